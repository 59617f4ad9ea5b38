"""Token counts with the library of a public tokenizer file, in Arrow functions that return lengths only.

Every text is encoded by the library that defines the result, in calls of about ``BATCH_BYTES`` bytes: short
texts go together, and a long text is cut at safe boundaries, so that calls are balanced by bytes whatever the
lengths of the texts are. A boundary is safe where a run of non-white-space ends: the byte-level pre-tokenizer
splits there, so no token reaches over it, a text's count is the sum over its parts, and memory is bounded.

Files whose tokens may cross white space (SentencePiece models, and .json files with another pre-tokenizer or a
normalizer) are encoded without cutting, a long text in a call of its own.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import pieces, text_of

#: UTF-8 bytes of one call to the encoder.
BATCH_BYTES = 500_000
#: Longer texts are cut at the next safe boundary after so many characters (a character has four bytes at most).
PART_CHARS = 100_000
#: White space to the pre-tokenizer and to Python alike follows what is none to either.
_SAFE = re.compile(r"(?<=\S)(?=[ \t\n\r])")


class Counter:
    """Counts tokens as the library of ``path`` gives them, without begin, end or added special tokens."""

    def __init__(self, path: str) -> None:
        self.cuts = False
        if path.endswith(".json"):
            from tokenizers import Tokenizer

            with open(path, encoding="utf-8") as f:
                kind = json.load(f)
            tokenizer = Tokenizer.from_file(path)
            tokenizer.no_truncation()
            tokenizer.no_padding()
            added, pre = kind.get("added_tokens") or (), kind.get("pre_tokenizer") or {}
            plain = not any(x["lstrip"] or x["rstrip"] or x["single_word"] or re.search(r"\s", x["content"]) for x in added)
            self.cuts = plain and not kind.get("normalizer") and pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space")
            self.encode = lambda texts: [len(x) for x in tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        else:
            import sentencepiece

            model = sentencepiece.SentencePieceProcessor(model_file=path)
            self.encode = lambda texts: [len(x) for x in model.encode(texts, num_threads=1)]

    def parts(self, text: str) -> Iterator[str]:
        """A text in parts that no token crosses."""
        at = 0
        while self.cuts and len(text) - at > PART_CHARS and (m := _SAFE.search(text, at + PART_CHARS)):
            yield text[at : m.start()]
            at = m.start()
        yield text[at:] if at else text

    def counts(self, texts: list[str]) -> list[int]:
        """The number of tokens of each text, in calls that are balanced by bytes."""
        out, batch, owners, held = [0] * len(texts), [], [], 0

        def flush() -> None:
            for i, n in zip(owners, self.encode(batch), strict=True):
                out[i] += n
            batch.clear()
            owners.clear()

        for i, text in enumerate(texts):
            for part in self.parts(text):
                size = len(part.encode())
                if batch and held + size > BATCH_BYTES:
                    flush()
                    held = 0
                batch.append(part)
                owners.append(i)
                held += size
        if batch:
            flush()
        return out


def count_tokens(docs: DataFrame, path: str | None = None, limit: int = 1024) -> DataFrame:
    """``docs(doc_id, text, ...)`` -> ``(doc_id, n_bytes, n_tokens, over_limit)``, a row for each input row.

    ``path`` is the tokenizer file (``byte_bpe_50k.json`` of the installed public vocabularies if not given),
    the same on every worker. A null text counts as empty: 0 bytes, 0 tokens. Special strings inside a text are
    treated as the library's default treats them. A null doc_id stays null; repeated rows are counted each; an empty
    table gives an empty table. Only ``doc_id`` and ``text`` are read, so no other column clashes.
    """
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("byte_bpe_50k.json")

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        counter = None
        for batch in pieces(batches):
            counter = counter or Counter(path)
            n = pa.array(counter.counts(batch.column("text").to_pylist()), pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("n_bytes"), n], ["doc_id", "n_bytes", "n_tokens"])

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text")).withColumn("n_bytes", F.octet_length("text").cast("long"))
    return texts.mapInArrow(counted, "doc_id long, n_bytes long, n_tokens long").withColumn("over_limit", F.col("n_tokens") > limit)
