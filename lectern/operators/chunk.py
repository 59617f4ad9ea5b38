"""Documents to pages to overlapping chunks within a token budget.

Filling a chunk depends on what the one before it left over, so it runs along a document in an Arrow function;
documents are independent, nothing is shuffled, and a worker holds one batch.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.titles import strip

_SENTENCE = re.compile(r"(?<=[.!?])\s+")
CHUNK_SCHEMA = "book_id long, chunk_index int, content string, page_number int, section_title string, token_count int, char_count int"
_ARROW = {"long": pa.int64(), "int": pa.int32(), "string": pa.string()}
#: Documents of an Arrow batch that are worked on at a time.
DOCUMENTS = 64


def estimate(text: str) -> int:
    """Tokens by words and by characters, the mean of both."""
    if not text:
        return 0
    return max(1, (int(len(text.split()) * 1.33) + 1 + len(text) // 4 + 1) // 2)


@dataclass(frozen=True)
class Budget:
    target: int = 512
    overlap: int = 64
    least: int = 30

    def carried(self) -> int:
        return min(self.overlap, self.target // 2)


def _tail(units: list[tuple[str, int]], most: int) -> list[tuple[str, int]]:
    """The last units within ``most`` tokens, one at least."""
    keep = used = 0
    for _, n in reversed(units):
        if keep and used + n > most:
            break
        keep, used = keep + 1, used + n
    return units[len(units) - keep :]


def chunk_pages(pages: list[tuple[int, str, str | None]], budget: Budget = Budget()) -> list[tuple]:
    """Chunks ``(index, content, page, section, tokens, chars)`` of pages ``(number, text, section)``.

    Paragraphs are the units; one over the target goes by sentences, which do not move the chunk's page. A full
    chunk is emitted unless it is under the least; its tail starts the next one. The rest at the end is
    emitted if it is large enough or nothing else was.
    """
    paragraphs = [(p, number, section) for number, text, section in pages for p in (x.strip() for x in re.split(r"\n\s*\n", text)) if p]
    if not paragraphs:
        return []
    out: list[tuple] = []
    held: list[tuple[str, int]] = []
    _, page, section = paragraphs[0]

    def emit(last: bool = False) -> None:
        tokens = sum(n for _, n in held)
        if tokens >= budget.least or (last and not out):
            content = "\n\n".join(t for t, _ in held).strip()
            out.append((len(out), content, page, section, tokens, len(content)))

    for paragraph, number, title in paragraphs:
        size = estimate(paragraph)
        whole = size <= budget.target
        units = [(paragraph, size)] if whole else [(s, estimate(s)) for s in (x.strip() for x in _SENTENCE.split(paragraph)) if s]
        for unit in units:
            if held and sum(n for _, n in held) + unit[1] > budget.target:
                emit()
                held = _tail(held, budget.carried())
                if whole:
                    page, section = number, title
            held.append(unit)
            page, section = (page if whole else page or number), section or title
    if held:
        emit(last=True)
    return out


def chunk_documents(pages: DataFrame, budget: Budget = Budget()) -> DataFrame:
    """``pages(book_id, pages array<struct<page_number, text, section_title>>)`` -> chunks, one row each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _chunks(batches, budget)

    return pages.select(F.col("book_id").cast("long").alias("book_id"), "pages").mapInArrow(run, CHUNK_SCHEMA)


def _chunks(batches: Iterator[pa.RecordBatch], budget: Budget) -> Iterator[pa.RecordBatch]:
    """Chunks of a few documents at a time, however many a batch has: only these are objects."""
    schema = pa.schema([(n, _ARROW[t]) for n, t in (x.split() for x in CHUNK_SCHEMA.split(", "))])
    for batch in batches:
        for start in range(0, batch.num_rows, DOCUMENTS):
            few = batch.slice(start, DOCUMENTS)
            rows = [(book, *c) for book, ps in zip(few["book_id"].to_pylist(), few["pages"].to_pylist(), strict=True) for c in chunk_pages([(p["page_number"], p["text"], p["section_title"]) for p in ps], budget)]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


def one_page(text: Column, section: Column | None = None) -> Column:
    """A document of a single page."""
    return F.array(F.struct(F.lit(1).alias("page_number"), F.coalesce(text, F.lit("")).alias("text"), (F.lit(None).cast("string") if section is None else section).alias("section_title")))


def paragraphs(text: Column) -> Column:
    return F.filter(F.transform(F.split(text, r"(?U)\n\s*\n"), strip), lambda p: F.length(p) > 0)


def sentences(text: Column) -> Column:
    return F.filter(F.transform(F.split(text, r"(?<=[.!?])\s+"), strip), lambda p: F.length(p) > 0)
