"""Conflict-constrained best-fit packing of documents into bins of a fixed number of words.

Two documents conflict when they share a source or a duplicate cluster; a bin never holds both. Open bins stand
in order of what room they have left, each with bitmaps of its sources and clusters; a document goes to the
tightest bin that it fits and does not conflict with: the search begins at the first bin with room enough and
goes on to its successors until one is compatible, else a bin is opened. Documents longer than a bin are
cut into whole bins, and only the remainder is packed.

Packing is sequential by nature, so documents are dealt to independent shards of about ``SHARD`` pieces by a
hash; the number of shards follows the count of documents, and memory does not. What a shard is given does
not depend on source or cluster, so hot groups spread over all shards.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import NOT_WORD_CHARS, WORD, cut, text_of
from .neardup import near_components

CAPACITY = 2048
SHARD = 4096
SEED = 29


def best_fit(sizes: list[int], sources: list[int], clusters: list[int], capacity: int) -> tuple[list[int], list[int]]:
    """Bin of each item (sizes from 1 to ``capacity``, best in descending order), and each bin's room left.

    ``sources`` and ``clusters`` are bitmaps with one bit set (or none, for what conflicts with nothing). Bins of
    equal room are tried in order of opening. A bin too full for the smallest item leaves the order.
    """
    smallest = min(sizes, default=1)
    room: list[int] = []
    held: list[tuple[int, int]] = []
    order: list[tuple[int, int]] = []  # (room, bin)
    out = []
    for size, source, cluster in zip(sizes, sources, clusters, strict=True):
        at = bisect_left(order, (size, -1))
        while at < len(order):
            own = held[order[at][1]]
            if not (own[0] & source or own[1] & cluster):
                break
            at += 1
        if at < len(order):
            left, bin_ = order.pop(at)
            held[bin_] = (held[bin_][0] | source, held[bin_][1] | cluster)
        else:
            left, bin_ = capacity, len(room)
            room.append(capacity)
            held.append((source, cluster))
        left -= size
        room[bin_] = left
        if left >= smallest:
            insort(order, (left, bin_))
        out.append(bin_)
    return out, room


def _bits(values: np.ndarray, single: bool) -> list[int]:
    """A bitmap for each value; values met once need no bit if ``single``."""
    seen = Counter(values.tolist())
    place: dict = {}
    return [0 if single and seen[v] == 1 else 1 << place.setdefault(v, len(place)) for v in values.tolist()]


def pack(items: DataFrame, capacity: int = CAPACITY, shard: int = SHARD) -> DataFrame:
    """``items(doc_id, source, cluster, size)`` -> ``(doc_id, piece, start, words, shard, bin, room)``.

    Sizes are words; ``start`` is the piece's first word, ``room`` what its bin has left. Items of size 0 (and of
    null size) are one piece of no words in no bin (null). A null source or cluster conflicts with nothing.
    Equal items are interchangeable. An empty table gives an empty table.
    """
    kept = items.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("source").alias("s"), F.col("source").isNull().alias("no_s"), F.xxhash64("cluster").alias("c"), F.col("cluster").isNull().alias("no_c"), F.coalesce("size", F.lit(0)).cast("long").alias("size"))
    n = kept.where("size > 0").count()
    shards = max(1, -(-n // shard))
    # equal items are counted before the shuffle and told apart by a number, so that they spread like all others
    copies = kept.where("size > 0").groupBy(*kept.columns).agg(F.count("*").alias("n")).withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("n")))).drop("n")
    salted = copies.withColumn("shard", F.pmod(F.xxhash64("doc_id", "s", "c", "copy", F.lit(SEED)), F.lit(shards))).drop("copy")
    names = "doc_id long, piece long, start long, words long, shard long, bin long, room long"

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = pa.Table.from_batches(list(batches))
        number = t.column("shard")[0].as_py()
        size = t.column("size").to_numpy()
        doc = np.array([-(1 << 62) if x is None else x for x in t.column("doc_id").to_pylist()], np.int64)
        s, c = t.column("s").to_numpy(), t.column("c").to_numpy()
        rest = size % capacity
        whole = size // capacity
        full = np.flatnonzero(whole)
        order = np.lexsort((c, s, doc, -rest))
        order = order[rest[order] > 0]
        source = _bits(s[order], False)
        cluster = _bits(c[order], True)
        for bits, none in ((source, t.column("no_s")), (cluster, t.column("no_c"))):
            blank = none.to_numpy(zero_copy_only=False)[order]
            for i in np.flatnonzero(blank):
                bits[i] = 0
        bins, room = best_fit(rest[order].tolist(), source, cluster, capacity)
        item = np.concatenate([order, np.repeat(full, whole[full])])
        piece = np.concatenate([whole[order], *[np.arange(k) for k in whole[full]]])
        bin_ = np.concatenate([np.array(bins, np.int64), len(room) + np.arange(whole[full].sum())])
        left = np.concatenate([np.array(room, np.int64)[np.array(bins, np.int64)] if bins else np.zeros(0, np.int64), np.zeros(whole[full].sum(), np.int64)])
        words = np.concatenate([rest[order], np.full(whole[full].sum(), capacity)])
        ids = t.column("doc_id").take(pa.array(item)).combine_chunks()
        arrays = [ids, *[pa.array(x.astype(np.int64)) for x in (piece, piece * capacity, words, np.full(len(item), number), bin_, left)]]
        yield from pa.Table.from_arrays(arrays, names=[x.split()[0] for x in names.split(", ")]).to_batches()

    result = salted.groupBy("shard").applyInArrow(lambda t: pa.Table.from_batches(list(packed(iter(t.to_batches())))), names)
    none = kept.where("size <= 0").select("doc_id", F.lit(0).cast("long").alias("piece"), F.lit(0).cast("long").alias("start"), F.lit(0).cast("long").alias("words"), *[F.lit(None).cast("long").alias(x) for x in ("shard", "bin", "room")])
    return result.unionByName(none)


def pack_documents(docs: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Documents by their number of words, conflicting by source and by equal lower-cased word sequence.

    This is for documents without near copies; ``pack_near_documents`` finds those first. A null text has no words. Only ``doc_id``, ``text`` and ``source`` are read.
    """
    text = text_of()
    same = F.xxhash64(F.trim(F.regexp_replace(F.lower(text), NOT_WORD_CHARS + "+", " ")))
    items = docs.select("doc_id", F.col("source").cast("string").alias("source"), same.alias("cluster"), F.regexp_count(text, F.lit(WORD)).alias("size"))
    return pack(cut(items), capacity)


def pack_near_documents(docs: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Documents by their number of words, conflicting by source and by near-duplicate component.

    Components are those of ``near_components`` over lower-cased texts, so that texts which differ in case and
    white space alone, in any script, are one cluster here too. A null text has no words. Repeated rows are packed each, and in different
    bins, as they are one cluster; a text of more than ``capacity`` words fills bins of its own first, however long. An empty table gives an empty table.
    """
    own = docs.select("doc_id", F.col("source").cast("string").alias("source"), F.lower("text").alias("text"))
    items = near_components(own, ("source",)).select("doc_id", "source", F.col("component").alias("cluster"), F.col("n_words").alias("size"))
    return pack(cut(items), capacity)
