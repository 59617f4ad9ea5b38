"""A stored inverted index: posting blocks under block maxima, read by term, kept up to date by replaced books.

A block is a range of ``BLOCK`` chunk ids. For each lexeme and block one row holds the ids, their positions and the most positions that
any of them has, stored by hash of the lexeme, so that a search reads the buckets of its terms alone and, of these, narrow columns first.
No chunk of a block ranks over what the maxima of the query's lexemes allow. A search ranks the few most promising blocks, which gives a
k-th best rank, and then only the blocks whose maxima may still reach it: dynamic pruning, and exact.

Chunks of a book that is replaced are not rewritten. Their ids become dead up to the segment of that change, and new postings are added
as that segment; ``compact`` makes one segment of all again. Postings, owners and dead ids change in one transaction of the store.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions.text import lexemes, stems
from ..sources.store import Store
from .fulltext import cover_rank, query_terms
from .vector import top_k

BLOCK = 128
#: Blocks that are ranked first, for the k-th best rank.
FIRST = 16
RANK = 0.1
_POSTINGS = "lexeme string, block long, segment int, most int, ids array<long>, places array<array<int>>"
_PACKED = _POSTINGS.replace("segment int, ", "")


class StoredIndex:
    """Tables ``<name>_postings``, ``<name>_owners`` and ``<name>_dead`` of a store. Chunk ids are unique longs."""

    def __init__(self, store: Store, name: str = "index", stemmed: bool = True, buckets: int = 64) -> None:
        self.store, self.name, self.stemmed, self.buckets = store, name, stemmed, buckets

    def _schemas(self) -> dict[str, tuple[str, str]]:
        return {"postings": (_POSTINGS, "lexeme"), "owners": ("book_id long, chunk_id long, block long", "book_id"), "dead": ("block long, chunk_id long, segment int", "block")}

    def _table(self, part: str, keys: list | None = None) -> DataFrame:
        return self.store.read(f"{self.name}_{part}", keys=keys)

    def _blocks(self, chunks: DataFrame, segment: Column) -> DataFrame:
        """``chunks(chunk_id, content)`` as posting rows."""
        tokens = lexemes(F.col("content"))
        # texts go to their block once and are packed where they lie; only packed rows are dealt anew, by lexeme
        dealt = chunks.select(F.floor(F.col("chunk_id") / BLOCK).cast("long").alias("block"), F.col("chunk_id").cast("long").alias("chunk_id"), "content")
        dealt = dealt.repartition("block").sortWithinPartitions("block", "chunk_id")
        rows = dealt.select("block", "chunk_id", (stems(tokens) if self.stemmed else tokens).alias("words")).mapInArrow(_pack, _PACKED)
        return rows.withColumn("segment", segment).select(*StructType.fromDDL(_POSTINGS).fieldNames())

    def build(self, chunks: DataFrame) -> None:
        """The index of ``chunks(chunk_id, book_id, content)``, in place of what there was."""
        spark = self.store.spark
        with self.store.transaction() as tx:
            for part, (schema, key) in self._schemas().items():
                if (table := f"{self.name}_{part}") not in tx.tables:
                    tx.create(table, StructType.fromDDL(schema), key, self.buckets)
            tx.overwrite(f"{self.name}_postings", self._blocks(chunks, F.lit(0)), ["lexeme", "block"])
            tx.overwrite(f"{self.name}_owners", _owners(chunks))
            tx.overwrite(f"{self.name}_dead", spark.createDataFrame([], self._schemas()["dead"][0]))
            tx.properties[f"{self.name}_segment"] = 0

    def replace(self, chunks: DataFrame) -> None:
        """The chunks of the books in ``chunks(chunk_id, book_id, content)`` in place of theirs; ids may be used again."""
        self._change(chunks.select(F.col("book_id").cast("long").alias("book_id")).distinct(), chunks)

    def remove(self, books: DataFrame) -> None:
        """The chunks of ``books(book_id)`` go."""
        self._change(books.select(F.col("book_id").cast("long").alias("book_id")).distinct(), None)

    def _change(self, books: DataFrame, chunks: DataFrame | None) -> None:
        with self.store.transaction() as tx:
            segment = tx.properties[f"{self.name}_segment"] + 1
            gone = tx.read(f"{self.name}_owners").join(books, "book_id", "left_semi")
            tx.append(f"{self.name}_dead", gone.select("block", "chunk_id", F.lit(segment).alias("segment")))
            tx.delete(f"{self.name}_owners", books)
            if chunks is not None:
                tx.append(f"{self.name}_postings", self._blocks(chunks, F.lit(segment)), ["lexeme", "block"])
                tx.append(f"{self.name}_owners", _owners(chunks))
            tx.properties[f"{self.name}_segment"] = segment

    def compact(self) -> None:
        """One segment of all that is alive."""
        with self.store.transaction() as tx:
            alive = _alive(_entries(tx.read(f"{self.name}_postings")), tx.read(f"{self.name}_dead"))
            tx.overwrite(f"{self.name}_postings", _packed(alive.withColumn("segment", F.lit(0))), ["lexeme", "block"])
            tx.overwrite(f"{self.name}_dead", tx.read(f"{self.name}_dead").limit(0))
            tx.properties[f"{self.name}_segment"] = 0

    def search(self, query: str, k: int = 10, id_: str = "chunk_id", allowed: DataFrame | None = None) -> DataFrame:
        """``(id, rank)`` as ``sparse_search`` gives them; with ``allowed(chunk_id)`` of these chunks only."""
        terms = query_terms(query, self.stemmed)
        rows = self._table("postings", terms) if terms else self._table("postings", [])
        if not terms:
            return rows.select(F.lit(0).cast("long").alias(id_), F.lit(0.0).alias("rank")).limit(0)
        heads = rows.groupBy("block", "lexeme").agg(F.max("most").alias("most")).groupBy("block").agg(F.count("*").alias("held"), F.sum("most").alias("most"))
        heads = heads.where(F.col("held") == len(terms)).select("block", (F.col("most") * RANK).alias("bound"))
        first = [r["block"] for r in heads.orderBy(F.desc("bound"), "block").limit(FIRST).collect()]
        best = self._ranked(rows.where(F.col("block").isin(*first)), self._table("dead", first), terms, k, allowed).collect() if first else []
        found = self.store.spark.createDataFrame([tuple(r) for r in best], "chunk_id long, rank double")
        rest = heads.where(~F.col("block").isin(*first)) if first else heads
        if len(best) == k:
            worst = best[-1]
            # a bound is a sum of many tenths: a hair over it is not a better rank
            rest = rest.where((F.col("bound") > worst["rank"] + 1e-9) | ((F.col("bound") >= worst["rank"] - 1e-9) & (F.col("block") * BLOCK < worst["chunk_id"])))
        if first and not rest.isEmpty():
            more = rows.join(rest.select("block"), "block", "left_semi")
            found = top_k(found.unionByName(self._ranked(more, self._table("dead"), terms, k, allowed)), "rank", "chunk_id", k)
        return top_k(found.withColumnRenamed("chunk_id", id_), "rank", id_, k)

    def _ranked(self, rows: DataFrame, dead: DataFrame, terms: list[str], k: int, allowed: DataFrame | None) -> DataFrame:
        entries = _entries(rows)
        if allowed is not None:
            entries = entries.join(allowed.select(F.col("chunk_id").cast("long").alias("chunk_id")), "chunk_id", "left_semi")
        alive = _alive(entries, dead)
        met = alive.groupBy("chunk_id").agg(F.collect_list("positions").alias("p")).where(F.size("p") == len(terms))
        rank = F.size(F.col("p")[0]) * F.lit(RANK) if len(terms) == 1 else cover_rank(F.col("p"), len(terms))
        return top_k(met.select("chunk_id", rank.alias("rank")), "rank", "chunk_id", k)


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows ``(block, chunk_id, words)`` in this order as ``_PACKED`` rows; a worker holds the postings of one block."""
    held: dict[str, tuple[list[int], list[list[int]]]] = {}
    last = None

    def packed() -> pa.RecordBatch:
        ids, places = ([x[i] for x in held.values()] for i in (0, 1))
        most = [max(map(len, x)) for x in places]
        return pa.RecordBatch.from_arrays([pa.array(held, pa.string()), pa.array([last] * len(held), pa.int64()), pa.array(most, pa.int32()), pa.array(ids, pa.list_(pa.int64())), pa.array(places, pa.list_(pa.list_(pa.int32())))], ["lexeme", "block", "most", "ids", "places"])

    for batch in batches:
        for start in range(0, batch.num_rows, BLOCK):
            for block, chunk, words in zip(*(c.to_pylist() for c in batch.slice(start, BLOCK).columns), strict=True):
                if block != last and held:
                    yield packed()
                    held.clear()
                last = block
                at: dict[str, list[int]] = {}
                for i, w in enumerate(words or (), 1):
                    if w is not None:
                        at.setdefault(w, []).append(i)
                for w, places in at.items():
                    entry = held.setdefault(w, ([], []))
                    entry[0].append(chunk)
                    entry[1].append(places)
    if held:
        yield packed()


def _owners(chunks: DataFrame) -> DataFrame:
    return chunks.select(F.col("book_id").cast("long").alias("book_id"), F.col("chunk_id").cast("long").alias("chunk_id"), F.floor(F.col("chunk_id") / BLOCK).cast("long").alias("block"))


def _packed(each: DataFrame) -> DataFrame:
    """``each(lexeme, block, segment, chunk_id, positions)``, a row for each lexeme and block: at most ``BLOCK`` ids."""
    held = F.sort_array(F.collect_list(F.struct(F.col("chunk_id").cast("long").alias("id"), F.col("positions").alias("at")))).alias("held")
    return each.groupBy("lexeme", "block", "segment").agg(F.max(F.size("positions")).alias("most"), held).select("lexeme", "block", "segment", "most", F.col("held.id").alias("ids"), F.col("held.at").alias("places"))


def _entries(rows: DataFrame) -> DataFrame:
    each = rows.select("lexeme", "block", "segment", F.explode(F.arrays_zip("ids", "places")).alias("x"))
    return each.select("lexeme", "block", "segment", F.col("x.ids").alias("chunk_id"), F.col("x.places").alias("positions"))


def _alive(entries: DataFrame, dead: DataFrame) -> DataFrame:
    """Entries less those of chunks that were replaced after their segment."""
    last = dead.groupBy("block", "chunk_id").agg(F.max("segment").alias("until"))
    return entries.join(last, ["block", "chunk_id"], "left").where(F.col("until").isNull() | (F.col("segment") >= F.col("until"))).drop("until")
