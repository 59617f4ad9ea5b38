"""Mixing sources to target weights by systematic sampling.

Each document's expected copies (its source's target over its source's size) are prefix-summed within the
source, one random offset is added, and a copy is emitted for every integer boundary crossed. Documents stand
in order of size, so every stretch of sizes gets its share and the words taken come near the target.

The prefix sum is distributed: documents fall into cells (source, size, one of ``LANES`` lanes by a digest of the id), cells are
counted before the shuffle and summed along a source, and only within a cell are rows numbered. A source, or a group of
documents of one size, with a third of all rows is thus ``LANES`` cells and never one task. Sources are a table
like any other: they are ranked where they lie, and a few sums over them reach the driver.
"""

from __future__ import annotations

from itertools import accumulate

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, cut, text_of

#: Weights of the sources in order of code points, repeating; their share of all words; and the cap on repeats.
WEIGHTS = (5.0, 2.0, 1.0)
PERCENT = 150
MOST_TIMES = 2
LANES = 1024
SEED = "lectern-mix-1"


def _ranked(sources: DataFrame) -> DataFrame:
    """``sources`` with ``rank`` from 0 by code points, null last; one count a partition reaches the driver."""
    placed = sources.orderBy(F.col("source").isNull(), "source").select("*", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("row"))
    placed = cut(placed)
    counts = sorted((r["part"], r["n"]) for r in placed.groupBy("part").agg(F.count("*").alias("n")).collect())
    starts = dict(zip((p for p, _ in counts), accumulate((n for _, n in counts), initial=0), strict=False))
    start = F.lit(0).cast("long")
    if starts:
        start = F.create_map(*[F.lit(x) for pair in starts.items() for x in pair])[F.col("part")].cast("long")
    return placed.withColumn("rank", start + F.col("row").bitwiseAND((1 << 33) - 1)).drop("part", "row")


def source_targets(sources: DataFrame, weights: tuple[float, ...] = WEIGHTS, percent: int = PERCENT, most: int = MOST_TIMES) -> DataFrame:
    """``sources(source, n)``, one row each -> ``(source, source_size, target, rate)``.

    Weighted shares of ``percent`` of all words; what is above ``most`` times a source's size is reshared by weight
    until none is above. Each round is one sum over the sources at their cap. A source without words gets nothing.
    """
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("rank") % len(weights) + 1).cast("int"))
    x = cut(_ranked(sources).withColumn("w", weight).withColumn("cap", most * F.col("n")))
    all_n, all_w = x.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("w"), F.lit(0.0))).first()
    left, heavy, capped, full = all_n * percent / 100, all_w, 0, F.lit(False)
    while heavy > 0:
        # caps only join from round to round, for what is left a unit of weight only grows
        full = F.lit(float(left)) * F.col("w") / F.lit(float(heavy)) > F.col("cap")
        n, words, w = x.where(full).agg(F.count("*"), F.coalesce(F.sum("cap"), F.lit(0)), F.coalesce(F.sum("w"), F.lit(0.0))).first()
        if n == capped:
            break
        capped, left, heavy = n, all_n * percent / 100 - words, all_w - w
    else:
        full = F.lit(True)
    target = F.when(full, F.col("cap").cast("double")).otherwise(F.lit(float(left)) * F.col("w") / F.lit(float(heavy or 1)))
    rate = F.when(F.col("n") > 0, F.col("target") / F.col("n")).otherwise(0.0)
    return x.withColumn("target", target).select("source", F.col("n").alias("source_size"), "target", rate.alias("rate"))


def offset_of(source: Column, seed: str = SEED) -> Column:
    """The source's random offset in [0, 1), from the first 32 bits of a digest."""
    return _digest(F.concat(F.lit(seed), F.lit("/"), F.coalesce(source, F.lit("")))).cast("double") / float(1 << 32)


def _digest(text: Column) -> Column:
    """The first 32 bits of a digest."""
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 8), 16, 10).cast("long")


def with_copies(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, percent: int = PERCENT, seed: str = SEED) -> DataFrame:
    """``(doc_id, source, text_hash, size, source_size, target, copies)``, a row for each input row.

    ``size`` counts the words of the whole text (null: 0). A null source is a source of its own, after all
    others. A document without words gets no copy, and so does every document of a source without words. Rows
    equal in id, source and text are interchangeable, and number as separate rows. Where the id is null its text
    stands in. Texts are counted whole, however long. Extra columns are not read; an empty table gives an empty table.
    """
    narrow = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.col("source").cast("string").alias("source"),
        F.xxhash64(text_of()).alias("text_hash"),
        F.regexp_count(text_of(), F.lit(WORD)).cast("long").alias("size"),
    )
    lane = _digest(F.coalesce("doc_id", "text_hash").cast("string")) % LANES
    sized = cut(narrow.withColumn("lane", lane))
    table = source_targets(sized.groupBy("source").agg(F.sum("size").alias("n")), weights, percent).withColumnRenamed("source", "of")
    used = sized.where("size > 0")
    cells = used.groupBy("source", "size", "lane").agg(F.count("*").alias("n"))
    by_size = cells.groupBy("source", "size").agg(F.sum("n").alias("n"))
    # a source's distinct sizes are few (bounded by its longest text); lanes are LANES at most
    below = by_size.withColumn("below", F.sum("n").over(Window.partitionBy("source").orderBy("size").rowsBetween(Window.unboundedPreceding, -1))).drop("n")
    beside = cells.withColumn("beside", F.sum("n").over(Window.partitionBy("source", "size").orderBy("lane").rowsBetween(Window.unboundedPreceding, -1))).drop("n")
    start = beside.join(below.select(F.col("source").alias("s"), F.col("size").alias("z"), "below"), F.col("source").eqNullSafe(F.col("s")) & (F.col("size") == F.col("z")))
    start = start.select(F.col("source").alias("s"), F.col("size").alias("z"), F.col("lane").alias("l"), (F.coalesce("below", F.lit(0)) + F.coalesce("beside", F.lit(0))).alias("before"))
    numbered = sized.withColumn("nth", F.row_number().over(Window.partitionBy("source", "size", "lane").orderBy("doc_id", "text_hash")))
    placed = numbered.join(start, F.col("source").eqNullSafe(F.col("s")) & (F.col("size") == F.col("z")) & (F.col("lane") == F.col("l")), "left").drop("s", "z", "l")
    # no hint: the planner broadcasts sources while they are small and shuffles once they are many
    placed = placed.join(table, F.col("source").eqNullSafe(F.col("of")), "left").drop("of")
    u, index = offset_of(F.col("source"), seed), F.coalesce("before", F.lit(0)) + F.col("nth")
    crossed = F.floor(F.col("rate") * index + u) - F.floor(F.col("rate") * (index - 1) + u)
    return placed.select("doc_id", "source", "text_hash", "size", "source_size", "target", F.when(F.col("size") > 0, crossed).otherwise(0).cast("long").alias("copies"))


def mix(docs: DataFrame) -> DataFrame:
    """``docs(doc_id, text, source, ...)`` -> ``(doc_id, size, source_size, target, taken)``, a row for each input row."""
    return with_copies(docs).select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


def mixed_documents(docs: DataFrame) -> DataFrame:
    """The documents themselves, each as often as it was taken; columns as in ``docs``.

    Copies are told by (doc_id, source, text), so equal rows are taken alike in number, in whatever order.
    """
    chosen = with_copies(docs).groupBy("doc_id", "source", "text_hash").agg(F.sum("copies").alias("total"), F.count("*").alias("rows")).where("total > 0")
    names = docs.columns
    kept = docs.select(F.struct(*[F.col(f"`{n}`") for n in names]).alias("row"), F.col("doc_id").cast("long").alias("k1"), F.col("source").cast("string").alias("k2"), F.xxhash64(text_of()).alias("k3"))
    joined = kept.join(chosen, F.col("k1").eqNullSafe(F.col("doc_id")) & F.col("k2").eqNullSafe(F.col("source")) & (F.col("k3") == F.col("text_hash")))
    # equal rows share their copies: whole ones each, the rest to as many of them
    single = joined.where("rows = 1").select("row", F.col("total").cast("int").alias("times"))
    several = joined.where("rows > 1").withColumn("nth", F.row_number().over(Window.partitionBy("k1", "k2", "k3").orderBy(F.lit(0))))
    several = several.select("row", (F.floor(F.col("total") / F.col("rows")) + (F.col("nth") <= F.col("total") % F.col("rows")).cast("int")).cast("int").alias("times"))
    return single.union(several).select("row", F.explode(F.array_repeat(F.lit(0), F.col("times"))).alias("copy")).select("row.*")
