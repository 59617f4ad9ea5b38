"""Reconciling a title list with a directory: keyed joins, statuses and a summary."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.files import scratch


def first_per_key(df: DataFrame, key: str, order: str | list[Column]) -> DataFrame:
    """The first row of each key in the given order. Aggregated before the shuffle, so a hot key is one row a task."""
    by = [F.col(order)] if isinstance(order, str) else order
    rest = F.struct(*[F.col(f"`{c}`") for c in df.columns])
    return df.groupBy(key).agg(F.min_by(rest, F.struct(*[b.alias(f"o{i}") for i, b in enumerate(by)])).alias("row")).select("row.*")


def last_per_key(df: DataFrame, key: str, order: str) -> DataFrame:
    rest = F.struct(*[F.col(f"`{c}`") for c in df.columns])
    return df.groupBy(key).agg(F.max_by(rest, F.col(order)).alias("row")).select("row.*")


def reconcile(listed: DataFrame, found: DataFrame, key: str = "normalized_title") -> DataFrame:
    """One full outer join of both sides, deduplicated by key: ``(key, list, dir, status)``.

    The first listed and the last found record of a key count. A null key matches nothing.
    """
    left = listed.select(F.col(key), F.struct(*listed.columns).alias("list"))
    right = found.select(F.col(key), F.struct(*found.columns).alias("dir"))
    out = left.join(right, key, "full_outer")
    status = F.when(F.col("list").isNull(), "unlisted").when(F.col("dir").isNull(), "missing").otherwise("matched")
    return out.withColumn("status", status)


def matched(listed: DataFrame, found: DataFrame, key: str = "normalized_title") -> DataFrame:
    return listed.join(found, key, "inner")


def missing(listed: DataFrame, found: DataFrame, key: str = "normalized_title") -> DataFrame:
    """Listed but not found: an anti join, nothing of the other side travels but its key."""
    return listed.join(found.select(key), key, "left_anti")


def unlisted(listed: DataFrame, found: DataFrame, key: str = "normalized_title") -> DataFrame:
    return found.join(listed.select(key), key, "left_anti")


def summarize(statuses: DataFrame) -> DataFrame:
    """One row of counts and the match rate in percent (0 for an empty list)."""
    n = lambda s: F.coalesce(F.sum((F.col("status") == s).cast("long")), F.lit(0))
    counts = statuses.agg(n("matched").alias("matched"), n("missing").alias("missing_from_dir"), n("unlisted").alias("unlisted_in_dir"))
    total = F.col("matched") + F.col("missing_from_dir")
    rate = F.when(total > 0, F.col("matched") / total * 100).otherwise(0.0)
    return counts.select(total.alias("total_list"), (F.col("matched") + F.col("unlisted_in_dir")).alias("total_dir"), "matched", "missing_from_dir", "unlisted_in_dir", rate.alias("match_rate"))


def number_rows(df: DataFrame, order: list[str], name: str = "id") -> DataFrame:
    """Dense ids from 1 by a total order, without one task for all rows: rows are sorted in ranges, stored, and numbered by the counts of the ranges before theirs.

    A row's place is stored with it, so it stays the same whatever is computed again. What is counted is one row a range.
    """
    spark = df.sparkSession
    path = scratch(spark)
    ranges = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    # the upper bits of this number tell the range, the lower 33 the place in it
    placed = df.repartitionByRange(ranges, *order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id())
    placed.write.parquet(path)
    rows = spark.read.schema(placed.schema).parquet(path).withColumn("_range", F.shiftright("_at", 33))
    sizes = rows.groupBy("_range").agg(F.count("*").alias("_n"))
    before = sizes.select("_range", F.coalesce(F.sum("_n").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    nth = F.col("_at").bitwiseAND(F.lit((1 << 33) - 1)) + 1
    return rows.join(F.broadcast(before), "_range").withColumn(name, F.col("_before") + nth).drop("_range", "_at", "_before")
