"""Merging rows into keyed tables without a lakehouse: every upsert is one full outer join."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Side = Callable[[str], Column]


def merge(target: DataFrame, source: DataFrame, key: str, update: dict[str, Callable[[Side, Side], Column]] | None = None, insert: dict[str, Callable[[Side], Column]] | None = None) -> DataFrame:
    """``source`` into ``target`` by ``key`` (unique on either side).

    A row on both sides takes ``update`` (default: every source column but the key; other columns stay), one only
    in the source is inserted with ``insert`` (default: its own columns, null where it has none), one only in the
    target stays. The result has the target's columns.
    """
    t, s = target.withColumn("_t", F.lit(True)).alias("t"), source.withColumn("_s", F.lit(True)).alias("s")
    old: Side = lambda c: F.col(f"t.`{c}`")
    new: Side = lambda c: F.col(f"s.`{c}`")
    shared = set(source.columns)
    if update is None:
        update = {c: (lambda o, n, c=c: n(c)) for c in target.columns if c in shared and c != key}
    if insert is None:
        insert = {}
    columns = []
    for c in target.columns:
        if c == key:
            columns.append(F.coalesce(old(key), new(key)).alias(key))
            continue
        kind = target.schema[c].dataType
        both = update[c](old, new) if c in update else old(c)
        fresh = insert[c](new) if c in insert else new(c) if c in shared else F.lit(None)
        columns.append(F.when(F.col("s._s").isNull(), old(c)).when(F.col("t._t").isNull(), fresh.cast(kind)).otherwise(both.cast(kind)).alias(c))
    return t.join(s, old(key) == new(key), "full_outer").select(*columns)


def last_by_priority(parts: list[DataFrame], key: str) -> DataFrame:
    """A union in which a later part's row replaces an earlier one's of the same key."""
    out = parts[0].withColumn("_p", F.lit(0))
    for i, p in enumerate(parts[1:], 1):
        out = out.unionByName(p.withColumn("_p", F.lit(i)), allowMissingColumns=True)
    rest = F.struct(*[c for c in out.columns if c != "_p"])
    return out.groupBy(key).agg(F.max_by(rest, "_p").alias("row")).select("row.*")


def fold_by_key(df: DataFrame, key: str, order: str, greatest: tuple[str, ...] = ()) -> DataFrame:
    """One row a key: the greatest of some columns, of all others the last value that is not null."""
    columns = [F.max(c).alias(c) if c in greatest else F.max_by(c, F.when(F.col(c).isNotNull(), F.col(order))).alias(c) for c in df.columns if c not in (key, order)]
    return df.groupBy(key).agg(F.min(order).alias(order), *columns)


def sync_catalog(catalog: DataFrame, statuses: DataFrame, list_path: str = "", now: Column | None = None) -> DataFrame:
    """Matched, missing and unlisted records into a catalog by ``clean_title``; the last of these three wins on a title.

    A missing record that the catalog does not know is inserted with its own path, else ``list_path``. Where the catalog has ``updated_at`` (and
    ``created_at``), every row that is touched gets ``now``; inserted ones get both.
    """
    now = F.current_timestamp() if now is None else now
    row = lambda side, path, flag: F.struct(F.col(f"{side}.clean_title").alias("clean_title"), F.col(f"{side}.raw_title").alias("raw_title"), path.alias("source_path"), F.lit(flag).alias("in_directory"))
    part = lambda s, side, path, flag: statuses.where(F.col("status") == s).select(row(side, path, flag).alias("r")).select("r.*")
    listed = F.coalesce("list.source_path", F.lit(list_path))
    rows = last_by_priority([part("matched", "list", F.col("dir.source_path"), 1), part("missing", "list", listed, 0), part("unlisted", "dir", F.col("dir.source_path"), 1)], "clean_title")
    update = {"in_directory": lambda o, n: n("in_directory"), "source_path": lambda o, n: F.when(n("in_directory") == 1, n("source_path")).otherwise(o("source_path")), "updated_at": lambda o, n: now}
    return merge(catalog, rows, "clean_title", update, {"updated_at": lambda n: now, "created_at": lambda n: now})


def sync_counts(statuses: DataFrame) -> DataFrame:
    """One row: how many records of each status a synchronisation takes in."""
    n = lambda s: F.coalesce(F.sum((F.col("status") == s).cast("long")), F.lit(0))
    return statuses.agg(n("matched").alias("matched_synced"), n("missing").alias("missing_synced"), n("unlisted").alias("unlisted_synced"))


def reclean(catalog: DataFrame, cleaned: Column) -> DataFrame:
    """Titles cleaned anew from raw ones; empty ones are skipped, rows that fall together are folded."""
    fresh = catalog.withColumn("clean_title", cleaned).where(F.length("clean_title") > 0)
    return fold_by_key(fresh, "clean_title", "id", ("in_directory",))


def replace_chunks(chunks: DataFrame, fresh: DataFrame, key: str = "book_id") -> DataFrame:
    """Chunks of the books in ``fresh`` replaced; books of which nothing comes keep what they have."""
    return chunks.join(fresh.select(key).distinct(), key, "left_anti").unionByName(fresh, allowMissingColumns=True)


def verify(df: DataFrame, key: str, required: tuple[str, ...] = ()) -> DataFrame:
    """One row: rows, duplicate keys, and nulls among required columns."""
    nulls = [F.coalesce(F.sum(F.col(f"no_{c}")), F.lit(0)).alias(f"null_{c}") for c in required]
    marked = df.groupBy(key).agg(F.count("*").alias("n"), *[F.sum(F.col(c).isNull().cast("long")).alias(f"no_{c}") for c in required])
    return marked.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("rows"), F.coalesce(F.sum((F.col("n") > 1).cast("long")), F.lit(0)).alias("duplicate_keys"), *nulls)
