"""Shared plumbing of the training-data operators: checkpoints, sizing, Arrow batches."""

from __future__ import annotations

import atexit
import gc
import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of anything but these; str/bytes ``split`` on ASCII white space agrees.
WORD = r"[^\x20\x09-\x0D]+"
NOT_WORD_CHARS = r"[\x20\x09-\x0D]"

_folder = ""

#: Arrow batches are cut into pieces of about this many bytes before any per-token arrays are made.
PIECE_BYTES = 2_000_000


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder for checkpoints; one of our own only where the session names none (tests)."""
    sc = spark.sparkContext
    where = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if not where:
        where = sc.getCheckpointDir()
    if not where:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        where = tempfile.mkdtemp(prefix="lectern-checkpoints-")
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(where)
    return where


def _scratch(spark: SparkSession) -> str:
    """This driver's own folder for cuts; it goes when the driver ends."""
    global _folder
    where = f"{checkpoint_dir(spark)}/lectern-{spark.sparkContext.applicationId}"
    if where != _folder:
        _folder = where
        atexit.register(_delete, spark, where)
    return where


def _delete(spark: SparkSession, path: str) -> None:
    sc = spark.sparkContext
    if sc._jsc is not None:  # else the session has ended before its driver
        at = sc._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(sc._jsc.hadoopConfiguration()).delete(at, True)


def cut(df: DataFrame) -> DataFrame:
    """``df`` with its lineage cut: written as a table in the shared folder and read again.

    A lost executor costs one task, later reads prune columns, and the planner knows the true size.
    """
    spark = df.sparkSession
    path = f"{_scratch(spark)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._stored_at = path
    return out


def discard(*frames: DataFrame | None) -> None:
    """Delete the tables behind frames from ``cut`` that nothing reads any more."""
    for df in frames:
        if df is not None and (path := df.__dict__.pop("_stored_at", None)):
            _delete(df.sparkSession, path)


def tidy(spark: SparkSession) -> None:
    """Have shuffle files deleted whose plans are done: Spark does so when the driver collects its garbage."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


#: A key is hot when it holds more than one row in so many; hence there are fewer hot keys than this, however large the table.
HOT = 1000


def join_counted(rows: DataFrame, counted: DataFrame, keys: list[str]) -> DataFrame:
    """``rows`` joined with their line of ``counted`` (stored; one line a key, ``n`` rows of it), without ``n``.

    Rows of hot keys, whose lines are fewer than ``HOT``, meet them by broadcast where they lie, so no task gets all rows of such
    a key; the others are shuffled. Keys are not null. ``rows`` is read twice if there are hot keys.
    """
    total, most = counted.agg(F.sum("n"), F.max("n")).first()
    if total is None or most * HOT <= total:
        return rows.join(counted.drop("n"), keys)
    hot = F.col("n") * HOT > total
    few = counted.where(hot).drop("n")
    others = rows.join(F.broadcast(few.select(keys)), keys, "left_anti").join(counted.where(~hot).drop("n"), keys)
    return rows.join(F.broadcast(few), keys).unionByName(others)


def tasks(spark: SparkSession) -> int:
    """Shuffle partitions of the session, the unit by which fixed-size work is dealt out."""
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def text_of(name: str = "text") -> Column:
    """The text, null as empty."""
    return F.coalesce(F.col(name), F.lit(""))


def shuffled_text_hash(name: str = "text") -> Column:
    return F.xxhash64(text_of(name))


def pieces(batches: Iterator[pa.RecordBatch], column: str = "text", most: int = PIECE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches cut so that ``column`` holds about ``most`` bytes in each (one row at least)."""
    for batch in batches:
        if batch.num_rows == 0:
            continue
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        start = held = 0
        for i, n in enumerate(sizes):
            if held and held + n > most:
                yield batch.slice(start, i - start)
                start, held = i, 0
            held += int(n)
        yield batch.slice(start)
