"""Caches as appended runs of keyed rows: the newest run's row of a key counts, a compaction leaves one row a key.

A run is one append under a number of its own, so a task or a driver that tries again under the same number replaces its first try and
adds nothing twice. Nothing that is stored is changed by an append; what cannot be read is an empty cache.
"""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..sources.files import Files

RUN = "run"


def newest(rows: DataFrame, key: str = "key", order: str | None = None) -> DataFrame:
    """One row a key: the one of the greatest ``order`` (a null order is the oldest), ties by the greatest of all values. Null keys go."""
    rest = [c for c in rows.columns if c != key]
    by = F.struct(*[F.col(f"`{c}`") for c in sorted(rest, key=lambda c: c != order)])
    return rows.where(F.col(key).isNotNull()).groupBy(key).agg(F.max(by).alias("_row")).select(key, *[F.col("_row")[c].alias(c) for c in rest]).select(*rows.columns)


class KeyedLog:
    """Rows of ``schema`` by ``key`` under ``path``, in folders ``run=<number>``."""

    def __init__(self, spark: SparkSession, path: str, schema: str, key: str = "key") -> None:
        self.spark, self.path, self.key, self.files = spark, path.rstrip("/"), key, Files(spark, path)
        self.schema = StructType.fromDDL(schema)

    def runs(self) -> list[int]:
        return sorted(int(x[4:]) for x in self.files.names(self.path) if x.startswith(f"{RUN}="))

    def append(self, rows: DataFrame, run: int | None = None) -> int:
        """Add a run; one that is there under its number already is replaced. Returns the number."""
        run = max(self.runs(), default=0) + 1 if run is None else run
        rows.select(*self.schema.fieldNames()).write.mode("overwrite").parquet(f"{self.path}/{RUN}={run}")
        return run

    def read(self) -> DataFrame:
        """One row a key, of the newest run that has it; empty where nothing is stored or it cannot be read."""
        try:
            rows = self.spark.read.schema(StructType([*self.schema.fields]).add(RUN, "long")).option("basePath", self.path).parquet(self.path)
        except AnalysisException:
            return self.spark.createDataFrame([], self.schema)
        return newest(rows, self.key, RUN).select(*self.schema.fieldNames())

    def misses(self, wanted: DataFrame) -> DataFrame:
        """Rows of ``wanted`` whose key is not stored; only keys are read."""
        return wanted.join(self.read().select(self.key).distinct(), self.key, "left_anti")

    def compact(self) -> int:
        """All runs as one, with one row a key, under the last one's number. Runs go only when the new one is whole."""
        runs = self.runs()
        if not runs:
            return 0
        beside = f"{self.path}/.compact-{uuid.uuid4().hex}"
        self.read().write.parquet(beside)
        after = runs[-1] + 1
        self.files.rename(beside, f"{self.path}/{RUN}={after}")
        for run in runs:
            self.files.delete(f"{self.path}/{RUN}={run}")
        return after
