"""New catalog files merged into a stored table, micro-batch by micro-batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from ..operators.merge import last_by_priority
from ..sources.store import BUCKETS, Store


def merge_stream(spark: SparkSession, source: str, schema: StructType, path: str, key: str, checkpoint: str, name: str = "rows", buckets: int = BUCKETS) -> StreamingQuery:
    """Rows of arriving Parquet files upserted into a table of the store at ``path``.

    A batch rewrites the buckets that its rows fall in. Its number is committed with it, so a batch that runs again changes nothing.
    """

    def upsert(batch: DataFrame, number: int) -> None:
        done = f"batch:{name}"
        with Store(spark, path).transaction() as tx:
            if tx.properties.get(done, -1) >= number:
                return
            if name not in tx.tables:
                tx.create(name, schema, key, buckets)
            tx.merge(name, last_by_priority([batch], key))
            tx.properties[done] = number

    return spark.readStream.schema(schema).parquet(source).writeStream.foreachBatch(upsert).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
