"""The catalog's and the chunks' declared schemas, additive evolution, and checks against them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType, IntegerType, LongType, StringType, StructField, StructType, TimestampType

# The catalog's columns in order.
BOOKS = StructType(
    [
        StructField("id", LongType()),
        StructField("clean_title", StringType()),
        StructField("subtitle", StringType()),
        StructField("raw_title", StringType()),
        StructField("author", StringType()),
        StructField("publisher", StringType()),
        StructField("published", StringType()),
        StructField("edition", StringType()),
        StructField("revision", IntegerType()),
        StructField("language", StringType()),
        StructField("domain", StringType()),
        StructField("subject", StringType()),
        StructField("subfield", StringType()),
        StructField("genre", StringType()),
        StructField("topics", StringType()),
        StructField("key_concepts", StringType()),
        StructField("target_audience", StringType()),
        StructField("media_type", StringType()),
        StructField("is_collection", IntegerType()),
        StructField("summary", StringType()),
        StructField("file_type", StringType()),
        StructField("file_extension", StringType()),
        StructField("source_path", StringType()),
        StructField("in_directory", IntegerType()),
        StructField("created_at", TimestampType()),
        StructField("updated_at", TimestampType()),
    ]
)
# The stored chunks' columns in order.
CHUNKS = StructType(
    [StructField("chunk_id", LongType()), StructField("book_id", LongType()), StructField("chunk_index", IntegerType()), StructField("content", StringType())]
    + [StructField("page_number", IntegerType()), StructField("section_title", StringType()), StructField("token_count", IntegerType())]
    + [StructField("embedding", ArrayType(FloatType(), False))]
)
# What a column holds where nothing is given.
DEFAULTS = {"revision": 1, "language": "en", "is_collection": 0, "in_directory": 0}


def create(spark: SparkSession, schema: StructType = BOOKS) -> DataFrame:
    """An empty table."""
    return spark.createDataFrame([], schema)


def conform(df: DataFrame, schema: StructType = BOOKS, defaults: dict | None = None) -> DataFrame:
    """Exactly the schema's columns and types: missing ones are null, or their default if ``defaults`` has one."""
    have = set(df.columns)
    given = defaults or {}
    return df.select(*[(F.col(f.name) if f.name in have else F.lit(given.get(f.name))).cast(f.dataType).alias(f.name) for f in schema.fields])


def add_missing(df: DataFrame, schema: StructType = BOOKS) -> DataFrame:
    """The table with the schema's missing columns added as nulls; columns of its own stay."""
    return df.withColumns({f.name: F.lit(None).cast(f.dataType) for f in schema.fields if f.name not in df.columns})


def differences(df: DataFrame, schema: StructType = BOOKS) -> list[tuple[str, str]]:
    """Columns that are missing, of another type, or not in the schema."""
    own, want = {f.name: f.dataType for f in df.schema.fields}, {f.name: f.dataType for f in schema.fields}
    out = [(c, "missing") for c in want if c not in own]
    out += [(c, f"{own[c].simpleString()} instead of {want[c].simpleString()}") for c in want if c in own and own[c] != want[c]]
    return out + [(c, "unknown") for c in own if c not in want]


def orphans(chunks: DataFrame, books: DataFrame) -> DataFrame:
    """Chunks of books that are not there."""
    return chunks.join(books.select(F.col("id").alias("book_id")), "book_id", "left_anti")


def drop_orphans(chunks: DataFrame, books: DataFrame) -> DataFrame:
    return chunks.join(books.select(F.col("id").alias("book_id")), "book_id", "left_semi")
