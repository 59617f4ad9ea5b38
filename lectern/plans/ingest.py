"""Ingestion: catalog rows with metadata vectors, documents to chunks with vectors, merged into stored tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.metadata import metadata_passage
from ..operators.chunk import Budget, chunk_documents
from ..operators.embed import embedded
from ..operators.merge import merge, replace_chunks


def catalog_rows(books: DataFrame, make: Callable[[], object]) -> DataFrame:
    """Books with defaults, and a vector of their metadata passage."""
    filled = books.withColumn("language", F.coalesce(F.when(F.length("language") > 0, F.col("language")), F.lit("en"))).withColumn("file_type", F.coalesce(F.when(F.length("file_type") > 0, F.col("file_type")), F.lit("Unknown")))
    passage = metadata_passage({c: F.col(c) for c in filled.columns})
    return embedded(filled.withColumn("_passage", passage), make, "_passage").withColumnRenamed("embedding", "metadata_embedding").drop("_passage")


def ingest_catalog(stored: DataFrame, books: DataFrame, make: Callable[[], object]) -> DataFrame:
    return merge(stored, catalog_rows(books, make), "id")


def ingest_documents(stored: DataFrame, pages: DataFrame, make: Callable[[], object], budget: Budget = Budget(), max_chunks: int | None = None) -> DataFrame:
    """Fresh chunks of ``pages(book_id, pages)`` in place of the stored ones."""
    chunks = chunk_documents(pages, budget)
    if max_chunks:
        chunks = chunks.where(F.col("chunk_index") < max_chunks)
    return replace_chunks(stored, embedded(chunks, make, "content").drop("char_count"))


def totals(chunks: DataFrame) -> DataFrame:
    return chunks.agg(F.count("*").alias("chunks"), F.countDistinct("book_id").alias("books"))
