"""Operations on a stored catalog: seeding, recleaning with new ids, id maps, the guard before ingestion, introspection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.merge import fold_by_key, merge
from ..operators.reconcile import number_rows
from ..schema import BOOKS, DEFAULTS, conform, differences

#: Rows to try a catalog with: one of each kind of record.
SAMPLES = (
    {"clean_title": "Pumps and Valves", "raw_title": "Pumps and Valves 2nd ed.pdf", "author": "A. Writer", "edition": "2nd Edition", "revision": 2, "media_type": "Book / Ebook", "file_type": "PDF", "file_extension": ".pdf", "in_directory": 1},
    {"clean_title": "Statistics Course", "raw_title": "Statistics Course", "media_type": "Course / Video Series", "file_type": "Directory / Folder", "file_extension": "", "in_directory": 1},
    {"clean_title": "Twenty Atlases", "raw_title": "Twenty Atlases", "media_type": "Collection / Resource Pack", "is_collection": 1, "file_type": "Directory / Folder", "file_extension": "", "in_directory": 0},
)


def sample_rows(spark: SparkSession) -> DataFrame:
    """``SAMPLES`` with their place from 1; what a sample does not say is its default, else null."""
    names = sorted({c for r in SAMPLES for c in r})
    kinds = ", ".join(f"{c} {BOOKS[c].dataType.simpleString()}" for c in names)
    return spark.createDataFrame([(i, *[r.get(c, DEFAULTS.get(c)) for c in names]) for i, r in enumerate(SAMPLES, 1)], f"place long, {kinds}")


def seed(catalog: DataFrame, records: DataFrame, now: Column | None = None) -> DataFrame:
    """``records`` (columns of the catalog and ``place``, unique from 1) into ``catalog`` by ``clean_title``.

    A known title takes every column that the records have; a new one is inserted with the declared defaults. As in a table
    that numbers its rows, a new row's id is the greatest id so far plus the record's place.
    """
    now = F.current_timestamp() if now is None else now
    last = catalog.agg(F.coalesce(F.max("id"), F.lit(0))).first()[0]
    given = [c for c in records.columns if c in catalog.columns and c not in ("id", "clean_title")]
    source = records.select("clean_title", *given, (F.lit(last) + F.col("place")).alias("id"))
    insert = {c: (lambda n, c=c: F.lit(v := DEFAULTS[c]) if c not in given else F.coalesce(n(c), F.lit(DEFAULTS[c]))) for c in DEFAULTS if c in catalog.columns}
    stamps = [c for c in ("created_at", "updated_at") if c in catalog.columns and c not in given]
    update = {c: (lambda o, n, c=c: n(c)) for c in given} | {c: (lambda o, n: now) for c in stamps if c == "updated_at"}
    return merge(catalog, source, "clean_title", update, insert | {c: (lambda n: now) for c in stamps})


def reclean_catalog(catalog: DataFrame, cleaned: Column, now: Column | None = None) -> DataFrame:
    """The catalog with titles cleaned anew and ids given again.

    Rows whose title becomes empty go; the others are numbered from 1 by their old id. Rows of one title are folded: the
    first one's number stays, ``in_directory`` is the greatest, of every other column the last value that is not null
    stays, and ``updated_at`` is ``now``, which a row that met no other does not get.
    """
    now = F.current_timestamp() if now is None else now
    kept = catalog.withColumn("clean_title", cleaned).where(F.length("clean_title") > 0)
    numbered = number_rows(kept.withColumnRenamed("id", "_old"), ["_old"]).drop("_old")
    folded = fold_by_key(numbered.withColumn("_last", F.col("id")), "clean_title", "id", ("in_directory", "_last"))
    if "updated_at" in catalog.columns:
        met = F.col("_last") > F.col("id")
        folded = folded.withColumn("updated_at", F.when(met, now.cast(catalog.schema["updated_at"].dataType)).otherwise(F.col("updated_at")))
    return folded.select(*catalog.columns)


def reclean_counts(catalog: DataFrame, cleaned: Column) -> DataFrame:
    """One row: rows that a recleaning processes, rows it skips, titles it leaves."""
    title = F.when(F.length(cleaned) > 0, cleaned)
    return catalog.select(title.alias("title")).agg(F.count("title").alias("processed"), (F.count("*") - F.count("title")).alias("skipped"), F.countDistinct("title").alias("titles"))


def id_map(books: DataFrame, stored: DataFrame) -> DataFrame:
    """``(source_id, book_id)``: the stored id of every book of a source, found by title."""
    return books.select(F.col("id").alias("source_id"), "clean_title").join(stored.select(F.col("id").alias("book_id"), "clean_title"), "clean_title").select("source_id", "book_id")


def documents_to_ingest(books: DataFrame, ids: DataFrame, found: DataFrame) -> DataFrame:
    """``(book_id, path)`` of the books whose chunks are to be made: those with a stored id and a path that is among ``found(path)``."""
    placed = books.where(F.length("source_path") > 0).select(F.col("id").alias("source_id"), F.col("source_path").alias("path"))
    return placed.join(found.select("path"), "path", "left_semi").join(ids, "source_id").select("book_id", "path")


def ingestion_report(stored: DataFrame, chunks: DataFrame, dimension: int) -> DataFrame:
    """One row: catalog rows, documents with chunks, chunks, and the vectors' dimension."""
    books = stored.agg(F.count("*").alias("catalog_records_ingested"))
    parts = chunks.groupBy("book_id").agg(F.count("*").alias("n")).agg(F.count("*").alias("documents_chunked"), F.coalesce(F.sum("n"), F.lit(0)).alias("total_chunks_ingested"))
    # one row on either side
    return books.join(F.broadcast(parts)).withColumn("vector_dimension", F.lit(dimension))


def introspect(catalog: DataFrame) -> DataFrame:
    """One row: rows, columns, the declared columns that are missing or of another type, and whether all is well."""
    wrong = sorted(c for c, what in differences(catalog) if what != "unknown")
    return catalog.agg(F.count("*").alias("row_count")).select("row_count", F.lit(len(catalog.columns)).alias("total_columns"), F.lit(", ".join(wrong)).alias("wrong_columns"), F.lit(not wrong).alias("valid"))


def declared(catalog: DataFrame) -> DataFrame:
    """The catalog in its declared columns, defaults where one is missing."""
    return conform(catalog, BOOKS, DEFAULTS)
