"""Vector search as JVM expressions: exact cosine, top-k, filters, two-stage search.

The query is a literal array, so a search is one scan with a bounded heap in each task and no join.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FILTERS = ("domain", "subject", "author", "media_type", "published", "file_type")


def doubles(v: Column) -> Column:
    return F.transform(v, lambda x: x.cast("double"))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def l2_norm(v: Column) -> Column:
    return F.sqrt(dot(v, v))


def l2_normalize(v: Column) -> Column:
    """A unit vector; one of (almost) no length is left as it is."""
    n = l2_norm(v)
    return F.when(n < 1e-12, doubles(v)).otherwise(F.transform(v, lambda x: x.cast("double") / n))


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / (l2_norm(a) * l2_norm(b))


def literal(vector: list[float]) -> Column:
    return F.array(*[F.lit(float(x)) for x in vector])


def filter_condition(filters: dict | None) -> Column:
    """A conjunction of substring matches (``%`` and ``_`` are wildcards); unknown keys and None are left out."""
    out = []
    for k, v in (filters or {}).items():
        if v is None:
            continue
        if k in FILTERS:
            out.append(F.col(k).ilike(f"%{v}%"))
        elif k == "in_directory":
            out.append(F.col(k) == int(v))
    return reduce(lambda a, b: a & b, out, F.lit(True))


def top_k(scored: DataFrame, score: str, id_: str, k: int) -> DataFrame:
    """The k best rows, ties by id: a heap of k rows in each task, never a full sort."""
    return scored.orderBy(F.desc(score), id_).limit(k)


def dense_search(rows: DataFrame, vector: list[float], k: int, id_: str, embedding: str = "embedding", filters: dict | None = None) -> DataFrame:
    """Nearest rows by cosine: filters reach the scan, rows without a vector are left out."""
    kept = rows.where(F.col(embedding).isNotNull()).where(filter_condition(filters))
    return top_k(kept.withColumn("similarity", cosine(F.col(embedding), literal(vector))), "similarity", id_, k)


def hierarchical_search(books: DataFrame, chunks: DataFrame, vector: list[float], top_books: int = 3, chunks_per_book: int = 3, filters: dict | None = None) -> DataFrame:
    """The best chunks of the best books: at most ``top_books`` ids are broadcast, the limit is over all of them."""
    best = dense_search(books, vector, top_books, "book_id", "metadata_embedding", filters).select("book_id")
    return dense_search(chunks.join(F.broadcast(best), "book_id", "left_semi"), vector, top_books * chunks_per_book, "chunk_id")
