"""Answers of lookup services as tables: acceptance, precedence, negative answers, and the cache they are kept in."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.metadata import accepts_crossref, accepts_open_library, clean_isbn, isbn_valid
from .cache import KeyedLog
from .enrich import LOOKUP, LOOKUP_SCHEMA, isbn_key

#: Documents of one answer that are looked at, and authors that are named.
FIRST_DOCUMENTS, FIRST_AUTHORS = 2, 3


def _data(source: str, **given: Column) -> Column:
    text = [F.coalesce(given[c].cast("string"), F.lit(None)).alias(c) if c in given else F.lit(source if c == "source" else None).cast("string").alias(c) for c in LOOKUP]
    return F.struct(*text, given.get("revision", F.lit(None)).cast("int").alias("revision"))


def _names(c: Column) -> Column:
    return F.when(F.size(c) > 0, F.array_join(F.slice(c, 1, FIRST_AUTHORS), ", "))


def open_library_answers(wanted: DataFrame, docs: DataFrame) -> DataFrame:
    """``(key, data)`` for ``wanted(key, query)``: of the first documents of a query, the first whose title is accepted.

    ``docs(query, place, title, author_name, first_publish_year, publisher, language, first_sentence, edition_count)``, places from 0.
    """
    near = docs.where(F.col("place") < FIRST_DOCUMENTS).join(wanted, "query").where(accepts_open_library(F.col("query"), F.col("title")))
    best = near.groupBy("key").agg(F.min_by(F.struct(*[c for c in docs.columns if c not in ("query", "place")]), "place").alias("x"))
    count = F.col("x.edition_count")
    data = _data(
        "OpenLibrary", author=_names(F.col("x.author_name")), published=F.col("x.first_publish_year"), publisher=F.try_element_at("x.publisher", F.lit(1)),
        language=F.coalesce(F.try_element_at("x.language", F.lit(1)), F.lit("en")), summary=F.col("x.first_sentence"), revision=F.when(count > 1, count),
    )
    return best.select("key", data.alias("data"))


def crossref_answers(wanted: DataFrame, works: DataFrame) -> DataFrame:
    """``(key, data)``: a query's first work, if its title is accepted. ``works(query, place, title, author, published, publisher)``."""
    first = works.where("place = 0").join(wanted, "query").where(accepts_crossref(F.col("query"), F.coalesce("title", F.lit(""))))
    return first.select("key", _data("Crossref", author=_names(F.col("author")), published=F.col("published"), publisher=F.col("publisher")).alias("data"))


def isbn_open_library(docs: DataFrame) -> DataFrame:
    """``(key, data)`` by number: the first document of each ``isbn``, with its title and without an acceptance test. Columns as in ``docs`` above, and ``subtitle``."""
    first = docs.where("place = 0")
    data = _data(
        "OpenLibrary:ISBN", title=F.col("title"), subtitle=F.col("subtitle"), author=_names(F.col("author_name")), publisher=F.try_element_at("publisher", F.lit(1)),
        published=F.col("first_publish_year"), language=F.coalesce(F.try_element_at("language", F.lit(1)), F.lit("en")), summary=F.col("first_sentence"),
    )
    return first.select(isbn_key(clean_isbn(F.col("isbn"))).alias("key"), data.alias("data"))


def isbn_google(volumes: DataFrame) -> DataFrame:
    """``(key, data)`` by number: the first of ``volumes(isbn, place, title, subtitle, authors, publisher, published_date, language, description)``."""
    data = _data(
        "GoogleBooks:ISBN", title=F.col("title"), subtitle=F.col("subtitle"), author=_names(F.col("authors")), publisher=F.col("publisher"),
        published=F.left("published_date", F.lit(4)), language=F.coalesce("language", F.lit("en")), summary=F.col("description"),
    )
    return volumes.where("place = 0").select(isbn_key(clean_isbn(F.col("isbn"))).alias("key"), data.alias("data"))


def wanted_isbns(front: DataFrame) -> DataFrame:
    """``(key)`` of every valid number that front matter names."""
    return front.where(isbn_valid(F.col("isbn"))).select(isbn_key(clean_isbn(F.col("isbn"))).alias("key")).distinct()


def answers(wanted: DataFrame, *services: DataFrame) -> DataFrame:
    """A cache row ``(key, hit, data)`` for every wanted key: the first service's answer that there is, else a negative one."""
    out = wanted.select("key").distinct()
    for i, s in enumerate(services):
        out = out.join(s.select("key", F.col("data").alias(f"_{i}")), "key", "left")
    data = F.coalesce(*[F.col(f"_{i}") for i in range(len(services))])
    return out.select("key", data.isNotNull().alias("hit"), data.alias("data"))


def read_cache(spark: SparkSession, path: str) -> DataFrame:
    """A stored cache, one row a key, the newest; one that is not there or cannot be read is empty."""
    return KeyedLog(spark, path, LOOKUP_SCHEMA).read()


def save_cache(fresh: DataFrame, path: str, run: int | None = None) -> int:
    """New rows added to a stored cache as a run; the same run again replaces its first try. Returns the run's number."""
    return KeyedLog(fresh.sparkSession, path, LOOKUP_SCHEMA).append(fresh, run)


def import_cache(spark: SparkSession, path: str) -> DataFrame:
    """A cache kept as one JSON object (key to answer, an empty answer being a negative one); a bad file is an empty cache."""
    fields = [*LOOKUP, "revision"]
    try:
        with open(path, encoding="utf-8") as f:
            held = json.load(f).items()
        rows = [(k, bool(v), tuple(v.get(c) if c == "revision" or v.get(c) is None else str(v[c]) for c in fields) if v else None) for k, v in held]
    except (OSError, ValueError, AttributeError):
        rows = []
    return spark.createDataFrame(rows, LOOKUP_SCHEMA)
