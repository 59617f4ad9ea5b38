"""Enrichment of catalog rows: rules, front matter and lookup tables fused by precedence, as one projection.

Online services are lookup tables here (``key``, ``hit``, ``data``): rows join them by key, what is missing is fetched
once elsewhere and appended, negative answers included. So a run is deterministic and scales as joins do.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions import metadata as M
from ..functions.text import html_snippet
from ..functions.titles import clean_title, strip
from .cache import newest
from .merge import merge

LOOKUP = ("title", "subtitle", "author", "publisher", "published", "language", "summary", "source")
LOOKUP_SCHEMA = "key string, hit boolean, data struct<" + ", ".join(f"{c}: string" for c in LOOKUP) + ", revision: int>"
FRONT_SCHEMA = "path string, title string, subtitle string, author string, publisher string, published string, language string, isbn string, revision int, edition string, summary string, source string"


def lookup_key(title: Column) -> Column:
    return F.lower(strip(title))


def isbn_key(isbn: Column) -> Column:
    return F.concat(F.lit("isbn:"), isbn)


def lookups_to_fetch(books: DataFrame, cache: DataFrame) -> DataFrame:
    """Distinct keys and queries that the cache has no answer to, not even a negative one."""
    want = books.select(lookup_key(F.col("clean_title")).alias("key"), M.search_query(F.col("clean_title")).alias("query")).where("query is not null").dropDuplicates(["key"])
    return want.join(cache.select("key"), "key", "left_anti")


def _once(df: DataFrame, fields: Column) -> DataFrame:
    """``df`` with the struct's fields as columns, computed once a row: the optimizer would put a projection's rules into every use of them, but not through a generator. As a lambda's body they stay out of the generated code, which they would make too long to compile.
    """
    return df.select("*", F.inline(F.transform(F.array(F.lit(0)), lambda _: fields)))


def spread(rows: DataFrame) -> DataFrame:
    """``rows`` dealt over the session's shuffle partitions: rules and title casing cost much a byte, so a small file, or a shuffle of few bytes, must not be one task."""
    return rows.repartition(max(1, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))))


def _left(rows: DataFrame, key: Column, few: DataFrame, own: str) -> DataFrame:
    """Left join by ``key``, which is ``own`` in ``few``. Rows without a key, mostly many, meet nothing and are dealt by their content, not all to one task."""
    salted = rows.withColumn("_k", key).withColumn("_salt", F.when(F.col("_k").isNull(), F.xxhash64(*[F.col(f"`{c}`") for c in rows.columns])).otherwise(F.lit(0).cast("long")))
    on = (F.col("_k") == F.col(own)) & (F.col("_salt") == F.col("_none"))
    # a literal zero would be no key of the join
    return salted.join(few.withColumn("_none", (F.length(own) * 0).cast("long")), on, "left").drop("_k", "_salt", "_none", own)


def enrich(books: DataFrame, front: DataFrame | None = None, cache: DataFrame | None = None) -> DataFrame:
    """``books(id, clean_title, raw_title, source_path, in_directory)`` -> all catalog columns.

    ``front`` has front matter by ``path``, ``cache`` answers by key. Without either, rules decide alone. A path or key that comes
    more than once counts once: the greatest ``run`` where there is such a column, then the greatest values.
    """
    titled = front is not None or cache is not None
    answers = None
    data = (StructType.fromDDL(LOOKUP_SCHEMA) if cache is None else cache.schema)["data"].dataType
    x = books
    if cache is not None:
        # the newest row of a key counts, also where it says that there is no answer
        answers = newest(cache, "key", "run" if "run" in cache.columns else None).where("hit")
    if front is None:
        x = x.withColumn("fm", F.lit(None).cast(StructType.fromDDL(FRONT_SCHEMA)))
    else:
        front = newest(front, "path", "run" if "run" in front.columns else None)
        fm = front.select(F.struct(*[F.col(c) if c in front.columns else F.lit(None).cast("int" if c == "revision" else "string").alias(c) for c in (x.split()[0] for x in FRONT_SCHEMA.split(", "))]).alias("fm"), F.col("path").alias("_path"))
        x = _left(x, F.col("source_path"), fm, "_path")
    if answers is None or front is None:
        x = x.withColumn("isbn_data", F.lit(None).cast(data))
    else:
        x = _left(x, isbn_key(F.col("fm.isbn")), answers.select(F.col("key").alias("_ik"), F.col("data").alias("isbn_data")), "_ik")
    blank = M.is_uninformative(F.col("clean_title"))
    useful = F.when(~M.is_uninformative(F.col("fm.title")), F.col("fm.title"))
    candidate = F.when(blank, F.coalesce(M.nonblank(F.col("isbn_data.title")), useful))
    if titled:
        # title casing is a Python function, which has no place in a lambda
        x = x.select("*", F.inline(F.array(F.struct(F.when(candidate.isNotNull(), clean_title(candidate)).alias("_better")))))
        x = x.withColumn("clean_title", F.coalesce("_better", "clean_title")).drop("_better")
    if answers is None:
        x = x.withColumn("title_data", F.lit(None).cast(data))
    else:
        x = _left(x, F.when(F.col("isbn_data").isNull(), lookup_key(F.col("clean_title"))), answers.select(F.col("key").alias("_tk"), F.col("data").alias("title_data")), "_tk")
    if titled:
        x = spread(x)
    api = lambda c: M.nonblank(F.coalesce(F.col("isbn_data"), F.col("title_data"))[c].cast("string"))
    isbn, page = (lambda c: M.nonblank(F.col(f"isbn_data.{c}"))), (lambda c: M.nonblank(F.col(f"fm.{c}")))
    raw, clean = F.coalesce("raw_title", F.lit("")), F.coalesce("clean_title", F.lit(""))
    info = M.file_info(F.when(F.length(F.coalesce("source_path", F.lit(""))) > 0, F.col("source_path")).otherwise(raw))
    x = x.select("*", F.inline(F.array(F.struct(info.alias("info")))))
    x = _once(x, F.struct(M.taxonomy(raw, clean).alias("tax"), M.edition_info(raw, clean).alias("ed")))
    x = _once(x, F.struct(M.media_class(raw, clean, F.col("info.file_type")).alias("media")))
    sub = F.coalesce(M.subtitle(clean), isbn("subtitle"), page("subtitle"))
    author = F.coalesce(api("author"), isbn("author"), page("author"), M.author(raw, clean))
    publisher = F.coalesce(api("publisher"), isbn("publisher"), page("publisher"), M.publisher(raw, clean))
    published = F.coalesce(api("published"), isbn("published"), page("published"), M.published_year(raw, clean))
    paged = F.col("fm.revision") > F.col("ed.revision")
    revision = F.when(paged, F.col("fm.revision")).otherwise(F.col("ed.revision"))
    edition = F.when(paged, F.coalesce(page("edition"), F.concat(F.col("fm.revision").cast("string"), F.lit("th Edition")))).otherwise(F.col("ed.edition"))
    counted = F.coalesce(F.col("isbn_data"), F.col("title_data"))["revision"]
    edition = F.when(counted > revision, F.concat(counted.cast("string"), F.lit("th Edition"))).otherwise(edition)
    told = (sub.alias("subtitle"), author.alias("author"), publisher.alias("publisher"), published.alias("published"), edition.alias("edition"), F.greatest(revision, F.coalesce(counted, F.lit(0))).alias("revision"))
    x = _once(x, F.struct(*told))
    found = F.coalesce(api("summary"), page("summary"))
    told = html_snippet(found)
    made = M.summary(F.col("clean_title"), F.col("subtitle"), F.col("author"), F.col("publisher"), F.col("published"), F.col("edition"), F.col("media.media_type"), F.col("tax.domain"), F.col("tax.subject"), F.col("tax.subfield"), F.col("tax.genre"))
    source = F.coalesce(api("source"), F.when(page("source") != "unsupported_format", page("source")), F.lit("local+rules"))
    return x.select(
        *[c for c in ("id",) if c in books.columns], "clean_title", "subtitle", "raw_title", "author", "publisher", "published", "edition", "revision",
        F.coalesce(api("language"), page("language"), F.lit("en")).alias("language"), *[F.col(f"tax.{c}").alias(c) for c in M.TAXONOMY_FIELDS],
        "media.media_type", "media.is_collection", F.when(F.length(told) >= 25, told).otherwise(made).alias("summary"), "info.file_type", F.col("info.extension").alias("file_extension"),
        "source_path", "in_directory", source.alias("source"),
    )


def enrichment_counts(enriched: DataFrame) -> DataFrame:
    """How many rows an online source enriched, and how many rules alone."""
    online = F.col("source").rlike("OpenLibrary|Crossref|GoogleBooks")
    return enriched.agg(F.count("*").alias("rows"), F.coalesce(F.sum(online.cast("long")), F.lit(0)).alias("online"), F.coalesce(F.sum((~online).cast("long")), F.lit(0)).alias("local"))


class TitleCollision(RuntimeError):
    """An update would give several rows one title."""


def title_collisions(catalog: DataFrame, fresh: DataFrame) -> DataFrame:
    """``(id, clean_title, holder)`` of the rows of ``fresh(id, clean_title)`` that cannot have the title they ask for.

    Titles are unique in ``catalog(id, clean_title)``. A row keeps its own; a new title is had by the smallest id that asks for it, and by none if another row
    holds it now, whatever that row asks for itself. ``holder`` is who has it. One aggregate over both finds them.
    """
    asked = fresh.select("id", F.col("clean_title").alias("title")).join(catalog.select("id", F.col("clean_title").alias("old")), "id").where(~F.col("title").eqNullSafe(F.col("old")) & F.col("title").isNotNull())
    claims = catalog.select(F.col("clean_title").alias("title"), F.col("id").alias("holds"), F.lit(None).cast(catalog.schema["id"].dataType).alias("asks"))
    claims = claims.unionByName(asked.select("title", F.lit(None).cast(catalog.schema["id"].dataType).alias("holds"), F.col("id").alias("asks")))
    first = claims.groupBy("title").agg(F.coalesce(F.min("holds"), F.min("asks")).alias("holder"), F.count("asks").alias("n")).where("n > 0")
    return asked.join(first, "title").where(F.col("holder") != F.col("id")).select("id", F.col("title").alias("clean_title"), "holder")


def enrich_update(catalog: DataFrame, fresh: DataFrame, collisions: str = "abort", named: int = 20) -> DataFrame:
    """``fresh`` (unique ids, columns of the catalog) into ``catalog`` by ``id``, its titles staying unique; unknown ids are ignored.

    With ``abort`` a collision raises ``TitleCollision``, with the number of rows and the first ``named`` of them, before anything is changed. With ``first``
    a row that cannot have its title keeps the old one and takes all else. A null title changes none.
    """
    if collisions not in ("abort", "first"):
        raise ValueError("collisions: abort or first")
    lost = title_collisions(catalog, fresh)
    if collisions == "abort":
        some = lost.orderBy("id").limit(named).collect()
        if some:
            raise TitleCollision(f"{lost.count()} rows cannot have their title, such as " + ", ".join(f"{r['id']}: {r['clean_title']!r} of {r['holder']}" for r in some))
    kept = fresh.join(lost.select("id", F.lit(True).alias("_lost")), "id", "left").withColumn("clean_title", F.when(F.col("_lost").isNull(), F.col("clean_title"))).drop("_lost")
    update = {c: (lambda o, n, c=c: n(c)) for c in fresh.columns if c in catalog.columns and c not in ("id", "clean_title")}
    update["clean_title"] = lambda o, n: F.coalesce(n("clean_title"), o("clean_title"))
    return merge(catalog, kept.join(catalog.select("id"), "id", "left_semi"), "id", update)
