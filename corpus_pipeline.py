"""From raw documents to packed sequences: quality, line dedup, near-dedup, mixing, packing.

Every stage takes whole texts, however long, and gives an empty table for an empty one.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lectern.llm.common import cut, discard
from lectern.llm.linededup import dedup_lines
from lectern.llm.mixing import mixed_documents
from lectern.llm.neardup import near_components
from lectern.llm.packing import pack_documents
from lectern.llm.resample import fit, is_kept, with_weights


def _rest(docs: DataFrame) -> Column:
    """All columns but id and text as one, so that none clashes with a stage's own."""
    return F.struct(*[F.col(f"`{c}`") for c in docs.columns if c not in ("doc_id", "text")], F.lit(0).alias("_")).alias("rest")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Importance resampling against the labelled good documents; rejected documents go.

    Texts without words stay, and so does every document where labels tell nothing. Repeated rows share their draw and
    stay or go together; ties with the last sampled one stay. Columns are carried whole, whatever their names.
    """
    model = fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    weighed = with_weights(docs.select("doc_id", "text", _rest(docs)), model)
    return weighed.where(is_kept(model)).select(*[F.col(c) if c in ("doc_id", "text") else F.col("rest")[c].alias(c) for c in docs.columns])


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later copies of repeated line runs go; every document stays, with what is left of its text.

    A null text stays null, a text of which all lines go becomes empty. Rows equal in id and text are one document and keep the
    same lines. ``n_chars`` follows the text; other columns are carried whole, whatever their names.
    """
    out = dedup_lines(docs.select("doc_id", "text", _rest(docs)))
    length = F.length("text").cast("long")
    return out.select(*[F.col(c) if c in ("doc_id", "text") else length.alias(c) if c == "n_chars" else F.col("rest")[c].alias(c) for c in docs.columns])


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each component stays, the one with the smallest id; rows without words stay, once for each id.

    Ids need not name a row: a row is found by its id and text, and of rows equal in both the first by the other
    columns stays. Without an id, rows without words cannot be told to be one document, and all stay.
    """
    no_id = F.col("doc_id").isNull()
    row = F.struct(no_id.alias("no_id"), F.coalesce(F.col("doc_id").cast("long"), F.lit(0)).alias("id"), F.col("hash"))
    rows = near_components(docs.withColumn("hash", F.xxhash64("text")), ("hash",)).select("component", row.alias("row"))
    full = rows.where("component is not null").groupBy("component").agg(F.min("row").alias("row")).select("row.*", F.lit(False).alias("empty"))
    empty = rows.where("component is null").select("row.*").distinct().withColumn("empty", F.lit(True))
    keyed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"), no_id.alias("no_id"), F.coalesce(F.col("doc_id").cast("long"), F.lit(0)).alias("id"), F.xxhash64("text").alias("hash"))
    met = keyed.join(full.unionByName(empty), ["no_id", "id", "hash"])
    others = [F.col("doc")[c] for c in docs.columns if c not in ("doc_id", "text")]
    first = Window.partitionBy("no_id", "id", "hash").orderBy(*(others or [F.lit(0)]))
    return met.withColumn("n", F.row_number().over(first)).where("n = 1 or (no_id and empty)").select("doc.*")


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as its source's target takes it.

    Documents without words are not taken. A null source is a source of its own. Of equal rows some may be taken once more than others.
    """
    return mixed_documents(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Bins of whole documents and pieces, without two of one source or one text in a bin.

    A null source conflicts with nothing; documents without words are in no bin; equal rows are packed each.
    """
    return pack_documents(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality classifier", quality),
    ("line dedup", line_dedup),
    ("MinHash near-dedup", near_dedup),
    ("mixing", mixing),
    ("best-fit packing", packing),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each is written to the shared checkpoint folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        before, docs = docs, cut(stage(spark, docs, sf_dir))
        discard(before)
    return STAGES[-1][1](spark, docs, sf_dir)


#: No SQL: hashed models, Gumbel draws and best-fit packing have no counterpart in DuckDB; tested by brute force.
ORACLE_SQL: str | None = None
