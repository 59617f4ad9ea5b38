"""The thin registered queries ``opN_<name>``: each applies its operator, with production parameters, to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .audit import audit
from .linededup import dedup_lines
from .mixing import mix
from .neardup import near_duplicates
from .packing import pack_near_documents
from .private import find_private, span_digests
from .resample import quality_classifier
from .rules import host_quality
from .stamps import normalise
from .tiff import text_to_tiff, tiff_documents
from .tokens import count_tokens
from .toxicity import toxicity
from .urlfilter import filter_urls


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_tiff_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts stored as TIFF files, walked and decoded again."""
    return tiff_documents(text_to_tiff(_table(spark, sf_dir, "documents")))


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's pieces with their bins; near copies never share one."""
    return pack_near_documents(_table(spark, sf_dir, "documents"))


def op3_crf_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's score; offending byte spans come along."""
    return toxicity(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op4_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that the mix takes of every document."""
    return mix(_table(spark, sf_dir, "documents"))


def op5_host_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Measures and verdicts; a document's host is its source."""
    out = host_quality(_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op6_quality_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log weight and verdict of every document."""
    return quality_classifier(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's text less its later copies of repeated line runs."""
    return dedup_lines(_table(spark, sf_dir, "documents")).select("doc_id", "n_lines", "n_deleted", "text")


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A verdict on every page's URL."""
    return filter_urls(_table(spark, sf_dir, "pages")).select("page_id", "host", "path", "rule", "verdict")


def op9_minhash_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's shingles, component and whether it is the one that stays."""
    return near_duplicates(_table(spark, sf_dir, "documents"))


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's tokens."""
    return count_tokens(_table(spark, sf_dir, "documents"))


def op11_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's base spans, counted and digested, and all spans."""
    return span_digests(find_private(_table(spark, sf_dir, "documents")))


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each order of the five filters keeps and removes of every language's documents."""
    return audit(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op13_stamp_normalisation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every stamp's instant, by which rule, and whether it was ambiguous."""
    return normalise(_table(spark, sf_dir, "stamps"))


QUERIES = {
    q.__name__: q
    for q in (
        op1_tiff_media, op2_best_fit_packing, op3_crf_toxicity, op4_source_mixing, op5_host_rules, op6_quality_resampling, op7_line_dedup, op8_url_filter, op9_minhash_neardup, op10_token_counts,
        op11_personal_data, op12_filter_audit, op13_stamp_normalisation,
    )
}
