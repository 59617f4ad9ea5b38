"""Reciprocal rank fusion of ranked lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def rrf(rank: Column, k: int = 60, weight: float = 1.0) -> Column:
    return F.lit(float(weight)) / (F.lit(k) + rank)


def ranked(results: DataFrame, score: str, id_: str) -> DataFrame:
    """Ranks from 1 over a list that a top-k has already bounded."""
    return results.withColumn("rank_no", F.row_number().over(Window.orderBy(F.desc(score), id_)))


def fuse(dense: DataFrame, sparse: DataFrame, id_: str = "chunk_id", top_k: int = 5, dense_weight: float = 0.5, sparse_weight: float = 0.5, k: int = 60) -> DataFrame:
    """``(id, dense_rank, sparse_rank, score)`` of the best of two bounded lists (similarity, rank); ties favour the dense one."""
    d = ranked(dense, "similarity", id_).select(id_, F.col("rank_no").alias("dense_rank"))
    s = ranked(sparse, "rank", id_).select(id_, F.col("rank_no").alias("sparse_rank"))
    score = F.coalesce(rrf(F.col("dense_rank"), k, dense_weight), F.lit(0.0)) + F.coalesce(rrf(F.col("sparse_rank"), k, sparse_weight), F.lit(0.0))
    both = d.join(s, id_, "full_outer").withColumn("score", score)
    return both.orderBy(F.desc("score"), F.asc_nulls_last("dense_rank"), F.asc_nulls_last("sparse_rank")).limit(top_k)
