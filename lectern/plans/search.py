"""Search plans over books and chunks: each is one logical plan; at most k rows reach the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.context import citation, context, prompt
from ..operators.fulltext import indexed_search, sparse_search
from ..operators.fusion import fuse
from ..operators.index import StoredIndex
from ..operators.vector import dense_search, filter_condition


def _within(chunks: DataFrame, books: DataFrame, filters: dict | None) -> DataFrame:
    """Chunks of the books that pass the filters: only the books' ids travel, and none of their columns."""
    return chunks.join(books.where(filter_condition(filters)).select("book_id"), "book_id", "left_semi")


def _winners(found: DataFrame, chunks: DataFrame, books: DataFrame) -> DataFrame:
    """A bounded result with the columns of its chunks and books, fetched last."""
    rows = chunks.drop("embedding").join(F.broadcast(found), "chunk_id")
    return rows.join(books.drop("embedding", "metadata_embedding"), "book_id", "left")


def _dense(chunks: DataFrame, books: DataFrame, vector: list[float], k: int, filters: dict | None) -> DataFrame:
    return dense_search(_within(chunks.select("chunk_id", "book_id", "embedding"), books, filters), vector, k, "chunk_id").select("chunk_id", "similarity")


def _sparse(chunks: DataFrame, books: DataFrame, query: str, k: int, filters: dict | None, stemmed: bool, index: DataFrame | StoredIndex | None) -> DataFrame:
    if isinstance(index, StoredIndex):
        allowed = None if not filters else _within(chunks.select("chunk_id", "book_id"), books, filters)
        return index.search(query, k, allowed=allowed)
    if index is not None:
        return indexed_search(_within(index, books, filters), query, k, stemmed=stemmed)
    return sparse_search(_within(chunks.select("chunk_id", "book_id", "content"), books, filters), query, k, stemmed=stemmed)


def search_chunks_dense(chunks: DataFrame, books: DataFrame, vector: list[float], k: int = 10, filters: dict | None = None) -> DataFrame:
    return _winners(_dense(chunks, books, vector, k, filters), chunks, books)


def search_chunks_sparse(chunks: DataFrame, books: DataFrame, query: str, k: int = 10, filters: dict | None = None, stemmed: bool = True, index: DataFrame | StoredIndex | None = None) -> DataFrame:
    """With an ``index`` (a ``StoredIndex``, or stored ``postings`` that carry ``book_id``) no text is read before the winners'."""
    return _winners(_sparse(chunks, books, query, k, filters, stemmed, index), chunks, books)


def search_hybrid(
    chunks: DataFrame, books: DataFrame, vector: list[float], query: str, top_k: int = 5, arm_k: int = 20, weights: tuple[float, float] = (0.5, 0.5), rrf_k: int = 60,
    filters: dict | None = None, stemmed: bool = True, index: DataFrame | StoredIndex | None = None,
) -> DataFrame:
    """Both arms, fused by reciprocal ranks, with the winners' columns."""
    fused = fuse(_dense(chunks, books, vector, arm_k, filters), _sparse(chunks, books, query, arm_k, filters, stemmed, index), "chunk_id", top_k, *weights, rrf_k)
    return _winners(fused, chunks, books)


def answer_prompt(results: DataFrame, question: str, score: str = "score", most: int = 8000) -> DataFrame:
    """A prompt of the passages in order of score, ties by chunk."""
    cited = results.withColumn("cited", citation(F.col("clean_title"), F.col("author"), F.col("section_title"), F.col("page_number"))).withColumn("_order", F.struct(-F.col(score), "chunk_id"))
    return prompt(context(cited, "_order", "cited", "content", most), question)
