"""Command line: reconcile a list with a directory, enrich a catalog, ingest documents, search."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .operators.embed import provider
from .operators.enrich import enrich
from .operators.reconcile import reconcile, summarize
from .operators.vector import dense_search, hierarchical_search
from .plans.ingest import ingest_documents
from .plans.search import search_chunks_dense, search_chunks_sparse, search_hybrid
from .sources.documents import document_pages, files
from .sources.sinks import report_text
from .sources.titles import directory_titles, list_directory, list_titles


def _parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="lectern", description=__doc__)
    sub = p.add_subparsers(dest="command", required=True)
    r = sub.add_parser("reconcile")
    r.add_argument("--list", required=True)
    r.add_argument("--directory", required=True)
    r.add_argument("--recursive", action="store_true")
    e = sub.add_parser("enrich")
    e.add_argument("--catalog", required=True)
    e.add_argument("--out", required=True)
    i = sub.add_parser("ingest")
    i.add_argument("--documents", required=True)
    i.add_argument("--out", required=True)
    i.add_argument("--provider", default=None)
    s = sub.add_parser("search")
    s.add_argument("--query", required=True)
    s.add_argument("--mode", choices=("hybrid", "vector", "keyword", "hierarchical", "books"), default="hybrid")
    s.add_argument("--books", required=True)
    s.add_argument("--chunks", required=True)
    s.add_argument("--provider", default=None)
    s.add_argument("--top-k", type=int, default=5)
    for name in ("domain", "subject", "author", "media-type", "published", "file-type"):
        s.add_argument(f"--{name}", default=None)
    return p


def main(args: list[str] | None = None) -> None:
    a = _parser().parse_args(args)
    spark = SparkSession.builder.appName("lectern").getOrCreate()
    if a.command == "reconcile":
        both = reconcile(list_titles(spark, a.list), directory_titles(list_directory(spark, a.directory, a.recursive)))
        print(report_text(summarize(both), both))
    elif a.command == "enrich":
        enrich(spark.read.parquet(a.catalog)).write.mode("overwrite").parquet(a.out)
    elif a.command == "ingest":
        pages = document_pages(files(spark, a.documents)).withColumn("book_id", F.abs(F.xxhash64("path")))
        empty = spark.createDataFrame([], "book_id long, chunk_index int, content string, page_number int, section_title string, token_count int, embedding array<float>")
        ingest_documents(empty, pages, lambda: provider(a.provider)).write.mode("overwrite").parquet(a.out)
    else:
        books, chunks = spark.read.parquet(a.books), spark.read.parquet(a.chunks)
        filters = {k: getattr(a, k) for k in ("domain", "subject", "author", "media_type", "published", "file_type")}
        vector = [] if a.mode == "keyword" else provider(a.provider).embed([a.query])[0]
        if a.mode == "keyword":
            out = search_chunks_sparse(chunks, books, a.query, a.top_k, filters)
        elif a.mode == "vector":
            out = search_chunks_dense(chunks, books, vector, a.top_k, filters)
        elif a.mode == "hierarchical":
            out = hierarchical_search(books, chunks, vector, 3, a.top_k, filters)
        elif a.mode == "books":
            out = dense_search(books, vector, a.top_k, "book_id", "metadata_embedding", filters)
        else:
            out = search_hybrid(chunks, books, vector, a.query, a.top_k, filters=filters)
        out.drop("embedding", "metadata_embedding").show(a.top_k, truncate=160)


if __name__ == "__main__":
    main()
