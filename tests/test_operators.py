import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import functions as F

from lectern.operators import vector as V
from lectern.operators.chunk import Budget, _chunks, chunk_documents, chunk_pages, estimate, one_page
from lectern.operators.context import NOTHING, citation, context, prompt
from lectern.operators.embed import HashEmbedder, _vectors, cache_key, embedded, provider, with_cache
from lectern.operators.fulltext import cover_density, query_terms, sparse_search
from lectern.operators.fusion import fuse
from lectern.operators.merge import fold_by_key, merge, sync_catalog
from lectern.operators.reconcile import number_rows, reconcile, summarize


def recs(spark, rows):
    return spark.createDataFrame(rows, "clean_title string, raw_title string, normalized_title string, source_path string")


def test_reconcile_and_sync(spark):
    left = recs(spark, [("A", "a.pdf", "a", "list"), ("B", "b.pdf", "b", "list")])
    right = recs(spark, [("A", "a.pdf", "a", "/d/a"), ("C", "c.pdf", "c", "/d/c")])
    both = reconcile(left, right)
    assert summarize(both).first().asDict() == {"total_list": 2, "total_dir": 2, "matched": 1, "missing_from_dir": 1, "unlisted_in_dir": 1, "match_rate": 50.0}
    empty = spark.createDataFrame([], "clean_title string, raw_title string, source_path string, in_directory int")
    assert {(r.clean_title, r.in_directory) for r in sync_catalog(empty, both, "list").collect()} == {("A", 1), ("B", 0), ("C", 1)}


def test_merge_keeps_and_inserts(spark):
    t = spark.createDataFrame([(1, "a", 1), (2, "b", 2)], "id long, x string, y int")
    s = spark.createDataFrame([(2, "z"), (3, "c")], "id long, x string")
    assert sorted(map(tuple, merge(t, s, "id").collect())) == [(1, "a", 1), (2, "z", 2), (3, "c", None)]


def test_fold(spark):
    df = spark.createDataFrame([(1, "t", None, 0), (2, "t", "p", 1), (3, "t", None, None)], "id long, title string, path string, in_directory int")
    assert fold_by_key(df, "title", "id", ("in_directory",)).first().asDict() == {"title": "t", "id": 1, "path": "p", "in_directory": 1}


def test_number_rows(spark):
    df = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("k")).repartition(5)
    got = sorted((r.k, r.id) for r in number_rows(df, ["k"]).collect())
    assert got == [(i, i + 1) for i in range(1000)]


def test_chunks():
    pages = [(1, "First paragraph has several words in it.\n\nSecond paragraph follows here with words.", "Introduction"), (2, "Third one on the next page with even more words.\n\nFourth closes.", "Next")]
    got = chunk_pages(pages, Budget(15, 5, 5))
    assert len(got) >= 2 and got[0][2:4] == (1, "Introduction") and [c[0] for c in got] == list(range(len(got)))
    long = chunk_pages([(5, "One sentence here. Another sentence there. A third one now! And a fourth?", None)], Budget(10, 3, 3))
    assert len(long) >= 2 and {c[2] for c in long} == {5}
    assert chunk_pages([(1, "tiny", None)])[0][1] == "tiny"
    assert chunk_pages([(1, " \n \n", None)]) == []
    assert estimate("") == 0 and estimate("a") == 1


def test_chunks_distributed(spark):
    df = spark.createDataFrame([(7, [(1, "tiny", None)]), (8, [])], "book_id long, pages array<struct<page_number:int,text:string,section_title:string>>")
    assert [(r.book_id, r.content) for r in chunk_documents(df).collect()] == [(7, "tiny")]


def test_vectors(spark):
    df = spark.createDataFrame([(1, [3.0, 4.0]), (2, [0.0, 0.0])], "id long, v array<double>")
    assert [r.x for r in df.orderBy("id").select(V.l2_normalize(F.col("v")).alias("x")).collect()] == [[0.6, 0.8], [0.0, 0.0]]


def test_filters_and_hierarchy(spark):
    books = spark.createDataFrame([(1, "Physics", 1, [1.0, 0.0]), (2, "Math", 1, [0.9, 0.1]), (3, "Physics", 0, None)], "book_id long, domain string, in_directory int, metadata_embedding array<double>")
    assert [r.book_id for r in books.where(V.filter_condition({"domain": "phys", "in_directory": True, "nope": 1, "author": None})).collect()] == [1]
    chunks = spark.createDataFrame([(10 + i, 1 + i % 3, [1.0, i / 10]) for i in range(9)], "chunk_id long, book_id long, embedding array<double>")
    got = V.hierarchical_search(books, chunks, [1.0, 0.0], 2, 2).collect()
    assert len(got) == 4 and {r.book_id for r in got} <= {1, 2}


def test_fusion(spark):
    dense = spark.createDataFrame([(101, 0.9), (102, 0.8)], "chunk_id long, similarity double")
    sparse = spark.createDataFrame([(102, 0.5), (103, 0.4)], "chunk_id long, rank double")
    got = fuse(dense, sparse).collect()
    assert [r.chunk_id for r in got] == [102, 101, 103]
    assert math.isclose(got[0].score, 0.5 / 62 + 0.5 / 61)


def test_fulltext(spark):
    assert query_terms("the running of foxes") == ["run", "fox"]
    assert cover_density([[1, 5]]) == 0.2
    assert math.isclose(cover_density([[1], [2]]), 0.1) and math.isclose(cover_density([[1], [4]]), 0.1 / 3)
    docs = spark.createDataFrame([(1, "Foxes run fast"), (2, "a fox was running, then ran"), (3, "nothing")], "chunk_id long, content string")
    assert {r.chunk_id for r in sparse_search(docs, "running foxes").collect()} == {1, 2}
    assert sparse_search(docs, "the of").count() == 0


def test_context(spark):
    df = spark.createDataFrame([(1, "T", "A", "S", 42, "body one"), (2, "T2", None, "", 0, "body two")], "n long, t string, a string, s string, p long, b string")
    cited = df.withColumn("c", citation(F.col("t"), F.col("a"), F.col("s"), F.col("p")))
    assert [r.c for r in cited.orderBy("n").collect()] == ["《T》 | by A | Section: S | p. 42", "《T2》"]
    text = context(cited.withColumnRenamed("n", "rank"), "rank", "c", "b")
    assert text.first().context == "--- [Passage 1] 《T》 | by A | Section: S | p. 42 ---\nbody one\n\n--- [Passage 2] 《T2》 ---\nbody two\n"
    assert context(cited.withColumnRenamed("n", "rank"), "rank", "c", "b", 10).first().context.count("Passage") == 1
    assert context(cited.withColumnRenamed("n", "rank").limit(0), "rank", "c", "b").first().context == NOTHING
    assert prompt(text, "why?").first().prompt.endswith("User Question: why?\n\nAnswer:")


def test_embedding_cache(spark):
    texts = spark.createDataFrame([("a b",), ("c",), ("c",)], "text string")
    cache = texts.where("text = 'a b'").select(cache_key("m", F.col("text")).alias("key"), F.lit("m").alias("model"), F.array(*[F.lit(0.5).cast("float")] * 384).alias("embedding"))
    got, fresh = with_cache(texts, cache, HashEmbedder, "m")
    assert got.count() == 3 and got.where("embedding is null").count() == 0
    assert fresh.count() == 1
    assert provider("hash").dimension == 384


def test_workers_hold_a_few_documents_and_vectors(spark):
    pages = [{"page_number": 1, "text": f"word{i} of text", "section_title": None} for i in range(200)]
    batch = pa.RecordBatch.from_pydict({"book_id": list(range(200)), "pages": [[p] for p in pages]})
    assert [b.num_rows for b in _chunks(iter([batch]), Budget())] == [64, 64, 64, 8]
    assert [len(x) for x in _vectors(iter([pd.Series(["a", None] * 50)]), HashEmbedder, 32)] == [32, 32, 32, 4]

    class Failing(HashEmbedder):
        def embed(self, texts):
            if "word99 of text" in texts:
                raise ValueError("no")
            return super().embed(texts)

    texts = spark.range(100).coalesce(1).selectExpr("id AS book_id", "concat('word', id, ' of text') AS text")
    chunks = chunk_documents(texts.select("book_id", one_page(F.col("text")).alias("pages")))
    got = {r.book_id: r for r in embedded(chunks, Failing, "content", errors="why").collect()}
    want = HashEmbedder().embed([f"word{i} of text" for i in range(100)])
    assert len(got) == 100 and got[99].embedding is None and got[99].why == "ValueError: no"
    assert all(got[i].why is None and np.allclose(got[i].embedding, want[i], atol=1e-7) for i in range(99))
