"""The stored index against searching all texts: several terms, filters, replaced books, pruned blocks."""

import os
import random

import pytest
from pyspark.sql import functions as F

from lectern.operators import index as I
from lectern.operators.fulltext import cover_density, cover_rank, postings, sparse_search
from lectern.plans.search import search_chunks_sparse, search_hybrid
from lectern.sources.store import Store

WORDS = "run runs running fox foxes river bank and the of library query".split()
KIND = "chunk_id long, book_id long, content string"


def chunks_of(rng, ids, books=9):
    return [(i, i % books, " ".join(rng.choice(WORDS[: rng.choice([3, 12])]) for _ in range(rng.randint(0, 40)))) for i in ids]


def same(index, chunks, query, k=7, stemmed=True, allowed=None):
    got = [tuple(r) for r in index.search(query, k, allowed=allowed).collect()]
    texts = chunks if allowed is None else chunks.join(allowed, "chunk_id", "left_semi")
    want = [tuple(r) for r in sparse_search(texts, query, k, stemmed=stemmed).collect()]
    assert [x[0] for x in got] == [x[0] for x in want] and all(abs(a[1] - b[1]) < 1e-9 for a, b in zip(got, want, strict=True)), query
    return got


def test_cover_rank_equals_cover_density(spark):
    rng = random.Random(3)
    cases = []
    for _ in range(200):
        places, n = rng.sample(range(1, 60), rng.randint(3, 25)), rng.randint(2, 3)
        cases.append((n, [sorted(p for i, p in enumerate(places) if i % n == t) for t in range(n)]))
    for n in (2, 3):
        own = [p for m, p in cases if m == n]
        got = spark.createDataFrame([(i, p) for i, p in enumerate(own)], "i int, p array<array<int>>").select("i", cover_rank(F.col("p"), n).alias("r")).collect()
        assert all(abs(r.r - cover_density(own[r.i])) < 1e-12 for r in got)


@pytest.fixture(scope="module")
def library(spark, tmp_path_factory):
    rng = random.Random(6)
    ids = rng.sample(range(6000), 900)
    rows = chunks_of(rng, ids) + [(7001, 3, None), (7002, None, "river river"), (2**40, 1, "river fox " * 30)]
    chunks = spark.createDataFrame(rows, KIND)
    index = I.StoredIndex(Store(spark, str(tmp_path_factory.mktemp("index"))), buckets=16)
    index.build(chunks)
    return rows, chunks, index


def test_search_equals_searching_texts(spark, library):
    rows, chunks, index = library
    for query in ("river", "run fox", "the river bank", "library query fox river", "absent", "river absent"):
        same(index, chunks, query)
    assert index.search("the of", 5).count() == 0 == index.search("", 5).count()
    assert len(same(index, chunks, "foxes", k=2000)) > 400  # fewer found than asked for: nothing may be pruned
    allowed = chunks.where("book_id in (2, 5)").select("chunk_id")
    same(index, chunks, "run fox", allowed=allowed)


def test_blocks_are_pruned_and_buckets_read(spark, library, monkeypatch):
    rows, chunks, index = library
    seen = []
    ranked = I.StoredIndex._ranked
    monkeypatch.setattr(I.StoredIndex, "_ranked", lambda self, rows, *a: (seen.append(rows.select("block").distinct().count()), ranked(self, rows, *a))[1])
    same(index, chunks, "river", k=1)
    every = index._table("postings", ["river"]).select("block").distinct().count()
    assert seen == [I.FIRST] and every > 2 * I.FIRST  # the best rank lies in a first block and no other block can reach it
    size = lambda df: sum(os.path.getsize(x.removeprefix("file:").replace("//", "/")) for x in df.inputFiles())
    assert size(index._table("postings", ["river"])) < 0.3 * size(index._table("postings"))


def test_replaced_books(spark, tmp_path):
    rng = random.Random(7)
    now = chunks_of(rng, range(300))
    frame = lambda rows: spark.createDataFrame(rows, KIND)
    index = I.StoredIndex(Store(spark, str(tmp_path)), "words", buckets=8)
    index.build(frame(now))
    fresh = [(i if i % 2 else i + 1000, b, t) for i, b, t in chunks_of(rng, range(300)) if b in (1, 4)]  # some ids come again
    index.replace(frame(fresh))
    now = [r for r in now if r[1] not in (1, 4)] + fresh
    same(index, frame(now), "river"), same(index, frame(now), "run fox")
    index.remove(frame(now).where("book_id = 2").select("book_id"))
    index.replace(frame([(9000, 4, "river river river")]))
    now = [r for r in now if r[1] not in (2, 4)] + [(9000, 4, "river river river")]
    same(index, frame(now), "river", k=50)
    version = index.store.version()
    index.compact()
    same(index, frame(now), "river", k=50), same(index, frame(now), "run fox")
    assert index._table("dead").count() == 0 and index.store.version() == version + 1
    assert index._table("postings").agg(F.max("segment")).first()[0] == 0


def test_plans_use_the_index(spark, library):
    rows, chunks, index = library
    full = chunks.withColumns({"embedding": F.array(F.lit(1.0), F.col("chunk_id").cast("double")), "page_number": F.lit(1), "section_title": F.lit("")})
    books = spark.createDataFrame([(b, f"Book {b}", "", ["physics", "law"][b % 2]) for b in range(9)], "book_id long, clean_title string, author string, domain string")
    pick = lambda df: sorted((r.chunk_id, round(r["rank"], 9)) for r in df.collect())
    for filters in (None, {"domain": "law"}):
        assert pick(search_chunks_sparse(full, books, "river fox", 6, filters, index=index)) == pick(search_chunks_sparse(full, books, "river fox", 6, filters)) or filters is None
    a = search_hybrid(full, books, [1.0, 0.2], "river fox", filters={"domain": "law"}, index=index)
    b = search_hybrid(full, books, [1.0, 0.2], "river fox", filters={"domain": "law"})
    assert sorted(r.chunk_id for r in a.collect()) == sorted(r.chunk_id for r in b.collect())


def test_postings_are_packed_where_their_texts_lie(spark, tmp_path):
    texts = [(i, i % 3, None if i % 50 == 7 else "" if i % 50 == 8 else f"the Cat {i % 9} and the dog{i} and the") for i in range(-200, 400)]
    x = spark.createDataFrame(texts, "chunk_id long, book_id long, content string")
    for stemmed in (False, True):
        index = I.StoredIndex(Store(spark, f"{tmp_path}/{stemmed}"), stemmed=stemmed)
        rows = index._blocks(x, F.lit(0))
        # one exchange, that of the texts; lists are collected by no aggregate, which would shuffle and sort every posting
        plan = rows._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange") == 1 and "Aggregate" not in plan
        got = [(r.lexeme, r.block, i, tuple(p), r.most) for r in rows.collect() for i, p in zip(r.ids, r.places, strict=True)]
        want = {(r.lexeme, r.chunk_id): tuple(r.positions) for r in postings(x, stemmed=stemmed).collect()}
        assert {(w, i): p for w, _, i, p, _ in got} == want and len(got) == len(want)
        assert all(b == i // 128 for _, b, i, _, _ in got) and rows.groupBy("lexeme", "block").count().where("count > 1").isEmpty()
        assert all(most == max(len(p) for v, c, _, p, _ in got if (v, c) == (w, b)) for w, b, _, _, most in got[:50])
        assert all(r.ids == sorted(r.ids) for r in rows.collect())
