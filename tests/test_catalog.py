import json
import sqlite3

import numpy as np
import pytest
from pyspark.sql import functions as F

from lectern.operators import embed as E
from lectern.operators import lookup as L
from lectern.operators.ann import ann_search, fit_centroids, index
from lectern.operators.cache import KeyedLog
from lectern.operators.enrich import LOOKUP_SCHEMA, TitleCollision, _left, enrich, enrich_update, spread, title_collisions
from lectern.operators.reconcile import number_rows
from lectern.operators.vector import dense_search
from lectern.plans import catalog as K
from lectern.schema import BOOKS, conform, create
from lectern.sources.documents import document_pages, files, front_matter_of
from lectern.sources.sqlite import read_sqlite, upsert_sqlite, write_sqlite


def test_seeding_twice_changes_nothing(spark):
    now = F.lit("2020-01-01").cast("timestamp")
    once = K.seed(create(spark), K.sample_rows(spark), now)
    rows = sorted(once.collect())
    assert [r.id for r in rows] == [1, 2, 3] and {r.language for r in rows} == {"en"} and {r.revision for r in rows} == {1, 2}
    assert sorted(K.seed(once, K.sample_rows(spark), now).collect()) == rows
    assert K.introspect(once).first().asDict() == {"row_count": 3, "total_columns": len(BOOKS), "wrong_columns": "", "valid": True}


def test_recleaning_folds_and_numbers_as_a_table_does(spark):
    rows = [(4, "x", "a.pdf", None, 0), (7, "y", "b.pdf", "p", 1), (9, "z", "", "q", 1), (12, "u", "a.pdf", "r", 1), (15, "v", "c.pdf", None, 0)]
    made = spark.createDataFrame(rows, "id long, clean_title string, raw_title string, publisher string, in_directory int").withColumn("updated_at", F.lit("old"))
    clean = F.regexp_replace("raw_title", r"\.pdf$", "")
    got = sorted(map(tuple, K.reclean_catalog(made, clean, F.lit("new")).collect()))
    assert got == [(1, "a", "a.pdf", "r", 1, "new"), (2, "b", "b.pdf", "p", 1, "old"), (4, "c", "c.pdf", None, 0, "old")]
    assert K.reclean_counts(made, clean).first().asDict() == {"processed": 4, "skipped": 1, "titles": 3}
    assert K.reclean_catalog(made.limit(0), clean).count() == 0


def test_only_books_with_an_id_and_a_file_are_ingested(spark):
    books = spark.createDataFrame([(1, "a", "/a"), (2, "b", "/b"), (3, "c", None), (4, "d", "/d"), (5, "e", "")], "id long, clean_title string, source_path string")
    stored = books.where("id <> 2").select((F.col("id") * 10).alias("id"), "clean_title")
    found = spark.createDataFrame([("/a",), ("/b",), ("",)], "path string")
    assert [tuple(r) for r in K.documents_to_ingest(books, K.id_map(books, stored), found).collect()] == [(10, "/a")]


def docs_of(spark, rows):
    return spark.createDataFrame([(*r, ["A", "B", "C", "D"], 1999, ["P"], [], None, 3) for r in rows], "query string, place int, title string, author_name array<string>, first_publish_year int, publisher array<string>, language array<string>, first_sentence string, edition_count int")


def test_lookups_accept_and_precede(spark):
    wanted = spark.createDataFrame([(k, k) for k in ("linear algebra", "deep work", "lost book", "late one")], "key string, query string")
    docs = docs_of(spark, [("linear algebra", 0, "gardens"), ("linear algebra", 1, "Linear Algebra Done"), ("deep work", 0, "shallow"), ("late one", 0, "far"), ("late one", 1, "off"), ("late one", 2, "late one")])
    works = spark.createDataFrame([("linear algebra", 0, "linear algebra", ["Z"], 1950, "Q"), ("deep work", 0, "deep work", [], 1951, "Q"), ("lost book", 1, "lost book", ["Z"], 1, "Q")], "query string, place int, title string, author array<string>, published int, publisher string")
    got = {r.key: r for r in L.answers(wanted, L.open_library_answers(wanted, docs), L.crossref_answers(wanted, works)).collect()}
    assert got["linear algebra"].data.asDict() == {"title": None, "subtitle": None, "author": "A, B, C", "publisher": "P", "published": "1999", "language": "en", "summary": None, "source": "OpenLibrary", "revision": 3}
    assert (got["deep work"].data.source, got["deep work"].data.author) == ("Crossref", None)
    assert not got["lost book"].hit and not got["late one"].hit and got["late one"].data is None


def test_isbn_answers_win_in_enrichment(spark):
    books = spark.createDataFrame([(1, "scan", "scan.pdf", "/scan.pdf", 1), (2, "Deep Work", "Deep Work.pdf", "/w.pdf", 0)], "id long, clean_title string, raw_title string, source_path string, in_directory int")
    front = spark.createDataFrame([("/scan.pdf", "978-0-13-110362-7")], "path string, isbn string").withColumn("isbn", L.clean_isbn(F.col("isbn")))
    volumes = spark.createDataFrame([("9780131103627", 0, "The C Language", None, ["K", "R"], "PH", "1988-03", "en", None)], "isbn string, place int, title string, subtitle string, authors array<string>, publisher string, published_date string, language string, description string")
    docs = docs_of(spark, []).withColumn("isbn", F.col("query")).withColumn("subtitle", F.col("query"))
    cache = L.answers(L.wanted_isbns(front), L.isbn_open_library(docs), L.isbn_google(volumes))
    got = {r.id: r for r in enrich(books, front, cache).collect()}
    assert (got[1].clean_title, got[1].author, got[1].published, got[1].source) == ("The C Language", "K, R", "1988", "GoogleBooks:ISBN")
    assert got[2].source == "local+rules"


def test_caches_are_read_written_and_forgiven(spark, tmp_path):
    path = str(tmp_path / "cache")
    assert L.read_cache(spark, path).count() == 0
    held = tmp_path / "c.json"
    held.write_text(json.dumps({"a": {"author": "X", "revision": 2}, "b": {}}))
    L.save_cache(L.import_cache(spark, str(held)), path)
    assert sorted((r.key, r.hit, r.data and (r.data.author, r.data.revision)) for r in L.read_cache(spark, path).collect()) == [("a", True, ("X", 2)), ("b", False, None)]
    for bad in ("{", "[1]", ""):
        held.write_text(bad)
        assert L.import_cache(spark, str(held)).count() == 0
    assert L.import_cache(spark, str(tmp_path / "none")).count() == 0


def test_sqlite_upsert_keeps_other_rows(spark, tmp_path):
    path = str(tmp_path / "b.db")
    write_sqlite(spark.createDataFrame([(1, "a", "x"), (2, "b", "y")], "id long, clean_title string, author string"), path)
    assert upsert_sqlite(spark.createDataFrame([(9, "b", "z"), (3, "c", "w")], "id long, clean_title string, author string"), path, keep=("id",)) == 2
    assert sorted(map(tuple, read_sqlite(spark, path).collect())) == [(1, "a", "x"), (2, "b", "z"), (3, "c", "w")]
    with sqlite3.connect(path) as c:
        assert c.execute("SELECT count(*) FROM books").fetchone() == (3,)


def test_every_vector_is_indexed_and_recall_is_high(spark):
    e = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet").select("vec_id", "embedding")
    e = e.union(spark.createDataFrame([(-1, None)], e.schema)).cache()
    centroids = fit_centroids(e, "vec_id")
    stored = index(e, centroids).cache()
    assert stored.where("cell is null").select("vec_id").collect() == [(-1,)] and stored.count() == e.count()
    hits = total = 0
    for q in e.where("vec_id >= 0 and vec_id % 100 = 0").collect():
        want = {r.vec_id for r in dense_search(e, q.embedding, 10, "vec_id").collect()}
        got = [r.vec_id for r in ann_search(stored, centroids, q.embedding, 10, "vec_id").collect()]
        hits, total = hits + len(want & set(got)), total + len(want)
    print("recall", hits / total)
    assert hits / total >= 0.9
    everything = ann_search(stored, centroids, q.embedding, 10, "vec_id", probes=len(centroids))
    assert [r.vec_id for r in everything.collect()] == [r.vec_id for r in dense_search(e, q.embedding, 10, "vec_id").collect()]
    assert ann_search(index(e.limit(0), np.zeros((0, 0))), np.zeros((0, 0)), q.embedding, 3, "vec_id").count() == 0


def test_pages_are_cut_and_missing_files_said(spark, tmp_path):
    (tmp_path / "a.md").write_text("# One\nfirst text\n# Two\nsecond text\n")
    rows = files(spark, str(tmp_path))
    assert len(document_pages(rows).first().pages) >= len(document_pages(rows, 1).first().pages) == 1
    gone = spark.createDataFrame([("/no/such.pdf",)], "path string")
    assert [(r.path, r.source) for r in front_matter_of(gone, rows).where("source = 'file_not_found'").collect()] == [("/no/such.pdf", "file_not_found")]


def test_declared_columns(spark):
    got = K.declared(spark.createDataFrame([("t",)], "clean_title string"))
    assert got.columns == BOOKS.fieldNames() and got.first().revision == 1
    assert conform(got).schema == got.schema


def test_a_key_cached_twice_counts_once(spark, tmp_path):
    path = str(tmp_path / "cache")
    answer = lambda author, hit=True: ("deep work", hit, (None, None, author, None, None, None, None, "OpenLibrary", None) if hit else None)
    frame = lambda *rows: spark.createDataFrame(list(rows), L.LOOKUP_SCHEMA)
    assert L.save_cache(frame(answer("Old"), (None, True, None)), path) == 1
    assert L.save_cache(frame(answer("New"), answer("New")), path) == 2
    assert L.save_cache(frame(answer("New"), answer("New")), path, 2) == 2  # the same run again adds nothing
    books = spark.createDataFrame([(1, "Deep Work", "Deep Work.pdf", "/w.pdf", 0)], "id long, clean_title string, raw_title string, source_path string, in_directory int")
    front = spark.createDataFrame([("/w.pdf", "P"), ("/w.pdf", "Q")], "path string, publisher string")
    got = enrich(books, front, L.read_cache(spark, path)).collect()
    assert [(r.id, r.author, r.publisher) for r in got] == [(1, "New", "Q")]
    raw = frame(answer("A"), answer("B"))
    assert [r.author for r in enrich(books, None, raw).collect()] == ["B"]
    # an answer that was withdrawn later is a negative one
    L.save_cache(frame(answer("", False)), path)
    log = KeyedLog(spark, path, L.LOOKUP_SCHEMA)
    assert [(r.key, r.hit) for r in log.read().collect()] == [("deep work", False)] and log.runs() == [1, 2, 3]
    assert [r.author for r in enrich(books, None, log.read()).collect()] == [None]
    assert log.compact() == 4 and log.runs() == [4] and log.read().count() == 1
    wanted = spark.createDataFrame([("deep work",), ("other",)], "key string")
    assert [r.key for r in log.misses(wanted).collect()] == ["other"]
    (tmp_path / "bad").write_text("{")
    assert KeyedLog(spark, str(tmp_path / "bad" / "none"), L.LOOKUP_SCHEMA).read().count() == 0


def touchy(calls=None):
    """A provider that fails on a word, and counts its calls; made here, for workers do not know this module."""

    class Touchy:
        def embed(self, texts):
            if calls is not None:
                calls.append(len(texts))
            if any("bad" in t for t in texts):
                raise OSError("no vector")
            return [[3.0, 4.0 * len(t)] for t in texts]

    return Touchy


def test_a_failed_batch_is_halved(spark):
    texts = [f"t{i}" for i in range(30)] + ["bad one", "t31"]
    calls = []
    got = E._bisected(touchy(calls)(), texts)
    assert [e for _, e in got if e] == ["OSError: no vector"] and got[30][0] is None and sum(v is not None for v, _ in got) == 31
    assert len(calls) <= 2 * 5 + 1
    rows = spark.createDataFrame([(i, t) for i, t in enumerate([*texts, None])], "id int, text string")
    done = {r.id: r for r in E.embedded(rows, touchy(), errors="why").collect()}
    assert done[30].embedding is None and done[30].why == "OSError: no vector" and done[32].why is None
    assert all(abs(sum(x * x for x in r.embedding) - 1) < 1e-6 for r in done.values() if r.embedding)
    assert E.unit([0.0, 0.0]) == [0.0, 0.0] and E.unit(None) is None


def test_embeddings_come_from_the_stored_cache(spark, tmp_path):
    log = E.embedding_cache(spark, str(tmp_path / "vectors"))
    rows = spark.createDataFrame([(1, "a"), (2, "b"), (3, "a"), (4, "bad")], "id int, text string")
    first = {r.id: r.embedding for r in E.embed_cached(rows, log, touchy(), "m").collect()}
    assert first[1] == first[3] and first[4] is None and log.read().count() == 2
    log.append(log.read().withColumn("embedding", F.array(F.lit(1.0).cast("float"))))  # the newest run counts
    assert {tuple(r.embedding) for r in E.embed_cached(rows.where("id < 4"), log, touchy(), "m").collect()} == {(1.0,)}
    twice = log.read().unionByName(log.read())
    out, fresh = E.with_cache(rows.where("id < 4"), twice, touchy(), "m")
    assert out.count() == 3 and fresh.count() == 0


def test_numbers_follow_the_order_over_ranges(spark):
    rows = spark.range(5000).select((F.col("id") * 7919 % 5003).alias("k"), F.lit("x").alias("_n"))
    got = sorted((r.k, r.id) for r in number_rows(rows, ["k"]).collect())
    assert [i for _, i in got] == list(range(1, 5001))
    odd = spark.createDataFrame([(None, 1), ("b", 2), ("", 3), ("b", 4)], "t string, n int")
    assert [(r.t, r.n) for r in number_rows(odd, ["t", "n"]).orderBy("id").collect()] == [(None, 1), ("", 3), ("b", 2), ("b", 4)]
    assert number_rows(odd.limit(0), ["t"]).count() == 0


def test_titles_stay_unique(spark):
    kind = "id long, clean_title string, author string"
    catalog = spark.createDataFrame([(1, "a", "x"), (2, "b", "x"), (3, "c", "x"), (4, "d", "x"), (5, "e", "x"), (6, "f", "x")], kind)
    fresh = spark.createDataFrame([(1, "b", "y"), (2, "z", "y"), (3, "new", "y"), (4, "new", "y"), (5, "e", "y"), (6, None, "y"), (9, "b", "y")], kind)
    assert sorted(map(tuple, title_collisions(catalog, fresh).collect())) == [(1, "b", 2), (4, "new", 3)]
    with pytest.raises(TitleCollision, match="2 rows .*1: 'b' of 2, 4: 'new' of 3"):
        enrich_update(catalog, fresh)
    got = sorted(map(tuple, enrich_update(catalog, fresh, "first").collect()))
    assert got == [(1, "a", "y"), (2, "z", "y"), (3, "new", "y"), (4, "d", "y"), (5, "e", "y"), (6, "f", "y")]
    sound = fresh.where("id in (3, 5)")
    assert sorted(map(tuple, enrich_update(catalog, sound).collect()))[2] == (3, "new", "y")
    assert enrich_update(catalog.limit(0), fresh).count() == 0
    # many that ask for one title: one has it
    many = spark.range(2000).select("id", F.concat(F.lit("t"), "id").alias("clean_title"), F.lit("x").alias("author"))
    out = enrich_update(many, many.select("id", F.lit("same").alias("clean_title")), "first")
    assert out.where("clean_title = 'same'").count() == 1 and out.select("clean_title").distinct().count() == 2000


def test_enrichment_is_dealt_out(spark):
    # every row's path is null, and rows are few bytes: neither may put them into one task
    books = spark.range(400).coalesce(1).selectExpr("id", "'scan' AS clean_title", "concat('raw ', id) AS raw_title", "IF(id < 0, 'x', NULL) AS source_path", "0 AS in_directory")
    front = spark.createDataFrame([("/p", "Title of a Page")], "path string, title string")
    cache = spark.createDataFrame([("scan", True, ("T", None, "Ann", None, None, None, None, "OpenLibrary", 2))], LOOKUP_SCHEMA)
    largest = lambda df: max(r["count"] for r in df.groupBy(F.spark_partition_id().alias("p")).count().collect())
    confs = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.coalescePartitions.enabled": "true"}
    held = {k: spark.conf.get(k) for k in confs}
    try:
        for k, v in confs.items():
            spark.conf.set(k, v)
        for out in (enrich(spread(books)), enrich(books, front), enrich(books, front, cache)):
            assert out.count() == 400 and largest(out) < 200
        assert {r.author for r in enrich(books, None, cache).select("author").distinct().collect()} == {"Ann"}
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        met = _left(books, F.col("source_path"), front.select("path", F.col("title").alias("t")), "path")
        assert met.columns == [*books.columns, "t"] and met.where("t is null").count() == 400 and largest(met) < 200
    finally:
        for k, v in held.items():
            spark.conf.set(k, v)
    assert "Join" not in enrich(books)._jdf.queryExecution().optimizedPlan().toString()
