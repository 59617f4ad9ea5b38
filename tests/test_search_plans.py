"""Search over chunks and books, stored postings, cover density by brute force, synchronisation with times, bad bytes."""

import random

from pyspark.sql import functions as F

from lectern.functions import metadata as M
from lectern.operators.enrich import enrich
from lectern.operators.fulltext import cover_density, indexed_search, postings, sparse_search
from lectern.operators.merge import sync_catalog, sync_counts
from lectern.operators.reconcile import number_rows, reconcile
from lectern.plans.search import answer_prompt, search_chunks_dense, search_chunks_sparse, search_hybrid
from lectern.sources.documents import files, text_pages

WORDS = "run runs running fox foxes river bank and the of library query".split()


def naive_density(positions):
    """Every cover that begins and ends at an event and holds no smaller one with the same begin."""
    events = sorted((at, t) for t, ps in enumerate(positions) for at in ps)
    total, previous = 0.0, -1
    for j, (end, _) in enumerate(events):
        last = {}
        for at, t in events[: j + 1]:
            last[t] = at
        if len(last) < len(positions):
            continue
        begin = min(last.values())
        if begin == previous:
            continue
        previous = begin
        inside = sum(begin <= at <= end for at, _ in events)
        total += 0.1 / (1 + max(0, end - begin - (inside - 1))) if len(positions) > 1 else 0.1
    return total


def test_cover_density_by_brute_force():
    rng = random.Random(3)
    for _ in range(300):
        places = rng.sample(range(1, 60), rng.randint(2, 25))
        n = rng.randint(1, 4)
        positions = [sorted(p for i, p in enumerate(places) if i % n == t) for t in range(n)]
        if all(positions):
            assert abs(cover_density(positions) - naive_density(positions)) < 1e-12
    assert cover_density([[1], []]) == 0.0 == cover_density([])


def library(spark, n=120):
    rng = random.Random(5)
    rows = [(i, i % 5, [rng.gauss(0, 1) for _ in range(4)] if i % 11 else None, " ".join(rng.choice(WORDS) for _ in range(rng.randint(1, 30))), i % 3, f"part {i % 2}") for i in range(n)]
    chunks = spark.createDataFrame(rows, "chunk_id long, book_id long, embedding array<double>, content string, page_number int, section_title string")
    books = spark.createDataFrame([(b, f"Book {b}", "", ["physics", "law", "physical chemistry"][b % 3]) for b in range(4)], "book_id long, clean_title string, author string, domain string")
    return rows, chunks, books


def test_chunk_search_plans(spark):
    rows, chunks, books = library(spark)
    q = [1.0, 0.5, -0.2, 0.1]
    cos = lambda v: sum(a * b for a, b in zip(v, q)) / (sum(a * a for a in v) ** 0.5 * sum(b * b for b in q) ** 0.5)
    fits = [r for r in rows if r[1] in (0, 2, 3)]
    want = sorted(((-cos(r[2]), r[0]) for r in fits if r[2]))[:7]
    got = search_chunks_dense(chunks, books, q, 7, {"domain": "phys"}).collect()
    assert sorted((round(-r.similarity, 9), r.chunk_id) for r in got) == sorted((round(s, 9), i) for s, i in want) and all(r.clean_title == f"Book {r.book_id}" for r in got)
    assert search_chunks_dense(chunks, books, q, 500).where("book_id = 4").count() == 0  # no such book
    index = postings(chunks, carried=("book_id",))
    for query in ("running", "foxes bank", "library run queries", "the", "", "unknown fox"):
        for k in (3, 500):
            plain = sorted(map(tuple, sparse_search(chunks.join(books, "book_id").where("domain like '%phys%'"), query, k).select("chunk_id", F.round("rank", 9)).collect()))
            assert plain == sorted(map(tuple, search_chunks_sparse(chunks, books, query, k, {"domain": "phys"}).select("chunk_id", F.round("rank", 9)).collect()))
            assert plain == sorted(map(tuple, search_chunks_sparse(chunks, books, query, k, {"domain": "phys"}, index=index).select("chunk_id", F.round("rank", 9)).collect()))
    assert sparse_search(chunks, "running", 500).count() > 20  # run, runs and running share a stem
    hybrid = search_hybrid(chunks, books, q, "fox bank", 6, filters={"domain": "phys"})
    assert hybrid.collect() and sorted(map(str, hybrid.collect())) == sorted(map(str, search_hybrid(chunks, books, q, "fox bank", 6, filters={"domain": "phys"}, index=index).collect()))
    text = answer_prompt(hybrid, "Why?").first()[0]
    best = hybrid.orderBy(F.desc("score"), "chunk_id").first()
    assert f"[Passage 1] 《{best.clean_title}》" in text and text.endswith("User Question: Why?\n\nAnswer:")


def test_only_ids_travel_before_the_top(spark):
    _, chunks, books = library(spark)
    plan = search_chunks_dense(chunks, books, [1.0, 0.0, 0.0, 0.0], 3)._jdf.queryExecution().optimizedPlan().toString()
    below = plan[plan.index("LocalLimit") :] if "LocalLimit" in plan else plan[plan.index("GlobalLimit") :]
    assert "content" not in below.split("LogicalRDD")[0]


def test_indexed_search_equals_scan(spark):
    _, chunks, _ = library(spark, 200)
    for stemmed in (True, False):
        index = postings(chunks, stemmed=stemmed)
        for query in ("fox", "fox river", "and the"):
            assert sorted(map(tuple, indexed_search(index, query, 9, stemmed=stemmed).collect())) == sorted(map(tuple, sparse_search(chunks, query, 9, stemmed=stemmed).collect()))


def test_sync_sets_times_and_counts(spark):
    kind = "clean_title string, raw_title string, normalized_title string, source_path string"
    left = spark.createDataFrame([("A", "a.pdf", "a", "list"), ("B", "b.pdf", "b", None)], kind)
    right = spark.createDataFrame([("A", "a.pdf", "a", "/d/a"), ("C", "c.pdf", "c", "/d/c")], kind)
    catalog = spark.createDataFrame([("A", "old", "old", 0, "t0", "t0"), ("Z", "old", "old", 1, "t0", "t0")], "clean_title string, raw_title string, source_path string, in_directory int, created_at string, updated_at string")
    both = reconcile(left, right)
    got = {r.clean_title: tuple(r)[1:] for r in sync_catalog(catalog, both, "titles.txt", F.lit("t1")).collect()}
    assert got == {"A": ("old", "/d/a", 1, "t0", "t1"), "B": ("b.pdf", "titles.txt", 0, "t1", "t1"), "C": ("c.pdf", "/d/c", 1, "t1", "t1"), "Z": ("old", "old", 1, "t0", "t0")}
    assert tuple(sync_counts(both).first()) == (1, 1, 1)


def test_row_numbers_with_ties_and_nulls(spark):
    rng = random.Random(9)
    rows = [(rng.choice([None, "a", "b", "É", ""]), i) for i in range(500)]
    df = spark.createDataFrame(rows, "k string, n long").repartition(7)
    got = {(r.k, r.n): r.id for r in number_rows(df, ["k", "n"]).collect()}
    order = sorted(rows, key=lambda r: (r[0] is not None, (r[0] or "").encode(), r[1]))
    assert [got[r] for r in order] == list(range(1, 501))
    assert number_rows(df.limit(0), ["k"]).count() == 0


def test_bytes_that_are_not_utf8(spark, tmp_path):
    (tmp_path / "latin.txt").write_bytes("caf\xe9 cr\xe8me".encode("latin-1"))
    (tmp_path / "plain.md").write_text("# Head\nbody é")
    got = {r.path.rsplit("/", 1)[-1]: r.pages for r in text_pages(files(spark, str(tmp_path))).collect()}
    assert got["latin.txt"][0].text == "caf� cr�me" and got["plain.md"][0].text == "body é"


def test_rules_run_once_a_row(spark):
    books = spark.createDataFrame([(1, "Machine Learning 3rd edition", "[Jane Roe] ml 3rd edition.pdf", None, 0)], "id long, clean_title string, raw_title string, source_path string, in_directory int")
    out = enrich(books)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("RLIKE") < 120
    row = out.first()
    tax = books.select(M.taxonomy(F.col("raw_title"), F.col("clean_title")).alias("t")).first().t
    assert (row.domain, row.subject, row.author, row.revision, row.edition) == (tax.domain, tax.subject, "Jane Roe", 3, "3rd Edition")
