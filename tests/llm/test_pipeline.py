"""The pipeline stage by stage on a small corpus: what each must do on its own input."""

import random

import pytest
from pyspark.sql import functions as F

pipeline = pytest.importorskip("corpus_pipeline")
WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau".split()


def prose(rng, n):
    return " ".join(rng.choice(WORDS) + rng.choice(["", "s", "ed", "ing"]) for _ in range(n))


@pytest.fixture
def corpus(spark, tmp_path):
    rng = random.Random(9)
    passage = prose(rng, 70)
    rows = []
    for i in range(240):
        text = prose(rng, rng.randint(60, 120)) + "\n" + prose(rng, 60)
        if i % 6 == 0:
            text = " | ".join(prose(rng, 90).split())
        if i % 7 == 1:
            text += "\n" + passage
        rows.append((i, text, "en", "hot" if i % 3 else f"s{i % 5}", len(text)))
    whole = " ".join(rows[1][1].split("\n")[0].split())
    near = whole.split()
    near[3] = "changed"
    rows += [(500, " ".join(near), "en", "s1", 1), (501, None, None, None, None), (502, "", "en", "s1", 0)]
    d = str(tmp_path / "sf")
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(i, int(i % 6 > 0), 0) for i in range(0, 240, 1)], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    return d, passage


def test_stages(spark, corpus):
    d, passage = corpus
    docs = spark.read.parquet(f"{d}/documents.parquet")
    names = docs.columns
    steps = []
    for _, f in pipeline.STAGES:
        docs = f(spark, docs, d)
        steps.append((docs.columns, docs.collect()))
    quality, lines, near, mixed, packed = steps
    assert all(c == names for c, _ in steps[:4])
    assert {r.doc_id for r in quality[1]} >= {i for i in range(240) if i % 6} and sum(r.doc_id % 6 == 0 for r in quality[1] if r.doc_id < 240) <= 2
    assert len(lines[1]) == len(quality[1]) and sum(passage in (r.text or "") for r in lines[1]) == 1
    assert all(r.n_chars == (None if r.text is None else len(r.text)) for r in lines[1])
    assert {r.doc_id for r in near[1]} <= {r.doc_id for r in lines[1]}
    assert {r.doc_id for r in mixed[1]} <= {r.doc_id for r in near[1]}
    assert sum(r.words for r in packed[1]) == sum(len((r.text or "").split()) for r in mixed[1])


def test_near_dedup_where_ids_do_not_name_a_row(spark):
    rng = random.Random(3)
    texts = [prose(rng, 80).split() for _ in range(4)]
    a, b, c, d = map(" ".join, texts)
    near = lambda x: " ".join([*x[:40], "changed", *x[41:]])
    rows = [
        *[(1, a, "s"), (1, a, "s"), (1, a, "r"), (2, near(texts[0]), "s")],  # repeated rows, and a copy
        *[(5, b, "s"), (6, c, "s"), (6, near(texts[1]), "s")],  # 6 stays through c, not through a copy of b
        *[(None, d, "s"), (None, near(texts[3]), "s"), (None, near(texts[0]), "s"), (None, "", "s"), (None, "", "s")],
        *[(7, None, "s"), (7, None, "s"), (8, " ", "s")],
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = [tuple(r) for r in pipeline.near_dedup(spark, docs, "").collect()]
    d_kept = [r for r in got if r[0] is None and r[1]]
    assert len(d_kept) == 1 and d_kept[0][1] in (d, near(texts[3]))
    assert sorted((r for r in got if r not in d_kept), key=str) == sorted([(1, a, "r"), (5, b, "s"), (6, c, "s"), (None, "", "s"), (None, "", "s"), (7, None, "s"), (8, " ", "s")], key=str)


def test_run(spark, corpus):
    got = pipeline.run(spark, corpus[0])
    assert sorted(map(str, got.collect())) == sorted(map(str, pipeline.run(spark, corpus[0]).collect()))
    assert got.count() > 100


CLASHES = ("log_weight", "n_ngrams", "runs", "n_lines", "n_deleted", "hash", "component", "id", "row", "rest", "k", "copies", "n", "empty", "size", "a.b")


def test_clashing_names_equal_ids_and_nulls(spark, corpus):
    d, _ = corpus
    docs = spark.read.parquet(f"{d}/documents.parquet")
    docs = docs.union(docs.where("doc_id < 40")).union(docs.where("doc_id = 7").withColumn("text", F.lit(None).cast("string")))
    docs = docs.unionByName(docs.limit(1).select(*[F.lit(None).cast(t).alias(c) for c, t in docs.dtypes]))
    docs = docs.select("*", *[F.concat(F.lit(f"{c} "), F.coalesce("doc_id", F.lit(-1))).alias(c) for c in CLASHES])
    for name, f in pipeline.STAGES:
        before, docs = docs, f(spark, docs, d)
        if name == "best-fit packing":
            break
        assert docs.columns == before.columns
        rows = docs.collect()
        assert rows and all(r[c] == f"{c} {-1 if r.doc_id is None else r.doc_id}" for r in rows for c in CLASHES)
        if name == "MinHash near-dedup":
            assert len({r.doc_id for r in rows if r.text}) == len([r for r in rows if r.text])
    assert docs.count() > 100


def test_empty_tables(spark, corpus, tmp_path):
    d, _ = corpus
    none = str(tmp_path / "none")
    for t in ("documents", "labels"):
        spark.read.parquet(f"{d}/{t}.parquet").limit(0).write.parquet(f"{none}/{t}.parquet")
    assert pipeline.run(spark, none).count() == 0
    docs = spark.read.parquet(f"{d}/documents.parquet")
    assert pipeline.quality(spark, docs, none).count() == docs.count()
    for _, f in pipeline.STAGES:
        assert f(spark, docs.limit(0), d).count() == 0
