"""The driver's contract: queries agree with their SQL on the smallest tables, and stand without the optional part."""

import math
import os
import subprocess
import sys
from pathlib import Path

import pytest

import __spark_entry__ as entry
from lectern.oracle import ORACLE_SQL
from lectern.queries import QUERIES

ROOT, DATA = Path(__file__).resolve().parent.parent, "/root/testdata/sf0.001"
needs_data = pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables here")


def rows(columns, values):
    order = sorted(range(len(columns)), key=lambda i: columns[i])

    def plain(x):
        return None if x is None or (isinstance(x, float) and math.isnan(x)) else round(float(x), 6) if isinstance(x, (int, float)) and not isinstance(x, bool) else x

    return sorted(([plain(r[i]) for i in order] for r in values), key=repr)


@needs_data
@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, name):
    df = QUERIES[name](spark, DATA)
    got = rows(df.columns, [tuple(r) for r in df.collect()])
    if name not in ORACLE_SQL:
        return
    import duckdb

    c = duckdb.connect()
    for p in Path(DATA).glob("*.parquet"):
        c.sql(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    r = c.sql(ORACLE_SQL[name])
    assert sorted(df.columns) == sorted(r.columns)
    assert got == rows(r.columns, r.fetchall())


@needs_data
def test_every_chunk_of_every_document_is_embedded(spark):
    chunks = QUERIES["chunked_documents"](spark, DATA).select("book_id", "chunk_index").collect()
    got = QUERIES["embedded_chunks"](spark, DATA).collect()
    assert sorted((r.book_id, r.chunk_index) for r in got) == sorted(map(tuple, chunks)) and len({r.book_id for r in got}) > 100
    assert all((r.dimension, r.norm) == (384, 1.0) for r in got)


def test_negative_numbers_that_round_to_zero_keep_their_sign(spark, tmp_path):
    import duckdb

    docs = [(1, "it it it has has"), (2, "by by by who who"), (3, "of of of is our"), (4, "of of of of of an you"), (5, None), (6, "to to to to to to to you him")]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    vectors = [(0, [-1.0, 2.0]), (1, [-1e-7, 1.0]), (2, [1e-7, 1.0]), (3, [-3.0, 4.0]), (4, [-1.5e-6, 1.0])]
    spark.createDataFrame(vectors, "vec_id long, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    c = duckdb.connect()
    for t in ("documents", "embeddings"):
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet/*.parquet'")
    for name, at, want in (("embedded_chunks", "digest", 2), ("l2_normalize", "first", 1)):
        df, r = QUERIES[name](spark, str(tmp_path)), c.sql(ORACLE_SQL[name])
        got = sorted(map(repr, map(tuple, df.select(*r.columns).collect())))
        assert got == sorted(map(repr, r.fetchall()))
        assert sum(math.copysign(1, x[at]) < 0 == x[at] for x in df.collect()) == want


@needs_data
def test_entry_runs(spark):
    assert entry.entry(spark).count() == 5


def test_stands_without_the_optional_part(tmp_path):
    for p in ("lectern", "__spark_entry__.py"):
        (tmp_path / p).symlink_to(ROOT / p) if p.endswith(".py") else None
    copy = tmp_path / "lectern"
    copy.mkdir()
    for p in (ROOT / "lectern").iterdir():
        if p.name != "llm":
            (copy / p.name).symlink_to(p)
    (tmp_path / "__spark_entry__.py").unlink()
    (tmp_path / "__spark_entry__.py").write_text((ROOT / "__spark_entry__.py").read_text())
    said = subprocess.run([sys.executable, "-B", "-c", "import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()))"], cwd=tmp_path, env={**os.environ, "PYTHONPATH": str(tmp_path)}, capture_output=True, text=True)
    assert said.stdout.split() == [str(len(QUERIES)), str(len(ORACLE_SQL))], said.stderr


def test_nothing_else_imports_the_optional_part():
    for p in (ROOT / "lectern").rglob("*.py"):
        if "llm" not in p.relative_to(ROOT / "lectern").parts:
            assert "llm import" not in p.read_text() and ".llm" not in p.read_text()
