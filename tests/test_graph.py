"""Graph search against comparing with every vector."""

import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from lectern.operators.graph import Graph, build_graphs, graph_neighbours, graph_search

DATA = "/root/testdata/sf0.1/embeddings.parquet"


def unit(x):
    return x / np.maximum(np.linalg.norm(x, axis=-1, keepdims=True), 1e-12)


def test_every_hundredth_vector_finds_its_neighbours(spark, tmp_path):
    rows = spark.read.parquet(DATA)
    x = unit(np.stack(pq.read_table(DATA).sort_by("vec_id").column("embedding").to_numpy(zero_copy_only=False)).astype(np.float64))
    ids = np.array(pq.read_table(DATA).sort_by("vec_id").column("vec_id"))
    build_graphs(rows, "vec_id").write.parquet(str(tmp_path / "g"))
    graphs = spark.read.parquet(str(tmp_path / "g"))
    assert sum(r.n for r in graphs.select("n").collect()) == len(ids)
    queries = rows.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query"), "embedding")
    got = {}
    for r in graph_neighbours(graphs, queries, 10, 16, block=7).collect():
        got.setdefault(r.query, []).append(r)
    right = 0
    for q, found in got.items():
        want = set(ids[np.argsort(-(x @ x[np.flatnonzero(ids == q)[0]]), kind="stable")[:10]].tolist())
        right += len(want & {r.id for r in found})
        assert sorted(r["rank"] for r in found) == list(range(1, 11))
    assert len(got) == queries.count() and right >= 0.9 * 10 * len(got)
    assert np.mean([f[0].seen for f in got.values()]) < 0.25 * len(ids)


def test_a_beam_without_bound_is_exact(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(300, 5))
    x[20] = x[10]  # a tie
    rows = spark.createDataFrame([(int(i), [float(v) for v in r]) for i, r in enumerate(x)] + [(999, None)], "id long, embedding array<double>")
    graphs = build_graphs(rows, "id", part=100)  # several parts
    assert graphs.count() == 3
    got = [(r.id, round(r.similarity, 5)) for r in graph_search(graphs, x[10].tolist(), 12, "id", 1 << 30).collect()]
    s = unit(x).astype(np.float32).astype(np.float64) @ unit(x[10])
    order = np.lexsort((np.arange(300), -s))[:12]
    assert [i for i, _ in got] == order.tolist() and got[0][0] == 10 and got[1][0] == 20
    near = graph_search(graphs, x[10].tolist(), 12, "id", 24).collect()
    assert len({r.id for r in near} & set(order.tolist())) >= 11


def test_graphs_of_few_rows_and_packing(spark):
    kind = "id long, embedding array<double>"
    one = build_graphs(spark.createDataFrame([(5, [1.0, 0.0])], kind), "id")
    assert [(r.id, r.similarity) for r in graph_search(one, [2.0, 0.0], 3, "id", 1).collect()] == [(5, 1.0)]
    none = build_graphs(spark.createDataFrame([], kind), "id")
    assert none.count() == 0 == graph_search(none, [1.0], 3, "id").count()
    rng = np.random.default_rng(1)
    g = Graph.build(unit(rng.normal(size=(200, 8))), 1 - rng.random(200))
    h = Graph.unpack(*g.pack())
    assert g.entry == h.entry or g.levels[g.entry] == h.levels[h.entry]
    assert all(np.array_equal(a, b) for r, s in zip(g.links, h.links, strict=True) for a, b in zip(r, s, strict=True))
    same = Graph.build(np.ones((50, 3)) / 3**0.5, 1 - rng.random(50))  # copies of one vector
    assert len(same.best(np.ones(3) / 3**0.5, 10, 5, np.arange(50))[0]) == 5


@pytest.mark.parametrize("n", [2, 30])
def test_links_reach_every_row(n):
    rng = np.random.default_rng(n)
    g = Graph.build(unit(rng.normal(size=(n, 4))), 1 - rng.random(n))
    found, seen = g.search(unit(rng.normal(size=4)), n)
    assert len(found) == n == seen
