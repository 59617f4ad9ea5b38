"""Best fit against a plain search, mixing against its contract."""

import random
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from lectern.llm.mixing import PERCENT, WEIGHTS, mix, mixed_documents, source_targets
from lectern.llm.packing import best_fit, pack, pack_documents, pack_near_documents
from lectern.llm.queries import QUERIES


def plain(sizes, sources, clusters, capacity):
    bins, out = [], []
    for n, s, c in zip(sizes, sources, clusters):
        fits = [(room, i) for i, (room, ss, cc) in enumerate(bins) if room >= n and not ss & s and not cc & c]
        if fits:
            i = min(fits)[1]
        else:
            i = len(bins)
            bins.append((capacity, 0, 0))
        room, ss, cc = bins[i]
        bins[i] = (room - n, ss | s, cc | c)
        out.append(i)
    return out, [b[0] for b in bins]


def test_best_fit_is_the_tightest_compatible():
    rng = random.Random(4)
    for _ in range(60):
        n = rng.randint(0, 80)
        sizes = sorted((rng.randint(1, 30) for _ in range(n)), reverse=True)
        sources, clusters = [1 << rng.randint(0, 4) for _ in range(n)], [rng.choice([0, 1 << rng.randint(0, 6)]) for _ in range(n)]
        assert best_fit(sizes, sources, clusters, 30) == plain(sizes, sources, clusters, 30)


def test_pack_is_whole_and_free_of_conflicts(spark):
    rng = random.Random(7)
    rows = [(i, rng.choice(["a", "b", "c", None]), rng.choice(["x", "y", None, str(i)]), rng.choice([0, 1, 5, 40, 99, 100, 250, None])) for i in range(400)] + [(None, "a", "x", 7), (3, "a", "x", 7), (3, "a", "x", 7)]
    df = spark.createDataFrame(rows, "doc_id long, source string, cluster string, size int")
    got = pack(df, 100, shard=64).collect()
    words = Counter()
    bins = defaultdict(list)
    info = defaultdict(list)
    for d, s, c, n in rows:
        info[d].append((s, c, n or 0))
    for r in got:
        words[r.doc_id] += r.words
        if r.bin is not None:
            bins[(r.shard, r.bin)].append(r)
    assert words == Counter({d: sum(n for _, _, n in v) for d, v in info.items()}) + Counter({d: 0 for d in info})
    for items in bins.values():
        assert sum(r.words for r in items) + items[0].room == 100
        single = [info[r.doc_id][0] for r in items if len(info[r.doc_id]) == 1]
        for k in (0, 1):
            seen = [x[k] for x in single if x[k] is not None]
            assert len(seen) == len(set(seen))
    assert len({r.shard for r in got if r.shard is not None}) > 1
    assert pack(df.limit(0), 100).count() == 0


def test_pack_documents(spark):
    df = spark.createDataFrame([(1, "Same text", "a", 9), (2, "same  TEXT", "b", 9), (3, None, "c", 9), (4, "w " * 5000, None, 9)], "doc_id long, text string, source string, size int")
    got = pack_documents(df).collect()
    at = {r.doc_id: (r.shard, r.bin) for r in got}
    assert at[1] != at[2] and at[3] == (None, None)
    assert sorted((r.piece, r.start, r.words) for r in got if r.doc_id == 4) == [(0, 0, 2048), (1, 2048, 2048), (2, 4096, 904)]


def test_near_copies_never_share_a_bin(spark, tmp_path):
    rng = random.Random(5)
    words = [f"w{i}" for i in range(500)]
    base = [rng.choice(words) for _ in range(100)]
    near = [" ".join([*base[:i], "changed", *base[i + 1 :]]) for i in (0, 40, 99)]
    rows = [(k, t, f"s{k}") for k, t in enumerate([" ".join(base), *near, " ".join(base).upper()])]
    rows += [(None, t.replace("w", "v"), f"n{k}") for k, t in enumerate(near)] + [(20, "É " + "été " * 8, "x"), (21, "é " + "ÉTÉ " * 8, "y"), (22, None, "x"), (23, "", "z")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("component", F.lit("clash"))
    df.write.parquet(f"{tmp_path}/documents.parquet")
    got = QUERIES["op2_best_fit_packing"](spark, str(tmp_path)).collect()
    assert sum(r.words for r in got) == sum(len((t or "").split()) for _, t, _ in rows) and len(got) == len(rows)
    bins = lambda ids: [(r.shard, r.bin) for r in got if r.doc_id in ids]
    assert len(set(bins(range(5)))) == 5 and len(set(bins([None]))) == 3 and len(set(bins((20, 21)))) == 2
    assert bins((22, 23)) == [(None, None)] * 2
    assert len(set(bins([None, *range(5)]))) == 5
    assert sorted(map(str, pack_near_documents(df.repartition(3)).collect())) == sorted(map(str, got))
    assert pack_near_documents(df.limit(0)).count() == 0


def shares(sizes):
    """Targets by resharing one step at a time."""
    out, open_, left = {}, set(range(len(sizes))), sum(n for _, n in sizes) * PERCENT / 100
    weight = [WEIGHTS[i % len(WEIGHTS)] for i in range(len(sizes))]
    while open_:
        heavy = sum(weight[i] for i in open_)
        over = {i for i in open_ if left * weight[i] / heavy > 2 * sizes[i][1]}
        for i in over or open_:
            out[i] = float(2 * sizes[i][1]) if over else left * weight[i] / heavy
        left -= sum(out[i] for i in over)
        open_ = open_ - over if over else set()
    return {s: out[i] for i, (s, _) in enumerate(sizes)}


def test_targets(spark):
    rng = random.Random(4)
    cases = [[("a", 100), ("b", 100), ("c", 100)], [("a", 10), ("b", 1000), ("c", 500), (None, 0)], [(None, 7)], [(None, 0)], [("Z", 5), ("a", 5), ("É", 900), ("ﬀ", 1), ("𝒳", 40)]]
    cases.append([(f"s{i:05d}", rng.choice([0, 1, 50, 4000])) for i in range(3000)])
    for sizes in cases:
        df = spark.createDataFrame(sizes, "source string, n long").repartition(5)
        got = {r.source: r for r in source_targets(df).collect()}
        want = shares(sizes)
        assert got.keys() == want.keys() and all(abs(got[s].target - t) < 1e-6 * max(1, t) for s, t in want.items())
        assert all(got[s].source_size == n and got[s].target <= 2 * n for s, n in sizes)
    assert source_targets(spark.createDataFrame([], "source string, n long")).count() == 0


def test_mix(spark):
    rng = random.Random(2)
    rows = [(i, "w " * rng.choice([0, 1, 3, 50, 51, 400]), rng.choice(["hot"] * 5 + ["b", "c", None])) for i in range(600)] + [(None, "null id", "b"), (1, "again", "c"), (1, "again", "c"), (9, None, "c")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("size", F.lit("clash"))
    got = mix(df).collect()
    assert len(got) == len(rows)
    taken, size, target = Counter(), {}, {}
    for r in got:
        assert r.taken % max(r.size, 1) == 0 and r.taken <= 2 * r.size
        key = (r.source_size, r.target)
        taken[key] += r.taken
        target[key] = r.target
    assert all(abs(taken[k] - target[k]) <= 1000 for k in target)
    assert sorted(map(str, mix(df.repartition(7)).collect())) == sorted(map(str, got))
    docs = mixed_documents(df)
    assert docs.columns == df.columns and docs.selectExpr("sum(size(filter(split(text, ' '), x -> x <> '')))").first()[0] == sum(taken.values())
    assert mix(df.limit(0)).count() == 0 and mixed_documents(df.limit(0)).count() == 0
