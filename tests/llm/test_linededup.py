"""Line dedup against the definition, tried run by run."""

import random

from lectern.llm.linededup import dedup_lines


def brute(docs, least):
    """Deleted lines of each (doc_id, text): the union of all runs of lines with words that occur earlier."""
    order = sorted({(d, t) for d, t in docs if t}, key=lambda x: (x[0] is None, x[0] or 0))
    lines = {k: [(i, x, len(x.split())) for i, x in enumerate(k[1].split("\n")) if x.split()] for k in order}
    seen, gone = set(), {k: set() for k in order}
    for k in order:
        own = lines[k]
        for s in range(len(own)):
            for e in range(s + 1, len(own) + 1):
                run = tuple(x for _, x, _ in own[s:e])
                if run in seen and sum(w for _, _, w in own[s:e]) >= least:
                    gone[k].update(i for i, _, _ in own[s:e])
            # runs that begin here are earlier for all that follow
            for e in range(s + 1, len(own) + 1):
                seen.add(tuple(x for _, x, _ in own[s:e]))
    for k in order:
        own = [i for i, _, _ in lines[k]]
        for a, b in zip(own, own[1:]):
            if a in gone[k] and b in gone[k]:
                gone[k].update(range(a, b))
    return gone


def check(spark, docs, least):
    df = spark.createDataFrame(docs, "doc_id long, text string, runs string")
    got = {(r.doc_id, i): r for i, r in enumerate(dedup_lines(df, least).collect())}
    gone = brute([(d, t) for d, t, _ in docs], least)
    want = sorted((str(d), None if t is None else "\n".join(x for i, x in enumerate(t.split("\n")) if i not in gone.get((d, t), ()))) for d, t, _ in docs)
    assert sorted((str(r.doc_id), r.text) for r in got.values()) == want
    return got


def test_random_sequences(spark):
    rng = random.Random(5)
    for least in (1, 3, 6):
        for _ in range(4):
            words = ["a", "b b", "c c c", "d d", "", " ", "e e e e e e"]
            docs = [(i, "\n".join(rng.choice(words) for _ in range(rng.randint(0, 14))), "x") for i in range(12)]
            check(spark, docs, least)


def test_edges(spark):
    long = " ".join(["w"] * 60)
    docs = [(1, None, None), (2, "", None), (3, long, None), (4, long + "\nown line\n" + long, None), (None, long, None), (5, "x\n" + long + "\n\ny y", None), (6, "x\n" + long + "\n\ny y", None)]
    got = check(spark, docs, 50)
    assert {r.doc_id: r.text for r in got.values()}[6] in ("x", "")


def test_same_row_twice_and_empty(spark):
    long = " ".join(["w"] * 60)
    df = spark.createDataFrame([(1, long), (1, long)], "doc_id long, text string")
    assert [r.n_deleted for r in dedup_lines(df).collect()] == [0, 0]
    assert dedup_lines(df.limit(0)).count() == 0


def test_rows_of_hot_and_other_keys_meet_their_line_once(spark):
    from pyspark.sql import functions as F

    from lectern.llm.common import cut, join_counted

    rows = spark.range(6000).select("id", F.when(F.col("id") < 2000, F.lit(-1)).otherwise(F.floor(F.col("id") / 3)).alias("k"))
    counted = cut(rows.groupBy("k").agg(F.count("*").alias("n"), F.min("id").alias("low")).where("n > 1"))
    got = sorted(map(tuple, join_counted(rows, counted, ["k"]).select("id", "k", "low").collect()))
    assert got == sorted(map(tuple, rows.join(counted, "k").select("id", "k", "low").collect()))
    assert {x[1] for x in got} > {-1} and join_counted(rows, counted.limit(0), ["k"]).count() == 0
