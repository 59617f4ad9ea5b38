"""Filter interactions against applying every order to every document."""

import random
from collections import Counter
from itertools import permutations

from pyspark.sql import functions as F

from lectern.llm.audit import FILTERS, audit

KIND, MARKS = "doc_id long, lang string, text string", "doc_id long, quality int, toxic int"


def fails(text, later):
    ws = [w for w in text.encode().split()]
    upper = sum("A" <= c <= "Z" for c in text)
    return (len(ws) < 100, 100 * len(set(ws)) < 80 * len(ws), 100 * upper > 10 * len(text), any(c in "#$%&*|" for c in text), later)


def brute(rows, labels):
    least = {}
    for i, _, t in rows:
        if i is not None:
            least[t or ""] = min(i, least.get(t or "", i))
    docs = [(lang or "", fails(t or "", i is not None and i > least[t or ""]), any(a == i and q == 1 for a, q, _ in labels if i is not None), any(a == i and x == 1 for a, _, x in labels if i is not None)) for i, lang, t in rows]
    out, shapley = {}, Counter()
    for part in {d[0] for d in docs}:
        own = [d for d in docs if d[0] == part]
        for order in map("".join, permutations(FILTERS)):
            left = own
            for step, name in enumerate(order, 1):
                k = FILTERS.index(name)
                gone, left = [d for d in left if d[1][k]], [d for d in left if not d[1][k]]
                shapley[part, name] += len(gone)
                out[part, order, step] = (len(left), len(gone), sum(d[1][k] for d in own) - len(gone), sum(d[1][k] and sum(d[1]) == 1 for d in own), sum(d[2] for d in gone), sum(d[3] for d in gone))
    return {k: (*v, shapley[k[0], k[1][k[2] - 1]]) for k, v in out.items()}


def check(spark, rows, labels):
    docs = spark.createDataFrame(rows, KIND).withColumns({"mask": F.lit("clash"), "part": F.lit(1), "set": F.lit(2)})
    got = {(r.part, r.filter_order, r.step): (r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley) for r in audit(docs, spark.createDataFrame(labels, MARKS)).collect()}
    want = brute(rows, labels)
    assert got == want and len(got) == 600 * len({x[1] or "" for x in rows})


def test_by_brute_force(spark):
    rng = random.Random(12)
    vocabulary = [a + b for a in "abcdefghijklmnop" for b in "qrstuvwxyz"]

    def text():
        ws = [rng.choice(vocabulary) for _ in range(rng.choice([20, 99, 100, 130]))] if rng.random() < 0.5 else rng.sample(vocabulary, 110)
        return " ".join(w.upper() if rng.random() < 0.12 * rng.randint(0, 1) else w for w in ws) + rng.choice(["", "", " #", "|x"])

    texts = [text() for _ in range(60)]
    rows = [(i, rng.choice(["en", "de", None, ""]), rng.choice(texts)) for i in range(150)]
    rows += [(200, "en", None), (201, "en", ""), (202, "fr", " \t"), (None, "en", texts[0]), (None, "en", texts[0]), (3, "en", rows[3][2]), rows[3], rows[3], (203, "long", "é " * 200_000), (204, "long", "A" * 300_000)]
    labels = [(i, rng.randint(0, 1), rng.randint(0, 1)) for i in range(0, 205, 2)] + [(4, 1, 1), (4, 0, 0), (None, 1, 1), (6, None, None), (9999, 1, 1)]
    check(spark, rows, labels)


def test_hot_texts_and_empty_tables(spark):
    rows = [(i, "en", "one text # of many copies" if i % 3 else f"own {i}") for i in range(1500)]
    check(spark, rows, [(i, 1, 0) for i in range(0, 1500, 7)])
    check(spark, rows[:3], [])
    assert audit(spark.createDataFrame([], KIND), spark.createDataFrame([], MARKS)).count() == 0
