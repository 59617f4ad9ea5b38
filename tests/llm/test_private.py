"""Personal data: base spans against regular expressions, the label model against planted reliabilities, added spans on planted cases."""

import hashlib
import random
import re

import numpy as np
from pyspark.sql import functions as F

from lectern.llm import private as P

FORMS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([ -]?[0-9])+", "phone": r"\+[0-9][ ().0-9-]+[0-9]"}


def base(text):
    out = []
    for kind, form in FORMS.items():
        for m in re.finditer(form, text):
            digits = re.sub("[^0-9]", "", m[0])
            ok = {"email": True, "ip": all(int(x) <= 255 for x in m[0].split(".") if kind == "ip"), "card": 12 <= len(digits) <= 19 and P.luhn(digits.encode()), "phone": 9 <= len(digits) <= 15}[kind]
            if ok:
                out.append((m.start(), P.KINDS.index(kind), m.end()))
    return [f"{P.KINDS[k]}:{s}:{e}" for s, k, e in sorted(out)]


def carded(rng, n=16):
    body = str(rng.randint(4, 5)) + "".join(rng.choice("0123456789") for _ in range(n - 2))
    return next(body + d for d in "0123456789" if P.luhn((body + d).encode()))


def test_base_spans_by_regular_expressions(spark):
    rng = random.Random(11)
    texts = ["", None, "a@b@c.de.x@y.com", "1.2.3.4.5.6.7.8 256.1.1.1 0000000255.0.0.1", "+1+2 (3)4-5 678901 +49 30 1234567.", "4111 1111-1111 1111 4111111111111111 4111  1111", "é+1 (555) 555-1234é 4111111111111111", "x" * 3000 + "@b.c", "@" * 2000, "1." * 2000 + "1", "7" * 30_000, "+1" * 500 + " " * 500 + "2"]
    texts += ["".join(rng.choice(["1", "2", "55", "4111111111111111", ".", "-", " ", "+", "(", ")", "@", "a", "b.", "é", "\n", "😀", "\x00", "255"]) for _ in range(rng.randint(1, 60))) for _ in range(3000)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumns({"spans": F.lit("clash"), "kind": F.lit(3)})
    got = {r.doc_id: r for r in P.span_digests(P.find_private(df)).collect()}
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        want = base(t or "")
        assert got[i].base_sha256 == hashlib.sha256(",".join(want).encode()).hexdigest(), (i, t, want, got[i].spans)
        assert [got[i][f"n_{k}"] for k in P.KINDS] == [sum(x.startswith(k) for x in want) for k in P.KINDS]
        assert set(want) <= set(got[i].spans.split(",")) | {""}


def test_label_model_finds_the_reliabilities():
    rng = np.random.default_rng(5)
    right = np.array([0.9, 0.95, 0.8, 0.6, 0.85, 0.7])
    truth = rng.random(20_000) < 0.3
    said = np.where(rng.random((20_000, 6)) < right, truth[:, None], ~truth[:, None]) * 2 - 1
    said[rng.random((20_000, 6)) < 0.2] = 0
    said[:, 1] = np.where(truth, np.abs(said[:, 1]), said[:, 1])  # the check never fails what is true
    rows, n = np.unique(said, axis=0, return_counts=True)
    chance = P.label_model([(tuple(map(int, r)), int(c)) for r, c in zip(rows, n, strict=True)])
    guess = np.array([chance[tuple(map(int, s))] for s in said])
    assert ((guess > 0.5) == truth).mean() > 0.95 and all(chance[tuple(map(int, r))] == 0 for r in rows if r[1] == -1)
    assert abs(guess.mean() - 0.3) < 0.03 and P.label_model([]) == {}


def test_adds_what_the_patterns_miss_and_nothing_else(spark):
    rng = random.Random(3)
    words = "alpha beta gamma delta epsilon zeta eta theta iota kappa".split()
    prose = lambda n: " ".join(rng.choice(words) for _ in range(n))
    phone = lambda: f"+1 ({rng.randint(200, 999)}) 555-{rng.randint(1000, 9999)}"
    address = lambda: ".".join(str(rng.randint(11, 250)) for _ in range(4))
    bad_card = lambda: next(x for x in ("".join(rng.choice("0123456789") for _ in range(16)) for _ in range(99)) if not P.luhn(x.encode()))
    rows, planted, clean = [], {}, []
    for i in range(600):
        kind = i % 12
        said = {0: phone(), 1: address(), 2: carded(rng), 3: f"jo.{rng.choice(words)}@{rng.choice(words)}.com", 4: bad_card(), 5: f"version {rng.randint(1, 9)}.{rng.randint(0, 9)}.{rng.randint(0, 9)}", 6: "%040x" % rng.getrandbits(160), 7: " ".join(str(rng.randint(0, 99)) for _ in range(40))}.get(kind, "")
        text = f"{prose(8)} {said} {prose(8)}"
        if kind in (8, 9, 10, 11):
            extra, rest = {8: (phone(), " " + address()), 9: (carded(rng), " " + bad_card()), 10: (f"jo [at] {rng.choice(words)} dot com", ""), 11: (f"({rng.randint(200, 999)}) 555-{rng.randint(1000, 9999)}", "")}[kind]
            text = f"{prose(6)} {'call ' if kind == 11 else 'mail ' if kind == 10 else ''}{extra}{rest} {prose(6)}"
            at = text.index(extra)
            planted[i] = f"{ {8: 'phone', 9: 'card', 10: 'email', 11: 'phone'}[kind]}:{at}:{at + len(extra)}"
        elif kind > 3:
            clean.append(i)
        rows.append((i, text))
    got = {r.doc_id: r.spans for r in P.span_digests(P.find_private(spark.createDataFrame(rows, "doc_id long, text string"))).collect()}
    caught = [i for i, x in planted.items() if x in got[i].split(",")]
    assert len(caught) >= 0.95 * len(planted), [(rows[i][1], got[i], planted[i]) for i in planted if i not in caught][:5]
    assert sum(got[i] == "" for i in clean) >= 0.99 * len(clean), [(rows[i][1], got[i]) for i in clean if got[i]][:5]


def test_repeated_rows_and_empty_tables(spark):
    rows = [(1, "mail a@b.com"), (1, "mail a@b.com"), (None, "mail a@b.com"), (2, None)]
    got = sorted((r.doc_id or 0, r.n_email, r.spans) for r in P.span_digests(P.find_private(spark.createDataFrame(rows, "doc_id long, text string"))).collect())
    assert got == [(0, 1, "email:5:12"), (1, 1, "email:5:12"), (1, 1, "email:5:12"), (2, 0, "")]
    assert P.find_private(spark.createDataFrame([], "doc_id long, text string")).count() == 0
