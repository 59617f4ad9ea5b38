"""Rules, resampling, toxicity, URLs, tokens and near-duplicates against brute force and held-out labels."""

import random
import re
from itertools import product

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lectern.llm import neardup as N
from lectern.llm import resample as R
from lectern.llm import tokens as K
from lectern.llm import toxicity as X
from lectern.llm import urlfilter as U
from lectern.llm.components import connected_components
from lectern.llm.neardup import near_duplicates
from lectern.llm.rules import HostRules, beta_prior, host_quality
from lectern.llm.urlfilter import filter_urls

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau".split()


def prose(rng, n):
    return " ".join(rng.choice(WORDS) + rng.choice(["", "", "s", "ed", "ing"]) for _ in range(n))


def test_rules_by_brute_force(spark):
    rng = random.Random(1)
    texts = ["", None, "a b c a b c", "one two", "é # \n x\n x\n\n x \n", "a a a a", "x\x0by\x0cz\rw\tv", prose(rng, 300), "#$% " * 60] + ["\n".join(rng.choice(["a b", "c", "", " "]) for _ in range(9)) for _ in range(40)]
    df = spark.createDataFrame([(i, t, "s%d" % (i % 3) if i % 7 else None) for i, t in enumerate(texts)], "doc_id long, text string, source string").withColumn("domain", F.lit("clash"))
    got = {r.doc_id: r for r in host_quality(df).collect()}
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        ws = [w.decode() for w in (t or "").encode().split()]
        grams = [tuple(ws[j : j + 3]) for j in range(len(ws) - 2)]
        cover = {p for j, g in enumerate(grams) if grams.count(g) > 1 for p in (j, j + 1, j + 2)}
        lines = [x for x in (t or "").split("\n") if x.encode().split()]
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (len(ws), sum(map(len, ws)), sum((t or "").count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(cover)), i
        assert r.base_failed == (len(ws) < 50 or 100 * len(cover) > 50 * len(ws))
    assert host_quality(df.limit(0)).count() == 0


def test_bad_host_falls_and_small_host_is_shrunk(spark):
    rng = random.Random(3)
    good = prose(rng, 80)
    rows = [(i, good + str(i), f"ok{i % 8}") for i in range(400)] + [(1000 + i, "too short" if i % 10 else good, "bad") for i in range(60)] + [(2000, "x", "tiny"), (2001, good, "tiny")]
    got = {r.doc_id: r for r in host_quality(spark.createDataFrame(rows, "doc_id long, text string, source string"), rules=HostRules()).collect()}
    assert not got[1000].kept and not got[1010].kept and got[1000].host_rate > 0.5
    assert got[2001].kept and all(got[i].kept for i in range(400))


def test_host_verdicts_part_documents(spark):
    rng = random.Random(4)
    noisy = lambda: prose(rng, 60) + " " + "#$% " * 40
    rows = [(i, noisy() if i % 5 == 0 else prose(rng, 70), "mixed") for i in range(200)] + [(1000 + i, noisy() if i == 0 else prose(rng, 70), "clean") for i in range(400)]
    rows += [(2000 + i, "\n".join([prose(rng, 30)] * 2 + [prose(rng, 20)]) if i % 4 == 0 else prose(rng, 70), None) for i in range(80)]
    got = {r.doc_id: r for r in host_quality(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    assert got[1000].kept and got[1000].failed and got[1000].host_verdict == "trusted"
    assert all(got[i].kept == bool(i % 5) and got[i].host_verdict == "watched" for i in range(200))
    assert all(got[2000 + i].kept == bool(i % 4) for i in range(80))
    twice = {r.doc_id: r.kept for r in host_quality(spark.createDataFrame(rows + rows, "doc_id long, text string, source string")).collect()}
    assert len(twice) == len(got)


def test_prior_takes_sampling_off(spark):
    rng = random.Random(7)
    same = spark.createDataFrame([(20, sum(rng.random() < 0.2 for _ in range(20))) for _ in range(400)], "docs long, failures long")
    alpha, beta = beta_prior(same)
    assert abs(alpha / (alpha + beta) - 0.2) < 0.03 and alpha + beta > 50
    spread = spark.createDataFrame([(200, sum(rng.random() < p for _ in range(200))) for p in (rng.betavariate(2, 6) for _ in range(600))], "docs long, failures long")
    alpha, beta = beta_prior(spread)
    assert abs(alpha - 2) < 0.6 and abs(beta - 6) < 1.6
    assert beta_prior(same.limit(0)) == (1.0, 1.0)


def test_kth_greatest(spark):
    rng = random.Random(5)
    values = [rng.gauss(0, 1) for _ in range(3000)] + [0.5] * 500
    df = spark.createDataFrame([(v,) for v in values], "x double")
    for k in (1, 7, 1200, 3500):
        assert R.kth_greatest(df, "x", k, bins=16, few=10) == sorted(values, reverse=True)[k - 1]
    assert R.kth_greatest(df, "x", 0) == float("inf")


def test_resampling_keeps_good_and_drops_junk(spark):
    rng = random.Random(8)
    rows = [(i, prose(rng, rng.randint(60, 200)) if i % 4 else " | ".join(prose(rng, 80).split()), "x") for i in range(600)] + [(None, None, "x"), (9001, "", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_ngrams string")
    labels = spark.createDataFrame([(i, int(i % 4 > 0)) for i in range(0, 600, 2)] + [(None, 1), (5, None)], "doc_id long, quality int")
    got = {r.doc_id: r.kept for r in R.quality_classifier(docs, labels).collect()}
    held = range(1, 600, 2)
    assert sum(got[i] == bool(i % 4) for i in range(0, 600)) > 590 and all(got[i] for i in held if i % 4)
    assert all(r.kept for r in R.quality_classifier(docs, labels.limit(0)).collect())
    assert R.quality_classifier(docs.limit(0), labels).count() == 0


def brute_tokens(text):
    """Runs of letters and digits (all beyond ASCII count as such), single other characters, in order."""
    out, run = [], b""
    for c in (text or "").encode():
        if c >= 128 or chr(c).isalnum():
            run += bytes((c,))
            continue
        if run:
            out.append(run)
        run = b""
        if chr(c) not in " \t\n\x0b\x0c\r":
            out.append(bytes((c,)))
    return out + ([run] if run else [])


def test_resampling_by_brute_force(spark, monkeypatch):
    monkeypatch.setattr(R, "MARGIN", -0.1)  # these texts lie close together
    rng = random.Random(12)
    text = lambda bad: " ".join((rng.choice(["#", "|", "zz", "9"]) if rng.random() < bad else rng.choice(WORDS)) for _ in range(rng.randint(5, 60)))
    rows = [(i, text(rng.random())) for i in range(300)] + [(900, None), (901, " \n"), (7, "copy of an id | é!")]
    quality = {i: int(sum(c in "#|" for c in t) * 8 < len(t.split())) for i, t in rows[:300] if i % 3}
    docs, labels = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(list(quality.items()), "doc_id long, quality int")
    # exact counts of n-grams, without hashing
    raw, target, grams = {}, {}, []
    for i, t in rows:
        ws = brute_tokens(t)
        own = [(w,) for w in ws] + list(zip(ws, ws[1:]))
        grams.append(own)
        for g in own:
            raw[g] = raw.get(g, 0) + 1
            if quality.get(i) == 1:
                target[g] = target.get(g, 0) + 1
    n_raw, n_target = sum(raw.values()) + R.BUCKETS / 2, sum(target.values())
    p = {g: (c + 0.5) / n_raw for g, c in raw.items()}
    ratio = {g: np.log((target.get(g, 0) / n_target + R.PRIOR * p[g]) / (1 + R.PRIOR) / p[g]) for g in raw}
    mean = [np.mean([ratio[g] for g in own]) if own else None for own in grams]
    model = R.fit(docs, labels)
    got = R.with_weights(docs, model).withColumn("key", R.gumbel_key()).withColumn("kept", R.is_kept(model)).collect()
    for (i, t), m, own, r in zip(rows, mean, grams, got, strict=True):
        assert (r.doc_id, r.n_ngrams) == (i, len(own))
        assert abs(r.log_weight - (R.TEMPER * m if own else 0)) < 2e-3 * (1 + R.TEMPER)
    # the k greatest keys, k the documents that are not much less likely under the target
    full = [r for r in got if r.n_ngrams]
    k = sum(r.log_weight >= -R.TEMPER * R.MARGIN for r in full)
    best = sorted((r.key for r in full), reverse=True)[k - 1]
    assert all(r.kept == (not r.n_ngrams or r.key >= best) for r in got) and 50 < k < 290
    # the draw matters: a plain threshold would choose others
    assert sum(r.kept != (r.log_weight >= sorted((x.log_weight for x in full), reverse=True)[k - 1]) for r in full) > 5
    assert sum(r.kept for r in R.quality_classifier(docs, labels, share=0.5).collect()) == 2 + round(0.5 * len(full))


def test_sampling_frequencies(spark):
    weights = [3.0, 2.0, 1.0, 0.5, 0.0, -0.5, -1.0, -2.0]
    df = spark.createDataFrame([(i, w) for i, w in enumerate(weights)], "doc_id long, log_weight double").coalesce(1).cache()
    rng, k, times = np.random.default_rng(1), 4, 300
    keys = df.select("doc_id", *[R.gumbel_key(s).alias(f"k{s}") for s in range(times)]).orderBy("doc_id").toPandas().drop(columns="doc_id").to_numpy()
    got = (keys.argsort(0)[::-1][:k][:, :, None] == np.arange(len(weights))).any(0).mean(0)
    want = ((np.array(weights) + rng.gumbel(size=(20_000, len(weights)))).argsort(1)[:, ::-1][:, :k, None] == np.arange(len(weights))).any(1).mean(0)
    assert np.abs(got - want).max() < 0.1
    one = df.withColumn("key", R.gumbel_key(5))
    assert R.kth_greatest(one, "key", k) == sorted(keys[:, 5], reverse=True)[k - 1]
    df.unpersist()


def brute_marginals(e, begin, step):
    n = len(e)
    total = np.zeros(n)
    z = 0.0
    for y in product((0, 1), repeat=n):
        s = sum(v for v, q in zip(e, y) if q) + begin * y[0] + sum(step[a, b] for a, b in zip(y, y[1:]))
        w = np.exp(s)
        z += w
        total += w * np.array(y)
    return total / z


def test_forward_backward_by_enumeration():
    rng = np.random.default_rng(2)
    e, step = rng.normal(size=17), rng.normal(size=(2, 2))
    chain = np.array([0, 5, 6, 14, 17])
    odds, _, _ = X.forward_backward(e, chain, 0.3, step)
    want = np.concatenate([brute_marginals(e[a:b], 0.3, step) for a, b in zip(chain, chain[1:])])
    assert np.allclose(1 / (1 + np.exp(-odds)), want)


def walked(e, begin, step):
    """Forward and backward log odds of one chain, token by token."""
    t, n = np.exp(step), len(e)
    a, b = np.zeros(n), np.zeros(n)
    for i in range(n):
        r = np.exp(a[i - 1]) if i else 0
        a[i] = e[i] + (np.log((t[0, 1] + t[1, 1] * r) / (t[0, 0] + t[1, 0] * r)) if i else begin)
    for i in range(n - 2, -1, -1):
        r = np.exp(e[i + 1] + b[i + 1])
        b[i] = np.log((t[1, 0] + t[1, 1] * r) / (t[0, 0] + t[0, 1] * r))
    return a, b


@pytest.mark.parametrize("piece", [1, 3, 7, 128])
def test_pieces_of_a_chain_are_exact(monkeypatch, piece):
    monkeypatch.setattr(X, "PIECE", piece)
    rng = np.random.default_rng(piece)
    size = np.array([5, 1, 700, 3, 128, 129, 1, 256, 40])
    chain, step = np.concatenate([[0], np.cumsum(size)]), rng.normal(size=(2, 2)) * 2
    e = np.clip(rng.normal(size=chain[-1]) * 8, -40, 40)
    odds, a, b = X.forward_backward(e, chain, 0.3, step)
    for i, j in zip(chain, chain[1:]):
        x, y = walked(e[i:j], 0.3, step)
        assert np.allclose(a[i:j], x) and np.allclose(b[i:j], y) and np.allclose(odds[i:j], x + y)
    none = X.forward_backward(np.zeros(0), np.zeros(1, np.int64), 0.3, step)
    assert [len(x) for x in none] == [0, 0, 0]


def test_a_field_keeps_every_feature():
    rng = np.random.default_rng(4)
    shift = np.uint64(64 - X.SLOTS_BITS)
    names = np.unique(np.concatenate([rng.integers(0, 2**63, 3000, np.uint64), (np.uint64(5) << shift) + np.arange(1, 40, dtype=np.uint64)]))
    weights, field = rng.normal(size=len(names)) / 100, X.Field(bias=0.0)
    field.learn(names, weights)
    unknown = np.array([(5 << int(shift)) + 99, 12345], np.uint64)
    got = field.emissions(np.concatenate([names, unknown])[:, None])
    assert len(field.others) >= 38 and np.allclose(got[:-2], weights, atol=1e-6) and (got[-2:] == 0).all()


def test_toxicity_scores_by_brute_force(spark):
    rng = random.Random(8)
    field = X.Field(bias=-1.0, begin=-0.2, step=np.array([[0.3, -0.7], [-0.5, 0.6]]), logistic=(-2.0, 1.5, 0.8))
    known = X.tokens(pa.array([" ".join(WORDS)]), X.Powers())
    field.learn(known.features[:, 0], np.array([rng.gauss(0, 2) for _ in WORDS]))
    texts = [None, "", "...", "alpha", "alpha beta\n\ngamma, alpha", prose(rng, 9000), "beta " * 400 + "\n" + "tau", "é alpha é"] + [prose(rng, rng.randint(1, 300)).replace("s ", "\n") for _ in range(40)]
    rows = list(enumerate(texts)) + [(3, "alpha"), (None, "beta")]
    got = sorted(((-1 if r.doc_id is None else r.doc_id), r.score, [tuple(x) for x in r.spans]) for r in X.score(spark.createDataFrame(rows, "doc_id long, text string"), field).collect())
    for (i, text), (at, score, spans) in zip(sorted(rows, key=lambda r: -1 if r[0] is None else r[0]), got, strict=True):
        assert at == (-1 if i is None else i)
        odds, places, base = [], [], 0
        for line in (text or "").split("\n"):
            raw = line.encode()
            found = list(re.finditer(rb"[0-9A-Za-z\x80-\xff]+", raw))
            e = np.clip([field.bias + X.Field.emissions(X.Field(bias=0.0, weights=field.weights, marks=field.marks, shared=field.shared, others=field.others, other_weights=field.other_weights), X.tokens(pa.array([m[0].decode(errors="surrogateescape")]), X.Powers()).features)[0] for m in found] if len(found) < 500 else field.emissions(X.tokens(pa.array([line]), X.Powers()).features), -40, 40)
            a, b = walked(np.asarray(e, float), field.begin, field.step)
            odds += list(a + b)
            places += [(base + m.start(), base + m.end()) for m in found]
            base += len(raw) + 1
        most = max([-30.0, *np.clip(odds, -30, 30)])
        count = np.log1p(sum(1 / (1 + np.exp(-x)) for x in odds))
        assert np.isclose(score, 1 / (1 + np.exp(-(-2.0 + 1.5 * most / 10 + 0.8 * count)))), (i, text)
        hot = [x for x, o in zip(places, odds, strict=True) if o > 0]
        assert {s for s, _ in spans} <= {s for s, _ in hot} and {e for _, e in spans} <= {e for _, e in hot}
        assert all(any(s <= x and y <= e for s, e in spans) for x, y in hot)


def test_toxicity_of_empty_tables_and_repeated_rows(spark):
    labels = spark.createDataFrame([(1, 1), (3, 0)], "doc_id long, toxic int")
    assert X.toxicity(spark.createDataFrame([], "doc_id long, text string"), labels).count() == 0
    rows = [(1, "zznit one"), (1, "zznit one"), (1, "zznit " + "a " * 30_000), (3, "two"), (3, "two")]
    got = X.toxicity(spark.createDataFrame(rows, "doc_id long, text string"), labels).collect()
    assert len(got) == 5 and len({r.score for r in got if r.doc_id == 3}) == 1


def test_toxicity_held_out(spark):
    rng = random.Random(11)
    bad = ["blorgface", "zznit", "vexoid"]

    def text(toxic):
        ws = prose(rng, rng.randint(30, 90)).split()
        for _ in range(rng.randint(2, 6) if toxic else 0):
            ws.insert(rng.randint(0, len(ws)), rng.choice(bad).upper() + ",")
        return " ".join(ws)

    rows = [(i, text(i % 5 == 0)) for i in range(800)]
    docs = spark.createDataFrame(rows + [(5000, None), (5001, ""), (None, "x")], "doc_id long, text string").withColumn("score", F.lit("clash"))
    labels = spark.createDataFrame([(i, int(i % 5 == 0)) for i in range(800)] + [(1, None), (None, 1)], "doc_id long, toxic int")
    got = {r.doc_id: r for r in X.toxicity(docs, labels).collect()}
    held = [i for i in range(800) if got[i].held_out]
    assert 100 < len(held) < 300 and all(got[i].predicted == (i % 5 == 0) for i in held)
    raw = dict(rows)
    for i in (0, 5):
        assert any(raw[i].encode()[s.start : s.end].decode().lower() in bad for s in got[i].spans)
    assert got[5000].predicted == 0 and got[5001].score == got[5000].score
    assert all(r.predicted == 0 for r in X.toxicity(docs, labels.limit(0)).collect())


def test_urls(spark):
    rows = [(1, "http://WWW.Example.com/en/x?q#f"), (2, "https://a.example.com/en/1"), (3, "http://x.net/es/1"), (4, "http://x.net"), (5, None), (6, "no scheme"), (7, "http://notcom/"), (8, "http://b.org/fr/2"), (9, "http://c.com/"), (10, "http://É.com/a"), (11, "a://b://c/d"), (12, "http://b.org/fr/2")]
    got = {r.page_id: r for r in filter_urls(spark.createDataFrame(rows, "page_id long, url string").withColumn("host", F.lit("clash"))).collect()}
    assert [(got[1].host, got[1].path, got[1].rule, got[1].verdict)] == [("www.example.com", "/en/x", "www.example.com/en/", "allow")]
    assert (got[2].rule, got[2].verdict) == ("example.com/en/", "block") and got[3].rule == "net/es/"
    assert got[4].rule is None and got[7].rule is None and got[4].path == ""
    assert (got[5].host, got[5].path) == ("", "") == (got[6].host, got[6].path)
    assert got[10].host == "É.com" and (got[11].host, got[11].path) == ("b:", "//c/d")
    assert got[8].verdict == got[12].verdict and all(r.verdict in ("allow", "block") for r in got.values())
    assert filter_urls(spark.createDataFrame(rows, "page_id long, url string").limit(0)).count() == 0
    assert all(r.verdict == "allow" for r in filter_urls(spark.createDataFrame(rows[7:8], "page_id long, url string")).collect())


def test_urls_are_scored_whole(spark):
    rng = random.Random(2)
    rows = [(i, f"http://h{i % 7}.com/a{rng.randint(0, 99)}?ref=good&x={i}") for i in range(60)] + [(100 + i, f"http://h{i % 7}.net/es/b?ref=spam&y={i}#z") for i in range(60)]
    rows += [(300, "http://q.org/p?ref=good&x=1"), (301, "http://q.org/p?ref=spam&y=1#z"), (302, "ref=good"), (303, "ref=spam#z"), (304, "http://q.org/" + "ab" * 20_000)]
    got = {r.page_id: r for r in filter_urls(spark.createDataFrame(rows, "page_id long, url string")).collect()}
    assert got[300].score > got[301].score and (got[300].verdict, got[301].verdict) == ("allow", "block")
    assert got[302].score > got[303].score and got[302].host == got[303].host == ""
    assert len(got) == len(rows) and got[304].verdict in ("allow", "block")


def test_tokens(spark):
    tokenizers = pytest.importorskip("tokenizers")
    import public_tokenizers as P

    rng = random.Random(6)
    alphabet = " \n\t\x1c\x85ab'sé1!<|endoftext|>\u200b😀漢"
    texts = ["", None, "   ", "a  b\n\n c", "<|endoftext|> x", "é" * 6000, " " * 9000 + "x", "ab" * 60_000] + ["".join(rng.choice(alphabet) for _ in range(rng.randint(1, 80))) for _ in range(800)] + [prose(rng, 40_000)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("n_tokens", F.lit("clash"))
    got = {r.doc_id: r for r in K.count_tokens(df).collect()}
    whole = tokenizers.Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    for i, e in enumerate(whole.encode_batch([t or "" for t in texts], add_special_tokens=False)):
        assert (got[i].n_tokens, got[i].n_bytes, got[i].over_limit) == (len(e.ids), len((texts[i] or "").encode()), len(e.ids) > 1024), i
    assert K.count_tokens(df.limit(0)).count() == 0
    twice = K.count_tokens(spark.createDataFrame([(1, "a b"), (1, "a b"), (None, "a b")], "doc_id long, text string")).collect()
    assert len(twice) == 3 and len({r.n_tokens for r in twice}) == 1
    calls, counter = [], K.Counter(P.path("byte_bpe_50k.json"))
    encode, counter.encode = counter.encode, lambda part: calls.append(sum(len(x.encode()) for x in part)) or encode(part)
    many = [prose(rng, n) for n in (5, 200_000, 3, 900, 90_000)]
    assert counter.counts(many) == [len(e.ids) for e in whole.encode_batch(many, add_special_tokens=False)] and max(calls) <= K.BATCH_BYTES and len(calls) > 2
    for name in ("word_bpe_49k.json", "piece_bpe_32k.model"):
        assert K.Counter(P.path(name)).counts(["a b", ""])[1] == 0


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 130)] + [(7, 7), (200, 201), (201, 200)]
    got = dict(map(tuple, connected_components(spark.createDataFrame(edges, "a long, b long")).collect()))
    assert {got[i] for i in range(41)} == {0} and {got[i] for i in range(100, 130)} == {100} and got[201] == 200


@pytest.mark.parametrize("hot", [False, True])
def test_near_duplicates_by_brute_force(spark, monkeypatch, hot):
    """With ``hot``, shared posts of so small a table are dealt over all tasks and go by estimates, too."""
    if hot:
        monkeypatch.setattr(N, "LOOKED", 2)
        monkeypatch.setattr(N, "LEAST_SEEN", 3)
    rng = random.Random(12)
    texts = [prose(rng, 120) for _ in range(12)]
    for base in list(texts[:6]):
        for _ in range(14):
            ws = base.split()
            for _ in range(rng.randint(0, 9)):
                ws[rng.randrange(len(ws))] = rng.choice(WORDS) + str(rng.randint(0, 99))
            texts.append(" ".join(ws))
    shared = prose(rng, 60)
    texts += [shared + " " + prose(rng, 90) for _ in range(40)]
    texts += ["a b", "A  b", "a b c d e", "A B C D E", "", " ", None, "a b", texts[0].upper()]
    rows = list(enumerate(texts)) + [(3, texts[3]), (None, texts[4]), (None, "lonely text without id")]
    sets = []
    for _, t in rows:
        ws = [w.decode() for w in (t or "").translate({i: i + 32 for i in range(65, 91)}).encode().split()]
        sets.append({tuple(ws[j : j + 5]) for j in range(max(1, len(ws) - 4))} if ws else set())
    part = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            x, y = sets[i], sets[j]
            if x and y and 100 * len(x & y) >= 75 * len(x | y):
                a, b = part[i], part[j]
                part = [min(a, b) if p in (a, b) else p for p in part]
    name = {}
    for p, (d, _) in zip(part, rows):
        if d is not None:
            name[p] = min(name.get(p, d), d)
    want = sorted((str(d), len(s), str(name.get(p) if s else d)) for (d, _), s, p in zip(rows, sets, part))
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("cid", F.lit("clash"))
    out = near_duplicates(df).collect()
    assert sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in out) == want
    assert all(r.kept == (r.doc_id == r.component_id) for r in out)
    assert near_duplicates(df.limit(0)).count() == 0


def test_token_arrays_are_whole():
    t = X.tokens(pa.array(["Ab, cd\nef", None, "", "x" * 9]), __import__("lectern.llm.textvec", fromlist=["Powers"]).Powers())
    assert list(t.row) == [0, 0, 0, 3] and list(t.chain) == [0, 2, 3, 4]


@pytest.mark.parametrize("shift", [-500, 0, 500])
def test_the_url_threshold_lies_in_the_gap(spark, shift):
    bins = [(-40 + shift, 0, 30), (-7 + shift, 1, 9), (60 + shift, 9, 0), (81 + shift, 30, 0)]
    assert U._threshold(spark.createDataFrame(bins, "bin long, good long, bad long")) == 27 + shift
    # of two gaps at the same cost the wider one, wherever it lies; without one of the classes none
    even = [(0, 0, 5), (10, 5, 5), (15, 5, 0)]
    assert U._threshold(spark.createDataFrame([(b + shift, g, x) for b, g, x in even], "bin long, good long, bad long")) == 5 + shift
    assert U._threshold(spark.createDataFrame([(shift, 4, 0)], "bin long, good long, bad long")) is None


def test_near_duplicates_exact_and_hot(spark):
    rng = random.Random(21)
    base = [prose(rng, 60).split() for _ in range(12)]
    rows = []
    for i in range(500):  # one common original for most, so that posts, cells and the component are hot
        ws = list(base[0] if i % 3 else base[i % 12])
        for _ in range(rng.randint(0, 3)):
            ws[rng.randrange(len(ws))] = rng.choice(WORDS) + str(rng.randint(0, 9))
        rows.append((i, " ".join(ws)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    sets = {i: {tuple(t.split()[j : j + 5]) for j in range(len(t.split()) - 4)} for i, t in rows}
    root = {i: i for i, _ in rows}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in sets:
        for j in range(i):
            both = len(sets[i] & sets[j])
            if 100 * both >= 75 * (len(sets[i]) + len(sets[j]) - both) and find(i) != find(j):
                root[max(find(i), find(j))] = min(find(i), find(j))
    want = {i: find(i) for i in sets}
    for exact in (False, True):
        assert {r.doc_id: r.component_id for r in near_duplicates(df, exact).collect()} == want
