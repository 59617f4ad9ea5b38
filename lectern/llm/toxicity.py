"""Toxic spans by a linear-chain conditional random field, folded into document scores and offsets.

Tokens are runs of letters, digits and bytes above ASCII; a chain is a whole line, however long (``PIECE`` tokens of it move
at a time, and what one piece hands to the next is exact). A token's features are its hashed lower-cased form, its prefixes and its suffixes, so marking needs no
Python object a token. Labels mark documents, so token labels come first: in a toxic training document the
tokens whose features sit almost only in toxic training documents, beyond chance. The field is then trained on
these labelled tokens by likelihood, and forward-backward gives every token's marginal. A document's score is
a logistic of its greatest marginal and of the expected number of toxic tokens, calibrated on the training
documents at the true share of toxic labels.

Training sees a bounded, documented sample (``Training``); scoring sees whole texts, in one pass without a
shuffle. Labels, language, source and id are never inputs of a score.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, pieces, text_of
from .textvec import Powers, mix, shingles, text_bytes, words

#: Tokens of a chain that are walked one by one; pieces of this length move side by side.
PIECE = 128
SLOTS_BITS = 20  # of the table that trained features are looked up in first, each under its hash's mark
PREFIXES, SUFFIXES = (3, 4, 5, 6, 7, 8), (3, 4)
_SOLID = np.zeros(256, bool)
_SOLID[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 32


@dataclass(frozen=True)
class Training:
    """Bounds of the sample the field is fitted to, and of the fit."""

    toxic_docs: int = 2000
    clean_docs: int = 4000
    doc_chars: int = 20_000  # longer labelled documents are not used for fitting
    crf_tokens: int = 400_000
    rounds: int = 30
    chance: float = 0.5


@dataclass
class Tokens:
    starts: np.ndarray
    ends: np.ndarray
    row: np.ndarray
    features: np.ndarray  # tokens x features, 64-bit hashes; the first is the whole token's
    chain: np.ndarray  # first token of each chain, and the number of tokens


def tokens(column: pa.Array, powers: Powers) -> Tokens:
    """All tokens of a batch with their features and chains."""
    data, places = text_bytes(column)
    n, width = len(data), 1 + len(PREFIXES) + len(SUFFIXES)
    if n == 0:
        z = np.zeros(0, np.int64)
        return Tokens(z, z, z, np.zeros((0, width), np.uint64), np.zeros(1, np.int64))
    solid, first = _SOLID[data], np.zeros(n + 1, bool)
    first[places] = True
    begins, ends = solid.copy(), solid.copy()
    begins[1:] &= ~solid[:-1] | first[1:n]
    ends[:-1] &= ~solid[1:] | first[1:n]
    s, e = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    up, down = powers.to(n)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum((_LOWER[data].astype(np.uint64) + np.uint64(1)) * up[:n], out=total[1:])
    size, features = e - s, np.zeros((len(s), width), np.uint64)

    def put(j: int, a: np.ndarray, b: np.ndarray, salt: int) -> None:
        features[:, j] = mix((total[b] - total[a]) * down[a] + np.uint64(salt))

    put(0, s, e, 1)
    for j, k in enumerate(PREFIXES, 1):
        put(j, s, np.minimum(s + k, e), 10 + k)
    for j, k in enumerate(SUFFIXES, 1 + len(PREFIXES)):
        put(j, np.maximum(e - k, s), e, 30 + k)
    # a feature that would be the whole short token again is the whole token
    for j, k in [*enumerate(PREFIXES, 1), *enumerate(SUFFIXES, 1 + len(PREFIXES))]:
        features[size <= k, j] = features[size <= k, 0]
    row = np.searchsorted(places, s, "right") - 1
    line = np.cumsum(data == 10)[s] if len(s) else np.zeros(0, np.int64)
    fresh = np.ones(len(s), bool)
    fresh[1:] = (row[1:] != row[:-1]) | (line[1:] != line[:-1])
    return Tokens(s, e, row, features, np.append(np.flatnonzero(fresh), len(s)))


@dataclass
class Field:
    """Weights of the features, transitions between clean (0) and toxic (1), and the document's logistic.

    A feature is looked up in a table by a part of its hash, and counts only where the rest of it agrees, so that the many unknown features
    of new text do not borrow weights. Trained features that share a slot are kept in order beside the table.
    """

    weights: np.ndarray = field(default_factory=lambda: np.zeros(1 << SLOTS_BITS, np.float32))
    marks: np.ndarray = field(default_factory=lambda: np.zeros(1 << SLOTS_BITS, np.uint32))
    shared: np.ndarray = field(default_factory=lambda: np.zeros(1 << SLOTS_BITS, bool))
    others: np.ndarray = field(default_factory=lambda: np.zeros(0, np.uint64))
    other_weights: np.ndarray = field(default_factory=lambda: np.zeros(0, np.float32))
    bias: float = -6.0
    begin: float = 0.0
    step: np.ndarray = field(default_factory=lambda: np.zeros((2, 2)))
    logistic: tuple[float, float, float] = (-3.0, 0.0, 0.0)

    @staticmethod
    def slots(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return (h >> np.uint64(64 - SLOTS_BITS)).astype(np.int64), (h & np.uint64(0xFFFFFFFF)).astype(np.uint32)

    def learn(self, features: np.ndarray, weights: np.ndarray) -> None:
        """Keep every feature that has a weight; of those that share a slot the first goes into the table, the others beside it."""
        order = np.argsort(features, kind="stable")
        order = order[weights[order] != 0]
        slot, mark = self.slots(features[order])
        first = np.ones(len(order), bool)
        first[1:] = slot[1:] != slot[:-1]  # slots are in order, as they are the hashes' first bits
        self.weights[slot[first]], self.marks[slot[first]] = weights[order[first]], mark[first]
        self.shared[slot[~first]] = True
        self.others, self.other_weights = features[order[~first]], weights[order[~first]].astype(np.float32)

    def emissions(self, features: np.ndarray) -> np.ndarray:
        out = np.full(len(features), self.bias)
        for j in range(features.shape[1]):
            slot, mark = self.slots(features[:, j])
            same = self.marks[slot] == mark
            out += self.weights[slot] * same
            if len(self.others):
                at = np.flatnonzero(self.shared[slot] & ~same)
                near = np.minimum(np.searchsorted(self.others, features[at, j]), len(self.others) - 1)
                out[at] += self.other_weights[near] * (self.others[near] == features[at, j])
        return np.clip(out, -40, 40)


def _chained(first: np.ndarray, steps: np.ndarray, chain: np.ndarray) -> np.ndarray:
    """``x`` of every token: ``first`` at the start of a chain, then ``(a x + b) / (c x + d)`` of the one before; ``steps`` holds a, b, c, d.

    Such steps are 2 x 2 matrices, and a piece's product turns what comes into it into what leaves it. So the pieces' products are
    taken side by side, what enters each piece is handed along its chain, and all pieces are walked at once.
    """
    n, x = np.diff(chain), np.zeros(len(first))
    each = -(-n // PIECE)  # pieces of each chain
    depth = np.arange(each.sum()) - np.repeat(np.cumsum(each) - each, each)
    start = np.repeat(chain[:-1], each) + depth * PIECE
    size = np.minimum(np.repeat(chain[1:], each) - start, PIECE)
    enters = np.zeros(len(start))

    def walk(of: np.ndarray) -> None:
        of = of[np.argsort(-size[of], kind="stable")]
        live = np.searchsorted(-size[of], -np.arange(PIECE), "left")
        for turn in range(int(size[of[0]]) if len(of) else 0):
            which = of[: live[turn]]
            at = start[which] + turn
            before = enters[which] if turn == 0 else x[at - 1]
            a, b, c, d = steps[:, at]
            x[at] = (a * before + b) / (c * before + d)
            if turn == 0:
                fresh = depth[which] == 0
                x[at[fresh]] = first[at[fresh]]

    walk(np.flatnonzero(depth == 0))
    if len(depth) and depth.max() > 0:
        inner = np.flatnonzero((depth > 0) & (np.append(depth[1:], 0) > 0))
        p = np.zeros((4, len(start)))
        q = np.repeat(np.array([[1.0], [0.0], [0.0], [1.0]]), len(inner), axis=1)
        for turn in range(PIECE if len(inner) else 0):
            a, b, c, d = steps[:, start[inner] + turn]
            q = np.stack([a * q[0] + b * q[2], a * q[1] + b * q[3], c * q[0] + d * q[2], c * q[1] + d * q[3]])
            q /= q.max(axis=0)
        p[:, inner] = q
        leaves = np.where(depth == 0, x[start + size - 1], 0.0)
        for d in range(1, int(depth.max()) + 1):
            at = np.flatnonzero(depth == d)
            enters[at] = leaves[at - 1]
            leaves[at] = (p[0, at] * enters[at] + p[1, at]) / np.maximum(p[2, at] * enters[at] + p[3, at], 1e-300)
        walk(np.flatnonzero(depth > 0))
    return x


def forward_backward(e: np.ndarray, chain: np.ndarray, begin: float, step: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per token the log odds of toxic given all of its chain, and the forward and backward log odds.

    ``step[i, j]`` is the log weight of going from label i to j. All chains move together.
    """
    if len(e) == 0:
        return e, e, e
    t, odds, ones = np.exp(step), np.exp(e), np.ones(len(e))
    a = np.log(_chained(odds * np.exp(begin), np.stack([odds * t[1, 1], odds * t[0, 1], ones * t[1, 0], ones * t[0, 0]]), chain))
    # backward is forward over the turned chains, where a token's step has the next token's odds
    following = np.append(1.0, odds[::-1][:-1])
    turned = np.stack([following * t[1, 1], ones * t[1, 0], following * t[0, 1], ones * t[0, 0]])
    b = np.log(_chained(ones, turned, len(e) - chain[::-1]))[::-1]
    return a + b, a, b


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -500, 500)))


def train_field(t: Tokens, y: np.ndarray, rounds: int) -> Field:
    """Maximum likelihood of the labelled tokens by adaptive gradient steps."""
    out = Field()
    if not y.any():
        return out
    _, sample, which = np.unique(t.features[:, 0], return_index=True, return_inverse=True)
    names, of = np.unique(t.features[sample].ravel(), return_inverse=True)
    of = of.reshape(len(sample), -1)  # features of each distinct token
    w, squares = np.zeros(len(names)), np.full(len(names), 1e-8)
    other, other_squares = np.array([-6.0, 0.0, 0.0, 0.0, 0.0, 0.0]), np.full(6, 1e-8)
    inside = np.ones(len(y), bool)
    inside[t.chain[:-1]] = False
    after, firsts = np.flatnonzero(inside), t.chain[:-1]
    for i in range(rounds):
        rate = 0.5 if i < rounds // 2 else 0.15
        step = other[2:].reshape(2, 2)
        e = np.clip(w[of].sum(axis=1) + other[0], -40, 40)[which]
        odds, a, b = forward_backward(e, t.chain, other[1], step)
        miss = _sigmoid(odds) - y
        each = np.bincount(which, miss, minlength=len(sample))
        g = np.bincount(of.ravel(), np.repeat(each, of.shape[1]), minlength=len(names)) + 0.02 * w
        # expected transitions: pair log weights of neighbours, normalised over the four
        left, right = a[after - 1], e[after] + b[after]
        pairs = np.stack([np.zeros(len(after)) + step[0, 0], right + step[0, 1], left + step[1, 0], left + right + step[1, 1]])
        pairs = np.exp(pairs - pairs.max(axis=0))
        expected = (pairs / pairs.sum(axis=0)).sum(axis=1)
        seen = np.bincount(2 * y[after - 1].astype(int) + y[after].astype(int), minlength=4)
        rest = np.concatenate([[miss.sum(), miss[firsts].sum()], expected - seen]) / 50
        squares += g * g
        other_squares += rest * rest
        w = w - rate * g / np.sqrt(squares)
        other = other - rate * rest / np.sqrt(other_squares)
    out.learn(names, w)
    out.bias, out.begin, out.step = float(other[0]), float(other[1]), other[2:].reshape(2, 2)
    return out


def _parts(texts: list[str], most: int = 1_000_000) -> Iterator[tuple[int, pa.Array]]:
    """The texts in parts of about ``most`` characters, each with the place of its first; fitting holds one at a time."""
    start = held = 0
    for i, t in enumerate(texts):
        if held and held + len(t) > most:
            yield start, pa.array(texts[start:i], pa.string())
            start, held = i, 0
        held += len(t)
    if start < len(texts):
        yield start, pa.array(texts[start:], pa.string())


def _signs(texts: list[str], toxic: np.ndarray, chance: float) -> np.ndarray:
    """Features that are toxic documents' own, beyond chance, sorted; only features of three documents or more are looked at."""
    n_docs, n_toxic = len(toxic), int(toxic.sum())
    none = np.zeros(0, np.uint64)
    if not n_toxic or n_toxic == n_docs:
        return none
    powers, names, both, bad = Powers(), none, np.zeros(0, np.int32), np.zeros(0, np.int32)
    for start, part in _parts(texts):
        t = tokens(part, powers)
        at = np.searchsorted(t.row, np.arange(len(part) + 1))
        seen = [np.unique(t.features[i:j]) for i, j in zip(at[:-1], at[1:], strict=True)]
        marks = np.repeat(toxic[start : start + len(part)], [len(x) for x in seen])
        merged, of = np.unique(np.concatenate([names, *seen]), return_inverse=True)
        both = np.bincount(of, np.concatenate([both, np.ones(len(marks), np.int32)]), len(merged)).astype(np.int32)
        bad = np.bincount(of, np.concatenate([bad, marks.astype(np.int32)]), len(merged)).astype(np.int32)
        names = merged
    often = both >= 3
    names, both, bad = names[often], both[often], bad[often]
    share, base = bad / both, n_toxic / n_docs
    p = np.clip(share, 1e-9, 1 - 1e-9)
    gain = both * (p * np.log(p / base) + (1 - p) * np.log((1 - p) / (1 - base)))
    # about ``chance`` features in all may pass by luck
    return names[(share >= max(0.9, 1 - (1 - base) / 10)) & (gain >= np.log(max(1, len(names)) / chance))]


def _document_inputs(odds: np.ndarray, row: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    most = np.full(n, -30.0)
    np.maximum.at(most, row, np.clip(odds, -30, 30))
    return most, np.log1p(np.bincount(row, _sigmoid(odds), minlength=n))


def _apart(texts: list[str], looks: int = 8, alike: int = 3) -> np.ndarray:
    """Which texts are not near copies of an earlier one, whose every word would look like a sign."""
    powers, first, keep = Powers(), {}, np.ones(len(texts), bool)
    for start, part in _parts(texts):
        h, bounds, _, _ = words(part, powers)
        grams, at = shingles(h, bounds)
        for i in range(len(part)):
            own = grams[at[i] : at[i + 1]]
            if not len(own):
                continue
            least = [(k, int(mix(own + np.uint64(k)).min())) for k in range(looks)]
            met = Counter(first[x] for x in least if x in first)
            if met and max(met.values()) >= alike:
                keep[start + i] = False
            else:
                for x in least:
                    first.setdefault(x, start + i)
    return keep


def fit(rows: list[tuple[str, int]], share: float, how: Training = Training()) -> Field:
    """A field from labelled texts; ``share`` is the true share of toxic labels."""
    rows = [r for r, k in zip(rows, _apart([x for x, _ in rows]), strict=True) if k]
    if not rows:
        return Field()
    powers, texts = Powers(), [x for x, _ in rows]
    toxic = np.array([y == 1 for _, y in rows])
    signs = _signs(texts, toxic, how.chance)
    # toxic and clean documents in turn, as long as the tokens last
    order = np.argsort(np.where(toxic, np.cumsum(toxic), np.cumsum(~toxic)), kind="stable")
    size = np.array([len(x) // 6 for x in texts])
    used = order[np.cumsum(size[order]) <= how.crf_tokens]
    small = tokens(pa.array([texts[i] for i in used], pa.string()), Powers())
    y = toxic[used][small.row]
    y[y] = np.isin(small.features[y], signs).any(axis=1)
    out = train_field(small, y, how.rounds)
    del small
    most, count = np.zeros(len(rows)), np.zeros(len(rows))
    for start, part in _parts(texts):
        t = tokens(part, powers)
        odds, _, _ = forward_backward(out.emissions(t.features), t.chain, out.begin, out.step)
        most[start : start + len(part)], count[start : start + len(part)] = _document_inputs(odds, t.row, len(part))
    share = min(max(share, 1e-4), 1 - 1e-4)
    weight = np.where(toxic, share / max(toxic.mean(), 1e-9), (1 - share) / max(1 - toxic.mean(), 1e-9))
    x = np.stack([np.ones(len(rows)), most / 10, count], axis=1)
    b = np.array([np.log(share / (1 - share)), 0.0, 0.0])
    for _ in range(50):
        p = _sigmoid(x @ b)
        h = (x * (weight * p * (1 - p))[:, None]).T @ x + 0.5 * np.eye(3)
        b = b + np.linalg.solve(h, x.T @ (weight * (toxic - p)) - 0.5 * np.array([0.0, b[1], b[2]]))
    out.logistic = (float(b[0]), float(b[1]), float(b[2]))
    return out


def training_rows(docs: DataFrame, labels: DataFrame, how: Training = Training()) -> tuple[list[tuple[str, int]], float]:
    """The bounded training sample, by hash order of ids, from labels outside the held-out quarter; and the toxic share."""
    known = labels.where("doc_id is not null and toxic is not null").groupBy(F.col("doc_id").cast("long").alias("id")).agg(F.max("toxic").cast("int").alias("toxic"))
    known = cut(known.where(F.crc32(F.col("id").cast("string")) % 4 != 2).where("toxic in (0, 1)"))
    n, bad = known.agg(F.count("*"), F.coalesce(F.sum("toxic"), F.lit(0))).first()
    by = F.xxhash64("id", F.lit(3))
    sample = known.where("toxic = 1").orderBy(by, "id").limit(how.toxic_docs).union(known.where("toxic = 0").orderBy(by, "id").limit(how.clean_docs))
    texts = docs.select(F.col("doc_id").cast("long").alias("id"), F.col("text").cast("string").alias("text")).where(F.length("text") <= how.doc_chars)
    # rows that share an id may outnumber the sample: one of each is enough
    rows = texts.join(F.broadcast(sample), "id").groupBy("id").agg(F.max("text").alias("text"), F.max("toxic").alias("toxic")).orderBy("id").toArrow()
    return list(zip(rows.column("text").to_pylist(), rows.column("toxic").to_pylist(), strict=True)), bad / n if n else 0.0


def score(docs: DataFrame, model: Field, span_odds: float = 0.0) -> DataFrame:
    """``(doc_id, score, spans)``: spans are ``(start, end)`` byte offsets in UTF-8 of runs of tokens likelier toxic than not."""

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = Powers()
        b0, b1, b2 = model.logistic
        for batch in pieces(batches):
            t = tokens(batch.column("text"), powers)
            _, places = text_bytes(batch.column("text"))
            odds, _, _ = forward_backward(model.emissions(t.features), t.chain, model.begin, model.step)
            most, count = _document_inputs(odds, t.row, batch.num_rows)
            spans: list[list[dict]] = [[] for _ in range(batch.num_rows)]
            last = -2
            for i in np.flatnonzero(odds > span_odds):
                of, place = spans[t.row[i]], places[t.row[i]]
                if i == last + 1 and of and t.row[i] == t.row[last]:
                    of[-1]["end"] = int(t.ends[i] - place)
                else:
                    of.append({"start": int(t.starts[i] - place), "end": int(t.ends[i] - place)})
                last = i
            kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(_sigmoid(b0 + b1 * most / 10 + b2 * count)), pa.array(spans, kind)], ["doc_id", "score", "spans"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"))
    return rows.mapInArrow(scored, "doc_id long, score double, spans array<struct<start: long, end: long>>")


def toxicity(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, how: Training = Training()) -> DataFrame:
    """``docs(doc_id, text, ...)``, ``labels(doc_id, toxic)`` -> ``(doc_id, held_out, score, predicted, spans)``, a row for each input row.

    A null or empty text has no tokens and gets the score of a document without any sign. Without usable labels
    every score is the same low value. Null labels are ignored, the highest counts where there are several;
    only ids whose crc32 modulo 4 is not 2 are ever learned from. A null doc_id is not held out. Repeated rows are scored each, and equal
    texts score alike; of rows that share a labelled id one is learned from. Texts are scored whole, however long. An empty table gives
    an empty table. Extra columns are not read.
    """
    rows, share = training_rows(docs, labels, how)
    out = score(docs, fit(rows, share, how))
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))
    return out.select("doc_id", held.alias("held_out"), "score", F.when(F.col("score") >= threshold, 1).otherwise(0).alias("predicted"), "spans")
