"""Personal data by weak supervision: base patterns, candidates that labelers vote on, a label model and a span classifier.

Base spans follow four fixed patterns (``base_spans``) and always stay. The patterns take the longest match and try none
again, so a number next to another one, a phone without its ``+`` or an address in words is missed. Such places become *candidates*, and so
do the base spans and the matches that failed, by which the labelers are judged. Labelers look at different things and vote for, against or not
at all: regular forms, checks (Luhn digits, ranges, digit counts), gazetteers (issuer prefixes, calling codes, top-level domains, reserved
networks), cue words before the span, its boundaries, and the numbers around it.

How often each pattern of votes occurs is counted over all documents; kinds times patterns is a number that does not grow with the
input. Expectation-maximisation estimates from these counts how reliable each labeler is on true and on false candidates, and so
how likely a pattern is true. A logistic classifier over features of the span is then fitted to these chances on a bounded sample
(``Training``), scores every candidate, and adds what it takes for likelier true than not, where no base span lies.

Texts are read once, map only; one narrow row a document is stored. No row is shuffled but the sums of vote patterns.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, pieces, text_of

KINDS = ("email", "ip", "card", "phone")
EMAIL, IP, CARD, PHONE = range(4)
LABELERS = ("form", "check", "gazetteer", "cue", "boundary", "neighbours")
#: Hashed features of the span classifier.
SLOTS = 1 << 14
#: Digit runs that a candidate may span.
MOST_RUNS = 8

# Gazetteers and cue words.
CALLING = frozenset("1 7 20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 60 61 62 63 64 65 66 81 82 84 86 90 91 92 93 94 95 98 211 212 213 216 218 234 254 255 351 352 353 354 358 359 370 371 372 380 385 386 420 421 852 880 886 961 962 965 966 971 972".split())
DOMAINS = frozenset("com org net edu gov mil int info biz io dev app eu uk de fr es it nl be ch at pl se no dk fi pt ie ru cn jp kr in br mx ar ca us au nz za example test".split())
ISSUERS = re.compile(r"4|5[1-5]|2[2-7]|3[47]|36|38|6011|64|65|35|62|50|5[6-8]")
CUES = {
    EMAIL: frozenset("mail email e contact kontakt contacto correo courriel write address adresse reach".split()),
    IP: frozenset("ip host server address adresse from login client addr ipv4".split()),
    CARD: frozenset("card cards visa mastercard amex karte kreditkarte carte tarjeta pay paid payment credit debit".split()),
    PHONE: frozenset("tel phone telephone call fax mobile cell telefon handy telefono ruf whatsapp".split()),
}
OTHER_CUES = frozenset("version ver isbn issn id no nr order ref token hash page chapter section figure table row total key sha md5".split())
FORMS = {
    EMAIL: re.compile(rb"[A-Za-z0-9._%+-]*[A-Za-z][A-Za-z0-9._%+-]*(?:@|\W+at\W+)[A-Za-z0-9-]+(?:(?:\.|\W+dot\W+)[A-Za-z0-9-]+)*(?:\.|\W+dot\W+)[A-Za-z]{2,24}", re.I),
    IP: re.compile(rb"(?:0|[1-9][0-9]{0,2})(?:\.(?:0|[1-9][0-9]{0,2})){3}"),
    CARD: re.compile(rb"[0-9]{13,19}|[0-9]{4}([ -])[0-9]{4}\1[0-9]{4}\1[0-9]{1,7}|[0-9]{4}([ -])[0-9]{6}\2[0-9]{4,5}"),
    PHONE: re.compile(rb"\+[0-9]{1,3}[ .-]?(?:\([0-9]{1,4}\)[ .-]?)?[0-9]{2,4}(?:[ .-]?[0-9]{2,4}){1,4}|\([0-9]{2,4}\) ?[0-9]{3,4}[ .-]?[0-9]{3,4}|[0-9]{3}([ .-])[0-9]{3}\1[0-9]{4}"),
}
_AT = re.compile(rb"(?<![A-Za-z0-9])at(?![A-Za-z0-9])", re.I)
_BEFORE_AT = re.compile(rb"([A-Za-z0-9._%+-]{1,64}) ?[\[({<]? ?\Z")
_AFTER_AT = re.compile(rb" ?[\])}>]? ?[A-Za-z0-9-]{1,63}(?: ?[\[({<]? ?(?:\.|\bdot\b) ?[\])}>]? ?[A-Za-z0-9-]{1,63}){1,6}", re.I)
_DOMAIN = re.compile(rb"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")


def _marks(chars: str) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(chars.encode())] = True
    return out


_NUM = "0123456789"
_ALNUM = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz" + _NUM
_DIGIT, _LOCAL, _HOST, _PHONE, _FIELD, _WORD = map(_marks, (_NUM, _ALNUM + "._%+-", _ALNUM + "-.", _NUM + " ().-", _NUM + " ().+-", _ALNUM + "_@"))
_WORD[0x80:] = True


@dataclass(frozen=True)
class Training:
    """Candidates that the span classifier is fitted to, by hash order; the label model counts all."""

    candidates: int = 20_000
    rounds: int = 40
    threshold: float = 0.5


class Span(NamedTuple):
    start: int  # bytes of the buffer
    end: int
    kind: int


class Buffer:
    """Texts one after the other, a line feed after each: none of the patterns crosses one."""

    def __init__(self, texts: list[bytes]) -> None:
        self.raw = b"\n".join([*texts, b""])
        self.data = np.frombuffer(self.raw, np.uint8)
        self.begins = np.concatenate([[0], np.cumsum([len(t) + 1 for t in texts])]).astype(np.int64)
        self.points = np.concatenate([[0], np.cumsum((self.data & 0xC0) != 0x80)])
        digit = _DIGIT[self.data]
        self.digits = np.flatnonzero(digit)
        edge = np.diff(np.concatenate([[0], digit.view(np.int8), [0]]))
        self.runs, self.run_ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)

    def chains(self, between: bytes) -> Iterator[tuple[int, int]]:
        """Maximal sequences of digit runs, first and last and one more, with a single one of these characters between them."""
        if not len(self.runs):
            return
        joined = (self.run_ends[:-1] + 1 == self.runs[1:]) & np.isin(self.data[self.run_ends[:-1]], list(between))
        firsts = np.concatenate([[0], np.flatnonzero(~joined) + 1, [len(self.runs)]])
        yield from zip(firsts[:-1].tolist(), firsts[1:].tolist(), strict=True)

    def fields(self, mark: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bounds of the maximal runs of marked characters."""
        edge = np.diff(np.concatenate([[0], mark[self.data].view(np.int8), [0]]))
        return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)

    def number(self, start: int, end: int) -> bytes:
        return bytes(c for c in self.raw[start:end] if 0x30 <= c <= 0x39)


def luhn(number: bytes) -> bool:
    total = 0
    for i, c in enumerate(reversed(number)):
        d = (c - 48) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def _octets(parts: list[bytes]) -> bool:
    return all(len(p := x.lstrip(b"0")) <= 3 and int(p or b"0") <= 255 for x in parts)


def base_spans(b: Buffer) -> tuple[list[Span], list[Span]]:
    """Spans of the four patterns that hold, and matches that failed their check."""
    good: list[Span] = []
    failed: list[Span] = []
    last = 0
    lows, highs = b.fields(_LOCAL)
    for at in np.flatnonzero(b.data == 0x40).tolist():
        k = int(np.searchsorted(highs, at))  # the run of local characters that ends at the @
        start = max(int(lows[k]), last) if k < len(highs) and highs[k] == at else at
        if start < at and (m := _DOMAIN.match(b.raw, at + 1)):
            good.append(Span(start, m.end(), EMAIL))
            last = m.end()
    for i, j in b.chains(b"."):
        for k in range(i, j - 3, 4):
            s, e = int(b.runs[k]), int(b.run_ends[k + 3])
            (good if _octets(b.raw[s:e].split(b".")) else failed).append(Span(s, e, IP))
    for i, j in b.chains(b" -"):
        size = int((b.run_ends[i:j] - b.runs[i:j]).sum())
        if size >= 12:
            s, e = int(b.runs[i]), int(b.run_ends[j - 1])
            (good if size <= 19 and luhn(b.number(s, e)) else failed).append(Span(s, e, CARD))
    lows, highs = b.fields(_PHONE)
    for at in np.flatnonzero(b.data == 0x2B).tolist():
        if at + 1 < len(b.data) and _DIGIT[b.data[at + 1]]:
            end = int(highs[np.searchsorted(lows, at + 1, "right") - 1])
            q = int(b.digits[np.searchsorted(b.digits, end) - 1])
            if q >= at + 3:
                n = int(np.searchsorted(b.digits, q, "right") - np.searchsorted(b.digits, at))
                (good if 9 <= n <= 15 else failed).append(Span(at, q + 1, PHONE))
    return good, failed


def _number_candidates(b: Buffer) -> Iterator[Span]:
    """Sequences of up to ``MOST_RUNS`` digit runs of a field that may be a card or a phone."""
    lows, highs = b.fields(_FIELD)
    firsts, lasts = np.searchsorted(b.runs, lows), np.searchsorted(b.runs, highs)
    size = np.concatenate([[0], np.cumsum(b.run_ends - b.runs)])
    for i, j in zip(firsts.tolist(), lasts.tolist(), strict=True):
        if size[j] - size[i] < 9:
            continue
        for k in range(i, j):
            for m in range(k, min(j, k + MOST_RUNS)):
                n = int(size[m + 1] - size[k])
                if n > 19:
                    break
                s, e = int(b.runs[k]), int(b.run_ends[m])
                if n >= 13 and (m == k or FORMS[CARD].fullmatch(b.raw, s, e)):
                    yield Span(s, e, CARD)
                if 9 <= n <= 15:
                    before = b.raw[s - 1 : s] if s else b""
                    if before == b"+" or (before == b"(" and b")" in b.raw[s:e]):
                        yield Span(s - 1, e, PHONE)
                    elif m > k and FORMS[PHONE].fullmatch(b.raw, s, e):
                        yield Span(s, e, PHONE)


def _address_candidates(b: Buffer) -> Iterator[Span]:
    """Addresses in words: ``name [at] host dot tld``."""
    for m in _AT.finditer(b.raw):
        if b"dot" not in (ahead := b.raw[m.end() : m.end() + 200]).lower():
            continue
        left = _BEFORE_AT.search(b.raw, max(0, m.start() - 70), m.start())
        right = _AFTER_AT.match(ahead)
        if left and right:
            yield Span(left.start(1), m.end() + right.end(), EMAIL)


def candidates(b: Buffer, good: list[Span], failed: list[Span]) -> list[tuple[Span, bool]]:
    """Base spans, and whatever else may be one and does not touch them."""
    taken = np.array(sorted((s.start, s.end) for s in good) or np.zeros((0, 2)), np.int64)
    reach = np.maximum.accumulate(taken[:, 1]) if len(taken) else taken[:, 0]
    out = [(s, True) for s in good]
    for s in sorted({*failed, *_number_candidates(b), *_address_candidates(b)}):
        k = int(np.searchsorted(taken[:, 0], s.end))  # base spans that start before it ends
        if (k == 0 or reach[k - 1] <= s.start) and s.end - s.start <= 200:
            out.append((s, False))
    return out


def votes(b: Buffer, s: Span) -> tuple[int, ...]:
    """What each labeler says of a candidate: 1 for, -1 against, 0 nothing."""
    raw, number = b.raw[s.start : s.end], b.number(s.start, s.end)
    form = 1 if FORMS[s.kind].fullmatch(raw) else -1
    if s.kind == CARD:
        check = 1 if 12 <= len(number) <= 19 and luhn(number) else -1
        known = 1 if ISSUERS.match(number.decode()) else -1
    elif s.kind == PHONE:
        check = 1 if 10 <= len(number) <= 13 else 0 if 9 <= len(number) <= 15 else -1
        known = 0 if raw[:1] != b"+" else 1 if any(number[:n].decode() in CALLING for n in (1, 2, 3)) else -1
    elif s.kind == IP:
        parts = raw.split(b".")
        check = 1 if _octets(parts) else -1
        first = int(parts[0][:4])
        known = -1 if first == 0 or first >= 240 else 1
    else:
        last = re.split(rb"\W+", raw)[-1].lower().decode()
        check = 1 if last.isalpha() and len(last) > 1 else -1
        known = 1 if last in DOMAINS else 0
    cues = set(re.findall(r"[a-z]+", b.raw[max(0, s.start - 40) : s.start].rpartition(b"\n")[2].decode("latin-1").lower()))
    cue = 1 if cues & CUES[s.kind] else -1 if cues & OTHER_CUES else 0
    left, right = (b.data[s.start - 1] if s.start else 10), b.data[s.end]
    boundary = -1 if _WORD[left] or _WORD[right] or (right == 0x2E and _DIGIT[b.data[min(s.end + 1, len(b.data) - 1)]]) else 1
    around = _field_digits(b, s)
    neighbours = 1 if around == 0 else 0 if around <= 20 else -1
    return form, check, known, cue, boundary, neighbours


def _field_digits(b: Buffer, s: Span) -> int:
    """Digits beside the candidate in an unbroken field around it, as far as 40 characters away."""
    left, right = b.raw[max(0, s.start - 40) : s.start], b.raw[s.end : s.end + 40]
    near = re.search(rb"[0-9 ().+-]*\Z", left)[0] + re.match(rb"[0-9 ().+-]*", right)[0]
    return sum(0x30 <= c <= 0x39 for c in near)


def features(b: Buffer, s: Span, said: tuple[int, ...]) -> list[int]:
    """Hashed features of a candidate: its shape, its size, what stands beside it."""
    raw = b.raw[s.start : s.end]
    shape = re.sub(rb"[a-z]+", b"a", re.sub(rb"[A-Z]+", b"A", re.sub(rb"[0-9]", b"9", raw)))
    side = lambda c: "w" if _WORD[c] else chr(c) if c < 128 else "-"
    word = re.search(rb"([A-Za-z]{2,20})[^A-Za-z\n]{0,6}\Z", b.raw[max(0, s.start - 40) : s.start])
    named = [f"shape {shape.decode('latin-1')[:40]}", f"digits {len(b.number(s.start, s.end))}", f"left {side(b.data[s.start - 1] if s.start else 10)}", f"right {side(b.data[s.end])}", f"word {word[1].decode().lower() if word else ''}", f"around {min(_field_digits(b, s), 24) // 8}", f"begins {raw[:1].decode('latin-1')}", "kind"]
    named += [f"{n} {v}" for n, v in zip(LABELERS, said, strict=True) if n in ("form", "check", "gazetteer", "boundary")]
    return [zlib.crc32(f"{s.kind} {x}".encode()) % SLOTS for x in named]


_CANDIDATE = pa.struct([("kind", pa.int32()), ("start", pa.int64()), ("end", pa.int64()), ("base", pa.bool_()), ("votes", pa.list_(pa.int32())), ("features", pa.list_(pa.int32()))])
_FOUND = "doc_id long, found array<struct<kind: int, start: long, end: long, base: boolean, votes: array<int>, features: array<int>>>"


def _found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in pieces(batches):
        b = Buffer([t.encode() for t in batch.column("text").to_pylist()])
        rows: list[list[dict]] = [[] for _ in range(batch.num_rows)]
        for s, base in candidates(b, *base_spans(b)):
            row = int(np.searchsorted(b.begins, s.start, "right")) - 1
            said = votes(b, s)
            at = b.points[b.begins[row]]
            rows[row].append({"kind": s.kind, "start": int(b.points[s.start] - at), "end": int(b.points[s.end] - at), "base": base, "votes": said, "features": features(b, s, said)})
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(rows, pa.list_(_CANDIDATE))], ["doc_id", "found"])


def label_model(patterns: list[tuple[tuple[int, ...], int]], rounds: int = 40, prior: float = 20.0) -> dict[tuple[int, ...], float]:
    """The chance that each pattern of votes is true, from ``(votes, how many)`` of one kind, by expectation-maximisation.

    Labelers are independent given the truth. ``prior`` candidates' worth of belief says that a labeler is right more often than wrong,
    and no labeler may speak for the false more often than for the true. What fails its check cannot be true: it is false in every
    round, and so shows how the other labelers vote on what only looks right.
    """
    if not patterns:
        return {}
    v, n = np.array([p for p, _ in patterns]), np.array([c for _, c in patterns], float)
    said = np.stack([v == -1, v == 0, v == 1], axis=2).astype(float)  # patterns x labelers x what
    believed = prior * np.array([[0.6, 0.3, 0.1], [0.1, 0.3, 0.6]])
    possible = v[:, LABELERS.index("check")] >= 0
    p = possible / (1 + np.exp(-1.5 * v.sum(axis=1)))
    for _ in range(rounds):
        seen = np.stack([np.einsum("p,plw->lw", n * (1 - p), said), np.einsum("p,plw->lw", n * p, said)]) + believed[:, None, :]
        rate = seen / seen.sum(axis=2, keepdims=True)
        wrong = rate[0, :, 2] > rate[1, :, 2]
        rate[:, wrong] = rate[:, wrong].mean(axis=0)
        share = ((n * p).sum() + 1) / (n.sum() + 2)
        log = np.einsum("plw,ylw->py", said, np.log(rate)) + np.log([1 - share, share])
        p = possible / (1 + np.exp(np.clip(log[:, 0] - log[:, 1], -500, 500)))
    return {tuple(map(int, x)): float(y) for x, y in zip(v, p, strict=True)}


def fit_classifier(rows: list[tuple[list[int], float]], rounds: int = 40) -> np.ndarray:
    """Weights of a logistic classifier over hashed features, fitted to chances."""
    w = np.zeros(SLOTS)
    if not rows:
        return w
    x, y = np.array([f for f, _ in rows]), np.array([p for _, p in rows])
    squares = np.full(SLOTS, 1e-8)
    for i in range(4 * rounds):
        miss = 1 / (1 + np.exp(-np.clip(w[x].sum(axis=1), -50, 50))) - y
        g = np.bincount(x.ravel(), np.repeat(miss, x.shape[1]), minlength=SLOTS) + 0.01 * w
        squares += g * g
        w -= (0.5 if i < 2 * rounds else 0.1) * g / np.sqrt(squares)
    return w


def fit(found: DataFrame, how: Training = Training()) -> np.ndarray:
    """The span classifier, from the candidates of all documents (``found`` of ``_found``)."""
    each = found.select("doc_id", F.explode("found").alias("x")).select("doc_id", "x.*")
    counts: dict[int, list] = {}
    for r in each.groupBy("kind", "votes").agg(F.count("*").alias("n")).collect():  # kinds times patterns at most
        counts.setdefault(r.kind, []).append((tuple(r.votes), r.n))
    chances = {kind: label_model(sorted(x), how.rounds) for kind, x in counts.items()}
    sample = each.select("kind", "votes", "features", F.xxhash64("doc_id", "kind", "start").alias("at")).orderBy("at", "kind", "votes", "features").limit(how.candidates).collect()
    return fit_classifier([(r.features, chances[r.kind][tuple(r.votes)]) for r in sample], how.rounds)


def find_private(docs: DataFrame, how: Training = Training()) -> DataFrame:
    """``docs(doc_id, text, ...)`` -> ``(doc_id, spans)``, a row for each input row; ``spans`` are ``(kind, start, end, base, score)`` by start.

    Offsets are code points of the whole text, the end exclusive. Base spans have ``base`` and the score 1, though they may overlap where
    their kinds differ; an added span overlaps no other and its score is over ``how.threshold``. A null or empty text has none. Equal texts
    have equal spans; ids may be null or repeated. Extra columns are not read; an empty table gives an empty table.
    """
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"))
    found = cut(texts.mapInArrow(_found, _FOUND))
    weights = fit(found, how)

    def chosen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("base", pa.bool_()), ("score", pa.float64())]))
        for batch in batches:
            rows = [_chosen(x, weights, how.threshold) if x else [] for x in batch.column("found").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(rows, kind)], ["doc_id", "spans"])

    return found.mapInArrow(chosen, "doc_id long, spans array<struct<kind: string, start: long, end: long, base: boolean, score: double>>")


def _chosen(found: list[dict], weights: np.ndarray, threshold: float) -> list[dict]:
    """Base spans and the likeliest of the others that overlap nothing."""
    out = [{"score": 1.0} | x for x in found if x["base"]]
    likely = []
    for x in found:
        score = 1.0 if x["base"] else float(1 / (1 + np.exp(-np.clip(weights[x["features"]].sum(), -50, 50))))
        if not x["base"] and score > threshold:
            likely.append({"score": score} | x)
    covered: set[int] = set()
    for x in sorted(likely, key=lambda x: (-(x["end"] - x["start"]), -x["score"], x["start"], x["kind"])):
        own = range(x["start"], x["end"])
        if covered.isdisjoint(own):
            covered.update(own)
            out.append(x)
    return [{"kind": KINDS[x["kind"]], "start": x["start"], "end": x["end"], "base": x["base"], "score": x["score"]} for x in sorted(out, key=lambda x: (x["start"], x["kind"], x["end"]))]


def span_digests(spans: DataFrame) -> DataFrame:
    """``(doc_id, spans)`` -> the counts of base spans by kind, the digest of all base spans, and all spans as a string."""
    base = F.filter("spans", lambda x: x["base"])
    text = lambda xs: F.array_join(F.transform(xs, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")
    count = lambda kind: F.size(F.filter("spans", lambda x: x["base"] & (x["kind"] == kind))).cast("long").alias(f"n_{kind}")
    return spans.select("doc_id", *map(count, KINDS), F.sha2(text(base), 256).alias("base_sha256"), text(F.col("spans")).alias("spans"))
