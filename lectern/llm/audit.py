"""Filter interaction audit: what every order of the filters would keep, remove and lose, from 32 joint-failure counts.

A document's failures are flags. For each set S of filters the documents that fail all of S are counted, that is, the sum of the
product of the flags in S; this is the only pass over documents, and all else follows from these counts of a part:

* Möbius inversion gives the documents that fail none of a set P (survivors: the sum over S within P of (-1)^|S| J(S)), those that fail
  f but none of P (removed at f after P) and those that fail f alone.
* A set removes the union of its filters' failures, so its Harsanyi dividends are (-1)^(|S|+1) J(S), and a filter's Shapley value shares each
  dividend evenly among S. Times the number of orders this is what the filter removes summed over all orders, a whole number.

Flags of a text come from one vectorised pass over whole texts. A text is known by 128 bits of its SHA-256; the smallest id of each is
found by a grouping, and rows of texts that hold a large share of all rows meet it by broadcast (``join_counted``). Rows are added up by id
before they meet labels, and by part and set before the last shuffle, so neither copies, repeated rows nor a large part heat a task.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import permutations
from math import factorial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, join_counted, pieces, text_of
from .textvec import Powers, text_bytes, words

FILTERS = "ABCDE"
SYMBOLS = "#$%&*|"
_UPPER, _SIGN = np.zeros(256, bool), np.zeros(256, bool)
_UPPER[0x41:0x5B] = True
_SIGN[list(SYMBOLS.encode())] = True


@dataclass(frozen=True)
class Limits:
    """Production limits: A fewer words, B a smaller share of distinct words, C a larger share of A-Z."""

    least_words: int = 100
    least_distinct_percent: int = 80
    most_upper_percent: int = 10


def _measured(batches: Iterator[pa.RecordBatch], limits: Limits) -> Iterator[pa.RecordBatch]:
    powers = Powers()
    for batch in pieces(batches):
        text = batch.column("text")
        h, bounds, _, _ = words(text, powers, lower=False)
        data, places = text_bytes(text)

        def count(mark: np.ndarray, places: np.ndarray = places) -> np.ndarray:
            upto = np.concatenate([[0], np.cumsum(mark)])
            return upto[places[1:]] - upto[places[:-1]]

        n = np.diff(bounds)
        distinct = np.array([len(np.unique(h[a:b])) for a, b in zip(bounds[:-1], bounds[1:], strict=True)], np.int64)
        fails = (
            n < limits.least_words,
            100 * distinct < limits.least_distinct_percent * n,
            100 * count(_UPPER[data]) > limits.most_upper_percent * count((data & 0xC0) != 0x80),
            count(_SIGN[data]) > 0,
        )
        mask = sum(x.astype(np.int32) << i for i, x in enumerate(fails))
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("part"), batch.column("key"), pa.array(mask, pa.int32())], ["doc_id", "part", "key", "mask"])


def failures(docs: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """``docs(doc_id, text, lang, ...)`` -> ``(doc_id, part, mask)``, a row for each input row; bit i of the mask is set if it fails filter i.

    A null text is empty and equal to other empty texts, a null lang is the empty part. A row without doc_id is no later copy, nor
    does it make others so; of rows with one id and text none is a copy of another.
    """
    key = F.substring(F.unhex(F.sha2(F.col("text").cast("binary"), 256)), 1, 16)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("part"), text_of().alias("text"))
    rows = cut(texts.select("*", key.alias("key")).mapInArrow(lambda batches: _measured(batches, limits), "doc_id long, part string, key binary, mask int"))
    firsts = cut(rows.groupBy("key").agg(F.count("*").alias("n"), F.min("doc_id").alias("first")))
    later = F.coalesce(F.col("doc_id") > F.col("first"), F.lit(False)).cast("int") * 16
    return join_counted(rows, firsts, ["key"]).select("doc_id", "part", (F.col("mask") + later).alias("mask"))


def joint_failures(fails: DataFrame, labels: DataFrame, filters: str = FILTERS) -> DataFrame:
    """``fails(doc_id, part, mask)``, ``labels(doc_id, quality, toxic)`` -> ``(part, set, docs, good, toxic)``: rows that fail every filter of the set.

    The empty set counts all rows of a part; sets that nothing fails together have no row. An id that is labelled more than once is good, or
    toxic, if any of its labels says so.
    """
    flags = [F.coalesce(F.max((F.col(c) == 1).cast("long")), F.lit(0)).alias(c) for c in ("quality", "toxic")]
    known = labels.where("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(*flags)
    rows = fails.groupBy("doc_id", "part", "mask").agg(F.count("*").alias("docs")).join(known, "doc_id", "left")
    # the product of the flags of a set is 1 for the sets within the mask
    within = F.array(*[F.array(*[F.lit(s) for s in range(m + 1) if s & m == s]) for m in range(1 << len(filters))])
    each = rows.select("part", "docs", *[(F.col("docs") * F.coalesce(c, F.lit(0))).alias(n) for c, n in (("quality", "good"), ("toxic", "toxic"))], F.explode(within[F.col("mask")]).alias("set"))
    return each.groupBy("part", "set").agg(*[F.sum(c).alias(c) for c in ("docs", "good", "toxic")])


def _sign(s: Column) -> Column:
    return 1 - 2 * (F.bit_count(s) % 2)


def _inverted(counts: Column, within: Column, also: Column, n: int) -> Column:
    """Rows that fail all of ``also`` and none of ``within``, from the joint counts of all sets."""
    term = lambda s: F.when(s.bitwiseAND(F.bitwise_not(within)) == 0, _sign(s) * F.element_at(counts, s.bitwiseOR(also) + 1)).otherwise(0)
    return F.aggregate(F.sequence(F.lit(0), F.lit((1 << n) - 1)), F.lit(0).cast("long"), lambda acc, s: acc + term(s))


def interactions(joint: DataFrame, filters: str = FILTERS) -> DataFrame:
    """``joint(part, set, docs, good, toxic)`` -> a row for each part, order of the filters and step of it."""
    n = len(filters)
    held = F.map_from_entries(F.collect_list(F.struct("set", F.struct("docs", "good", "toxic"))))
    every = F.sequence(F.lit(0), F.lit((1 << n) - 1))
    parts = joint.groupBy("part").agg(held.alias("held"))
    filled = lambda c: F.transform(every, lambda s: F.coalesce(F.try_element_at("held", s)[c], F.lit(0))).alias(c)
    parts = parts.select("part", *map(filled, ("docs", "good", "toxic")))
    orders = F.array(*[F.lit("".join(p)) for p in permutations(filters)])
    rows = parts.select("*", F.explode(orders).alias("filter_order")).select("*", F.explode(F.sequence(F.lit(1), F.lit(n))).alias("step"))
    bit = lambda i: F.call_function("shiftleft", F.lit(1), F.instr(F.lit(filters), F.col("filter_order").substr(i, F.lit(1))) - 1)
    before = F.aggregate(F.sequence(F.lit(1), F.lit(n)), F.lit(0), lambda acc, i: acc.bitwiseOR(F.when(i < F.col("step"), bit(i)).otherwise(0)))
    rows = rows.select("*", bit(F.col("step")).alias("own"), before.alias("before"))
    own, none = F.col("own"), F.lit(0)
    others = F.lit((1 << n) - 1).bitwiseXOR(own)
    share = lambda s: F.when(s.bitwiseAND(own) != 0, -_sign(s) * (F.lit(factorial(n)) / F.greatest(F.bit_count(s), F.lit(1))).cast("long") * F.element_at("docs", s + 1)).otherwise(0)
    out = rows.select(
        "part", "filter_order", "step",
        _inverted(F.col("docs"), F.col("before").bitwiseOR(own), none, n).alias("kept"),
        _inverted(F.col("docs"), F.col("before"), own, n).alias("removed"),
        F.element_at("docs", own + 1).alias("failing"),
        _inverted(F.col("docs"), others, own, n).alias("unique_fails"),
        _inverted(F.col("good"), F.col("before"), own, n).alias("good_lost"),
        _inverted(F.col("toxic"), F.col("before"), own, n).alias("toxic_lost"),
        F.aggregate(every, F.lit(0).cast("long"), lambda acc, s: acc + share(s)).alias("shapley"),
    )
    return out.select("part", "filter_order", "step", "kept", "removed", (F.col("failing") - F.col("removed")).alias("redundant"), "unique_fails", "good_lost", "toxic_lost", "shapley")


def audit(docs: DataFrame, labels: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """``docs(doc_id, text, lang, ...)``, ``labels(doc_id, quality, toxic)`` -> ``(part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley)``.

    One row for each part (lang, null as empty), order of the five filters and step: rows ``kept`` after it, ``removed`` at it, ``redundant``
    (failing its filter but gone before), ``unique_fails`` (failing its filter alone), ``good_lost`` and ``toxic_lost`` (labelled ones
    removed at it), and ``shapley``, what the filter removes summed over all orders. Each row of ``docs`` counts, repeated ones too; see
    ``failures`` and ``joint_failures`` for nulls and repeated labels. Texts are measured whole, however long. Extra columns are not
    read; an empty table gives an empty table.
    """
    return interactions(joint_failures(failures(docs, limits), labels))
