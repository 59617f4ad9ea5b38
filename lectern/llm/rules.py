"""Host-level quality rules: rule failures by domain, shrunk by an empirical beta prior, back on documents.

Every document is held against the rules of ``HostRules``. The base rule (length, repetition) decides on its own. The
others (symbols, repeated lines) are signs that a sound document may show too, and its host tells what to make of
them: the share of a host's documents that fail any rule is shrunk towards the rate of all hosts, and a host is

* trusted, up to ``trusted_failures``: its documents need to pass the base rule alone;
* watched, above it: its documents need to pass every rule;
* rejected, above ``most_failures``: none of its documents is kept.

Each document's measures come from one vectorised pass over whole texts; they are narrow and checkpointed.
Failures are pre-aggregated by domain before the shuffle, so a domain with a third of all rows is one row a
task. The prior is fitted to all domains by the method of moments from two sums. Verdicts are joined back on
the domain; the domain side is one row each and AQE splits what is hot on the other side.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, pieces, text_of
from .textvec import Powers, shingles, text_bytes, words

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True


@dataclass(frozen=True)
class HostRules:
    """Production parameters: the base rule, the other rules, and the shrunk failure rates that part hosts."""

    least_words: int = 50
    most_repeat_percent: int = 50
    most_symbol_percent: int = 10
    most_dup_line_percent: int = 30
    trusted_failures: float = 0.05
    most_failures: float = 0.5


def _measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    powers = Powers()
    for batch in pieces(batches):
        text = batch.column("text")
        h, bounds, _, _ = words(text, powers, lower=False)
        data, places = text_bytes(text)
        # code points of words: bytes that begin one, outside white space
        lead = np.concatenate([[0], np.cumsum(((data & 0xC0) != 0x80) & ~_SPACE[data])])
        symbols = np.concatenate([[0], np.cumsum(_SYMBOL[data])])
        n = np.diff(bounds)
        grams, _ = shingles(h, np.array([0, len(h)]), 3)
        repeats, lines, dups = (np.zeros(len(n), np.int64) for _ in range(3))
        raw = data.tobytes()
        for i, (a, b) in enumerate(zip(bounds[:-1], bounds[1:], strict=True)):
            if b - a >= 4:
                own = grams[a : b - 2]
                order = np.argsort(own, kind="stable")
                same = own[order[1:]] == own[order[:-1]]
                if same.any():
                    again = np.zeros(len(own), bool)
                    again[order[1:][same]] = True
                    again[order[:-1][same]] = True
                    cover = np.zeros(b - a, bool)
                    for j in range(3):
                        cover[j : j + len(own)] |= again
                    repeats[i] = cover.sum()
            whole = raw[places[i] : places[i + 1]]
            solid = [x for x in whole.split(b"\n") if x.strip(b" \t\n\x0b\x0c\r")]
            lines[i], dups[i] = len(solid), len(solid) - len(set(solid))
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), batch.column("domain"), pa.array(n), *[pa.array(x.astype(np.int64)) for x in (lead[places[1:]] - lead[places[:-1]], symbols[places[1:]] - symbols[places[:-1]], lines, dups, repeats)]],
            ["doc_id", "domain", "n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words"],
        )


def measure(docs: DataFrame, domain: str = "source") -> DataFrame:
    """The measures of each whole text, with its domain. A null text is empty."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(domain).cast("string").alias("domain"), text_of().alias("text"))
    return rows.mapInArrow(_measured, "doc_id long, domain string, n_words long, word_chars long, n_symbols long, n_lines long, n_dup_lines long, n_repeat_words long")


def beta_prior(hosts: DataFrame) -> tuple[float, float]:
    """The beta prior of failure rates over ``hosts(docs, failures)``, by moments; five sums reach the driver.

    The spread of the observed rates holds what sampling a host's few documents adds to the spread of the true
    ones: that part is taken off. Where nothing is left, hosts do not differ, and the prior is as strong as it gets.
    """
    f, n = F.col("failures"), F.col("docs")
    k, docs, failures, square, squares = hosts.agg(F.count("*"), F.sum(n), F.sum(f), F.sum(f * f / n), F.sum(n * n)).first()
    if not k:
        return 1.0, 1.0
    mean = min(max(failures / docs, 1e-6), 1 - 1e-6)
    spread = square - failures * failures / docs - (k - 1) * mean * (1 - mean)
    weight = docs - squares / docs - (k - 1)
    strength = min(max(mean * (1 - mean) * weight / spread - 1, 1.0), 1e6) if spread > 0 and weight > 0 else 1e6
    return mean * strength, (1 - mean) * strength


def host_quality(docs: DataFrame, domain: str = "source", rules: HostRules = HostRules()) -> DataFrame:
    """``docs(doc_id, text, <domain>, ...)`` -> measures, ``base_failed``, ``failed`` (any rule), ``host_rate``, ``host_verdict`` and ``kept``.

    One row per input row; repeated rows count each, for their host too. A null text has no words and fails the
    base rule; a null domain is a domain of its own. An empty table gives an empty table. Extra columns are ignored.
    """
    base = (F.col("n_words") < rules.least_words) | (100 * F.col("n_repeat_words") > rules.most_repeat_percent * F.col("n_words"))
    noisy = 100 * F.col("n_symbols") > rules.most_symbol_percent * F.col("word_chars")
    stuttered = 100 * F.col("n_dup_lines") > rules.most_dup_line_percent * F.col("n_lines")
    measured = cut(measure(docs, domain).withColumn("base_failed", base).withColumn("failed", base | noisy | stuttered))
    hosts = measured.groupBy("domain").agg(F.count("*").alias("docs"), F.sum(F.col("failed").cast("long")).alias("failures"))
    alpha, beta = beta_prior(hosts)
    rate: Column = (F.col("failures") + F.lit(alpha)) / (F.col("docs") + F.lit(alpha + beta))
    verdict = F.when(rate <= rules.trusted_failures, "trusted").when(rate <= rules.most_failures, "watched").otherwise("rejected")
    verdicts = hosts.select(F.col("domain").alias("host"), rate.alias("host_rate"), verdict.alias("host_verdict"))
    out = measured.join(verdicts, F.col("domain").eqNullSafe(F.col("host")), "left").drop("host")
    passed = F.when(F.col("host_verdict") == "trusted", True).when(F.col("host_verdict") == "watched", ~F.col("failed")).otherwise(False)
    return out.withColumn("kept", ~F.col("base_failed") & passed)
