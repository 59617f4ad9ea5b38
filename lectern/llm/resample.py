"""Quality by importance resampling: hashed n-gram models of target and raw text, sampled by Gumbel top-k.

Tokens are runs of letters and digits or single other characters (case kept); unigrams and bigrams fall into
``BUCKETS`` hash buckets. The raw model counts every document; the target model counts the labelled good
documents of a bounded sample (``sample_labels``); labels serve for nothing else. The log ratio of the two models grows with a text's
length, far beyond what any draw could turn, so a document's log weight is the mean log ratio of its n-grams times the constant
``TEMPER``. Every document gets one Gumbel draw from its id; the ``k`` greatest ``log weight + draw`` are kept, which samples ``k``
documents without replacement in proportion to the weights. ``k`` is a share of the documents, if one is given, else the number of documents whose
n-grams are on average not less likely under the target model than under the raw one by more than ``MARGIN`` (in nats).

Counts are pre-aggregated in each task (``BUCKETS`` rows a task at most); the driver sees the two fixed-size
models and fixed-size histograms, never a row for each document. Nothing is sorted: the k-th greatest key is
found by counting keys in ever finer bins.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StructField, StructType

from .common import cut, discard, pieces
from .textvec import Powers, mix, text_bytes

BUCKETS = 1 << 18
SEED = 17
#: Log weight of a nat of mean log ratio: a draw, of deviation 1.3, turns the order of documents that lie about 0.13 nats apart.
TEMPER = 10.0
#: The raw model as the target's prior, in shares of what the target has counted: an n-gram that it never saw weighs log(PRIOR / (1 + PRIOR)) = -2.4.
PRIOR = 0.1
#: How many nats an n-gram less likely under the target a document may be to count for ``k``.
MARGIN = 0.2
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_SOLID = np.zeros(256, bool)
_SOLID[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True


def _ngrams(column: pa.Array, powers: Powers) -> tuple[np.ndarray, np.ndarray]:
    """Bucket of each n-gram (unigrams, then the bigram that begins there) and the row of each."""
    data, places = text_bytes(column)
    n = len(data)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    solid, first = _SOLID[data], np.zeros(n + 1, bool)
    first[places] = True
    other = ~solid & ~_SPACE[data]
    begins, ends = solid.copy(), solid.copy()
    begins[1:] &= ~solid[:-1] | first[1:n]
    ends[:-1] &= ~solid[1:] | first[1:n]
    s, e = np.flatnonzero(begins | other), np.flatnonzero(ends | other) + 1
    up, down = powers.to(n)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[:n], out=total[1:])
    h = mix((total[e] - total[s]) * down[s] + (e - s).astype(np.uint64))
    row = np.searchsorted(places, s, "right") - 1
    pair = row[1:] == row[:-1]
    two = mix(h[:-1] * np.uint64(0xC2B2AE3D27D4EB4F) + h[1:])[pair]
    return np.concatenate([h, two]).astype(np.uint64) % np.uint64(BUCKETS), np.concatenate([row, row[:-1][pair]])


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    powers, raw, target = Powers(), np.zeros(BUCKETS, np.int64), np.zeros(BUCKETS, np.int64)
    for batch in pieces(batches):
        bucket, row = _ngrams(batch.column("text"), powers)
        raw += np.bincount(bucket.astype(np.int64), minlength=BUCKETS)
        good = batch.column("good").to_numpy(zero_copy_only=False).astype(bool)
        if good.any():
            target += np.bincount(bucket[good[row]].astype(np.int64), minlength=BUCKETS)
    full = np.flatnonzero(raw)
    yield pa.RecordBatch.from_arrays([pa.array(full.astype(np.int32)), pa.array(raw[full]), pa.array(target[full])], ["bucket", "raw", "target"])


@dataclass
class Model:
    """The log ratio of each bucket, and the key from which documents are kept."""

    ratio: np.ndarray
    least_key: float = -np.inf


def sample_labels(labels: DataFrame, most: int = 20_000) -> DataFrame:
    """``(doc_id, quality)`` of ``most`` labelled documents by hash order, one row each; null labels are left out."""
    one = labels.where("doc_id is not null and quality is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min("quality").cast("int").alias("quality"))
    return one.orderBy(F.xxhash64("doc_id", F.lit(SEED)), "doc_id").limit(most)


def fit_models(docs: DataFrame, sample: DataFrame) -> Model:
    """Both n-gram models: raw from every document, target from the good ones of the (bounded) sample."""
    good = F.broadcast(sample.where("quality = 1").select(F.col("doc_id").alias("good_id")))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(good, F.col("doc_id") == F.col("good_id"), "left")
    rows = texts.select("text", F.col("good_id").isNotNull().alias("good")).mapInArrow(_counted, "bucket int, raw long, target long")
    table = rows.groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target")).toArrow()
    raw, target = np.zeros(BUCKETS), np.zeros(BUCKETS)
    at = table.column("bucket").to_numpy()
    raw[at], target[at] = table.column("raw").to_numpy(), table.column("target").to_numpy()
    if not target.sum():
        return Model(np.zeros(BUCKETS, np.float32))
    # both stay positive; buckets that no text has weigh the same as those that no good one has
    raw = (raw + 0.5) / (raw + 0.5).sum()
    target = (target / target.sum() + PRIOR * raw) / (1 + PRIOR)
    return Model(np.log(target / raw).astype(np.float32))


def with_weights(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` with ``n_ngrams`` and ``log_weight`` added, in one pass without a shuffle.

    A text without n-grams has log weight 0. Only ``text`` is read; columns of either name are replaced.
    """
    ratio = model.ratio
    docs = docs.drop("n_ngrams", "log_weight")

    def weighed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = Powers()
        for batch in pieces(batches):
            bucket, row = _ngrams(batch.column("text"), powers)
            n = np.bincount(row, minlength=batch.num_rows)
            mean = np.bincount(row, ratio[bucket].astype(np.float64), minlength=batch.num_rows) / np.maximum(n, 1)
            arrays = [*batch.columns, pa.array(n.astype(np.int64)), pa.array(TEMPER * mean)]
            yield pa.RecordBatch.from_arrays(arrays, [*batch.schema.names, "n_ngrams", "log_weight"])

    schema = StructType([*docs.schema.fields, StructField("n_ngrams", LongType()), StructField("log_weight", DoubleType())])
    return docs.mapInArrow(weighed, schema)


def gumbel_key(seed: int = SEED) -> Column:
    """``log_weight`` with the document's Gumbel draw, the same in every run."""
    u = (F.shiftrightunsigned(F.xxhash64("doc_id", F.lit(seed)), 11).cast("double") + 0.5) / float(1 << 53)
    return F.col("log_weight") - F.log(-F.log(u))


def is_kept(model: Model, seed: int = SEED) -> Column:
    """Whether a row of ``with_weights`` is among the sampled; texts without n-grams show nothing against them and stay."""
    return (F.col("n_ngrams") == 0) | (gumbel_key(seed) >= F.lit(model.least_key))


def kth_greatest(keys: DataFrame, column: str, k: int, bins: int = 4096, few: int = 4096) -> float:
    """The k-th greatest value, by counting in bins; at most ``bins`` counts or ``few`` values reach the driver."""
    low, high = keys.agg(F.min(column), F.max(column)).first()
    if low is None or k <= 0:
        return float("inf")
    while True:
        inside = keys.where((F.col(column) >= low) & (F.col(column) <= high))
        width = (high - low) / bins
        if width <= 0 or low + width == low:
            return low
        slot = F.least(F.floor((F.col(column) - F.lit(low)) / F.lit(width)), F.lit(bins - 1))
        counts = sorted((r[0], r[1], r[2], r[3]) for r in inside.groupBy(slot.alias("slot")).agg(F.count("*"), F.min(column), F.max(column)).collect())
        for _, n, least, most in reversed(counts):
            if k <= n:
                break
            k -= n
        else:
            return low
        if n <= few:
            got = sorted((r[0] for r in keys.where((F.col(column) >= least) & (F.col(column) <= most)).select(column).collect()), reverse=True)
            return got[k - 1]
        low, high = least, most


def fit(docs: DataFrame, labels: DataFrame, share: float | None = None, seed: int = SEED) -> Model:
    """Models and the key of the k-th document. Without a good label nothing can be told apart and every document is kept."""
    sample = cut(sample_labels(labels))
    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    model = fit_models(narrow, sample)
    if not model.ratio.any():
        return model
    keyed = cut(with_weights(narrow, model).drop("text").where("n_ngrams > 0").withColumn("key", gumbel_key(seed)))
    near = F.coalesce(F.sum((F.col("log_weight") >= -TEMPER * MARGIN).cast("long")), F.lit(0))
    n, k = keyed.agg(F.count("*"), near).first()
    model.least_key = kth_greatest(keyed, "key", round(share * n) if share is not None else k)
    discard(sample, keyed)
    return model


def quality_classifier(docs: DataFrame, labels: DataFrame, share: float | None = None, seed: int = SEED) -> DataFrame:
    """``docs(doc_id, text, ...)``, ``labels(doc_id, quality)`` -> ``(doc_id, n_ngrams, log_weight, kept)``, a row for each input row.

    A null text is empty; a text without n-grams has log weight 0, takes no part in the sampling and is kept. Texts are weighed whole, however long. Rows with equal
    doc_id share one Gumbel draw, and so do all without one. Rows whose key ties with the k-th are all kept. Labels of unknown documents
    and null labels are ignored; where a document has several labels the lowest counts. Extra columns are not read.
    """
    model = fit(docs, labels, share, seed)
    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return with_weights(narrow, model).drop("text").withColumn("kept", is_kept(model, seed))
