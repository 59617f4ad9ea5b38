"""Embedding providers behind one interface, and a cache of vectors as a keyed table."""

from __future__ import annotations

import hashlib
import json
import os
import time
import urllib.request
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .cache import KeyedLog, newest

CACHE_SCHEMA = "key string, model string, embedding array<float>"

#: Dimensions of models that are asked for by name.
DIMENSIONS = {"BAAI/bge-small-en-v1.5": 384, "nomic-embed-text": 768, "text-embedding-3-small": 1536}


class HashEmbedder:
    """Deterministic offline vectors: signed hashed words, unit length. For tests and plans without a model."""

    def __init__(self, model: str = "hash-384", dimension: int = 384) -> None:
        self.model, self.dimension = model, dimension

    def embed(self, texts: list[str]) -> list[list[float]]:
        out = []
        for t in texts:
            v = [0.0] * self.dimension
            for w in t.lower().split():
                h = int.from_bytes(hashlib.sha256(w.encode()).digest()[:8], "big")
                v[h % self.dimension] += 1.0 if h >> 63 else -1.0
            n = sum(x * x for x in v) ** 0.5
            out.append([x / n for x in v] if n >= 1e-12 else v)
        return out


class HttpEmbedder:
    """A REST backend (``ollama`` or ``openai``), a batch a call, with retries that wait twice as long each time."""

    def __init__(self, kind: str, model: str, url: str, key: str | None = None, tries: int = 3, timeout: float = 30.0) -> None:
        self.kind, self.model, self.url, self.key, self.tries, self.timeout = kind, model, url.rstrip("/"), key, tries, timeout

    def embed(self, texts: list[str]) -> list[list[float]]:
        path, wait = ("/api/embed", 0.5) if self.kind == "ollama" else ("/embeddings", 1.0)
        body = json.dumps({"model": self.model, "input": texts}).encode()
        headers = {"Content-Type": "application/json"} | ({"Authorization": f"Bearer {self.key}"} if self.key else {})
        for i in range(self.tries):
            try:
                with urllib.request.urlopen(urllib.request.Request(self.url + path, body, headers), timeout=self.timeout) as r:
                    got = json.load(r)
                return got["embeddings"] if self.kind == "ollama" else [x["embedding"] for x in sorted(got["data"], key=lambda x: x["index"])]
            except OSError:
                if i + 1 == self.tries:
                    raise
                time.sleep(wait * 2**i)
        return []


class OnnxEmbedder:
    """A local sentence model through fastembed, loaded once a worker; the package is optional."""

    def __init__(self, model: str = "BAAI/bge-small-en-v1.5") -> None:
        self.model, self._loaded = model, None

    def embed(self, texts: list[str]) -> list[list[float]]:
        if self._loaded is None:
            from fastembed import TextEmbedding

            self._loaded = TextEmbedding(model_name=self.model)
        return [[float(x) for x in v] for v in self._loaded.embed(texts)]


def provider(kind: str | None = None, model: str | None = None, url: str | None = None, key: str | None = None):
    """A provider by name; the environment's ``EMBEDDING_PROVIDER`` and its like where nothing is given."""
    kind = (kind or os.environ.get("EMBEDDING_PROVIDER", "local")).lower()
    if kind == "hash":
        return HashEmbedder()
    if kind in ("fastembed", "local", "onnx"):
        return OnnxEmbedder(model or "BAAI/bge-small-en-v1.5")
    if kind == "ollama":
        return HttpEmbedder("ollama", model or "nomic-embed-text", url or os.environ.get("OLLAMA_HOST", "http://localhost:11434"))
    if kind in ("openai", "azure", "cloud"):
        return HttpEmbedder("openai", model or "text-embedding-3-small", url or os.environ.get("OPENAI_BASE_URL", "https://api.openai.com/v1"), key or os.environ.get("OPENAI_API_KEY"))
    raise ValueError(f"no embedding provider is called {kind!r}")


def embedded(texts: DataFrame, make: Callable[[], object], text: str = "text", batch: int = 32, errors: str | None = None) -> DataFrame:
    """``texts`` with ``embedding``, a vector of unit length; the provider is made once a task and called in batches.

    A batch that fails is halved until what fails stands alone; that text gets null. With ``errors`` a column of that name says why.
    """

    def run(series: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        return _vectors(series, make, batch)

    got = texts.withColumn("_got", F.pandas_udf(run, "vector array<float>, error string")(F.col(text))).withColumn("embedding", F.col("_got.vector"))
    return (got.withColumn(errors, F.col("_got.error")) if errors else got).drop("_got")


def _vectors(series: Iterator[pd.Series], make: Callable[[], object], batch: int) -> Iterator[pd.DataFrame]:
    """Vectors and errors, one call's at a time and as arrays: a number as an object takes eight times its bytes."""
    p = make()
    for s in series:
        for i in range(0, len(s), batch):
            done = _bisected(p, s.iloc[i : i + batch].fillna("").tolist())
            vectors = [unit(v) for v, _ in done]
            yield pd.DataFrame({"vector": pd.Series([None if v is None else np.asarray(v, np.float32) for v in vectors], dtype=object), "error": pd.Series([e for _, e in done], dtype=object)})


def unit(vector: list[float] | None) -> list[float] | None:
    """The vector at unit length; one of (almost) no length as it is."""
    if vector is None:
        return None
    v = np.asarray(vector, dtype=np.float64)
    n = float(np.sqrt(v @ v))
    return (v / n if n >= 1e-12 else v).tolist()


def _bisected(p: object, texts: list[str]) -> list[tuple[list[float] | None, str | None]]:
    """A vector or an error for each text: of a failed batch the halves are tried, down to single texts."""
    try:
        got = p.embed(texts)
        if len(got) != len(texts):
            raise ValueError(f"{len(got)} vectors for {len(texts)} texts")
        return [(v, None) for v in got]
    except Exception as e:
        if len(texts) == 1:
            return [(None, f"{type(e).__name__}: {e}"[:500])]
        half = len(texts) // 2
        return _bisected(p, texts[:half]) + _bisected(p, texts[half:])


def cache_key(model: str, text: Column) -> Column:
    return F.sha2(F.concat(F.lit(model + ":"), text), 256)


def misses(texts: DataFrame, cache: DataFrame, model: str, text: str = "text") -> DataFrame:
    """Distinct texts that the cache has no vector of, with their keys."""
    keyed = texts.select(cache_key(model, F.col(text)).alias("key"), F.col(text)).dropDuplicates(["key"])
    return keyed.join(cache.select("key"), "key", "left_anti")


def with_cache(texts: DataFrame, cache: DataFrame, make: Callable[[], object], model: str, text: str = "text") -> tuple[DataFrame, DataFrame]:
    """The texts with vectors, and the rows to append to the cache: only misses are embedded, each once. Of a key cached twice the newest counts."""
    fresh = embedded(misses(texts, cache, model, text), make, text).select("key", F.lit(model).alias("model"), "embedding")
    held = newest(cache, "key", "run" if "run" in cache.columns else None)
    known = held.select("key", "embedding").unionByName(fresh.select("key", "embedding"))
    return texts.withColumn("key", cache_key(model, F.col(text))).join(known, "key", "left").drop("key"), fresh


def embedding_cache(spark: SparkSession, path: str) -> KeyedLog:
    """A stored cache of vectors: read with one row a key, appended to run by run; one that cannot be read is empty."""
    return KeyedLog(spark, path, CACHE_SCHEMA)


def embed_cached(texts: DataFrame, log: KeyedLog, make: Callable[[], object], model: str, text: str = "text") -> DataFrame:
    """The texts with vectors from the stored cache. What it lacks is embedded first and stored as a run; texts that failed are not, and are null."""
    fresh = embedded(misses(texts, log.read(), model, text), make, text).where("embedding is not null")
    log.append(fresh.select("key", F.lit(model).alias("model"), "embedding"))
    return texts.withColumn("key", cache_key(model, F.col(text))).join(log.read().select("key", "embedding"), "key", "left").drop("key")
