"""Approximate vector search over navigable small-world graphs, one for each part of the rows.

Rows are dealt to parts of about ``PART`` rows by a digest of their id. A part is a graph of its own: each row draws a level, and on each level up to
its own it has links to near rows. A search walks from the top level down to nearer and nearer rows and then spreads over the lowest level with a
beam of bounded width; the parts' best rows are merged. With a beam as wide as the part every row that links reach is looked at, which is the exact search.

A part is stored as one row of packed arrays, so a search reads it in one piece, needs no shuffle but for the k best of each part, and
compares the query with the rows on its way only; ``seen`` counts these. Building is one part a task, bounded by ``PART``.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

PART = 10_000
LINKS, BUILD_BEAM = 12, 80
BEAM = 64
_PARTS = "part int, n int, ids binary, vectors binary, levels binary, starts binary, links binary"
_FOUND = "query long, id long, similarity double, seen long"


class Graph:
    """Unit vectors with links on levels; level 0 holds all rows."""

    def __init__(self, x: np.ndarray, levels: np.ndarray, links: list[list[np.ndarray]]) -> None:
        self.x, self.levels, self.links = x, levels, links
        self.entry = int(np.argmax(levels)) if len(levels) else -1

    @classmethod
    def build(cls, x: np.ndarray, draws: np.ndarray, m: int = LINKS, beam: int = BUILD_BEAM) -> Graph:
        """Rows put in one after the other; ``draws`` in (0, 1] give their levels."""
        levels = np.minimum(np.floor(-np.log(draws) / np.log(m)), 12).astype(np.int32)
        g = cls(x, levels, [[np.zeros(0, np.int32) for _ in range(level + 1)] for level in levels])
        g.entry = 0 if len(x) else -1
        for i in range(1, len(x)):
            top, at = int(levels[g.entry]), g.entry
            for level in range(top, int(levels[i]), -1):
                at = g._nearest(x[i], at, level)
            near = [at]
            for level in range(min(top, int(levels[i])), -1, -1):
                found = g._spread(x[i], near, level, beam)[0]
                near = [j for _, j in found]
                own = g._spaced(i, near, m)
                g.links[i][level] = own
                for j in own.tolist():
                    back = np.append(g.links[j][level], np.int32(i))
                    most = 2 * m if level == 0 else m
                    if len(back) > most:
                        order = np.argsort(-(x[back] @ x[j]), kind="stable")
                        back = g._spaced(j, back[order].tolist(), most)
                    g.links[j][level] = back
            if levels[i] > top:
                g.entry = i
        return g

    def _spaced(self, i: int, near: list[int], most: int) -> np.ndarray:
        """Of near rows, nearest first, those nearer to ``i`` than to one that is taken; the rest fills up what is left."""
        taken: list[int] = []
        rest: list[int] = []
        own = self.x[near] @ self.x[i]
        for j, s in zip(near, own, strict=True):
            if j == i:
                continue
            if len(taken) < most and (not taken or float((self.x[taken] @ self.x[j]).max()) < s):
                taken.append(j)
            else:
                rest.append(j)
        return np.array((taken + rest)[:most], np.int32)

    def _nearest(self, q: np.ndarray, at: int, level: int) -> int:
        best = float(self.x[at] @ q)
        while len(near := self.links[at][level]):
            s = self.x[near] @ q
            k = int(np.argmax(s))
            if s[k] <= best:
                break
            best, at = float(s[k]), int(near[k])
        return at

    def _spread(self, q: np.ndarray, start: list[int], level: int, beam: int) -> tuple[list[tuple[float, int]], int]:
        """The ``beam`` nearest rows that links reach, nearest first, and how many rows were compared."""
        seen = np.zeros(len(self.x), bool)
        seen[start] = True
        first = [(float(s), j) for s, j in zip(self.x[start] @ q, start, strict=True)]
        open_, best = [(-s, j) for s, j in first], list(first)
        heapq.heapify(open_)
        heapq.heapify(best)
        while open_:
            s, j = heapq.heappop(open_)
            if len(best) >= beam and -s < best[0][0]:
                break
            near = self.links[j][level]
            near = near[~seen[near]]
            if not len(near):
                continue
            seen[near] = True
            for v, i in zip((self.x[near] @ q).tolist(), near.tolist(), strict=True):
                if len(best) < beam or v > best[0][0]:
                    heapq.heappush(open_, (-v, i))
                    heapq.heappush(best, (v, i))
                    if len(best) > beam:
                        heapq.heappop(best)
        return sorted(best, reverse=True), int(seen.sum())

    def search(self, q: np.ndarray, beam: int) -> tuple[list[tuple[float, int]], int]:
        if self.entry < 0:
            return [], 0
        at = self.entry
        for level in range(int(self.levels[at]), 0, -1):
            at = self._nearest(q, at, level)
        return self._spread(q, [at], 0, beam)

    def pack(self) -> tuple[bytes, bytes, bytes, bytes]:
        """Vectors, levels, and all links one after the other with where each row's and level's begin."""
        flat = [x for row in self.links for x in row]
        starts = np.concatenate([[0], np.cumsum([len(x) for x in flat])]).astype(np.int64)
        links = np.concatenate(flat).astype(np.int32) if flat else np.zeros(0, np.int32)
        return self.x.astype(np.float32).tobytes(), self.levels.tobytes(), starts.tobytes(), links.tobytes()

    @classmethod
    def unpack(cls, vectors: bytes, levels: bytes, starts: bytes, links: bytes) -> Graph:
        own = np.frombuffer(levels, np.int32)
        at, flat = np.frombuffer(starts, np.int64), np.frombuffer(links, np.int32)
        lists = [flat[a:b] for a, b in zip(at[:-1], at[1:], strict=True)]
        firsts = np.concatenate([[0], np.cumsum(own + 1)])
        x = np.frombuffer(vectors, np.float32).reshape(len(own), -1).astype(np.float64) if len(own) else np.zeros((0, 1))
        return cls(x, own, [lists[a:b] for a, b in zip(firsts[:-1], firsts[1:], strict=True)])

    def best(self, q: np.ndarray, beam: int, k: int, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        """Rows and similarities of the k best, ties by id, and how many rows were compared; a beam as wide as the part looks at every row."""
        if beam >= len(self.x):
            rows, s, seen = np.arange(len(self.x)), self.x @ q, len(self.x)
        else:
            found, seen = self.search(q, max(beam, k))
            rows, s = np.array([j for _, j in found], np.int64), np.array([v for v, _ in found])
        order = np.lexsort((ids[rows], -s))[:k]
        return rows[order], s[order], seen


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=-1, keepdims=True), 1e-12)


def build_graphs(rows: DataFrame, id_: str, embedding: str = "embedding", part: int = PART, links: int = LINKS) -> DataFrame:
    """One packed graph a row, to be stored; rows without a vector are left out. The same rows give the same graphs. Ids are longs."""
    held = rows.where(F.col(embedding).isNotNull()).select(F.col(id_).cast("long").alias("id"), F.col(embedding).cast("array<double>").alias("v"))
    parts = max(1, -(-held.count() // part))

    def built(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("id", kind="stable")
        draws = (frame["draw"].to_numpy(np.int64).astype(np.float64) % (1 << 52) + 1) / (1 << 52)
        g = Graph.build(_unit(np.stack(frame["v"].to_numpy())), draws, links)
        vectors, levels, starts, flat = g.pack()
        return pd.DataFrame({"part": [key[0]], "n": [len(frame)], "ids": [frame["id"].to_numpy(np.int64).tobytes()], "vectors": [vectors], "levels": [levels], "starts": [starts], "links": [flat]})

    draw = F.pmod(F.xxhash64("id", F.lit(7)), F.lit(1 << 52)).alias("draw")
    dealt = held.select("id", "v", draw, F.pmod(F.xxhash64("id"), F.lit(parts)).cast("int").alias("part"))
    return dealt.groupBy("part").applyInPandas(built, _PARTS)


def _searched(frame: pd.DataFrame, queries: list[tuple[int, np.ndarray]], k: int, beam: int) -> Iterator[tuple]:
    for ids, vectors, levels, starts, links in zip(frame["ids"], frame["vectors"], frame["levels"], frame["starts"], frame["links"], strict=True):
        g, own = Graph.unpack(vectors, levels, starts, links), np.frombuffer(ids, np.int64)
        for query, q in queries:
            rows, s, seen = g.best(q, beam, k, own)
            for n, (i, v) in enumerate(zip(own[rows].tolist(), s.tolist(), strict=True)):
                yield query, i, v, seen if n == 0 else 0


def _frame(found: Iterator[tuple]) -> pd.DataFrame:
    return pd.DataFrame(list(found), columns=["query", "id", "similarity", "seen"]).astype({"query": "int64", "id": "int64", "similarity": "float64", "seen": "int64"})


def graph_search(graphs: DataFrame, vector: list[float], k: int, id_: str, beam: int = BEAM) -> DataFrame:
    """``(id, similarity)`` of about the k nearest rows to one vector."""
    q = _unit(np.asarray(vector, dtype=np.float64))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield _frame(_searched(frame, [(0, q)], k, beam))

    found = graphs.mapInPandas(run, _FOUND)
    return found.select(F.col("id").alias(id_), "similarity").orderBy(F.desc("similarity"), id_).limit(k)


def graph_neighbours(graphs: DataFrame, queries: DataFrame, k: int, beam: int = BEAM, block: int = 1000) -> DataFrame:
    """``queries(query, embedding)`` -> ``(query, id, similarity, rank, seen)``: the k nearest of each, and how many rows it was compared with.

    Queries are dealt to blocks of about ``block``; a task searches one part for one block, so neither side has to fit as a whole.
    """
    asked = queries.where(F.col("embedding").isNotNull()).select(F.col("query").cast("long").alias("query"), F.col("embedding").cast("array<double>").alias("v"))
    blocks = max(1, -(-asked.count() // block))
    parts = graphs.agg(F.max("part")).first()[0]
    left = graphs.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    right = asked.withColumn("block", F.pmod(F.xxhash64("query"), F.lit(blocks)).cast("int")).withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts or 0))))

    def run(frame: pd.DataFrame, wanted: pd.DataFrame) -> pd.DataFrame:
        return _frame(_searched(frame, [(q, _unit(np.asarray(v))) for q, v in zip(wanted["query"], wanted["v"], strict=True)], k, beam))

    found = left.groupBy("part", "block").cogroup(right.groupBy("part", "block")).applyInPandas(run, _FOUND)
    best = Window.partitionBy("query").orderBy(F.desc("similarity"), "id")
    ranked = found.select("query", "id", "similarity", F.sum("seen").over(Window.partitionBy("query")).alias("seen"), F.row_number().over(best).alias("rank"))
    return ranked.where(F.col("rank") <= k).select("query", "id", "similarity", "rank", "seen")
