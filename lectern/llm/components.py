"""Connected components over an edge table, by hooking and shortcutting; nothing is collected."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import HOT, cut, discard


def _common(rows: DataFrame, key: str, total: int) -> list[int]:
    """Values of ``key`` that more than one row in ``HOT`` holds: fewer than ``HOT``."""
    return [r[0] for r in rows.groupBy(key).count().where(F.col("count") * HOT > total).select(key).collect()]


def _joined(rows: DataFrame, lines: DataFrame, key: str, common: list[int]) -> DataFrame:
    """``rows`` with the one line of their key; rows of common keys meet it by broadcast, so that no task gets them all."""
    if not common:
        return rows.join(lines, key)
    often = F.col(key).isin(common)
    return rows.where(~often).join(lines.where(~often), key).unionByName(rows.where(often).join(F.broadcast(lines.where(often)), key))


def connected_components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """``edges(a, b)`` of longs -> ``(node, component)``, the smallest node reachable; nodes without edges are absent.

    Each round hooks a node's parent under the smallest grandparent next to it and halves the paths, so
    rounds grow with the logarithm of a component's width. State is one long pair a node, stored after each round. Nodes
    of a giant component meet their parent, and edges of a hub their end, by broadcast.
    Raises after ``most_rounds`` rounds: a component that wide would take more nodes than there are.
    """
    both = cut(edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct())
    parent = cut(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("least")).select("node", F.least("node", "least").alias("component")))
    hubs, nodes = _common(both, "b", both.count()), parent.count()
    before = None
    for _ in range(most_rounds):
        up = parent.select(F.col("node").alias("component"), F.col("component").alias("grand"))
        grand = cut(_joined(parent, up, "component", _common(parent, "component", nodes)).select("node", "component", "grand"))
        near = _joined(both, grand.select(F.col("node").alias("b"), "grand"), "b", hubs).groupBy(F.col("a").alias("node")).agg(F.min("grand").alias("near"))
        all_ = grand.join(near, "node")
        hooks = all_.select(
            F.explode(
                F.array(
                    F.struct(F.col("component").alias("node"), F.col("near").alias("to")),
                    F.struct(F.col("node").alias("node"), F.least("near", "grand", "component").alias("to")),
                )
            ).alias("x")
        ).select("x.node", "x.to")
        old, parent = parent, cut(hooks.groupBy("node").agg(F.min("to").alias("component")))
        discard(old, grand)
        now = parent.agg(F.count("*"), F.sum(F.col("component").cast("decimal(38,0)"))).first()
        if now == before:
            discard(both)
            return parent
        before = now
    raise RuntimeError(f"components did not settle in {most_rounds} rounds")
