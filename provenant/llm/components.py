"""Connected components by repeated contraction, with DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from provenant.llm.common import materialize


def connected_components(edges: DataFrame) -> DataFrame:
    """node, component for every node of edges(src, dst); component is the smallest reachable node.

    Each round hooks every node to its smallest neighbour, follows those
    pointers, and replaces the ends of each edge by what they point to; edges
    inside one group vanish, so the edge table shrinks quickly. A round needs
    only a partial-aggregated min and joins whose one side is unique per key,
    so a node with very many edges is never gathered in one task. Self loops
    and repeated or reversed edges are allowed; null ends are ignored. An
    empty table gives an empty result.
    """
    live = _canonical(edges.select("src", "dst"))
    labels = None
    while True:
        live = materialize(live, "cc-edges")
        if live.isEmpty():
            break
        both = live.union(live.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
        hook = both.groupBy("src").agg(F.min("dst").alias("up")).select(F.col("src").alias("node"), F.least("src", "up").alias("up"))
        hook = materialize(_jump(_jump(hook)), "cc-hook")
        left = hook.select(F.col("node").alias("src"), F.col("up").alias("s"))
        right = hook.select(F.col("node").alias("dst"), F.col("up").alias("d"))
        live = _canonical(live.join(left, "src").join(right, "dst").select(F.col("s").alias("src"), F.col("d").alias("dst")))
        if labels is None:
            labels = hook.select("node", F.col("up").alias("component"))
        else:
            step = hook.select(F.col("node").alias("component"), "up")
            labels = materialize(labels.join(step, "component", "left").select("node", F.coalesce("up", "component").alias("component")), "cc-labels")
    if labels is None:
        return live.select(F.col("src").alias("node"), F.col("dst").alias("component"))
    return labels


def _canonical(edges: DataFrame) -> DataFrame:
    return edges.where("src <> dst").select(F.greatest("src", "dst").alias("src"), F.least("src", "dst").alias("dst")).distinct()


def _jump(hook: DataFrame) -> DataFrame:
    above = hook.select(F.col("node").alias("up"), F.col("up").alias("top"))
    return hook.join(above, "up").select("node", F.col("top").alias("up"))
