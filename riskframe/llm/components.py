"""Connected components of an edge table, by contraction (native).

Each round every vertex hooks onto its smallest neighbour if that is smaller,
the hooks are followed to their roots by pointer jumping, and the edges are
rewritten to roots; only edges between different roots go on. All tables stay
distributed; each round is written to the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored


def _follow(parents: DataFrame) -> DataFrame:
    """u -> root of u, by repeated p(u) := p(p(u))."""
    while True:
        up = parents.select(F.col("u").alias("_u"), F.col("p").alias("_p"))
        jumped = stored(parents.join(up, F.col("p") == F.col("_u"), "left").select(
            "u", F.coalesce("_p", "p").alias("p"), F.col("_p").isNotNull().alias("moved")), "jump")
        parents = jumped.select("u", "p")
        if not jumped.filter("moved").head(1):
            return parents


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """node, component (its smallest node) of every node with an edge."""
    edges = stored(edges.filter(F.col(a) != F.col(b)).select(
        F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct(), "edges")
    labels = None
    while edges.head(1):
        parents = _follow(stored(edges.groupBy("u").agg(F.min("v").alias("p")), "hooks"))
        if labels is None:
            nodes = edges.select(F.col("u").alias("node")).union(edges.select("v")).distinct()
            labels = nodes.select("node", F.col("node").alias("component"))
        labels = stored(labels.join(parents, F.col("component") == F.col("u"), "left").select(
            "node", F.coalesce("p", "component").alias("component")), "labels")
        pu = parents.select(F.col("u").alias("_a"), F.col("p").alias("_pa"))
        pv = parents.select(F.col("u").alias("_b"), F.col("p").alias("_pb"))
        moved = edges.join(pu, F.col("u") == F.col("_a"), "left").join(pv, F.col("v") == F.col("_b"), "left").select(
            F.coalesce("_pa", "u").alias("u"), F.coalesce("_pb", "v").alias("v"))
        edges = stored(moved.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(),
                       "edges")
    if labels is None:
        return edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return labels
