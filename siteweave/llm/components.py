"""Connected components as Spark jobs: alternating large and small stars.

Each round is two groupings with a ``min`` per node (combined before the shuffle) and joins back to
the edges; the edge count never grows. Rounds are written to the shared folder, so plans stay short
and a lost executor costs one round at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from siteweave.plans.stages import written

MAX_ROUNDS = 60


def forest(left, right):
    """Arrays of linked ids -> (node, smallest id of its piece) for all nodes but the smallest.

    Used inside tasks so that they hand on one row per node, whatever the number of links.
    """
    import numpy as np

    nodes, flat = np.unique(np.concatenate([left, right]), return_inverse=True)
    a, b = flat[: len(left)], flat[len(left) :]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[a], label[b])
        before = label.copy()
        # hook roots and ends to the smaller label, then jump
        np.minimum.at(label, before[a], low)
        np.minimum.at(label, before[b], low)
        np.minimum.at(label, a, low)
        np.minimum.at(label, b, low)
        while True:
            jumped = label[label]
            if np.array_equal(jumped, label):
                break
            label = jumped
        if np.array_equal(before, label):
            break
    keep = label != np.arange(len(nodes))
    return nodes[keep], nodes[label[keep]]


def _star(both: DataFrame, large: bool) -> DataFrame:
    """One star step on undirected edges given in both directions (u, v)."""
    low = F.least(F.min("v"), F.col("u"))
    if large:
        least = both.groupBy("u").agg(low.alias("m"))
        kept = both.where("v > u")
        return kept.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    down = both.where("v < u")
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    linked = down.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return linked.unionByName(least.select("u", F.col("m").alias("v")))


def components(edges: DataFrame, left: str, right: str) -> DataFrame:
    """(node, component): smallest id reachable, for every node that has an edge.

    Null ends and self-links are ignored, repeated edges count once, no edges give no rows.
    """
    down = written(
        edges.select(F.greatest(left, right).alias("u"), F.least(left, right).alias("v"))
        .where(F.col(left).isNotNull() & F.col(right).isNotNull() & F.col("u").isNotNull())
        .where("u > v")
        .distinct(),
        "links",
    )

    def mark(df: DataFrame) -> tuple:
        row = df.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.hash("u", "v"))).first()
        return tuple(row)

    before = mark(down)
    for _ in range(MAX_ROUNDS if before[0] else 0):
        both = down.unionByName(down.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _star(both, large=True).where("u > v").distinct()
        down = written(_star(large, large=False).where("u > v").distinct(), "links")
        now = mark(down)
        if now == before:
            break
        before = now
    else:
        if before[0]:
            raise RuntimeError("components did not settle")
    return down.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        down.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    )
