"""Connected components by repeated contraction, without collecting links anywhere."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomtext.plans.runtime import checkpoint


def connected_components(edges: DataFrame, u: str = "u", v: str = "v") -> DataFrame:
    """(node, component) of every node that a link between two different nodes touches.

    ``component`` is the smallest node reachable. Each round points every node at its smallest
    neighbour, jumps along the pointers until they end, which doubles the way each time and so takes
    few jumps even of long chains, and contracts the links to what still differs; a hub's links are
    pre-aggregated by ``min`` before the shuffle. Null ends and self-links are ignored;
    an empty table gives an empty result.
    """
    e = edges.select(F.least(u, v).alias("u"), F.greatest(u, v).alias("v")).where("u is not null and v is not null and u < v").distinct()
    e = checkpoint(e)
    labels: DataFrame | None = None
    while not e.isEmpty():
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        step = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("node"), F.least("u", "m").alias("to"))
        step, moved = checkpoint(step), True
        while moved:
            ahead = step.select(F.col("node").alias("to"), F.col("to").alias("further"))
            step = checkpoint(step.join(ahead, "to").select("node", F.col("further").alias("to"), (F.col("further") != F.col("to")).alias("moved")))
            moved = step.agg(F.max("moved")).first()[0]
        if labels is None:
            labels = step.select("node", F.col("to").alias("component"))
        else:
            labels = labels.join(step.select(F.col("node").alias("component"), "to"), "component", "left").select("node", F.coalesce("to", "component").alias("component"))
        labels = checkpoint(labels)
        left, right = step.select(F.col("node").alias("u"), F.col("to").alias("pu")), step.select(F.col("node").alias("v"), F.col("to").alias("pv"))
        e = e.join(left, "u").join(right, "v").where("pu <> pv")
        e = checkpoint(e.select(F.least("pu", "pv").alias("u"), F.greatest("pu", "pv").alias("v")).distinct())
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")) if labels is None else labels
