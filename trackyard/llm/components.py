"""Connected components of a stored edge table, by rounds of contraction on Spark."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trackyard.llm.common import stored


def _ranked(node: Column) -> Column:
    """Nodes in a random but fixed order, so that a chain shrinks by a share in each round."""
    return F.struct(F.xxhash64(node).alias("h"), node.alias("node"))


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for each node of ``edges`` (u long, v long); roots are arbitrary members.

    In a round each node goes to the smallest (in hash order) of itself and its neighbours;
    edges between the merged nodes remain.  Each round's tables are stored.  An empty edge
    table gives no rows.
    """
    edges = stored(edges.where("u <> v").select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v"))
                   .distinct(), "edges")
    steps: list[DataFrame] = []
    while not steps or not edges.isEmpty():
        both = edges.select("u", "v").unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        best = both.groupBy("u").agg(F.min(_ranked(F.col("v"))).alias("m"))
        step = stored(best.select(F.col("u").alias("node"),
                                  F.least(F.col("m"), _ranked(F.col("u"))).getField("node").alias("root")), "step")
        steps.append(step)
        left, right = (step.select(F.col("node").alias(k), F.col("root").alias(f"{k}2")) for k in ("u", "v"))
        merged = edges.join(left, "u").join(right, "v").where("u2 <> v2")
        edges = stored(merged.select(F.least("u2", "v2").alias("u"), F.greatest("u2", "v2").alias("v")).distinct(),
                       "edges")
    found = steps.pop()
    while steps:
        later = found.select(F.col("node").alias("root"), F.col("root").alias("last"))
        found = stored(steps.pop().join(later, "root", "left")
                       .select("node", F.coalesce("last", "root").alias("root")), "step")
    return found
