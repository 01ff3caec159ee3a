"""Connected components for alias keys, by hooking and contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinscope.runtime import materialise


def components(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, root): the least node joined to each node by the edges (u, v), itself if nothing is.

    Each round every node points to its least neighbour if that is lower, pointers are followed a few steps, and the
    graph shrinks to the nodes pointed to; rounds end when no edge is left, and the pointers of all rounds are followed
    in turn. A round is a written table, so lineage stays short and a lost executor costs one round.
    """
    own = edges.select("u", "v").where("u is not null and v is not null")
    label = nodes.select("node").union(own.select("u")).union(own.select("v")).where("node is not null").distinct().withColumn("root", F.col("node"))
    left = materialise(own.where("u <> v").distinct(), "alias-edges")
    while not left.isEmpty():
        both = left.union(left.select("v", "u").toDF("u", "v"))
        up = both.groupBy("u").agg(F.least("u", F.min("v")).alias("r"))
        for _ in range(2):
            # Pointers only go down, so following them ends, and each step doubles the reach.
            up = up.join(up.select(F.col("u").alias("r"), F.col("r").alias("rr")), "r").select("u", F.col("rr").alias("r"))
        up = materialise(up, "alias-pointers")
        a, b = up.toDF("u", "ru"), up.toDF("v", "rv")
        left = materialise(left.join(a, "u").join(b, "v").where("ru <> rv").select(F.col("ru").alias("u"), F.col("rv").alias("v")).distinct(), "alias-edges")
        label = label.join(up.toDF("root", "next"), "root", "left").select("node", F.coalesce("next", "root").alias("root"))
    return label
