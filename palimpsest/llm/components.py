"""Connected components with smallest-id labels, by hooking and pointer jumping on tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.functions.materialize import materialize


def components(edges: DataFrame) -> DataFrame:
    """`a, b` links -> `node, label` for every node of a link; label is the smallest node reachable.

    A round gives every label the smallest label next to any of its nodes and then follows labels once
    more, so rounds grow with the logarithm of a component's width. Links inside a component leave.
    Groups are folded by `min` before any shuffle; joins meet unique keys, so AQE can split hot ones.
    """
    links = materialize(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    nodes = links.select(F.col("a").alias("node")).union(links.select("b")).distinct()
    state = materialize(nodes.withColumn("label", F.col("node")))
    while True:
        # links between labels: every label hooks onto the smallest one it meets
        onto = links.groupBy(F.col("b").alias("label")).agg(F.min("a").alias("next"))
        if onto.isEmpty():
            return state
        jump = onto.join(onto.select(F.col("label").alias("next"), F.col("next").alias("after")), "next", "left")
        jump = materialize(jump.select("label", F.coalesce("after", "next").alias("next")))
        state = materialize(state.join(jump, "label", "left").select("node", F.coalesce("next", "label").alias("label")))
        moved = links.join(jump.select(F.col("label").alias("a"), F.col("next").alias("na")), "a", "left")
        moved = moved.join(jump.select(F.col("label").alias("b"), F.col("next").alias("nb")), "b", "left")
        ends = moved.select(F.coalesce("na", "a").alias("a"), F.coalesce("nb", "b").alias("b")).where("a <> b")
        links = materialize(ends.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
