"""Roots and depths of parent chains by pointer doubling: log2(depth) joins, no recursion."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.functions.materialize import materialize


def chain_roots(links: DataFrame) -> DataFrame:
    """`id, parent` -> `id, root, depth`. A parent that is absent counts as a root.

    Every round doubles the hops an open row has followed. Rows that reached a root leave the loop, so a
    root is never a join key and each row is written once when it settles. Open rows meet the unique ids of
    all rows. Rows still open after more hops than there are rows run in a cycle.
    """
    ids = links.select(F.col("id").alias("up"))
    known = links.join(ids, links["parent"] == ids["up"], "left")
    state = materialize(
        known.select(
            "id",
            F.coalesce("up", "id").alias("root"),
            F.when(F.col("up").isNull(), 0).otherwise(1).cast("long").alias("depth"),
        )
    )
    settled, open_rows = [state.where("depth = 0")], state.where("depth > 0")
    total = left = open_rows.count()
    hops = 1
    while left:
        if hops > 2 * total:
            raise ValueError("parent links form a cycle")
        done = reduce(DataFrame.unionByName, settled).withColumn("done", F.lit(True))
        every = done.unionByName(open_rows.withColumn("done", F.lit(False)))
        ahead = every.select(F.col("id").alias("root"), F.col("root").alias("next"), F.col("depth").alias("more"), "done")
        moved = materialize(
            open_rows.join(ahead, "root").select("id", F.col("next").alias("root"), (F.col("depth") + F.col("more")).alias("depth"), "done")
        )
        settled.append(moved.where("done").drop("done"))
        open_rows = moved.where("not done").drop("done")
        left, hops = open_rows.count(), hops * 2
    return reduce(DataFrame.unionByName, settled)
