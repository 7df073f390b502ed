"""Connected components by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._store import cut


def _ends(edges: DataFrame) -> tuple[int, int]:
    row = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    return row[0], row[1]


def connected_components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, component): every node of `edges` (columns u, v; any order, repeats and loops allowed) with the
    smallest node that it reaches. Hot nodes are no trouble: minima combine before the shuffle and joins may split.

    Each round leaves a checkpoint, so a lost executor repeats one round at most. Raises after `most_rounds`.
    """
    nodes = edges.select(F.explode(F.array("u", "v")).alias("node")).where("node IS NOT NULL").distinct()
    now = cut(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    seen = _ends(now)
    for _ in range(most_rounds):
        both = now.union(now.select("v", "u")).toDF("u", "v")
        least = both.groupBy("u").agg(F.least("u", F.min("v")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        small = large.groupBy("u").agg(F.min("v").alias("m"))
        step = large.join(small, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
        now = cut(step.select("e.u", "e.v").where("u <> v").distinct())
        if (found := _ends(now)) == seen:
            break
        seen = found
    else:
        raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    return nodes.join(now.toDF("node", "component"), "node", "left").select("node", F.coalesce("component", "node").alias("component"))
