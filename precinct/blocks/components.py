"""Connected components by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from precinct.blocks.shared import materialize


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.union(edges.select("v", "u"))
    low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.filter("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    low = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = down.join(low, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(low.select("u", F.col("m").alias("v")))


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """(node, component) for every node of an edge; component is the smallest node id reachable.

    Self-loops give a component of one; null ends are ignored; direction and repeats don't matter.
    A hub is safe: minima are pre-aggregated and the join back to a hub's edges is one Spark can split.
    """
    edges = edges.select(F.col(src).alias("u"), F.col(dst).alias("v")).dropna()
    loops = edges.filter("u = v").select("u").distinct()
    now = materialize(edges.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    state = None
    while True:
        mark = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if mark["n"] == 0 or (mark["n"], mark["h"]) == state:
            break
        state = (mark["n"], mark["h"])
        now = materialize(_small_star(_large_star(now)).distinct(), "edges")
    member = now.select(F.col("u").alias("node"), F.col("v").alias("component"))
    roots = member.select(F.col("component").alias("node"), "component").distinct()
    alone = loops.select(F.col("u").alias("node"), F.col("u").alias("component"))
    found = member.union(roots)
    return found.union(alone.join(found, "node", "left_anti"))
