"""Connected components by alternating large-star and small-star steps over an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common


def _smallest(edges: DataFrame) -> DataFrame:
    """u -> the least of its neighbours and itself."""
    return edges.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    return both.join(_smallest(both), "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = _smallest(down)
    return down.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v"))).where("u <> v").distinct()


def components(edges: DataFrame, about: int | None = None) -> DataFrame:
    """edges(u, v) of longs -> (u, component), a row per node that has an edge; component is its least node.

    Self-loops and repeated edges change nothing; no edges give no rows. Every step's edges are
    written to the shared folder; steps grow with the logarithm of the longest path.  `about`: how many
    edges there may be, for the number of tasks alone."""
    now = common.staged(common.narrow(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), about), "cc")
    last = None
    while True:
        mark = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if mark == last:
            break
        step = common.staged(common.narrow(_small_star(_large_star(now)), mark[0]), "cc")
        common.unstage(now)
        now, last = step, mark
    least = now.groupBy("u").agg(F.min("v").alias("component"))
    return common.narrow(least.unionByName(now.select(F.col("v").alias("u"), F.col("v").alias("component")).distinct()), 2 * mark[0])
