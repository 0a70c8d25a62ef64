"""Connected components by alternating large and small stars; links stay distributed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from concord.llm.storage import forget, saved


def _state(links: DataFrame) -> tuple:
    return tuple(links.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def _star(pairs: DataFrame, large: bool) -> DataFrame:
    """Link the larger (large star) or the smaller (small star) neighbours of every node to the smallest one."""
    # Stored, so that the join deals both sides itself and can split the centre of a large star.
    least = saved(pairs.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("least")), "least")
    joined = pairs.join(least, "a")
    if large:
        out = joined.where("b > a").select(F.col("b").alias("a"), F.col("least").alias("b"))
    else:
        out = joined.where("b <= a").select(F.col("b").alias("a"), F.col("least").alias("b")).unionByName(
            least.select("a", F.col("least").alias("b"))
        )
    return out.where("a <> b").distinct()


def components(links: DataFrame) -> DataFrame:
    """(node, component) of all nodes that have a link; a component is its smallest node. `links` has the
    columns `a` and `b`, in any direction, with repeats."""
    now = saved(links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    state = _state(now)
    while True:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        large = saved(_star(both, True), "large-star")
        small = saved(_star(large, False), "small-star")
        forget(now)
        forget(large)
        now, before = small, state
        state = _state(now)
        if state == before:
            break
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(
        now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    )
