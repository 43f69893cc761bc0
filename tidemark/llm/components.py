"""Connected components by alternating large-star and small-star steps.

Every step keeps one row per edge at most and writes its edges to the shared
folder, so lineage stays short and lost executors only cost the running step;
the step before is deleted. Steps end as soon as the edges are stars.
"""

from __future__ import annotations

from math import ceil

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import discard, stored

#: Edges a partition of a written step.
_PART_EDGES = 250_000


def _are_stars(edges: DataFrame) -> bool:
    """Whether every node has one edge down at most, and none leads to a node that has one itself."""
    twice = edges.groupBy("u").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("u")
    inner = edges.select("u").join(edges.select(F.col("v").alias("u")), "u", "left_semi")
    return twice.unionByName(inner).isEmpty()


def components(edges: DataFrame, work: str) -> DataFrame:
    """Rows (u, root) for every node of ``edges`` (a, b): root is the smallest node it is linked with."""
    now = stored(
        edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), f"{work}/step=0"
    )
    step, parts = 0, max(8, ceil(now.count() / _PART_EDGES))
    while not _are_stars(now):
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = stored(large.where("u <> v").distinct().coalesce(parts), f"{work}/step={step}-large")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))
        step += 1
        now = stored(small.where("u <> v").distinct().coalesce(parts), f"{work}/step={step}")
        discard(now.sparkSession, f"{work}/step={step - 1}", f"{work}/step={step - 1}-large")
    roots = now.select("v").distinct().select(F.col("v").alias("u"), F.col("v").alias("root"))
    return now.select("u", F.col("v").alias("root")).unionByName(roots)
