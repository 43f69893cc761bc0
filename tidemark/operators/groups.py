"""Groups of linked rows, without pairs of all members.

``linked`` finds the connected parts of a graph of few edges a node by rounds in
which every node points to the least node it knows of and pulls its neighbours
there, until every node points to its part's least node itself; each round is
written to the shared folder.

``near_groups`` joins dealings of like value and date. Rows of one director, day
and value range (so narrow that all its values are alike) are one node from the
start, with their least and greatest value; a node has at most
2 * days + 1 days and five ranges to meet, so a director with many rows, or many
copies of one, gives a number of edges in proportion to distinct days and ranges,
never to the square of its rows. A node that no other of its director is near in
time is left out before nodes meet; a window over a director holds its nodes.
"""

from __future__ import annotations

from math import log

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.ranking import kept


def linked(edges: DataFrame) -> DataFrame:
    """Rows (node, root) for every node of ``edges`` (a, b): the least node that it is linked with."""
    now = kept(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    while True:
        # a node goes under its least neighbour, its greater neighbours too
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        up = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # then all it has below go under the least of them
        low = up.groupBy("u").agg(F.min("v").alias("m"))
        down = up.join(low, "u").select(F.greatest("v", "m").alias("u"), F.least("v", "m").alias("v")).union(low.select("u", F.col("m").alias("v")))
        after = kept(down.where("u <> v").distinct(), "edges")
        same = now.join(after, ["u", "v"], "left_anti").isEmpty() and after.join(now, ["u", "v"], "left_anti").isEmpty()
        now = after
        if same:
            break
    roots = now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots)


def near_groups(rows: DataFrame, days: int = 7, tolerance: float = 0.05, who: str = "director", key: str = "fingerprint") -> DataFrame:
    """``rows`` (key, who, dt, value) with group_key and stays: chains of near dealings keep their first row (by date, then key).

    Two dealings of one person are near if at most ``days`` apart and their values differ by at most ``tolerance`` of the
    earlier one's (on one day: of the smaller one's). Rows without a person, date or positive value are groups of their own.
    """
    width = log(1 + tolerance) * (1 - 1e-9)  # all values of a range are alike, whatever the rounding
    day = F.datediff("dt", F.lit("1970-01-01").cast("date"))
    whole = F.col(who).isNotNull() & F.col("dt").isNotNull() & F.coalesce(F.col("value") > 0, F.lit(False))
    placed = rows.withColumns({"_day": F.when(whole, day), "_range": F.when(whole, F.floor(F.log("value") / width))})
    cells = placed.where("_day IS NOT NULL").groupBy(F.col(who).alias("who"), "_day", "_range").agg(
        F.min("value").alias("lo"), F.max("value").alias("hi"), F.min(F.struct("dt", key)).alias("first"), F.count(F.lit(1)).alias("n")
    )
    # what has one row and no other of its person within reach is a group of its own, and goes no further
    order = Window.partitionBy("who").orderBy("_day")
    near = (F.col("_day") - F.lag("_day").over(order) <= days) | (F.lead("_day").over(order) - F.col("_day") <= days)
    cells = kept(cells.withColumn("near", F.coalesce(near, F.lit(False))).where("near OR n > 1").withColumn("node", F.col(f"first.{key}")), "cells")
    met = _met(cells.where("near"), days)
    # ranges lie apart, so the nearest values of two nodes are the greatest of the lower and the least of the higher one
    rise = (F.col("r2") > F.col("r1")) & (F.col("lo2") - F.col("hi1") <= tolerance * F.col("hi1"))
    base = F.when(F.col("d1") == F.col("d2"), F.col("hi2")).otherwise(F.col("lo1"))
    fall = (F.col("r2") < F.col("r1")) & (F.col("lo1") - F.col("hi2") <= tolerance * base)
    alike = (F.col("r2") == F.col("r1")) | rise | fall
    parts = linked(met.where(alike & (F.col("a") != F.col("b"))).select("a", "b"))
    named = cells.join(parts, "node", "left").withColumn("root", F.coalesce("root", "node"))
    named = kept(named.select("who", "_day", "_range", "root", "first"), "named")
    least = named.groupBy("root").agg(F.min("first").alias("least"))
    found = named.join(least, "root").select(F.col("who").alias(who), "_day", "_range", F.col(f"least.{key}").alias("group_key"))
    out = placed.join(found, [who, "_day", "_range"], "left").withColumn("group_key", F.coalesce("group_key", key))
    return out.select(*rows.columns, "group_key", (F.col("group_key") == F.col(key)).alias("stays"))


def _met(cells: DataFrame, days: int) -> DataFrame:
    """Pairs of cells of one person of which the second is up to ``days`` later and up to two ranges away: (who, d1, r1, lo1, hi1, a, d2, r2, lo2, hi2, b).

    Days and ranges are dealt into buckets of ``days + 1`` days and five ranges, so a cell asks in four of them at most.
    """
    long, broad = days + 1, 5
    name = lambda k, node: [F.col(c).alias(f"{a}{k}") for c, a in (("_day", "d"), ("_range", "r"), ("lo", "lo"), ("hi", "hi"))] + [F.col("node").alias(node)]
    reach = lambda low, high, size: F.explode(F.sequence(F.floor(low / size), F.floor(high / size)))
    asked = cells.select("who", *name(1, "a"), reach(F.col("_day"), F.col("_day") + days, long).alias("_d")).withColumn("_r", reach(F.col("r1") - 2, F.col("r1") + 2, broad))
    held = cells.select("who", *name(2, "b"), F.floor(F.col("_day") / long).alias("_d"), F.floor(F.col("_range") / broad).alias("_r"))
    within = (F.col("d2") - F.col("d1")).between(0, days) & (F.col("r2") - F.col("r1")).between(-2, 2)
    # files of like values say little of the rows' size, by which one side might be broadcast
    return asked.join(held.hint("merge"), ["who", "_d", "_r"]).where(within).drop("_d", "_r")
