"""Global order without a task that holds all rows.

Rows are dealt out by ranges of their order columns and written to the shared
folder, so that the ranges stay as they are if a task runs again. Counts or sums
per range, of which there are as many as partitions, give each range its start.
"""

from __future__ import annotations

from math import ceil, log2

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.streaming.jobs import work_path


def _order(columns: list[str], descending: tuple[str, ...]) -> list[Column]:
    return [F.col(c).desc() if c in descending else F.col(c).asc() for c in columns]


def kept(rows: DataFrame, label: str = "kept") -> DataFrame:
    """``rows`` written to the shared folder and read back, for plans that use them several times."""
    path = work_path(rows.sparkSession, label)
    rows.write.parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


def ranged(rows: DataFrame, columns: list[str], descending: tuple[str, ...] = ()) -> DataFrame:
    """``rows`` with _part: parts hold ranges of the order, in its order; rows equal in all columns share one.

    The bounds of the ranges are sampled first, so rows that take work should be ``kept``.
    """
    return kept(rows.repartitionByRange(*_order(columns, descending)).withColumn("_part", F.spark_partition_id()), "ranged")


def running_total(rows: DataFrame, amount: Column, columns: list[str], descending: tuple[str, ...] = ()) -> DataFrame:
    """Column _before: the sum of ``amount`` over all rows that come before; ``columns`` tell rows apart."""
    placed = ranged(rows.withColumn("_amount", amount), columns, descending)
    parts = placed.groupBy("_part").agg(F.sum("_amount").alias("_sum"))
    starts = parts.select("_part", F.coalesce(F.sum("_sum").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_start"))
    own = Window.partitionBy("_part").orderBy(*_order(columns, descending)).rowsBetween(Window.unboundedPreceding, -1)
    before = F.col("_start") + F.coalesce(F.sum("_amount").over(own), F.lit(0))
    return placed.join(starts, "_part").withColumn("_before", before).drop("_part", "_start", "_amount")


def numbered(rows: DataFrame, columns: list[str], name: str, keys: list[str] | None = None, descending: tuple[str, ...] = ()) -> DataFrame:
    """Column ``name``: the place from 1 in the order of ``columns``, within ``keys``; ``columns`` tell rows apart."""
    keys = keys or []
    placed = running_total(rows, F.lit(1).cast("long"), [*keys, *columns], descending)
    if not keys:
        return placed.withColumn(name, F.col("_before") + 1).drop("_before")
    first = placed.groupBy(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)]).agg(F.min("_before").alias("_first"))
    same = F.lit(True)
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    out = placed.join(first, same).withColumn(name, F.col("_before") - F.col("_first") + 1)
    return out.drop("_before", "_first", *[f"_k{i}" for i in range(len(keys))])


def tile(place: Column, total: Column, n: int) -> Column:
    """Which of ``n`` groups of equal size a place falls into; the first groups take what is left over."""
    small, more = F.floor(total / n), total % n
    cut = more * (small + 1)
    return F.when(place <= cut, F.ceil(place / (small + 1))).otherwise(more + F.ceil((place - cut) / F.greatest(small, F.lit(1)))).cast("int")


def below_before(history: DataFrame, asked: DataFrame, day: str, measures: list[str]) -> DataFrame:
    """Rows (measure, day, value, n_below, n_before) for each distinct asked value of a day: how many earlier values there are, and how many smaller ones.

    Days are numbered from the first, and the days before a day are put together from blocks of 1, 2, 4, ... days, one for each bit of
    its number that is set. In each block the values and the questions to it stand in one order, so a running sum of the
    values' counts answers all questions at once. That makes log2(days) rows of each distinct value and day, and no pairs
    of rows; order and sums come from ranges of values, so no task holds a block.
    """
    # a value that is not a number, or null, is neither counted nor asked for
    long = lambda df: df.select(F.col(day).alias("day"), F.explode(F.array(*[F.struct(F.lit(m).alias("measure"), F.col(m).cast("double").alias("value")) for m in measures])).alias("_m")).select("day", "_m.*").where("day IS NOT NULL AND value IS NOT NULL AND NOT isnan(value)")
    counts = kept(long(history).groupBy("measure", "day", "value").agg(F.count(F.lit(1)).alias("n")), "counts")
    questions = kept(long(asked).distinct(), "questions")
    ends = counts.select("day").union(questions.select("day")).agg(F.min("day").alias("first"), F.datediff(F.max("day"), F.min("day")).alias("n")).first()
    levels = max(1, ceil(log2((ends.n or 0) + 2)))
    number = F.datediff("day", F.lit(ends.first)).alias("t")
    every = F.explode(F.sequence(F.lit(0), F.lit(levels - 1)))
    shifted = F.expr("shiftright(t, level)")
    place = ["measure", "level", "block", "value"]
    blocks = counts.select("measure", "value", "n", number, every.alias("level")).withColumn("block", shifted).where("block % 2 = 0")
    parts = questions.select("measure", "day", "value", number, every.alias("level")).withColumn("block", shifted).where("block % 2 = 1").withColumn("block", F.col("block") - 1)
    # at equal values questions come first; among equal rows of one kind the order does not matter
    both = blocks.select(*place, "n", F.lit(None).cast("date").alias("day"), F.lit(1).alias("kind")).unionByName(parts.select(*place, F.lit(0).cast("long").alias("n"), "day", F.lit(0).alias("kind")))
    placed = running_total(both, F.col("n"), [*place, "kind"])
    first = placed.groupBy("measure", "level", "block").agg(F.min("_before").alias("_first"))
    answers = placed.where("kind = 0").join(first, ["measure", "level", "block"])
    below = answers.groupBy("measure", "day", "value").agg(F.sum(F.col("_before") - F.col("_first")).alias("n_below"))
    daily = counts.groupBy("measure", "day").agg(F.sum("n").alias("n")).unionByName(questions.select("measure", "day", F.lit(0).cast("long").alias("n"))).groupBy("measure", "day").agg(F.sum("n").alias("n"))
    before = F.sum("n").over(Window.partitionBy("measure").orderBy("day").rowsBetween(Window.unboundedPreceding, -1))
    earlier = daily.select("measure", "day", F.coalesce(before, F.lit(0)).alias("n_before"))
    return kept(questions.join(earlier, ["measure", "day"]).join(below, ["measure", "day", "value"], "left").withColumn("n_below", F.coalesce("n_below", F.lit(0))), "ranks")


#: Bits of a rank that a step of ``median_before`` settles.
_STEP_BITS = 4


def median_before(rows: DataFrame, who: str, day: str, value: str) -> DataFrame:
    """Rows (who, day, median): for each day of each key the median of its values on earlier days; days without any are left out.

    The values of a key get ranks; the middle ranks of the days before are found by descent, a few bits of the rank a step:
    running counts along the days say how many earlier values each of a range's parts holds. A window holds a row a day and
    range, and two for each day's questions, so a key's rows take time in proportion to its days and the logarithm of its values.
    """
    fan = 1 << _STEP_BITS
    known = rows.select(F.col(who).alias("who"), F.col(day).alias("day"), F.col(value).cast("double").alias("value")).where("who IS NOT NULL AND day IS NOT NULL AND value IS NOT NULL AND NOT isnan(value)")
    counts = kept(known.groupBy("who", "day", "value").agg(F.count(F.lit(1)).alias("n")), "counts")
    ranks = kept(numbered(counts.select("who", "value").distinct(), ["value"], "_rank", ["who"]).select("who", "value", (F.col("_rank") - 1).cast("long").alias("rank")), "ranks")
    most = ranks.agg(F.max("rank").alias("m")).first().m or 0
    steps = max(1, ceil(int(most).bit_length() / _STEP_BITS))
    items = kept(counts.join(ranks, ["who", "value"]).select("who", "day", "rank", "n"), "items")
    daily = items.groupBy("who", "day").agg(F.sum("n").alias("n"))
    before = F.sum("n").over(Window.partitionBy("who").orderBy("day").rowsBetween(Window.unboundedPreceding, -1))
    asked = daily.select("who", "day", before.alias("total")).where("total > 0")
    asked = asked.select("who", "day", F.explode(F.array_distinct(F.array(F.floor((F.col("total") - 1) / 2), F.floor(F.col("total") / 2)))).alias("k"))
    asked = asked.select("who", "day", F.col("k").alias("asked_k"), "k", F.lit(0).cast("long").alias("node"))
    none = F.array_repeat(F.lit(0).cast("long"), fan)
    for step in range(steps):
        shift = _STEP_BITS * (steps - 1 - step)
        node, child = F.shiftright("rank", shift + _STEP_BITS), F.shiftright("rank", shift) % fan
        parts = items.select("who", node.alias("node"), "day", child.alias("c"), "n").groupBy("who", "node", "day").agg(*[F.coalesce(F.sum(F.when(F.col("c") == c, F.col("n"))), F.lit(0)).alias(f"c{c}") for c in range(fan)])
        parts = parts.select("who", "node", "day", *[f"c{c}" for c in range(fan)], *[F.lit(None).cast("long").alias(x) for x in ("k", "asked_k")])
        both = parts.unionByName(asked.select("who", "node", "day", *[F.lit(0).cast("long").alias(f"c{c}") for c in range(fan)], "k", "asked_k"))
        run = Window.partitionBy("who", "node").orderBy("day", F.col("k").isNull()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
        found = both.withColumns({f"c{c}": F.sum(f"c{c}").over(run) for c in range(fan)}).where("k IS NOT NULL")
        # the first part up to which there are more than k values
        state = F.struct(F.lit(0).alias("at"), F.col("k").alias("left"), F.lit(False).alias("done"))
        walk = lambda s, n: F.when(s["done"] | (s["left"] < n), F.struct(s["at"].alias("at"), s["left"].alias("left"), F.lit(True).alias("done"))).otherwise(F.struct((s["at"] + 1).alias("at"), (s["left"] - n).alias("left"), F.lit(False).alias("done")))
        found = found.withColumn("_s", F.aggregate(F.array(*[F.col(f"c{c}") for c in range(fan)]), state, walk))
        asked = kept(found.select("who", "day", "asked_k", F.col("_s.left").alias("k"), (F.col("node") * fan + F.col("_s.at")).alias("node")), "asked")
    values = asked.join(ranks, (asked["who"] == ranks["who"]) & (asked["node"] == ranks["rank"])).select(asked["who"], "day", "value")
    return values.groupBy("who", "day").agg(F.avg("value").alias("median"))


def exact_medians(rows: DataFrame, keys: list[str], measures: list[str], share: float = 0.5, accuracy: int = 1000) -> DataFrame:
    """One row per key with the exact percentile ``share`` of each measure under its name; interpolated, nulls left out.

    A sketch first gives each key and measure two values that enclose the percentile for certain (its ranks are off by at
    most one in ``accuracy`` of the key's rows); rows below are only counted, and the few between are counted by distinct
    value and ordered. So no task gets the rows of a key, and all keys and measures take two passes.
    """
    fields = F.array(*[F.struct(F.lit(m).alias("_measure"), F.col(m).cast("double").alias("_v")) for m in measures])
    long = rows.select(*keys, F.explode(fields).alias("_m")).select(*keys, "_m.*").where("_v IS NOT NULL")
    groups = [*keys, "_measure"]
    wide = 2.0 / accuracy
    ends = long.groupBy(*groups).agg(
        F.percentile_approx("_v", [max(0.0, share - wide), min(1.0, share + wide)], accuracy).alias("_ends"), F.count(F.lit(1)).alias("_n"), F.min("_v").alias("_least"), F.max("_v").alias("_most")
    )
    position = (F.col("_n") - 1) * F.lit(float(share))
    small = F.col("_n") < 4 * accuracy  # the sketch's error is of the order of single rows then
    ends = ends.select(
        *[F.col(k).alias(f"_k{i}") for i, k in enumerate(groups)], "_n", position.alias("_position"),
        F.when(small, F.col("_least")).otherwise(F.col("_ends")[0]).alias("_lo"), F.when(small, F.col("_most")).otherwise(F.col("_ends")[1]).alias("_hi"),
    )
    same = F.lit(True)
    for i, k in enumerate(groups):
        same = same & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    cut = F.when(F.col("_v") < F.col("_lo"), F.lit(None).cast("double")).otherwise(F.col("_v"))
    # every row has its ends, and the outer side of a join is never broadcast: files of like values are a small part of their rows' size
    near = long.join(ends, same, "left").where("_v <= _hi OR _hi IS NULL").select(*groups, "_n", "_position", cut.alias("_v"))
    counted = near.groupBy(*groups, "_v").agg(F.count(F.lit(1)).alias("_c"), F.first("_position").alias("_position"))
    through = F.sum("_c").over(Window.partitionBy(*groups).orderBy(F.col("_v").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    placed = counted.withColumn("_through", through)
    at = lambda k: F.min(F.when(F.col("_v").isNotNull() & (F.col("_through") > k) & (F.col("_through") - F.col("_c") <= k), F.col("_v")))
    low, high = F.floor("_position"), F.ceil("_position")
    found = placed.groupBy(*groups).agg(at(low).alias("_a"), at(high).alias("_b"), F.first("_position").alias("_position"))
    value = F.col("_a") + (F.col("_b") - F.col("_a")) * (F.col("_position") - F.floor("_position"))
    certain = F.when(F.col("_a").isNull() | F.col("_b").isNull(), F.raise_error(F.lit("a percentile lies outside its sketch's bounds")).cast("double")).otherwise(value)
    return found.groupBy(*keys).agg(*[F.max(F.when(F.col("_measure") == m, certain)).alias(m) for m in measures])
