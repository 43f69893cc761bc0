"""Clusters of buys by different directors, found on one row a day.

A day on which several directors buy a ticker is connected in itself, so a ticker
and day is either one director's or several's, and two such days within reach are
linked unless both are the same single director's. In order of time the
components are contiguous, so a cut between two neighbouring days is decided by
them and by the nearest days of others. A ticker's window therefore holds one row
a day at most, however many buys it has; counts by ticker and day are made before
the shuffle, and buys look up their day's component afterwards.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_EPOCH = "1970-01-01"


def _day(c: str | Column) -> Column:
    return F.datediff(c, F.lit(_EPOCH).cast("date"))


def components(days: DataFrame, keys: list[str], reach: int = 30) -> DataFrame:
    """``days`` (keys, day, lo, hi: the least and greatest director; one row a day) of components of two directors or more, with first and last day."""
    order = Window.partitionBy(*keys).orderBy("day")
    lone = F.col("lo") == F.col("hi")
    same = lone & F.lag(lone).over(order) & (F.lag("lo").over(order) == F.col("lo"))
    rows = days.withColumn("_run", F.when(F.coalesce(same, F.lit(False)), 0).otherwise(1))
    before, after = F.lag("day").over(order), F.lead("day").over(order)
    rows = rows.withColumn("_ends", F.lead("_run").over(order) == 1).withColumn("_next", after).withColumn("_starts", F.when(F.col("_run") == 1, before))
    # the day before a run of one director's days, and the day after it
    earlier = F.last("_starts", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0))
    later = F.first(F.when(F.col("_ends"), F.col("_next")), ignorenulls=True).over(order.rowsBetween(0, Window.unboundedFollowing))
    rows = rows.withColumn("_earlier", earlier).withColumn("_later", later)
    near = lambda c: F.coalesce(c <= reach, F.lit(False))
    inside = near(F.col("_next") - F.col("_earlier")) | near(F.col("_later") - F.col("day"))
    linked = F.when(F.col("_ends"), near(F.col("_next") - F.col("day"))).otherwise(inside & F.col("_next").isNotNull())
    rows = rows.withColumn("_cut", F.when(F.coalesce(F.lag(linked).over(order), F.lit(False)), 0).otherwise(1))
    rows = rows.withColumn("_component", F.sum("_cut").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    whole = Window.partitionBy(*keys, "_component")
    sized = rows.withColumns({"_lo": F.min("lo").over(whole), "_hi": F.max("hi").over(whole), "first": F.min("day").over(whole), "last": F.max("day").over(whole)})
    return sized.where("_lo <> _hi").select(*days.columns, "first", "last")


def clusters(buys: DataFrame, days: int = 30) -> DataFrame:
    """The buys that are in a cluster of at least two directors, with cluster_id (ticker-first date)."""
    daily = buys.groupBy("ticker", "dt").agg(F.min("director").alias("lo"), F.max("director").alias("hi")).withColumn("day", _day("dt"))
    name = F.concat_ws("-", "ticker", F.date_add(F.lit(_EPOCH).cast("date"), F.col("first")).cast("string"))
    found = components(daily, ["ticker"], days).select("ticker", "dt", name.alias("cluster_id"))
    return buys.join(found, ["ticker", "dt"]).select(*buys.columns, "cluster_id")


def summaries(clustered: DataFrame) -> DataFrame:
    """One row per cluster: directors, buys, total, first and last date, span in days."""
    return clustered.groupBy("cluster_id", "ticker").agg(
        F.countDistinct("director").alias("n_directors"), F.count(F.lit(1)).alias("n_buys"), F.sum("value").alias("total_value"),
        F.min("dt").alias("first_date"), F.max("dt").alias("last_date"),
    ).withColumn("span_days", F.datediff("last_date", "first_date"))


def members(clustered: DataFrame) -> DataFrame:
    """One row per cluster and director: buys, total, first and last date."""
    return clustered.groupBy("cluster_id", "director").agg(
        F.count(F.lit(1)).alias("n_buys"), F.sum("value").alias("total_value"), F.min("dt").alias("first_date"), F.max("dt").alias("last_date")
    )


def listed(clustered: DataFrame) -> DataFrame:
    """One row per cluster: its directors and fingerprints in order. A row holds a whole cluster; ``members`` and the buys themselves do not."""
    return clustered.groupBy("cluster_id").agg(F.array_sort(F.collect_set("director")).alias("directors"), F.array_sort(F.collect_list("fingerprint")).alias("fingerprints"))


def conviction(n_directors, total_value, span_days):
    """3 a director, up to 8 for size, up to 2 for speed."""
    size = F.least(F.lit(4.0), F.greatest(F.lit(0.0), F.log10(total_value) - 3))
    return F.round(3 * n_directors + 2 * size + 2 * F.greatest(F.lit(0.0), (30 - span_days) / 30.0), 1)


def state(last_date, as_of: str):
    """active up to 90 days after the last buy, of which brewing from 30 on; else past."""
    age = F.datediff(F.lit(as_of).cast("date"), last_date)
    return F.when(age < 30, "active").when(age <= 90, "brewing").otherwise("past")


def as_of_grid(as_of: str, days: int = 30, weeks: int = 8) -> list[str]:
    """The day, the days before it and the weeks before it, as ISO dates."""
    import datetime

    now = datetime.date.fromisoformat(as_of)
    return sorted({(now - datetime.timedelta(days=n)).isoformat() for n in [*range(days), *range(0, 7 * weeks, 7)]})


def brewing_counts(buys: DataFrame, grid: list[str], back: int = 366, days: int = 30) -> DataFrame:
    """Rows (as_of, n_brewing): clusters whose last buy is 30 to 90 days back, found anew at each of a few days from what was announced by then.

    A buy more than ``back`` days old takes no part. Buys are first brought down to a row per ticker, trade date and announcement.
    """
    asked = F.array(*[F.lit(d).cast("date") for d in grid])
    daily = buys.groupBy("ticker", "dt", "announced").agg(F.min("director").alias("lo"), F.max("director").alias("hi"))
    seen = F.filter(asked, lambda d: (F.col("announced") <= d) & (F.datediff(d, F.col("dt")).between(0, back)))
    rows = daily.select("ticker", _day("dt").alias("day"), "lo", "hi", F.explode(seen).alias("as_of"))
    rows = rows.groupBy("as_of", "ticker", "day").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    last = components(rows, ["as_of", "ticker"], days).select("as_of", "ticker", "first", "last").distinct()
    counts = last.where((_day("as_of") - F.col("last")).between(30, 90)).groupBy("as_of").agg(F.count(F.lit(1)).alias("n"))
    every = buys.sparkSession.range(1).select(F.explode(asked).alias("as_of"))
    return every.join(counts, "as_of", "left").select("as_of", F.coalesce("n", F.lit(0)).alias("n_brewing"))


def brewing_trend(buys: DataFrame, as_of: str, days: int = 30, weeks: int = 8) -> DataFrame:
    """One row: brewing clusters now, their mean over the last days, and a count a week, oldest first; each count walk-forward."""
    counts = brewing_counts(buys, as_of_grid(as_of, days, weeks))
    now = F.lit(as_of).cast("date")
    age = F.datediff(now, "as_of")
    weekly = F.sort_array(F.collect_list(F.when((age % 7 == 0) & (age < 7 * weeks), F.struct("as_of", "n_brewing"))))
    return counts.agg(
        F.max(F.when(age == 0, F.col("n_brewing"))).alias("current"), F.round(F.avg(F.when(age < days, F.col("n_brewing"))), 4).alias("mean_30d"), F.transform(weekly, lambda s: s["n_brewing"]).alias("weekly")
    )
