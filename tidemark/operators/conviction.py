"""Conviction score of a buy: five strengths between 0 and 1, weighed over those known, and a sector guardrail."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.clean import lookup, role_tier
from tidemark.operators.features import pre_results
from tidemark.operators.ranking import below_before, kept
from tidemark.operators.timeseries import last_of_each, last_until

SENIORITY = {"T1a": 1.0, "T7": 1.0, "T1b": 0.9, "T2": 0.7, "T6": 0.5, "T3": 0.3}
WEIGHTS = {"who": 0.25, "size": 0.25, "small": 0.20, "timing": 0.15, "fall": 0.15}


def _clamp(c: Column, low: float = 0.0, high: float = 1.0) -> Column:
    return F.when(c.isNotNull(), F.least(F.lit(high), F.greatest(F.lit(low), c)))


def _senior(buys: DataFrame) -> DataFrame:
    """Per ticker and day of announcement: how senior the most senior buyer so far is."""
    daily = buys.groupBy("ticker", F.col("announced").alias("day")).agg(F.max(lookup(role_tier(F.col("role")), SENIORITY)).alias("best"))
    so_far = Window.partitionBy("ticker").orderBy("day").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return daily.withColumn("senior", F.max("best").over(so_far))


def scores(firings: DataFrame, buys: DataFrame, prices: DataFrame, results: DataFrame, meta: DataFrame) -> DataFrame:
    """``firings`` (with tier, sector, market_cap_gbp) with the strengths, guard and score.

    Everything is as of the announcement: later rows of any table change nothing. Sizes
    are judged against all buys announced before, by the share of them that are smaller;
    a size without history is unknown.
    """
    order = Window.partitionBy("ticker").orderBy("dt")
    moved = prices.withColumn("m3", F.col("close") / F.lag("close", 63).over(order) - 1)
    series = kept(moved.select("ticker", "dt", "m3", F.avg(F.col("close") * F.col("volume")).over(order.rowsBetween(-20, 0)).alias("traded")), "series")
    rows = kept(pre_results(firings, results), "firings")
    past = kept(buys.select("ticker", "announced", "value", "role"), "buys")
    # all that hangs on ticker and day of announcement, found once for firings and history
    asked = rows.select("ticker", "announced").union(past.select("ticker", "announced")).distinct()
    confirmed = results.where("confidence = 'confirmed'").select("ticker", "report_date").distinct()
    facts = last_of_each(asked, "announced", {"_price": (series, "dt", ["m3", "traded"]), "_results": (confirmed, "report_date", []), "_senior": (_senior(past), "day", ["senior"])})
    since = F.datediff("announced", "_results.report_date")
    facts = kept(facts.select("ticker", "announced", "_price.m3", "_price.traded", since.alias("days_since_results"), "_senior.senior"), "facts")
    with_facts = lambda df: df.join(facts, ["ticker", "announced"], "left").withColumn("to_traded", F.col("value") / F.col("traded"))
    rows = with_facts(rows).withColumn("post_results", F.col("days_since_results") <= 14)
    # closely associated people count as the most senior director who has bought at the company so far
    who = F.when(F.col("tier") == "T5", F.col("senior")).otherwise(lookup(F.col("tier"), SENIORITY))
    measures = {"value": "_by_value", "to_traded": "_by_traded"}
    ranks = below_before(with_facts(past), rows, "announced", list(measures))
    for measure, name in measures.items():
        known = ranks.where(F.col("measure") == measure).select(F.col("day").alias("announced"), F.col("value").alias(measure), (F.col("n_below") / F.nullif("n_before", F.lit(0))).alias(name))
        rows = rows.join(known, ["announced", measure], "left")
    size = (F.col("_by_value") + F.col("_by_traded")) / 2
    low, high = 20e6, 10e9
    small = _clamp(1.0 - 0.9 * (F.log10("market_cap_gbp") - F.log10(F.lit(low))) / (F.log10(F.lit(high)) - F.log10(F.lit(low))), 0.1)
    ahead, since = F.col("days_to_results"), F.col("days_since_results")
    timing = F.when(ahead <= 30, 0.0).when(ahead <= 45, 0.8).when(since <= 14, 1.0).when(since.isNotNull() | ahead.isNotNull(), 0.3)
    rows = rows.withColumns({"who": who, "size": size, "small": small, "timing": timing, "fall": _clamp(0.5 - F.col("m3"))}).drop("_by_value", "_by_traded")
    # how the sector's tickers have moved, on its last trading day
    sectors = series.join(meta.select("ticker", "sector"), "ticker").groupBy("sector", "dt").agg(F.avg("m3").alias("moved")).where("moved IS NOT NULL")
    rows = last_until(rows, sectors, "announced", take=["moved"], key="sector").withColumn("moved", F.col("found.moved")).drop("found")
    rows = rows.withColumn("guard", F.when(F.col("moved") > 0, 1 - 0.3 * F.least(F.lit(1.0), F.col("moved") / 0.2)).otherwise(1.0))
    total = sum((F.coalesce(F.col(n), F.lit(0.0)) * w for n, w in WEIGHTS.items()), F.lit(0.0))
    known = sum((F.when(F.col(n).isNotNull(), w).otherwise(0.0) for n, w in WEIGHTS.items()), F.lit(0.0))
    return rows.withColumn("score", F.round(100 * F.col("guard") * total / known, 4))


def band(score: Column) -> Column:
    return F.when(score >= 80, "Exceptional").when(score >= 60, "High").when(score >= 40, "Moderate").otherwise("Low")
