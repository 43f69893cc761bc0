"""Point-in-time features of firings; each sees only what was known by the announcement."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.ranking import median_before
from tidemark.operators.timeseries import first_from, last_before, last_until


def short_interest(firings: DataFrame, shorts: DataFrame) -> DataFrame:
    """short_pct: the sum of each holder's latest disclosure strictly before the announcement; null without any.

    A disclosure changes its holder's position by the difference to the one before; these changes, summed along the
    ticker's days, are the series of the total, which an as-of join looks up: no firing meets a disclosure history.
    """
    held = Window.partitionBy("ticker", "holder").orderBy("position_date")
    change = F.col("net_short_pct") - F.coalesce(F.lag("net_short_pct").over(held), F.lit(0.0))
    daily = shorts.withColumn("change", change).groupBy("ticker", "position_date").agg(F.sum("change").alias("change"))
    along = Window.partitionBy("ticker").orderBy("position_date").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    total = daily.withColumn("short_pct", F.sum("change").over(along))
    found = last_before(firings, total, "announced", when="position_date", take=["short_pct"])
    return found.withColumn("short_pct", F.col("found.short_pct")).drop("found")


def latest_pay(firings: DataFrame, pay: DataFrame, take: tuple[str, ...] = ("fy_end", "pay_gbp", "pay_status")) -> DataFrame:
    """found: the pay row of the director last published on or before the announcement."""
    keyed = firings.withColumn("who", F.struct("ticker", "director"))
    rows = pay.withColumn("who", F.struct("ticker", "director"))
    return last_until(keyed, rows, "announced", when="ar_published_at", take=list(take), key="who").drop("who")


def salary_multiple(value: Column, pay: Column, amount: str = "pay_gbp") -> Column:
    """Value over total pay, or over the pay's ``amount``; null unless the pay was found and is usable."""
    return F.when((pay["pay_status"] == "ok") & (pay[amount] > 0), value / pay[amount])


def post_results(firings: DataFrame, results: DataFrame, days: int = 14) -> DataFrame:
    """days_since_results and post_results (within ``days``); both null without confirmed results before."""
    confirmed = results.where("confidence = 'confirmed'").select("ticker", "report_date").distinct()
    found = last_until(firings, confirmed, "announced", when="report_date")
    since = F.datediff("announced", "found.report_date")
    return found.withColumn("days_since_results", since).withColumn("post_results", F.col("days_since_results") <= days).drop("found")


def pre_results(firings: DataFrame, results: DataFrame) -> DataFrame:
    """days_to_results: to the next results on or after the trade."""
    found = first_from(firings, results.select("ticker", "report_date").distinct(), "dt", when="report_date")
    return found.withColumn("days_to_results", F.datediff("found.report_date", "dt")).drop("found")


def reversal(buys: DataFrame, dealings: DataFrame, days: int = 365) -> DataFrame:
    """net_prior_shares and reversal: bought minus sold in the ``days`` before, the announcement day left out; 0 and false without any."""
    signed = F.when(F.col("type") == "BUY", F.col("shares")).when(F.col("type") == "SELL", -F.col("shares")).otherwise(F.lit(0))
    day = F.datediff("announced", F.lit("1970-01-01").cast("date"))
    daily = dealings.groupBy("director", "ticker", day.alias("day")).agg(F.sum(signed).alias("net"))
    recent = Window.partitionBy("director", "ticker").orderBy("day").rangeBetween(-days, -1)
    net = daily.withColumn("net_prior_shares", F.coalesce(F.sum("net").over(recent), F.lit(0))).drop("net")
    out = buys.withColumn("day", day).join(net, ["director", "ticker", "day"], "left").drop("day")
    return out.withColumn("reversal", F.col("net_prior_shares") < 0)


def routine(buys: DataFrame) -> DataFrame:
    """routine_class by the months of the director's earlier buys in the ticker.

    Under two earlier years: insufficient; a month seen in a majority of the years
    (two at least): routine; else opportunistic. Only the first buy of a month changes
    these counts, so they run along at most twelve days a year of each director and ticker.
    """
    who = F.struct("director", "ticker")
    days = buys.where("announced IS NOT NULL").select(who.alias("who"), F.year("announced").alias("y"), F.month("announced").alias("m"), F.col("announced").alias("day"))
    first = days.groupBy("who", "y", "m").agg(F.min("day").alias("day"))
    along = Window.partitionBy("who").orderBy("day").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    month = Window.partitionBy("who", "m").orderBy("day").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    new_year = F.when(F.row_number().over(Window.partitionBy("who", "y").orderBy("day")) == 1, 1).otherwise(0)
    seen = first.withColumn("new_year", new_year).withColumn("hits", F.count(F.lit(1)).over(month))
    seen = seen.withColumn("n_years", F.sum("new_year").over(along)).withColumn("best", F.max("hits").over(along))
    out = last_before(buys.withColumn("who", who), seen, "announced", when="day", take=["n_years", "best"], key="who")
    n_years, best = F.coalesce("found.n_years", F.lit(0)), F.col("found.best")
    need = F.greatest(F.lit(2), F.floor(n_years / 2) + 1)
    kind = F.when(n_years < 2, "insufficient").when(best >= need, "routine").otherwise("opportunistic")
    return out.select("fingerprint", n_years.alias("n_years"), kind.alias("routine_class"))


def relative_size(buys: DataFrame) -> DataFrame:
    """relative_size: value over the median of the director's buys of earlier days; null without any."""
    medians = median_before(buys, "director", "announced", "value").select(F.col("who").alias("director"), F.col("day").alias("announced"), "median")
    return buys.join(medians, ["director", "announced"], "left").withColumn("relative_size", F.col("value") / F.col("median")).select(*buys.columns, "relative_size")


def expected_results(results: DataFrame) -> DataFrame:
    """Next results of each ticker and type, marked est: preliminary and interim ones a year after the last confirmed ones of the type, trading statements half a year after; known ones left out."""
    last = results.where("confidence = 'confirmed'").groupBy("ticker", "report_type").agg(F.max("report_date").alias("last_date"))
    steps = F.explode(F.when(F.col("report_type") == "TRADING_STMT", F.array(F.lit(6))).otherwise(F.array(F.lit(12))))
    expected = last.where("report_type IN ('PRELIM', 'INTERIM', 'TRADING_STMT')").select("ticker", "report_type", "last_date", steps.alias("months"))
    expected = expected.withColumn("expected", F.expr("add_months(last_date, months)"))
    newest = results.groupBy(F.col("ticker").alias("_t"), F.col("report_type").alias("_r")).agg(F.max("report_date").alias("_newest"))
    known = (F.col("ticker") == F.col("_t")) & (F.col("report_type") == F.col("_r")) & (F.col("_newest") >= F.col("expected"))
    return expected.join(newest, known, "left_anti").select("ticker", "report_type", "expected", F.lit("est").alias("confidence"))


def routine_by_gaps(buys: DataFrame, limit: float = 0.5) -> DataFrame:
    """Per director and ticker with three buys or more: whether the gaps between buys vary little."""
    order = Window.partitionBy("director", "ticker").orderBy("announced", "fingerprint")
    gaps = buys.withColumn("gap", F.datediff("announced", F.lag("announced").over(order)))
    out = gaps.groupBy("director", "ticker").agg(F.count(F.lit(1)).alias("n_buys"), F.avg("gap").alias("mean_gap"), F.stddev_samp("gap").alias("sd_gap")).where("n_buys >= 3")
    return out.withColumn("is_routine", F.coalesce(F.col("sd_gap") / F.nullif(F.col("mean_gap"), F.lit(0.0)) < limit, F.lit(False)))


def spread_bps(prices: DataFrame, rows: int = 21, low: float = 5.0, high: float = 450.0) -> DataFrame:
    """Corwin-Schultz high-low spread in basis points, averaged over ``rows`` trading days and clamped."""
    order = Window.partitionBy("ticker").orderBy("dt")
    p = prices.withColumn("h1", F.lag("high").over(order)).withColumn("l1", F.lag("low").over(order))
    one = F.pow(F.log(F.col("high") / F.col("low")), 2)
    beta = one + F.pow(F.log(F.col("h1") / F.col("l1")), 2)
    gamma = F.pow(F.log(F.greatest("high", "h1") / F.least("low", "l1")), 2)
    k = F.lit(3 - 2 * 2**0.5)
    alpha = (F.sqrt(2 * beta) - F.sqrt(beta)) / k - F.sqrt(gamma / k)
    spread = 2 * (F.exp(alpha) - 1) / (1 + F.exp(alpha)) * 10_000
    daily = p.withColumn("daily", F.when(F.col("h1").isNotNull(), F.greatest(F.lit(0.0), spread)))
    mean = F.avg("daily").over(order.rowsBetween(1 - rows, 0))
    return daily.withColumn("spread_bps", F.least(F.lit(high), F.greatest(F.lit(low), mean))).select("ticker", "dt", "close", "spread_bps")
