"""Abnormal returns of firings over trading-day horizons, net of costs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators.timeseries import at_offsets, first_after, last_until, trade_index

HORIZONS = {"t1": 1, "t30": 21, "t90": 63, "t180": 126, "t365": 252}
FALLBACK = "^FTAS"


def entries(firings: DataFrame, indexed: DataFrame) -> DataFrame:
    """entry_dt, entry_idx, entry_close: the first trading day strictly after the announcement."""
    found = first_after(firings, indexed, "announced", take=["idx", "close"])
    return found.select(*firings.columns, F.col("found.dt").alias("entry_dt"), F.col("found.idx").alias("entry_idx"), F.col("found.close").alias("entry_close"))


def benchmark_entries(entered: DataFrame, indexed: DataFrame) -> DataFrame:
    """bench_idx, bench_close: the benchmark's last row on or before the entry day."""
    symbol = F.coalesce("benchmark_symbol", F.lit(FALLBACK))
    asked = entered.withColumn("_symbol", symbol)
    series = indexed.withColumnRenamed("ticker", "_symbol")
    found = last_until(asked, series, "entry_dt", take=["idx", "close"], key="_symbol")
    return found.select(*entered.columns, F.col("_symbol").alias("bench"), F.col("found.idx").alias("bench_idx"), F.col("found.close").alias("bench_close"))


def cost(is_aim: Column) -> Column:
    """Flat round-trip cost: 50 bps on the junior market, 100 bps elsewhere."""
    return F.when(is_aim, F.lit(0.005)).otherwise(F.lit(0.01))


def returns(firings: DataFrame, prices: DataFrame, horizons: dict[str, int] | None = None, min_history: int = 30) -> DataFrame:
    """One row per firing and horizon: raw, bench and abnormal return, net of cost; null where a series has ended.

    ``firings`` has fingerprint, ticker, announced, benchmark_symbol, is_aim. Firings
    without an entry day or with fewer than ``min_history`` rows before it are left out
    (see ``skipped``). A later close beyond four times, or under a quarter of, the entry
    is taken for an unadjusted split and gives no return.
    """
    indexed = trade_index(prices)
    entered = benchmark_entries(entries(firings, indexed).where(F.col("entry_idx") > min_history), indexed)
    own = at_offsets(entered, indexed, horizons or HORIZONS)
    later = indexed.select(F.col("ticker").alias("_b"), F.col("idx").alias("_i"), F.col("close").alias("bench_later"))
    joined = own.join(later, (F.col("bench") == F.col("_b")) & (F.col("bench_idx") + F.col("days") == F.col("_i")), "left").drop("_b", "_i")
    ratio = F.col("later_close") / F.col("entry_close")
    raw = F.when(ratio.between(0.25, 4), ratio - 1)
    market = F.col("bench_later") / F.col("bench_close") - 1
    return joined.withColumns({"raw": raw, "market": market}).withColumn("car", F.col("raw") - F.col("market")).withColumn("net", F.col("car") - cost(F.col("is_aim")))


def skipped(firings: DataFrame, prices: DataFrame, min_history: int = 30) -> DataFrame:
    """Firings that returns() leaves out, with the reason."""
    entered = entries(firings, trade_index(prices))
    reason = F.when(F.col("entry_idx").isNull(), "no_entry").when(F.col("entry_idx") <= min_history, "short_history")
    return entered.withColumn("reason", reason).where("reason IS NOT NULL")


def wide(returns: DataFrame, measures: tuple[str, ...] = ("raw", "market", "car", "net"), horizons: dict[str, int] | None = None) -> DataFrame:
    """One backtest row per firing and signal: entry, attributes, each measure per horizon, and windows_available."""
    names = list(horizons or HORIZONS)
    at = lambda h, m: F.max(F.when(F.col("horizon") == h, F.col(m)))
    keep = ["announced", "entry_dt", "entry_close", "bench", "is_aim", "ticker", "role", "value", "tier", "sector", "market_cap_gbp"]
    keep = [c for c in keep if c in returns.columns]
    out = returns.groupBy("fingerprint", "signal").agg(
        *[F.first(c).alias(c) for c in keep], *[at(h, m).alias(f"{m}_{h}") for m in measures for h in names], *[at(h, "later_dt").alias(f"exit_dt_{h}") for h in names]
    )
    ready = F.array_compact(F.array(*[F.when(F.col(f"net_{h}").isNotNull(), F.lit(h)) for h in names]))
    return out.withColumn("cost_bps", cost(F.col("is_aim")) * 10_000).withColumn("windows_available", F.array_join(ready, ","))


def split_violations(returns: DataFrame) -> DataFrame:
    """Rows that the split guard has taken out, with the ratio that gave them away."""
    ratio = F.col("later_close") / F.col("entry_close")
    return returns.where(F.col("raw").isNull() & ratio.isNotNull()).select("fingerprint", "ticker", "horizon", "entry_dt", "later_dt", ratio.alias("ratio"))


def mark_to_market(entered: DataFrame, prices: DataFrame) -> DataFrame:
    """mtm_pct: the latest close against the entry in per cent, less half a point on the junior market and one elsewhere."""
    latest = prices.groupBy("ticker").agg(F.max_by("close", "dt").alias("last_close"))
    mtm = (F.col("last_close") / F.col("entry_close") - 1) * 100 - F.when(F.col("is_aim"), 0.5).otherwise(1.0)
    return entered.join(latest, "ticker", "left").withColumn("mtm_pct", F.round(mtm, 2)).drop("last_close")
