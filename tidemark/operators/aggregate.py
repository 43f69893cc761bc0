"""Aggregations over event returns and dealings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.ranking import exact_medians, kept, numbered


def _pct(hits: Column) -> Column:
    return F.round(100.0 * F.count_if(hits) / F.count(F.lit(1)), 4)


def with_medians(rows: DataFrame, keys: list[str], aggregates: list[Column], medians: dict[str, str], accuracy: int | None = None, scale: float = 100, digits: int = 4) -> DataFrame:
    """Aggregates per key, and the median of each column (name of the result -> column) times ``scale``.

    Medians are exact, from ranges of values, so that no task gets the rows of a key; ``accuracy`` takes them by sketch in
    the same pass. For exact ones ``rows`` are written first, as they are read three times.
    """
    rounded = lambda c, name: F.round(c * scale, digits).alias(name)
    if accuracy is not None:
        return rows.groupBy(*keys).agg(*aggregates, *[rounded(F.percentile_approx(c, 0.5, accuracy), n) for n, c in medians.items()])
    rows = kept(rows, "medians")
    middle = exact_medians(rows, keys, list(dict.fromkeys(medians.values())))
    middle = middle.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], *[rounded(F.col(c), n) for n, c in medians.items()])
    same = F.lit(True)
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    return rows.groupBy(*keys).agg(*aggregates).join(middle, same, "left").drop(*[f"_k{i}" for i in range(len(keys))])


def scoreboard(returns: DataFrame, keys: list[str], measure: str, digits: int = 4, accuracy: int | None = None) -> DataFrame:
    """n, hit %, median and mean (in per cent) of a measure per key, matured rows only; ``accuracy`` takes medians by sketch."""
    m = F.col(measure)
    counts = [F.count(F.lit(1)).alias("n"), F.round(100.0 * F.count_if(m > 0) / F.count(F.lit(1)), digits).alias("hit_pct"), F.round(F.avg(m) * 100, digits).alias(f"mean_{measure}")]
    return with_medians(returns.where(m.isNotNull()).select(*keys, measure), keys, counts, {f"median_{measure}": measure}, accuracy, digits=digits)


def matured(returns: DataFrame, as_of: str, days: int = 365) -> DataFrame:
    """Firings of the trailing ``days`` whose horizon has passed by ``as_of``."""
    day = F.lit(as_of).cast("date")
    return returns.where(F.datediff(day, "announced").between(0, days) & (F.col("later_dt") <= day))


def base_rates(series: DataFrame, days: list[int]) -> DataFrame:
    """Share of rising windows of so many rows of one series."""
    w = Window.partitionBy("ticker").orderBy("dt")
    wide = series.select(*[(F.lead("close", d).over(w) / F.col("close") - 1).alias(f"r{d}") for d in days])
    long = wide.select(F.explode(F.array(*[F.struct(F.lit(d).alias("days"), F.col(f"r{d}").alias("r")) for d in days])).alias("x")).select("x.*").where("r IS NOT NULL")
    return long.groupBy("days").agg(F.count(F.lit(1)).alias("n"), _pct(F.col("r") > 0).alias("positive_pct"))


def status(matured: DataFrame, as_of: str, weeks: int = 4, gated: tuple[str, ...] = ()) -> DataFrame:
    """gated, live, review or kill? by the medians of the current and the prior window; fewer than five firings are for review."""
    age = F.datediff(F.lit(as_of).cast("date"), "announced")
    now, before = age.between(0, weeks * 7 - 1), age.between(weeks * 7, weeks * 14 - 1)
    rows = matured.select("signal", F.when(now, F.col("car")).alias("now"), F.when(before, F.col("car")).alias("before"), now.alias("recent"))
    m = with_medians(rows, ["signal"], [F.count_if("recent").alias("n")], {"cur": "now", "prior": "before"}, scale=1, digits=12)
    state = F.when(F.col("signal").isin(*gated, ""), "gated").when(F.col("n") < 5, "review").when((F.col("cur") < 0) & (F.col("prior") < 0), "kill?").when(F.col("cur") < 0, "review").otherwise("live")
    return m.select("signal", "n", state.alias("status"))


def cohort_tiles(rows: DataFrame, dims: dict[str, Column], accuracy: int | None = None) -> DataFrame:
    """n, hit %, median and outlier flag per dimension, key, horizon and lookback, in one pass over the rows."""
    tags = F.explode(F.array(*[F.struct(F.lit(n).alias("dim"), c.alias("key")) for n, c in dims.items()]))
    long = rows.withColumn("_t", tags).select("_t.dim", "_t.key", "horizon", "lookback", "car")
    counts = [F.count(F.lit(1)).alias("n"), _pct(F.col("car") > 0).alias("hit_pct"), (F.max(F.abs("car")) > 2.0).alias("outlier")]
    return with_medians(long, ["dim", "key", "horizon", "lookback"], counts, {"median_car": "car"}, accuracy)


def drill(matured: DataFrame, key: str, k: int = 10, least: int = 3) -> DataFrame:
    """Counts, hit %, medians and the k best and worst firings per key; n_tickers_3 counts tickers with ``least`` firings or more."""
    matured = kept(matured.select(key, "fingerprint", "ticker", "car", "market"), "drill")
    a = F.row_number().over(Window.partitionBy(key).orderBy(F.desc("car"), "fingerprint"))
    b = F.row_number().over(Window.partitionBy(key).orderBy("car", "fingerprint"))
    # each task keeps only the k best and worst of what it meets
    best = matured.withColumn("a", a).where(F.col("a") <= k).groupBy(key).agg(F.transform(F.sort_array(F.collect_list(F.struct("a", "fingerprint"))), lambda s: s["fingerprint"]).alias(f"top{k}"))
    worst = matured.withColumn("b", b).where(F.col("b") <= k).groupBy(key).agg(F.transform(F.sort_array(F.collect_list(F.struct("b", "fingerprint"))), lambda s: s["fingerprint"]).alias(f"bottom{k}"))
    tickers = matured.groupBy(key, "ticker").agg(F.count(F.lit(1)).alias("n")).groupBy(key).agg(F.count(F.lit(1)).alias("n_tickers"), F.count_if(F.col("n") >= least).alias(f"n_tickers_{least}"))
    counts = with_medians(matured, [key], [F.count(F.lit(1)).alias("n"), _pct(F.col("car") > 0).alias("hit_pct")], {"median_car": "car", "median_market": "market"})
    return counts.join(tickers, key).join(best, key).join(worst, key)


def monthly(returns: DataFrame) -> DataFrame:
    """Per signal, month of announcement and horizon: counts, mean, extremes and hits."""
    return returns.groupBy("signal", F.trunc("announced", "month").alias("month"), "horizon").agg(
        F.count(F.lit(1)).alias("n_all"), F.count("car").alias("n"), F.avg("car").alias("mean"), F.min("car").alias("lo"), F.max("car").alias("hi"), F.count_if(F.col("car") > 0).alias("hits")
    )


def shares(matured: DataFrame) -> DataFrame:
    """Each ticker's share of its signal's absolute return, equal shares where that is zero."""
    t = matured.groupBy("signal", "ticker").agg(F.sum("car").alias("r"))
    own = Window.partitionBy("signal")
    total = F.sum(F.abs("r")).over(own)
    share = F.when(total > 0, F.abs("r") / total).otherwise(1 / F.count(F.lit(1)).over(own))
    return t.withColumn("share", share).withColumn("dominated", F.max("share").over(own) > 0.5)


def buy_sell(dealings: DataFrame) -> DataFrame:
    """Monthly value and number of buys and sells; sells are negative."""
    kind = lambda k, c: F.when(F.col("type") == k, c)
    return dealings.groupBy(F.trunc("announced", "month").alias("month")).agg(
        F.sum(kind("BUY", F.col("value"))).alias("bought"), (-F.sum(kind("SELL", F.col("value")))).alias("sold"), F.count(kind("BUY", F.lit(1))).alias("n_buys"), F.count(kind("SELL", F.lit(1))).alias("n_sells")
    )


def baskets(returns: DataFrame, config: DataFrame, proven: int = 30, small_cap: float = 500e6, baseline: str = "all firings") -> DataFrame:
    """Medians and share of gains per basket of signals, and of all firings, ranked by median t90; the configuration is a small fixed table."""
    fits = F.expr("array_contains(signals, signal)") & (~F.col("small") | (F.col("market_cap_gbp") < small_cap))
    rows = returns.where("horizon IN ('t30', 't90')").select("fingerprint", "signal", "horizon", "net", "market_cap_gbp")
    inside = rows.join(F.broadcast(config), fits).select("basket", "fingerprint", "horizon", "net")
    every = inside.unionByName(rows.select(F.lit(baseline).alias("basket"), "fingerprint", "horizon", "net"))
    per = every.groupBy("basket", "fingerprint").agg(*[F.max(F.when(F.col("horizon") == h, F.col("net"))).alias(h) for h in ("t30", "t90")])
    counts = [F.count(F.lit(1)).alias("n"), F.round(100.0 * F.count_if(F.col("t90") > 0) / F.count("t90"), 2).alias("positive_pct"), (F.count("t90") >= proven).alias("proven")]
    out = with_medians(per, ["basket"], counts, {"median_t30": "t30", "median_t90": "t90"}, digits=2)
    ranked = F.row_number().over(Window.partitionBy(F.col("basket") == baseline).orderBy(F.desc_nulls_last("median_t90"), "basket"))
    return out.withColumn("place", F.when(F.col("basket") != baseline, ranked))


def leaderboard(returns: DataFrame, horizons: tuple[str, ...] = ("t30", "t60", "t90", "t360"), primary: str = "t90", least: int = 3, accuracy: int | None = None) -> DataFrame:
    """Directors with ``least`` firings matured at the primary horizon, ranked by their median net return there; counts, medians and means per horizon."""
    at = lambda h: F.max(F.when(F.col("horizon") == h, F.col("net")))
    per = returns.groupBy("director", "fingerprint").agg(F.first("ticker").alias("ticker"), F.first("value").alias("value"), *[at(h).alias(h) for h in horizons])
    counts = [
        F.count(F.lit(1)).alias("n_buys"), F.countDistinct("ticker").alias("n_tickers"), F.round(F.sum("value"), 2).alias("total"),
        F.round(F.count_if(F.col(primary) > 0) / F.count(primary), 4).alias("win_rate"), *[F.count(h).alias(f"n_{h}") for h in horizons],
        *[F.round(F.avg(h), 5).alias(f"mean_{h}") for h in horizons],
    ]
    d = with_medians(per, ["director"], counts, {f"median_{h}": h for h in horizons}, accuracy, scale=1, digits=5).where(F.col(f"n_{primary}") >= least)
    return numbered(kept(d), [f"median_{primary}", "director"], "place", descending=(f"median_{primary}",))


def concentration(fired: DataFrame, returns: DataFrame) -> DataFrame:
    """Per signal: how much its busiest ticker and month hold of its firings, and its best firing of its positive return."""
    ticker = fired.groupBy("signal", "ticker").agg(F.count(F.lit(1)).alias("n")).groupBy("signal").agg(F.max("n").alias("top_ticker_n"), F.round(F.max("n") / F.sum("n"), 6).alias("top_ticker_share"))
    month = fired.groupBy("signal", F.trunc("announced", "month").alias("mo")).agg(F.count(F.lit(1)).alias("n")).groupBy("signal").agg(F.round(F.max("n") / F.sum("n"), 6).alias("top_month_share"))
    won = returns.where("car > 0").groupBy("signal").agg(F.round(F.max("car") / F.sum("car"), 6).alias("top_winner_share"))
    return ticker.join(month, "signal").join(won, "signal", "left")


def feed(dealings: DataFrame, fired: DataFrame, marked: DataFrame, severity: dict[str, int], as_of: str, days: int = 7) -> DataFrame:
    """Dealings of the day and of the ``days`` before with their signals and mark to market, strongest signal first, then by value."""
    from tidemark.operators.clean import lookup

    ranked = fired.withColumn("rank", F.coalesce(lookup(F.col("signal"), severity), F.lit(99)))
    per = ranked.groupBy("fingerprint").agg(F.min("rank").alias("severity"), F.transform(F.sort_array(F.collect_list(F.struct("rank", "signal"))), lambda s: s["signal"]).alias("signals_fired"))
    age = F.datediff(F.lit(as_of).cast("date"), "announced")
    recent = dealings.where(age.between(0, days)).withColumn("section", F.when(age == 0, "today").otherwise("this_week"))
    out = recent.join(per, "fingerprint").join(marked.select("fingerprint", "mtm_pct").distinct(), "fingerprint", "left")
    return out.orderBy(F.asc("severity"), F.desc("value"), "fingerprint").select("section", "fingerprint", "ticker", "value", "severity", "signals_fired", "mtm_pct")


def company_status(summaries: DataFrame, fired: DataFrame, results: DataFrame, as_of: str) -> DataFrame:
    """Per ticker: active and brewing clusters, last firing and whether it is within a week, past clusters, and past results dates."""
    day = F.lit(as_of).cast("date")
    age = F.datediff(day, "last_date")
    c = summaries.where(F.col("last_date") <= day).groupBy("ticker").agg(
        F.count_if(age < 30).alias("n_active"), F.count_if(age.between(30, 90)).alias("n_brewing"), F.count_if(age > 90).alias("n_past"), F.max("last_date").alias("last_cluster")
    )
    f = fired.where(F.col("fired_at") <= day).groupBy("ticker").agg(F.max("fired_at").alias("last_fired"))
    r = results.where(F.col("report_date") <= day).groupBy("ticker").agg(F.countDistinct("report_date").alias("n_results"), F.max("report_date").alias("last_results"))
    out = c.join(f, "ticker", "full").join(r, "ticker", "full")
    zero = lambda n: F.coalesce(n, F.lit(0)).alias(n)
    week = F.coalesce(F.datediff(day, "last_fired") <= 7, F.lit(False))
    return out.select("ticker", zero("n_active"), zero("n_brewing"), zero("n_past"), "last_cluster", "last_fired", week.alias("fired_this_week"), zero("n_results"), "last_results")
