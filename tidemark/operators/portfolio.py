"""Paper positions: sizing, opening and closing, and daily value."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.ranking import kept
from tidemark.operators.timeseries import extremes_ahead, last_until

SCHEMES = ("flat", "log", "tier", "linear", "capped")


def position_size(value: Column, scheme: str, tier: Column | None = None) -> Column:
    """Notional of a position under one of five schemes."""
    if scheme == "flat":
        return F.lit(1000.0)
    if scheme == "log":
        return F.least(F.lit(5000.0), F.greatest(F.lit(500.0), 1000 * F.log10(value / 50_000)))
    if scheme == "tier":
        return F.when(tier.isin("T1a", "T1b"), 3000.0).when(tier.isin("T2", "T7"), 2000.0).otherwise(1000.0)
    if scheme == "linear":
        return 0.005 * value
    if scheme == "capped":
        return F.least(value, F.lit(50_000.0))
    raise ValueError(f"unknown sizing scheme: {scheme}")


def positions(entered: DataFrame, indexed: DataFrame, as_of: str, hold: int = 21, notional: Column | None = None) -> DataFrame:
    """Entry and exit of each firing and its state at ``as_of``: planned, open or closed."""
    exits = indexed.select(F.col("ticker").alias("_t"), (F.col("idx") - hold).alias("_i"), F.col("dt").alias("exit_dt"), F.col("close").alias("exit_close"))
    out = entered.join(exits, (F.col("ticker") == F.col("_t")) & (F.col("entry_idx") == F.col("_i")), "left").drop("_t", "_i")
    day = F.lit(as_of).cast("date")
    state = F.when(F.col("entry_dt") > day, "planned").when(F.col("exit_dt") <= day, "closed").otherwise("open")
    return out.withColumn("status", state).withColumn("notional", notional if notional is not None else F.lit(1000.0))


def summary(held: DataFrame, indexed: DataFrame, as_of: str) -> DataFrame:
    """Open and closed positions: count, notional, mean return in per cent (open ones at the last close by ``as_of``), winners and losers."""
    last = indexed.where(F.col("dt") <= F.lit(as_of).cast("date")).groupBy("ticker").agg(F.max_by("close", "dt").alias("now_close"))
    rows = held.where("status <> 'planned'").join(last, "ticker", "left")
    gain = F.when(F.col("status") == "closed", F.col("exit_close")).otherwise(F.col("now_close")) / F.col("entry_close") - 1
    return rows.withColumn("gain", gain).groupBy("status").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.sum("notional"), 2).alias("notional"), F.round(F.avg("gain") * 100, 4).alias("mean_pct"),
        F.count_if(F.col("gain") > 0).alias("winners"), F.count_if(F.col("gain") < 0).alias("losers"),
    )


def guarded(entered: DataFrame, prices: DataFrame, as_of: str, hold: int = 21, tickers: tuple[str, ...] = (), issuers: DataFrame | None = None, least: float = 0.25, most: float = 4.0) -> DataFrame:
    """``entered`` with excluded: excluded_ticker, excluded_issuer, excluded_split, or null if the position counts.

    ``tickers`` are left out, and those in ``issuers`` (ticker). A position is taken for one across an unadjusted split if
    any close while it is held, up to its exit or ``as_of``, is more than ``most`` or less than ``least`` times its entry.
    """
    seen = prices.where(F.col("dt") <= F.lit(as_of).cast("date"))
    ahead = extremes_ahead(seen, "close", hold).select(F.col("ticker").alias("_t"), F.col("dt").alias("_d"), "least_ahead", "most_ahead")
    rows = entered.join(ahead, (F.col("ticker") == F.col("_t")) & (F.col("entry_dt") == F.col("_d")), "left").drop("_t", "_d")
    if issuers is None:
        rows = rows.withColumn("_issuer", F.lit(None).cast("boolean"))
    else:
        rows = rows.join(issuers.select("ticker", F.lit(True).alias("_issuer")).distinct(), "ticker", "left")
    split = (F.col("most_ahead") / F.col("entry_close") > most) | (F.col("least_ahead") / F.col("entry_close") < least)
    reason = F.when(F.col("ticker").isin(*tickers, ""), "excluded_ticker").when(F.col("_issuer"), "excluded_issuer").when(split, "excluded_split")
    return rows.withColumn("excluded", reason).select(*entered.columns, "excluded")


GUARDS = ("excluded_split", "excluded_ticker", "excluded_issuer")


def guard_counts(checked: DataFrame, as_of: str, keys: list[str] | None = None) -> DataFrame:
    """How many positions entered by ``as_of`` each guard has left out."""
    rows = checked.where(F.col("entry_dt") <= F.lit(as_of).cast("date"))
    return rows.groupBy(*(keys or [])).agg(*[F.count_if(F.coalesce(F.col("excluded") == g, F.lit(False))).alias(g) for g in GUARDS])


def tracker(entered: DataFrame, prices: DataFrame, as_of: str, hold: int = 21, stake: float = 10_000.0, keys: list[str] | None = None) -> DataFrame:
    """The strategy against its index: per key and day of the index, the value of a stake in each firing, and of the same stakes in the index.

    A position is cash before its entry, marked to market (last close on or before the day) while it is open, and worth
    its exit afterwards; the equity leg pays its cost at entry, the index leg none. ``entered`` has fingerprint, ticker,
    bench, is_aim, entry_dt, entry_idx, entry_close, bench_close; leave out what ``guarded`` excludes. Entries and exits
    are summed per security and day first; cash runs along the calendar, and a security is marked only on the days from
    an entry to the exit after which none of it is held.
    """
    keys = keys or []
    day = F.lit(as_of).cast("date")
    rows = entered.where(F.col("entry_dt") <= day).withColumn("fee", F.when(F.col("is_aim"), 0.005).otherwise(0.01))
    exits = prices.withColumn("_i", F.row_number().over(Window.partitionBy("ticker").orderBy("dt"))).select(
        F.col("ticker").alias("_t"), (F.col("_i") - hold).alias("_i"), F.col("dt").alias("exit_dt"), F.col("close").alias("exit_close")
    )
    rows = rows.join(exits, (F.col("ticker") == F.col("_t")) & (F.col("entry_idx") == F.col("_i")), "left").drop("_t", "_i")
    rows = rows.withColumn("exit_dt", F.when(F.col("exit_dt") <= day, F.col("exit_dt")))
    # the index leg leaves at the index's last close on or before the exit
    index = prices.select(F.col("ticker").alias("bench"), "dt", F.col("close").alias("bench_out"))
    rows = last_until(rows, index, "exit_dt", take=["bench_out"], key="bench").withColumn("bench_out", F.col("found.bench_out")).drop("found")
    shares, units = F.lit(stake) * (1 - F.col("fee")) / F.col("entry_close"), F.lit(stake) / F.col("bench_close")
    rows = kept(rows.select(*keys, "ticker", "bench", "entry_dt", "exit_dt", "exit_close", "bench_out", shares.alias("shares"), units.alias("units")))
    move = lambda at, leg, security, amount, cash, n: F.when(F.col(at).isNotNull(), F.struct(F.col(at).alias("dt"), F.lit(leg).alias("leg"), F.col(security).alias("security"), amount.alias("amount"), cash.alias("cash"), F.lit(n).alias("n")))
    moves = [
        move("entry_dt", "equity", "ticker", F.col("shares"), F.lit(-stake), 1), move("exit_dt", "equity", "ticker", -F.col("shares"), F.col("shares") * F.col("exit_close"), -1),
        move("entry_dt", "index", "bench", F.col("units"), F.lit(-stake), 1), move("exit_dt", "index", "bench", -F.col("units"), F.col("units") * F.col("bench_out"), -1),
    ]
    # one row a key, leg, security and day: bounded by the calendar from here on
    each = rows.select(*keys, F.explode(F.array_compact(F.array(*moves))).alias("_m")).select(*keys, "_m.*")
    daily = kept(each.groupBy(*keys, "leg", "security", "dt").agg(F.sum("amount").alias("amount"), F.sum("cash").alias("cash"), F.sum("n").alias("n")))
    first = daily.agg(F.min("dt").alias("first"))
    calendar = kept(prices.where((F.col("dt") <= day) & F.col("ticker").startswith("^")).select("dt").distinct().crossJoin(F.broadcast(first)).where("dt >= first").select("dt"))
    # cash, and how many positions are open, per key and day
    flows = daily.groupBy(*keys, "leg", "dt").agg(F.sum("cash").alias("cash"), F.sum("n").alias("n"))
    days = flows.select(*keys, "leg").distinct().crossJoin(calendar).unionByName(flows.select(*keys, "leg", "dt")).distinct()
    along = Window.partitionBy(*keys, "leg").orderBy("dt").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    run = days.join(flows, [*keys, "leg", "dt"], "left").withColumns({c: F.coalesce(F.sum(c).over(along), F.lit(0)) for c in ("cash", "n")})
    # what is held of each security, from one move to the next
    own = Window.partitionBy(*keys, "leg", "security").orderBy("dt")
    upto = own.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    spans = daily.select(*keys, "leg", "security", "dt", F.sum("amount").over(upto).alias("amount"), F.sum("n").over(upto).alias("n"), F.lead("dt").over(own).alias("until")).where("n > 0")
    held = spans.withColumn("dt", F.explode(F.sequence("dt", F.coalesce(F.date_sub("until", 1), day)))).join(calendar, "dt", "left_semi")
    marks = prices.select(F.col("ticker").alias("security"), F.col("dt").alias("day"), F.col("close").alias("mark"))
    marked = last_until(held, marks, "dt", when="day", take=["mark"], key="security")
    worth = marked.groupBy(*keys, "leg", "dt").agg(F.sum(F.col("amount") * F.coalesce("found.mark", F.lit(0.0))).alias("worth"))
    capital = rows.groupBy(*keys).agg((F.count(F.lit(1)) * F.lit(stake)).alias("capital"), F.count(F.lit(1)).alias("n_positions"))
    total = run.join(calendar, "dt", "left_semi").join(worth, [*keys, "leg", "dt"], "left").withColumn("total", F.col("cash") + F.coalesce("worth", F.lit(0.0)))
    of = lambda leg, c: F.sum(F.when(F.col("leg") == leg, F.col(c)))
    per = total.groupBy(*keys, "dt").agg(of("equity", "total").alias("_e"), of("index", "total").alias("_b"), of("equity", "n").alias("n_open"))
    per = per.join(capital, keys) if keys else per.crossJoin(F.broadcast(capital))  # one row
    value = lambda c: F.round(F.col("capital") + F.coalesce(F.col(c), F.lit(0.0)), 2)
    return per.select(*keys, "dt", "n_positions", "n_open", "capital", value("_e").alias("strategy_value"), value("_b").alias("index_value"))


def tracker_summary(series: DataFrame, keys: list[str] | None = None, days: int = 30, counts: DataFrame | None = None) -> DataFrame:
    """The last day of a tracker: excess in pounds and per cent of the capital, and both legs' change over the trailing days.

    ``counts`` (from ``guard_counts``) adds how many positions each guard has left out.
    """
    keys, series = keys or [], kept(series)
    end = series.groupBy(*keys).agg(F.max("dt").alias("as_of"))
    rows = series.join(end, keys) if keys else series.crossJoin(F.broadcast(end))  # one row
    last, then = F.col("dt") == F.col("as_of"), F.col("dt") <= F.date_sub("as_of", days)
    at = lambda c, when: F.max_by(F.when(when, F.col(c)), F.when(when, F.col("dt")))
    out = rows.groupBy(*keys, "as_of").agg(*[at(c, last).alias(c) for c in ("n_positions", "capital", "strategy_value", "index_value")], at("strategy_value", then).alias("_s"), at("index_value", then).alias("_i"))
    excess = F.col("strategy_value") - F.col("index_value")
    trend = lambda c, old: F.round(100 * (F.col(c) / F.col(old) - 1), 2)
    out = out.select(
        *keys, "as_of", "n_positions", "capital", "strategy_value", "index_value", F.round(excess, 2).alias("excess"), F.round(100 * excess / F.col("capital"), 2).alias("excess_pct"),
        trend("strategy_value", "_s").alias("strategy_trend_pct"), trend("index_value", "_i").alias("index_trend_pct"),
    )
    if counts is None:
        return out
    return out.join(counts, keys, "left") if keys else out.crossJoin(F.broadcast(counts))  # one row


def anchors(as_of: str, weeks: int = 12) -> Column:
    """The Mondays of the last weeks, as an array."""
    monday = F.date_trunc("week", F.lit(as_of).cast("date")).cast("date")
    return F.sequence(F.date_sub(monday, 7 * (weeks - 1)), monday, F.expr("INTERVAL 7 DAYS"))


def open_at(held: DataFrame, days: Column, keys: list[str]) -> DataFrame:
    """Open count and notional at each of a few days; the days are exploded onto the positions that span them."""
    grid = held.withColumn("day", F.explode(F.filter(days, lambda d: (d >= F.col("entry_dt")) & (F.col("exit_dt").isNull() | (d < F.col("exit_dt"))))))
    return grid.groupBy("day", *keys).agg(F.count(F.lit(1)).alias("n_open"), F.sum("notional").alias("notional"))


def capital_panels(held: DataFrame, as_of: str, weeks: int = 12, mean: int = 4) -> DataFrame:
    """Per size band ('all' too): open notional and count now and on the last Mondays, their trailing means, and how far now is from these."""
    rows = held.withColumn("band", F.explode(F.array(F.lit("all"), F.when(F.col("market_cap_gbp") < 500e6, "small").otherwise("large"))))
    today = F.lit(as_of).cast("date")
    open_days = open_at(rows, F.array_union(anchors(as_of, weeks), F.array(today)), ["band"])
    grid = rows.sparkSession.range(1).select(F.explode(F.array(*[F.lit(b) for b in ("all", "small", "large")])).alias("band"), F.explode(F.array_union(anchors(as_of, weeks), F.array(today))).alias("day"))
    full = grid.join(open_days, ["band", "day"], "left").select("band", "day", F.coalesce("n_open", F.lit(0)).alias("n_open"), F.coalesce("notional", F.lit(0.0)).alias("notional"))
    monday = F.col("day") == F.date_trunc("week", "day").cast("date")
    ranked = full.withColumn("back", F.when(monday, F.row_number().over(Window.partitionBy("band", monday).orderBy(F.desc("day")))))
    weekly = lambda c: F.transform(F.sort_array(F.collect_list(F.when(monday, F.struct("day", F.round(c, 2).alias("x"))))), lambda s: s["x"])
    now = lambda c: F.max(F.when(F.col("day") == today, F.col(c)))
    recent = lambda c: F.avg(F.when(F.col("back") <= mean, F.col(c)))
    out = ranked.groupBy("band").agg(
        now("notional").alias("n_now"), now("n_open").alias("live_count"), weekly("notional").alias("weekly_notional"), weekly("n_open").alias("weekly_count"), recent("notional").alias("ma_n"), recent("n_open").alias("ma_c")
    )
    return out.select(
        "band", F.round("n_now", 2).alias("live_notional"), "live_count", "weekly_notional", "weekly_count", F.round("ma_n", 2).alias("mean_notional"), F.round("ma_c", 4).alias("mean_count"),
        F.round(F.col("n_now") - F.col("ma_n"), 2).alias("delta_notional"), F.round((F.col("live_count") - F.col("ma_c")) / F.nullif("ma_c", F.lit(0.0)) * 100, 4).alias("delta_count_pct"),
    )
