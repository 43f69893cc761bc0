"""Queries on paper portfolios and factor statistics."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.operators import aggregate as ag
from tidemark.operators import eventstudy, portfolio, signals, stats
from tidemark.operators import timeseries as ts
from tidemark.operators.conviction import WEIGHTS
from tidemark.plans.aggregates import n_rows, nets
from tidemark.plans.core import AS_OF, R, event_returns, tier_firings
from tidemark.plans.features import _CV, scored
from tidemark.plans.registry import query

_T90 = "r AS (SELECT * FROM es WHERE horizon='t90' AND net IS NOT NULL)"


def t90(t):
    return nets(t).where("horizon = 't90'")


# --- portfolio ------------------------------------------------------------------

_POS = f"""p AS (SELECT e.*, x.dt AS exit_dt, x.close AS exit_close, CASE WHEN e.entry_dt > DATE '{AS_OF}' THEN 'planned' WHEN x.dt <= DATE '{AS_OF}' THEN 'closed' ELSE 'open' END AS status,
 least(e.value, 50000.0) AS notional FROM entry e LEFT JOIN px x ON x.ticker = e.ticker AND x.idx = e.entry_idx + 21)"""


def held(t):
    indexed = ts.trade_index(t.prices)
    entered = eventstudy.entries(tier_firings(t), indexed).where("entry_idx > 30")
    return portfolio.positions(entered, indexed, AS_OF, notional=portfolio.position_size(F.col("value"), "capped"))


@query("pf01_position_size", """
SELECT fingerprint, 1000.0::DOUBLE AS flat, round(least(5000.0, greatest(500.0, 1000*log10(value/50000))), 4) AS log, CASE WHEN tier IN ('T1a','T1b') THEN 3000.0 WHEN tier IN ('T2','T7') THEN 2000.0 ELSE 1000.0 END::DOUBLE AS tier,
 0.005::DOUBLE*value AS linear, least(value, 50000.0) AS capped FROM firing""")
def pf01(t):
    sizes = {s: portfolio.position_size(F.col("value"), s, F.col("tier")) for s in portfolio.SCHEMES}
    return tier_firings(t).select("fingerprint", *[(R(c, 4) if s == "log" else c).alias(s) for s, c in sizes.items()])


@query("pf02_positions", f"WITH {_POS} SELECT fingerprint, entry_dt, exit_dt, status, notional FROM p")
def pf02(t):
    return held(t).select("fingerprint", "entry_dt", "exit_dt", "status", "notional")


@query("pf03_paper_summary", f"""WITH {_POS}, last AS (SELECT ticker, arg_max(close, dt) AS now_close FROM fx_prices WHERE dt <= DATE '{AS_OF}' GROUP BY 1),
g AS (SELECT p.status, p.notional, CASE WHEN status = 'closed' THEN exit_close ELSE now_close END / entry_close - 1 AS gain FROM p LEFT JOIN last ON last.ticker = p.ticker WHERE status <> 'planned')
SELECT status, count(*) AS n, round(sum(notional), 2) AS notional, round(avg(gain) * 100, 4) AS mean_pct, count(*) FILTER (gain > 0) AS winners, count(*) FILTER (gain < 0) AS losers FROM g GROUP BY 1""")
def pf03(t):
    return portfolio.summary(held(t), t.prices, AS_OF)


@query("pf04_sizing_comparison", f"WITH {_T90} SELECT signal, round(avg(net), 6) AS flat_mean, round(sum(net*least(value, 50000.0))/sum(least(value, 50000.0)), 6) AS weighted_mean, round(median(net), 6) AS median_net FROM r GROUP BY 1")
def pf04(t):
    w = portfolio.position_size(F.col("value"), "capped")
    counts = [R(F.avg("net")).alias("flat_mean"), R(F.sum(F.col("net") * F.col("w")) / F.sum("w")).alias("weighted_mean")]
    return ag.with_medians(t90(t).select("signal", "net", w.alias("w")), ["signal"], counts, {"median_net": "net"}, scale=1, digits=6)


@query("pf04_flat_and_weighted", f"""WITH {_T90}, l AS (SELECT signal, fingerprint, net, unnest([{{'scheme': 'flat', 'w': 1000.0::DOUBLE}}, {{'scheme': 'capped', 'w': least(value, 50000.0)}}], recursive := true) FROM r),
a AS (SELECT *, sum(w) OVER (PARTITION BY signal, scheme ORDER BY net, fingerprint ROWS UNBOUNDED PRECEDING) AS upto, sum(w) OVER (PARTITION BY signal, scheme) AS whole FROM l)
SELECT signal, scheme, count(*) AS n, round(sum(net * w) / sum(w), 6) AS mean, round(min(net) FILTER (upto * 2 >= whole * (1 - 1e-12)), 6) AS median, round(100.0 * sum(w) FILTER (net > 0) / sum(w), 4) AS hit_pct FROM a GROUP BY 1, 2""")
def pf04_schemes(t):
    """Mean, median and hit rate of each signal with equal stakes and with stakes by the size of the dealing."""
    sizes = {s: portfolio.position_size(F.col("value"), s) for s in ("flat", "capped")}
    out = stats.weighted_board(t90(t).withColumns({f"_{s}": w for s, w in sizes.items()}), ["signal"], "net", {s: F.col(f"_{s}") for s in sizes})
    return out.select("signal", "scheme", "n", R("mean").alias("mean"), R("median").alias("median"), R("hit_pct", 4).alias("hit_pct"))


def _tracker(hold: int, keys: list[str]) -> str:
    """The tracker position by position and day by day."""
    by = "".join(f"{k}, " for k in keys)
    return f"""
pos AS (SELECT e.*, CASE WHEN market_cap_gbp < 500e6 THEN 'small' ELSE 'large' END AS band, CASE WHEN x.dt <= DATE '{AS_OF}' THEN x.dt END AS exit_dt, x.close AS exit_close, 10000.0 * (1 - CASE WHEN is_aim THEN 0.005 ELSE 0.01 END) / e.entry_close AS bought, 10000.0 / e.bench_close AS units
 FROM bentry e LEFT JOIN px x ON x.ticker = e.ticker AND x.idx = e.entry_idx + {hold} WHERE e.entry_dt <= DATE '{AS_OF}'),
pos2 AS (SELECT pos.*, q.close AS bench_out FROM pos ASOF LEFT JOIN px q ON q.ticker = pos.benchmark_symbol AND pos.exit_dt >= q.dt),
cal AS (SELECT DISTINCT dt FROM fx_prices WHERE ticker LIKE '^%' AND dt <= DATE '{AS_OF}' AND dt >= (SELECT min(entry_dt) FROM pos)),
grid AS (SELECT cal.dt AS day, pos2.* FROM cal CROSS JOIN pos2),
m1 AS (SELECT grid.*, q.close AS mark FROM grid ASOF LEFT JOIN px q ON q.ticker = grid.ticker AND grid.day >= q.dt),
m2 AS (SELECT m1.*, q.close AS bench_mark FROM m1 ASOF LEFT JOIN px q ON q.ticker = m1.benchmark_symbol AND m1.day >= q.dt),
trk AS (SELECT {by}day AS dt, count(*) AS n_positions, count(*) FILTER (day >= entry_dt AND (exit_dt IS NULL OR day < exit_dt)) AS n_open, 10000.0::DOUBLE * count(*) AS capital,
 round(sum(CASE WHEN day < entry_dt THEN 10000.0 WHEN exit_dt IS NOT NULL AND day >= exit_dt THEN bought * exit_close ELSE bought * mark END), 2) AS strategy_value,
 round(sum(CASE WHEN day < entry_dt THEN 10000.0 WHEN exit_dt IS NOT NULL AND day >= exit_dt THEN units * bench_out ELSE units * bench_mark END), 2) AS index_value FROM m2 GROUP BY {by}day)"""


def _tracker_end(keys: list[str]) -> str:
    by = "".join(f"{k}, " for k in keys)
    on = " AND ".join(["true", *[f"trk.{k} = e.{k}" for k in keys]])
    return f"""
e AS (SELECT {by}max(dt) AS as_of FROM trk {"GROUP BY " + ", ".join(keys) if keys else ""}), j AS (SELECT trk.*, e.as_of FROM trk JOIN e ON {on}),
z AS (SELECT {by}as_of, max(n_positions) FILTER (dt = as_of) AS n_positions, max(capital) FILTER (dt = as_of) AS capital, max(strategy_value) FILTER (dt = as_of) AS strategy_value, max(index_value) FILTER (dt = as_of) AS index_value,
 arg_max(strategy_value, dt) FILTER (dt <= as_of - 30) AS s0, arg_max(index_value, dt) FILTER (dt <= as_of - 30) AS i0 FROM j GROUP BY {by}as_of),
fin AS (SELECT {by}as_of, n_positions, capital, strategy_value, index_value, round(strategy_value - index_value, 2) AS excess, round(100 * (strategy_value - index_value) / capital, 2) AS excess_pct,
 round(100 * (strategy_value / s0 - 1), 2) AS strategy_trend_pct, round(100 * (index_value / i0 - 1), 2) AS index_trend_pct FROM z)"""


def entered_positions(t):
    indexed = ts.trade_index(t.kept("prices"))
    entered = eventstudy.benchmark_entries(eventstudy.entries(t.kept("firings", lambda: tier_firings(t)), indexed).where("entry_idx > 30"), indexed)
    return entered.withColumn("band", F.when(F.col("market_cap_gbp") < 500e6, "small").otherwise("large"))


def tracked(t, hold: int = 21, keys: list[str] | None = None):
    return portfolio.tracker(entered_positions(t), t.kept("prices"), AS_OF, hold, keys=keys)


@query("pf05_daily_value", f"WITH {_tracker(21, [])} SELECT dt, n_positions, n_open, capital, strategy_value, index_value FROM trk")
def pf05(t):
    return tracked(t)


@query("pf06_tracker_summary", f"WITH {_tracker(21, [])}, {_tracker_end([])} SELECT * FROM fin")
def pf06(t):
    return portfolio.tracker_summary(tracked(t))


_GUARDED = f"""
{_tracker(21, []).split("pos2 AS")[0].replace("pos AS", "pos0 AS")}
gd AS (SELECT pos0.fingerprint, max(q.close) / any_value(pos0.entry_close) AS hi, min(q.close) / any_value(pos0.entry_close) AS lo FROM pos0 JOIN px q ON q.ticker = pos0.ticker AND q.idx BETWEEN pos0.entry_idx AND pos0.entry_idx + 21 AND q.dt <= DATE '{AS_OF}' GROUP BY 1),
ex AS (SELECT pos0.*, CASE WHEN ticker = 'Brand#12' THEN 'excluded_ticker' WHEN CAST(substring(ticker, 7) AS INT) % 11 = 0 THEN 'excluded_issuer' WHEN gd.hi > 1.15 OR gd.lo < 0.87 THEN 'excluded_split' END AS excluded FROM pos0 JOIN gd USING (fingerprint)),
pos AS (SELECT * EXCLUDE (excluded) FROM ex WHERE excluded IS NULL),
pos2 AS{_tracker(21, []).split("pos2 AS")[1]}"""


@query("pf06_guarded_summary", f"WITH {_GUARDED}, {_tracker_end([])}, c AS (SELECT count(*) FILTER (excluded = 'excluded_split') AS excluded_split, count(*) FILTER (excluded = 'excluded_ticker') AS excluded_ticker, count(*) FILTER (excluded = 'excluded_issuer') AS excluded_issuer FROM ex) SELECT fin.*, c.* FROM fin CROSS JOIN c")
def pf06_guarded(t):
    """The tracker without a ticker, some issuers and positions whose price runs beyond narrow limits while they are held; with counters."""
    prices = t.kept("prices")
    issuers = t.meta.where(F.substring("ticker", 7, 9).cast("int") % 11 == 0)
    checked = t.kept("checked", lambda: portfolio.guarded(entered_positions(t), prices, AS_OF, 21, ("Brand#12",), issuers, least=0.87, most=1.15))
    series = portfolio.tracker(checked.where("excluded IS NULL"), prices, AS_OF, 21)
    return portfolio.tracker_summary(series, counts=portfolio.guard_counts(checked, AS_OF))


_TOGGLES = {"t30": 21, "t90": 63}


@query("pf07_by_size", " UNION ALL ".join(f"SELECT '{h}' AS horizon, * FROM (WITH {_tracker(n, ['band', 'signal'])}, {_tracker_end(['band', 'signal'])} SELECT * FROM fin)" for h, n in _TOGGLES.items()))
def pf07(t):
    """The tracker's end by holding time, size and signal."""
    ends = [portfolio.tracker_summary(tracked(t, n, ["band", "signal"]), ["band", "signal"]).withColumn("horizon", F.lit(h)) for h, n in _TOGGLES.items()]
    return ends[0].unionByName(ends[1])


@query("pf08_capital_panels", f"""WITH {_POS}, g AS (SELECT CAST(date_trunc('week', DATE '{AS_OF}') AS DATE) - CAST(7*i AS INT) AS day, true AS monday FROM range(12) v(i) UNION SELECT DATE '{AS_OF}', date_trunc('week', DATE '{AS_OF}') = DATE '{AS_OF}'),
bands AS (SELECT unnest(['all', 'small', 'large']) AS band), q AS (SELECT p.*, CASE WHEN market_cap_gbp < 500e6 THEN 'small' ELSE 'large' END AS size FROM p),
o AS (SELECT bands.band, g.day, any_value(g.monday) AS monday, count(q.fingerprint) AS n_open, coalesce(sum(q.notional), 0.0) AS notional FROM bands CROSS JOIN g LEFT JOIN q ON (bands.band = 'all' OR bands.band = q.size) AND g.day >= q.entry_dt AND (q.exit_dt IS NULL OR g.day < q.exit_dt) GROUP BY 1, 2),
k AS (SELECT *, CASE WHEN monday THEN row_number() OVER (PARTITION BY band, monday ORDER BY day DESC) END AS back FROM o),
f AS (SELECT band, max(notional) FILTER (day = DATE '{AS_OF}') AS n_now, max(n_open) FILTER (day = DATE '{AS_OF}') AS live_count, list(round(notional, 2) ORDER BY day) FILTER (monday) AS weekly_notional, list(n_open ORDER BY day) FILTER (monday) AS weekly_count,
 avg(notional) FILTER (back <= 4) AS ma_n, avg(n_open) FILTER (back <= 4) AS ma_c FROM k GROUP BY 1)
SELECT band, round(n_now, 2) AS live_notional, live_count, weekly_notional, weekly_count, round(ma_n, 2) AS mean_notional, round(ma_c, 4) AS mean_count, round(n_now - ma_n, 2) AS delta_notional, round((live_count - ma_c) / nullif(ma_c, 0) * 100, 4) AS delta_count_pct FROM f""")
def pf08(t):
    return portfolio.capital_panels(held(t), AS_OF)


# --- statistics -------------------------------------------------------------------

_SPLIT = f"WITH {_T90}, s AS (SELECT *, CASE WHEN row_number() OVER (ORDER BY announced, fingerprint) <= floor(count(*) OVER () * 0.6) THEN 'train' ELSE 'test' END AS part FROM r) "


@query("st01_time_split", _SPLIT + "SELECT fingerprint, part FROM s")
def st01(t):
    return stats.time_split(t90(t)).select("fingerprint", "part")


@query("st02_out_of_sample", _SPLIT + """SELECT tier, part, count(*) AS n, round(avg(net), 6) AS mean, round(median(net), 6) AS median, CASE WHEN count(*) < 30 THEN 'INSUFFICIENT-N' WHEN avg(net) > 0.02 THEN 'EDGE' WHEN avg(net) > 0 THEN 'PRELIMINARY' ELSE 'NOISE' END AS verdict FROM s GROUP BY 1, 2""")
def st02(t):
    m = F.avg("net")
    verdict = F.when(F.count(F.lit(1)) < 30, "INSUFFICIENT-N").when(m > 0.02, "EDGE").when(m > 0, "PRELIMINARY").otherwise("NOISE")
    rows = stats.time_split(t90(t)).select("tier", "part", "net")
    return ag.with_medians(rows, ["tier", "part"], [n_rows(), R(m).alias("mean"), verdict.alias("verdict")], {"median": "net"}, scale=1, digits=6)


@query("st02_tier_verdicts", _SPLIT + """, b AS (SELECT avg(net) AS base FROM s WHERE part = 'test'),
x AS (SELECT tier, count(*) AS n, avg(net) AS mean, median(net) AS median, round(100.0 * count(*) FILTER (net > 0) / count(*), 4) AS hit_pct, (sum(net) - max(net)) / nullif(count(*) - 1, 0) AS rest FROM s WHERE part = 'test' GROUP BY 1),
y AS (SELECT tier, avg(net) AS train_mean FROM s WHERE part = 'train' GROUP BY 1)
SELECT tier, n, round(mean, 6) AS mean, round(median, 6) AS median, hit_pct, round(mean - base, 6) AS vs_baseline, round(train_mean, 6) AS train_mean, CASE WHEN n < 30 THEN 'INSUFFICIENT-N' WHEN mean > 0 AND mean > base AND coalesce(train_mean > 0, false) AND coalesce(rest > 0, false) THEN 'EDGE'
 WHEN mean > 0 AND mean > base AND (coalesce(train_mean > 0, false) OR coalesce(rest > 0, false)) THEN 'PRELIMINARY' ELSE 'NOISE' END AS verdict FROM x LEFT JOIN y USING (tier) CROSS JOIN b""")
def st02_verdicts(t):
    """Each tier on the later four tenths in time: what it earned, how often, against all firings and against the earlier part."""
    out = stats.out_of_sample(stats.time_split(t90(t)), "tier")
    return out.select("tier", "n", *[R(c).alias(c) for c in ("mean", "median")], "hit_pct", *[R(c).alias(c) for c in ("vs_baseline", "train_mean")], "verdict")


@query("st03_decile_contrast", f"WITH {_T90}, d AS (SELECT *, ntile(10) OVER (ORDER BY net, fingerprint) AS decile FROM r) SELECT decile, count(*) AS n, round(avg(value), 2) AS mean_value, round(avg(market_cap_gbp), 2) AS mean_cap, round(avg(net), 6) AS mean_net FROM d WHERE decile IN (1, 10) GROUP BY 1")
def st03(t):
    d = stats.buckets(t90(t), "net", 10, []).withColumnRenamed("bucket", "decile").where("decile IN (1, 10)")
    return d.groupBy("decile").agg(n_rows(), R(F.avg("value"), 2).alias("mean_value"), R(F.avg("market_cap_gbp"), 2).alias("mean_cap"), R(F.avg("net")).alias("mean_net"))


@query("st04_clustered_t", f"WITH {_T90}, m AS (SELECT signal, ticker, avg(net) AS m, count(*) AS n FROM r GROUP BY 1, 2) SELECT signal, CAST(sum(n) AS BIGINT) AS n, count(*) AS n_clusters, round(avg(m)/(stddev_samp(m)/sqrt(count(*))), 4) AS clustered_t FROM m GROUP BY 1")
def st04(t):
    return stats.clustered_t(t90(t), ["signal"], "net")


@query("st05_half_samples", f"""WITH {_T90}, h AS (SELECT *, entry_dt <= (SELECT quantile_disc(entry_dt, 0.5) FROM r) AS early FROM r), x AS (SELECT signal, avg(net)/(stddev_samp(net)/sqrt(count(*))) AS t, coalesce(sign(avg(net) FILTER (early)) = sign(avg(net) FILTER (NOT early)), false) AS same_sign FROM h GROUP BY 1)
SELECT signal, round(t, 4) AS t, same_sign, coalesce(abs(t) >= 2.5, false) AND same_sign AS robust FROM x""")
def st05(t):
    rows = t90(t).withColumn("day", F.unix_date("entry_dt"))
    middle = rows.agg(F.expr("percentile_disc(0.5) WITHIN GROUP (ORDER BY day)").alias("middle"))
    early = F.col("day") <= F.col("middle")
    h = rows.crossJoin(F.broadcast(middle))  # one row
    same = F.coalesce(F.signum(F.avg(F.when(early, F.col("net")))) == F.signum(F.avg(F.when(~early, F.col("net")))), F.lit(False))
    out = h.groupBy("signal").agg(stats.t_value("net").alias("t"), same.alias("same_sign"))
    return out.select("signal", R("t", 4).alias("t"), "same_sign", (F.coalesce(F.abs("t") >= 2.5, F.lit(False)) & F.col("same_sign")).alias("robust"))


_FACTORS = "u AS (SELECT fingerprint, net, unnest(['tier='||tier, 'sector='||sector, 'aim='||is_aim, 'cap='||CASE WHEN market_cap_gbp < 500e6 THEN 'small' ELSE 'large' END]) AS factor FROM r)"


def factors(t):
    cap = F.when(F.col("market_cap_gbp") < 500e6, "small").otherwise("large")
    named = [F.concat(F.lit(f"{n}="), c.cast("string")) for n, c in (("tier", F.col("tier")), ("sector", F.col("sector")), ("aim", F.col("is_aim")), ("cap", cap))]
    return t90(t).select("fingerprint", "net", F.array(*named).alias("fs"))


@query("st06_factor_grid", f"WITH {_T90}, {_FACTORS}, c AS (SELECT factor, '' AS second, net FROM u UNION ALL SELECT a.factor, b.factor, a.net FROM u a JOIN u b ON a.fingerprint = b.fingerprint AND a.factor < b.factor) SELECT factor, second, count(*) AS n, round(avg(net), 6) AS mean_net FROM c GROUP BY 1, 2 HAVING count(*) >= 30")
def st06(t):
    # singles and pairs come from the row's own array: no join
    cells = F.flatten(F.transform("fs", lambda a: F.concat(F.array(F.struct(a.alias("factor"), F.lit("").alias("second"))), F.transform(F.filter("fs", lambda b: a < b), lambda b: F.struct(a.alias("factor"), b.alias("second"))))))
    out = factors(t).select("net", F.explode(cells).alias("c")).groupBy("c.factor", "c.second").agg(n_rows(), R(F.avg("net")).alias("mean_net"))
    return out.where("n >= 30")


@query("st07_winsorised", f"WITH {_T90}, e AS (SELECT signal, quantile_cont(net, 0.01) AS lo, quantile_cont(net, 0.99) AS hi FROM r GROUP BY 1) SELECT r.signal, round(avg(least(hi, greatest(lo, net))), 6) AS w_mean FROM r JOIN e ON e.signal = r.signal GROUP BY 1")
def st07(t):
    return stats.winsorised(t90(t), "net", ["signal"]).groupBy("signal").agg(R(F.avg("w")).alias("w_mean"))


@query("st08_without_top", f"WITH {_T90} SELECT signal, round((sum(net) - max(net)) / (count(*) - 1), 6) AS mean_rest FROM r GROUP BY 1 HAVING count(*) > 1")
def st08(t):
    out = t90(t).groupBy("signal").agg(n_rows(), F.sum("net").alias("s"), F.max("net").alias("m")).where("n > 1")
    return out.select("signal", R((F.col("s") - F.col("m")) / (F.col("n") - 1)).alias("mean_rest"))


_SCORED = _CV + ", e AS (SELECT fingerprint, horizon, net, ticker AS tk FROM es WHERE net IS NOT NULL), j AS (SELECT c.*, e.horizon, e.net, e.tk FROM c JOIN e USING (fingerprint)) "


def scored_returns(t):
    return scored(t).join(nets(t).select("fingerprint", "horizon", "net"), "fingerprint")


@query("st09_spearman", _SCORED + ", k AS (SELECT horizon, rank() OVER (PARTITION BY horizon ORDER BY score) + (count(*) OVER (PARTITION BY horizon, score) - 1)/2.0 AS a, rank() OVER (PARTITION BY horizon ORDER BY net) + (count(*) OVER (PARTITION BY horizon, net) - 1)/2.0 AS b FROM j) SELECT horizon, count(*) AS n, nullif(round(corr(a, b), 6), 'nan'::DOUBLE) AS spearman FROM k GROUP BY 1")
def st09(t):
    return stats.spearman(scored_returns(t), "score", "net", ["horizon"])


@query("st10_ols_slope", _SCORED + "SELECT horizon, round(regr_slope(net, score), 8) AS slope FROM j GROUP BY 1")
def st10(t):
    return scored_returns(t).groupBy("horizon").agg(R(F.regr_slope("net", "score"), 8).alias("slope"))


@query("st10_ols_multi", _SCORED + """, qq AS (SELECT net AS y, small AS x1, fall AS x2 FROM j WHERE horizon = 't30' AND small IS NOT NULL AND fall IS NOT NULL),
ss AS (SELECT count(*) AS n, avg(y) AS my, avg(x1) AS m1, avg(x2) AS m2, var_pop(x1)*count(*) AS s11, var_pop(x2)*count(*) AS s22, covar_pop(x1, x2)*count(*) AS s12, covar_pop(x1, y)*count(*) AS s1y, covar_pop(x2, y)*count(*) AS s2y, var_pop(y)*count(*) AS syy FROM qq),
bb AS (SELECT *, s11*s22 - s12*s12 AS det, (s1y*s22 - s2y*s12)/(s11*s22 - s12*s12) AS b1, (s2y*s11 - s1y*s12)/(s11*s22 - s12*s12) AS b2 FROM ss),
ee AS (SELECT *, my - b1*m1 - b2*m2 AS b0, (syy - b1*s1y - b2*s2y)/(n - 3) AS v FROM bb WHERE n > 3)
SELECT 'intercept' AS factor, round(b0, 6) AS coefficient, round(b0/sqrt(v*(1.0/n + (m1*m1*s22 + m2*m2*s11 - 2*m1*m2*s12)/det)), 4) AS t FROM ee UNION ALL SELECT 'small', round(b1, 6), round(b1/sqrt(v*s22/det), 4) FROM ee UNION ALL SELECT 'fall', round(b2, 6), round(b2/sqrt(v*s11/det), 4) FROM ee""")
def st10_multi(t):
    return stats.ols(scored_returns(t).where("horizon = 't30'"), "net", ["small", "fall"]).select("factor", R("coefficient").alias("coefficient"), R("t", 4).alias("t"))


@query("st11_top_quintile", _SCORED + ", q AS (SELECT *, ntile(5) OVER (PARTITION BY horizon ORDER BY score, fingerprint) AS b FROM j), m AS (SELECT horizon, tk, avg(net) AS m, count(*) AS n FROM q WHERE b = 5 GROUP BY 1, 2) SELECT horizon, CAST(sum(n) AS BIGINT) AS n, count(*) AS n_clusters, round(avg(m)/(stddev_samp(m)/sqrt(count(*))), 4) AS clustered_t FROM m GROUP BY 1")
def st11(t):
    return stats.clustered_t(stats.buckets(scored_returns(t), "score", 5, ["horizon"]).where("bucket = 5"), ["horizon"], "net")


@query("st12_score_buckets", _SCORED + ", q AS (SELECT *, ntile(10) OVER (PARTITION BY horizon ORDER BY score, fingerprint) AS b FROM j) SELECT horizon, b AS bucket, count(*) AS n, min(score) AS low, max(score) AS high, round(avg(net), 6) AS mean_net FROM q GROUP BY 1, 2")
def st12(t):
    q = stats.buckets(scored_returns(t), "score", 10, ["horizon"])
    return q.groupBy("horizon", "bucket").agg(n_rows(), F.min("score").alias("low"), F.max("score").alias("high"), R(F.avg("net")).alias("mean_net"))


@query("st13_factor_correlations", _SCORED + """, u AS (SELECT horizon, net, 'who' AS factor, who AS x FROM j UNION ALL SELECT horizon, net, 'size', size FROM j UNION ALL SELECT horizon, net, 'small', small FROM j UNION ALL SELECT horizon, net, 'timing', timing FROM j UNION ALL SELECT horizon, net, 'fall', fall FROM j),
k AS (SELECT horizon, factor, rank() OVER (PARTITION BY horizon, factor ORDER BY x) + (count(*) OVER (PARTITION BY horizon, factor, x) - 1)/2.0 AS a, rank() OVER (PARTITION BY horizon, factor ORDER BY net) + (count(*) OVER (PARTITION BY horizon, factor, net) - 1)/2.0 AS b FROM u WHERE x IS NOT NULL)
SELECT horizon, factor, count(*) AS n, nullif(round(corr(a, b), 6), 'nan'::DOUBLE) AS spearman FROM k GROUP BY 1, 2""")
def st13(t):
    long = scored_returns(t).select("horizon", "net", F.explode(F.array(*[F.struct(F.lit(f).alias("factor"), F.col(f).alias("x")) for f in WEIGHTS])).alias("s")).select("horizon", "net", "s.*")
    return stats.spearman(long, "x", "net", ["horizon", "factor"])


@query("st14_two_sample_t", f"WITH {_T90}, g AS (SELECT avg(net) FILTER (is_aim) AS ma, avg(net) FILTER (NOT is_aim) AS mb, var_samp(net) FILTER (is_aim) / count(*) FILTER (is_aim) AS va, var_samp(net) FILTER (NOT is_aim) / count(*) FILTER (NOT is_aim) AS vb, signal FROM r GROUP BY signal) SELECT signal, round((ma - mb)/sqrt(va + vb), 4) AS welch_t FROM g")
def st14(t):
    a, b = F.when(F.col("is_aim"), F.col("net")), F.when(~F.col("is_aim"), F.col("net"))
    return t90(t).groupBy("signal").agg(R((F.avg(a) - F.avg(b)) / F.sqrt(F.var_samp(a) / F.count(a) + F.var_samp(b) / F.count(b)), 4).alias("welch_t"))


@query("st15_coalesce", "SELECT fingerprint, arg_min(horizon, days) FILTER (net IS NOT NULL) AS first_horizon, round(arg_min(net, days) FILTER (net IS NOT NULL), 6) AS first_net FROM es GROUP BY 1")
def st15(t):
    ready = F.when(F.col("net").isNotNull(), F.col("days"))
    return event_returns(t).groupBy("fingerprint").agg(F.min_by("horizon", ready).alias("first_horizon"), R(F.min_by("net", ready)).alias("first_net"))


@query("st16_run_delta", f"WITH {_T90}, d AS (SELECT signal, avg(net) - avg(net) FILTER (value >= 150000) AS delta, count(*) AS n FROM r GROUP BY 1) SELECT signal, round(delta, 6) AS delta, n, abs(delta) > 0.03 AND n >= 20 AS flagged FROM d")
def st16(t):
    one = t90(t).groupBy("signal").agg(F.avg("net").alias("a"), n_rows())
    two = t90(t).where("value >= 150000").groupBy("signal").agg(F.avg("net").alias("b"))
    d = one.join(two, "signal", "left").withColumn("delta", F.col("a") - F.col("b"))
    return d.select("signal", R("delta").alias("delta"), "n", ((F.abs("delta") > 0.03) & (F.col("n") >= 20)).alias("flagged"))


@query("st17_overlap", f"WITH {_T90}, k AS (SELECT rank() OVER (ORDER BY ln(value)) + (count(*) OVER (PARTITION BY value) - 1)/2.0 AS a, rank() OVER (ORDER BY ln(shares)) + (count(*) OVER (PARTITION BY shares) - 1)/2.0 AS b FROM r), s AS (SELECT count(*) AS n, nullif(round(corr(a, b), 6), 'nan'::DOUBLE) AS spearman FROM k) SELECT n, spearman, CASE WHEN n < 5 THEN 'inconclusive' WHEN spearman >= 0.7 THEN 'redundant' ELSE 'distinct' END AS verdict FROM s")
def st17(t):
    rows = t90(t).select(F.log("value").alias("x"), F.log("shares").alias("y"), F.lit(1).alias("all"))
    s = stats.spearman(rows, "x", "y", ["all"])
    return s.select("n", "spearman", F.when(F.col("n") < 5, "inconclusive").when(F.col("spearman") >= 0.7, "redundant").otherwise("distinct").alias("verdict"))


_LEASTS, _DAYS = (80_000, 100_000, 120_000, 160_000, 200_000, 240_000), (14, 30, 60)


@query("st19_threshold_sweep", f"""
WITH gap AS (SELECT a.fingerprint, min(abs(datediff('day', a.dt, b.dt))) AS gap FROM buys a JOIN buys b ON a.ticker = b.ticker AND a.director <> b.director AND abs(datediff('day', a.dt, b.dt)) <= 60 AND b.announced <= a.announced GROUP BY 1),
tr AS (SELECT ticker, dt, close / lag(close, 60) OVER (PARTITION BY ticker ORDER BY dt) - 1 AS ret FROM fx_prices),
seen AS (SELECT a.* FROM buys a ASOF JOIN tr ON a.ticker = tr.ticker AND a.announced >= tr.dt WHERE a.buy_strictness = 'STRICT_BUY' AND tr.ret IS NOT NULL AND NOT tr.ret BETWEEN -0.10 AND -0.02),
n AS (SELECT fingerprint, net FROM es WHERE horizon = 't90' AND net IS NOT NULL)
SELECT l.least::DOUBLE AS least, d.days, count(*) AS n, count(n.net) AS n_matured, round(avg(n.net), 6) AS mean_net FROM seen JOIN (SELECT unnest({list(_LEASTS)}) AS least) l ON seen.value >= l.least CROSS JOIN (SELECT unnest({list(_DAYS)}) AS days) d LEFT JOIN gap USING (fingerprint) LEFT JOIN n USING (fingerprint)
WHERE gap.gap IS NULL OR gap.gap > d.days GROUP BY 1, 2""")
def st19(t):
    """The lone-buy signal under thresholds a fifth up and down and three windows, with what its firings earned."""
    fired = signals.lone_sweep(signals.context(t.dealings, t.prices), list(_LEASTS), list(_DAYS))
    out = fired.join(t90(t).select("fingerprint", "net"), "fingerprint", "left").groupBy("least", "days")
    return out.agg(n_rows(), F.count("net").alias("n_matured"), R(F.avg("net")).alias("mean_net"))


@query("st19_tier_sweep", f"""WITH n AS (SELECT fingerprint, net FROM es WHERE horizon = 't90' AND net IS NOT NULL)
SELECT b.tier, f.factor, count(*) AS n, count(n.net) AS n_matured, round(avg(n.net), 6) AS mean_net FROM buys b JOIN tiers t ON t.tier = b.tier JOIN (SELECT unnest([0.8, 1.0, 1.2]::DOUBLE[]) AS factor) f ON b.value >= t.least * f.factor LEFT JOIN n USING (fingerprint)
WHERE b.buy_strictness = 'STRICT_BUY' GROUP BY 1, 2""")
def st19_tiers(t):
    """Every tier's threshold a fifth down and up, with what the firings that fire now as well have earned."""
    fired = signals.tier_sweep(signals.context(t.dealings, t.prices), [0.8, 1.0, 1.2])
    out = fired.join(t90(t).select("fingerprint", "net"), "fingerprint", "left").groupBy("tier", "factor")
    return out.agg(n_rows(), F.count("net").alias("n_matured"), R(F.avg("net")).alias("mean_net"))


@query("st18_challenger", None)
def st18(t):
    """Weights refitted on the first six tenths in time and judged on the rest; a proposal, nothing is changed."""
    rows = stats.time_split(scored_returns(t).where("horizon = 't90'"))
    return stats.challenger(rows.where("part = 'train'"), rows.where("part = 'test'"), "net", WEIGHTS)


@query("st20_contributors", f"WITH {_T90}, k AS (SELECT signal, fingerprint, net, row_number() OVER (PARTITION BY signal ORDER BY net DESC, fingerprint) AS a, row_number() OVER (PARTITION BY signal ORDER BY net, fingerprint) AS b FROM r) SELECT signal, fingerprint, CASE WHEN a <= 3 THEN 'best' ELSE 'worst' END AS side FROM k WHERE a <= 3 OR b <= 3")
def st20(t):
    a = F.row_number().over(Window.partitionBy("signal").orderBy(F.desc("net"), "fingerprint"))
    b = F.row_number().over(Window.partitionBy("signal").orderBy("net", "fingerprint"))
    return t90(t).withColumn("a", a).withColumn("b", b).where("a <= 3 OR b <= 3").select("signal", "fingerprint", F.when(F.col("a") <= 3, "best").otherwise("worst").alias("side"))


@query("st21_hit_interval", f"WITH {_T90}, h AS (SELECT signal, count(*) AS n, count(*) FILTER (net > 0)::DOUBLE / count(*) AS p, stddev_samp(net)/sqrt(count(*)) AS se FROM r GROUP BY 1) SELECT signal, n, round(p - 1.96*sqrt(p*(1-p)/n), 6) AS low, round(p + 1.96*sqrt(p*(1-p)/n), 6) AS high, round(2*se, 6) AS two_se FROM h")
def st21(t):
    h = t90(t).groupBy("signal").agg(n_rows(), (F.count_if(F.col("net") > 0) / F.count(F.lit(1))).alias("p"), (F.stddev_samp("net") / F.sqrt(F.count(F.lit(1)))).alias("se"))
    w = 1.96 * F.sqrt(F.col("p") * (1 - F.col("p")) / F.col("n"))
    return h.select("signal", "n", R(F.col("p") - w).alias("low"), R(F.col("p") + w).alias("high"), R(2 * F.col("se")).alias("two_se"))


@query("st22_drift", "SELECT fingerprint, round(max(car) FILTER (horizon='t30') - max(car) FILTER (horizon='t1'), 6) AS to_t30, round(max(car) FILTER (horizon='t90') - max(car) FILTER (horizon='t30'), 6) AS to_t90 FROM es GROUP BY 1")
def st22(t):
    at = lambda h: F.max(F.when(F.col("horizon") == h, F.col("car")))
    return event_returns(t).groupBy("fingerprint").agg(R(at("t30") - at("t1")).alias("to_t30"), R(at("t90") - at("t30")).alias("to_t90"))


@query("cv11_calibration", _SCORED + """, k AS (SELECT horizon, score, net, rank() OVER (PARTITION BY horizon ORDER BY score) + (count(*) OVER (PARTITION BY horizon, score) - 1)/2.0 AS a, rank() OVER (PARTITION BY horizon ORDER BY net) + (count(*) OVER (PARTITION BY horizon, net) - 1)/2.0 AS b FROM j),
u AS (SELECT horizon, net, 'who' AS factor, who AS x FROM j UNION ALL SELECT horizon, net, 'size', size FROM j UNION ALL SELECT horizon, net, 'small', small FROM j UNION ALL SELECT horizon, net, 'timing', timing FROM j UNION ALL SELECT horizon, net, 'fall', fall FROM j),
w AS (SELECT horizon, factor, rank() OVER (PARTITION BY horizon, factor ORDER BY x) + (count(*) OVER (PARTITION BY horizon, factor, x) - 1)/2.0 AS a, rank() OVER (PARTITION BY horizon, factor ORDER BY net) + (count(*) OVER (PARTITION BY horizon, factor, net) - 1)/2.0 AS b FROM u WHERE x IS NOT NULL),
q AS (SELECT *, ntile(5) OVER (PARTITION BY horizon ORDER BY score, fingerprint) AS f5, ntile(10) OVER (PARTITION BY horizon ORDER BY score, fingerprint) AS f10 FROM j), m AS (SELECT horizon, tk, avg(net) AS m FROM q WHERE f5 = 5 GROUP BY 1, 2),
sp AS (SELECT horizon, net, CASE WHEN row_number() OVER (ORDER BY announced, fingerprint, horizon) <= floor(count(*) OVER () * 0.6) THEN 'train' ELSE 'test' END AS part FROM j)
SELECT 'rank' AS section, horizon, 'n' AS key, count(*)::DOUBLE AS value FROM k GROUP BY 2 UNION ALL SELECT 'rank', horizon, 'spearman', nullif(round(corr(a, b), 6), 'nan'::DOUBLE) FROM k GROUP BY 2
UNION ALL SELECT 'slope', horizon, 'ols', round(regr_slope(net, score), 8) FROM j GROUP BY 2 UNION ALL SELECT 'top_fifth', horizon, 'clustered_t', round(avg(m)/(stddev_samp(m)/sqrt(count(*))), 4) FROM m GROUP BY 2
UNION ALL SELECT 'groups', horizon, 'group_' || lpad(CAST(f10 AS VARCHAR), 2, '0'), round(avg(net), 6) FROM q GROUP BY 2, 3 UNION ALL SELECT 'factors', horizon, factor, nullif(round(corr(a, b), 6), 'nan'::DOUBLE) FROM w GROUP BY 2, 3
UNION ALL SELECT 'time', horizon, part, round(avg(net), 6) FROM sp GROUP BY 2, 3""")
def cv11(t):
    rows = scored_returns(t)
    return stats.calibration(rows, list(WEIGHTS))
