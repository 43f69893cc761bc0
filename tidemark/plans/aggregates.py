"""Queries on scoreboards, cohorts, leaderboards and monthly activity."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators import aggregate as ag
from tidemark.operators import clean, clusters, eventstudy
from tidemark.operators import timeseries as ts
from tidemark.operators.ranking import exact_medians, kept
from tidemark.plans.core import _CLUSTERS, _EVAL, _SUMMARY, AS_OF, D, R, buys, clustered, event_returns, tier_firings
from tidemark.plans.registry import STEPS, query
from tidemark.sources.fixtures import Tables

_BUCKET = "CASE WHEN value >= 500000 THEN '500k+' WHEN value >= 100000 THEN '100k-500k' WHEN value >= 25000 THEN '25k-100k' WHEN value >= 1000 THEN '1k-25k' END"


def n_rows():
    return F.count(F.lit(1)).alias("n")


def nets(t: Tables) -> DataFrame:
    return event_returns(t).where("net IS NOT NULL")


@query("ag01_scoreboard", f"""
SELECT signal, horizon, count(*) AS n, round(100.0 * count(*) FILTER (car > 0) / count(*), 1) AS hit_pct, round(median(car) * 100, 1) AS median_car, round(avg(car) * 100, 1) AS mean_car
FROM es WHERE car IS NOT NULL AND datediff('day', announced, DATE '{AS_OF}') BETWEEN 0 AND 365 AND later_dt <= DATE '{AS_OF}' GROUP BY 1, 2""")
def ag01(t):
    return ag.scoreboard(ag.matured(event_returns(t), AS_OF), ["signal", "horizon"], "car", digits=1)


@query("ag02_base_rate", """
SELECT days, count(*) AS n, round(100.0 * count(*) FILTER (r > 0) / count(*), 4) AS positive_pct FROM (SELECT h.days, lead(close, h.days) OVER (PARTITION BY h.days ORDER BY dt) / close - 1 AS r
 FROM fx_prices CROSS JOIN (SELECT DISTINCT days FROM hz) h WHERE ticker = '^ALL') WHERE r IS NOT NULL GROUP BY 1""")
def ag02(t):
    return ag.base_rates(t.prices.where("ticker = '^ALL'"), sorted(eventstudy.HORIZONS.values()))


@query("ag03_edge", """
SELECT s.signal, s.horizon, round(s.m - b.m, 4) AS edge FROM (SELECT signal, horizon, median(car)*100 AS m FROM es WHERE car IS NOT NULL GROUP BY 1, 2) s
JOIN (SELECT horizon, median(market)*100 AS m FROM es WHERE market IS NOT NULL GROUP BY 1) b USING (horizon)""")
def ag03(t):
    es = event_returns(t)
    es = kept(es.select("signal", "horizon", "car", "market"))
    market = exact_medians(es, ["horizon"], ["market"]).select("horizon", (F.col("market") * 100).alias("bench"))
    own = exact_medians(es, ["signal", "horizon"], ["car"]).select("signal", "horizon", (F.col("car") * 100).alias("own"))
    return own.join(market, "horizon").select("signal", "horizon", R(F.col("own") - F.col("bench"), 4).alias("edge"))


@query("ag04_status", f"""
WITH w AS (SELECT signal, car, datediff('day', announced, DATE '{AS_OF}') AS age FROM es WHERE horizon='t30' AND car IS NOT NULL),
m AS (SELECT signal, median(car) FILTER (age BETWEEN 0 AND 27) AS cur, median(car) FILTER (age BETWEEN 28 AND 55) AS prior, count(*) FILTER (age BETWEEN 0 AND 27) AS n FROM w GROUP BY 1)
SELECT signal, n, CASE WHEN signal = 't7_chair_buy' THEN 'gated' WHEN n < 5 THEN 'review' WHEN cur < 0 AND prior < 0 THEN 'kill?' WHEN cur < 0 THEN 'review' ELSE 'live' END AS status FROM m""")
def ag04(t):
    return ag.status(event_returns(t).where("horizon = 't30' AND car IS NOT NULL"), AS_OF, gated=("t7_chair_buy",))


@query("ag05_sparkline", """
WITH months AS (SELECT CAST(range AS DATE) AS month FROM range(DATE '1997-01-01', DATE '1998-01-01', INTERVAL 1 MONTH)),
m AS (SELECT CAST(date_trunc('month', announced) AS DATE) AS month, signal, median(car) AS med FROM es WHERE horizon='t30' GROUP BY 1, 2)
SELECT s.signal, months.month, round(m.med, 6) AS med FROM months CROSS JOIN (SELECT DISTINCT signal FROM firing) s LEFT JOIN m ON m.month = months.month AND m.signal = s.signal""")
def ag05(t):
    es = event_returns(t).where("horizon = 't30'")
    rows = kept(es.select(F.trunc("announced", "month").alias("month"), "signal", "car"))
    med = exact_medians(rows, ["month", "signal"], ["car"]).select("month", "signal", R("car").alias("med"))
    grid = tier_firings(t).select("signal").distinct().withColumn("month", F.explode(F.sequence(D("1997-01-01"), D("1997-12-01"), F.expr("INTERVAL 1 MONTH"))))
    return grid.join(med, ["signal", "month"], "left")


@query("ag06_cohort_tiles", f"""
WITH d AS (SELECT *, {_BUCKET} AS bucket FROM es WHERE car IS NOT NULL), l AS (SELECT d.*, v.lookback FROM d JOIN (VALUES ('90d',90),('183d',183),('365d',365),('all',1000000)) v(lookback,age)
 ON datediff('day', announced, DATE '{AS_OF}') BETWEEN 0 AND v.age),
u AS (SELECT 'value' AS dim, bucket AS key, horizon, lookback, car FROM l UNION ALL SELECT 'role', tier, horizon, lookback, car FROM l UNION ALL SELECT 'sector', sector, horizon, lookback, car FROM l)
SELECT dim, key, horizon, lookback, count(*) AS n, round(100.0 * count(*) FILTER (car > 0) / count(*), 4) AS hit_pct, round(median(car)*100, 4) AS median_car, max(abs(car)) > 2.0 AS outlier FROM u GROUP BY 1, 2, 3, 4""")
def ag06(t):
    dims = {"value": clean.value_bucket(F.col("value")), "role": F.col("tier"), "sector": F.col("sector")}
    return ag.cohort_tiles(clean.lookback_rows(event_returns(t).where("car IS NOT NULL"), "announced", AS_OF), dims)


@query("ag07_sector_ends", """
WITH s AS (SELECT sector, count(*) AS n, round(median(car)*100, 4) AS median_car FROM es WHERE horizon='t90' AND car IS NOT NULL GROUP BY 1 HAVING count(*) >= 10)
SELECT sector, n, median_car, row_number() OVER (ORDER BY median_car DESC, sector) AS top, row_number() OVER (ORDER BY median_car, sector) AS bottom FROM s
QUALIFY top <= 3 OR bottom <= 2""")
def ag07(t):
    s = event_returns(t).where("horizon = 't90' AND car IS NOT NULL")
    s = ag.with_medians(s.select("sector", "car"), ["sector"], [n_rows()], {"median_car": "car"}).where("n >= 10")
    top = F.row_number().over(Window.orderBy(F.desc("median_car"), "sector"))
    low = F.row_number().over(Window.orderBy("median_car", "sector"))
    return s.withColumn("top", top).withColumn("bottom", low).where("top <= 3 OR bottom <= 2")


@query("ag08_drill", """
WITH r AS (SELECT fingerprint, signal, ticker, car, market, row_number() OVER (PARTITION BY signal ORDER BY car DESC, fingerprint) AS a, row_number() OVER (PARTITION BY signal ORDER BY car, fingerprint) AS b,
 count(*) OVER (PARTITION BY signal, ticker) AS nt FROM es WHERE horizon='t90' AND car IS NOT NULL)
SELECT signal, count(*) AS n, count(DISTINCT ticker) AS n_tickers, count(DISTINCT ticker) FILTER (nt >= 3) AS n_tickers_3, round(100.0 * count(*) FILTER (car > 0) / count(*), 4) AS hit_pct, round(median(car)*100, 4) AS median_car,
 round(median(market)*100, 4) AS median_market, list(fingerprint ORDER BY a) FILTER (a <= 10) AS top10, list(fingerprint ORDER BY b) FILTER (b <= 10) AS bottom10 FROM r GROUP BY 1""")
def ag08(t):
    return ag.drill(event_returns(t).where("horizon = 't90' AND car IS NOT NULL"), "signal")


@query("ag09_ticker_rollup", """
SELECT ticker, count(*) AS n, round(100.0 * count(*) FILTER (car > 0) / count(*), 4) AS hit_pct, round(avg(car)*100, 4) AS mean_car, max(announced) AS latest FROM es WHERE horizon='t90' AND car IS NOT NULL GROUP BY 1""")
def ag09(t):
    rows = event_returns(t).where("horizon = 't90' AND car IS NOT NULL")
    out = rows.groupBy("ticker").agg(n_rows(), R(100.0 * F.count_if(F.col("car") > 0) / F.count(F.lit(1)), 4).alias("hit_pct"), R(F.avg("car") * 100, 4).alias("mean_car"), F.max("announced").alias("latest"))
    return out.orderBy((F.col("n") >= 3).desc(), F.desc("hit_pct"), "ticker")


_MONTHLY = "WITH m AS (SELECT signal, CAST(date_trunc('month', announced) AS DATE) AS month, horizon, count(*) AS n_all, count(car) AS n, avg(car) AS mean, min(car) AS lo, max(car) AS hi, count(*) FILTER (car > 0) AS hits FROM es GROUP BY 1, 2, 3) "


@query("ag10_monthly_cohorts", _MONTHLY + "SELECT signal, month, horizon, n_all, n, round(mean, 6) AS mean, round(lo, 6) AS lo, round(hi, 6) AS hi, hits FROM m")
def ag10(t):
    m = ag.monthly(event_returns(t))
    return m.select("signal", "month", "horizon", "n_all", "n", R("mean").alias("mean"), R("lo").alias("lo"), R("hi").alias("hi"), "hits")


@query("ag11_rolling_hit", _MONTHLY + """, k AS (SELECT *, year(month)*12 + month(month) AS ix FROM m)
SELECT signal, month, horizon, round(sum(hits) OVER w * 100.0 / nullif(sum(n) OVER w, 0), 4) AS hit_6m FROM k WINDOW w AS (PARTITION BY signal, horizon ORDER BY ix RANGE BETWEEN 5 PRECEDING AND CURRENT ROW)""")
def ag11(t):
    m = ag.monthly(event_returns(t)).withColumn("ix", F.year("month") * 12 + F.month("month"))
    w = Window.partitionBy("signal", "horizon").orderBy("ix").rangeBetween(-5, 0)
    return m.select("signal", "month", "horizon", R(F.sum("hits").over(w) * 100.0 / F.nullif(F.sum("n").over(w), F.lit(0)), 4).alias("hit_6m"))


@query("ag12_moving_average", _MONTHLY + """SELECT signal, month, horizon, CASE WHEN row_number() OVER (PARTITION BY signal, horizon ORDER BY month) >= 3 THEN
 round(avg(mean) OVER (PARTITION BY signal, horizon ORDER BY month ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), 6) END AS ma3 FROM m""")
def ag12(t):
    w = Window.partitionBy("signal", "horizon").orderBy("month")
    m = ag.monthly(event_returns(t))
    return m.select("signal", "month", "horizon", F.when(F.row_number().over(w) >= 3, R(F.avg("mean").over(w.rowsBetween(-2, 0)))).alias("ma3"))


@query("ag13_trend", _MONTHLY + """, r AS (SELECT *, row_number() OVER (PARTITION BY signal, horizon ORDER BY month DESC) AS back FROM m WHERE mean IS NOT NULL),
d AS (SELECT signal, horizon, count(*) AS n_months, avg(mean) FILTER (back <= 3) - avg(mean) FILTER (back BETWEEN 4 AND 6) AS delta FROM r GROUP BY 1, 2)
SELECT signal, horizon, CASE WHEN n_months >= 6 THEN round(delta, 6) END AS delta, CASE WHEN n_months < 6 THEN NULL WHEN delta > 0.01 THEN 'up' WHEN delta < -0.01 THEN 'down' ELSE 'flat' END AS trend FROM d""")
def ag13(t):
    m = ag.monthly(event_returns(t)).where("mean IS NOT NULL")
    r = m.withColumn("back", F.row_number().over(Window.partitionBy("signal", "horizon").orderBy(F.desc("month"))))
    late, early = F.avg(F.when(F.col("back") <= 3, F.col("mean"))), F.avg(F.when(F.col("back").between(4, 6), F.col("mean")))
    d = r.groupBy("signal", "horizon").agg(F.count(F.lit(1)).alias("n_months"), (late - early).alias("delta")).withColumn("delta", F.when(F.col("n_months") >= 6, F.col("delta")))
    return d.select("signal", "horizon", R("delta").alias("delta"), F.when(F.col("delta") > 0.01, "up").when(F.col("delta") < -0.01, "down").when(F.col("delta").isNotNull(), "flat").alias("trend"))


_SHARE = """WITH t AS (SELECT signal, ticker, sum(car) AS r FROM es WHERE horizon='t90' AND car IS NOT NULL GROUP BY 1, 2), s AS (SELECT *, abs(r) / sum(abs(r)) OVER (PARTITION BY signal) AS share FROM t) """


@query("ag14_shares", _SHARE + "SELECT signal, ticker, round(share, 6) AS share, max(share) OVER (PARTITION BY signal) > 0.5 AS dominated FROM s")
def ag14(t):
    return ag.shares(event_returns(t).where("horizon = 't90' AND car IS NOT NULL")).select("signal", "ticker", R("share").alias("share"), "dominated")


@query("ag15_verdict", _SHARE + """, m AS (SELECT signal, arg_max(ticker, (share, ticker)) AS top, max(share) AS share, arg_max(r, (share, ticker)) AS r, max(share) - min(share) AS spread FROM s GROUP BY 1)
SELECT signal, CASE WHEN spread < 0.05 THEN 'consistent' WHEN r < 0 THEN 'drag: ' || top ELSE 'contributor: ' || top END AS verdict FROM m""")
def ag15(t):
    s = ag.shares(event_returns(t).where("horizon = 't90' AND car IS NOT NULL"))
    order = F.struct("share", "ticker")
    m = s.groupBy("signal").agg(F.max_by("ticker", order).alias("top"), F.max_by("r", order).alias("r"), (F.max("share") - F.min("share")).alias("spread"))
    text = F.when(F.col("spread") < 0.05, "consistent").when(F.col("r") < 0, F.concat(F.lit("drag: "), "top")).otherwise(F.concat(F.lit("contributor: "), "top"))
    return m.select("signal", text.alias("verdict"))


@query("ag16_pending_months", _MONTHLY + "SELECT signal, month, horizon FROM m WHERE n_all > 0 AND mean IS NULL")
def ag16(t):
    return ag.monthly(event_returns(t)).where("n_all > 0 AND mean IS NULL").select("signal", "month", "horizon")


@query("ag17_value_weighted", "SELECT signal, horizon, round(avg(car), 6) AS mean_car, round(sum(value*car)/sum(value), 6) AS vw_mean_car FROM es WHERE car IS NOT NULL GROUP BY 1, 2")
def ag17(t):
    rows = event_returns(t).where("car IS NOT NULL")
    return rows.groupBy("signal", "horizon").agg(R(F.avg("car")).alias("mean_car"), R(F.sum(F.col("value") * F.col("car")) / F.sum("value")).alias("vw_mean_car"))


_BS = """WITH m AS (SELECT CAST(date_trunc('month', announced) AS DATE) AS month, sum(value) FILTER (type='BUY') AS bought, -sum(value) FILTER (type='SELL') AS sold, count(*) FILTER (type='BUY') AS n_buys, count(*) FILTER (type='SELL') AS n_sells
 FROM fx_dealings WHERE role NOT LIKE 'Person%' GROUP BY 1) """


def monthly_buysell(t: Tables) -> DataFrame:
    return ag.buy_sell(t.dealings.where(clean.role_bucket(F.col("role")) != "PCA"))


@query("ag18_monthly_buysell", _BS + """, g AS (SELECT CAST(range AS DATE) AS month FROM range(DATE '1997-02-01', DATE '1998-02-01', INTERVAL 1 MONTH))
SELECT g.month, round(bought, 2) AS bought, round(sold, 2) AS sold, n_buys, n_sells FROM g LEFT JOIN m USING (month)""")
def ag18(t):
    grid = t.spark.range(1).select(F.explode(F.sequence(D("1997-02-01"), D("1998-01-01"), F.expr("INTERVAL 1 MONTH"))).alias("month"))
    return grid.join(monthly_buysell(t), "month", "left").select("month", R("bought", 2).alias("bought"), R("sold", 2).alias("sold"), "n_buys", "n_sells")


@query("ag19_trailing_year", _BS + """, r AS (SELECT *, sum(bought) OVER (ORDER BY month ROWS BETWEEN 11 PRECEDING AND CURRENT ROW) AS year_bought, row_number() OVER (ORDER BY month) AS rn FROM m)
SELECT month, round(year_bought, 2) AS year_bought, CASE WHEN rn >= 13 THEN round(year_bought - lag(year_bought) OVER (ORDER BY month), 2) END AS change FROM r""")
def ag19(t):
    w = Window.orderBy("month")
    r = monthly_buysell(t).withColumn("year_bought", F.sum("bought").over(w.rowsBetween(-11, 0))).withColumn("rn", F.row_number().over(w))
    change = F.when(F.col("rn") >= 13, R(F.col("year_bought") - F.lag("year_bought").over(w), 2))
    return r.select("month", R("year_bought", 2).alias("year_bought"), change.alias("change"))


@query("ag20_signals_today", """
WITH c AS (SELECT announced AS day, count(DISTINCT fingerprint) AS n FROM firing GROUP BY 1), g AS (SELECT CAST(range AS DATE) AS day FROM range(DATE '1997-01-01', DATE '1998-01-01', INTERVAL 1 DAY)),
d AS (SELECT day, coalesce(n, 0) AS n FROM g LEFT JOIN c USING (day))
SELECT day, n, round(n - avg(n) OVER (ORDER BY day ROWS BETWEEN 7 PRECEDING AND 1 PRECEDING), 6) AS delta FROM d""")
def ag20(t):
    grid = t.spark.range(1).select(F.explode(F.sequence(D("1997-01-01"), D("1997-12-31"))).alias("day"))
    counts = tier_firings(t).groupBy(F.col("announced").alias("day")).agg(F.countDistinct("fingerprint").alias("n"))
    d = grid.join(counts, "day", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    return d.select("day", "n", R(F.col("n") - F.avg("n").over(Window.orderBy("day").rowsBetween(-7, -1))).alias("delta"))


@query("ag21_month_histogram", "SELECT strftime(dt, '%Y-%m') AS month, type, count(*) AS n, min(dt) AS first_day, max(dt) AS last_day FROM fx_dealings GROUP BY 1, 2")
def ag21(t):
    return t.dealings.groupBy(F.date_format("dt", "yyyy-MM").alias("month"), "type").agg(n_rows(), F.min("dt").alias("first_day"), F.max("dt").alias("last_day"))


_BASKETS = "(VALUES ('executives',['t1a_ceo_founder_buy','t1b_cfo_buy','t2_exec_buy'],false),('chairs',['t7_chair_buy'],false),('small_neds',['t3_ned_buy'],true))"


@query("ag22_baskets", f"""
WITH b AS (SELECT * FROM {_BASKETS} v(basket, signals, small)), r AS (SELECT b.basket, es.fingerprint, max(net) FILTER (horizon='t30') AS t30, max(net) FILTER (horizon='t90') AS t90 FROM b JOIN es ON list_contains(b.signals, es.signal)
 AND (NOT b.small OR es.market_cap_gbp < 500e6) GROUP BY 1, 2 UNION ALL SELECT 'all firings', fingerprint, max(net) FILTER (horizon='t30'), max(net) FILTER (horizon='t90') FROM es GROUP BY fingerprint),
m AS (SELECT basket, count(*) AS n, round(median(t30)*100, 2) AS median_t30, round(median(t90)*100, 2) AS median_t90, round(100.0*count(*) FILTER (t90 > 0)/count(t90), 2) AS positive_pct, count(t90) >= 30 AS proven FROM r GROUP BY 1)
SELECT *, CASE WHEN basket <> 'all firings' THEN CAST(row_number() OVER (PARTITION BY basket = 'all firings' ORDER BY median_t90 DESC NULLS LAST, basket) AS INT) END AS place FROM m""")
def ag22(t):
    config = t.spark.createDataFrame(
        [("executives", ["t1a_ceo_founder_buy", "t1b_cfo_buy", "t2_exec_buy"], False), ("chairs", ["t7_chair_buy"], False), ("small_neds", ["t3_ned_buy"], True)],
        "basket string, signals array<string>, small boolean",
    )
    return ag.baskets(event_returns(t), config)


_LEADER = ("t30", "t60", "t90", "t360")


@query("ag23_director_leaderboard", f"""
WITH hz2 AS (SELECT * FROM (VALUES ('t30',21),('t60',42),('t90',63),('t360',252)) v(horizon,days)),
e0 AS ({STEPS["es0"].replace("hz", "hz2")}),
f AS (SELECT director, fingerprint, any_value(ticker) AS ticker, any_value(value) AS value, {", ".join(f"max(raw - market - CASE WHEN is_aim THEN 0.005 ELSE 0.01 END) FILTER (horizon='{h}') AS {h}" for h in _LEADER)} FROM e0 GROUP BY 1, 2),
d AS (SELECT director, count(*) AS n_buys, count(DISTINCT ticker) AS n_tickers, round(sum(value), 2) AS total, round(count(*) FILTER (t90 > 0)/count(t90), 4) AS win_rate, {", ".join(f"count({h}) AS n_{h}, round(median({h}), 5) AS median_{h}, round(avg({h}), 5) AS mean_{h}" for h in _LEADER)}
 FROM f GROUP BY 1 HAVING count(t90) >= 3)
SELECT *, row_number() OVER (ORDER BY median_t90 DESC, director) AS place FROM d""")
def ag23(t):
    return ag.leaderboard(eventstudy.returns(t.kept("firings", lambda: tier_firings(t)), t.kept("prices"), {"t30": 21, "t60": 42, "t90": 63, "t360": 252}), _LEADER)


@query("ag24_tier_hit_rate", "SELECT tier, horizon, count(*) AS n, round(100.0*count(*) FILTER (net > 0)/count(*), 4) AS hit_pct, count(*) < 10 AS low_n FROM es WHERE net IS NOT NULL GROUP BY 1, 2")
def ag24(t):
    return ag.scoreboard(nets(t), ["tier", "horizon"], "net").select("tier", "horizon", "n", "hit_pct", (F.col("n") < 10).alias("low_n"))


@query("ag25_company_stats", "SELECT ticker, count(*) AS n, CASE WHEN count(*) >= 5 THEN round(100.0*count(*) FILTER (net > 0)/count(*), 4) END AS hit_pct, CASE WHEN count(*) >= 5 THEN round(median(net)*100, 4) END AS median_net FROM es WHERE horizon='t90' AND net IS NOT NULL GROUP BY 1")
def ag25(t):
    out = ag.scoreboard(nets(t).where("horizon = 't90'"), ["ticker"], "net")
    return out.select("ticker", "n", F.when(F.col("n") >= 5, F.col("hit_pct")).alias("hit_pct"), F.when(F.col("n") >= 5, F.col("median_net")).alias("median_net"))


@query("ag26_upcoming_events", f"SELECT ticker, report_date, report_type FROM fx_reporting_dates WHERE report_date BETWEEN DATE '{AS_OF}' AND DATE '{AS_OF}' + 14")
def ag26(t):
    return t.results.where(F.col("report_date").between(D(AS_OF), F.date_add(D(AS_OF), 14))).select("ticker", "report_date", "report_type")


@query("ag28_concentration", """
WITH f AS (SELECT signal, ticker, count(*) AS n FROM firing GROUP BY 1, 2), m AS (SELECT signal, CAST(date_trunc('month', announced) AS DATE) AS mo, count(*) AS n FROM firing GROUP BY 1, 2),
w AS (SELECT signal, round(max(car) / sum(car), 6) AS top_winner_share FROM es WHERE horizon = 't90' AND car > 0 GROUP BY 1)
SELECT f.signal, max(f.n) AS top_ticker_n, round(max(f.n)::DOUBLE / sum(f.n), 6) AS top_ticker_share, any_value(q.s) AS top_month_share, any_value(w.top_winner_share) AS top_winner_share
FROM f JOIN (SELECT signal, round(max(n)::DOUBLE / sum(n), 6) AS s FROM m GROUP BY 1) q ON q.signal = f.signal LEFT JOIN w ON w.signal = f.signal GROUP BY 1""")
def ag28(t):
    return ag.concentration(tier_firings(t), event_returns(t).where("horizon = 't90'"))


@query("ag29_kill_list", "SELECT ticker, count(*) AS n, round(avg(car), 6) AS mean_car FROM es WHERE horizon='t90' AND car IS NOT NULL GROUP BY 1 HAVING count(*) >= 20 AND avg(car) < 0")
def ag29(t):
    out = event_returns(t).where("horizon = 't90' AND car IS NOT NULL").groupBy("ticker").agg(n_rows(), F.avg("car").alias("m")).where("n >= 20 AND m < 0")
    return out.select("ticker", "n", R("m").alias("mean_car"))


@query("ag30_monthly_capital", """
WITH c AS (SELECT CAST(date_trunc('month', b.announced) AS DATE) AS month, CASE WHEN m.market_cap_gbp < 500e6 THEN 'small' ELSE 'large' END AS band, b.value FROM buys b JOIN fx_tickers_meta m USING (ticker)),
g AS (SELECT month, coalesce(band, 'all') AS band, sum(value) AS capital FROM c GROUP BY GROUPING SETS ((month, band), (month)))
SELECT month, band, round(capital, 2) AS capital, round(avg(capital) OVER (PARTITION BY band ORDER BY month ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), 2) AS ma3 FROM g""")
def ag30(t):
    rows = buys(t).join(t.meta, "ticker").select(F.trunc("announced", "month").alias("month"), F.when(F.col("market_cap_gbp") < 500e6, "small").otherwise("large").alias("band"), "value")
    g = rows.rollup("month", "band").agg(F.sum("value").alias("capital")).where("month IS NOT NULL").withColumn("band", F.coalesce("band", F.lit("all")))
    ma = F.avg("capital").over(Window.partitionBy("band").orderBy("month").rowsBetween(-2, 0))
    return g.select("month", "band", R("capital", 2).alias("capital"), R(ma, 2).alias("ma3"))


@query("ag31_sector_size_grid", """
WITH r AS (SELECT sector, CASE WHEN market_cap_gbp < 500e6 THEN 'small' ELSE 'large' END AS size, ticker, net FROM es WHERE horizon='t90' AND net IS NOT NULL),
k AS (SELECT coalesce(sector,'all') AS sector, coalesce(size,'all') AS size, ticker, count(*) AS n, avg(net) AS m, sum(net) AS s, count(*) FILTER (net > 0) AS h FROM r GROUP BY GROUPING SETS ((sector,size,ticker),(sector,ticker),(size,ticker),(ticker)))
SELECT sector, size, CAST(sum(n) AS BIGINT) AS n, count(*) AS n_tickers, round(sum(s)/sum(n), 6) AS mean_net, round(100.0*sum(h)/sum(n), 4) AS hit_pct, round(avg(m)/(stddev_samp(m)/sqrt(count(*))), 4) AS clustered_t FROM k GROUP BY 1, 2""")
def ag31(t):
    r = nets(t).where("horizon = 't90'").select("sector", F.when(F.col("market_cap_gbp") < 500e6, "small").otherwise("large").alias("size"), "ticker", "net")
    every = lambda c: F.explode(F.array(F.col(c), F.lit("all")))
    k = r.withColumn("sector", every("sector")).withColumn("size", every("size")).groupBy("sector", "size", "ticker").agg(n_rows(), F.avg("net").alias("m"), F.sum("net").alias("s"), F.count_if(F.col("net") > 0).alias("h"))
    tstat = F.avg("m") / (F.stddev_samp("m") / F.sqrt(F.count(F.lit(1))))
    return k.groupBy("sector", "size").agg(
        F.sum("n").alias("n"), F.count(F.lit(1)).alias("n_tickers"), R(F.sum("s") / F.sum("n")).alias("mean_net"), R(100.0 * F.sum("h") / F.sum("n"), 4).alias("hit_pct"), R(tstat, 4).alias("clustered_t")
    )


#: How strong a signal is, the strongest first.
SEVERITY = {"t0_cluster_combo": 0, **{v[3]: v[2] for v in clean.TIERS.values()}, "s1_cluster_buy": 9, "f1_first_time_buy": 10, "b1_lone_conviction_buy": 11}
_SEVERITY = "CASE signal " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in SEVERITY.items()) + " END"


@query("ag32_dealing_feed", _EVAL + f""", sev AS (SELECT fingerprint, signal, {_SEVERITY} AS rank FROM final), g AS (SELECT fingerprint, CAST(min(rank) AS INT) AS severity, list(signal ORDER BY rank) AS signals_fired FROM sev GROUP BY 1),
latest AS (SELECT ticker, arg_max(close, dt) AS last_close FROM fx_prices GROUP BY ticker),
mk AS (SELECT d.fingerprint, round((l.last_close / p.close - 1) * 100 - CASE WHEN t.is_aim THEN 0.5 ELSE 1.0 END, 2) AS mtm_pct FROM fx_dealings d ASOF JOIN fx_prices p ON d.ticker = p.ticker AND d.announced < p.dt JOIN fx_tickers_meta t ON t.ticker = d.ticker JOIN latest l ON l.ticker = d.ticker)
SELECT CASE WHEN d.announced = DATE '{AS_OF}' THEN 'today' ELSE 'this_week' END AS section, d.fingerprint, d.ticker, d.value, g.severity, g.signals_fired, mk.mtm_pct FROM fx_dealings d JOIN g USING (fingerprint) LEFT JOIN mk USING (fingerprint)
WHERE datediff('day', d.announced, DATE '{AS_OF}') BETWEEN 0 AND 7""")
def ag32(t):
    from tidemark.operators.signals import evaluate

    entered = eventstudy.entries(t.dealings.where("type = 'BUY'").join(t.meta, "ticker"), ts.trade_index(t.prices))
    return ag.feed(t.dealings, evaluate(t.dealings, t.prices), eventstudy.mark_to_market(entered, t.prices), SEVERITY, AS_OF)


@query("ag33_company_status", _SUMMARY + ", " + _EVAL[5:] + f""", cs AS (SELECT ticker, count(*) FILTER (age < 30) AS n_active, count(*) FILTER (age BETWEEN 30 AND 90) AS n_brewing, count(*) FILTER (age > 90) AS n_past, max(last_date) AS last_cluster
 FROM (SELECT *, datediff('day', last_date, DATE '{AS_OF}') AS age FROM s WHERE last_date <= DATE '{AS_OF}') GROUP BY 1),
fs AS (SELECT ticker, max(fired_at) AS last_fired FROM final JOIN (SELECT fingerprint, ticker FROM fx_dealings) USING (fingerprint) WHERE fired_at <= DATE '{AS_OF}' GROUP BY 1),
rs AS (SELECT ticker, count(DISTINCT report_date) AS n_results, max(report_date) AS last_results FROM fx_reporting_dates WHERE report_date <= DATE '{AS_OF}' GROUP BY 1)
SELECT ticker, coalesce(n_active, 0) AS n_active, coalesce(n_brewing, 0) AS n_brewing, coalesce(n_past, 0) AS n_past, last_cluster, last_fired, coalesce(datediff('day', last_fired, DATE '{AS_OF}') <= 7, false) AS fired_this_week, coalesce(n_results, 0) AS n_results, last_results
FROM cs FULL JOIN fs USING (ticker) FULL JOIN rs USING (ticker)""")
def ag33(t):
    from tidemark.operators.signals import evaluate

    return ag.company_status(clusters.summaries(clustered(t)), evaluate(t.dealings, t.prices), t.results, AS_OF)


@query("ag34_pay_worklist", "SELECT ticker, director, count(*) AS n FROM firing WHERE tier <> 'T5' GROUP BY 1, 2")
def ag34(t):
    return tier_firings(t).where("tier <> 'T5'").groupBy("ticker", "director").agg(n_rows()).orderBy(F.desc("n"), "ticker", "director")


@query("ag35_month_drill", """SELECT month, type, fingerprint FROM (SELECT strftime(announced, '%Y-%m') AS month, type, fingerprint, row_number() OVER (PARTITION BY strftime(announced, '%Y-%m'), type ORDER BY value DESC, fingerprint) AS rn FROM fx_dealings) WHERE rn <= 500""")
def ag35(t):
    rows = t.dealings.withColumn("month", F.date_format("announced", "yyyy-MM"))
    rn = F.row_number().over(Window.partitionBy("month", "type").orderBy(F.desc("value"), "fingerprint"))
    return rows.withColumn("rn", rn).where("rn <= 500").select("month", "type", "fingerprint")


_GRID = f"snap AS (SELECT DISTINCT CAST(DATE '{AS_OF}' - CAST(i AS INT) AS DATE) AS day FROM (SELECT i FROM range(30) v(i) UNION ALL SELECT 7*i FROM range(8) v(i)))"
_WALK = _CLUSTERS.replace("WITH b AS (SELECT *, datediff('day', DATE '1970-01-01', dt) AS day FROM buys)", f"""WITH {_GRID}, b AS (SELECT x.fingerprint, x.director, x.dt, x.value, x.ticker || '@' || CAST(snap.day AS VARCHAR) AS ticker, snap.day AS as_of,
 datediff('day', DATE '1970-01-01', x.dt) AS day FROM buys x JOIN snap ON x.announced <= snap.day AND datediff('day', x.dt, snap.day) BETWEEN 0 AND 366)""")


@query("cl05_brewing_trend", _WALK + f""", lst AS (SELECT as_of, cluster_id, max(dt) AS last_date FROM cl GROUP BY 1, 2), cnt AS (SELECT as_of, count(*) AS n FROM lst WHERE datediff('day', last_date, as_of) BETWEEN 30 AND 90 GROUP BY 1),
every AS (SELECT snap.day, datediff('day', snap.day, DATE '{AS_OF}') AS age, coalesce(cnt.n, 0) AS n FROM snap LEFT JOIN cnt ON cnt.as_of = snap.day)
SELECT max(n) FILTER (age = 0) AS current, round(avg(n) FILTER (age < 30), 4) AS mean_30d, list(n ORDER BY day) FILTER (age % 7 = 0 AND age < 56) AS weekly FROM every""")
def cl05(t):
    return clusters.brewing_trend(buys(t), AS_OF)


@query("cl06_cluster_intensity", """
WITH o AS (SELECT a.fingerprint, count(DISTINCT b.director) AS others FROM firing a LEFT JOIN buys b ON a.ticker = b.ticker AND a.director <> b.director AND abs(datediff('day', a.dt, b.dt)) <= 30 AND b.announced <= a.announced GROUP BY 1)
SELECT others, count(*) AS n, round(100.0*count(*) FILTER (car > 0)/count(*), 4) AS hit_pct FROM es JOIN o USING (fingerprint) WHERE horizon='t30' AND car IS NOT NULL GROUP BY 1""")
def cl06(t):
    from tidemark.operators.signals import context, other_counts

    ctx = context(t.dealings, t.prices)
    seen = ["ticker", "dt", "announced"]
    rows = event_returns(t).where("horizon = 't30' AND car IS NOT NULL").groupBy(*seen, F.col("director").isNotNull().alias("named")).agg(n_rows(), F.count_if(F.col("car") > 0).alias("hits"))
    out = rows.join(other_counts(ctx.buys, ctx.strict), seen, "left").withColumn("others", F.coalesce(F.when(F.col("named"), F.col("others")), F.lit(0)))
    return out.groupBy("others").agg(F.sum("n").alias("n"), R(100.0 * F.sum("hits") / F.sum("n"), 4).alias("hit_pct"))
