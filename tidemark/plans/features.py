"""Queries on point-in-time features and the conviction score."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators import clean, conviction, eventstudy, features
from tidemark.operators import timeseries as ts
from tidemark.plans.core import _CLUSTERS, AS_OF, D, R, buys, clustered, event_returns, tier_firings
from tidemark.plans.registry import query
from tidemark.sources.fixtures import Tables

_ENTRY_OF = "firing f ASOF JOIN {0} p ON f.ticker = p.ticker AND f.announced >= p.dt"


def _on_price(t: Tables, series: DataFrame, take: list[str]) -> DataFrame:
    return ts.last_until(tier_firings(t), series, "announced", take=take).where("found IS NOT NULL")


@query("ft01_52_week_range", """
WITH r AS (SELECT *, min(close) OVER w AS lo, max(close) OVER w AS hi FROM fx_prices WINDOW w AS (PARTITION BY ticker ORDER BY dt ROWS BETWEEN 252 PRECEDING AND CURRENT ROW))
SELECT f.fingerprint, round(p.close / p.lo - 1, 6) AS above_low, round(p.close / p.hi - 1, 6) AS below_high FROM firing f ASOF JOIN r p ON f.ticker = p.ticker AND f.announced >= p.dt""")
def ft01(t):
    r = t.prices.withColumn("lo", ts.rolling(t.prices, F.min("close"), 252)).withColumn("hi", ts.rolling(t.prices, F.max("close"), 252))
    found = _on_price(t, r, ["close", "lo", "hi"])
    return found.select("fingerprint", R(F.col("found.close") / F.col("found.lo") - 1).alias("above_low"), R(F.col("found.close") / F.col("found.hi") - 1).alias("below_high"))


@query("ft02_momentum", """
WITH r AS (SELECT *, close / lag(close, 21) OVER w - 1 AS m1, close / lag(close, 63) OVER w - 1 AS m3, close / lag(close, 126) OVER w - 1 AS m6 FROM fx_prices WINDOW w AS (PARTITION BY ticker ORDER BY dt))
SELECT f.fingerprint, round(m1, 6) AS m1, round(m3, 6) AS m3, round(m6, 6) AS m6 FROM firing f ASOF JOIN r p ON f.ticker = p.ticker AND f.announced >= p.dt""")
def ft02(t):
    w = Window.partitionBy("ticker").orderBy("dt")
    r = t.prices.withColumns({f"m{m}": F.col("close") / F.lag("close", m * 21).over(w) - 1 for m in (1, 3, 6)})
    return _on_price(t, r, ["m1", "m3", "m6"]).select("fingerprint", *[R(f"found.m{m}").alias(f"m{m}") for m in (1, 3, 6)])


@query("ft03_trailing_60", """
WITH r AS (SELECT *, close / lag(close, 60) OVER (PARTITION BY ticker ORDER BY dt) - 1 AS ret FROM fx_prices)
SELECT f.fingerprint, round(ret, 6) AS trailing_60 FROM firing f ASOF JOIN r p ON f.ticker = p.ticker AND f.announced >= p.dt""")
def ft03(t):
    r = t.prices.withColumn("ret", F.col("close") / F.lag("close", 60).over(Window.partitionBy("ticker").orderBy("dt")) - 1)
    return _on_price(t, r, ["ret"]).select("fingerprint", R("found.ret").alias("trailing_60"))


_SPREAD = """
WITH l AS (SELECT *, lag(high) OVER w AS h1, lag(low) OVER w AS l1 FROM fx_prices WINDOW w AS (PARTITION BY ticker ORDER BY dt)),
g AS (SELECT *, pow(ln(high/low),2) + pow(ln(h1/l1),2) AS beta, pow(ln(greatest(high,h1)/least(low,l1)),2) AS gamma, 3 - 2*sqrt(2) AS k FROM l),
a AS (SELECT *, (sqrt(2*beta) - sqrt(beta))/k - sqrt(gamma/k) AS alpha FROM g),
s AS (SELECT *, CASE WHEN h1 IS NOT NULL THEN greatest(0.0, 2*(exp(alpha)-1)/(1+exp(alpha))*10000) END AS daily FROM a),
sp AS (SELECT ticker, dt, close, least(450.0, greatest(5.0, avg(daily) OVER (PARTITION BY ticker ORDER BY dt ROWS BETWEEN 20 PRECEDING AND CURRENT ROW))) AS spread_bps FROM s)
"""


@query("ft04_spread", _SPREAD + "SELECT ticker, dt, round(spread_bps, 4) AS spread_bps FROM sp WHERE spread_bps IS NOT NULL AND dt <> (SELECT min(dt) FROM fx_prices q WHERE q.ticker = sp.ticker)")
def ft04(t):
    first = Window.partitionBy("ticker").orderBy("dt")
    return features.spread_bps(t.prices).withColumn("rn", F.row_number().over(first)).where("rn > 1 AND spread_bps IS NOT NULL").select("ticker", "dt", R("spread_bps", 4).alias("spread_bps"))


@query("es05_dynamic_cost", _SPREAD + """
SELECT f.fingerprint, round(p.spread_bps + CASE WHEN f.is_aim THEN 0 ELSE 50 END, 4) AS cost_bps FROM firing f ASOF JOIN sp p ON f.ticker = p.ticker AND f.announced >= p.dt""")
def es05(t):
    return _on_price(t, features.spread_bps(t.prices), ["spread_bps"]).select("fingerprint", R(F.col("found.spread_bps") + F.when(F.col("is_aim"), 0).otherwise(50), 4).alias("cost_bps"))


@query("es04_flat_cost", "SELECT fingerprint, CASE WHEN is_aim THEN 0.005::DOUBLE ELSE 0.01::DOUBLE END AS cost FROM firing")
def es04(t):
    return tier_firings(t).select("fingerprint", eventstudy.cost(F.col("is_aim")).alias("cost"))


@query("ft05_routine", """
WITH e AS (SELECT b.fingerprint, year(p.announced) AS y, month(p.announced) AS m FROM buys b JOIN buys p ON b.director = p.director AND b.ticker = p.ticker AND p.announced < b.announced),
yy AS (SELECT fingerprint, count(DISTINCT y) AS n_years FROM e GROUP BY 1), mm AS (SELECT fingerprint, max(h) AS best FROM (SELECT fingerprint, m, count(DISTINCT y) AS h FROM e GROUP BY 1, 2) GROUP BY 1)
SELECT b.fingerprint, coalesce(n_years, 0) AS n_years, CASE WHEN coalesce(n_years, 0) < 2 THEN 'insufficient' WHEN best >= greatest(2, floor(n_years/2)+1) THEN 'routine' ELSE 'opportunistic' END AS routine_class
FROM buys b LEFT JOIN yy USING (fingerprint) LEFT JOIN mm USING (fingerprint)""")
def ft05(t):
    return features.routine(buys(t))


@query("ft06_routine_gaps", """
WITH g AS (SELECT *, datediff('day', lag(announced) OVER (PARTITION BY director, ticker ORDER BY announced, fingerprint), announced) AS gap FROM buys)
SELECT director, ticker, count(*) AS n_buys, coalesce(stddev_samp(gap) / nullif(avg(gap), 0) < 0.5, false) AS is_routine FROM g GROUP BY 1, 2 HAVING count(*) >= 3""")
def ft06(t):
    return features.routine_by_gaps(buys(t)).select("director", "ticker", "n_buys", "is_routine")


@query("ft07_reversal", """
SELECT b.fingerprint, CAST(coalesce((SELECT sum(CASE d.type WHEN 'BUY' THEN d.shares WHEN 'SELL' THEN -d.shares ELSE 0 END) FROM fx_dealings d
 WHERE d.director = b.director AND d.ticker = b.ticker AND d.announced >= b.announced - 365 AND d.announced < b.announced), 0) AS BIGINT) AS net_prior_shares FROM buys b""")
def ft07(t):
    return features.reversal(buys(t), t.dealings).select("fingerprint", "net_prior_shares")


@query("ft08_post_results", """
SELECT f.fingerprint, datediff('day', r.report_date, f.announced) AS days_since_results, datediff('day', r.report_date, f.announced) <= 14 AS post_results
FROM firing f ASOF LEFT JOIN (SELECT DISTINCT ticker, report_date FROM fx_reporting_dates WHERE confidence = 'confirmed') r ON f.ticker = r.ticker AND f.announced >= r.report_date""")
def ft08(t):
    return features.post_results(tier_firings(t), t.results).select("fingerprint", "days_since_results", "post_results")


@query("ft10_holding_increase", "SELECT fingerprint, CASE WHEN type = 'BUY' AND shares % 3 > 0 THEN round(shares / (shares % 3 * 100)::DOUBLE, 6) END AS holding_increase FROM fx_dealings")
def ft10(t):
    held = t.dealings.withColumn("resulting", F.col("shares") + F.col("shares") % 3 * 100)
    prior = F.col("resulting") - F.col("shares")
    return held.select("fingerprint", F.when((F.col("type") == "BUY") & (prior > 0), R(F.col("shares") / prior)).alias("holding_increase"))


@query("ft11_salary_multiple", """
SELECT f.fingerprint, CASE WHEN p.pay_status = 'ok' THEN round(f.value / p.pay_gbp, 6) END AS salary_multiple, CASE WHEN p.pay_status = 'ok' AND p.base_gbp > 0 THEN round(f.value / p.base_gbp, 6) END AS base_multiple
FROM firing f ASOF LEFT JOIN (SELECT *, round(pay_gbp * 0.6 - 70000, 2) AS base_gbp FROM fx_director_pay) p ON f.ticker = p.ticker AND f.director = p.director AND f.announced >= p.ar_published_at""")
def ft11(t):
    pay = t.pay.withColumn("base_gbp", R(F.col("pay_gbp") * 0.6 - 70_000, 2))
    out = features.latest_pay(tier_firings(t), pay, ("fy_end", "pay_gbp", "pay_status", "base_gbp"))
    multiple = lambda amount: R(features.salary_multiple(F.col("value"), F.col("found"), amount))
    return out.select("fingerprint", multiple("pay_gbp").alias("salary_multiple"), multiple("base_gbp").alias("base_multiple"))


@query("ft12_fraction_of_company", "SELECT fingerprint, shares / shares_outstanding::DOUBLE AS fraction FROM firing")
def ft12(t):
    return tier_firings(t).select("fingerprint", (F.col("shares") / F.col("shares_outstanding")).alias("fraction"))


@query("ft13_point_in_time_cap", "SELECT f.fingerprint, round(f.shares_outstanding * p.close, 2) AS cap FROM firing f ASOF JOIN fx_prices p ON f.ticker = p.ticker AND f.announced >= p.dt")
def ft13(t):
    return _on_price(t, t.prices, ["close"]).select("fingerprint", R(F.col("shares_outstanding") * F.col("found.close"), 2).alias("cap"))


@query("ft14_cap_class", "SELECT ticker, CASE WHEN market_cap_gbp < 50e6 THEN 'micro' WHEN market_cap_gbp < 500e6 THEN 'small' WHEN market_cap_gbp < 1e9 THEN 'mid' ELSE 'large' END AS cap_class FROM fx_tickers_meta")
def ft14(t):
    return t.meta.select("ticker", clean.cap_class(F.col("market_cap_gbp")).alias("cap_class"))


@query("ft15_disclosure_lag", "SELECT CAST(datediff('day', dt, announced) AS INT) AS lag_days, count(*) AS n FROM fx_dealings GROUP BY 1")
def ft15(t):
    return t.dealings.groupBy(F.datediff("announced", "dt").alias("lag_days")).agg(F.count(F.lit(1)).alias("n"))


@query("ft16_relative_size", """
SELECT b.fingerprint, round(b.value / (SELECT median(p.value) FROM buys p WHERE p.director = b.director AND p.announced < b.announced), 6) AS relative_size FROM buys b""")
def ft16(t):
    return features.relative_size(buys(t)).select("fingerprint", R("relative_size").alias("relative_size"))


@query("ft17_size_to_volume", """
WITH r AS (SELECT *, avg(close*volume) OVER (PARTITION BY ticker ORDER BY dt ROWS BETWEEN 20 PRECEDING AND CURRENT ROW) AS traded FROM fx_prices)
SELECT f.fingerprint, round(f.value / p.traded, 6) AS size_to_volume FROM firing f ASOF JOIN r p ON f.ticker = p.ticker AND f.announced >= p.dt""")
def ft17(t):
    r = t.prices.withColumn("traded", ts.rolling(t.prices, F.avg(F.col("close") * F.col("volume")), 20))
    return _on_price(t, r, ["traded"]).select("fingerprint", R(F.col("value") / F.col("found.traded")).alias("size_to_volume"))


@query("ft18_closed_period", """
SELECT f.fingerprint, datediff('day', f.dt, r.report_date) AS days_to_results, coalesce(datediff('day', f.dt, r.report_date) <= 30, false) AS closed_period
FROM firing f ASOF LEFT JOIN (SELECT DISTINCT ticker, report_date FROM fx_reporting_dates) r ON f.ticker = r.ticker AND f.dt <= r.report_date""")
def ft18(t):
    out = features.pre_results(tier_firings(t), t.results)
    return out.select("fingerprint", "days_to_results", F.coalesce(F.col("days_to_results") <= 30, F.lit(False)).alias("closed_period"))


@query("ft19_signal_age", f"""
SELECT CASE WHEN age <= 45 THEN 'live' WHEN age <= 90 THEN 'ageing' ELSE 'closed' END AS state, count(*) AS n FROM (SELECT datediff('day', announced, DATE '{AS_OF}') AS age FROM firing) WHERE age >= 0 GROUP BY 1""")
def ft19(t):
    age = F.datediff(D(AS_OF), "announced")
    state = F.when(age <= 45, "live").when(age <= 90, "ageing").otherwise("closed")
    return tier_firings(t).where(age >= 0).groupBy(state.alias("state")).agg(F.count(F.lit(1)).alias("n"))


@query("ft21_expected_results", """
WITH last AS (SELECT ticker, report_type, max(report_date) AS d FROM fx_reporting_dates WHERE confidence='confirmed' GROUP BY 1, 2),
e AS (SELECT ticker, report_type, CAST(d + CASE WHEN report_type = 'TRADING_STMT' THEN INTERVAL 6 MONTH ELSE INTERVAL 12 MONTH END AS DATE) AS expected FROM last)
SELECT ticker, report_type, expected, 'est' AS confidence FROM e WHERE NOT EXISTS (SELECT 1 FROM fx_reporting_dates r WHERE r.ticker = e.ticker AND r.report_type = e.report_type AND r.report_date >= e.expected)""")
def ft21(t):
    return features.expected_results(t.results)


# --- conviction score ------------------------------------------------------------

_TIER_WEIGHT = "CASE {0} WHEN 'T1a' THEN 1.0 WHEN 'T7' THEN 1.0 WHEN 'T1b' THEN 0.9 WHEN 'T2' THEN 0.7 WHEN 'T6' THEN 0.5 WHEN 'T3' THEN 0.3 {1} END"
# sizes are compared with each earlier buy, one by one
_CV = f"""
WITH r AS (SELECT *, close / lag(close, 63) OVER w - 1 AS m3, avg(close*volume) OVER (PARTITION BY ticker ORDER BY dt ROWS BETWEEN 20 PRECEDING AND CURRENT ROW) AS traded FROM fx_prices WINDOW w AS (PARTITION BY ticker ORDER BY dt)),
past AS (SELECT b.announced, b.value AS bv, b.value / p.traded AS bt FROM buys b ASOF LEFT JOIN r p ON b.ticker = p.ticker AND b.announced >= p.dt),
p AS (SELECT f.*, p.m3, f.value AS bv, f.value / p.traded AS bt FROM firing f ASOF LEFT JOIN r p ON f.ticker = p.ticker AND f.announced >= p.dt),
sz AS (SELECT p.fingerprint, (count(*) FILTER (past.bv < p.bv) / nullif(count(past.bv), 0) + count(*) FILTER (past.bt < p.bt) / nullif(count(past.bt), 0)) / 2 AS size
 FROM p LEFT JOIN past ON past.announced < p.announced WHERE p.bt IS NOT NULL AND p.bv IS NOT NULL GROUP BY 1),
n AS (SELECT p.*, datediff('day', p.dt, q.report_date) AS ahead FROM p ASOF LEFT JOIN (SELECT DISTINCT ticker, report_date FROM fx_reporting_dates) q ON p.ticker = q.ticker AND p.dt <= q.report_date),
l AS (SELECT n.*, datediff('day', q.report_date, n.announced) AS since FROM n ASOF LEFT JOIN (SELECT DISTINCT ticker, report_date FROM fx_reporting_dates WHERE confidence='confirmed') q ON n.ticker = q.ticker AND n.announced >= q.report_date),
s AS (SELECT l.*, sz.size, {_TIER_WEIGHT.format("tier", "WHEN 'T5' THEN (SELECT max(" + _TIER_WEIGHT.format("b.tier", "") + ") FROM buys b WHERE b.ticker = l.ticker AND b.announced <= l.announced)")}::DOUBLE AS who,
  least(1.0, greatest(0.1, 1.0 - 0.9 * (log10(market_cap_gbp) - log10(20e6)) / (log10(10e9) - log10(20e6)))) AS small,
  CASE WHEN ahead <= 30 THEN 0.0 WHEN ahead <= 45 THEN 0.8 WHEN since <= 14 THEN 1.0 WHEN since IS NOT NULL OR ahead IS NOT NULL THEN 0.3 END AS timing,
  CASE WHEN m3 IS NOT NULL THEN least(1.0, greatest(0.0, 0.5 - m3)) END AS fall FROM l LEFT JOIN sz USING (fingerprint)),
sec AS (SELECT m.sector, r.dt, avg(r.m3) AS moved FROM r JOIN fx_tickers_meta m ON r.ticker = m.ticker GROUP BY 1, 2 HAVING avg(r.m3) IS NOT NULL),
g AS (SELECT s.*, CASE WHEN q.moved > 0 THEN 1 - 0.3 * least(1.0, q.moved / 0.2) ELSE 1.0 END AS guard FROM s ASOF LEFT JOIN sec q ON s.sector = q.sector AND s.announced >= q.dt),
c AS (SELECT *, round(100 * guard * (0.25*coalesce(who,0) + 0.25*coalesce(size,0) + 0.20*coalesce(small,0) + 0.15*coalesce(timing,0) + 0.15*coalesce(fall,0))
  / (0.25*(who IS NOT NULL)::INT + 0.25*(size IS NOT NULL)::INT + 0.20*(small IS NOT NULL)::INT + 0.15*(timing IS NOT NULL)::INT + 0.15*(fall IS NOT NULL)::INT), 4) AS score FROM g)
"""


def scored(t: Tables) -> DataFrame:
    return conviction.scores(tier_firings(t), buys(t), t.kept("prices"), t.results, t.meta)


@query("cv01_who", _CV + "SELECT fingerprint, who FROM c")
def cv01(t):
    return scored(t).select("fingerprint", "who")


@query("cv02_size", _CV + "SELECT fingerprint, round(size, 6) AS size FROM c")
def cv02(t):
    return scored(t).select("fingerprint", R("size").alias("size"))


@query("cv03_company_size", _CV + "SELECT fingerprint, round(small, 6) AS small FROM c")
def cv03(t):
    return scored(t).select("fingerprint", R("small").alias("small"))


@query("cv04_timing", _CV + "SELECT fingerprint, timing::DOUBLE AS timing FROM c")
def cv04(t):
    return scored(t).select("fingerprint", "timing")


@query("cv05_fall", _CV + "SELECT fingerprint, round(fall, 6) AS fall FROM c")
def cv05(t):
    return scored(t).select("fingerprint", R("fall").alias("fall"))


@query("cv06_sector_guard", _CV + "SELECT fingerprint, sector, round(guard, 6) AS guard FROM c")
def cv06(t):
    return scored(t).select("fingerprint", "sector", R("guard").alias("guard"))


@query("cv07_composite", _CV + "SELECT fingerprint, score FROM c")
def cv07(t):
    return scored(t).select("fingerprint", "score")


@query("cv08_bands", _CV + "SELECT CASE WHEN score >= 80 THEN 'Exceptional' WHEN score >= 60 THEN 'High' WHEN score >= 40 THEN 'Moderate' ELSE 'Low' END AS band, count(*) AS n FROM c GROUP BY 1")
def cv08(t):
    return scored(t).groupBy(conviction.band(F.col("score")).alias("band")).agg(F.count(F.lit(1)).alias("n"))


@query("cv09_top_10", _CV + f"SELECT fingerprint, score FROM c WHERE datediff('day', announced, DATE '{AS_OF}') BETWEEN 0 AND 28 ORDER BY score DESC, fingerprint LIMIT 10")
def cv09(t):
    return scored(t).where(F.datediff(D(AS_OF), "announced").between(0, 28)).orderBy(F.desc("score"), "fingerprint").select("fingerprint", "score").limit(10)


@query("cv10_shadow_log", _CV + ", e AS (SELECT fingerprint, max(net) FILTER (horizon='t30') AS t30, max(net) FILTER (horizon='t90') AS t90 FROM es GROUP BY 1) SELECT c.fingerprint, c.score, round(t30, 6) AS net_t30, round(t90, 6) AS net_t90 FROM c LEFT JOIN e USING (fingerprint)")
def cv10(t):
    nets = event_returns(t).groupBy("fingerprint").agg(*[R(F.max(F.when(F.col("horizon") == h, F.col("net")))).alias(f"net_{h}") for h in ("t30", "t90")])
    return scored(t).select("fingerprint", "score").join(nets, "fingerprint", "left")


@query("ft20_cluster_breadth", _CLUSTERS + "SELECT cluster_id, count(DISTINCT director) AS breadth, CAST(datediff('day', min(dt), max(dt)) AS INT) AS days FROM cl GROUP BY 1")
def ft20(t):
    return clustered(t).groupBy("cluster_id").agg(F.countDistinct("director").alias("breadth"), F.datediff(F.max("dt"), F.min("dt")).alias("days"))
