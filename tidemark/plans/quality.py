"""Queries on data quality, extraction from pages, and writes."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.operators import checks, eventstudy, extract, groups, timeseries, writes
from tidemark.plans.aggregates import n_rows
from tidemark.plans.core import AS_OF, D, R, buys, tier_firings
from tidemark.plans.registry import query
from tidemark.streaming.jobs import work_path
from tidemark.streaming.tables import parted_table

# Derived prices have an error every so often, so that the checks find something.
_PRICED = """priced AS (SELECT d.*, p.close, CASE d.fingerprint % 6 WHEN 0 THEN p.close*100 WHEN 1 THEN p.close*7 WHEN 2 THEN p.close*1000 ELSE p.close*1.1 END AS price
 FROM fx_dealings d ASOF LEFT JOIN fx_prices p ON d.ticker = p.ticker AND d.announced >= p.dt)"""


def priced(t):
    found = timeseries.last_until(t.dealings, t.prices, "announced", take=["close"]).withColumn("close", F.col("found.close")).drop("found")
    k = F.col("fingerprint") % 6
    factor = F.when(k == 0, F.col("close") * 100).when(k == 1, F.col("close") * 7).when(k == 2, F.col("close") * 1000).otherwise(F.col("close") * 1.1)
    return found.withColumn("price", factor)


@query("dq01_date_audit", f"""
WITH d AS (SELECT fingerprint, CASE WHEN fingerprint % 17 = 0 THEN strftime(dt, '%d %b %Y') WHEN fingerprint % 19 = 0 THEN CAST(announced + 20 AS VARCHAR) WHEN fingerprint % 23 = 0 THEN CAST(dt - 1500 AS VARCHAR) ELSE CAST(dt AS VARCHAR) END AS dt, CAST(announced AS VARCHAR) AS announced FROM fx_dealings),
p AS (SELECT fingerprint, TRY_CAST(dt AS DATE) AS d, CAST(announced AS DATE) AS a FROM d), n AS (SELECT count(*) AS n_rows FROM p),
c AS (SELECT 'I1_format' AS rule, count(*) FILTER (d IS NULL OR a IS NULL) AS n_failed FROM p UNION ALL SELECT 'I2_future', count(*) FILTER (a > DATE '{AS_OF}' + 1) FROM p UNION ALL SELECT 'I3_after_filing', count(*) FILTER (d > a + 7) FROM p
 UNION ALL SELECT 'I4_stale', count(*) FILTER (d < a - 1095) FROM p UNION ALL SELECT 'I5_firing', count(*) FILTER (abs(datediff('day', p.d, p.a)) > 365) FROM p JOIN firing USING (fingerprint))
SELECT rule, n_failed, n_rows FROM c CROSS JOIN n""")
def dq01(t):
    k = lambda n: F.col("fingerprint") % n == 0
    shown = F.when(k(17), F.date_format("dt", "dd MMM yyyy")).when(k(19), F.date_add("announced", 20).cast("string")).when(k(23), F.date_sub("dt", 1500).cast("string")).otherwise(F.col("dt").cast("string"))
    dealings = t.dealings.select("fingerprint", shown.alias("dt"), F.col("announced").cast("string").alias("announced"))
    counts, _ = checks.date_audit(dealings, tier_firings(t).select("fingerprint", F.col("announced").alias("fired_at")), AS_OF)
    return counts


@query("dq01_date_violations", "SELECT 'I3_after_filing' AS rule, fingerprint, CAST(announced + 20 AS VARCHAR) AS dt, CAST(announced AS VARCHAR) AS announced FROM fx_dealings WHERE fingerprint % 19 = 0")
def dq01_violations(t):
    """The offending keys of the same audit."""
    shown = F.when(F.col("fingerprint") % 19 == 0, F.date_add("announced", 20)).otherwise(F.col("dt")).cast("string")
    dealings = t.dealings.select("fingerprint", shown.alias("dt"), F.col("announced").cast("string").alias("announced"))
    _, broken = checks.date_audit(dealings, tier_firings(t).select("fingerprint", F.col("announced").alias("fired_at")), "2100-01-01")
    return broken


@query("dq02_plausibility", f"""WITH {_PRICED}
SELECT fingerprint, list_filter([CASE WHEN coalesce(value,0) < 1 AND type NOT IN ('GRANT','EXERCISE','SIP') THEN 'R1_sub_pound_value' END, CASE WHEN shares < 100 AND coalesce(price,0) < 1 AND type <> 'SIP' THEN 'R2_tiny_shares_low_price' END,
 CASE WHEN coalesce(price,0) > 200 AND ticker NOT IN ('Brand#1') THEN 'R3_price_too_high' END, CASE WHEN value > 100e6 THEN 'R4_excessive_value' END, CASE WHEN (shares BETWEEN 1 AND 31 OR shares BETWEEN 1990 AND 2099) AND value < 100 THEN 'R5_date_component_in_shares' END], lambda x: x IS NOT NULL) AS reasons FROM priced""")
def dq02(t):
    return priced(t).select("fingerprint", checks.plausibility(trust_allowed=["Brand#1"]).alias("reasons"))


@query("dq03_year_as_shares", "SELECT fingerprint, shares, year(dt) = shares AS hard FROM (SELECT fingerprint, dt, shares + 1700 AS shares FROM fx_dealings) WHERE shares BETWEEN 1990 AND 2099")
def dq03(t):
    return checks.year_as_shares(t.dealings.withColumn("shares", F.col("shares") + 1700)).select("fingerprint", "shares", "hard")


@query("dq04_duplicate_number", "SELECT fingerprint FROM (SELECT fingerprint, shares + 1000 AS shares, shares + 1000 + (fingerprint % 5) * 0.2 AS price FROM fx_dealings) WHERE price > 1000 AND shares > 1000 AND abs(price - shares) < 0.5")
def dq04(t):
    rows = t.dealings.select("fingerprint", (F.col("shares") + 1000).alias("shares"), (F.col("shares") + 1000 + (F.col("fingerprint") % 5) * 0.2).alias("price"))
    return checks.same_number(rows).select("fingerprint")


@query("dq05_price_units", f"""WITH {_PRICED}
SELECT CASE WHEN close IS NULL THEN 'no_market_price' WHEN abs(price/close-1) <= 0.35 THEN 'ok_pounds' WHEN abs(price/100/close-1) <= 0.35 THEN 'corrected_pence' WHEN type IN ('GRANT','EXERCISE') AND value <= 100e6 THEN 'ok_pounds' ELSE 'unresolved_quarantine' END AS status, count(*) AS n FROM priced GROUP BY 1""")
def dq05(t):
    fixed = checks.reconciled_price(F.col("price"), F.col("close"), F.col("type"), F.col("value"))
    return priced(t).groupBy(fixed["status"].alias("status")).agg(n_rows())


@query("dq06_price_recovery", "SELECT fingerprint, CASE WHEN fingerprint % 4 = 0 THEN CASE WHEN value/shares <= 500 THEN round(value/shares, 6) END ELSE 10.0 END AS price FROM fx_dealings")
def dq06(t):
    rows = t.dealings.withColumn("price", F.when(F.col("fingerprint") % 4 != 0, 10.0))
    return rows.select("fingerprint", R(checks.price_recovery(F.col("price"), F.col("value"), F.col("shares"))).alias("price"))


@query("dq07_error_classes", f"""WITH {_PRICED} SELECT CASE WHEN q BETWEEN 0.5 AND 2 THEN 'ok' WHEN q BETWEEN 5 AND 20 OR q BETWEEN 0.05 AND 0.2 THEN '10x' WHEN q BETWEEN 50 AND 200 OR q BETWEEN 0.005 AND 0.02 THEN '100x' WHEN q BETWEEN 500 AND 2000 OR q BETWEEN 0.0005 AND 0.002 THEN '1000x' ELSE 'extreme' END AS class, count(*) AS n
FROM (SELECT price/close AS q FROM priced WHERE close IS NOT NULL) GROUP BY 1""")
def dq07(t):
    return priced(t).where("close IS NOT NULL").groupBy(checks.error_class(F.col("price") / F.col("close")).alias("class")).agg(n_rows())


@query("dq08_exact_dedup", "SELECT fingerprint, ticker, value, 1 + (fingerprint % 9 = 0)::INT::BIGINT AS copies FROM fx_dealings")
def dq08(t):
    """Every ninth dealing comes twice; one of each key stays."""
    return checks.first_copies(t.dealings.unionByName(t.dealings.where("fingerprint % 9 = 0"))).select("fingerprint", "ticker", "value", "copies")


@query("dq09_near_duplicates", """SELECT a.fingerprint, b.fingerprint AS earlier_fp FROM fx_dealings a JOIN fx_dealings b ON a.director = b.director AND (b.dt, b.fingerprint) < (a.dt, a.fingerprint) AND datediff('day', b.dt, a.dt) <= 7 AND abs(a.value - b.value) <= 0.05*b.value""")
def dq09(t):
    return checks.near_duplicates(t.dealings)


@query("dq09_survivors", """SELECT fingerprint, group_key, group_key = fingerprint AS stays FROM (
WITH RECURSIVE e AS (SELECT a.fingerprint AS a, b.fingerprint AS b FROM fx_dealings a JOIN fx_dealings b ON a.director = b.director AND a.fingerprint <> b.fingerprint AND abs(datediff('day', a.dt, b.dt)) <= 7
  AND abs(a.value - b.value) <= 0.05 * CASE WHEN a.dt < b.dt THEN a.value WHEN b.dt < a.dt THEN b.value ELSE least(a.value, b.value) END),
reach AS (SELECT fingerprint AS a, fingerprint AS b FROM fx_dealings UNION SELECT reach.a, e.b FROM reach JOIN e ON reach.b = e.a)
SELECT reach.a AS fingerprint, arg_min(d.fingerprint, (d.dt, d.fingerprint)) AS group_key FROM reach JOIN fx_dealings d ON d.fingerprint = reach.b GROUP BY 1)""")
def dq09_survivors(t):
    """Of each chain of near dealings the first stays."""
    return groups.near_groups(t.dealings).select("fingerprint", "group_key", "stays")


_DIFF = """x AS (SELECT fingerprint, field, CASE WHEN fingerprint % 13 = 0 THEN 'FAILED' WHEN fingerprint % 17 = 0 AND field = 'value' THEN 'AMBIGUOUS' ELSE v END AS verdict FROM (
 SELECT fingerprint, 'value' AS field, CASE WHEN fingerprint % 7 = 0 THEN 'MAJOR' WHEN fingerprint % 5 = 0 THEN 'MINOR' ELSE 'MATCH' END AS v FROM fx_dealings
 UNION ALL SELECT fingerprint, 'role', CASE WHEN fingerprint % 11 = 0 THEN 'MAJOR' WHEN fingerprint % 3 = 0 THEN 'MINOR' ELSE 'MATCH' END FROM fx_dealings UNION ALL SELECT fingerprint, 'type', 'MATCH' FROM fx_dealings))"""


def field_diff(t):
    """Sources differ in value by a lot or a little, or are two; roles differ, or have a title before; some are missing."""
    fp = F.col("fingerprint")
    value = F.when(fp % 7 == 0, F.col("value") * 2).when(fp % 5 == 0, F.col("value") * 1.001).otherwise(F.col("value"))
    role = F.when(fp % 11 == 0, "?").when(fp % 3 == 0, F.concat(F.lit("Group "), "role")).otherwise(F.concat(F.lit(" "), F.upper("role")))
    source = t.dealings.where(fp % 13 != 0).select("fingerprint", value.alias("value"), role.alias("role"), "type")
    twice = source.where(fp % 17 == 0).withColumn("value", F.col("value") + 1)
    return checks.field_diff(t.dealings, source.unionByName(twice), "fingerprint", {"value": 0.01}, ["role", "type"])


@query("dq10_field_diff", f"WITH {_DIFF} SELECT fingerprint, field, verdict FROM x")
def dq10(t):
    return field_diff(t)


@query("dq10_match_rates", f"WITH {_DIFF} SELECT field, " + ", ".join(f"count(*) FILTER (verdict = '{v.upper()}') AS {v}" for v in ("match", "minor", "major", "ambiguous", "failed")) + " FROM x GROUP BY 1")
def dq10_rates(t):
    return checks.match_rates(field_diff(t))


@query("dq11_stratified_sample", "SELECT type, fingerprint FROM (SELECT type, fingerprint, row_number() OVER (PARTITION BY type ORDER BY md5(CAST(fingerprint AS VARCHAR)), fingerprint) AS rn FROM fx_dealings) WHERE rn <= CASE type WHEN 'BUY' THEN 25 WHEN 'SELL' THEN 20 ELSE 10 END")
def dq11(t):
    rn = F.row_number().over(Window.partitionBy("type").orderBy(F.md5(F.col("fingerprint").cast("string").cast("binary")), "fingerprint"))
    most = F.when(F.col("type") == "BUY", 25).when(F.col("type") == "SELL", 20).otherwise(10)
    return t.dealings.withColumn("rn", rn).where(F.col("rn") <= most).select("type", "fingerprint")


@query("dq11_audit_sample", f"""
WITH s AS (SELECT v.stratum, v.most, d.fingerprint FROM fx_dealings d JOIN (VALUES ('any', 50), ('recent', 50), ('small cap', 30), ('other types', 20)) v(stratum, most) ON v.stratum = 'any'
  OR v.stratum = 'recent' AND datediff('day', d.announced, DATE '{AS_OF}') BETWEEN 0 AND 90 OR v.stratum = 'small cap' AND CAST(substring(d.ticker, 7) AS INT) % 3 = 0 OR v.stratum = 'other types' AND d.type NOT IN ('BUY', 'SELL'))
SELECT stratum, fingerprint FROM s QUALIFY row_number() OVER (PARTITION BY stratum ORDER BY md5('1:' || fingerprint), fingerprint) <= most""")
def dq11_audit(t):
    """An audit sample of 200: a quarter of any rows, a quarter recent, the rest small caps and other types."""
    strata = {
        "any": (F.lit(True), 0.25), "recent": (F.datediff(D(AS_OF), "announced").between(0, 90), 0.25),
        "small cap": (F.substring("ticker", 7, 9).cast("int") % 3 == 0, 0.15), "other types": (~F.col("type").isin("BUY", "SELL"), 0.10),
    }
    return checks.sample_strata(t.dealings, strata, 200, "fingerprint")


@query("dq13_bad_batches", """
WITH r AS (SELECT *, CASE WHEN confidence = 'est' THEN 'model' ELSE 'diary' END AS source, report_date - CAST(day(report_date) % 3 AS INT) AS fetched FROM fx_reporting_dates)
SELECT report_date, report_type, source, fetched, count(DISTINCT ticker) AS n_tickers FROM r GROUP BY 1, 2, 3, 4 HAVING count(DISTINCT ticker) >= 2""")
def dq13(t):
    source = F.when(F.col("confidence") == "est", "model").otherwise("diary")
    fetched = F.date_sub("report_date", F.dayofmonth("report_date") % 3).cast("timestamp") + F.expr("INTERVAL 5 HOURS")
    return checks.bad_batches(t.results.withColumns({"source": source, "fetched_at": fetched}))


@query("dq14_coverage", """
WITH s AS (SELECT DISTINCT b.ticker FROM buys b JOIN fx_short_positions s ON s.ticker = b.ticker AND abs(datediff('day', b.announced, s.position_date)) <= 90), r AS (SELECT DISTINCT b.ticker FROM buys b JOIN fx_reporting_dates r ON r.ticker = b.ticker AND abs(datediff('day', b.announced, r.report_date)) <= 90)
SELECT count(DISTINCT b.ticker) AS n_tickers, count(DISTINCT b.ticker) FILTER (b.ticker IN (SELECT ticker FROM s)) AS with_shorts, count(DISTINCT b.ticker) FILTER (b.ticker IN (SELECT ticker FROM r)) AS with_results,
 count(DISTINCT b.ticker) FILTER (m.sector IS NOT NULL) AS with_sector, count(DISTINCT b.ticker) FILTER (m.market_cap_gbp >= 10e6) AS with_cap FROM buys b LEFT JOIN fx_tickers_meta m ON m.ticker = b.ticker""")
def dq14(t):
    own = buys(t)
    shorts = checks.near_coverage(own, t.shorts, "position_date").withColumn("s", F.lit(1))
    results = checks.near_coverage(own, t.results, "report_date").withColumn("r", F.lit(1))
    meta = t.meta.select("ticker", "sector", F.when(F.col("market_cap_gbp") >= 10e6, F.col("market_cap_gbp")).alias("cap"))
    rows = own.select("ticker").distinct().join(shorts, "ticker", "left").join(results, "ticker", "left").join(meta, "ticker", "left")
    return rows.agg(F.count(F.lit(1)).alias("n_tickers"), *[F.count(c).alias(n) for c, n in (("s", "with_shorts"), ("r", "with_results"), ("sector", "with_sector"), ("cap", "with_cap"))])


def _cache(t):
    linked = t.dealings.withColumn("rns_id", F.when(F.col("fingerprint") % 10 != 0, F.col("fingerprint")))
    return checks.cache_coverage(linked, t.dealings.where("fingerprint % 3 = 0").select(F.col("fingerprint").alias("rns_id")))


@query("dq15_cache_coverage", "SELECT CASE WHEN fingerprint % 10 = 0 THEN 'no_url' WHEN fingerprint % 3 = 0 THEN 'cached' ELSE 'not_cached' END AS state, count(*) AS n, round(sum(value), 2) AS total FROM fx_dealings GROUP BY 1")
def dq15(t):
    return _cache(t)[0]


@query("dq15_largest_not_cached", "SELECT fingerprint, value FROM fx_dealings WHERE fingerprint % 10 <> 0 AND fingerprint % 3 <> 0 ORDER BY value DESC, fingerprint LIMIT 15")
def dq15_largest(t):
    return _cache(t)[1].select("fingerprint", "value")


@query("dq16_role_corpus", "SELECT type, role, count(*) AS n FROM fx_dealings GROUP BY 1, 2")
def dq16(t):
    return t.dealings.groupBy("type", "role").agg(n_rows()).orderBy(F.desc("n"), "type", "role")


@query("dq17_blast_radius", "SELECT signal, count(DISTINCT fingerprint) AS n FROM firing WHERE shares BETWEEN 100 AND 200 GROUP BY 1")
def dq17(t):
    flagged = t.dealings.where("shares BETWEEN 100 AND 200").select("fingerprint")
    return tier_firings(t).join(flagged, "fingerprint", "left_semi").groupBy("signal").agg(F.countDistinct("fingerprint").alias("n"))


@query("dq18_unclassified", "SELECT count(*) FILTER (market_cap_gbp < 10e6) AS n FROM fx_tickers_meta")
def dq18(t):
    return t.meta.withColumn("cap", F.when(F.col("market_cap_gbp") >= 10e6, F.col("market_cap_gbp"))).agg(F.count_if(F.col("cap").isNull()).alias("n"))


_PAIDROLE = "p AS (SELECT y.ticker, y.fy_end, r.role, max(y.pay_gbp) AS pay FROM fx_director_pay y JOIN (SELECT DISTINCT ticker, director, role FROM fx_dealings) r ON y.ticker = r.ticker AND y.director = r.director GROUP BY 1, 2, 3)"


@query("dq19_pay_sanity", f"WITH {_PAIDROLE} SELECT a.ticker, a.fy_end FROM p a JOIN p b ON a.ticker = b.ticker AND a.fy_end = b.fy_end AND a.role = 'Chief Financial Officer' AND b.role = 'Chief Executive Officer' WHERE a.pay > b.pay")
def dq19(t):
    roles = t.dealings.select("ticker", "director", "role").distinct()
    paid = t.pay.join(roles, ["ticker", "director"]).groupBy("ticker", "fy_end").agg(
        F.max(F.when(F.col("role") == "Chief Financial Officer", F.col("pay_gbp"))).alias("cfo"), F.max(F.when(F.col("role") == "Chief Executive Officer", F.col("pay_gbp"))).alias("ceo")
    )
    return paid.where("cfo > ceo").select("ticker", "fy_end")


@query("dq20_closed_period", "SELECT b.fingerprint FROM buys b ASOF JOIN (SELECT DISTINCT ticker, report_date FROM fx_reporting_dates WHERE confidence='confirmed') r ON b.ticker = r.ticker AND b.dt <= r.report_date WHERE datediff('day', b.dt, r.report_date) <= 30")
def dq20(t):
    confirmed = t.results.where("confidence = 'confirmed'").select("ticker", "report_date").distinct()
    found = timeseries.first_from(buys(t), confirmed, "dt", when="report_date")
    return found.where(F.datediff("found.report_date", "dt") <= 30).select("fingerprint")


_SPLIT = """px9 AS (SELECT * REPLACE (CASE WHEN idx > 300 AND ticker LIKE 'Brand%5' THEN close / 10 ELSE close END AS close) FROM px), en AS (SELECT f.*, p.dt AS entry_dt, p.idx AS entry_idx, p.close AS entry_close FROM firing f ASOF JOIN px9 p ON f.ticker = p.ticker AND f.announced < p.dt WHERE p.idx > 30),
v9 AS (SELECT e.fingerprint, e.ticker, hz.horizon, e.entry_dt, p.dt AS later_dt, p.close / e.entry_close AS ratio FROM en e CROSS JOIN hz JOIN px9 p ON p.ticker = e.ticker AND p.idx = e.entry_idx + hz.days WHERE NOT p.close / e.entry_close BETWEEN 0.25 AND 4)"""


@query("fil09_split_guard", f"WITH {_SPLIT} SELECT fingerprint, ticker, horizon, entry_dt, later_dt, round(ratio, 6) AS ratio FROM v9")
def fil09(t):
    """Some tickers' prices fall to a tenth at an unadjusted split; what the guard takes out comes as violations."""
    split = timeseries.trade_index(t.prices).withColumn("close", F.when((F.col("idx") > 300) & F.col("ticker").rlike("^Brand.*5$"), F.col("close") / 10).otherwise(F.col("close"))).drop("idx")
    return eventstudy.split_violations(eventstudy.returns(tier_firings(t), split)).withColumn("ratio", R("ratio"))


# --- extraction ------------------------------------------------------------------


@query("src09_filing_scan", "SELECT page_id, length(html) AS n_chars FROM pages")
def src09(t):
    return t.read("pages").select("page_id", F.char_length("html").cast("long").alias("n_chars"))


_TEXT = "html"
for _pattern, _new in ((r"(?is)<script\\b.*?</script>", " "), (r"(?is)<style\\b.*?</style>", " "), (r"(?i)<(br|/p|/td|/tr|/div|/li|/h[1-6])[^>]*>", "\n"), (r"<[^>]*>", " ")):
    _TEXT = f"regexp_replace({_TEXT}, '{_pattern}', '{_new}', 'g')".replace("\\\\", "\\")
for _name, _char in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "''"), ("&pound;", "£"), ("&amp;", "&")):
    _TEXT = f"replace({_TEXT}, '{_name}', '{_char}')"


@query("ext01_html_text", f"SELECT page_id, trim(regexp_replace(regexp_replace({_TEXT}, '[ \\t]+', ' ', 'g'), ' ?\\n[ \\n]*', chr(10), 'g'), ' ') AS text FROM pages")
def ext01(t):
    return t.read("pages").select("page_id", extract.html_text(F.col("html")).alias("text"))


@query("ext05_rns_id", r"""SELECT page_id, CASE WHEN regexp_matches(p, '^[0-9]{5,12}$') THEN p END AS rns_id FROM (SELECT page_id, list_last(string_split(regexp_replace(regexp_replace(url, '[?#].*$', ''), '/+$', ''), '/')) AS p FROM pages)""")
def ext05(t):
    return t.read("pages").select("page_id", extract.rns_id(F.col("url")).alias("rns_id"))


@query("ext04_kind", """SELECT fingerprint, CASE type WHEN 'BUY' THEN 'BUY' WHEN 'SELL' THEN 'SELL' WHEN 'GRANT' THEN 'GRANT' WHEN 'EXERCISE' THEN 'EXERCISE' ELSE 'SIP' END AS kind FROM fx_dealings""")
def ext04(t):
    words = {"BUY": "Purchase of ordinary shares", "SELL": "Sale of shares", "GRANT": "Grant of options", "EXERCISE": "Exercise of options", "SIP": "Share Incentive Plan"}
    text = F.element_at(F.create_map(*[F.lit(x) for kv in words.items() for x in kv]), F.col("type"))
    return t.dealings.select("fingerprint", extract.kind(text).alias("kind"))


@query("ext02_labelled_date", "SELECT fingerprint, CASE WHEN fingerprint % 3 <> 2 THEN dt END AS day FROM fx_dealings")
def ext02(t):
    shown = F.when(F.col("fingerprint") % 3 == 0, F.date_format("dt", "dd/MM/yyyy")).otherwise(F.date_format("dt", "d MMMM yyyy"))
    label = F.when(F.col("fingerprint") % 3 != 2, "Date of the transaction: ").otherwise("Published ")
    return t.dealings.select("fingerprint", extract.labelled_date(F.concat(label, shown)).alias("day"))


@query("ext03_price", "SELECT fingerprint, CASE WHEN fingerprint % 3 = 2 THEN round(shares * 1.0 / 100, 6) ELSE shares::DOUBLE END AS price, CASE fingerprint % 3 WHEN 0 THEN 'GBP' WHEN 1 THEN 'foreign' ELSE 'GBX' END AS unit FROM fx_dealings")
def ext03(t):
    k = F.col("fingerprint") % 3
    text = F.when(k == 0, F.concat(F.lit("Price £"), "shares")).when(k == 1, F.concat(F.lit("Price US$"), "shares")).otherwise(F.concat(F.lit("Price "), "shares", F.lit("p")))
    p = extract.price(text)
    return t.dealings.select("fingerprint", R(p["price"]).alias("price"), p["unit"].alias("unit"))


@query("ext06_buy_strictness", """SELECT fingerprint, CASE WHEN type = 'BUY' AND fingerprint % 4 = 0 THEN 'MIXED' WHEN type = 'BUY' THEN 'STRICT_BUY' WHEN type = 'SELL' THEN 'UNKNOWN' ELSE 'NON_BUY_ONLY' END AS strictness FROM fx_dealings""")
def ext06(t):
    words = {"BUY": "On-market purchase of ordinary shares", "SELL": "Sale of shares", "GRANT": "Grant of options", "EXERCISE": "Exercise of options", "SIP": "Share Incentive Plan"}
    text = F.element_at(F.create_map(*[F.lit(x) for kv in words.items() for x in kv]), F.col("type"))
    text = F.when((F.col("type") == "BUY") & (F.col("fingerprint") % 4 == 0), F.concat(text, F.lit(" under the LTIP"))).otherwise(text)
    return t.dealings.select("fingerprint", extract.buy_strictness(text, F.col("value")).alias("strictness"))


@query("ext07_tranches", "SELECT l_orderkey AS rns_id, CAST(sum(l_quantity) AS DOUBLE) AS shares, round(sum(l_extendedprice)/sum(l_quantity), 6) AS price, CAST(max(l_shipdate) AS DATE) AS dt, count(*) AS n_tranches FROM lineitem GROUP BY 1")
def ext07(t):
    rows = t.read("lineitem").select(F.col("l_orderkey").alias("rns_id"), F.col("l_quantity").cast("double").alias("shares"), (F.col("l_extendedprice") / F.col("l_quantity")).alias("price"), F.col("l_shipdate").cast("date").alias("dt"))
    return extract.roll_up(rows, ["rns_id"]).withColumn("price", R("price"))


@query("ext10_ingest_gate", "SELECT 'ingested' AS lane, count(*) AS n FROM fx_dealings WHERE fingerprint % 5 <> 0 UNION ALL SELECT 'pending', count(*) FROM fx_dealings WHERE fingerprint % 5 = 0")
def ext10(t):
    marked = t.dealings.withColumn("warnings", F.when(F.col("fingerprint") % 5 == 0, F.array(F.lit("bad_price"))).when(F.col("fingerprint") % 7 == 0, F.array(F.lit("late_filing"))).otherwise(F.array().cast("array<string>"))).withColumnRenamed("type", "kind")
    ingested, pending = extract.gate(marked)
    return ingested.agg(n_rows()).select(F.lit("ingested").alias("lane"), "n").unionByName(pending.agg(n_rows()).select(F.lit("pending").alias("lane"), "n"))


@query("ext12_fingerprint", "SELECT fingerprint, substring(sha256(CAST(dt AS VARCHAR)||'|'||ticker||'|'||director||'|'||type||'|'||shares), 1, 16) AS fp FROM fx_dealings")
def ext12(t):
    return t.dealings.select("fingerprint", extract.fingerprint(*[F.col(c) for c in ("dt", "ticker", "director", "type", "shares")]).alias("fp"))


# --- writes, as merges ------------------------------------------------------------


@query("snk01_upsert_seen", """SELECT fingerprint, value, CASE WHEN fingerprint % 3 = 0 THEN DATE '1998-02-01' ELSE DATE '1998-01-01' END AS first_seen, CASE WHEN fingerprint % 2 = 0 OR fingerprint % 3 = 0 THEN DATE '1998-02-01' ELSE DATE '1998-01-01' END AS last_seen,
 CASE WHEN fingerprint % 3 = 0 THEN 1 WHEN fingerprint % 2 = 0 THEN 2 ELSE 1 END AS seen_count FROM fx_dealings""")
def snk01(t):
    rows = t.dealings.select("fingerprint", "value")
    old = rows.where("fingerprint % 3 <> 0").withColumns({"first_seen": D("1998-01-01"), "last_seen": D("1998-01-01"), "seen_count": F.lit(1)})
    return writes.upsert_seen(old, rows.where("fingerprint % 2 = 0 OR fingerprint % 3 = 0"), "fingerprint", "1998-02-01")


@query("snk01_parted_upsert", """SELECT fingerprint, value, DATE '1998-01-01' + CAST(least(fingerprint % 3, 1) AS INT) * 31 AS first_seen, CASE WHEN fingerprint % 5 = 0 THEN DATE '1998-03-01' WHEN fingerprint % 3 = 0 THEN DATE '1998-01-01' ELSE DATE '1998-02-01' END AS last_seen,
 1 + CAST(fingerprint % 5 = 0 AS INT) AS seen_count FROM fx_dealings""")
def snk01_parted(t):
    """Three numbered batches into a table of parts; the second comes twice and counts once."""
    rows, target, fp = t.dealings.select("fingerprint", "value"), work_path(t.spark, "upsert"), F.col("fingerprint")
    for number, inside, seen in ((0, fp % 3 == 0, "1998-01-01"), (1, fp % 3 != 0, "1998-02-01"), (1, fp % 3 != 0, "1998-02-01"), (2, fp % 5 == 0, "1998-03-01")):
        writes.upsert_into(rows.where(inside), number, target, "fingerprint", seen, parts=16)
    return parted_table(t.spark, target).select("fingerprint", "value", "first_seen", "last_seen", "seen_count")


@query("snk02_insert_new", "SELECT ticker, dt, close FROM fx_prices WHERE dt < DATE '1997-01-01' UNION ALL SELECT ticker, dt, close + 1 FROM fx_prices WHERE dt >= DATE '1997-01-01'")
def snk02(t):
    p = t.prices.select("ticker", "dt", "close")
    return writes.insert_new(p.where("dt < DATE'1997-01-01'"), p.where("dt >= DATE'1996-01-01'").withColumn("close", F.col("close") + 1), ["ticker", "dt"])


@query("snk02_backfill", """
WITH old AS (SELECT ticker, dt, close FROM fx_prices WHERE dt < CASE CAST(ascii(right(ticker, 1)) AS INT) % 3 WHEN 0 THEN DATE '1992-06-01' WHEN 1 THEN DATE '1996-01-01' ELSE DATE '1900-01-01' END),
s AS (SELECT ticker, count(*) AS n, max(dt) AS last FROM old GROUP BY 1)
SELECT * FROM old UNION ALL SELECT p.ticker, p.dt, p.close + 1 FROM fx_prices p LEFT JOIN s USING (ticker) WHERE coalesce(s.n, 0) < 250 AND (s.last IS NULL OR p.dt > s.last)""")
def snk02_backfill(t):
    """Tickers hold nothing, some days or many; only those with fewer than 250 days are fetched, from the day after their last one."""
    p = t.kept("prices").select("ticker", "dt", "close")
    third = F.ascii(F.right("ticker", F.lit(1))) % 3
    upto = F.when(third == 0, D("1992-06-01")).when(third == 1, D("1996-01-01")).otherwise(D("1900-01-01"))
    return writes.backfill(p.where(F.col("dt") < upto), p.withColumn("close", F.col("close") + 1))


@query("snk03_latest_wins", "SELECT fingerprint, CASE WHEN value > 200000 THEN 'high' ELSE confidence END AS confidence FROM firing")
def snk03(t):
    f = tier_firings(t).select("fingerprint", "confidence", "value")
    new = f.where("value > 200000").select("fingerprint", F.lit("high").alias("confidence"))
    return writes.latest_wins(f.select("fingerprint", "confidence"), new, ["fingerprint"])


@query("snk04_replace_slice", "SELECT ticker, report_date, report_type, confidence FROM fx_reporting_dates WHERE confidence <> 'est' UNION ALL SELECT ticker, report_date + 1, report_type, confidence FROM fx_reporting_dates WHERE confidence = 'est'")
def snk04(t):
    new = t.results.where("confidence = 'est'").withColumn("report_date", F.date_add("report_date", 1))
    return writes.replace_slice(t.results, new, F.col("confidence") == "est")


@query("snk07_parity_counts", "SELECT 'dealings' AS name, (SELECT count(DISTINCT fingerprint) FROM fx_dealings) AS n_keys, (SELECT count(DISTINCT fingerprint) FROM fx_dealings) AS n_same, 0 AS n_other UNION ALL SELECT 'prices', (SELECT count(*) FROM fx_prices), (SELECT count(*) FROM fx_prices), 0 UNION ALL SELECT 'results', (SELECT count(DISTINCT (ticker, report_date, report_type, confidence)) FROM fx_reporting_dates), (SELECT count(DISTINCT (ticker, report_date, report_type, confidence)) FROM fx_reporting_dates), 0")
def snk07(t):
    """All tables are copied, and copy and source compared key by key and by content."""
    tables = {"dealings": (t.dealings, ["fingerprint"]), "prices": (t.prices, ["ticker", "dt"]), "results": (t.results, ["ticker", "report_date", "report_type", "confidence"])}
    return writes.reload(t.spark, tables, work_path(t.spark, "reload"))


@query("snk09_price_coverage", "SELECT ticker, min(dt) AS first_day, max(dt) AS last_day, count(*) AS n FROM fx_prices GROUP BY 1")
def snk09(t):
    """Prices are written as text, and their coverage is counted from that."""
    text = writes.snapshot(t.prices, work_path(t.spark, "snapshot"))
    return text.groupBy("ticker").agg(F.min("dt").alias("first_day"), F.max("dt").alias("last_day"), n_rows())
