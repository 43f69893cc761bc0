"""Queries on scans, cleansing, joins, clusters, signals and event returns."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators import checks, clean, clusters, eventstudy, signals
from tidemark.operators import timeseries as ts
from tidemark.operators.ranking import kept
from tidemark.plans.registry import query
from tidemark.sources import files
from tidemark.sources.fixtures import Tables
from tidemark.streaming.jobs import work_path

AS_OF = "1998-01-01"
D = lambda text: F.lit(text).cast("date")
R = lambda c, n=6: F.round(c, n)


def buys(t: Tables) -> DataFrame:
    return t.dealings.where("type = 'BUY'")


def tier_firings(t: Tables) -> DataFrame:
    """Tier firings with the dealing's and the issuer's columns."""
    return signals.with_tier_signal(signals.context(t.dealings, t.prices)).join(t.meta, "ticker")


def event_returns(t: Tables) -> DataFrame:
    return eventstudy.returns(t.kept("firings", lambda: tier_firings(t)), t.kept("prices"))


# --- sources -----------------------------------------------------------------


@query("src01_dealings_scan", "SELECT fingerprint, ticker, announced, value FROM fx_dealings WHERE announced >= DATE '1996-01-01' AND announced <= DATE '1996-12-31'")
def src01(t):
    return t.dealings.where("announced >= DATE'1996-01-01' AND announced <= DATE'1996-12-31'").select("fingerprint", "ticker", "announced", "value")


@query("src02_price_scan", "SELECT ticker, dt, close, volume FROM fx_prices WHERE ticker LIKE '^%'")
def src02(t):
    return t.prices.where("ticker LIKE '^%'").select("ticker", "dt", "close", "volume")


@query("src03_meta_scan", "SELECT ticker, sector FROM fx_tickers_meta WHERE benchmark_symbol = '^AIM'")
def src03(t):
    return t.meta.where("benchmark_symbol = '^AIM'").select("ticker", "sector")


@query("src05_curated_overlay", """
SELECT m.ticker, CASE WHEN is_excluded_issuer THEN 'Curated, by hand' ELSE sector END AS sector, market_cap_gbp, is_excluded_issuer AS curated FROM fx_tickers_meta m""")
def src05(t):
    """A hand-kept CSV is read by its schema; its values win, and where it has none the fetched ones stay."""
    path = work_path(t.spark, "curated")
    t.meta.where("is_excluded_issuer").select("ticker", F.lit("Curated, by hand").alias("sector"), F.lit(None).cast("double").alias("market_cap_gbp")).write.option("header", "true").csv(path)
    curated = files.curated_csv(t.spark, path, "ticker string, sector string, market_cap_gbp double")
    return files.overlay(t.meta, curated, "ticker", ["sector", "market_cap_gbp"]).select("ticker", "sector", "market_cap_gbp", "curated")


@query("src07_short_disclosures", """
SELECT holder, ticker, position_date, net_short_pct, 'current' AS sheet FROM fx_short_positions WHERE position_date >= DATE '1997-01-01'
UNION ALL SELECT holder, ticker, position_date, net_short_pct, 'historic' FROM fx_short_positions WHERE position_date < DATE '1997-01-01'""")
def src07(t):
    now = t.shorts.where("position_date >= DATE'1997-01-01'").withColumn("sheet", F.lit("current"))
    return now.unionByName(t.shorts.where("position_date < DATE'1997-01-01'").withColumn("sheet", F.lit("historic")))


@query("src07_sheets_by_name", "SELECT 'H' || holder AS holder, ticker AS issuer, position_date, net_short_pct, CASE WHEN position_date >= DATE '1997-01-01' THEN 'current' ELSE 'historic' END AS sheet FROM fx_short_positions")
def src07_sheets(t):
    """Sheets with dated names are written as CSV and read back by how their names begin; a sheet of notes is not read."""
    path = work_path(t.spark, "sheets")
    rows = t.shorts.select(F.concat(F.lit("H"), "holder").alias("Position Holder"), F.col("ticker").alias("Name of Share Issuer"), F.lit("GB00").alias("ISIN"), F.col("net_short_pct").alias("Net Short Position (%)"), F.col("position_date").alias("Position Date"))
    now = F.col("Position Date") >= D("1997-01-01")
    for name, inside in (("Current Disclosures 01.01.1998", now), ("Historic Disclosures 01.01.1998", ~now), ("Notes 01.01.1998", now)):
        rows.where(inside).write.option("header", "true").csv(f"{path}/{name}")
    return files.disclosure_sheets(t.spark, path).select("holder", "issuer", "position_date", "net_short_pct", "sheet")


@query("src08_results_diary", """
SELECT DISTINCT ticker, report_date, CASE report_type WHEN 'PRELIM' THEN 'PRELIM' WHEN 'INTERIM' THEN 'INTERIM' ELSE CASE day(report_date) % 3 WHEN 0 THEN 'QUARTERLY' ELSE 'TRADING_STMT' END END AS report_type FROM fx_reporting_dates r
WHERE NOT (report_type = 'TRADING_STMT' AND day(report_date) % 3 = 1) AND ticker IN (SELECT ticker FROM fx_dealings WHERE type='BUY')""")
def src08(t):
    third = F.dayofmonth("report_date") % 3
    other = F.when(third == 0, F.concat(F.lit("Q"), (F.month("report_date") % 4 + 1).cast("string"), F.lit(" Results"))).when(third == 1, "AGM").otherwise("Trading Announcements")
    label = F.when(F.col("report_type") == "PRELIM", "Final Results").when(F.col("report_type") == "INTERIM", "Interim Results").otherwise(other)
    return files.results_diary(t.results.select("ticker", "report_date", label.alias("label")), buys(t))


@query("src11_aim_overlay", """
SELECT ticker, is_aim, CASE WHEN is_aim THEN '^AIM' ELSE '^ALL' END AS benchmark FROM
(SELECT ticker, ticker IN (SELECT 'Brand#'||x FROM range(1,100) r(x) WHERE x%3=0) AS is_aim FROM fx_tickers_meta)""")
def src11(t):
    listed = t.spark.range(1, 100).where("id % 3 = 0").select(F.concat(F.lit("Brand#"), F.col("id")).alias("ticker"), F.lit(True).alias("hit"))
    out = t.meta.select("ticker").join(listed, "ticker", "left").withColumn("is_aim", F.coalesce("hit", F.lit(False)))
    return out.select("ticker", "is_aim", F.when(F.col("is_aim"), "^AIM").otherwise("^ALL").alias("benchmark"))


# --- projections and filters ---------------------------------------------------


@query("prj01_effective_date", "SELECT fingerprint, coalesce(announced, dt) AS effective FROM fx_dealings")
def prj01(t):
    return t.dealings.select("fingerprint", clean.effective_date().alias("effective"))


@query("prj02_iso_day", """
SELECT fingerprint, CAST(dt AS DATE) AS day FROM fx_dealings""")
def prj02(t):
    shapes = [F.date_format("dt", "yyyy-MM-dd"), F.date_format("dt", "d MMM yyyy"), F.date_format("dt", "dd/MM/yyyy"), F.date_format("dt", "d MMMM yyyy")]
    mixed = F.element_at(F.array(*shapes), (F.col("fingerprint") % 4 + 1).cast("int"))
    return t.dealings.select("fingerprint", clean.iso_day(mixed).alias("day"))


@query("prj03_director_key", "SELECT c_custkey, lower(trim(regexp_replace(c_name, '\\s+', ' ', 'g'))) || CASE c_custkey % 4 WHEN 0 THEN '' WHEN 1 THEN ' fi' WHEN 2 THEN ' strasse 12' ELSE ' ltd' END AS director_key FROM customer")
def prj03(t):
    """Every fourth name is ASCII; the others have a ligature, a sharp s with a wide space and wide digits, full-width letters."""
    tail = F.element_at(F.array(F.lit(""), F.lit(" ﬁ"), F.lit("\u3000Straße\u00a0１２"), F.lit(" ＬＴＤ")), (F.col("c_custkey") % 4 + 1).cast("int"))
    odd = t.read("customer").select("c_custkey", F.concat(F.lit("  "), F.regexp_replace("c_name", " ", "  "), tail, F.lit(" ")).alias("name"))
    return clean.with_director_key(odd, "name").select("c_custkey", "director_key")


@query("prj06_role_bucket", """
SELECT role, CASE role WHEN 'Chief Executive Officer' THEN 'CEO' WHEN 'Chief Financial Officer' THEN 'CFO' WHEN 'Executive Chairman' THEN 'Chair'
 WHEN 'Chief Operating Officer' THEN 'OtherChief' WHEN 'Non-Executive Director' THEN 'NED' WHEN 'Company Secretary' THEN 'CoSec' ELSE 'PCA' END AS bucket, count(*) AS n
FROM fx_dealings GROUP BY 1, 2""")
def prj06(t):
    return t.dealings.groupBy("role", clean.role_bucket(F.col("role")).alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


@query("prj07_role_tier", "SELECT b.tier, t.least, t.confidence, count(*) AS n FROM buys b JOIN tiers t ON b.tier = t.tier GROUP BY 1, 2, 3")
def prj07(t):
    tier = clean.role_tier(F.col("role"))
    out = buys(t).groupBy(tier.alias("tier")).agg(F.count(F.lit(1)).alias("n"))
    return out.select("tier", clean.lookup(F.col("tier"), {k: v[0] for k, v in clean.TIERS.items()}).alias("least"), clean.lookup(F.col("tier"), {k: v[1] for k, v in clean.TIERS.items()}).alias("confidence"), "n")


@query("prj08_legacy_role_class", r"""
SELECT role, CASE WHEN regexp_matches(role, '(?i)chief executive|chief financial') THEN 'CEO_CFO' WHEN regexp_matches(role, '(?i)non-exec') THEN 'NED'
 WHEN regexp_matches(role, '(?i)chairman|chief \w+ officer') THEN 'EXEC' ELSE 'OTHER' END AS role_class, count(*) AS n FROM fx_dealings GROUP BY 1, 2""")
def prj08(t):
    return t.dealings.groupBy("role", clean.legacy_role_class(F.col("role")).alias("role_class")).agg(F.count(F.lit(1)).alias("n"))


@query("prj09_role_group", """
SELECT role, CASE WHEN role LIKE 'Chief Exec%' OR role LIKE 'Chief Fin%' THEN 'ceo_cfo' WHEN role LIKE 'Non-Exec%' THEN 'ned'
 WHEN role LIKE 'Executive Chair%' OR role LIKE '%Operating Officer' THEN 'other_exec' END AS role_group, count(*) AS n FROM fx_dealings GROUP BY 1, 2""")
def prj09(t):
    return t.dealings.groupBy("role", clean.role_group(F.col("role")).alias("role_group")).agg(F.count(F.lit(1)).alias("n"))


_CLASS = {0: "T1", 1: " t3 ", 2: "T2"}


@query("prj09_role_class", """
SELECT fingerprint, CASE WHEN k = 0 OR role LIKE 'Chief Exec%' OR role LIKE 'Chief Fin%' THEN 'ceo_cfo' WHEN k = 1 OR role LIKE 'Non-Exec%' THEN 'ned' WHEN k = 2 OR role LIKE 'Executive Chair%' OR role LIKE '%Operating Officer' THEN 'other_exec' END AS role_group
FROM (SELECT *, director % 7 AS k FROM fx_dealings)""")
def prj09_class(t):
    """A class beside the title settles a group before the title's pattern does."""
    known = F.element_at(F.create_map(*[F.lit(x) for kv in _CLASS.items() for x in kv]), (F.col("director") % 7).cast("int"))
    return t.dealings.select("fingerprint", clean.role_group(F.col("role"), known).alias("role_group"))


@query("prj10_corporate_holder", "SELECT fingerprint, role LIKE 'Person Closely%' OR director % 50 = 0 AS excluded FROM fx_dealings")
def prj10(t):
    name = F.when(F.col("director") % 50 == 0, F.concat(F.lit("Holder "), "director", F.lit(" Nominees Limited"))).otherwise(F.concat(F.lit("Director "), "director"))
    return t.dealings.select("fingerprint", clean.corporate_holder(name, F.col("role")).alias("excluded"))


@query("prj11_sector_normalise", "SELECT ticker, CASE sector WHEN 'Sector_0' THEN 'Materials' WHEN 'Sector_1' THEN 'Health Care' WHEN 'Sector_2' THEN 'Financials' ELSE sector END AS sector FROM fx_tickers_meta")
def prj11(t):
    raw = {"Sector_0": "Basic Materials", "Sector_1": "Healthcare", "Sector_2": "Financial Services"}
    return t.meta.select("ticker", clean.sector(F.coalesce(clean.lookup(F.col("sector"), raw), "sector")).alias("sector"))


@query("prj12_company_label", """
WITH n AS (SELECT ticker, dt, fingerprint, CASE fingerprint % 5 WHEN 0 THEN NULL WHEN 1 THEN '' ELSE 'Company ' || (director % 3) END AS company FROM fx_dealings), k AS (SELECT * FROM n WHERE trim(company) <> ''),
c AS (SELECT ticker, company, count(*) AS n FROM k GROUP BY 1, 2), m AS (SELECT ticker, arg_min(company, (-n, company)) AS most_frequent FROM c GROUP BY 1)
SELECT k.ticker, arg_max(k.company, (k.dt, k.fingerprint)) AS latest, any_value(m.most_frequent) AS most_frequent FROM k JOIN m ON k.ticker = m.ticker GROUP BY 1""")
def prj12(t):
    k = F.col("fingerprint") % 5
    named = t.dealings.withColumn("company", F.when(k == 1, "").when(k > 1, F.concat(F.lit("Company "), (F.col("director") % 3).cast("string"))))
    return clean.company_label(named)


@query("prj13_search_index", """
SELECT ticker, rank FROM (SELECT ticker, CASE WHEN starts_with(lower(ticker), 'brand#1') THEN 0 ELSE 1 END AS rank FROM fx_tickers_meta WHERE contains(lower(ticker), '#1') OR contains(lower(sector), '_1'))
ORDER BY rank, ticker LIMIT 8""")
def prj13(t):
    low = F.lower("ticker")
    hits = t.meta.where(low.contains("#1") | F.lower("sector").contains("_1"))
    return hits.select("ticker", F.when(low.startswith("brand#1"), 0).otherwise(1).alias("rank")).orderBy("rank", "ticker").limit(8)


@query("prj14_page_name", "SELECT ticker, regexp_replace(upper(ticker), '[^A-Z0-9.]', '_', 'g') AS page FROM fx_tickers_meta")
def prj14(t):
    return t.meta.select("ticker", clean.page_name(F.col("ticker")).alias("page"))


@query("prj15_fx_to_gbp", """
SELECT p.director, p.fy_end, round(p.pay_gbp * r.rate, 4) AS pay_home, r.rate FROM fx_director_pay p
JOIN (SELECT MAKE_DATE(y,12,31) AS fy_end, round(0.5 + (y-1994)*0.01, 4) AS rate FROM (VALUES (1994),(1995),(1996),(1997),(1998),(1999),(2000)) v(y)) r ON p.fy_end = r.fy_end""")
def prj15(t):
    rates = t.spark.range(1994, 2001).select(F.make_date("id", F.lit(12), F.lit(31)).alias("fy_end"), R(0.5 + (F.col("id") - 1994) * 0.01, 4).alias("rate"))
    return t.pay.join(F.broadcast(rates), "fy_end").select("director", "fy_end", R(F.col("pay_gbp") * F.col("rate"), 4).alias("pay_home"), "rate")


@query("prj16_pay_status", """
SELECT CASE WHEN pay_status <> 'ok' THEN CASE year(fy_end) % 3 WHEN 0 THEN 'out_of_scope' WHEN 1 THEN 'extraction_fail' ELSE 'new_appointee' END WHEN director % 11 = 0 THEN 'fee_waiver' WHEN director % 11 = 1 THEN 'nominal' ELSE 'ok' END AS bucket, count(*) AS n FROM fx_director_pay GROUP BY 1""")
def prj16(t):
    third, eleventh = F.year("fy_end") % 3, F.col("director") % 11
    status = F.when(F.col("pay_status") != "ok", F.when(third == 0, "out_of_scope").when(third == 1, "extraction_fail").otherwise(F.col("pay_status"))).otherwise(F.col("pay_status"))
    pay = F.when(eleventh == 0, 0.0).when(eleventh == 1, 1.0).otherwise(F.col("pay_gbp"))
    return t.pay.groupBy(clean.pay_bucket(status, pay).alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


@query("fil01_universe", f"""
SELECT d.fingerprint, d.ticker, m.benchmark_symbol FROM fx_dealings d JOIN fx_tickers_meta m ON d.ticker = m.ticker
WHERE d.announced IS NOT NULL AND d.announced <= DATE '{AS_OF}' AND m.benchmark_symbol IS NOT NULL""")
def fil01(t):
    return clean.universe(t.dealings, t.meta, AS_OF).select("fingerprint", "ticker", "benchmark_symbol")


@query("fil02_excluded_issuers", "SELECT fingerprint, ticker FROM fx_dealings WHERE ticker NOT IN (SELECT ticker FROM fx_tickers_meta WHERE is_excluded_issuer)")
def fil02(t):
    return t.dealings.join(t.meta.where("is_excluded_issuer").select("ticker"), "ticker", "left_anti").select("fingerprint", "ticker")


@query("fil03_strict_gate", "SELECT fingerprint FROM fx_dealings WHERE type='BUY' AND buy_strictness='STRICT_BUY'")
def fil03(t):
    return buys(t).where("buy_strictness = 'STRICT_BUY'").select("fingerprint")


@query("fil04_price_audit_gate", "SELECT fingerprint, CASE WHEN fingerprint % 20 = 0 THEN NULL ELSE value END AS value FROM fx_dealings")
def fil04(t):
    flagged = t.dealings.withColumn("price_audit", F.when(F.col("fingerprint") % 20 == 0, "unresolved"))
    return flagged.select("fingerprint", F.when(F.col("price_audit").isNull(), F.col("value")).alias("value"))


@query("fil05_lookbacks", f"""
SELECT lookback, count(*) AS n, round(sum(value), 2) AS total FROM buys JOIN (VALUES ('90d',90),('183d',183),('365d',365),('all',1000000)) v(lookback,days)
ON datediff('day', announced, DATE '{AS_OF}') BETWEEN 0 AND days GROUP BY lookback""")
def fil05(t):
    return clean.lookback_rows(buys(t), "announced", AS_OF).groupBy("lookback").agg(F.count(F.lit(1)).alias("n"), R(F.sum("value"), 2).alias("total"))


@query("fil06_value_buckets", """
SELECT CASE WHEN value >= 500000 THEN '500k+' WHEN value >= 100000 THEN '100k-500k' WHEN value >= 25000 THEN '25k-100k' WHEN value >= 1000 THEN '1k-25k' END AS bucket,
 count(*) AS n FROM buys GROUP BY 1""")
def fil06(t):
    return buys(t).groupBy(clean.value_bucket(F.col("value")).alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


@query("fil07_size_band", """
SELECT band, count(*) AS n FROM buys JOIN fx_tickers_meta USING (ticker) JOIN (VALUES ('all'),('small'),('large')) v(band)
ON band = 'all' OR (band = 'small') = (market_cap_gbp < 500e6) GROUP BY band""")
def fil07(t):
    rows = buys(t).join(t.meta, "ticker")
    band = F.explode(F.array(F.lit("all"), F.when(F.col("market_cap_gbp") < 500e6, "small").otherwise("large")))
    return rows.select(band.alias("band")).groupBy("band").agg(F.count(F.lit(1)).alias("n"))


@query("fil08_min_history", """
SELECT f.fingerprint, p.idx - 1 AS history FROM firing f ASOF JOIN px p ON f.ticker = p.ticker AND f.announced < p.dt WHERE p.idx > 30""")
def fil08(t):
    return eventstudy.entries(tier_firings(t), ts.trade_index(t.prices)).where("entry_idx > 30").select("fingerprint", (F.col("entry_idx") - 1).alias("history"))


@query("fil10_outlier_flag", "SELECT signal, max(abs(car)) > 2.0 AS outlier FROM es GROUP BY signal")
def fil10(t):
    """Whether any abnormal return of a signal exceeds 200 %."""
    return event_returns(t).groupBy("signal").agg((F.max(F.abs("car")) > 2.0).alias("outlier"))


@query("fil11_type_scope", "SELECT type, count(*) AS n FROM fx_dealings WHERE type NOT IN ('SELL_TAX','GRANT','SIP','EXERCISE') GROUP BY type")
def fil11(t):
    return t.dealings.where("type NOT IN ('SELL_TAX','GRANT','SIP','EXERCISE')").groupBy("type").agg(F.count(F.lit(1)).alias("n"))


@query("fil12_field_validation", """
WITH e AS (SELECT fingerprint, CASE fingerprint % 5 WHEN 0 THEN 'reject' WHEN 1 THEN 'add' ELSE 'update' END AS action, CASE WHEN fingerprint % 7 = 0 THEN 'DIVIDEND' ELSE type END AS type,
 CASE fingerprint % 11 WHEN 0 THEN '-5' WHEN 1 THEN '7.5' WHEN 2 THEN 'many' WHEN 3 THEN NULL ELSE CAST(shares AS VARCHAR) END AS shares, CASE WHEN fingerprint % 13 = 0 THEN '-1' ELSE '10' END AS price,
 CASE fingerprint % 17 WHEN 0 THEN '02 Jun 1996' WHEN 1 THEN NULL ELSE CAST(dt AS VARCHAR) END AS date, CASE WHEN fingerprint % 19 = 0 THEN ' ' ELSE ticker END AS ticker, CASE WHEN fingerprint % 23 = 0 THEN 'Sector_X' ELSE 'Sector_1' END AS sector FROM fx_dealings)
SELECT fingerprint, CASE WHEN action = 'reject' THEN [] ELSE list_filter([
 CASE WHEN action = 'add' AND (date IS NULL OR trim(date) = '') THEN 'date_required' END, CASE WHEN action = 'add' AND (ticker IS NULL OR trim(ticker) = '') THEN 'ticker_required' END,
 CASE WHEN action = 'add' AND (shares IS NULL OR trim(shares) = '') THEN 'shares_required' END, CASE WHEN type = 'DIVIDEND' THEN 'type_unknown' END,
 CASE WHEN shares IS NOT NULL AND TRY_CAST(shares AS DOUBLE) IS NULL THEN 'shares_not_numeric' END, CASE WHEN TRY_CAST(shares AS DOUBLE) < 0 THEN 'shares_negative' END, CASE WHEN price = '-1' THEN 'price_negative' END,
 CASE WHEN TRY_CAST(shares AS DOUBLE) <> floor(TRY_CAST(shares AS DOUBLE)) THEN 'shares_not_whole' END, CASE WHEN date = '02 Jun 1996' THEN 'date_not_iso' END, CASE WHEN ticker = ' ' THEN 'ticker_empty' END, CASE WHEN sector = 'Sector_X' THEN 'sector_unknown' END], lambda x: x IS NOT NULL) END AS errors FROM e""")
def fil12(t):
    k = lambda n: F.col("fingerprint") % n
    edits = t.dealings.select(
        "fingerprint", F.when(k(5) == 0, "reject").when(k(5) == 1, "add").otherwise("update").alias("action"), F.when(k(7) == 0, "DIVIDEND").otherwise(F.col("type")).alias("type"),
        F.when(k(11) == 0, "-5").when(k(11) == 1, "7.5").when(k(11) == 2, "many").when(k(11) > 3, F.col("shares").cast("string")).alias("shares"), F.when(k(13) == 0, "-1").otherwise("10").alias("price"),
        F.when(k(17) == 0, "02 Jun 1996").when(k(17) > 1, F.col("dt").cast("string")).alias("date"), F.when(k(19) == 0, " ").otherwise(F.col("ticker")).alias("ticker"),
        F.when(k(23) == 0, "Sector_X").otherwise("Sector_1").alias("sector"), F.col("director").cast("string").alias("director"),
    )
    return edits.select("fingerprint", checks.field_errors(edits, [f"Sector_{n}" for n in range(5)]).alias("errors"))


@query("fil13_coercion", "SELECT fingerprint, CAST(shares AS BIGINT) AS shares, upper(trim(ticker)) AS ticker FROM fx_dealings")
def fil13(t):
    raw = t.dealings.select("fingerprint", F.col("shares").cast("string").alias("shares"), F.concat(F.lit(" "), F.lower("ticker"), F.lit(" ")).alias("ticker"))
    return raw.select("fingerprint", F.col("shares").cast("long").alias("shares"), F.upper(F.trim("ticker")).alias("ticker"))


# --- joins -----------------------------------------------------------------


@query("jn01_sector_lookup", "SELECT d.fingerprint, m.sector FROM fx_dealings d LEFT JOIN fx_tickers_meta m USING (ticker)")
def jn01(t):
    return t.dealings.join(t.meta.select("ticker", "sector"), "ticker", "left").select("fingerprint", "sector")


@query("jn02_firings_join", "SELECT fingerprint, signal, sector, value FROM firing")
def jn02(t):
    return tier_firings(t).select("fingerprint", "signal", "sector", "value")


@query("jn03_first_after", "SELECT b.fingerprint, p.dt AS entry_dt, p.close AS entry_close FROM buys b ASOF LEFT JOIN px p ON b.ticker = p.ticker AND b.announced < p.dt")
def jn03(t):
    found = ts.first_after(buys(t), t.prices, "announced", take=["close"])
    return found.select("fingerprint", F.col("found.dt").alias("entry_dt"), F.col("found.close").alias("entry_close"))


@query("jn04_last_until", "SELECT b.fingerprint, p.dt AS on_dt, p.close AS on_close FROM buys b ASOF LEFT JOIN px p ON b.ticker = p.ticker AND b.announced >= p.dt")
def jn04(t):
    found = ts.last_until(buys(t), t.prices, "announced", take=["close"])
    return found.select("fingerprint", F.col("found.dt").alias("on_dt"), F.col("found.close").alias("on_close"))


@query("jn05_offsets", "SELECT fingerprint, horizon, later_dt FROM es")
def jn05(t):
    indexed = ts.trade_index(t.prices)
    entered = eventstudy.entries(tier_firings(t), indexed).where("entry_idx > 30")
    return ts.at_offsets(entered, indexed, eventstudy.HORIZONS).select("fingerprint", "horizon", "later_dt")


_OTHERS = """
SELECT a.fingerprint, b.fingerprint AS other_fp FROM buys a JOIN buys b ON a.ticker = b.ticker AND a.director <> b.director
AND abs(datediff('day', a.dt, b.dt)) <= 30 AND b.announced <= a.announced WHERE a.buy_strictness = 'STRICT_BUY'"""


@query("jn06_other_buyers", _OTHERS)
def jn06(t):
    ctx = signals.context(t.dealings, t.prices)
    return signals.other_buyers(ctx.buys, ctx.strict).select("fingerprint", "other_fp")


@query("jn07_no_earlier_buy", """
SELECT fingerprint FROM buys b WHERE NOT EXISTS (SELECT 1 FROM buys p WHERE p.director = b.director AND p.ticker = b.ticker AND p.announced < b.announced)""")
def jn07(t):
    own = Window.partitionBy("director", "ticker")
    return buys(t).withColumn("first", F.min("announced").over(own)).where("announced = first").select("fingerprint")


@query("jn08_buys_without_firing", "SELECT fingerprint, value FROM buys WHERE fingerprint NOT IN (SELECT fingerprint FROM firing)")
def jn08(t):
    return buys(t).join(tier_firings(t).select("fingerprint"), "fingerprint", "left_anti").select("fingerprint", "value")


@query("jn11_short_interest", """
SELECT fingerprint, round(sum(net_short_pct), 4) AS short_pct FROM (
 SELECT f.fingerprint, s.net_short_pct, row_number() OVER (PARTITION BY f.fingerprint, s.holder ORDER BY s.position_date DESC) AS rn
 FROM firing f JOIN fx_short_positions s ON s.ticker = f.ticker AND s.position_date < f.announced) WHERE rn = 1 GROUP BY fingerprint""")
def jn11(t):
    from tidemark.operators.features import short_interest

    return short_interest(tier_firings(t), t.shorts).where("short_pct IS NOT NULL").select("fingerprint", R("short_pct", 4).alias("short_pct"))


@query("jn12_latest_pay", """
SELECT f.fingerprint, p.fy_end, p.pay_gbp FROM firing f ASOF LEFT JOIN fx_director_pay p ON f.ticker = p.ticker AND f.director = p.director AND f.announced >= p.ar_published_at""")
def jn12(t):
    from tidemark.operators.features import latest_pay

    return latest_pay(tier_firings(t), t.pay).select("fingerprint", F.col("found.fy_end").alias("fy_end"), F.col("found.pay_gbp").alias("pay_gbp"))


@query("jn13_last_results", """
SELECT f.fingerprint, r.report_date FROM firing f ASOF LEFT JOIN (SELECT DISTINCT ticker, report_date FROM fx_reporting_dates WHERE confidence = 'confirmed') r
ON f.ticker = r.ticker AND f.announced >= r.report_date""")
def jn13(t):
    confirmed = t.results.where("confidence = 'confirmed'").select("ticker", "report_date").distinct()
    found = ts.last_until(tier_firings(t), confirmed, "announced", when="report_date")
    return found.select("fingerprint", F.col("found.report_date").alias("report_date"))


@query("jn14_next_results", """
SELECT f.fingerprint, r.report_date AS next_date, datediff('day', f.dt, r.report_date) AS days FROM firing f
ASOF JOIN (SELECT DISTINCT ticker, report_date FROM fx_reporting_dates) r ON f.ticker = r.ticker AND f.dt <= r.report_date WHERE datediff('day', f.dt, r.report_date) <= 60""")
def jn14(t):
    found = ts.first_from(tier_firings(t), t.results.select("ticker", "report_date").distinct(), "dt", when="report_date")
    days = F.datediff("found.report_date", "dt")
    return found.where(days <= 60).select("fingerprint", F.col("found.report_date").alias("next_date"), days.alias("days"))


@query("jn15_benchmark_default", "SELECT d.fingerprint, coalesce(CASE WHEN m.is_aim THEN m.benchmark_symbol END, '^FTAS') AS benchmark FROM fx_dealings d LEFT JOIN fx_tickers_meta m USING (ticker)")
def jn15(t):
    known = t.meta.where("is_aim").select("ticker", "benchmark_symbol")
    return t.dealings.join(known, "ticker", "left").select("fingerprint", F.coalesce("benchmark_symbol", F.lit(eventstudy.FALLBACK)).alias("benchmark"))


@query("jn16_parity", """
SELECT coalesce(a.fingerprint, b.fingerprint) AS fingerprint, CASE WHEN b.fingerprint IS NULL THEN 'left_only' WHEN a.fingerprint IS NULL THEN 'right_only'
 WHEN a.value IS DISTINCT FROM b.value THEN 'differs' ELSE 'same' END AS parity
FROM (SELECT * FROM fx_dealings WHERE fingerprint % 10 <> 0) a FULL JOIN (SELECT fingerprint, CASE WHEN fingerprint % 7 = 0 THEN value + 1 ELSE value END AS value FROM fx_dealings WHERE fingerprint % 11 <> 0) b
ON a.fingerprint = b.fingerprint""")
def jn16(t):
    from tidemark.operators.checks import parity

    right = t.dealings.where("fingerprint % 11 <> 0").withColumn("value", F.when(F.col("fingerprint") % 7 == 0, F.col("value") + 1).otherwise(F.col("value")))
    return parity(t.dealings.where("fingerprint % 10 <> 0"), right, "fingerprint", ["value"]).select("fingerprint", "parity")


@query("jn17_issuer_mapping", """
SELECT issuer, CASE method WHEN 'name' THEN ticker WHEN 'map' THEN 'M' || n WHEN 'override' THEN 'O' || n END AS ticker, method FROM (SELECT ticker AS issuer, ticker, n, CASE WHEN n % 2 = 0 THEN 'name' WHEN n % 3 = 0 THEN 'map' WHEN n % 5 = 0 THEN 'override' END AS method
 FROM (SELECT ticker, CAST(substring(ticker, 7) AS INT) AS n FROM fx_tickers_meta))""")
def jn17(t):
    """Half the issuers are known by name whatever its case and spaces, others by a map or an override with tickers of their own, the rest not at all."""
    n = F.substring("ticker", 7, 9).cast("int")
    issuers = t.meta.select(F.col("ticker").alias("issuer"), F.concat(F.lit(" "), F.upper("ticker"), F.lit("  PLC")).alias("name"))
    names = t.meta.where(n % 2 == 0).select(F.concat("ticker", F.lit(" plc")).alias("name"), "ticker")
    mapped = t.meta.where(n % 3 == 0).select(F.col("ticker").alias("issuer"), F.concat(F.lit("M"), n).alias("ticker"))
    override = t.meta.where((n % 3 == 0) | (n % 5 == 0)).select(F.col("ticker").alias("issuer"), F.concat(F.lit("O"), n).alias("ticker"))
    return clean.issuer_tickers(issuers, names, mapped, override)


@query("jn20_edit_overlay", """
SELECT fingerprint, CASE WHEN fingerprint % 5 = 1 THEN value * 2 ELSE value END AS value FROM fx_dealings WHERE fingerprint % 5 <> 2
UNION ALL SELECT -fingerprint, value FROM fx_dealings WHERE fingerprint % 50 = 3""")
def jn20(t):
    from tidemark.operators.writes import apply_edits

    fp = F.col("fingerprint")
    update = t.dealings.where(fp % 5 == 1).select("fingerprint", F.lit("update").alias("action"), (F.col("value") * 2).alias("value"))
    reject = t.dealings.where(fp % 5 == 2).select("fingerprint", F.lit("reject").alias("action"), F.lit(None).cast("double").alias("value"))
    add = t.dealings.where(fp % 50 == 3).select((-fp).alias("fingerprint"), F.lit("add").alias("action"), "value")
    return apply_edits(t.dealings.select("fingerprint", "value"), update.union(reject).union(add), "fingerprint")


def _keyed_edits(t):
    """Dealings keyed by number and shares, and edits: values twice (the later one counts), shares (a new key), a rejection and an addition after it."""
    fp, key = F.col("fingerprint"), F.concat_ws("-", "fingerprint", "shares")
    rows = t.dealings.select(key.alias("k"), "fingerprint", "ticker", "shares", "value")
    no = lambda kind: F.lit(None).cast(kind)

    def edit(inside, action, at, shares=no("long"), value=no("double"), given=("value",), ticker=no("string")):
        return rows.where(inside).select("k", F.lit(action).alias("action"), fp, ticker.alias("ticker"), shares.alias("shares"), value.alias("value"), F.array(*[F.lit(g) for g in given]).alias("given"), F.lit(at).alias("at"))

    edits = edit(fp % 5 == 1, "update", 1, value=F.col("value") * 2).unionByName(edit(fp % 10 == 1, "update", 2, value=F.col("value") * 3))
    edits = edits.unionByName(edit(fp % 7 == 3, "update", 3, shares=F.col("shares") + 1, given=("shares",))).unionByName(edit(fp % 11 == 5, "update", 4))
    edits = edits.unionByName(edit(fp % 13 == 6, "reject", 5, given=("action",)))
    again = edit(fp % 26 == 6, "add", 6, shares=F.col("shares"), value=F.lit(1.0), given=("fingerprint", "ticker", "shares", "value"), ticker=F.col("ticker"))
    return rows, edits.unionByName(again)


_EDITED = """ed AS (SELECT CAST(fingerprint AS VARCHAR) || '-' || CAST(s AS VARCHAR) AS k, fingerprint, ticker, s AS shares, v AS value FROM (
 SELECT *, CASE WHEN fingerprint % 26 = 6 THEN shares WHEN fingerprint % 7 = 3 THEN shares + 1 ELSE shares END AS s,
 CASE WHEN fingerprint % 26 = 6 THEN 1.0 WHEN fingerprint % 11 = 5 THEN NULL WHEN fingerprint % 10 = 1 THEN value * 3 WHEN fingerprint % 5 = 1 THEN value * 2 ELSE value END AS v
 FROM fx_dealings WHERE fingerprint % 13 <> 6 OR fingerprint % 26 = 6))"""


def _edited(t):
    from tidemark.operators.writes import apply_edits

    rows, edits = _keyed_edits(t)
    return rows, kept(apply_edits(rows, edits, "k", "at", rekey=lambda fingerprint, ticker, shares, value: F.concat_ws("-", fingerprint, shares)), "edited")


@query("jn20_key_changes", f"WITH {_EDITED} SELECT k, fingerprint, ticker, shares, value FROM ed")
def jn20_keys(t):
    return _edited(t)[1]


@query("jn20_refreshed_firings", f"WITH {_EDITED} SELECT k, ticker, value >= 200000 AS large FROM ed WHERE value >= 100000")
def jn20_firings(t):
    """What large rows fire is derived anew for the tickers that edits touch, and kept for the others."""
    from tidemark.operators.writes import refresh_dependents

    fire = lambda rows: rows.where("value >= 100000").select("k", "ticker", (F.col("value") >= 200_000).alias("large"))
    rows, edited = _edited(t)
    return refresh_dependents(rows, edited, fire(rows), "k", "ticker", fire)


@query("jn21_price_markers", """
SELECT p.ticker, p.dt, p.close, count(d.fingerprint) AS n_dealings, coalesce(list_sort(list(d.type) FILTER (d.type IS NOT NULL)), []) AS types FROM fx_prices p LEFT JOIN fx_dealings d
ON p.ticker = d.ticker AND p.dt = d.dt GROUP BY 1, 2, 3""")
def jn21(t):
    marks = t.dealings.select("ticker", "dt", "fingerprint", "type")
    out = t.prices.join(marks, ["ticker", "dt"], "left").groupBy("ticker", "dt", "close")
    return out.agg(F.count("fingerprint").alias("n_dealings"), F.sort_array(F.collect_list("type")).alias("types"))


@query("jn21_markers", """
SELECT p.ticker, p.dt, p.close, coalesce(d.markers, []) AS markers FROM fx_prices p LEFT JOIN (SELECT ticker, dt, list(fingerprint || ' ' || type || ' ' || shares || ' ' || CAST(round(value * 100) AS BIGINT) || ' ' || director ORDER BY fingerprint) AS markers
 FROM fx_dealings GROUP BY 1, 2) d ON p.ticker = d.ticker AND p.dt = d.dt""")
def jn21_markers(t):
    """Each day's dealings beside its price: number, type, shares, value in pence and director."""
    out = ts.with_markers(t.prices, t.dealings, ["fingerprint", "dt", "type", "shares", "value", "director"])
    text = F.transform("markers", lambda m: F.concat_ws(" ", m["fingerprint"], m["type"], m["shares"], F.round(m["value"] * 100).cast("long"), m["director"]))
    return out.select("ticker", "dt", "close", text.alias("markers"))


# --- clusters and signals -------------------------------------------------------

_CLUSTERS = """
WITH b AS (SELECT *, datediff('day', DATE '1970-01-01', dt) AS day FROM buys),
o AS (SELECT *, lead(director) OVER w AS nd, lead(day) OVER w AS nday,
  (SELECT max(x.day) FROM b x WHERE x.ticker = b.ticker AND x.director <> b.director AND (x.day, x.director, x.fingerprint) < (b.day, b.director, b.fingerprint)) AS ob,
  (SELECT min(x.day) FROM b x WHERE x.ticker = b.ticker AND x.director <> b.director AND (x.day, x.director, x.fingerprint) > (b.day, b.director, b.fingerprint)) AS oa
  FROM b WINDOW w AS (PARTITION BY ticker ORDER BY day, director, fingerprint)),
l AS (SELECT *, CASE WHEN nd <> director THEN nday - day <= 30 ELSE coalesce(nday - ob <= 30, false) OR coalesce(oa - day <= 30, false) END AS linked FROM o),
c AS (SELECT *, CASE WHEN coalesce(lag(linked) OVER w, false) THEN 0 ELSE 1 END AS cut FROM l WINDOW w AS (PARTITION BY ticker ORDER BY day, director, fingerprint)),
k AS (SELECT *, sum(cut) OVER (PARTITION BY ticker ORDER BY day, director, fingerprint ROWS UNBOUNDED PRECEDING) AS comp FROM c),
m AS (SELECT *, min(director) OVER g <> max(director) OVER g AS many, ticker || '-' || CAST(min(dt) OVER g AS VARCHAR) AS cluster_id FROM k WINDOW g AS (PARTITION BY ticker, comp)),
cl AS (SELECT * FROM m WHERE many)
"""


def clustered(t: Tables) -> DataFrame:
    return clusters.clusters(buys(t))


@query("cl01_clusters", _CLUSTERS + "SELECT fingerprint, cluster_id FROM cl")
def cl01(t):
    return clustered(t).select("fingerprint", "cluster_id")


_SUMMARY = _CLUSTERS + """, s AS (SELECT cluster_id, ticker, count(DISTINCT director) AS n_directors, count(*) AS n_buys, sum(value) AS total_value, min(dt) AS first_date, max(dt) AS last_date,
 datediff('day', min(dt), max(dt)) AS span_days FROM cl GROUP BY 1, 2) """


@query("cl02_cluster_summary", _SUMMARY + "SELECT cluster_id, ticker, n_directors, n_buys, round(total_value, 2) AS total_value, first_date, last_date, span_days FROM s")
def cl02(t):
    return clusters.summaries(clustered(t)).withColumn("total_value", R("total_value", 2))


@query("cl02_cluster_members", _CLUSTERS + "SELECT cluster_id, director, count(*) AS n_buys, round(sum(value), 2) AS total_value, min(dt) AS first_date, max(dt) AS last_date FROM cl GROUP BY 1, 2")
def cl02_members(t):
    return clusters.members(clustered(t)).withColumn("total_value", R("total_value", 2))


@query("cl02_cluster_lists", _CLUSTERS + "SELECT cluster_id, list_sort(list(DISTINCT director)) AS directors, list_sort(list(fingerprint)) AS fingerprints FROM cl GROUP BY 1")
def cl02_lists(t):
    return clusters.listed(clustered(t))


@query("cl03_cluster_state", _SUMMARY + f"SELECT cluster_id, CASE WHEN datediff('day', last_date, DATE '{AS_OF}') < 30 THEN 'active' WHEN datediff('day', last_date, DATE '{AS_OF}') <= 90 THEN 'brewing' ELSE 'past' END AS state FROM s WHERE last_date <= DATE '{AS_OF}'")
def cl03(t):
    return clusters.summaries(clustered(t)).where(F.col("last_date") <= D(AS_OF)).select("cluster_id", clusters.state(F.col("last_date"), AS_OF).alias("state"))


@query("cl04_cluster_conviction", _SUMMARY + "SELECT cluster_id, round(3*n_directors + 2*least(4.0::DOUBLE, greatest(0.0::DOUBLE, log10(total_value) - 3)) + 2*greatest(0.0::DOUBLE, (30 - span_days)/30.0::DOUBLE), 1) AS conviction FROM s")
def cl04(t):
    return clusters.summaries(clustered(t)).select("cluster_id", clusters.conviction(F.col("n_directors"), F.col("total_value"), F.col("span_days")).alias("conviction"))


for _tier, (_least, _conf, _rank, _signal) in clean.TIERS.items():
    if _tier != "T4":  # the derived dealings have no such role
        _number = {"T1a": 1, "T1b": 2, "T2": 3, "T3": 4, "T5": 6, "T6": 7, "T7": 8}[_tier]
        query(f"sig0{_number}_{_signal}", f"SELECT fingerprint, signal, confidence FROM firing WHERE tier = '{_tier}'")(
            lambda t, tier=_tier: signals.tier_signal(tier)(signals.context(t.dealings, t.prices)).select("fingerprint", "signal", "confidence")
        )

@query("sig05_t4_other_buy", "SELECT fingerprint, 't4_other_buy' AS signal, 'low' AS confidence FROM fx_dealings WHERE type = 'BUY' AND buy_strictness = 'STRICT_BUY' AND value >= 1000 AND role = 'Company Secretary'")
def sig05(t):
    """The derived dealings have no role of the last tier, so secretaries are read as heads of marketing here."""
    other = t.dealings.withColumn("role", F.when(F.col("role") == "Company Secretary", "Head of Marketing").otherwise(F.col("role")))
    return signals.tier_signal("T4")(signals.context(other, t.prices)).select("fingerprint", "signal", "confidence")


_S1 = f"s1 AS (SELECT DISTINCT fingerprint FROM ({_OTHERS}))"
_B2 = """
crowd AS (SELECT DISTINCT a.ticker, a.announced AS d FROM buys a WHERE (SELECT count(DISTINCT b.director) FROM buys b WHERE b.ticker = a.ticker AND b.announced BETWEEN a.announced - 30 AND a.announced) >= 4),
isl AS (SELECT *, CASE WHEN d <= max(d) OVER (PARTITION BY ticker ORDER BY d ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + 60 THEN 0 ELSE 1 END AS new FROM crowd),
isl2 AS (SELECT *, sum(new) OVER (PARTITION BY ticker ORDER BY d) AS i FROM isl),
win AS (SELECT ticker, min(d) AS start, max(d) + 60 AS stop FROM isl2 GROUP BY ticker, i)"""
_F1 = "f1 AS (SELECT fingerprint FROM buys b WHERE buy_strictness = 'STRICT_BUY' AND NOT EXISTS (SELECT 1 FROM buys p WHERE p.director = b.director AND p.ticker = b.ticker AND p.announced < b.announced))"
_B1 = f"""
tr AS (SELECT ticker, dt, close / lag(close, 60) OVER (PARTITION BY ticker ORDER BY dt) - 1 AS ret FROM fx_prices),
alone AS (SELECT * FROM buys WHERE buy_strictness = 'STRICT_BUY' AND value >= 200000 AND fingerprint NOT IN (SELECT fingerprint FROM ({_OTHERS}))),
b1 AS (SELECT a.fingerprint FROM alone a ASOF JOIN tr ON a.ticker = tr.ticker AND a.announced >= tr.dt WHERE tr.ret IS NOT NULL AND NOT tr.ret BETWEEN -0.10 AND -0.02)"""


@query("sig09_cluster_buy", f"WITH {_S1} SELECT fingerprint FROM s1")
def sig09(t):
    return signals.cluster_buy(signals.context(t.dealings, t.prices)).select("fingerprint")


@query("sig10_first_time_buy", f"WITH {_F1} SELECT fingerprint FROM f1")
def sig10(t):
    return signals.first_time_buy(signals.context(t.dealings, t.prices)).select("fingerprint")


@query("sig11_combo", f"WITH {_S1} SELECT fingerprint, 't0_cluster_combo' AS signal FROM firing WHERE tier IN ('T1a','T1b','T2') AND fingerprint IN (SELECT fingerprint FROM s1)")
def sig11(t):
    ctx = signals.context(t.dealings, t.prices)
    return signals.combo(signals.tier_signals(ctx).unionByName(signals.cluster_buy(ctx))).select("fingerprint", "signal")


@query("sig12_lone_conviction", f"WITH {_B1} SELECT fingerprint FROM b1")
def sig12(t):
    return signals.lone_conviction(signals.context(t.dealings, t.prices)).select("fingerprint")


@query("sig13_crowd_windows", f"WITH {_B2} SELECT ticker, start, stop FROM win")
def sig13(t):
    return signals.crowd_windows(buys(t))


_EVAL = f"""WITH {_S1}, {_F1}, {_B1}, {_B2},
fired AS (SELECT fingerprint, ticker, signal, announced AS fired_at, rank FROM firing JOIN tiers USING (tier, signal)
 UNION ALL SELECT fingerprint, ticker, 's1_cluster_buy', announced, NULL FROM buys WHERE fingerprint IN (SELECT fingerprint FROM s1)
 UNION ALL SELECT fingerprint, ticker, 'f1_first_time_buy', announced, NULL FROM buys WHERE fingerprint IN (SELECT fingerprint FROM f1)
 UNION ALL SELECT fingerprint, ticker, 'b1_lone_conviction_buy', announced, NULL FROM buys WHERE fingerprint IN (SELECT fingerprint FROM b1)),
free AS (SELECT f.*, EXISTS (SELECT 1 FROM win w WHERE w.ticker = f.ticker AND f.fired_at BETWEEN w.start AND w.stop) AS suppressed FROM fired f),
kept AS (SELECT fingerprint, signal, fired_at FROM free WHERE NOT suppressed),
final AS (SELECT * FROM kept UNION ALL SELECT fingerprint, 't0_cluster_combo', min(fired_at) FROM kept GROUP BY fingerprint
 HAVING bool_or(signal = 's1_cluster_buy') AND bool_or(signal IN ('t1a_ceo_founder_buy','t1b_cfo_buy','t2_exec_buy')))
"""


@query("sig15_evaluate_all", _EVAL + "SELECT fingerprint, signal, fired_at FROM final")
def sig15(t):
    return signals.evaluate(t.dealings, t.prices).select("fingerprint", "signal", "fired_at")


@query("sig14_tier_dedup", "SELECT fingerprint, signal FROM firing")
def sig14(t):
    ctx = signals.context(t.dealings, t.prices)
    fired = signals.tier_signals(ctx)
    # the same dealings fire a lower tier's signal too: only the best stays
    lower = fired.where("signal <> 't6_company_sec_buy'").withColumn("signal", F.lit("t4_other_buy"))
    return signals.best_tier(fired.unionByName(lower)).select("fingerprint", "signal")


@query("sig16_deprecate", "SELECT fingerprint, signal FROM firing WHERE signal NOT IN ('t5_pca_buy','t6_company_sec_buy')")
def sig16(t):
    status = t.spark.createDataFrame([("t5_pca_buy", "deprecated"), ("t6_company_sec_buy", "deprecated"), ("t3_ned_buy", "live")], "signal string, status string")
    return tier_firings(t).join(F.broadcast(status.where("status = 'deprecated'")), "signal", "left_anti").select("fingerprint", "signal")


@query("sig17_latest_version", "SELECT signal, max(CAST(fingerprint % 3 AS BIGINT)) AS version, arg_max(fingerprint, (fingerprint % 3, fingerprint)) AS fingerprint FROM firing GROUP BY signal")
def sig17(t):
    versioned = tier_firings(t).withColumn("version", (F.col("fingerprint") % 3).cast("long"))
    return versioned.groupBy("signal").agg(F.max("version").alias("version"), F.max_by("fingerprint", F.struct("version", "fingerprint")).alias("fingerprint"))


@query("sig18_firing_diff", """
SELECT fingerprint, CASE WHEN value >= 150000 AND value < 250000 THEN 'lost' ELSE 'same' END AS change FROM firing WHERE value >= 150000
UNION ALL SELECT fingerprint, 'gained' FROM firing WHERE value < 100000""")
def sig18(t):
    fired = tier_firings(t)
    old = fired.where("value >= 150000").select("fingerprint", F.lit(1).alias("old"))
    new = fired.where("value >= 250000 OR value < 100000").select("fingerprint", F.lit(1).alias("new"))
    change = F.when(F.col("new").isNull(), "lost").when(F.col("old").isNull(), "gained").otherwise("same")
    return old.join(new, "fingerprint", "full").select("fingerprint", change.alias("change"))


@query("sig19_legacy_tiers", """
SELECT fingerprint, CASE WHEN tier IN ('T1a','T1b') AND value >= 100000 THEN 'T1' WHEN tier IN ('T2','T7') AND value >= 25000 THEN 'T2' WHEN tier = 'T3' AND value >= 10000 THEN 'T3'
 WHEN tier IN ('T5','T6') AND value >= 1000 THEN 'T4' END AS legacy FROM buys""")
def sig19(t):
    kind = clean.legacy_role_class(F.col("role"))
    v = F.col("value")
    legacy = F.when((kind == "CEO_CFO") & (v >= 100_000), "T1").when((kind == "EXEC") & (v >= 25_000), "T2").when((kind == "NED") & (v >= 10_000), "T3").when((kind == "OTHER") & (v >= 1_000), "T4")
    return buys(t).select("fingerprint", legacy.alias("legacy"))


@query("sig20_suppression_count", _EVAL + "SELECT signal, count(*) FILTER (suppressed) AS n_suppressed, count(*) AS n FROM free GROUP BY signal")
def sig20(t):
    ctx = signals.context(t.dealings, t.prices)
    fired = signals.tier_signals(ctx).unionByName(signals.cluster_buy(ctx)).unionByName(signals.first_time_buy(ctx)).unionByName(signals.lone_conviction(ctx))
    marked = signals.split_by_crowds(fired, signals.crowd_windows(ctx.buys))
    return marked.groupBy("signal").agg(F.count_if("suppressed").alias("n_suppressed"), F.count(F.lit(1)).alias("n"))


# --- event study ---------------------------------------------------------------


@query("es01_raw_return", "SELECT fingerprint, horizon, round(raw, 6) AS raw FROM es")
def es01(t):
    return event_returns(t).select("fingerprint", "horizon", R("raw").alias("raw"))


@query("es03_car", "SELECT fingerprint, horizon, round(market, 6) AS market, round(car, 6) AS car FROM es")
def es03(t):
    return event_returns(t).select("fingerprint", "horizon", R("market").alias("market"), R("car").alias("car"))


@query("es06_net_car", "SELECT fingerprint, horizon, round(net, 6) AS net FROM es WHERE net IS NOT NULL")
def es06(t):
    return event_returns(t).where("net IS NOT NULL").select("fingerprint", "horizon", R("net").alias("net"))


_WIDE = "SELECT fingerprint, " + ", ".join(f"round(max(net) FILTER (horizon = '{h}'), 6) AS net_{h}" for h in eventstudy.HORIZONS)


_NAMES = list(eventstudy.HORIZONS)
_WIDE = ", ".join(f"round(max({m}) FILTER (horizon = '{h}'), 6) AS {m}_{h}" for m in ("raw", "market", "car", "net") for h in _NAMES) + ", " + ", ".join(f"max(later_dt) FILTER (horizon = '{h}') AS exit_dt_{h}" for h in _NAMES)


@query("es08_backtest_rows", f"""
WITH w AS (SELECT fingerprint, signal, any_value(announced) AS announced, any_value(entry_dt) AS entry_dt, any_value(entry_close) AS entry_close, any_value(benchmark_symbol) AS bench, any_value(is_aim) AS is_aim, any_value(ticker) AS ticker, any_value(role) AS role,
 any_value(value) AS value, any_value(tier) AS tier, any_value(sector) AS sector, any_value(market_cap_gbp) AS market_cap_gbp, {_WIDE}, CASE WHEN any_value(is_aim) THEN 50.0 ELSE 100.0 END::DOUBLE AS cost_bps,
 coalesce(string_agg(horizon, ',' ORDER BY days) FILTER (net IS NOT NULL), '') AS windows_available FROM es GROUP BY 1, 2),
r AS (SELECT *, close / lag(close, 63) OVER v - 1 AS m3, close / min(close) OVER (v ROWS BETWEEN 252 PRECEDING AND CURRENT ROW) - 1 AS above_low FROM fx_prices WINDOW v AS (PARTITION BY ticker ORDER BY dt)),
rev AS (SELECT b.fingerprint, CAST(coalesce((SELECT sum(CASE d.type WHEN 'BUY' THEN d.shares WHEN 'SELL' THEN -d.shares ELSE 0 END) FROM fx_dealings d WHERE d.director = b.director AND d.ticker = b.ticker AND d.announced >= b.announced - 365 AND d.announced < b.announced), 0) AS BIGINT) AS net_prior_shares FROM buys b),
f1 AS (SELECT w.*, round(r.m3, 6) AS m3, round(r.above_low, 6) AS above_low FROM w ASOF LEFT JOIN r ON w.ticker = r.ticker AND w.announced >= r.dt),
f2 AS (SELECT f1.*, CAST(datediff('day', q.report_date, f1.announced) AS INT) AS days_since_results FROM f1 ASOF LEFT JOIN (SELECT DISTINCT ticker, report_date FROM fx_reporting_dates WHERE confidence = 'confirmed') q ON f1.ticker = q.ticker AND f1.announced >= q.report_date),
fx AS (SELECT f2.*, d.director FROM f2 JOIN (SELECT fingerprint, director FROM fx_dealings) d USING (fingerprint)),
f3 AS (SELECT fx.* EXCLUDE (director), CASE WHEN p.pay_status = 'ok' THEN round(fx.value / p.pay_gbp, 6) END AS salary_multiple FROM fx ASOF LEFT JOIN fx_director_pay p ON fx.ticker = p.ticker AND fx.director = p.director AND fx.announced >= p.ar_published_at)
SELECT f3.*, rev.net_prior_shares, rev.net_prior_shares < 0 AS reversal FROM f3 JOIN rev USING (fingerprint)""")
def es08(t):
    """The whole backtest row: returns at every horizon, attributes, and features as of the announcement."""
    from tidemark.operators import features

    order = Window.partitionBy("ticker").orderBy("dt")
    series = t.kept("prices").withColumn("m3", F.col("close") / F.lag("close", 63).over(order) - 1).withColumn("above_low", F.col("close") / F.min("close").over(order.rowsBetween(-252, 0)) - 1)
    fired = t.kept("firings", lambda: tier_firings(t))
    # prices and results hang on ticker and day alike
    confirmed = t.results.where("confidence = 'confirmed'").select("ticker", "report_date").distinct()
    rows = ts.last_of_each(fired, "announced", {"_price": (series, "dt", ["m3", "above_low"]), "_results": (confirmed, "report_date", [])})
    rows = rows.withColumns({"m3": R("_price.m3"), "above_low": R("_price.above_low"), "days_since_results": F.datediff("announced", "_results.report_date")})
    rows = features.latest_pay(rows, t.pay).withColumn("salary_multiple", R(features.salary_multiple(F.col("value"), F.col("found")))).drop("found")
    rows = features.reversal(rows, t.dealings).select("fingerprint", "signal", "m3", "above_low", "days_since_results", "salary_multiple", "net_prior_shares", "reversal")
    wide = eventstudy.wide(event_returns(t))
    rounded = {c: R(c) for c in wide.columns if c.split("_")[0] in ("raw", "market", "car", "net") and c != "market_cap_gbp"}
    return wide.withColumns(rounded).join(rows, ["fingerprint", "signal"])


@query("es09_skip_log", """
SELECT f.fingerprint, CASE WHEN p.idx IS NULL THEN 'no_entry' ELSE 'short_history' END AS reason FROM firing f ASOF LEFT JOIN px p ON f.ticker = p.ticker AND f.announced < p.dt
WHERE p.idx IS NULL OR p.idx <= 30""")
def es09(t):
    return eventstudy.skipped(tier_firings(t), t.prices).select("fingerprint", "reason")


@query("es10_mark_to_market", """
WITH latest AS (SELECT ticker, arg_max(close, dt) AS last_close FROM fx_prices GROUP BY ticker)
SELECT fingerprint, round((last_close / entry_close - 1) * 100 - CASE WHEN is_aim THEN 0.5 ELSE 1.0 END, 2) AS mtm_pct FROM entry JOIN latest USING (ticker)""")
def es10(t):
    entered = eventstudy.entries(tier_firings(t), ts.trade_index(t.prices)).where("entry_idx > 30")
    return eventstudy.mark_to_market(entered, t.prices).select("fingerprint", "mtm_pct")


@query("es12_benchmark_since", """
WITH latest AS (SELECT ticker, arg_max(close, dt) AS last_close FROM fx_prices GROUP BY ticker)
SELECT fingerprint, round((last_close / bench_close - 1) * 100, 2) + 0.0 AS bench_pct FROM bentry JOIN latest ON latest.ticker = benchmark_symbol""")
def es12(t):
    indexed = ts.trade_index(t.prices)
    latest = t.prices.groupBy(F.col("ticker").alias("bench")).agg(F.max_by("close", "dt").alias("last_close"))
    entered = eventstudy.entries(tier_firings(t), indexed).where("entry_idx > 30")
    return eventstudy.benchmark_entries(entered, indexed).join(latest, "bench").select("fingerprint", (R((F.col("last_close") / F.col("bench_close") - 1) * 100, 2) + 0.0).alias("bench_pct"))


@query("es13_indexed_line", "SELECT ticker, dt, round(close / first_value(close) OVER (PARTITION BY ticker ORDER BY dt) * 100, 4) AS line FROM fx_prices")
def es13(t):
    return t.prices.select("ticker", "dt", R(F.col("close") / F.first("close").over(Window.partitionBy("ticker").orderBy("dt")) * 100, 4).alias("line"))


@query("es14_header_quote", """
SELECT ticker, close, round(close / prev - 1, 6) AS change FROM (SELECT *, lag(close) OVER (PARTITION BY ticker ORDER BY dt) AS prev, row_number() OVER (PARTITION BY ticker ORDER BY dt DESC) AS rn FROM fx_prices) WHERE rn = 1""")
def es14(t):
    own = Window.partitionBy("ticker")
    rows = t.prices.withColumn("prev", F.lag("close").over(own.orderBy("dt"))).withColumn("rn", F.row_number().over(own.orderBy(F.desc("dt"))))
    return rows.where("rn = 1").select("ticker", "close", R(F.col("close") / F.col("prev") - 1).alias("change"))
