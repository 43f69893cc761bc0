"""Dealings, prices and reference tables derived from the given star-schema tables.

The derivation is SQL text that Spark and DuckDB read alike, so that oracles can
start from the same rows. ``Tables`` builds each view lazily from one folder.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession

from tidemark.operators.ranking import kept

#: View name -> (source tables, SQL).
VIEWS: dict[str, tuple[tuple[str, ...], str]] = {
    "fx_tickers_meta": (("part",), """
SELECT 'Brand#'||n AS ticker, 'Sector_'||(n%5) AS sector,
       CASE WHEN n%3=0 THEN '^AIM' ELSE '^ALL' END AS benchmark_symbol, (n%3=0) AS is_aim, (n%10=0) AS is_excluded_issuer,
       n*n*2000 AS shares_outstanding, CAST(n*n*2000*950 AS DOUBLE) AS market_cap_gbp
FROM (SELECT DISTINCT CAST(SUBSTRING(p_brand,7) AS INT) AS n FROM part)"""),
    "fx_prices": (("lineitem", "part"), """
SELECT ticker, dt, ROUND(AVG(px),6) AS close, ROUND(MAX(px),6) AS high, ROUND(MIN(px),6) AS low, SUM(q) AS volume FROM
 (SELECT p_brand AS ticker, CAST(l_shipdate AS DATE) AS dt, p_retailprice*(1-l_discount) AS px, l_quantity AS q FROM lineitem JOIN part ON l_partkey=p_partkey) b GROUP BY ticker, dt
UNION ALL SELECT '^ALL', dt, ROUND(AVG(px),6), ROUND(MAX(px),6), ROUND(MIN(px),6), SUM(q) FROM
 (SELECT CAST(l_shipdate AS DATE) AS dt, p_retailprice*(1-l_discount) AS px, l_quantity AS q FROM lineitem JOIN part ON l_partkey=p_partkey) b GROUP BY dt
UNION ALL SELECT '^AIM', dt, ROUND(AVG(px),6), ROUND(MAX(px),6), ROUND(MIN(px),6), SUM(q) FROM
 (SELECT CAST(l_shipdate AS DATE) AS dt, p_retailprice*(1-l_discount) AS px, l_quantity AS q FROM lineitem JOIN part ON l_partkey=p_partkey WHERE CAST(SUBSTRING(p_brand,7) AS INT)%3=0) b GROUP BY dt"""),
    "fx_dealings": (("orders", "customer"), """
SELECT o_orderkey AS fingerprint, CAST(o_orderdate AS DATE) AS dt,
       CAST(o_orderdate AS DATE) + CAST(o_orderkey%4 AS INT) AS announced,
       'Brand#'||(o_custkey%25+1) AS ticker, o_custkey AS director,
       CASE c_mktsegment WHEN 'MACHINERY' THEN 'Chief Executive Officer' WHEN 'BUILDING' THEN 'Chief Financial Officer'
            WHEN 'AUTOMOBILE' THEN 'Non-Executive Director' WHEN 'FURNITURE' THEN 'Executive Chairman'
            ELSE CASE o_custkey%3 WHEN 0 THEN 'Chief Operating Officer' WHEN 1 THEN 'Person Closely Associated with a director'
                 ELSE 'Company Secretary' END END AS role,
       CASE o_orderpriority WHEN '1-URGENT' THEN 'BUY' WHEN '2-HIGH' THEN 'SELL' WHEN '3-MEDIUM' THEN 'GRANT'
            WHEN '4-NOT SPECIFIED' THEN 'EXERCISE' ELSE 'SIP' END AS type,
       CASE o_orderstatus WHEN 'P' THEN 'MIXED' ELSE 'STRICT_BUY' END AS buy_strictness,
       CAST(FLOOR(o_totalprice/950)+1 AS BIGINT) AS shares, o_totalprice AS value
FROM orders JOIN customer ON c_custkey=o_custkey"""),
    "fx_reporting_dates": (("orders",), """
SELECT DISTINCT 'Brand#'||(o_custkey%25+1) AS ticker, CAST(o_orderdate AS DATE) AS report_date,
       CASE o_orderkey%3 WHEN 0 THEN 'PRELIM' WHEN 1 THEN 'INTERIM' ELSE 'TRADING_STMT' END AS report_type,
       CASE WHEN o_orderkey%10=0 THEN 'est' ELSE 'confirmed' END AS confidence
FROM orders WHERE o_orderpriority='5-LOW' AND o_orderstatus='O'"""),
    "fx_short_positions": (("lineitem", "part"), """
SELECT CAST(l_suppkey%10 AS INT) AS holder, p_brand AS ticker, CAST(l_shipdate AS DATE) AS position_date,
       ROUND(MAX(l_discount)*10,2) AS net_short_pct
FROM lineitem JOIN part ON l_partkey=p_partkey WHERE l_linenumber=1 AND l_returnflag='R' GROUP BY 1,2,3"""),
    "fx_director_pay": (("customer",), """
SELECT 'Brand#'||(c_custkey%25+1) AS ticker, c_custkey AS director, MAKE_DATE(y,12,31) AS fy_end, MAKE_DATE(y,12,31)+90 AS ar_published_at,
       ROUND(100000+ABS(c_acctbal)*50+(y-1994)*1000,2) AS pay_gbp,
       CASE WHEN c_acctbal<0 THEN 'new_appointee_no_disclosure' ELSE 'ok' END AS pay_status
FROM customer, (VALUES (1994),(1995),(1996),(1997),(1998),(1999),(2000)) t(y)"""),
}


class Tables:
    """The given tables of a folder, and the views derived from them."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir
        self._kept: dict[str, DataFrame] = {}

    def kept(self, name: str, rows: Callable[[], DataFrame] | None = None) -> DataFrame:
        """A view (or ``rows()``) written once to the shared folder, for plans that read it several times."""
        if name not in self._kept:
            self._kept[name] = kept(rows() if rows else getattr(self, name), name)
        return self._kept[name]

    def read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def _view(self, name: str) -> DataFrame:
        sources, text = VIEWS[name]
        for s in sources:
            self.read(s).createOrReplaceTempView(s)
        return self.spark.sql(text)

    @cached_property
    def meta(self) -> DataFrame:
        return self._view("fx_tickers_meta")

    @cached_property
    def prices(self) -> DataFrame:
        return self._view("fx_prices")

    @cached_property
    def dealings(self) -> DataFrame:
        return self._view("fx_dealings")

    @cached_property
    def results(self) -> DataFrame:
        return self._view("fx_reporting_dates")

    @cached_property
    def shorts(self) -> DataFrame:
        return self._view("fx_short_positions")

    @cached_property
    def pay(self) -> DataFrame:
        return self._view("fx_director_pay")
