"""Registered queries: a DataFrame plan over Tables, and its SQL over the same views."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tidemark.sources.fixtures import VIEWS, Tables

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

#: Steps that many oracles share, after the views.
STEPS = {
    "px": "SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY dt) AS idx FROM fx_prices",
    "buys": """
SELECT *, CASE role WHEN 'Chief Executive Officer' THEN 'T1a' WHEN 'Chief Financial Officer' THEN 'T1b' WHEN 'Executive Chairman' THEN 'T7'
   WHEN 'Chief Operating Officer' THEN 'T2' WHEN 'Non-Executive Director' THEN 'T3' WHEN 'Company Secretary' THEN 'T6' ELSE 'T5' END AS tier
FROM fx_dealings WHERE type = 'BUY'""",
    "tiers": """
SELECT * FROM (VALUES ('T1a',100000,'t1a_ceo_founder_buy','high',1),('T1b',100000,'t1b_cfo_buy','high',2),('T7',25000,'t7_chair_buy','med',3),
 ('T2',25000,'t2_exec_buy','med',4),('T3',10000,'t3_ned_buy','med',5),('T5',10000,'t5_pca_buy','low',6),('T6',10000,'t6_company_sec_buy','low',7)) v(tier,least,signal,confidence,rank)""",
    "firing": """
SELECT b.*, t.signal, t.confidence, m.sector, m.benchmark_symbol, m.is_aim, m.market_cap_gbp, m.shares_outstanding
FROM buys b JOIN tiers t ON b.tier = t.tier AND b.value >= t.least JOIN fx_tickers_meta m ON b.ticker = m.ticker WHERE b.buy_strictness = 'STRICT_BUY'""",
    "entry": """
SELECT f.*, p.dt AS entry_dt, p.idx AS entry_idx, p.close AS entry_close FROM firing f ASOF JOIN px p ON f.ticker = p.ticker AND f.announced < p.dt
WHERE p.idx > 30""",
    "bentry": """
SELECT e.*, b.idx AS bench_idx, b.close AS bench_close FROM entry e ASOF LEFT JOIN px b ON e.benchmark_symbol = b.ticker AND e.entry_dt >= b.dt""",
    "hz": "SELECT * FROM (VALUES ('t1',1),('t30',21),('t90',63),('t180',126),('t365',252)) v(horizon,days)",
    "es0": """
SELECT e.*, hz.horizon, hz.days, CASE WHEN p.close / e.entry_close BETWEEN 0.25 AND 4 THEN p.close / e.entry_close - 1 END AS raw, b.close / e.bench_close - 1 AS market, p.dt AS later_dt
FROM bentry e CROSS JOIN hz LEFT JOIN px p ON p.ticker = e.ticker AND p.idx = e.entry_idx + hz.days
LEFT JOIN px b ON b.ticker = e.benchmark_symbol AND b.idx = e.bench_idx + hz.days""",
    "es": "SELECT *, raw - market AS car, raw - market - CASE WHEN is_aim THEN 0.005 ELSE 0.01 END AS net FROM es0",
}


def with_views(body: str) -> str:
    """The SQL with the views and steps it rests on as CTEs."""
    ctes = {**{n: t for n, (_, t) in VIEWS.items()}, **STEPS}
    needed: list[str] = []

    def need(text: str) -> None:
        for name in ctes:
            if name not in needed and _mentions(text, name):
                need(ctes[name])
                if name not in needed:
                    needed.append(name)

    need(body)
    if not needed:
        return body
    head = ",\n".join(f"{n} AS ({ctes[n]})" for n in needed)
    text = body.strip()
    return f"WITH {head},\n{text[5:]}" if text[:5].upper() == "WITH " else f"WITH {head}\n{text}"


def _mentions(text: str, name: str) -> bool:
    return re.search(rf"(?i)\b(from|join)\s+{name}\b", text) is not None


def query(name: str, oracle: str | None):
    """Register ``plan(tables)`` under ``name``; ``oracle`` is DuckDB SQL that may use the views and steps."""

    def put(plan: Callable[[Tables], DataFrame]):
        QUERIES[name] = lambda spark, sf_dir: plan(Tables(spark, sf_dir))
        if oracle is not None:
            ORACLES[name] = with_views(oracle)
        return plan

    return put
