"""Queries on filings: pages that carry a notification's tables, read back cell by cell.

The tables hold an order's lines as tranches: prices in pounds, pence or dollars, dates in the rows, as a label or missing, an aggregate as a
number, N/A or missing, one person or two, and volumes that look like years. Around them stands the page's own text, with words of other kinds.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import extract, filings
from tidemark.plans.core import R
from tidemark.plans.registry import query

_NATURE = {"BUY": "Purchase of ordinary shares", "SELL": "Sale of shares", "GRANT": "Grant of options", "EXERCISE": "Exercise of options", "SIP": "Share Incentive Plan"}


def filing_pages(t):
    """Rows (page_id, html): the pages with an order of their own, with its notification behind their text."""
    line = F.struct(
        F.col("l_linenumber").alias("n"), (F.col("l_quantity").cast("int") * 100 + F.col("l_linenumber")).cast("long").alias("volume"),
        (F.floor(F.col("l_extendedprice") * 100 / F.col("l_quantity")) / 100).alias("price"), F.col("l_shipdate").cast("date").alias("day"),
    )
    orders = t.read("lineitem").groupBy(F.col("l_orderkey").alias("fingerprint")).agg(F.array_sort(F.collect_list(line)).alias("lines"))
    rows = t.read("pages").withColumn("fingerprint", F.col("page_id") + 1).join(t.dealings, "fingerprint").join(orders, "fingerprint")
    fp = F.col("fingerprint")
    tag = lambda name, *c: F.concat(F.lit(f"<{name}>"), *c, F.lit(f"</{name}>"))
    row = lambda *cells: tag("tr", *[tag("td", c) for c in cells])
    comma = lambda c: F.format_number(c, 0)
    two, dated = fp % 11 == 0, fp % 2 == 0
    paid = lambda x: F.when(fp % 5 == 0, F.concat(F.lit("US$"), F.format_string("%.2f", x))).when(fp % 5 == 1, F.concat(F.format_string("%.0f", x * 100), F.lit("p"))).otherwise(F.concat(F.lit("&pound;"), F.format_number(x, 2)))
    who = lambda i: F.concat(F.lit("Mr "), F.when(i % 2 == 0, "A").otherwise("B"), F.lit(" Person"))

    def tranche(x, i):
        name = F.when(two, tag("td", who(i))).otherwise("")
        day = F.when(dated, tag("td", F.date_format(x["day"], "d MMMM yyyy"))).otherwise("")
        return tag("tr", name, day, tag("td", F.lit("<span>"), paid(x["price"]), F.lit("</span>")), tag("td", comma(x["volume"])))

    head = tag("tr", F.when(two, "<th>Name of PDMR</th>").otherwise(""), F.when(dated, "<th>Date</th>").otherwise(""), F.lit("<th>Price(s)</th><th>Volume(s)</th>"))
    total = F.aggregate("lines", F.lit(0).cast("long"), lambda n, x: n + x["volume"])
    details = tag(
        "table",
        F.when(~two, row(F.lit("a)"), F.lit("Name"), F.lit("Ms C Person"))).otherwise(""),
        row(F.lit("b)"), F.lit("Nature of the transaction"), F.element_at(F.create_map(*[F.lit(x) for kv in _NATURE.items() for x in kv]), F.col("type"))),
        F.when(~dated & (fp % 7 != 0), row(F.lit("c)"), F.lit("Date of the transaction:"), F.date_format("dt", "dd/MM/yyyy"))).otherwise(""),
        F.when(fp % 3 == 0, row(F.lit("Aggregated volume:"), F.lit("N/A"))).when(fp % 3 == 1, row(F.lit("Aggregated volume:"), comma(total + 10))).otherwise(""),
        F.lit('<tr><td colspan="2">Resulting holding</td><td>'), comma(fp + 3000), F.lit("</td></tr>"),
    )
    moves = tag("table", F.lit('<tr><td colspan="2">Price(s) and volume(s)</td></tr>'), head, F.array_join(F.transform("lines", tranche), ""))
    news = F.lit("<div>Other news: grant of options; sale of shares; purchase of shares</div>")
    return rows.select("page_id", F.concat("html", news, details, moves, F.lit("<p>End of notification</p>"), news).alias("html"))


_FILED = """
l AS (SELECT l_orderkey AS fingerprint, l_linenumber AS n, CAST(l_quantity AS INT) * 100 + l_linenumber AS volume, floor(l_extendedprice * 100 / l_quantity) / 100 AS price, CAST(l_shipdate AS DATE) AS day,
 row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, CAST(l_quantity AS INT) * 100 + l_linenumber, floor(l_extendedprice * 100 / l_quantity) / 100, l_shipdate) - 1 AS i FROM lineitem),
f AS (SELECT d.fingerprint - 1 AS page_id, d.*, l.n, l.volume, l.price, l.day, CASE WHEN d.fingerprint % 11 <> 0 THEN 'Ms C Person' WHEN i % 2 = 0 THEN 'Mr A Person' ELSE 'Mr B Person' END AS name
 FROM l JOIN fx_dealings d USING (fingerprint) JOIN pages p ON p.page_id = d.fingerprint - 1),
g AS (SELECT page_id, fingerprint, name, any_value(type) AS kind, CASE WHEN fingerprint % 2 = 0 THEN max(day) WHEN fingerprint % 7 <> 0 THEN any_value(dt) END AS dt,
 sum(volume) + CASE WHEN fingerprint % 11 <> 0 AND fingerprint % 3 = 1 THEN 10 ELSE 0 END AS shares, sum(volume * price) / sum(volume) AS price, count(DISTINCT price) AS prices,
 CASE fingerprint % 5 WHEN 0 THEN 'foreign' WHEN 1 THEN 'GBX' ELSE 'GBP' END AS unit FROM f GROUP BY page_id, fingerprint, name)
"""


@query("ext03_price_warnings", "WITH " + _FILED + """
SELECT page_id, name, round(price, 4) AS price, unit, list_filter([CASE WHEN shares BETWEEN 1990 AND 2099 THEN 'year_as_shares' END, CASE WHEN prices > 1 THEN 'multiple_prices' END, CASE WHEN unit = 'foreign' THEN 'foreign_currency' END,
 CASE WHEN dt IS NULL THEN 'missing_date' END, CASE WHEN fingerprint % 11 = 0 AND (SELECT count(DISTINCT name) FROM g o WHERE o.page_id = g.page_id) > 1 THEN 'bundled_multi_pdmr' END], lambda x: x IS NOT NULL) AS warnings FROM g""")
def ext03_warnings(t):
    """Prices of each person in a filing, with what is doubtful: years as volumes, several prices, other currencies."""
    rows = filings.filing_rows(filing_pages(t), "page_id")
    return rows.select("page_id", "name", R("price", 4).alias("price"), "unit", "warnings")


@query("ext04_kind_in_cell", "WITH " + _FILED + "SELECT DISTINCT page_id, kind FROM g")
def ext04_cell(t):
    """The kind is read beside its label only; the page around names all of them."""
    grids = filing_pages(t).select("page_id", filings.tables(F.col("html")).alias("grid"))
    found = grids.select("page_id", filings.pairs(F.col("grid")).alias("found"))
    return found.select("page_id", extract.kind(filings.value_of(F.col("found"), "nature")).alias("kind"))


@query("ext07_filing_rows", "WITH " + _FILED + "SELECT page_id, name, kind, dt, CAST(shares AS BIGINT) AS shares, round(price * shares, 2) AS value FROM g")
def ext07_rows(t):
    """One dealing per filing and person: the labelled aggregate, or the tranches' sum where it is N/A or missing."""
    rows = filings.filing_rows(filing_pages(t), "page_id")
    return rows.select("page_id", "name", "kind", "dt", "shares", R("value", 2).alias("value"))


@query("ext10_filing_gate", "WITH " + _FILED + """, w AS (SELECT *, shares BETWEEN 1990 AND 2099 OR unit = 'foreign' OR dt IS NULL OR fingerprint % 11 = 0 AND (SELECT count(DISTINCT name) FROM g o WHERE o.page_id = g.page_id) > 1 AS waits FROM g)
SELECT page_id, name, CASE WHEN waits THEN 'pending' ELSE 'ingested' END AS lane FROM w""")
def ext10_gate(t):
    """Row by row: what blocks waits, several prices alone do not."""
    ingested, pending = extract.gate(filings.filing_rows(filing_pages(t), "page_id"))
    lane = lambda df, name: df.select("page_id", "name", F.lit(name).alias("lane"))
    return lane(ingested, "ingested").unionByName(lane(pending, "pending"))


@query("ext08_holding_in_table", "WITH " + _FILED + "SELECT page_id, name, CASE WHEN fingerprint + 3000 NOT BETWEEN 1990 AND 2099 AND (kind <> 'BUY' OR fingerprint + 3000 >= shares) THEN fingerprint + 3000 END AS holding FROM g")
def ext08_table(t):
    return filings.filing_rows(filing_pages(t), "page_id").select("page_id", "name", "holding")


@query("ext01_cells", "WITH " + _FILED + """
SELECT page_id, CAST(count(*) * (2 + CASE WHEN any_value(fingerprint) % 2 = 0 THEN 1 ELSE 0 END + CASE WHEN any_value(fingerprint) % 11 = 0 THEN 1 ELSE 0 END) AS BIGINT) AS n_cells, CAST(sum(volume) AS BIGINT) AS volume FROM f GROUP BY page_id""")
def ext01_cells(t):
    """The cells of the second table, below its header: how many there are, and the sum of the last column."""
    cells = filings.grid(filing_pages(t), "page_id").where("table = 1 AND row > 1")
    last = F.max("col").over(_row_of_table())
    numbers = cells.withColumn("volume", F.when(F.col("col") == last, filings.whole_number(F.col("text"))))
    return numbers.groupBy("page_id").agg(F.count(F.lit(1)).alias("n_cells"), F.sum("volume").alias("volume"))


def _row_of_table():
    from pyspark.sql import Window

    return Window.partitionBy("page_id", "row")
