"""Operators of the event-study engine on small frames, and oracles on the given tables."""

import datetime as dt
import itertools
import random
from pathlib import Path

import duckdb
import pytest

from tidemark.operators import checks, clean, clusters, conviction, eventstudy, extract, features, portfolio, ranking, signals, writes
from tidemark.operators import timeseries as ts
from tidemark.plans.catalog import ORACLES, QUERIES
from tidemark.sources.fixtures import VIEWS

SF = "/root/testdata/sf0.001"
DAY = dt.date(2024, 1, 1)
DEAL = "fingerprint long, ticker string, director long, dt date, announced date, role string, type string, buy_strictness string, shares long, value double"


def day(n):
    return DAY + dt.timedelta(days=n)


def deal(fp, director=1, at=0, ticker="X", role="Chief Executive Officer", kind="BUY", value=150_000.0, lag=0, shares=100):
    return (fp, ticker, director, day(at), day(at + lag), role, kind, "STRICT_BUY", shares, value)


def test_asof_flavours(spark):
    series = spark.createDataFrame([("X", day(n), float(n)) for n in (0, 2, 4)], "ticker string, dt date, close double")
    events = spark.createDataFrame([(1, "X", day(2)), (2, "X", day(3)), (3, "X", day(9)), (4, "Y", day(2))], "id int, ticker string, at date")

    def found(fn):
        return {r.id: r.found.close if r.found else None for r in fn(events, series, "at", take=["close"]).collect()}

    assert found(ts.first_after) == {1: 4.0, 2: 4.0, 3: None, 4: None}
    assert found(ts.first_from) == {1: 2.0, 2: 4.0, 3: None, 4: None}
    assert found(ts.last_until) == {1: 2.0, 2: 2.0, 3: 4.0, 4: None}
    assert found(ts.last_before) == {1: 0.0, 2: 2.0, 3: 4.0, 4: None}


@pytest.mark.parametrize(
    "role,bucket",
    [("Group CEO", "CEO"), ("Chief Executive Officer, North America", "Divisional"), ("Finance Director", "CFO"), ("Co-Founder and CEO", "Founder"), ("Executive Chairman", "Chair"),
     ("Independent Non-Executive Chair", "NonExecChair"), ("Director", "NED"), ("Senior Independent Director", "NED"), ("PCA of J Smith", "PCA"), ("Director/PDMR", "PDMR"), (None, "Other"),
     ("Regional Director", "Divisional"), ("Managing Director", "ExecDirector"), ("General Counsel", "CoSec"), ("Vice President", "President"), ("Chief Risk Officer", "OtherChief")],
)
def test_role_buckets(spark, role, bucket):
    got = spark.createDataFrame([(role,)], "role string").select(clean.role_bucket(spark_col("role")).alias("b")).first().b
    assert got == bucket


def spark_col(name):
    from pyspark.sql import functions as F

    return F.col(name)


def test_iso_days(spark):
    texts = ["2024-02-03", "3 February 2024", "3rd Feb 2024", "03/02/2024", "3.2.2024", "soon", None]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select(clean.iso_day(spark_col("t")).alias("d")).collect()
    assert [r.d for r in rows] == [dt.date(2024, 2, 3)] * 5 + [None, None]


def _components(rows):
    """Union-find over pairs of different directors at most 30 days apart."""
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, j in itertools.combinations(range(len(rows)), 2):
        if rows[i][2] != rows[j][2] and abs((rows[i][3] - rows[j][3]).days) <= 30:
            parent[find(i)] = find(j)
    groups = {}
    for i in range(len(rows)):
        groups.setdefault(find(i), []).append(rows[i][0])
    return {frozenset(g) for g in groups.values() if len(g) > 1}


def test_clusters_against_union_find(spark):
    rng = random.Random(7)
    for _ in range(4):
        rows = [deal(k, director=rng.randint(1, 3), at=rng.randint(0, 400)) for k in range(30)]
        out = clusters.clusters(spark.createDataFrame(rows, DEAL)).collect()
        got = {}
        for r in out:
            got.setdefault(r.cluster_id, set()).add(r.fingerprint)
        assert {frozenset(g) for g in got.values()} == _components(rows)


def test_first_buys_see_only_the_past(spark):
    prices = spark.createDataFrame([("X", day(n), 1.0) for n in range(3)], "ticker string, dt date, close double")
    base = [deal(1, at=0), deal(2, at=10), deal(3, director=2, at=5)]
    late = [deal(9, director=2, at=50)]

    def fired(rows):
        ctx = signals.context(spark.createDataFrame(rows, DEAL), prices)
        return {r.fingerprint for r in signals.first_time_buy(ctx).collect()}

    assert fired(base) == {1, 3}
    assert fired(base + late) == {1, 3}


def test_cluster_buy_needs_another_director_in_sight(spark):
    prices = spark.createDataFrame([], "ticker string, dt date, close double")
    rows = [deal(1, 1, 0), deal(2, 2, 30), deal(3, 3, 61), deal(4, 4, 200)]
    ctx = signals.context(spark.createDataFrame(rows, DEAL), prices)
    assert {r.fingerprint for r in signals.cluster_buy(ctx).collect()} == {2}


def test_event_returns_by_hand(spark):
    prices = [("X", day(n), 100.0 + n) for n in range(40)] + [("^B", day(n), 1000.0 + n) for n in range(40)]
    firing = spark.createDataFrame([(1, "X", day(31), "^B", True)], "fingerprint long, ticker string, announced date, benchmark_symbol string, is_aim boolean")
    out = eventstudy.returns(firing, spark.createDataFrame(prices, "ticker string, dt date, close double"), {"t1": 1, "t99": 99}).collect()
    by = {r.horizon: r for r in out}
    assert by["t1"].entry_dt == day(32)
    assert by["t1"].net == pytest.approx(133 / 132 - 1 - (1033 / 1032 - 1) - 0.005)
    assert by["t99"].net is None


def test_reversal_window(spark):
    rows = [deal(1, at=400), deal(2, at=400 - 365, kind="SELL", shares=10), deal(3, at=400 - 366, kind="SELL", shares=99), deal(4, at=400, kind="SELL", shares=50)]
    d = spark.createDataFrame(rows, DEAL)
    got = features.reversal(d.where("type = 'BUY'"), d).first()
    assert (got.net_prior_shares, got.reversal) == (-10, True)


PRICE = "ticker string, dt date, close double, volume double"


def _scores(spark, deals, prices, results):
    meta = spark.createDataFrame([("X", "S"), ("Y", "S"), ("Z", "T")], "ticker string, sector string")
    buys = spark.createDataFrame(deals, DEAL)
    fired = signals.context(buys, None).buys.join(meta, "ticker").selectExpr("*", "50e6 AS market_cap_gbp")
    frame = spark.createDataFrame(results, "ticker string, report_date date, report_type string, confidence string")
    out = conviction.scores(fired, buys, spark.createDataFrame(prices, PRICE), frame, meta)
    return {r.fingerprint: (r.who, r.size, r.timing, r.fall, r.guard, r.score) for r in out.collect()}


def test_scores_do_not_look_ahead(spark):
    rng = random.Random(5)
    roles = ["Chief Executive Officer", "Person Closely Associated with a director", "Company Secretary", "Non-Executive Director"]
    deals = [deal(k, director=rng.randint(1, 4), at=rng.randint(80, 160), ticker=rng.choice("XYZ"), role=rng.choice(roles), value=float(rng.randint(1_000, 900_000))) for k in range(40)]
    prices = [(x, day(n), 100 + 20 * rng.random(), 1000.0 * rng.random() + 1) for x in "XYZ" for n in range(170)]
    results = [("X", day(100), "PRELIM", "confirmed"), ("Y", day(130), "INTERIM", "confirmed")]
    now = _scores(spark, deals, prices, results)
    # later buys by more senior people and of other sizes, later prices
    more = [deal(100 + k, director=9, at=161 + k, ticker="XYZ"[k % 3], value=1e6) for k in range(6)]
    late = [(x, day(n), 900.0, 9e9) for x in "XYZ" for n in range(170, 200)]
    after = _scores(spark, deals + more, prices + late, results)
    assert {k: after[k] for k in now} == now and len({v[1] for v in now.values()}) > 5


def test_places_and_groups(spark):
    rng = random.Random(6)
    rows = [(rng.choice("ab"), rng.randint(0, 9), i) for i in range(157)]
    frame = spark.createDataFrame(rows, "g string, x int, i int")
    got = {r.i: r.place for r in ranking.numbered(frame, ["x", "i"], "place", ["g"]).collect()}
    for g in "ab":
        mine = sorted((x, i) for h, x, i in rows if h == g)
        assert [got[i] for _, i in mine] == list(range(1, len(mine) + 1))
    down = {r.i: r.place for r in ranking.numbered(frame, ["x", "i"], "place", descending=("x",)).collect()}
    assert [i for i, _ in sorted(down.items(), key=lambda p: p[1])] == [i for _, x, i in sorted(rows, key=lambda r: (-r[1], r[2]))]
    for n, total in ((10, 157), (5, 3), (4, 8)):
        tiles = spark.range(1, total + 1).select(ranking.tile(spark_col("id"), spark_col("id") * 0 + total, n).alias("t")).collect()
        want = duckdb.sql(f"select ntile({n}) over (order by i) from range({total}) v(i) order by i").fetchall()
        assert [r.t for r in tiles] == [w[0] for w in want]


def test_brewing_counts_are_walk_forward(spark):
    rows = [deal(1, 1, 0), deal(2, 2, 10), deal(3, 3, 100, ticker="Y"), deal(4, 4, 110, ticker="Y")]
    grid = [day(n).isoformat() for n in (15, 45, 100, 145)]
    got = {r.as_of: r.n_brewing for r in clusters.brewing_counts(spark.createDataFrame(rows, DEAL), grid).collect()}
    assert got == {day(15): 0, day(45): 1, day(100): 1, day(145): 1}
    early = {r.as_of: r.n_brewing for r in clusters.brewing_counts(spark.createDataFrame(rows[:2], DEAL), grid[:3]).collect()}
    assert early == {day(15): 0, day(45): 1, day(100): 1}


def test_routine_by_hand(spark):
    d = lambda y, m: (dt.date(y, m, 5) - DAY).days
    rows = [deal(1, 1, d(2021, 3)), deal(2, 1, d(2022, 3)), deal(3, 1, d(2023, 3)), deal(4, 2, d(2022, 1)), deal(5, 2, d(2023, 7)), deal(6, 2, d(2024, 7)), deal(7, 3, d(2024, 1))]
    got = {r.fingerprint: (r.n_years, r.routine_class) for r in features.routine(spark.createDataFrame(rows, DEAL)).collect()}
    assert got == {1: (0, "insufficient"), 2: (1, "insufficient"), 3: (2, "routine"), 4: (0, "insufficient"), 5: (1, "insufficient"), 6: (2, "opportunistic"), 7: (0, "insufficient")}


def test_short_interest_sums_the_latest_of_each_holder(spark):
    shorts = [("X", 1, day(0), 0.5), ("X", 2, day(3), 0.7), ("X", 1, day(5), 0.0), ("Y", 1, day(1), 9.0)]
    fired = spark.createDataFrame([(n, "X", day(n)) for n in (0, 1, 4, 5, 6)], "fingerprint int, ticker string, announced date")
    out = features.short_interest(fired, spark.createDataFrame(shorts, "ticker string, holder int, position_date date, net_short_pct double")).collect()
    assert {r.fingerprint: None if r.short_pct is None else round(r.short_pct, 6) for r in out} == {0: None, 1: 0.5, 4: 1.2, 5: 1.2, 6: 0.7}


def test_names_in_compatibility_form(spark):
    names = [(" Ann\u00a0 SMITH ", "ann smith"), ("ﬁona Straße", "fiona strasse"), ("Ａ B", "a b"), (None, None), ("", "")]
    rows = clean.with_director_key(spark.createDataFrame(names, "name string, want string"), "name").collect()
    assert len(rows) == 5 and all(r.director_key == r.want for r in rows)


def test_cells_people_and_edits(spark):
    text = "Notification of dealings\n1. Details\na) Name: Mr John O'Brien\nPosition: Director\nName of PDMR: Jane van Smith-Jones\nname: someone"
    row = spark.createDataFrame([(text,)], "t string").select(extract.people(spark_col("t")).alias("p")).first()
    assert row.p == ["Mr John O'Brien"]
    edits = [("add", "BUY", "7", "2024-01-02", "X", "A B"), ("add", None, "-1.5", "2 Jan", " ", None), ("reject", "?", "x", None, None, None), ("update", None, None, None, None, None)]
    frame = spark.createDataFrame(edits, "action string, type string, shares string, date string, ticker string, director string")
    got = [r.e for r in frame.select(checks.field_errors(frame, []).alias("e")).collect()]
    assert got == [[], ["ticker_required", "director_required", "type_required", "shares_negative", "shares_not_whole", "date_not_iso", "ticker_empty"], [], []]


def test_namesakes_in_one_filing_are_two_people(spark):
    part = "1. Details of the person discharging responsibilities\na) Name: {}\nFull name: {}\nPosition: Director\n"
    texts = [part.format("Mr Adam Smith", "Mr Adam Smith") * 2, part.format("Mr Adam Smith", "Mr Adam Smith"), "Name: Ann Lee\nName: Mr Adam Smith\n" + part.format("Mr Adam Smith", "Mr Adam Smith"), "Name: Ann Lee\nName: Ann Lee"]
    single, review = extract.bundled(spark.createDataFrame(list(enumerate(texts)), "k int, text string"))
    assert {r.k: r.names for r in single.collect()} == {1: ["Mr Adam Smith"], 3: ["Ann Lee"]}
    assert {r.k: r.names for r in review.collect()} == {0: ["Mr Adam Smith"] * 2, 2: ["Ann Lee", "Mr Adam Smith"]}


def test_tracker_by_hand(spark):
    prices = [("X", day(n), 100.0 + n) for n in range(60)] + [("^B", day(n), 1000.0) for n in range(60)]
    frame = spark.createDataFrame(prices, "ticker string, dt date, close double")
    entered = spark.createDataFrame([(1, "X", "^B", True, day(10), 11, 110.0, 1000.0), (2, "X", "^B", True, day(50), 51, 150.0, 1000.0)], "fingerprint int, ticker string, bench string, is_aim boolean, entry_dt date, entry_idx int, entry_close double, bench_close double")
    got = {r.dt: r for r in portfolio.tracker(entered, frame, day(55).isoformat()).collect()}
    held = 10_000 * 0.995 / 110
    assert got[day(20)].strategy_value == pytest.approx(10_000 + held * 120, abs=0.01) and got[day(20)].n_open == 1
    assert got[day(40)].strategy_value == pytest.approx(10_000 + held * 131, abs=0.01) and got[day(40)].n_open == 0
    assert got[day(55)].strategy_value == pytest.approx(held * 131 + 10_000 * 0.995 / 150 * 155, abs=0.01) and got[day(55)].index_value == 20_000


def test_copies_are_compared_by_content(spark, tmp_path):
    frame = spark.createDataFrame([(1, "a"), (2, None)], "k int, v string")
    row = writes.reload(spark, {"t": (frame, ["k"])}, str(tmp_path)).first()
    assert (row.n_keys, row.n_same, row.n_other) == (2, 2, 0)
    back = writes.result_file(frame.where("k = 1"), str(tmp_path / "csv"), ["v", "k"])
    assert back.columns == ["v", "k"] and [tuple(r) for r in back.collect()] == [("a", 1)]


def test_a_source_that_comes_out_otherwise_each_time_is_compared_as_it_was_copied(spark, tmp_path):
    frame = spark.range(20).selectExpr("id AS k", "reflect('java.util.UUID', 'randomUUID') AS v")
    row = writes.reload(spark, {"t": (frame, ["k"])}, str(tmp_path)).first()
    assert (row.n_keys, row.n_same, row.n_other) == (20, 20, 0)


def test_position_sizes(spark):
    row = spark.createDataFrame([(20e6, "T1a")], "value double, tier string")
    c = spark_col
    sizes = {s: row.select(portfolio.position_size(c("value"), s, c("tier")).alias("s")).first().s for s in portfolio.SCHEMES}
    assert sizes["flat"] == 1000 and sizes["capped"] == 50_000 and sizes["linear"] == 100_000 and sizes["log"] == pytest.approx(2602.06, abs=0.01)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in {s for sources, _ in VIEWS.values() for s in sources} | {"events", "pages"}:
        con.sql(f"create view {name} as select * from '{SF}/{name}.parquet'")
    return con


def _plain(v):
    if hasattr(v, "replace") and isinstance(v, dt.datetime):
        return v.replace(tzinfo=None)
    if isinstance(v, float):
        return float(f"{v:.9g}") + 0.0
    return [_plain(x) for x in v] if isinstance(v, (list, tuple)) else v


@pytest.mark.parametrize("name", ["jn03_first_after", "cl01_clusters", "sig15_evaluate_all", "ag01_scoreboard", "ft07_reversal", "cv07_composite", "fil12_field_validation", "snk06_nested_export", "str04_buyer_sessions",
    "cl02_cluster_lists", "sig13_crowd_windows", "dq09_survivors", "jn20_key_changes", "ext07_filing_rows", "ft16_relative_size", "pf06_guarded_summary", "st02_tier_verdicts"])
def test_oracles(spark, duck, name):
    df = QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    got = sorted(([_plain(v) for v in r] for r in df.select(*columns).collect()), key=str)
    want = duck.sql(ORACLES[name])
    order = [want.columns.index(c) for c in columns]
    assert got == sorted(([_plain(r[i]) for i in order] for r in want.fetchall()), key=str)


def test_every_query_has_a_plan_and_entry_imports():
    import __spark_entry__

    assert set(QUERIES) <= set(__spark_entry__.queries())
    assert Path(__spark_entry__.__file__).exists()
