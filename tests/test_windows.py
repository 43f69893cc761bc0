"""Order-bound operators on a hot key against brute force: clusters, crowds, sliding counts, ranks against history, running medians."""

import datetime as dt
import random
import statistics

import pytest
from pyspark.sql import functions as F

from tidemark.operators import aggregate, clusters, portfolio, ranking, signals
from tidemark.operators import timeseries as ts
from tidemark.operators.groups import near_groups
from tidemark.streaming import jobs

DAY = dt.date(2024, 1, 1)
DEAL = "fingerprint long, ticker string, director long, dt date, announced date, role string, type string, buy_strictness string, shares long, value double"


def day(n):
    return DAY + dt.timedelta(days=n)


def deals(spark, rows):
    """(fingerprint, ticker, director, day, lag)"""
    return spark.createDataFrame([(fp, t, d, day(n), day(n + lag), "CEO", "BUY", "STRICT_BUY", 1, 1.0) for fp, t, d, n, lag in rows], DEAL)


def groups(rows, reach):
    """Components of different directors of one ticker at most ``reach`` days apart, by their members."""
    parent = {r[0]: r[0] for r in rows}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(rows):
        for b in rows[:i]:
            if a[1] == b[1] and a[2] != b[2] and abs(a[3] - b[3]) <= reach:
                parent[root(a[0])] = root(b[0])
    out = {}
    for r in rows:
        out.setdefault(root(r[0]), set()).add(r[0])
    return {frozenset(g) for g in out.values() if len(g) > 1}


@pytest.mark.parametrize("seed,directors,span,reach", [(1, 2, 300, 30), (2, 4, 900, 30), (3, 2, 60, 3), (4, 40, 2000, 30), (5, 3, 40, 0)])
def test_clusters_of_a_hot_ticker(spark, seed, directors, span, reach):
    rng = random.Random(seed)
    rows = [(k, "HOT" if rng.random() < 0.8 else f"T{k % 3}", rng.randint(1, directors), rng.randint(0, span), 0) for k in range(150)]
    got = {}
    for r in clusters.clusters(deals(spark, rows), reach).collect():
        got.setdefault((r.ticker, r.cluster_id), set()).add(r.fingerprint)
    assert {frozenset(g) for g in got.values()} == groups(rows, reach)
    first = {r[0]: r[3] for r in rows}
    assert all(name == f"{t}-{day(min(first[k] for k in g))}" for (t, name), g in got.items())


def test_a_window_of_clusters_holds_a_row_a_day(spark):
    """20,000 buys of one ticker on ten days: ten rows reach the window."""
    days = spark.range(20_000).select(F.lit("HOT").alias("ticker"), (F.col("id") % 10).cast("int").alias("day"), (F.col("id") % 700).alias("director"))
    daily = days.groupBy("ticker", "day").agg(F.min("director").alias("lo"), F.max("director").alias("hi"))
    assert daily.count() == 10 and {(r.first, r.last) for r in clusters.components(daily, ["ticker"]).collect()} == {(0, 9)}


@pytest.mark.parametrize("back,ahead", [(0, 30), (-29, 0), (-3, 3), (0, 0)])
def test_distinct_members_in_reach(spark, back, ahead):
    rng = random.Random(back + ahead)
    rows = [(rng.choice("AAAB"), rng.randint(1, 6), rng.randint(0, 120)) for _ in range(120)] + [("A", None, 4), ("A", 3, None), ("A", 2, 7), ("A", 2, 7)]
    frame = spark.createDataFrame(rows, "ticker string, director int, day int")
    got = ts.distinct_in_reach(frame, ["ticker"], "director", "day", back, ahead).collect()
    want = lambda t, at: len({d for k, d, n in rows if k == t and d is not None and n is not None and n + back <= at <= n + ahead})
    assert len(got) == len({(r.ticker, r.day) for r in got}) and all(r.n == want(r.ticker, r.day) for r in got)
    assert {(t, n) for t, d, n in rows if d is not None and n is not None} <= {(r.ticker, r.day) for r in got}


def test_crowds(spark):
    rng = random.Random(8)
    rows = [(k, "HOT", rng.randint(1, 12), rng.randint(0, 1500), rng.randint(0, 3)) for k in range(160)]
    held = []
    for d in sorted({r[3] + r[4] for r in rows}):
        if len({r[2] for r in rows if d - 30 <= r[3] + r[4] <= d}) >= 4:
            if held and d <= held[-1][1]:
                held[-1][1] = d + 60
            else:
                held.append([d, d + 60])
    got = sorted((r.start, r.stop) for r in signals.crowd_windows(deals(spark, rows)).collect())
    assert held and got == [(day(a), day(b)) for a, b in held]


def test_sliding_counts(spark):
    rng = random.Random(9)
    rows = [(rng.choice("AB"), rng.randint(1, 5), rng.randint(0, 100)) for _ in range(60)]
    frame = spark.createDataFrame([(t, d, day(n)) for t, d, n in set(rows)], "ticker string, director int, day date")
    want = {}
    for t, d, n in rows:
        for k in range(30):
            want.setdefault((day(n - k), t), set()).add(d)
    assert {(r.start, r.ticker): r.n_buyers for r in jobs.sliding_counts(frame).collect()} == {k: len(v) for k, v in want.items()}


def test_ranks_against_earlier_values(spark):
    rng = random.Random(11)
    data = [(day(rng.randint(0, 70)), rng.choice([1.0, 2.0, 2.5, rng.random() * 9]), rng.choice([None, float("nan"), rng.random(), 0.5])) for _ in range(250)]
    data += [(None, 1.0, 1.0), (day(3), None, None)]
    frame = spark.createDataFrame(data, "at date, a double, b double")
    asked = spark.createDataFrame([*data[:100], (day(90), 2.5, 0.5), (day(-5), 1.0, 1.0)], "at date, a double, b double")
    ok = lambda v: v is not None and v == v
    got = {(r.measure, r.day, r.value): (r.n_below, r.n_before) for r in ranking.below_before(frame, asked, "at", ["a", "b"]).collect()}
    want = {}
    for r in asked.collect():
        for m in ("a", "b"):
            if ok(r[m]) and r["at"] is not None:
                earlier = [x[1 + "ab".index(m)] for x in data if x[0] is not None and x[0] < r["at"] and ok(x[1 + "ab".index(m)])]
                want[m, r["at"], r[m]] = (sum(v < r[m] for v in earlier), len(earlier))
    assert got == want
    assert ranking.below_before(frame.limit(0), asked, "at", ["a"]).agg(F.max("n_before")).first()[0] == 0


@pytest.mark.parametrize("n,kinds", [(40, 5), (600, 400), (300, 1)])
def test_medians_of_earlier_days(spark, n, kinds):
    rng = random.Random(n)
    data = [(rng.choice("HHHHB"), day(rng.randint(0, 90)), float(rng.randint(1, kinds))) for _ in range(n)] + [(None, day(1), 1.0), ("H", None, 1.0), ("H", day(2), None)]
    frame = spark.createDataFrame(data, "who string, at date, v double")
    want = {}
    for w, d, v in data:
        earlier = [x for k, e, x in data if k == w and e is not None and d is not None and e < d and x is not None]
        if w is not None and earlier and v is not None:
            want[w, d] = statistics.median(earlier)
    assert {(r.who, r.day): r.median for r in ranking.median_before(frame, "who", "at", "v").collect()} == want


def test_percentiles_of_large_groups_are_exact(spark):
    rng = random.Random(12)
    data = [(rng.choice(["hot"] * 8 + ["b", None]), rng.gauss(0, 1), rng.choice([1.0, 2.0, None, rng.random()])) for _ in range(6000)]
    frame = spark.createDataFrame(data, "k string, a double, b double")
    for share in (0.5, 0.01, 0.99, 0.0, 1.0):
        got = {r.k: (r.a, r.b) for r in ranking.exact_medians(frame, ["k"], ["a", "b"], share, accuracy=50).collect()}
        want = {r.k: (r.a, r.b) for r in frame.groupBy("k").agg(F.percentile("a", share).alias("a"), F.percentile("b", share).alias("b")).collect()}
        assert set(got) == set(want) == {"hot", "b", None}
        assert all(got[k] == pytest.approx(want[k], abs=1e-12) for k in want)
    assert ranking.exact_medians(frame.limit(0), ["k"], ["a"]).count() == 0
    board = aggregate.scoreboard(frame.withColumn("net", F.col("a")), ["k"], "net").collect()
    sketch = aggregate.scoreboard(frame.withColumn("net", F.col("a")), ["k"], "net", accuracy=10_000).collect()
    assert {(r.k, r.n, r.hit_pct) for r in board} == {(r.k, r.n, r.hit_pct) for r in sketch}


@pytest.mark.parametrize("ahead", [0, 1, 5, 21, 40])
def test_extremes_ahead(spark, ahead):
    rng = random.Random(ahead)
    closes = [rng.random() for _ in range(30)]
    frame = spark.createDataFrame([("X", day(i), c) for i, c in enumerate(closes)] + [("Y", day(0), 5.0)], "ticker string, dt date, close double")
    got = {(r.ticker, r.dt): (r.least_ahead, r.most_ahead) for r in ts.extremes_ahead(frame, "close", ahead).collect()}
    want = {("X", day(i)): (min(closes[i : i + ahead + 1]), max(closes[i : i + ahead + 1])) for i in range(30)} | {("Y", day(0)): (5.0, 5.0)}
    assert got == want


def test_several_series_are_looked_up_at_once(spark):
    rng = random.Random(2)
    series = {n: spark.createDataFrame([(rng.choice("AB"), day(rng.randint(0, 50)) if n != "c" else day(k), k) for k in range(m)], "ticker string, d date, v int").dropDuplicates(["ticker", "d"]) for n, m in (("a", 20), ("b", 3), ("c", 40))}
    events = spark.createDataFrame([(k, rng.choice(["A", "B", "Z", None]), day(rng.randint(-3, 60)) if k else None) for k in range(40)], "k int, ticker string, at date")
    got = {r.k: (r.a, r.b, r.c) for r in ts.last_of_each(events, "at", {n: (s, "d", ["v"]) for n, s in series.items()}).collect()}
    one = {n: {r.k: r.found for r in ts.last_until(events, s, "at", when="d", take=["v"]).collect()} for n, s in series.items()}
    assert got == {k: (one["a"][k], one["b"][k], one["c"][k]) for k in range(40)}


def test_tracker_guards(spark):
    prices = [(t, day(n), c) for t, f in {"OK": lambda n: 100.0, "UP": lambda n: 20.0 if n == 15 else 1.0, "DOWN": lambda n: 1.0 if n < 14 else 0.2, "LATE": lambda n: 1.0 if n < 40 else 9.0, "HDD": lambda n: 1.0, "BAD": lambda n: 1.0, "^B": lambda n: 1.0}.items() for n in range(60) for c in [f(n)]]
    frame = spark.createDataFrame(prices, "ticker string, dt date, close double")
    names = ["OK", "UP", "DOWN", "LATE", "HDD", "BAD"]
    entered = spark.createDataFrame([(k, t, "^B", True, day(10), 11, 100.0 if t == "OK" else 1.0, 1.0) for k, t in enumerate(names)], "fingerprint int, ticker string, bench string, is_aim boolean, entry_dt date, entry_idx int, entry_close double, bench_close double")
    checked = portfolio.guarded(entered, frame, day(50).isoformat(), 21, ("HDD",), spark.createDataFrame([("BAD",)], "ticker string"))
    assert {r.ticker: r.excluded for r in checked.collect()} == {"OK": None, "UP": "excluded_split", "DOWN": "excluded_split", "LATE": None, "HDD": "excluded_ticker", "BAD": "excluded_issuer"}
    series = portfolio.tracker(checked.where("excluded IS NULL"), frame, day(50).isoformat())
    row = portfolio.tracker_summary(series, counts=portfolio.guard_counts(checked, day(50).isoformat())).first()
    assert (row.n_positions, row.excluded_split, row.excluded_ticker, row.excluded_issuer) == (2, 2, 1, 1)
    # by the 12th nothing has gone wrong yet
    early = portfolio.guarded(entered, frame, day(12).isoformat(), 21)
    assert early.where("excluded IS NOT NULL").count() == 0


def test_rows_of_like_values_are_not_broadcast_for_medians(spark):
    rows = ranking.kept(spark.range(100_000).select(F.lit("hot").alias("k"), (F.col("id") % 3).cast("double").alias("a")))
    out = ranking.exact_medians(rows, ["k"], ["a"])
    plan = out._jdf.queryExecution().executedPlan().toString()
    # the files take a few hundred bytes, so their size says nothing of the rows that a broadcast would gather in the driver
    assert "BuildLeft" not in plan and "LeftOuter" in plan and [tuple(r) for r in out.collect()] == [("hot", 1.0)]


@pytest.mark.parametrize("seed,lag,span", [(1, 3, 200), (2, 60, 120), (3, 0, 40), (4, 200, 400)])
def test_other_directors_are_counted_without_pairs(spark, seed, lag, span):
    rng = random.Random(seed)
    rows = [(k, rng.choice("HHHHB"), rng.choice([*range(1, 9), None]), rng.randint(0, span), rng.randint(0, lag)) for k in range(160)]
    buys = deals(spark, rows)
    asked = buys.where("fingerprint % 3 > 0")
    for days in (5, 30, 60):
        counts = {(r.ticker, r.dt, r.announced): r.others for r in signals.other_counts(buys, asked, days).collect()}
        gaps = {(r.ticker, r.dt, r.announced): r.gap for r in signals.nearest_other(buys, asked, days).collect()}
        for k, t, d, n, late in rows:
            if k % 3 and d is not None:
                seen = [(e, abs(m - n)) for _, u, e, m, late2 in rows if u == t and e not in (None, d) and abs(m - n) <= days and m + late2 <= n + late]
                at = (t, day(n), day(n + late))
                assert counts[at] == len({e for e, _ in seen}) and gaps.get(at) == min((g for _, g in seen), default=None)


def written(spark):
    """Rows that tasks have written for shuffles so far."""
    sc = spark.sparkContext
    sc._jsc.sc().listenerBus().waitUntilEmpty()
    stages = sc._jsc.sc().statusStore().stageList(None, False, False, sc._gateway.new_array(sc._jvm.double, 0), sc._jvm.java.util.ArrayList())
    return sum(stages.apply(i).shuffleWriteRecords() for i in range(stages.size()))


@pytest.fixture
def shuffled(spark):
    """As with tables beyond the broadcast limit."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_crowded_days_write_no_pairs(spark, shuffled):
    rows = [(k, "H", k % 500, k % 20, 0) for k in range(4000)]  # each of 4000 buys sees 499 others
    buys = ranking.kept(deals(spark, rows))
    before = written(spark)
    counts = signals.other_counts(buys, buys).agg(F.min("others"), F.max("others"), F.count("*")).first()
    gaps = signals.nearest_other(buys, buys, 60).agg(F.max("gap")).first()
    assert counts[1] == 499 and counts[2] == 20 and gaps[0] == 0 and written(spark) - before < 20 * 4000


def test_a_crowd_writes_no_pairs_in_a_sweep(spark, shuffled):
    prices = spark.createDataFrame([("H", day(n - 100), 100.0 + n) for n in range(200)], "ticker string, dt date, close double")
    buys = ranking.kept(deals(spark, [(k, "H", k % 500, k % 20, 0) for k in range(4000)] + [(4000, "H", 1, 90, 0)]))
    before = written(spark)
    got = {(r.fingerprint, r.days) for r in signals.lone_sweep(signals.context(buys, prices), [0.5], [14, 60]).collect()}
    assert got == {(4000, 14), (4000, 60)} and written(spark) - before < 20 * 4000


def test_lone_rows_meet_none_in_near_groups(spark, shuffled):
    rows = ranking.kept(spark.range(4000).selectExpr("id AS fingerprint", "id % 40 AS director", "date_add(DATE'2020-01-01', CAST(10 * (id DIV 40) AS INT)) AS dt", "100D AS value"))
    before = written(spark)
    found = near_groups(rows).agg(F.count_if("stays").alias("n"), F.count_if(F.col("group_key") == F.col("fingerprint")).alias("own")).first()
    assert tuple(found) == (4000, 4000) and written(spark) - before < 5 * 4000
