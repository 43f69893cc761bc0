"""Sweeps, samples, verdicts, challenger weights, sources and stream jobs on small hand-made tables."""

import datetime as dt
import random
import statistics

import pytest
from pyspark.sql import functions as F

from tidemark.operators import checks, clean, extract, signals, stats, writes
from tidemark.operators import timeseries as ts
from tidemark.sources import files
from tidemark.streaming import jobs

DAY = dt.date(2024, 1, 1)
DEAL = "fingerprint long, ticker string, director long, dt date, announced date, role string, type string, buy_strictness string, shares long, value double"


def day(n):
    return DAY + dt.timedelta(days=n)


def deal(fp, director=1, at=0, ticker="X", role="Chief Executive Officer", value=150_000.0):
    return (fp, ticker, director, day(at), day(at), role, "BUY", "STRICT_BUY", 100, value)


def test_challenger(spark):
    rng = random.Random(1)
    rows = [(k, a := rng.random(), rng.random(), a / 10 + rng.gauss(0, 0.005)) for k in range(400)]
    frame = spark.createDataFrame(rows, "k int, a double, b double, net double")
    champion = {"a": 0.1, "b": 0.9}
    got = {r.factor: r for r in stats.challenger(frame.where("k < 240"), frame.where("k >= 240"), "net", champion).collect()}
    assert all(r.proposed and r.n_test == 160 and r.challenger_rank > r.champion_rank for r in got.values())
    assert got["a"].champion == 0.1 and got["a"].challenger > got["b"].challenger and sum(r.challenger for r in got.values()) == pytest.approx(1)
    few = stats.challenger(frame.where("k < 240"), frame.where("k >= 390"), "net", champion).collect()
    assert len(few) == 2 and not any(r.proposed for r in few)
    good = stats.challenger(frame.where("k < 240"), frame.where("k >= 240"), "net", {"a": 0.9, "b": 0.1}).collect()
    assert not any(r.proposed for r in good)  # no better than the champion
    assert stats.challenger(frame.limit(0), frame, "net", champion).count() == 0


def test_sweeps(spark):
    prices = spark.createDataFrame([(t, day(n), 100.0 + n) for t in "XY" for n in range(120)], "ticker string, dt date, close double")
    rows = [deal(1, at=90, value=210_000.0), deal(2, 2, 110, value=90_000.0), deal(3, 1, 100, "Y", value=85_000.0), deal(4, 3, 119, role="Company Secretary", value=9_000.0)]
    ctx = signals.context(spark.createDataFrame(rows, DEAL), prices)
    got = {(r.fingerprint, r.least, r.days) for r in signals.lone_sweep(ctx, [80_000.0, 200_000.0], [14, 30]).collect()}
    # dealing 2 sees dealing 1, twenty days before, not the other way round; dealing 4 is too small for all
    assert got == {(1, 80_000.0, 14), (1, 80_000.0, 30), (1, 200_000.0, 14), (1, 200_000.0, 30), (2, 80_000.0, 14), (3, 80_000.0, 14), (3, 80_000.0, 30)}
    tiers = {(r.fingerprint, r.factor) for r in signals.tier_sweep(ctx, [0.8, 1.0, 1.2]).collect()}
    assert tiers == {(1, 0.8), (1, 1.0), (1, 1.2), (2, 0.8), (3, 0.8), (4, 0.8)}


def test_verdicts_out_of_sample(spark):
    sets = {"edge": ([0.05] * 20, [0.06, 0.05] * 20), "outlier": ([0.01] * 20, [-0.01] * 39 + [9.0]), "flip": ([-0.02] * 20, [0.4] * 40), "noise": ([0.01] * 20, [-0.01] * 40), "few": ([0.1] * 5, [0.1] * 10)}
    rows = [(s, part, v) for s, parts in sets.items() for part, values in zip(("train", "test"), parts) for v in values] + [("edge", "test", None)]
    got = {r.s: r for r in stats.out_of_sample(spark.createDataFrame(rows, "s string, part string, net double"), "s").collect()}
    base = statistics.mean(v for _, test in sets.values() for v in test)
    assert {s: r.verdict for s, r in got.items()} == {"edge": "NOISE" if 0.055 <= base else "EDGE", "outlier": "PRELIMINARY", "flip": "PRELIMINARY", "noise": "NOISE", "few": "INSUFFICIENT-N"}
    assert got["edge"].n == 40 and got["edge"].hit_pct == 100.0 and got["edge"].median == pytest.approx(0.055) and got["edge"].vs_baseline == pytest.approx(0.055 - base)


def test_weighted_board(spark):
    rng = random.Random(5)
    rows = [(rng.choice("ab"), k, rng.choice([-0.1, 0.0, 0.2, rng.gauss(0, 1)]), rng.choice([1.0, 5.0])) for k in range(120)]
    frame = spark.createDataFrame(rows, "s string, fingerprint int, net double, w double")
    got = {(r.s, r.scheme): r for r in stats.weighted_board(frame, ["s"], "net", {"flat": F.lit(1.0), "sized": F.col("w")}).collect()}
    for (s, scheme), r in got.items():
        own = sorted((v, w if scheme == "sized" else 1.0) for t, _, v, w in rows if t == s)
        total, upto = sum(w for _, w in own), 0.0
        for v, w in own:
            upto += w
            if upto * 2 >= total:
                break
        assert r.n == len(own) and r.median == v and r.mean == pytest.approx(sum(v * w for v, w in own) / total) and r.hit_pct == pytest.approx(100 * sum(w for v, w in own if v > 0) / total)
    assert len(got) == 4


def test_winsorised_and_ranks(spark):
    rng = random.Random(6)
    frame = spark.createDataFrame([(rng.choice("ab"), float(rng.randint(0, 40)), rng.gauss(0, 1)) for _ in range(300)], "k string, x double, y double")
    ends = {r.k: r for r in frame.groupBy("k").agg(F.percentile("y", 0.01).alias("lo"), F.percentile("y", 0.99).alias("hi")).collect()}
    for r in stats.winsorised(frame, "y", ["k"]).collect():
        assert r.w == pytest.approx(min(ends[r.k].hi, max(ends[r.k].lo, r.y)))
    ranked = stats.average_ranks(frame, ["x", "y"], ["k"]).collect()
    for k in "ab":
        own = [r for r in ranked if r.k == k]
        for r in own:
            assert r.rank_x == sum(o.x < r.x for o in own) + (sum(o.x == r.x for o in own) + 1) / 2
            assert r.rank_y == sum(o.y < r.y for o in own) + (sum(o.y == r.y for o in own) + 1) / 2
    assert len(ranked) == 300


def test_strata(spark):
    frame = spark.range(1000).withColumnRenamed("id", "k")
    strata = {"any": (F.lit(True), 0.5), "even": (F.col("k") % 2 == 0, 0.3), "rare": (F.col("k") < 3, 0.2), "none": (F.lit(None).cast("boolean"), 0.1)}
    rows = checks.sample_strata(frame, strata, 40, "k").collect()
    got = {s: {r.k for r in rows if r.stratum == s} for s in strata}
    assert {s: len(v) for s, v in got.items()} == {"any": 20, "even": 12, "rare": 3, "none": 0} and all(k % 2 == 0 for k in got["even"])
    assert sorted(rows) == sorted(checks.sample_strata(frame.repartition(7), strata, 40, "k").collect())


def test_backfill(spark):
    held = spark.createDataFrame([("FULL", day(n), 1.0) for n in range(250)] + [("PART", day(n), 1.0) for n in range(0, 20, 2)], "ticker string, dt date, close double")
    fetched = spark.createDataFrame([(t, day(n), 2.0) for t in ("FULL", "PART", "NEW") for n in (5, 18, 19, 300)] + [("NEW", day(5), 2.0)], "ticker string, dt date, close double")
    new = {(r.ticker, r.dt) for r in writes.backfill(held, fetched).where("close = 2").collect()}
    assert new == {("PART", day(19)), ("PART", day(300)), *[("NEW", day(n)) for n in (5, 18, 19, 300)]}
    assert {r.ticker: r.start for r in writes.backfill_starts(held, fetched).collect()} == {"PART": day(19), "NEW": None}


def test_gate(spark):
    rows = [(1, "BUY", 1.0, 10.0, []), (2, "BUY", 0.0, 10.0, []), (3, "BUY", 1.0, None, []), (4, "GRANT", 0.0, 0.0, []), (5, None, 1.0, 1.0, []), (6, "BUY", 1.0, 1.0, ["multiple_prices"]), (7, "BUY", 1.0, 1.0, ["foreign_currency"]), (8, "SELL", 1.0, 1.0, None)]
    ingested, pending = extract.gate(spark.createDataFrame(rows, "k int, kind string, price double, value double, warnings array<string>"))
    assert {r.k for r in ingested.collect()} == {1, 4, 6, 8} and {r.k for r in pending.collect()} == {2, 3, 5, 7}


def test_class_comes_before_title(spark):
    rows = [("T1", "Non-Executive Director", "ceo_cfo"), (" t3 ", "Executive", "ned"), ("T3", "Chief Executive", "ceo_cfo"), ("T2", "NED", "ned"), ("T2", "Adviser", "other_exec"), (None, "Group COO", "other_exec"), ("X", None, None)]
    frame = spark.createDataFrame(rows, "c string, role string, want string")
    assert all(r.g == r.want for r in frame.select("want", clean.role_group(F.col("role"), F.col("c")).alias("g")).collect())


def test_sheets_and_logs(spark, tmp_path):
    head = "Position Holder,Name of Share Issuer,ISIN,Net Short Position (%),Position Date\n"
    for name, line in (("Current Disclosures 10.06.2026.csv", "A,X,GB1,0.5,2026-06-01"), ("Historic Disclosures 10.06.2026.csv", "A,X,GB1,0.0,2020-06-01"), ("Read me.csv", "B,Y,GB2,9,2020-01-01")):
        (tmp_path / name).write_text(head + line + "\n")
    got = {(r.holder, r.net_short_pct, str(r.position_date), r.sheet) for r in files.disclosure_sheets(spark, str(tmp_path)).collect()}
    assert got == {("A", 0.5, "2026-06-01", "current"), ("A", 0.0, "2020-06-01", "historic")}
    log = tmp_path / "log.jsonl"
    log.write_text("".join(f'{{"k": {k}}}\n' if k % 3 else f"broken {k}\n\n" for k in range(50)))
    rows = files.log_tail(spark, str(log), "k long", 5).orderBy("place").collect()
    assert [(r.place, r.k, r._raw) for r in rows] == [(1, 49, None), (2, None, "broken 48"), (3, 47, None), (4, 46, None), (5, None, "broken 45")]


@pytest.mark.parametrize("n", [1, 3, 5, 8, 30])
def test_of_a_day_broken_lines_come_last(spark, tmp_path, n):
    log = [(d, f'{{"k": {k}}}' if k % 3 else f"broken {k}") for d, k in zip([1] * 6 + [2] * 1 + [3] * 7, range(14))]
    for i in (0, 1):
        (tmp_path / f"part-{i}").write_text("".join(f"2024-01-0{d} {line}\n" for d, line in log[7 * i : 7 * i + 7]) + "\n")
    want = sorted(((-d, line.startswith("b"), 14 - i, line) for i, (d, line) in enumerate(log)))[:n]
    rows = files.log_tail_by_day(spark, str(tmp_path), "k long", "k", n).collect()
    assert [(r.place, r._raw or f'{{"k": {r.k}}}') for r in rows] == [w[2:] for w in want]


def test_markers(spark):
    prices = spark.createDataFrame([("X", day(1), 1.0), ("X", day(2), 2.0)], "ticker string, dt date, close double")
    out = ts.with_markers(prices, spark.createDataFrame([deal(2, at=1), deal(1, at=1), deal(3, at=5)], DEAL), ["fingerprint", "type"]).orderBy("dt").collect()
    assert [[(m.fingerprint, m.type) for m in r.markers] for r in out] == [[(1, "BUY"), (2, "BUY")], []]


def test_stream_jobs(spark, tmp_path):
    at = lambda d, h=0: dt.datetime(2024, 1, d, h)
    rows = [(1, 26, "purchase", at(1), 5.0), (2, 26, "purchase", at(1, 3), 7.0), (3, 1, "purchase", at(2), 1.0), (4, 1, "sale", at(2), 2.0), (5, 51, "purchase", at(20), 1.0), (6, 1, "view", at(3), 0.0)]
    spark.createDataFrame(rows, "event_id long, user_id long, event_type string, ts timestamp, value double").write.parquet(str(tmp_path / "e"))
    stream = lambda: jobs.file_stream(spark, str(tmp_path / "e"))
    days = jobs.by_month(jobs.run_available(jobs.daily_activity(stream()), "update", ["start", "type"], "d"))
    assert {(r.type, r.n, r.total) for r in days.collect()} == {("BUY", 4, 14.0), ("SELL", 1, 2.0)}
    first = jobs.run_available(jobs.first_time_events(stream()), "append", ["director", "ticker"], "f")
    assert {(r.director, r.ticker, r.first_ts) for r in first.collect()} == {(26, "Brand#2", at(1)), (1, "Brand#2", at(2)), (51, "Brand#2", at(20))}
    sessions = jobs.run_available(jobs.buyer_sessions(stream(), "10 days"), "complete", ["start", "ticker"], "s")
    assert {(r.n, tuple(r.directors)) for r in sessions.collect()} == {(3, (1, 26)), (1, (51,))}
    counts = {r.start: r.n_buyers for r in jobs.sliding_counts(jobs.run_available(jobs.buying_days(stream()), "update", ["day", "ticker", "director"], "b"), 15).collect()}
    assert counts[dt.date(2023, 12, 31)] == 2 and counts[dt.date(2024, 1, 2)] == 1 and counts[dt.date(2024, 1, 20)] == 1 and dt.date(2024, 1, 4) not in counts
    assert counts[dt.date(2024, 1, 6)] == 1
