"""Edits, upserts, restartable ingest and groups of near dealings on small tables."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from tidemark.operators import groups, writes
from tidemark.streaming import jobs, tables

DAY = dt.date(2024, 1, 1)


def rows(df, *columns):
    return sorted(tuple(r[c] for c in columns) for r in df.collect())


def test_edits_of_one_key_are_folded_in_order_of_time(spark):
    table = spark.createDataFrame([("a", 1, "x"), ("b", 2, "y"), ("c", 3, "z"), ("d", 4, None)], "k string, v int, w string")
    edits = spark.createDataFrame(
        [("a", "update", 10, None, ["v"], 2), ("a", "update", 5, "q", ["v", "w"], 1), ("b", "reject", None, None, [], 1), ("b", "update", 9, None, ["v"], 2), ("c", "update", None, None, ["w"], 1),
         ("e", "add", 7, "n", ["v", "w"], 1), ("e", "update", 8, None, ["v"], 2), ("d", "reject", None, None, [], 1), ("d", "add", 6, "again", ["v", "w"], 3), ("zz", "update", 1, None, ["v"], 1)],
        "k string, action string, v int, w string, given array<string>, at int",
    )
    assert rows(writes.apply_edits(table, edits, "k", "at"), "k", "v", "w") == [("a", 10, "q"), ("c", 3, None), ("d", 6, "again"), ("e", 8, "n")]
    # without times and given fields: fields that are not null are given
    plain = spark.createDataFrame([("a", "update", None, "new"), ("b", "reject", None, None)], "k string, action string, v int, w string")
    assert rows(writes.apply_edits(table, plain, "k"), "k", "v", "w") == [("a", 1, "new"), ("c", 3, "z"), ("d", 4, None)]
    assert rows(writes.apply_edits(table, plain.limit(0), "k"), "k") == rows(table, "k")


def test_an_edit_may_change_the_key(spark):
    table = spark.createDataFrame([("x-1", "x", 1), ("x-2", "x", 2), ("y-5", "y", 5)], "k string, name string, n int")
    edits = spark.createDataFrame([("x-1", "update", None, 2, 1), ("y-5", "update", "z", None, 1)], "k string, action string, name string, n int, at int")
    out = writes.apply_edits(table, edits, "k", "at", rekey=lambda name, n: F.concat_ws("-", name, n))
    assert rows(out, "k", "name", "n") == [("x-2", "x", 2), ("z-5", "z", 5)]


def test_only_touched_parts_are_derived_anew(spark):
    before = spark.createDataFrame([(1, "A", 10), (2, "A", 20), (3, "B", 30), (4, "C", None)], "k int, ticker string, v int")
    after = spark.createDataFrame([(1, "A", 10), (2, "A", 21), (3, "B", 30), (4, "C", None), (5, "D", 1)], "k int, ticker string, v int")
    held = spark.createDataFrame([(k, t, "old") for k, t in [(1, "A"), (2, "A"), (3, "B"), (4, "C")]], "k int, ticker string, s string")
    out = writes.refresh_dependents(before, after, held, "k", "ticker", lambda df: df.select("k", "ticker", F.lit("new").alias("s")))
    assert rows(out, "k", "s") == [(1, "new"), (2, "new"), (3, "old"), (4, "old"), (5, "new")]


def test_a_batch_that_stops_anywhere_is_run_again(spark, tmp_path, monkeypatch):
    target, frame = str(tmp_path / "t"), spark.createDataFrame([(k, f"v{k}") for k in range(20)], "k int, v string")
    assert tables.parted_table(spark, target) is None
    writes.upsert_into(frame, 0, target, "k", "2024-01-01", parts=4)
    whole = rows(tables.parted_table(spark, target), "k", "seen_count")
    real = tables._files

    def broken(session, path):
        if "_commits/1" in path:
            raise OSError("lost before the commit")
        return real(session, path)

    monkeypatch.setattr(tables, "_files", broken)
    with pytest.raises(OSError):
        writes.upsert_into(frame.where("k < 3"), 1, target, "k", "2024-02-01", parts=4)
    monkeypatch.setattr(tables, "_files", real)
    assert rows(tables.parted_table(spark, target), "k", "seen_count") == whole  # readers see the last whole batch
    for _ in range(2):
        touched = writes.upsert_into(frame.where("k < 3"), 1, target, "k", "2024-02-01", parts=4)
    assert touched == []  # committed already
    got = {r.k: (r.seen_count, str(r.first_seen), str(r.last_seen)) for r in tables.parted_table(spark, target).collect()}
    assert all(got[k] == ((2, "2024-01-01", "2024-02-01") if k < 3 else (1, "2024-01-01", "2024-01-01")) for k in range(20))
    assert all(len(ks) == 1 for ks in tables.versions(spark, target, 1).values())  # older versions of rewritten parts are gone


def test_ingest_goes_on_where_it_stopped(spark, tmp_path):
    at = lambda day, hour=0: dt.datetime(2024, 3, day, hour)
    batches = [
        [(1, "a", at(1)), (2, "a", at(2)), (1, "a", at(1))],
        [(2, "a", at(2)), (3, "b", at(20)), (4, "c", at(12))],
        # beyond 7 days before the 20th: late, and dropped; the copy of event 3 is known
        [(5, "a", at(5)), (6, "a", at(19)), (3, "b", at(20))],
        [],
    ]
    ran = []
    real = jobs.parted_merge

    def counted(batch, number, *rest):
        ran.append(batch.count())
        return real(batch, number, *rest)

    jobs.parted_merge = counted
    try:
        for n, batch in enumerate(batches):
            spark.createDataFrame(batch, "id long, user string, ts timestamp").coalesce(1).write.mode("append").parquet(str(tmp_path / "in")) if batch else None
            stream = jobs.file_stream(spark, str(tmp_path / "in"))
            out = jobs.ingest_and_upsert(stream, ["id"], ["user"], "ts", str(tmp_path / "table"), str(tmp_path / "check"), parts=4)
            got = {r.user: r.seen_count for r in out.collect()}
            assert got == [{"a": 2}, {"a": 2, "b": 1, "c": 1}, {"a": 3, "b": 1, "c": 1}, {"a": 3, "b": 1, "c": 1}][n]
    finally:
        jobs.parted_merge = real
    assert sum(ran) == 5  # each event reached the table once


def near(a, b):
    base = a[3] if a[2] < b[2] else b[3] if b[2] < a[2] else min(a[3], b[3])
    return a[1] == b[1] and abs(a[2] - b[2]) <= 7 and abs(a[3] - b[3]) <= 0.05 * base


@pytest.mark.parametrize("seed,low,high,span", [(1, 90, 130, 60), (2, 100, 100, 400), (3, 1, 10_000, 30), (4, 95, 106, 200)])
def test_near_groups_against_union_find(spark, seed, low, high, span):
    rng = random.Random(seed)
    data = [(k, rng.choice([1, 1, 1, 2]), rng.randint(0, span), float(rng.randint(low, high))) for k in range(150)]
    parent = list(range(150))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in data:
        for b in data[: a[0]]:
            if near(a, b):
                parent[root(a[0])] = root(b[0])
    first = {}
    for k, _, n, _ in data:
        first[root(k)] = min(first.get(root(k), (10**9, 0)), (n, k))
    frame = spark.createDataFrame([(k, d, DAY + dt.timedelta(days=n), v, "x") for k, d, n, v in data], "fingerprint int, director int, dt date, value double, note string")
    got = groups.near_groups(frame).collect()
    assert {(r.fingerprint, r.group_key, r.stays) for r in got} == {(k, first[root(k)][1], first[root(k)][1] == k) for k in range(150)}


def test_near_groups_of_odd_rows_and_copies(spark):
    odd = [(1, None, DAY, 5.0), (2, 1, None, 5.0), (3, 1, DAY, None), (4, 1, DAY, 0.0), (5, 1, DAY, -3.0)] + [(k, 9, DAY, 100.0) for k in range(10, 400)]
    got = groups.near_groups(spark.createDataFrame(odd, "fingerprint int, director int, dt date, value double")).collect()
    assert len(got) == len(odd) and sum(r.stays for r in got) == 6 and {r.group_key for r in got if r.director == 9} == {10}


def test_linked_chains(spark):
    rng = random.Random(3)
    order = rng.sample(range(300), 300)
    edges = [(order[i], order[i + 1]) for i in range(299) if i % 50 != 49]
    got = {r.node: r.root for r in groups.linked(spark.createDataFrame(edges, "a int, b int")).collect()}
    assert got == {x: min(order[i // 50 * 50 : i // 50 * 50 + 50]) for i, x in enumerate(order)}
    assert groups.linked(spark.createDataFrame([], "a int, b int")).count() == 0
