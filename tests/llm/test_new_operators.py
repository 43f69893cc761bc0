"""Fill-in-the-middle, decontamination and hard negatives against brute force, with nulls, ties, repeats, long texts and clashing columns."""

import hashlib
import random
import re

import numpy as np
import pytest

pytest.importorskip("tidemark.llm")

from pyspark.sql import functions as F  # noqa: E402

from tidemark.llm import decontaminate, fill_in_middle, hard_negatives  # noqa: E402

RNG = random.Random(5)
DOCS = "doc_id long, text string, n string, form int, output string, cut int, spans int, items int, `__x` string"


def docs(spark, texts, ids=None):
    return spark.createDataFrame([(ids[i] if ids else i, t, None, 1, None, 2, 3, 4, "x") for i, t in enumerate(texts)], DOCS)


def _fim(doc_id, text, spm=50, rate=100, unit=r"[^\n]*\n|[^\n]+"):
    text = text or ""
    units = re.findall(unit, text)
    h = hashlib.sha256(f"7:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(h[8 * k : 8 * k + 8], 16) for k in range(4)]
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= rate:
        return len(units), "plain", None, None, text
    a, b = sorted((h[0] % (len(units) + 1), h[1] % (len(units) + 1)))
    p, m, s = ("".join(x) for x in (units[:a], units[a:b], units[b:]))
    psm, spm_text = f"<P>{p}<S>{s}<M>{m}", f"<S>{s}<P>{p}<M>{m}"
    form = "spm" if h[3] % 100 < spm else "psm"
    return len(units), form, len(p), len(m), spm_text if form == "spm" else psm


@pytest.mark.parametrize("rate,spm", [(100, 50), (40, 0)])
def test_fill_in_middle(spark, rate, spm):
    lines = ["", "a", "é 日本 😀", "x" * 300, "\r", " ", "<P", "S>", "P>"]
    texts = [None, "", "\n", "\n\n\n", "no end", "with <S> inside", "<P><M>", "a\nb\n", "a\nb\n", "q\n" * 20_000, "long " * 50_000]
    texts += ["\n".join(RNG.choice(lines) for _ in range(RNG.randint(0, 12))) for _ in range(300)]
    ids = [*range(len(texts) - 3), None, 3, 3]
    got = fill_in_middle.fill_in_middle(docs(spark, texts, ids), rate=rate, spm_rate=spm)
    got = got.withColumn("back", fill_in_middle.restored(F.col("output"), F.col("form")))
    rows = sorted(map(repr, [(r.doc_id, (r.n, r.form, r.prefix_chars, r.middle_chars, r.output), r.back) for r in got.collect()]))
    assert rows == sorted(map(repr, [(i, _fim(i, t, spm, rate), t or "") for i, t in zip(ids, texts)]))


def test_fill_in_middle_of_nothing_and_of_other_units(spark):
    assert fill_in_middle.fill_in_middle(docs(spark, [])).count() == 0
    words = fill_in_middle.fill_in_middle(docs(spark, ["one two three", " lead", "x"]), unit=r"\S+\s*").collect()
    assert [(r.n, r.form == "plain") for r in sorted(words, key=lambda r: r.doc_id)] == [(3, False), (None, True), (1, False)]
    for marks in (("<P>", "<P>", "<M>"), ("", "a", "b"), ("ab", "bc", "x"), ("aba", "c", "d"), ("abc", "b", "x")):
        with pytest.raises(ValueError):
            fill_in_middle.fill_in_middle(docs(spark, []), marks=marks)


def _words(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return list(re.finditer(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low))


def _leaks(text, items, length, coverage=1.0):
    """Every window of every item is looked for at every place."""
    words = [m.group() for m in _words(text)]
    hit, found = set(), set()
    for item, body in items:
        own = [m.group() for m in _words(body)]
        wide = min(length, max(1, -int(-coverage * len(own) // 1))) if own else 0
        windows = {tuple(own[i : i + wide]) for i in range(len(own) - wide + 1)} if own else set()
        for i in range(len(words) - wide + 1 if windows else 0):
            if tuple(words[i : i + wide]) in windows:
                hit |= set(range(i, i + wide))
                found.add("" if item is None else str(item))
    return len(words), len(hit), sorted(found), hit


def _leak_case(few):
    word = lambda: RNG.choice(few)
    items = [(RNG.choice([None, *range(30)]), " ".join(word() for _ in range(RNG.choice([0, 1, 2, 3, 5, 9, 14])))) for _ in range(40)] + [(7, None), (8, "..."), (9, "Ünï Ö-日本 42"), (9, "Ünï Ö-日本 42")]
    texts = [None, "", "-", "Ünï ö 日本 42", "ÜNÏ Ö 日本 42", "ünï Ö_日本,42 x"]
    texts += ["; ".join(word().upper() if RNG.random() < 0.3 else word() for _ in range(RNG.randint(0, 60))) for _ in range(150)]
    texts += [f"{RNG.choice(items)[1] or ''} tail {RNG.choice(items)[1] or ''}" for _ in range(60)]
    return items, [*texts, texts[-1]]


@pytest.mark.parametrize("length,coverage,shard,kinds", [(4, 1.0, 200_000, 3), (4, 1.0, 40, 4), (10, 1.0, 60, 12), (6, 0.5, 50, 5)])
def test_leaks_against_brute_force(spark, length, coverage, shard, kinds):
    items, texts = _leak_case(["ab", "b2", "c", "日", "é"][: min(kinds, 5)] + [f"w{k}" for k in range(kinds - 5)])
    table = spark.createDataFrame(items, "item_id long, text string")
    rows = decontaminate.find_leaks(docs(spark, texts), table, length, coverage, shard_words=shard).collect()
    assert len(rows) == len(texts)
    for r in rows:
        n, n_hit, found, hit = _leaks(texts[r.doc_id], items, length, coverage)
        assert (r.n_words, r.n_hit, r.items) == (n, n_hit, found)
        words = _words(texts[r.doc_id])
        assert {k for s in r.spans for k in range(s.first, s.last + 1)} == hit
        assert all((s.start, s.end) == (words[s.first].start(), words[s.last].end()) for s in r.spans)


def test_leaks_are_cut_out(spark, monkeypatch):
    monkeypatch.setattr(decontaminate, "STEP", 64)
    passage = " ".join(f"t{k}" for k in range(12))
    items = spark.createDataFrame([("q", passage)], "item_id string, text string")
    long = " ".join(f"w{k % 50}" for k in range(5000))
    texts = [f"é {long}. {passage.upper()}! {long}", passage, f"x {passage}", None, long, f"{passage[:-4]} {long}"]
    table = docs(spark, texts)
    rows = {r.doc_id: r for r in decontaminate.remove_leaks(table, items, max_share=0.5).collect()}
    assert decontaminate.remove_leaks(table, items).columns == table.columns
    assert {i: r.text for i, r in rows.items()} == {0: f"é {long}. ! {long}", 3: None, 4: long, 5: f" {long}"}
    assert decontaminate.remove_leaks(table, items.limit(0)).count() == 6
    assert decontaminate.find_leaks(docs(spark, []), items).count() == 0


def test_long_items_are_cut_into_pieces(spark):
    words = [f"v{k}" for k in range(3000)]
    items = spark.createDataFrame([("long", " ".join(words)), ("rep", "a " * 500)], "item_id string, text string")
    texts = [" ".join(words[k : k + 10]) for k in range(0, 2990, 23)] + [" ".join(words[k : k + 9]) for k in range(0, 500, 50)] + ["a " * 9, "a " * 10, "a " * 200]
    rows = decontaminate.find_leaks(docs(spark, texts), items, shard_words=500).collect()
    for r in rows:
        n = len(texts[r.doc_id].split())
        assert (r.n_words, r.n_hit) == (n, n if n >= 10 else 0)


def _mined(rows, positives=5, negatives=10, low=30, high=90):
    rows = [(i, lab, [int(np.floor(256.0 * float(np.float32(x)))) for x in v]) for i, lab, v in rows if i is not None and lab is not None and v is not None and len(v) and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for i, lab, v in rows:
        if i % 100:
            continue
        scored = [(-sum(a * b for a, b in zip(v, w)), j, other) for j, other, w in rows if j != i]
        for s, j, _ in sorted((x for x in scored if x[2] == lab), key=lambda x: x[:2])[:positives]:
            band = sorted((x[:2] for x in scored if x[2] != lab and low * -s <= 100 * -x[0] <= high * -s))[:negatives]
            out += [(i, j, k + 1, n, -s, -m) for k, (m, n) in enumerate(band)]
    return sorted(out)


def vectors(spark, rows):
    return spark.createDataFrame([(i, [float(x) if x is not None else None for x in v] if v is not None else None, lab, 1, "x") for i, lab, v in rows], "vec_id long, embedding array<float>, label int, score int, a string")


@pytest.mark.parametrize("dims,spread,anchor_bytes", [(16, 1.0, 8 << 20), (64, 0.3, 1500), (100, 5.0, 4000)])
def test_hard_negatives_against_brute_force(spark, dims, spread, anchor_bytes):
    rng = np.random.default_rng(dims)
    middles = rng.standard_normal((4, dims))
    ids = [*range(0, 900), *range(1000, 1600, 100)]
    rows = [(i, int(k), spread * middles[k] + rng.standard_normal(dims)) for i in ids for k in [rng.integers(0, 4)]]
    rows += [(5000 + i, 3, rows[0][2]) for i in range(40)] + [(6000 + i, 1, rows[0][2] * 0.6) for i in range(40)]  # ties
    rows += [(7000, 2, np.zeros(dims)), (7001, None, rows[1][2]), (7002, 1, None), (7003, 1, [None] * dims), (7004, 1, [float("nan")] * dims), (7005, 1, [float("inf")] * dims), (None, 1, rows[3][2]), (7100, 99, rows[4][2]), (7200, 1, [])]
    table = vectors(spark, rows)
    got = hard_negatives.hard_negatives(table.repartition(5), F.col("vec_id") % 100 == 0, anchor_bytes=anchor_bytes).collect()
    assert sorted(tuple(r[c] for c in ("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")) for r in got) == _mined(rows)


def test_hard_negatives_of_odd_tables(spark):
    anchor = F.col("vec_id") % 100 == 0
    assert hard_negatives.hard_negatives(vectors(spark, []), anchor).count() == 0
    assert hard_negatives.hard_negatives(vectors(spark, [(1, 1, [1.0, 2.0]), (2, 2, [1.0, 2.0])]), anchor).count() == 0
    # huge components are clipped, other lengths take no part, an anchor's copies are not its partners
    rows = [(100, 1, [3e38, 1.0]), (100, 1, [3e38, 1.0]), (1, 1, [3e38, 3e38]), (2, 2, [1e30, 0.0]), (3, 2, [1.0]), (4, 2, [2e6, 5.0])]
    got = hard_negatives.hard_negatives(vectors(spark, rows), anchor).collect()
    assert len(got) == 2 and {(r.anchor_id, r.positive_id, r.negative_id) for r in got} == {(100, 1, 4)}


def test_intervals_hold_and_leave_rows_out():
    rng = np.random.default_rng(3)
    v = np.floor(256 * rng.standard_normal((3000, 64)) / 8).astype(np.int64)
    coder = hard_negatives.Coder(64, 4, 8, 1)
    codes, gains, rests = coder.encode(v)
    q = v[0]
    parts, estimate, off, exact = coder.query(q), 0, 0, v @ q
    norm, left = np.sqrt(float(q @ q)), []
    for k, part in enumerate(parts):
        product = coder.products(codes.view(np.uint64)[:, k : k + 1], part)
        estimate, off = estimate + gains[:, k] * product, off + gains[:, k] * part[-1]
        along = np.maximum(0, np.abs(product) - part[-1])
        half = np.sqrt(np.maximum(0, norm**2 - along**2)) * rests[:, k] + off + 1e-4
        assert (np.abs(exact - estimate) <= half).all()
        left.append(int((estimate + half >= np.sort(exact)[-20]).sum()))
    assert left[-1] < 0.2 * len(v) and left == sorted(left, reverse=True)
