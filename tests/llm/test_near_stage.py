"""The near-duplicate stage on short texts, hot shingles and wide partitions against brute force."""

import random

import numpy as np
import pytest

pytest.importorskip("tidemark.llm")

from pyspark.sql import functions as F  # noqa: E402

from tidemark.llm import simhash  # noqa: E402

RNG = random.Random(4)
WORDS = ["".join(RNG.choice("abcdefghijklmno") for _ in range(RNG.randint(2, 8))) for _ in range(3000)]


def prose(n):
    return [RNG.choice(WORDS) for _ in range(n)]


def groups(texts, least=0.8):
    sets = [set(simhash.shingle_hashes(t or "", 5).tolist()) for t in texts]
    root = list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and len(a & sets[j]) >= least * len(a | sets[j]):
                root[find(i)] = find(j)
    return {frozenset(i for i in range(len(texts)) if find(i) == r) for r in map(find, range(len(texts)))}


def found(spark, texts):
    rows = simhash.similar_groups(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    out = {}
    for r in rows:
        out.setdefault(r.component_id, set()).add(r.doc_id)
    return {frozenset(g) for g in out.values()}


@pytest.mark.parametrize("bucket,block", [(16, 512), (1, 8)])
def test_short_texts_are_joined_exactly(spark, monkeypatch, bucket, block):
    monkeypatch.setattr(simhash, "PAIR_BUCKET", bucket)
    monkeypatch.setattr(simhash, "BLOCK", block)
    texts = [None, "", "one", "one", "a b c d"]
    for n in range(5, 26):
        for _ in range(8):
            base = prose(n)
            other = base + prose(1) if RNG.random() < 0.7 else base[1:] if n > 5 else base
            texts += [" ".join(base), " ".join(other)]
    line = prose(12)  # a line that many short texts have, with ends of their own: some alike, most not
    texts += [" ".join(line + prose(RNG.randint(0, 6))) for _ in range(60)] + [" ".join(line[:k]) for k in range(5, 13)]
    assert found(spark, texts) == groups(texts)


def test_partitions_get_wider_with_the_rows():
    assert simhash.width(0) == simhash.width(1 << 20) == (simhash.WIDE_PARTS, simhash.PART_BITS)
    before = (0, 0)
    for k in range(10, 44):
        parts, bits = simhash.width(1 << k)
        assert (1 << k) / (1 << bits) <= 16 and 1 - (1 - simhash.AGREE**bits) ** parts >= 0.95 and (parts, bits) >= before
        before = (parts, bits)


def test_wide_partitions_find_the_same_pairs(spark, monkeypatch):
    texts = []
    for n in (40, 80, 200):
        for _ in range(40):
            base = prose(n)
            edit = list(base)
            for _ in range(max(1, n // 80)):
                edit[RNG.randrange(n)] = RNG.choice(WORDS)
            texts += [" ".join(base), " ".join(edit)]
    want = {g for g in groups(texts) if len(g) > 1}
    shares = []
    for n in (1000, 1 << 24):  # as if there were so many rows
        monkeypatch.setattr(simhash, "width", lambda _, n=n, real=simhash.__dict__["width"]: real(n))
        got = {g for g in found(spark, texts) if len(g) > 1}
        monkeypatch.undo()
        assert got <= want
        shares.append(len(got) / len(want))
    assert min(shares) >= 0.9


def test_prefix_of_rare_shingles_keeps_hot_buckets_small(spark):
    hot = prose(9)
    texts = [" ".join(hot + prose(12)) for _ in range(400)]
    rows = simhash.located(spark.createDataFrame(list(enumerate(texts)), "id long, text string"))
    wide = simhash._wide(rows, 5).withColumn("k", F.monotonically_increasing_id())
    work = simhash.work_dir(spark, "test")
    assert simhash._short_links(wide, 0.8, work).count() == 0
    assert spark.read.parquet(f"{work}/short").count() == 0  # the shingles of the hot line are in no prefix


def test_wide_partitions_are_generalised_pigeonholes(spark):
    line = prose(60)  # shared in full by half the texts, so that many partitions are crowded
    texts = ["", *(" ".join((line if n % 2 else []) + prose(RNG.randint(5, 60))) for n in range(600))]
    texts += [f"{t} changed" for t in texts if len(t.split()) > 80]
    parts, bits = simhash.width(len(texts))
    rows = simhash.located(spark.createDataFrame(list(enumerate(texts)), "id long, text string"))
    prints = simhash.stored(simhash._wide(rows, 5).withColumn("k", F.col("id")), simhash.work_dir(spark, "prints"))
    order = simhash.correlated_order(prints, parts, bits)
    assert sorted(order) == list(range(parts * bits))
    given = {r.k: np.array(r.parts, np.int64) for r in prints.collect() if r.parts}
    keys, values = np.array(list(given)), np.array(list(given.values()))
    flags = simhash._flags(values, bits)
    bond = np.abs(np.corrcoef(flags.T.astype(float)))
    inside = lambda places: np.mean([bond[np.ix_(p, p)].mean() for p in np.split(places, parts)])
    assert inside(order) > inside(np.arange(parts * bits))
    holes = {r.k: [tuple(h) for h in r.holes] for r in simhash._allotted(prints, parts, bits).collect()}
    assert holes[0] == [] and set(holes) == {*given, 0}
    held, asked, skipped, further = {}, {}, 0, 0
    for k, some in holes.items():
        held[k] = {h[:2] for h in some if h[2] & simhash.HOLDS}
        asked[k] = {h[:2] for h in some if h[2] & simhash.ASKS}
        if k in given:
            assert len(held[k]) == parts and {p for p, _ in held[k]} == set(range(parts))
            none, wide = parts - len({p for p, _ in asked[k]}), sum(len([h for h in asked[k] if h[0] == p]) > 1 for p in range(parts))
            assert none == wide and len(asked[k]) == parts - none + wide * bits
            skipped, further = skipped + none, further + wide
    assert skipped == further > 0
    near = 0
    for i in range(len(keys)):
        for j in np.flatnonzero((flags[i] != flags).sum(axis=1) < parts):
            if i != j:
                near += 1
                assert asked[keys[i]] & held[keys[j]]
    assert near > 100


def test_large_groups_of_near_copies_are_not_dealt_out_by_bucket(spark, monkeypatch):
    dealt, real = [], simhash._in_blocks

    def counted(values, sizes, *rest):
        dealt.append(values.join(sizes, ["part", "value"]).count())
        return real(values, sizes, *rest)

    monkeypatch.setattr(simhash, "_in_blocks", counted)
    monkeypatch.setattr(simhash, "BLOCK", 64)
    rng, base = random.Random(9), prose(200)

    def edited(words, n):
        words = words[:]
        for at in rng.sample(range(len(words)), n):
            words[at] = rng.choice(WORDS)
        return " ".join(words)

    texts = [edited(base, rng.randint(1, 3)) for _ in range(300)]  # one large group
    texts += [edited(base[:165] + prose(35), rng.randint(0, 2)) for _ in range(12)]  # too far from most of it
    other = base[:170] + prose(30)
    texts += [edited(other, rng.randint(1, 3)) for _ in range(40)] + [" ".join(prose(60)) for _ in range(20)]  # a second group, and texts apart
    rng.shuffle(texts)
    assert found(spark, texts) == groups(texts)
    assert sum(dealt) <= 10 * len(texts)  # by bucket: each text in some forty of them, in each round


def test_crossing_between_sides_is_that_of_all_without_pairs_on_one_side():
    rng = np.random.default_rng(2)
    p = rng.integers(0, 4, (60, 2)).astype(np.uint64)
    group, side = np.arange(60) // 3, rng.random(60) < 0.4
    i, j, _ = simhash.crossing(p, group, 2, 10**6)
    keep = side[i] != side[j]
    x, y, _ = simhash.crossing(p, group, 2, 10**6, side)
    assert set(zip(x.tolist(), y.tolist())) == set(zip(i[keep].tolist(), j[keep].tolist())) and len(x)
