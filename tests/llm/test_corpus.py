"""Corpus operators against brute force on small tables, with nulls, ties, repeats, long texts and clashing columns."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

pytest.importorskip("tidemark.llm")

from pyspark.sql import functions as F  # noqa: E402

from tidemark.llm import exact_dedup, line_dedup, mixing, packing, pii, quality, repeats, simhash, token_counts  # noqa: E402
from tidemark.llm.ann import nearest  # noqa: E402
from tidemark.llm.components import components  # noqa: E402
from tidemark.llm.queries import tokenizer_path  # noqa: E402

RNG = random.Random(11)
WORDS = ["".join(RNG.choice("abcdefghijklmno") for _ in range(RNG.randint(1, 9))) for _ in range(800)]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, kept boolean, k long, score double, loc_x string"


def prose(n):
    return " ".join(RNG.choice(WORDS) for _ in range(n))


def table(spark, texts, ids=None, sources=None):
    rows = [(ids[i] if ids else i, t, None, sources[i] if sources else None, None, None, None, None, "x") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA)


BASE = prose(60)
ODD = [None, "", " ", BASE, BASE, BASE.upper(), "é 日本 😀 " * 40, "a" * 5000, "x\ty\x0bz\n", prose(3000), "one", prose(80)]


@pytest.fixture(scope="module")
def odd(spark):
    ids = [*range(len(ODD) - 2), None, 3]
    return table(spark, ODD, ids)


def test_exact_dedup(spark, odd):
    for digits in (64, 1):  # one hex digit: digests collide and full texts decide
        rows = exact_dedup.exact_dedup(odd, digest_hex=digits, trigger={"maxFilesPerTrigger": "1"}).collect()
        assert len(rows) == len(ODD)
        groups = {}
        for r in rows:
            groups.setdefault(r.text_sha256, []).append(r)
        assert Counter(len(g) for g in groups.values()) == Counter(Counter((t or "") for t in ODD).values())
        for g in groups.values():
            assert sum(r.kept for r in g) == 1 and {r.group_size for r in g} == {len(g)}
            ids = [r.doc_id for r in g if r.doc_id is not None]
            assert {r.keep_id for r in g} == {max(ids) if ids else None}


def test_exact_dedup_of_nothing_and_of_repeats(spark):
    assert exact_dedup.exact_dedup(table(spark, [])).count() == 0
    twice = table(spark, ["same", "same"], [7, 7])
    assert [r.kept for r in exact_dedup.exact_dedup(twice).orderBy("kept").collect()] == [False, True]
    assert exact_dedup.drop_copies(twice).columns == twice.columns and exact_dedup.drop_copies(twice).count() == 1


def test_token_counts(spark, odd):
    import sentencepiece

    path = tokenizer_path("piece_bpe_32k.model")
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    want = sorted((len((t or "").encode()), len(model.encode(t or ""))) for t in ODD)
    # small chunks and overlaps: splices are widened, and a run without any is done whole
    for huge, overlap in ((65536, 256), (200, 8)):
        rows = token_counts.token_counts(odd, path, huge_chars=huge, overlap_chars=overlap).collect()
        assert sorted((r.n_bytes, r.n_tokens) for r in rows) == want
    assert token_counts.token_counts(table(spark, []), path).count() == 0


def test_texts_without_a_boundary_are_widened_to_the_whole(spark):
    import sentencepiece

    path = tokenizer_path("piece_bpe_32k.model")
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    texts = ["e" * 3000, "ab" * 2000, " " * 1500, "日本語" * 700, "x" + " é" * 900]
    rows = {r.doc_id: r.n_tokens for r in token_counts.token_counts(table(spark, texts), path, huge_chars=100, overlap_chars=1).collect()}
    assert rows == {i: len(model.encode(t)) for i, t in enumerate(texts)}


@pytest.mark.parametrize("step, overlap", [(5, 1), (5, 7), (100, 3), (1, 200)])
def test_chunks_cover_a_text(step, overlap):
    text = "".join(RNG.choice("abc") for _ in range(103))
    chunks = list(token_counts.cut(text, step, overlap))
    assert "".join(t[a:b] for t, a, b, _, _ in chunks) == text
    assert [last for *_, last in chunks] == [False] * (len(chunks) - 1) + [True]
    assert all(whole == text.endswith(t) or not whole for t, _, _, whole, _ in chunks)


def test_mixing(spark):
    texts = [prose(RNG.randint(0, 40)) for _ in range(900)] + [None, ""]
    sources = [RNG.choice(["a", "b", "b", "b", "c", None]) for _ in texts]
    docs = table(spark, texts, sources=sources)
    rows = mixing.mix_sources(docs, [3.0, 1.0, 2.0]).collect()
    assert len(rows) == len(texts) and Counter(rows) == Counter(mixing.mix_sources(docs, [3.0, 1.0, 2.0]).collect())
    size = {}
    for r in rows:
        assert r.taken <= 2 * r.size
        size[r.source] = size.get(r.source, 0) + r.size
    # water-filling by repeated redistribution
    order = sorted((s for s in size if s), key=lambda s: s.encode()) + ([None] if None in size else [])
    weight = {s: [3, 1, 2][i % 3] for i, s in enumerate(order)}
    total, full, target = 1.5 * sum(size.values()), set(), {}
    while True:
        level = (total - sum(2 * size[s] for s in full)) / sum(weight[s] for s in order if s not in full)
        target = {s: 2 * size[s] if s in full else level * weight[s] for s in order}
        over = {s for s in order if s not in full and target[s] > 2 * size[s]}
        if not over:
            break
        full |= over
    for s in order:
        mine = [r for r in rows if r.source == s]
        assert mine[0].target == pytest.approx(target[s])
        assert abs(sum(r.taken for r in mine) - target[s]) <= max(r.size for r in mine)
    assert mixing.mix_sources(table(spark, []), [1.0]).count() == 0
    assert mixing.take_mix(docs, [3.0, 1.0, 2.0]).count() == sum(r.repeats for r in rows)
    clash = docs.withColumns({"repeats": F.lit("x"), "size": F.lit(1), "bucket": F.lit(2), "target": F.lit(3)})
    assert mixing.take_mix(clash, [3.0, 1.0, 2.0]).columns == clash.columns
    assert mixing.take_mix(clash, [3.0, 1.0, 2.0]).count() == sum(r.repeats for r in rows)


def test_ties_of_a_mix_do_not_depend_on_partitions(spark, tmp_path):
    """Rows of one identifier, or none, and one size: the same texts are taken however they are dealt out."""
    texts = [f"{k:04d} same size" for k in range(60)]
    for name, ids in (("same", [5] * 60), ("none", [None] * 60)):
        table(spark, texts, ids=ids).coalesce(1).write.parquet(f"{tmp_path}/{name}")
        taken = []
        for parts in (4, 1, 7):
            spark.conf.set("spark.sql.shuffle.partitions", parts)
            taken.append(Counter(r.text for r in mixing.take_mix(spark.read.parquet(f"{tmp_path}/{name}"), [1.0], share=0.5).collect()))
        spark.conf.set("spark.sql.shuffle.partitions", 4)
        assert taken[0] == taken[1] == taken[2] and 25 <= sum(taken[0].values()) <= 35


PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def luhn(digits):
    return sum((d := int(c) * (1 + i % 2)) - 9 * (d > 9) for i, c in enumerate(reversed(digits))) % 10 == 0


def base_spans(text):
    def valid(kind, m):
        digits = re.sub("[^0-9]", "", m)
        return {"ip": lambda: all(int(p) <= 255 for p in m.split(".")), "card": lambda: 16 <= len(digits) <= 19 and luhn(digits), "phone": lambda: 8 <= len(digits) <= 15}.get(kind, lambda: True)()

    return [(k, m.start(), m.end()) for k, p in PATTERNS.items() for m in re.finditer(p, text) if valid(k, m.group())]


def test_personal_data(spark):
    texts = [None, "", "a.b@c.de x@y", "1.2.3.4 300.1.1.1 1.2.3.4.5", "4111 1111 1111 1111, 4111-1111-1111-1112", "+1 (606) 555-7814 +12", "a@b.c@d.e_f@g.hi", "😀 q@r.st", "1" * 3000, "+" * 50]
    texts += ["".join(RNG.choice("0123456789.@+ -()aé") for _ in range(RNG.randint(1, 60))) for _ in range(600)]
    rows = {r.doc_id: r for r in pii.find_personal_data(table(spark, [*texts, "a" * 20000 + "@"])).collect()}
    for i, t in enumerate(texts):
        assert [tuple(s) for s in rows[i].base] == base_spans(t or ""), t
        taken = sorted([(s.start, s.end) for s in rows[i].added])
        assert all(a[1] <= b[0] for a, b in zip(taken, taken[1:]))
        assert not any(x < e and s < y for _, s, e in base_spans(t or "") for x, y in taken)
    assert rows[len(texts)].base == []
    nothing = pii.find_personal_data(table(spark, [])).collect()
    assert nothing == []


def test_boosted_proposals_add_what_base_patterns_miss(spark):
    rng = random.Random(3)
    number = lambda passes: next(n for n in ("".join(rng.choice("0123456789") for _ in range(16)) for _ in range(10**6)) if luhn(n) == passes)
    grouped = lambda n, by: by.join(n[k : k + 4] for k in range(0, 16, 4))
    key = lambda: f"{rng.getrandbits(160):040x}"
    texts, want, never = [], {}, set()
    for i in range(420):
        kind = i % 7
        word = rng.choice(["token", "clave", "jeton", "Schlüssel", "x"])
        inner = [
            f"{number(True)}", f"{number(False)}", f'{word} = "{key()}"', f"part {rng.randint(1, 999)} of {rng.randint(1, 99)}.{rng.randint(0, 9)} kg", f"see {key()} there",
            grouped(number(True), ". ") if i % 2 else grouped(number(True), " "), grouped(number(False), ". ") if i % 2 else grouped(number(False), "-"),
        ][kind]
        before, after = prose(6), prose(6)
        at = len(before) + 1
        if kind in (2, 4):  # a secret is found with any word before it, or none
            at += inner.index('"') + 1 if kind == 2 else 4
            want[i] = [("secret", at, at + 40)]
        if kind == 5 and i % 2:
            want[i] = [("card_like", at, at + 22)]
        if kind in (1, 3, 6):
            never.add(i)
        texts.append(f"{before} {inner} {after}")
    rows = {r.doc_id: [tuple(s) for s in r.added] for r in pii.find_personal_data(table(spark, texts)).collect()}
    got = {i: s for i, s in rows.items() if s}
    assert not never & set(got)  # numbers that fail their check, and quantities, are left alone
    assert {i: (texts[i], s, want.get(i)) for i, s in got.items() if s != want.get(i)} == {}
    assert len(got) >= 0.95 * len(want)


def test_a_long_text_of_numbers_takes_time_in_proportion(spark):
    text = " ".join(f"+1 (606) 555-{RNG.randint(0, 9999):04d}," for _ in range(30_000))
    found = pii.find_personal_data(table(spark, [text, None])).where("doc_id = 0").first().base
    assert [tuple(s) for s in found] == base_spans(text)


def test_redaction(spark):
    row = spark.createDataFrame([("call q@r.st now, or 1.2.3.4", [("email", 5, 11), ("ip", 20, 27)])], "t string, s array<struct<kind:string,start:long,end:long>>")
    assert row.select(pii.redact(F.col("t"), F.col("s")).alias("o")).first().o == "call [redacted] now, or [redacted]"
    assert row.select(pii.redact(F.col("t"), F.slice("s", 1, 0)).alias("o")).first().o == "call q@r.st now, or 1.2.3.4"


def test_fingerprint_bit_by_bit():
    import xxhash

    for text in [prose(50), prose(400), "one", "One  TWO", "", " ", "É ß 日本 x", "a b c d"]:
        words = [w for w in re.split("[\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m.group().lower(), text)) if w]
        shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
        hashes = [xxhash.xxh64_intdigest(x.encode(), 42) for x in shingles]
        want = sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)) if hashes else 0
        assert simhash.fingerprint(text, 3, 42) == want


def test_simhash_links(spark):
    base = [RNG.getrandbits(64) for _ in range(30)]
    fps = set(base)
    for b in base[:12]:  # chains and clouds around some of them
        for _ in range(12):
            b ^= 1 << RNG.randrange(64)
            b ^= (1 << RNG.randrange(64)) * RNG.randint(0, 1)
            fps.add(b)
    fps = sorted(fps)
    frame = spark.createDataFrame([(int(np.uint64(f).astype(np.int64)),) for f in fps], "fp long")
    parent = {f: f for f in fps}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, f in enumerate(fps):
        for g in fps[:i]:
            if (f ^ g).bit_count() <= 2:
                parent[find(f)] = find(g)
    want = {}
    for f in fps:
        want.setdefault(find(f), set()).add(f)
    for cap in (64, 0):  # with no bucket expanded, code words alone must hold every link
        path = simhash.work_dir(spark, "test")
        roots = components(simhash.links(frame, 2, path, bucket_cap=cap), path + "-c").collect()
        got = {}
        for r in roots:
            got.setdefault(r.root, set()).add(r.u & (2**64 - 1))
        assert sorted(map(sorted, got.values())) == sorted(sorted(g) for g in want.values() if len(g) > 1)


def test_thresholds_hold_the_pigeonhole_principle():
    costs = [np.random.default_rng(k).random((50, 4)) for k in range(3)]
    for c in costs:
        c[:, 0] = 0
    t = simhash.allocate(costs, 3)
    assert (t.sum(axis=1) == 3 - 3).all() and (t >= -1).all()
    best = min(sum(costs[i][0, x] for i, x in enumerate((a, b, 3 - a - b))) for a in range(4) for b in range(4 - a))
    assert sum(costs[i][0, t[0, i] + 1] for i in range(3)) == pytest.approx(best)


def test_near_duplicates_of_odd_rows(spark, odd):
    rows = simhash.near_duplicates(odd, words=3, max_bits=2).collect()
    assert len(rows) == len(ODD)
    assert sum(r.fp == 0 for r in rows) == 3
    assert {r.component_id for r in rows if r.fp == 0} == {0}
    assert simhash.near_duplicates(table(spark, []), words=3, max_bits=2).count() == 0


def test_similar_groups(spark):
    long = prose(400).split()
    edited = long[:]
    edited[200] = "changed"
    texts = [" ".join(long), " ".join(edited), prose(300), None, "", " ".join(long[:200])]
    rows = {r.doc_id: r.component_id for r in simhash.similar_groups(table(spark, texts)).collect()}
    assert rows == {0: 0, 1: 0, 2: 2, 3: 3, 4: 4, 5: 5}
    assert simhash.one_of_each_group(table(spark, texts)).count() == 5
    assert simhash.similar_groups(table(spark, [])).count() == 0


def test_one_of_each_group_with_null_and_repeated_ids(spark):
    many = [prose(100) for _ in range(7)]
    texts = [*many, many[0].upper(), many[3].upper(), many[5].upper(), None, ""]
    ids = [None, None, None, 4, 4, 4, 9, 2, None, 3, None, None]
    kept = [(r.doc_id, r.text) for r in simhash.one_of_each_group(table(spark, texts, ids)).collect()]
    wanted = [(2, texts[7]), (None, texts[1]), (None, texts[2]), (4, texts[3]), (4, texts[4]), (3, texts[9]), (9, texts[6]), (None, None), (None, "")]
    assert Counter(kept) == Counter(wanted)


def _roots(nodes, edges):
    root = {n: n for n in nodes}
    for _ in nodes:
        before = dict(root)
        for a, b in edges:
            root[a] = root[b] = min(root[a], root[b])
        if root == before:
            return root
    return root


@pytest.mark.parametrize("kinds, bucket, block, dense, pairs", [(1, 1, 16, 4, 64), (3, 16, 24, 0, 1)])
def test_crowded_buckets_hold_all_their_links(spark, monkeypatch, kinds, bucket, block, dense, pairs):
    for name, value in {"PAIR_BUCKET": bucket, "BLOCK": block, "DENSE": dense, "ROUND_PAIRS": pairs}.items():
        monkeypatch.setattr(simhash, name, value)
    rng = random.Random(5)

    def edited(words, n):
        words = words[:]
        for at in rng.sample(range(len(words)), n):
            words[at] = rng.choice(WORDS)
        return words

    texts = []
    for _ in range(25):  # lone pairs
        texts += [one := prose(120).split(), edited(one, 2)]
    chain = prose(150).split()
    for _ in range(25):  # a chain: neighbours are similar, its ends are not
        texts.append(chain := edited(chain, 2))
    middle = prose(200).split()
    texts += [edited(middle, rng.randint(1, 5)) for _ in range(40)]  # many pairs just above and below the limit
    texts = [" ".join(t) for t in texts] + [" ".join(middle), " ".join(middle).upper()] + [prose(90) for _ in range(20)]
    rng.shuffle(texts)
    rows = simhash.located(table(spark, texts)).select(F.col("doc_id").alias("id"), *simhash.LOCATOR, "text")
    work = simhash.work_dir(spark, "test")
    values = F.transform(F.slice("parts", 1, 2 if kinds < 1 << 16 else 40), lambda v: v % kinds)  # few values: each bucket is crowded
    wide = simhash.stored(simhash._wide(rows, 5).withColumn("k", F.monotonically_increasing_id()).withColumn("parts", values), f"{work}/wide")
    at = {r.k: r for r in wide.collect()}
    sets = {k: set(simhash.shingle_hashes(texts[r.id], 5).tolist()) for k, r in at.items()}

    def asked(x, y):
        bits = sum(bin((x[p] ^ y[p]) & (1 << 64) - 1).count("1") for p in ("p1", "p2"))
        return bits <= 33 and any(v == w for v, w in zip(x.parts, y.parts))

    edges = [(a, b) for a in at for b in at if a < b and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]) and asked(at[a], at[b])]
    assert len(edges) > 100
    got = {r.u: r.root for r in simhash._linked(wide, rows, 5, 0.8, work).collect()}
    assert {k: got.get(k, k) for k in at} == _roots(at, edges)


def test_packing(spark, odd):
    path = tokenizer_path("byte_bpe_50k.json")
    encoder = packing.Encoder(path)
    rows = packing.pack(table(spark, ODD), path).collect()
    ids = {i: np.frombuffer(encoder.whole(t or "") + b"\0\0\0\0", "<u4") for i, t in enumerate(ODD)}
    docs, sequences = {}, {}
    for r in rows:
        docs.setdefault(r.doc_id, []).append(r)
        sequences.setdefault(r.sequence_id, []).append(r)
    assert set(docs) == set(ids)
    for i, pieces in docs.items():
        pieces.sort(key=lambda r: r.start)
        assert [r.start for r in pieces] == list(np.cumsum([0, *[r.length for r in pieces]])[:-1]) and sum(r.length for r in pieces) == len(ids[i])
        for r in pieces:
            assert r.doc_tokens == len(ids[i]) and r.length > 0
            assert r.ids_crc32 == zlib.crc32(ids[i][r.start : r.start + r.length].tobytes())
    for s in sequences.values():
        s.sort(key=lambda r: r.offset)
        assert [r.offset for r in s] == list(np.cumsum([0, *[r.length for r in s]])[:-1]) and sum(r.length for r in s) <= 1024
    assert packing.pack(odd, path).count() == len(rows)
    assert packing.pack(table(spark, []), path).count() == 0


def test_units_give_the_ids_of_whole_texts():
    encoder = packing.Encoder(tokenizer_path("byte_bpe_50k.json"))
    parts = ["a", "the", "é", "ß", ".", ",", "\n", " ", "1", "'s", "ation", "  ", "\t", "日", "😀", "\xa0", "ing", ".\n", "<|endoftext|>"]
    for _ in range(3000):
        text = "".join(RNG.choice(parts) for _ in range(RNG.randint(0, 25)))
        assert encoder.encode(text) == encoder.whole(text)


def test_cuts_are_cheapest():
    """Against every choice of cuts."""
    rng, window = random.Random(2), 8

    def tail(rest):
        pieces = bin(rest).count("1")
        return 0 if pieces <= 1 else min(packing._padding(rest, window), (pieces - 1) * packing.CUT_COST)

    def price(chosen, cost, end):
        total, at = 0.0, 0
        for c in chosen:
            if c - at > window:
                return float("inf")
            total, at = total + window - (c - at) + cost[c], c
        return total + tail(end - at) if end - at <= window else float("inf")

    for _ in range(200):
        places, at = [], 0
        while len(places) < 9:
            places.append(at := at + rng.randint(1, window))
        end = at + rng.randint(1, window)
        cost = {p: rng.choice([0.0, 2.0, 6.0]) for p in places}
        cuts = packing.window_cuts(places, [cost[p] for p in places], end, window)
        assert cuts[-1] == end and all(0 < b - a <= window for a, b in zip([0, *cuts], cuts))
        least = min(price([p for i, p in enumerate(places) if mask >> i & 1], cost, end) for mask in range(1 << len(places)))
        # the first cuts are places, the others make up the tail
        got = min(price(cuts[:n], cost, end) for n in range(len(cuts)) if all(c in cost for c in cuts[:n]))
        assert got == least


def test_repeats_against_brute_force(spark):
    shared = prose(80)
    texts = [f"{prose(RNG.randint(3, 40))} {shared[RNG.randint(0, 60) : len(shared) - RNG.randint(0, 60)]} {prose(RNG.randint(3, 40))}" for _ in range(60)]
    texts += ["a" * 900, "ab" * 300, "é" * 300, None, "", texts[0], "x" * 199, "y" * 200, "y" * 201]
    data = [(t or "").encode() for t in texts]
    seen = Counter(b[x : x + 200] for b in data for x in range(len(b) - 199))
    for cap in (64, 1):  # with a cap of one, windows are counted by hash
        rows = {r.doc_id: r for r in repeats.remove_repeats(table(spark, texts), group_cap=cap).collect()}
        for i, b in enumerate(data):
            gone = np.zeros(len(b) + 1, bool)
            for x in range(len(b) - 199):
                if seen[b[x : x + 200]] > 1:
                    gone[x : x + 200] = True
            runs = int((np.diff(np.concatenate(([0], gone.astype(int)))) == 1).sum())
            left = bytes(np.frombuffer(b, np.uint8)[~gone[: len(b)]])
            assert (rows[i].n_bytes, rows[i].n_removed, rows[i].n_spans, rows[i].kept_sha256) == (len(b), int(gone.sum()), runs, hashlib.sha256(left).hexdigest())
    assert repeats.remove_repeats(table(spark, [])).count() == 0


def test_quality_on_held_out_rows(spark):
    good = [" ".join(RNG.choice(WORDS[:400]) for _ in range(60)) for _ in range(300)]
    bad = [" ".join(RNG.choice(WORDS[400:]) for _ in range(60)) for _ in range(300)]
    docs = table(spark, [*good, *bad, None, ""])
    labels = spark.createDataFrame([(i, int(i < 300)) for i in range(600)] + [(None, 1), (601, None)], "doc_id long, quality int")
    weights, _ = quality.train(quality.labelled_rows(docs, labels, "quality"))
    rows = quality.score(docs, weights).withColumn("held_out", quality.held_out()).collect()
    assert len(rows) == 602 and all(0 <= r.score <= 1 for r in rows)
    held = [r for r in rows if r.held_out and r.doc_id < 600]
    assert {zlib.crc32(str(r.doc_id).encode()) % 4 for r in held} == {2}
    assert np.mean([(r.score >= 0.5) == (r.doc_id < 300) for r in held]) > 0.95
    none, share = quality.train(quality.labelled_rows(docs, labels.where("quality = 1"), "quality"))
    assert share == 1 and not none.any()
    assert quality.keep_good(docs, weights).columns == docs.columns


def test_scores_against_a_plain_version(spark):
    bits = 18

    def plain(text):
        words = (text or "").lower().split()
        hashes = [zlib.crc32(w.encode()) for w in words]
        slots = Counter((h * 0x9E3779B97F4A7C15 % 2**64) >> (64 - bits) for h in hashes)
        slots.update((((a * 31 + b) * 0x9E3779B97F4A7C15 + 1) % 2**64) >> (64 - bits) for a, b in zip(hashes, hashes[1:]))
        norm = sum(np.log1p(n) ** 2 for n in slots.values()) ** 0.5
        return {i: np.log1p(n) / norm for i, n in slots.items()}

    # the update rule, one coordinate at a time
    model, z, n = quality.Ftrl(bits, 2.0, 1.0, 0.05, 0.01), {}, {}

    def weight(i):
        return 0.0 if abs(z.get(i, 0)) <= 0.05 else -(z[i] - np.sign(z[i]) * 0.05) / ((1.0 + n[i] ** 0.5) / 2.0 + 0.01)

    for _ in range(40):
        x, label = plain(prose(12)), RNG.randint(0, 1)
        index = np.array(sorted(x))
        model.learn(index, np.array([x[i] for i in index]), label)
        p = 1 / (1 + np.exp(-sum(weight(i) * v for i, v in x.items())))
        for i, v in x.items():
            g, w, old = (p - label) * v, weight(i), n.get(i, 0.0)
            z[i] = z.get(i, 0.0) + g - ((old + g * g) ** 0.5 - old**0.5) / 2.0 * w
            n[i] = old + g * g
    weights = model.weights()
    assert all(weights[i] == pytest.approx(weight(i)) for i in z) and np.count_nonzero(weights) <= len(z)
    weights[-1] = 0.25
    texts = [prose(30), prose(5), None, "", "one two one two"]
    for r in quality.score(table(spark, texts), weights, bits).collect():
        x = plain(texts[r.doc_id])
        assert r.score == pytest.approx(1 / (1 + np.exp(-sum(weights[i] * v for i, v in x.items()) - 0.25)))


def test_quality_with_labels_of_one_kind(spark):
    from corpus_pipeline import quality_stage

    docs = table(spark, [prose(20), "", None, prose(5)])
    folder = quality.work_dir(spark, "one-kind")
    for label, kept in ((1, 4), (0, 0), (None, 0)):
        spark.createDataFrame([(i, label) for i in range(4)], "doc_id long, quality int").write.parquet(f"{folder}-{label}/labels.parquet")
        assert quality_stage(spark, docs, f"{folder}-{label}").count() == kept
        weights = quality.scoring_weights(quality.labelled_rows(docs, spark.read.parquet(f"{folder}-{label}/labels.parquet"), "quality"))
        share = 0.5 if label is None else label
        assert all(abs(r.score - share) < 2e-6 for r in quality.score(docs, weights).collect())


def test_nearest(spark):
    rng = np.random.default_rng(3)
    x = rng.standard_normal((600, 16))
    rows = [(i, v.tolist(), "e") for i, v in enumerate(x)] + [(600 + i, x[0].tolist(), "e") for i in range(80)]
    rows += [(900, None, "e"), (901, [0.0] * 16, "e"), (902, [float("nan")] * 16, "e"), (903, [1.0] * 3, "e"), (904, [1.0, None] * 8, "e")]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>, score string")
    got = nearest(frame, frame.where("vec_id % 20 = 0"), k=10).collect()
    vectors = {i: np.array(v) for i, v, _ in rows[:680]}
    ids = np.array(sorted(vectors))
    matrix = np.stack([vectors[i] for i in ids])
    hits = total = 0
    by = {}
    for r in got:
        by.setdefault(r.query_id, []).append(r)
    assert set(by) == {i for i in vectors if i % 20 == 0}
    for q, found in by.items():
        s = matrix @ vectors[q]
        order = [i for i in ids[np.lexsort((ids, -s))] if i != q][:10]
        found.sort(key=lambda r: r.rank)
        assert [r.rank for r in found] == list(range(1, 11)) and q not in [r.vec_id for r in found]
        assert all(r.score == pytest.approx(float(vectors[r.vec_id] @ vectors[q])) for r in found)
        hits, total = hits + len(set(order) & {r.vec_id for r in found}), total + 10
    assert hits / total >= 0.9
    tied = [r.vec_id for r in by[0] if r.score == by[0][0].score]
    assert tied == sorted(tied)
    assert nearest(frame.limit(0), frame.limit(0)).count() == 0


@pytest.mark.parametrize("norms", ["one long", "lognormal", "huge"])
def test_nearest_with_unequal_norms(spark, norms):
    rng = np.random.default_rng(4)
    x = rng.standard_normal((500, 24))
    if norms == "one long":
        x[7] *= 50
    elif norms == "lognormal":
        x *= rng.lognormal(0, 0.7, 500)[:, None]
    else:
        x *= 1e100
    frame = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = {}
    for r in nearest(frame, frame.where("vec_id % 20 = 0"), k=10, max_cells=300).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    hits = 0
    for q in range(0, 500, 20):
        s = x @ x[q]
        s[q] = -np.inf
        hits += len(set(np.argsort(-s)[:10].tolist()) & got[q])
    assert hits >= 0.9 * 250


def test_vectors_of_one_identifier_are_candidates_of_their_own(spark):
    rng = np.random.default_rng(6)
    rows = [(i, rng.standard_normal(8).tolist()) for i in range(60)]
    near = rows[0][1]
    rows += [(500, [x * 0.99 for x in near]), (500, [x * 0.98 for x in near]), (500, [-x for x in near]), (0, [x * 0.97 for x in near])]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = [(r.vec_id, r.score) for r in nearest(frame, frame.where("vec_id = 20").union(frame.where("vec_id = 500").limit(0)).union(spark.createDataFrame([(1000, near)], "vec_id long, embedding array<double>")), k=6).where("query_id = 1000").orderBy("rank").collect()]
    want = sorted(((-sum(a * b for a, b in zip(near, v)), i) for i, v in rows))[:6]
    assert [i for i, _ in got] == [i for _, i in want] and [s for _, s in got] == pytest.approx([-s for s, _ in want])
    assert [i for i, _ in got].count(500) == 2


def test_line_dedup(spark):
    page = lambda *lines: "<html><style>x</style><body>" + "".join(f"<p>{x}</p>" for x in lines) + "</body>"
    rows = [(i, "http://a.example/p", page("menu", f"text {i}", "menu"), "x") for i in range(4)]
    rows += [(10, "https://b.example", page("menu", "own"), "x"), (11, None, None, "x"), (12, "no url", "plain<br>line", "x"), (0, "http://A.example/q", page("rare"), "x"), (13, "http://b.example", "", "x")]
    out = line_dedup.drop_boilerplate(spark.createDataFrame(rows, "page_id long, url string, html string, host string")).collect()
    kept = sorted((r.page_id, r.host, r.kept) for r in out)
    want = [(i, "a.example", [f"text {i}"]) for i in range(4)] + [(0, "a.example", ["rare"]), (10, "b.example", ["menu", "own"]), (11, "", []), (12, "", ["plain", "line"]), (13, "b.example", [])]
    assert kept == sorted(want)
    assert line_dedup.drop_boilerplate(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_line_dedup_deals_out_hot_hosts(spark, monkeypatch):
    monkeypatch.setattr(line_dedup, "SALTS", 4)
    rows = [(i, f"http://{'hot' if i % 3 else f'h{i % 7}'}.example/{i}", f"<p>menu</p><p>{i % 20}</p><p>own {i}</p>") for i in range(90)]
    rows += [(None, "http://hot.example", "<p>menu</p>")] * 9
    out = line_dedup.drop_boilerplate(spark.createDataFrame(rows, "page_id long, url string, html string"), ratio=0.5).collect()
    lines = lambda html: re.findall("<p>(.*?)</p>", html)
    pages, seen = Counter(), Counter()
    for _, url, html in rows:
        host = url.split("/")[2]
        pages[host] += 1
        seen.update((host, x) for x in set(lines(html)))
    want = Counter()
    for i, url, html in rows:
        host = url.split("/")[2]
        want[i, tuple(x for x in lines(html) if not (seen[host, x] >= 3 and seen[host, x] > 0.5 * pages[host]))] += 1
    assert Counter((r.page_id, tuple(r.kept)) for r in out) == want
