"""Removal of repeated passages: every byte covered by a ``length``-byte string that also starts elsewhere.

Sorting all suffixes by external induced sorting carries a tuple of some twenty
bytes for every byte of text, dozens of times the disk that the checks allow, so
this operator works on sampled suffixes instead (the README has figures).

Each window of ``length`` bytes is represented by its anchor, the place of its
least hashed ``gram``-byte string. Equal windows have equal anchors at equal
distance, and the windows of one anchor are consecutive, a range. So:

1. Anchors are grouped by their string. One that occurs once cannot hold a
   repeated window. Where all ranges of a group are equal, all their windows are
   repeated, and so are those of a range that occurs twice. Strings and ranges
   are told apart by 64 bits of hash each, so a false match needs 128 bits.
2. Only ranges that share an anchor string with different ranges are compared
   byte by byte, one of each kind: common bytes before and after the anchor give
   the distances at which windows agree. Groups of more than ``group_cap``
   different ranges are compared by counting window hashes instead, so no group
   needs to fit in a task.

Only texts that hold such anchors travel; a Bloom filter of bounded size keeps
the others where they are.

Defined results: null text counts as empty; texts shorter than ``length`` lose
nothing; repeated rows are documents of their own, so each loses all if long
enough; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import BLOOM_CONF, LOCATOR, configured, located, stored, whole_text, work_dir

_GRAM = 64  # a power of two
_SEGMENT = 1 << 19
_PLACE = np.uint64((1 << 20) - 1)
_TABLE = np.random.default_rng(1).integers(0, 2**64, 256, dtype=np.uint64)


def _gram_hashes(data: np.ndarray) -> np.ndarray:
    """A hash of the _GRAM bytes from each place on."""
    h, size, factor = _TABLE[data], 1, 0x9E3779B97F4A7C15
    while size < _GRAM:
        h = h[:-size] * np.uint64(factor) + h[size:]
        size, factor = size * 2, factor * factor & 0xFFFFFFFFFFFFFFFF
    h ^= h >> np.uint64(29)
    return h * np.uint64(0xBF58476D1CE4E5B9)


def anchor_ranges(data: bytes, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First and last window start of each range, and the place of its anchor."""
    lows, highs, places = [], [], []
    for base in range(0, len(data) - length + 1, _SEGMENT):
        part = np.frombuffer(data, np.uint8)[base : base + _SEGMENT + length - 1]
        hashes = _gram_hashes(part)
        least = (hashes & ~_PLACE) | np.arange(len(hashes), dtype=np.uint64)
        size, want = 1, length - _GRAM + 1
        while size * 2 <= want:
            least, size = np.minimum(least[:-size], least[size:]), size * 2
        if want > size:
            least = np.minimum(least[: size - want], least[want - size :])
        at = (least & _PLACE).astype(np.int64)
        low = np.concatenate(([0], np.flatnonzero(np.diff(at)) + 1))
        lows.append(low + base)
        highs.append(np.concatenate((low[1:] - 1, [len(at) - 1])) + base)
        places.append(at[low] + base)
    if not lows:
        return (np.empty(0, np.int64),) * 3
    return np.concatenate(lows), np.concatenate(highs), np.concatenate(places)


def _lists(parts: list[np.ndarray], kind: pa.DataType) -> pa.Array:
    ends = np.concatenate(([0], np.cumsum([len(p) for p in parts])))
    flat = np.concatenate(parts) if parts else np.empty(0, np.int64)
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat, kind))


def _anchors(rows: DataFrame, length: int) -> DataFrame:
    """One row per text: id, LOCATOR, n_bytes, sha and arrays low, high, place, a (anchor hash), r (range hash)."""
    import xxhash

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest = xxhash.xxh3_64_intdigest
        for batch in batches:
            sizes, shas, arrays = [], [], ([], [], [], [], [])
            for text in batch.column("text").to_pylist():
                data = text.encode("utf-8", "surrogatepass")
                sizes.append(len(data))
                shas.append(hashlib.sha256(data).hexdigest())
                low, high, place = anchor_ranges(data, length)
                spots = place.tolist()
                a = np.fromiter((digest(data[p : p + _GRAM]) for p in spots), np.uint64, len(spots))
                each = zip(low.tolist(), high.tolist(), spots)
                r = np.fromiter((digest(data[x : y + length], p - x) for x, y, p in each), np.uint64, len(spots))
                for into, part in zip(arrays, (low, high, place, a.view(np.int64), r.view(np.int64))):
                    into.append(part)
            kinds = (pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in ("id", *LOCATOR)), pa.array(sizes, pa.int64()), pa.array(shas), *map(_lists, arrays, kinds)],
                ["id", *LOCATOR, "n_bytes", "sha", "low", "high", "place", "a", "r"],
            )

    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(
        run,
        f"id {kind}, {LOCATOR[0]} string, {LOCATOR[1]} long, n_bytes long, sha string, "
        "low array<int>, high array<int>, place array<int>, a array<long>, r array<long>",
    )


def cut(data: bytes, starts: list[tuple[int, int]], length: int) -> tuple[int, int, str]:
    """Bytes removed, runs removed, and the sha256 of what is left, given ranges of repeated window starts."""
    removed = runs = 0
    left, at = hashlib.sha256(), 0
    end = -1
    for low, high in sorted(starts):
        high += length
        if low > end:
            if end >= 0:
                removed, runs = removed + end - begin, runs + 1  # noqa: F821
                left.update(data[at:begin])  # noqa: F821
                at = end
            begin, end = low, high
        else:
            end = max(end, high)
    if end >= 0:
        removed, runs = removed + end - begin, runs + 1
        left.update(data[at:begin])
        at = end
    left.update(data[at:])
    return removed, runs, left.hexdigest()


def _common(a: np.ndarray, b: np.ndarray) -> int:
    n = min(len(a), len(b))
    differ = np.flatnonzero(a[:n] != b[:n])
    return int(differ[0]) if len(differ) else n


def shared_windows(group: list[tuple[bytes, int]], length: int) -> list[list[tuple[int, int]]]:
    """For each (bytes, anchor's offset), the ranges of its windows that another member has at the same distance."""
    out: list[list[tuple[int, int]]] = [[] for _ in group]
    if len(group) <= 6:
        parts = [np.frombuffer(c, np.uint8) for c, _ in group]
        for i in range(len(group)):
            for j in range(i):
                (ca, ba), (cb, bb) = group[i], group[j]
                before = _common(parts[i][:ba][::-1], parts[j][:bb][::-1])
                after = _common(parts[i][ba:], parts[j][bb:])
                nearest = max(length - after, ba - (len(ca) - length), bb - (len(cb) - length))
                if nearest <= before:  # windows start between these distances before the anchor
                    out[i].append((ba - before, ba - nearest))
                    out[j].append((bb - before, bb - nearest))
        return out
    seen: dict[tuple[int, bytes], int] = {}
    for context, back in group:
        for x in range(len(context) - length + 1):
            key = (back - x, context[x : x + length])
            seen[key] = seen.get(key, 0) + 1
    for i, (context, back) in enumerate(group):
        out[i] = [(x, x) for x in range(len(context) - length + 1) if seen[back - x, context[x : x + length]] > 1]
    return out


_WINDOWS = "array<struct<low:int,high:int>>"


def _compare_groups(contexts: DataFrame, length: int) -> DataFrame:
    """Rows (k, windows) for single ranges; contexts of one anchor string are neighbours in the stream."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict] = []

        def flush() -> tuple[list, list]:
            keys, found = [], []
            for row, windows in zip(held, shared_windows([(h["context"], h["back"]) for h in held], length)):
                if row["single"] and windows:
                    keys.append(row["k"])
                    found.append([{"low": row["low"] + x, "high": row["low"] + y} for x, y in windows])
            held.clear()
            return keys, found

        kind = pa.list_(pa.struct([("low", pa.int32()), ("high", pa.int32())]))
        for batch in batches:
            keys, found = [], []
            for row in batch.to_pylist():
                if held and held[0]["a"] != row["a"]:
                    k, f = flush()
                    keys, found = keys + k, found + f
                held.append(row)
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(found, kind)], ["k", "windows"])
        if held:
            keys, found = flush()
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(found, kind)], ["k", "windows"])

    return contexts.repartition("a").sortWithinPartitions("a").mapInArrow(run, f"k long, windows {_WINDOWS}")


_BLOCK = 8


def _blocks(row: dict, length: int) -> list[tuple[int, int, int]]:
    """(number, first, last window) of the aligned blocks of _BLOCK distances that the context holds whole."""
    back, n = row["back"], len(row["context"]) - length + 1
    low = back - n + 1  # the least distance
    numbers = range(-(-low // _BLOCK), (back + 1) // _BLOCK)
    return [(j, back - j * _BLOCK - _BLOCK + 1, back - j * _BLOCK) for j in numbers]


def _count_windows(contexts: DataFrame, length: int) -> DataFrame:
    """Rows (k, windows) for single ranges of crowded groups, by counting hashes.

    First whole blocks of windows are counted; what is left, the windows of one
    block of each repeated kind, and those in no block or in one that is not
    repeated, is counted window by window. Hashes have 128 bits.
    """
    import xxhash

    def key(row: dict, first: int, last: int, tag: int) -> bytes:
        data = row["context"][first : last + length]
        return xxhash.xxh3_128_digest(data, (row["a"] ^ ((row["back"] - last) * 2 + tag)) & 0xFFFFFFFFFFFFFFFF)

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [
                (key(r, x, y, 1), r["k"], r["low"], j, r["low"] + x, r["low"] + y, r["single"])
                for r in batch.to_pylist()
                for j, x, y in _blocks(r, length)
            ]
            w, *rest = zip(*out) if out else [()] * 7
            kinds = [pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.bool_()]
            yield pa.RecordBatch.from_arrays([pa.array(w, pa.binary()), *map(pa.array, rest, kinds)], ["w", "k", "low", "j", "x", "y", "single"])

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                known = set(r["known"] or ())
                skip = {x for j, first, last in _blocks(r, length) if j in known for x in range(first, last + 1)}
                todo = [x for x in range(len(r["context"]) - length + 1) if x not in skip]
                keys = [key(r, x, x, 0) for x in todo]
                starts = np.array(todo, np.int32) + np.int32(r["low"])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(keys, pa.binary()), pa.array(np.full(len(todo), r["k"], np.int64)), pa.array(starts), pa.array(np.full(len(todo), r["single"], bool))],
                    ["w", "k", "low", "single"],
                )

    whole = contexts.mapInArrow(blocks, "w binary, k long, low int, j int, x int, y int, single boolean")
    kinds = whole.groupBy("w").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("k", "low", "j")).alias("one")).where("n > 1")
    again = whole.join(kinds, "w").select("k", "low", "j", "x", "y", "single", (F.struct("k", "low", "j") == F.col("one")).alias("counts"))
    known = again.where("NOT counts").groupBy("k", "low").agg(F.collect_list("j").alias("known"))
    rows = contexts.join(known, ["k", "low"], "left").mapInArrow(windows, "w binary, k long, low int, single boolean")
    twice = rows.groupBy("w").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    found = rows.where("single").join(twice, "w").select("k", F.struct(F.col("low"), F.col("low").alias("high")).alias("s"))
    found = found.unionByName(again.where("single").select("k", F.struct(F.col("x").alias("low"), F.col("y").alias("high")).alias("s")))
    return found.groupBy("k").agg(F.collect_list("s").cast(_WINDOWS).alias("windows"))


_ITEM = "array<struct<low:int,high:int,place:int,tag:int,a:bigint>>"


def _visit(texts: DataFrame, length: int) -> DataFrame:
    """Rows of three kinds: 0 a finished text, 1 a text that waits for its single ranges, 2 a range to compare."""
    names = ["k", "kind", "n_removed", "n_spans", "kept", "data", "full", "a", "back", "low", "single", "context"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        full_type = pa.list_(pa.struct([("low", pa.int32()), ("high", pa.int32())]))
        types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.string(), pa.binary(), full_type, pa.int64(), pa.int32(), pa.int32(), pa.bool_(), pa.binary()]
        for batch in batches:
            rows = []
            for k, text, items in zip(*(batch.column(c).to_pylist() for c in ("k", "text", "items"))):
                data = text.encode("utf-8", "surrogatepass")
                singles = {i["low"] for i in items if i["tag"] == 1}
                full = [(i["low"], i["high"]) for i in items if i["tag"] == 0 and i["low"] not in singles]
                if singles:
                    rows.append((k, 1, None, None, None, data, [{"low": x, "high": y} for x, y in full], *(None,) * 5))
                else:
                    rows.append((k, 0, *cut(data, full, length), *(None,) * 7))
                for i in items:
                    if i["tag"]:
                        context = data[i["low"] : i["high"] + length]
                        rows.append((k, 2, *(None,) * 5, i["a"], i["place"] - i["low"], i["low"], i["tag"] == 1, context))
            for part in range(0, len(rows), 2000):
                columns = zip(*rows[part : part + 2000])
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names)

    return texts.mapInArrow(
        run,
        f"k long, kind int, n_removed long, n_spans long, kept string, data binary, full {_WINDOWS}, "
        "a long, back int, low int, single boolean, context binary",
    )


def _finish(waiting: DataFrame, length: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                out.append((r["k"], *cut(r["data"], [(w["low"], w["high"]) for w in r["full"] + (r["windows"] or [])], length)))
            columns = list(zip(*out)) or [[]] * 4
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], ["k", "n_removed", "n_spans", "kept"])

    return waiting.mapInArrow(run, "k long, n_removed long, n_spans long, kept string")


def remove_repeats(docs: DataFrame, length: int = 200, group_cap: int = 64, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, n_bytes, n_removed, n_spans, kept_sha256."""
    spark = docs.sparkSession
    work = work_dir(spark, "repeats")
    rows = located(docs).select(F.col(id_col).alias("id"), *LOCATOR, whole_text(text_col).alias("text"))
    anchors = stored(_anchors(rows, length).withColumn("k", F.monotonically_increasing_id()), f"{work}/anchors")
    every = anchors.select("k", F.explode(F.arrays_zip("low", "high", "place", "a", "r")).alias("e")).select("k", "e.*")
    groups = every.groupBy("a").agg(F.count(F.lit(1)).alias("n"), F.min("r").alias("r1"), F.max("r").alias("r2"))
    repeated = stored(groups.where("n > 1").select("a", "n", (F.col("r1") != F.col("r2")).alias("mixed")), f"{work}/repeated")
    with configured(spark, BLOOM_CONF):
        hits = every.join(repeated.where("n > 1"), "a")
        only = lambda c: F.when(F.col("mixed"), F.col(c)).alias(c)
        hits = stored(hits.select("k", "low", "high", only("place"), only("a"), only("r")), f"{work}/hits")
    kinds = hits.where("a IS NOT NULL").groupBy("a", "r").agg(
        F.count(F.lit(1)).alias("n"), F.min(F.struct("k", "low", "high", "place")).alias("first")
    )
    asked = kinds.select("first.*", F.when(F.col("n") == 1, 1).otherwise(2).alias("tag"), "a")
    plain = hits.select("k", "low", "high", F.lit(None).cast("int").alias("place"), F.lit(0).alias("tag"), F.lit(None).cast("long").alias("a"))
    items = plain.unionByName(asked).groupBy("k").agg(F.collect_list(F.struct("low", "high", "place", "tag", "a")).cast(_ITEM).alias("items"))
    listed = stored(
        items.join(anchors.select("k", *LOCATOR), "k").withColumn("n", F.size("items")), f"{work}/listed"
    )
    with configured(spark, BLOOM_CONF):
        texts = rows.select(*LOCATOR, "text").join(listed.where("n > 0"), list(LOCATOR)).select("k", "text", "items")
        visited = stored(_visit(texts, length), f"{work}/visited")
    contexts = visited.where("kind = 2").select("k", "a", "back", "low", "single", "context")
    crowded = stored(
        contexts.groupBy("a").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > group_cap).select("a"), f"{work}/crowded"
    )
    windows = _compare_groups(contexts.join(crowded, "a", "left_anti"), length)
    windows = windows.unionByName(_count_windows(contexts.join(crowded, "a", "left_semi"), length))
    windows = stored(windows.groupBy("k").agg(F.flatten(F.collect_list("windows")).alias("windows")), f"{work}/windows")
    waiting = visited.where("kind = 1").select("k", "data", "full").join(windows, "k", "left")
    done = visited.where("kind = 0").select("k", "n_removed", "n_spans", "kept").unionByName(_finish(waiting, length))
    out = anchors.select("k", "id", "n_bytes", "sha").join(stored(done, f"{work}/done"), "k", "left")
    return out.select(
        F.col("id").alias(id_col),
        "n_bytes",
        F.coalesce("n_removed", F.lit(0)).cast("long").alias("n_removed"),
        F.coalesce("n_spans", F.lit(0)).cast("long").alias("n_spans"),
        F.coalesce("kept", "sha").alias("kept_sha256"),
    )
