"""SimHash near-duplicates by the generalised pigeonhole principle.

The 64 fingerprint bits are grouped into partitions of correlated bits
(statistics over all fingerprints). Two fingerprints that differ in at most d
bits agree, for any thresholds t_1..t_m >= -1 with sum(t_i + 1) = d + 1, in
some partition i up to t_i bits. Each fingerprint chooses its thresholds by
dynamic programming on the candidate counts that a histogram per partition
estimates, probes the index of partition values within them, and its candidates
are verified on all 64 bits.

Buckets of more than ``bucket_cap`` fingerprints are not expanded into pairs.
For the fingerprints that live in or probe such a bucket, every code word
within half of d (rounded up) is emitted: fingerprints at most d apart share
one, and those that share one halfway are at most d apart, so that a star
inside each code word's group, which is never larger than a ball of that
radius, holds every link that the buckets hold.

Defined results: null text counts as empty; a document without words has
fingerprint zero and is linked like any other; one with fewer words than a
shingle has its whole word sequence as its one shingle; null identifiers get
the component of their fingerprint, and a component of null identifiers only
has a null component_id; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import ceil, comb, log, log2

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import BLOOM_CONF, LOCATOR, configured, discard, give_back, kept_for, located, stored, whole_text, work_dir
from tidemark.llm.components import components

BITS = 64
_COARSE = 12  # bits of a partition value that the histogram tells apart


def fingerprint(text: str, words: int, seed: int = 42) -> int:
    """SimHash of the word shingles: a bit is set if it is in over half of the shingle hashes."""
    import xxhash

    tokens = text.encode("utf-8", "surrogatepass").lower().split()  # bytes: only A-Z and the six ASCII white spaces
    if not tokens:
        return 0
    shift = max(1, len(tokens) - words + 1)
    joined = b" ".join(tokens)
    lengths = np.fromiter(map(len, tokens), np.int64, len(tokens))
    ends = np.cumsum(lengths + 1) - 1
    starts = (ends - lengths)[:shift].tolist()
    stops = ends[min(words, len(tokens)) - 1 :].tolist()
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(joined[a:b], seed) for a, b in zip(starts, stops)), np.uint64, shift)
    ones = np.zeros(BITS, np.int64)
    for k in range(0, shift, 8192):
        part = hashes[k : k + 8192].astype(">u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > shift).tobytes(), "big")


def _signed(values: np.ndarray) -> pa.Array:
    return pa.array(values.view(np.int64))


def fingerprints(docs: DataFrame, words: int, seed: int = 42, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (id, fp, LOCATOR): fp holds the 64 bits as a signed long."""
    rows = located(docs).select(F.col(id_col).alias("id"), *LOCATOR, whole_text(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept_for("simhash")
        for batch in batches:
            fps = np.fromiter((fingerprint(t, words, seed) for t in batch.column("text").to_pylist()), np.uint64, batch.num_rows)
            keys = [batch.column(c) for c in ("id", *LOCATOR)]
            yield pa.RecordBatch.from_arrays([*keys, _signed(fps)], ["id", *LOCATOR, "fp"])

    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(run, f"id {kind}, {LOCATOR[0]} string, {LOCATOR[1]} long, fp long")


def _bits(fps: np.ndarray) -> np.ndarray:
    """(n, 64) of 0 and 1, lowest bit first."""
    return ((fps[:, None] >> np.arange(BITS, dtype=np.uint64)) & np.uint64(1)).astype(np.uint8)


def _fps(batch: pa.RecordBatch) -> np.ndarray:
    return batch.column("fp").to_numpy(zero_copy_only=False).view(np.uint64)


def correlated_partitions(distinct: DataFrame, n_parts: int) -> list[list[int]]:
    """Bits grouped by correlation over all fingerprints; 64 x 64 counts reach the driver, whatever the input."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((BITS, BITS), np.int64)
        for batch in batches:
            x = _bits(_fps(batch)).astype(np.float32)
            total += (x.T @ x).astype(np.int64)
        i, j = np.indices((BITS, BITS))
        yield pa.RecordBatch.from_arrays([pa.array(i.ravel()), pa.array(j.ravel()), pa.array(total.ravel())], ["i", "j", "n"])

    together = np.zeros((BITS, BITS))
    for r in distinct.select("fp").mapInArrow(run, "i long, j long, n long").groupBy("i", "j").agg(F.sum("n").alias("n")).collect():
        together[r.i, r.j] = r.n
    return _by_bond(together, max(1, distinct.count()), n_parts)


def _by_bond(together: np.ndarray, total: int, n_parts: int) -> list[list[int]]:
    """Places of bits in ``n_parts`` groups, those that go together in one; ``together`` counts rows with both bits set."""
    size = len(together)
    mean = together.diagonal() / total
    spread = np.sqrt(np.maximum(mean * (1 - mean), 1e-12))
    bond = np.abs((together / total - np.outer(mean, mean)) / np.outer(spread, spread))
    np.fill_diagonal(bond, 0)
    left, parts = set(range(size)), []
    for k in range(n_parts):
        room = len(left) // (n_parts - k)
        part = [max(left, key=lambda b: (bond[b, sorted(left)].sum(), -b))]
        left.discard(part[0])
        while len(part) < room:
            part.append(max(left, key=lambda b: (bond[b, part].sum(), -b)))
            left.discard(part[-1])
        parts.append(part)
    return parts


def _values(bits: np.ndarray, part: list[int]) -> np.ndarray:
    return bits[:, part].astype(np.int64) @ (1 << np.arange(len(part), dtype=np.int64))


def _histogram(distinct: DataFrame, parts: list[list[int]]) -> np.ndarray:
    """Fingerprints per partition and coarse value: a table of fixed size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros((len(parts), 1 << _COARSE), np.int64)
        for batch in batches:
            bits = _bits(_fps(batch))
            for k, part in enumerate(parts):
                seen[k] += np.bincount(_values(bits, part) & ((1 << _COARSE) - 1), minlength=1 << _COARSE)
        k, v = np.nonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(k), pa.array(v), pa.array(seen[k, v])], ["k", "v", "n"])

    out = np.zeros((len(parts), 1 << _COARSE))
    for r in distinct.select("fp").mapInArrow(run, "k long, v long, n long").groupBy("k", "v").agg(F.sum("n").alias("n")).collect():
        out[r.k, r.v] = r.n
    return out


def _near_masks(width: int, distance: int) -> np.ndarray:
    return np.array([sum(1 << b for b in c) for d in range(distance + 1) for c in combinations(range(width), d)], np.int64)


def allocate(costs: list[np.ndarray], budget: int) -> np.ndarray:
    """Thresholds (n, m) of least cost with sum(t + 1) = budget, by dynamic programming.

    ``costs[i][:, t + 1]`` is what threshold t costs in partition i, for each of n queries.
    """
    n = len(costs[0])
    best = np.full((n, budget + 1), np.inf)
    best[:, 0] = 0
    taken = []
    for cost in costs:
        new, took = np.full_like(best, np.inf), np.zeros((n, budget + 1), np.int64)
        for total in range(budget + 1):
            for t in range(min(total, cost.shape[1] - 1) + 1):
                now = best[:, total - t] + cost[:, t]
                better = now < new[:, total]
                new[better, total], took[better, total] = now[better], t
        best = new
        taken.append(took)
    left, out = np.full(n, budget), np.empty((n, len(costs)), np.int64)
    for i in range(len(costs) - 1, -1, -1):
        out[:, i] = taken[i][np.arange(n), left]
        left = left - out[:, i]
    return out - 1


def _entries(distinct: DataFrame, parts: list[list[int]], histogram: np.ndarray, max_bits: int) -> DataFrame:
    """Rows (part, value, fp, probe): the index (probe false) and each fingerprint's probes."""
    masks = [[_near_masks(len(p), t) for t in range(min(max_bits, len(p)) + 1)] for p in parts]
    ball = [_near_masks(min(_COARSE, len(p)), 1) for p in parts]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = _fps(batch)
            bits = _bits(fps)
            values, costs = [_values(bits, p) for p in parts], []
            for k, part in enumerate(parts):
                coarse = values[k] & ((1 << _COARSE) - 1)
                fine = max(0, len(part) - _COARSE)  # bits that a histogram cell sums over
                own = histogram[k, coarse] / 2.0**fine
                near = histogram[k][coarse[:, None] ^ ball[k][1:]].mean(axis=1) / 2.0**fine
                cost = np.zeros((len(fps), len(masks[k]) + 1))
                for t in range(len(masks[k])):
                    same = sum(comb(fine, d) for d in range(t + 1))
                    cost[:, t + 1] = len(masks[k][t]) + own * same + near * (len(masks[k][t]) - same)
                costs.append(cost)
            thresholds = allocate(costs, max_bits + 1)
            for k in range(len(parts)):
                put = [(values[k], fps, False)]
                for t in range(len(masks[k])):
                    mine = thresholds[:, k] == t
                    put.append(((values[k][mine][:, None] ^ masks[k][t]).ravel(), np.repeat(fps[mine], len(masks[k][t])), True))
                for v, f, probe in put:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(v), k, np.int32)), pa.array(v), _signed(f), pa.array(np.full(len(v), probe))],
                        ["part", "value", "fp", "probe"],
                    )

    return distinct.select("fp").mapInArrow(run, "part int, value long, fp long, probe boolean")


def _halfway_links(hot: DataFrame, max_bits: int) -> DataFrame:
    """Links (a, b) among ``hot`` (fp) that hold together all pairs at most max_bits apart."""
    radius = (max_bits + 1) // 2
    masks = np.array([sum(1 << b for b in c) for d in range(radius + 1) for c in combinations(range(BITS), d)], np.uint64)
    away = np.array([d for d in range(radius + 1) for _ in combinations(range(BITS), d)], np.int32)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = _fps(batch)
            for k in range(0, len(fps), 512):
                some = fps[k : k + 512]
                words = (some[:, None] ^ masks).ravel()
                yield pa.RecordBatch.from_arrays(
                    [_signed(words), _signed(np.repeat(some, len(masks))), pa.array(np.tile(away, len(some)))], ["word", "fp", "away"]
                )

    spread = hot.mapInArrow(run, "word long, fp long, away int")
    hub = spread.groupBy("word").agg(F.min(F.struct("away", "fp")).alias("hub"), F.count(F.lit(1)).alias("n")).where("n > 1")
    ends = spread.join(hub, "word").where(F.col("away") + F.col("hub.away") <= max_bits)
    return ends.select(F.col("hub.fp").alias("a"), F.col("fp").alias("b")).where("a <> b").distinct()


def links(distinct: DataFrame, max_bits: int, work: str, n_parts: int = 3, bucket_cap: int = 64) -> DataFrame:
    """Edges (a, b) between fingerprints; their components are those of all pairs at most max_bits apart."""
    parts = correlated_partitions(distinct, n_parts)
    entries = stored(_entries(distinct, parts, _histogram(distinct, parts), max_bits), f"{work}/entries")
    index, probes = entries.where("NOT probe").drop("probe"), entries.where("probe").drop("probe")
    crowded = stored(
        index.groupBy("part", "value").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > bucket_cap).drop("n"), f"{work}/crowded"
    )
    key = ["part", "value"]
    pairs = (
        probes.withColumnRenamed("fp", "a")
        .join(crowded, key, "left_anti")
        .join(index.withColumnRenamed("fp", "b").join(crowded, key, "left_anti"), key)
        .where("a <> b")
        .where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= max_bits)
        .select("a", "b")
    )
    hot = stored(entries.join(crowded, key, "left_semi").select("fp").distinct(), f"{work}/hot")
    return stored(pairs.unionByName(_halfway_links(hot, max_bits)), f"{work}/links")


def near_duplicates(
    docs: DataFrame, words: int = 5, max_bits: int = 3, seed: int = 42, n_parts: int = 3, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """One row per document: id, fp (signed long), component_id (smallest id reachable) and LOCATOR."""
    work = work_dir(docs.sparkSession, "simhash")
    fps = stored(fingerprints(docs, words, seed, id_col, text_col), f"{work}/fps")
    classes = stored(fps.groupBy("fp").agg(F.min("id").alias("least")), f"{work}/classes")
    reached = components(links(classes, max_bits, work, n_parts), f"{work}/components")
    rooted = classes.join(reached, classes["fp"] == reached["u"], "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    names = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    named = stored(rooted.join(names, "root").select("fp", "component_id"), f"{work}/named")
    return fps.join(named, "fp").select(F.col("id").alias(id_col), "fp", "component_id", *LOCATOR)


# --- near duplicates by similarity ----------------------------------------------

#: Partitions of the wide fingerprint and bits of each, at least. Texts of similarity 0.8 agree in a bit with chance AGREE; they share a value with chance CHANCE.
WIDE_PARTS, PART_BITS = 40, 16
AGREE, CHANCE = 0.85, 0.954
#: Partitions that share out their bits by correlation, and bits of a value that the histogram of a wide partition tells apart.
TOGETHER, WIDE_COARSE = 4, 10
#: What a text does at a value: it is found there, it looks there, or both.
HOLDS, ASKS = 1, 2
#: Texts of so many shingles or fewer are joined on the shingles themselves: too few for a fingerprint to tell.
SHORT = 24
#: Buckets up to this size give their pairs in a DataFrame expression; larger ones are compared all against all in blocks.
PAIR_BUCKET = 16
#: Members of a block of a crowded bucket, and near pairs a member from which on only a spanning forest of them is tested first.
BLOCK, DENSE = 512, 4
#: Every so many partitions, members of crowded buckets are joined into classes before all others are looked at.
CLASS_EVERY = 8
#: Near pairs that each two groups of a dense block give in the first further round; each later round gives eight times as many.
ROUND_PAIRS = 512
#: In further rounds, members of crowded buckets get a print of LONG_WORDS * 64 bits, and pairs differ in at most so many of them: those of
#: similarity 0.8 differ in 309 with deviation 16, those of 0.7 in 390. Texts of fewer shingles than SMALL differ in more bits at the same
#: similarity, so for them it is the second number.
LONG_WORDS, LONG_BITS, SMALL = 32, (364, 450), 32


def shingle_hashes(text: str, words: int, seed: int = 42) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word shingles."""
    import xxhash

    tokens = text.encode("utf-8", "surrogatepass").lower().split()
    digest = xxhash.xxh64_intdigest
    many = (digest(b" ".join(tokens[k : k + words]), seed) for k in range(max(1, len(tokens) - words + 1)))
    return np.unique(np.fromiter(many, np.uint64)) if tokens else np.empty(0, np.uint64)


def _words_of_bits(hashes: np.ndarray, n_words: int) -> np.ndarray:
    """SimHash of n_words * 64 bits as 0 and 1; each word of bits comes from a remix of the hashes."""
    ones = np.zeros((n_words, BITS), np.int64)
    for k in range(n_words):
        h = hashes ^ np.uint64((0x9E3779B97F4A7C15 * (k + 1)) & 0xFFFFFFFFFFFFFFFF)
        h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        h ^= h >> np.uint64(31)
        for at in range(0, len(h), 16384):
            ones[k] += np.unpackbits(h[at : at + 16384].view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return (2 * ones > len(hashes)).ravel()


def width(n: int) -> tuple[int, int]:
    """(partitions, bits of each) for ``n`` texts: buckets keep a mean of 16 members or fewer, whatever ``n``, and pairs their chance to meet."""
    bits = min(40, max(PART_BITS, ceil(log2(max(2, n))) - 4))
    return max(WIDE_PARTS, ceil(log(1 - CHANCE) / log(1 - AGREE**bits))), bits


def wide_fingerprint(hashes: np.ndarray, parts: int = WIDE_PARTS, bits: int = PART_BITS) -> tuple[np.ndarray, np.ndarray]:
    """SimHash of ``parts * bits`` bits, as ``parts`` numbers, and its first 128 bits."""
    flags = _words_of_bits(hashes, ceil(max(128, parts * bits) / BITS))
    return flags[: parts * bits].reshape(parts, bits) @ (1 << np.arange(bits, dtype=np.int64)), np.packbits(flags[:128]).view(np.uint64)


def _wide(rows: DataFrame, words: int, n_parts: int = WIDE_PARTS, bits: int = PART_BITS) -> DataFrame:
    """Rows (id, LOCATOR, p1, p2, parts, same, few): 128 bits of the fingerprint, its partitions' values (none without words), a digest of the shingles, the shingles if they are few."""
    import xxhash

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept_for("simhash")
        for batch in batches:
            prints, parts, same, few = np.zeros((batch.num_rows, 2), np.uint64), [], np.zeros(batch.num_rows, np.uint64), []
            for i, text in enumerate(batch.column("text")):
                hashes = shingle_hashes(text.as_py(), words)
                values = []
                if len(hashes):
                    values, prints[i] = wide_fingerprint(hashes, n_parts, bits)
                parts.append(values)
                few.append(hashes.view(np.int64) if 0 < len(hashes) <= SHORT else None)
                same[i] = xxhash.xxh64_intdigest(hashes.tobytes())
            columns = [*(batch.column(c) for c in ("id", *LOCATOR)), _signed(prints[:, 0].copy()), _signed(prints[:, 1].copy())]
            columns += [pa.array(parts, pa.list_(pa.int64())), _signed(same), pa.array(few, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, ["id", *LOCATOR, "p1", "p2", "parts", "same", "few"])

    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(run, f"id {kind}, {LOCATOR[0]} string, {LOCATOR[1]} long, p1 long, p2 long, parts array<long>, same long, few array<long>")


def _flags(values: np.ndarray, bits: int) -> np.ndarray:
    """(n, partitions * bits) of 0 and 1 from the partitions' values."""
    return ((values[:, :, None] >> np.arange(bits)) & 1).astype(np.uint8).reshape(len(values), values.shape[1] * bits)


def _part_values(batch: pa.RecordBatch, n_parts: int) -> np.ndarray:
    """(n, partitions) values of the rows that have any."""
    return batch.column("parts").flatten().to_numpy(zero_copy_only=False).reshape(-1, n_parts)


def _regrouped(values: np.ndarray, bits: int, order: np.ndarray) -> np.ndarray:
    """Values of the partitions that take the bits in ``order``."""
    flags = _flags(values, bits)[:, order].reshape(*values.shape, bits)
    return flags.astype(np.int64) @ (1 << np.arange(bits, dtype=np.int64))


def correlated_order(wide: DataFrame, n_parts: int, bits: int) -> np.ndarray:
    """The wide fingerprint's bits, correlated ones in one partition; each TOGETHER partitions in a row share out their bits anew."""
    step = TOGETHER * bits
    having = wide.where(F.size("parts") > 0).select("parts")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = [np.zeros((min(step, n_parts * bits - at),) * 2, np.int64) for at in range(0, n_parts * bits, step)]
        for batch in batches:
            flags = _flags(_part_values(batch, n_parts), bits).astype(np.float32)
            for b, sums in enumerate(total):
                x = flags[:, b * step : (b + 1) * step]
                sums += (x.T @ x).astype(np.int64)
        for b, sums in enumerate(total):
            i, j = np.triu_indices(len(sums))
            columns = [np.full(len(i), b, np.int32), i.astype(np.int32), j.astype(np.int32), sums[i, j]]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["b", "i", "j", "n"])

    counted = having.mapInArrow(run, "b int, i int, j int, n long").groupBy("b", "i", "j").agg(F.sum("n").alias("n")).toArrow()
    b, i, j, n = (counted.column(c).to_numpy() for c in ("b", "i", "j", "n"))
    out, rows = [], max(1, having.count())
    for at in range(0, n_parts * bits, step):
        size, here = min(step, n_parts * bits - at), b == at // step
        together = np.zeros((size, size))
        together[i[here], j[here]] = together[j[here], i[here]] = n[here]
        out += [at + bit for part in _by_bond(together, rows, size // bits) for bit in part]
    return np.array(out)


def _wide_histogram(wide: DataFrame, n_parts: int, bits: int, order: np.ndarray) -> np.ndarray:
    """By partition and the lowest WIDE_COARSE bits of its value: texts, and how many a text there shares its whole value with, itself included, on average."""
    cells = 1 << WIDE_COARSE

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = _regrouped(_part_values(batch, n_parts), bits, order)
            for k in range(n_parts):
                v, n = np.unique(values[:, k], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(v), k, np.int32)), pa.array(v), pa.array(n)], ["k", "v", "n"])

    sizes = wide.where(F.size("parts") > 0).select("parts").mapInArrow(run, "k int, v long, n long").groupBy("k", "v").agg(F.sum("n").alias("n"))
    by_cell = sizes.groupBy("k", F.col("v").bitwiseAND(cells - 1).alias("v")).agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("n")).alias("met")).toArrow()
    k, v, n, met = (by_cell.column(c).to_numpy() for c in ("k", "v", "n", "met"))
    out = np.zeros((2, n_parts, cells))
    out[:, k, v] = n, met / np.maximum(n, 1)
    return out


def reaches(values: np.ndarray, histogram: np.ndarray, bits: int) -> np.ndarray:
    """Thresholds -1, 0 or 1 (n, partitions) of least cost; the sum of each and one is the number of partitions."""
    n_parts, costs = values.shape[1], []
    fine = bits - WIDE_COARSE  # bits of which the histogram does not tell
    for k in range(n_parts):
        coarse = values[:, k] & ((1 << WIDE_COARSE) - 1)
        texts, own = histogram[0, k] / 2.0**fine, histogram[1, k, coarse]
        near = texts[coarse] * fine + texts[coarse[:, None] ^ (1 << np.arange(WIDE_COARSE))].sum(axis=1)
        costs.append(np.column_stack((np.zeros(len(values)), 1 + own, 1 + own + bits + near)))
    return allocate(costs, n_parts)


def _allotted(wide: DataFrame, n_parts: int, bits: int) -> DataFrame:
    """``wide`` with ``holes`` for ``parts``: where each text is held, and where it asks, by the generalised pigeonhole principle.

    Bits that go together share a partition. Each text has thresholds t_i >= -1 of least cost with sum(t_i + 1) equal to
    the number of partitions, so that it asks where any fingerprint that differs in fewer bits than there are partitions
    is held. A text is held at its own value of each partition, asks there unless t_i is -1, and where t_i is 1 asks at
    the values one bit away as well.
    """
    order = correlated_order(wide, n_parts, bits)
    histogram = _wide_histogram(wide, n_parts, bits, order)
    kept = [c for c in wide.columns if c != "parts"]
    flips = np.append(0, 1 << np.arange(bits, dtype=np.int64))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                some = batch.slice(at, 1024)
                here = some.column("parts").value_lengths().to_numpy(zero_copy_only=False) > 0
                values = _regrouped(_part_values(some, n_parts), bits, order)
                reach = reaches(values, histogram, bits)
                each = np.where(reach > 0, len(flips), 1).ravel()  # holes by row and partition
                starts = np.cumsum(each) - each
                turn = np.arange(each.sum()) - np.repeat(starts, each)
                kinds = np.where(turn > 0, ASKS, np.repeat(np.where(reach.ravel() < 0, HOLDS, HOLDS | ASKS), each))
                part = np.repeat(np.tile(np.arange(n_parts), len(values)), each)
                columns = [pa.array(part.astype(np.int32)), pa.array(np.repeat(values.ravel(), each) ^ flips[turn]), pa.array(kinds.astype(np.int32))]
                lengths = np.zeros(len(here), np.int64)
                lengths[here] = each.reshape(len(values), n_parts).sum(axis=1)
                offsets = pa.array(np.append(0, np.cumsum(lengths)).astype(np.int32))
                holes = pa.ListArray.from_arrays(offsets, pa.StructArray.from_arrays(columns, ["part", "value", "kind"]))
                yield pa.RecordBatch.from_arrays([*(some.column(c) for c in kept), holes], [*kept, "holes"])
        give_back()

    schema = ", ".join(f"{c} {wide.schema[c].dataType.simpleString()}" for c in kept)
    return wide.mapInArrow(run, f"{schema}, holes array<struct<part: int, value: bigint, kind: int>>")


def _distances(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Differing bits between each row of p and each of q."""
    out = np.zeros((len(p), len(q)), np.int16)
    for word in range(p.shape[1]):
        out += np.bitwise_count(p[:, None, word] ^ q[None, :, word])
    return out


def _near_places(p: np.ndarray, max_bits: int | np.ndarray, most: float = float("inf")) -> tuple[np.ndarray, np.ndarray, np.ndarray] | None:
    """Places i < j of the rows at most max_bits apart (the larger of two rows' own, if each has one), and their distances; None if they are more than ``most``."""
    limit, found, n = np.broadcast_to(max_bits, len(p)), [], 0
    for at in range(0, len(p), 256):
        d = _distances(p[at : at + 256], p[at:])
        i, j = np.nonzero(d <= np.maximum(limit[at : at + 256, None], limit[None, at:]))
        i, j, d = (x[i < j] for x in (i + at, j + at, d[i, j]))
        found.append((i, j, d))
        n += len(i)
        if n > most:
            return None
    return tuple(np.concatenate(x) for x in zip(*found))


def spanning(p: np.ndarray, max_bits: int) -> list[tuple[int, int]]:
    """A forest (i, j) of least distances with the components of all rows at most max_bits apart; no matrix is kept."""
    left = np.arange(len(p))
    reach, near_to, out, now = np.full(len(p), 32_000, np.int16), np.zeros(len(p), np.int64), [], 0
    while len(left) > 1:
        here, keep = left[now], np.arange(len(left)) != now
        left, reach, near_to = left[keep], reach[keep], near_to[keep]
        d = _distances(p[here : here + 1], p[left])[0]
        closer = d < reach
        reach[closer], near_to[closer] = d[closer], here
        now = int(reach.argmin())
        if reach[now] <= max_bits:
            out.append((int(near_to[now]), int(left[now])))
    return out


def crossing(p: np.ndarray, group: np.ndarray, max_bits: int | np.ndarray, most: int, side: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Near places (i, j) of different groups, and of different sides if these are given: for each two groups the ``most`` nearest, and whether these two have more."""
    if side is None:
        i, j, d = _near_places(p, max_bits)
    else:
        own, their, limit = np.flatnonzero(~side), np.flatnonzero(side), np.broadcast_to(max_bits, len(p))
        d = _distances(p[own], p[their])
        x, y = np.nonzero(d <= np.maximum(limit[own][:, None], limit[their][None, :]))
        i, j, d = np.minimum(own[x], their[y]), np.maximum(own[x], their[y]), d[x, y]
    i, j, d = (x[group[i] != group[j]] for x in (i, j, d))
    low, high = np.minimum(group[i], group[j]), np.maximum(group[i], group[j])
    order = np.lexsort((j, i, d, high, low))
    i, j, low, high = (x[order] for x in (i, j, low, high))
    new = np.ones(len(i), bool)
    new[1:] = (low[1:] != low[:-1]) | (high[1:] != high[:-1])
    first = np.flatnonzero(new)
    sizes = np.diff(np.append(first, len(i)))
    keep = np.arange(len(i)) - np.repeat(first, sizes) < most
    return i[keep], j[keep], np.repeat(sizes > most, sizes)[keep]


def _in_blocks(values: DataFrame, sizes: DataFrame, columns: list[str], compare, schema: str) -> DataFrame:
    """``compare`` (part, value, members' arrays to a batch) over every two blocks of the buckets in ``sizes`` (part, value, n).

    ``values`` has part, value, k and ``columns``. A block takes BLOCK members, so that no task holds a bucket; a
    bucket of b blocks sends each member to b places. Members come in the order of k.
    """
    key = ["part", "value"]
    blocks = F.ceil(F.col("n") / F.lit(BLOCK)).cast("int")
    mine = values.join(sizes.withColumn("blocks", blocks).drop("n"), key).withColumn("block", F.pmod(F.xxhash64("k"), F.col("blocks")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    mine = mine.select("*", other.alias("other")).where("blocks < 2 OR block <> other")
    # of two blocks, one place holds both; pairs inside a block are in each of its places
    names = ["k", *columns]
    mine = mine.select(*key, F.least("block", "other").alias("b1"), F.greatest("block", "other").alias("b2"), *names)
    grouped = mine.groupBy(*key, "b1", "b2").agg(F.collect_list(F.struct(*names)).alias("m")).where(F.size("m") > 1)
    return _compared(grouped, names, compare, schema)


def _across(sides: DataFrame, columns: list[str], compare, schema: str) -> DataFrame:
    """As ``_in_blocks``, over each block of the rows of ``sides`` (part, value, k, asks, columns) that ask and each of the others."""
    key = ["part", "value"]
    blocks = lambda of: F.ceil(F.count_if(of) / F.lit(BLOCK)).cast("int")
    sizes = sides.groupBy(*key).agg(blocks(~F.col("asks")).alias("own"), blocks(F.col("asks")).alias("their")).where("own > 0 AND their > 0")
    mine = sides.join(sizes, key).withColumn("block", F.pmod(F.xxhash64("k"), F.when(F.col("asks"), F.col("their")).otherwise(F.col("own"))).cast("int"))
    mine = mine.select("*", F.explode(F.sequence(F.lit(0), F.when(F.col("asks"), F.col("own")).otherwise(F.col("their")) - 1)).alias("other"))
    b1, b2 = (F.when(F.col("asks"), F.col(x)).otherwise(F.col(y)) for x, y in (("other", "block"), ("block", "other")))
    names = ["k", "asks", *columns]
    grouped = mine.select(*key, b1.alias("b1"), b2.alias("b2"), *names).groupBy(*key, "b1", "b2").agg(F.collect_list(F.struct(*names)).alias("m"))
    return _compared(grouped, names, compare, schema)


def _compared(grouped: DataFrame, names: list[str], compare, schema: str) -> DataFrame:
    """``compare`` (part, value, members' arrays to a batch) over the lists m of ``grouped``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("m")
            flat, at = lists.flatten(), 0
            for part, value, n in zip(batch.column("part").to_pylist(), batch.column("value").to_pylist(), lists.value_lengths().to_pylist()):
                some = flat.slice(at, n)
                arrays = [some.field(x).to_numpy(zero_copy_only=False) for x in names]
                order = np.argsort(arrays[0])
                yield compare(part, value, *(x[order] for x in arrays))
                at += n

    return grouped.mapInArrow(run, schema)


def _classes(single: DataFrame, wide: DataFrame, rows: DataFrame, words: int, least: float, work: str, max_bits: int) -> tuple[DataFrame, DataFrame]:
    """Verified links (a, b) in crowded buckets of some partitions, and the classes (k, class): components of more than PAIR_BUCKET texts.

    A member is in one block of each bucket, in others from partition to partition. What this does not link is left to
    the comparison of classes with all that meets them.
    """
    key = ["part", "value"]
    here = lambda h: (h["part"] % CLASS_EVERY == 0) & (h["kind"].bitwiseAND(HOLDS) > 0)
    values = single.select("k", "p1", "p2", F.explode(F.filter("holes", here)).alias("hole")).select("k", "p1", "p2", "hole.part", "hole.value")
    blocks = values.groupBy(*key).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > PAIR_BUCKET)
    blocks = blocks.select(*key, F.ceil(F.col("n") / F.lit(BLOCK)).alias("blocks"))
    mine = values.join(blocks, key).withColumn("block", F.pmod(F.xxhash64("k", "part"), F.col("blocks")))
    grouped = mine.groupBy(*key, "block").agg(F.collect_list(F.struct("k", "p1", "p2")).alias("m")).where(F.size("m") > 1)

    def compare(part: int, value: int, k: np.ndarray, p1: np.ndarray, p2: np.ndarray) -> pa.RecordBatch:
        ends = k[np.array(spanning(np.column_stack((p1, p2)).view(np.uint64), max_bits), np.int64).reshape(-1, 2)]
        return pa.RecordBatch.from_arrays([pa.array(ends.min(axis=1)), pa.array(ends.max(axis=1))], ["a", "b"])

    with configured(single.sparkSession, _FEW_GROUPS):
        met = stored(_compared(grouped, ["k", "p1", "p2"], compare, "a long, b long").distinct(), f"{work}/class-pairs")
    links = _verified(met, wide, rows, words, least, f"{work}/class-round")
    reached = stored(components(links, f"{work}/class-components"), f"{work}/class-reached")
    large = reached.groupBy("root").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > PAIR_BUCKET).select("root")
    classes = reached.join(large, "root", "left_semi").select(F.col("u").alias("k"), F.col("root").alias("class"))
    return links, stored(classes, f"{work}/classes")


def _sides(values: DataFrame, at: DataFrame, classes: DataFrame, work: str) -> DataFrame:
    """Rows (part, value, k, asks): for each class (value) its members, and all (asks) that meet it where it stands: other texts, and members of other classes that stand there."""
    key = ["part", "value"]
    both = F.col("kind").bitwiseOR(F.col("there")) == HOLDS | ASKS
    lone = values.drop("class").join(at.withColumnRenamed("kind", "there"), key).where(both).select("class", "k").distinct()
    more = at.select(*key, F.col("class").alias("other"), F.col("kind").alias("there"))
    pairs = at.join(more, key).where(both).where("class < other").select("class", "other").distinct()
    others = pairs.join(classes.withColumnRenamed("class", "other"), "other").select("class", "k")
    asking = lone.unionByName(others).distinct().join(classes, ["class", "k"], "left_anti")
    row = lambda df, asks: df.select(F.lit(-2).alias("part"), F.col("class").alias("value"), "k", F.lit(asks).alias("asks"))
    return stored(row(classes, False).unionByName(row(asking, True)), f"{work}/sides")


def _candidates(wide: DataFrame, classes: DataFrame, work: str, max_bits: int = 33) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame, DataFrame]:
    """Pairs of keys of which one asks where the other is held, and that differ in few of 128 bits.

    Gives the pairs (a, b) to verify, the forests (a, b, part, value) that stand for the near pairs of dense blocks,
    and the values and crowded buckets for further rounds over these. Where over PAIR_BUCKET members of a class are in
    a bucket, the class stands there for them: the last rows (part, value, class, kind) say so, and they are in no values.
    """
    key = ["part", "value"]
    every = stored(wide.select("k", "p1", "p2", "holes").join(classes, "k", "left"), f"{work}/marked")
    met = every.select("class", F.explode("holes").alias("hole")).select("class", "hole.*").groupBy(*key, "class")
    met = stored(met.agg(F.count(F.lit(1)).alias("n"), F.bit_or("kind").alias("kind")).where(F.col("class").isNotNull() | (F.col("n") > PAIR_BUCKET)), f"{work}/met")
    at = met.where("class IS NOT NULL").where(F.col("n") > PAIR_BUCKET).select(*key, "class", "kind")
    none, few = F.sum(F.when(F.col("class").isNull(), F.col("n"))), F.sum(F.when(F.col("class").isNotNull() & (F.col("n") <= PAIR_BUCKET), F.col("n")))
    left = met.groupBy(*key).agg(none.alias("none"), few.alias("few"))  # none is null if it is PAIR_BUCKET or less
    left = left.select(*key, "none", (F.coalesce("none", F.lit(PAIR_BUCKET)) + F.coalesce("few", F.lit(0))).alias("n"))
    crowded = stored(left.where(F.col("none").isNotNull() | (F.col("n") > 2 * PAIR_BUCKET)).drop("none"), f"{work}/crowded-buckets")
    stand = stored(at.groupBy(*key).agg(F.collect_set("class").alias("classes")), f"{work}/standing")
    values = every.select("k", "p1", "p2", "class", F.explode("holes").alias("hole")).select("k", "p1", "p2", "class", "hole.*").join(stand, key, "left")
    values = values.where(~F.coalesce(F.array_contains("classes", F.col("class")), F.lit(False))).drop("classes")
    near = lambda x, y: F.bit_count(x["p1"].bitwiseXOR(y["p1"])) + F.bit_count(x["p2"].bitwiseXOR(y["p2"])) <= max_bits
    # lists have at most 2 * PAIR_BUCKET members: crowded buckets are taken out before
    member = F.struct("k", "p1", "p2", "kind", "class")
    asked = lambda x, y: (x["kind"].bitwiseOR(y["kind"]) == HOLDS | ASKS) & F.coalesce(x["class"] != y["class"], F.lit(True))
    small = values.join(crowded, key, "left_anti").groupBy(*key).agg(F.collect_list(member).alias("m")).where(F.size("m") > 1)
    pairs = F.flatten(F.transform("m", lambda x: F.transform(F.filter("m", lambda y: (x["k"] < y["k"]) & asked(x, y) & near(x, y)), lambda y: F.struct(x["k"].alias("a"), y["k"].alias("b")))))
    inside = small.select(F.explode(pairs).alias("p")).select("p.a", "p.b")

    def compare(part: int, value: int, k: np.ndarray, p1: np.ndarray, p2: np.ndarray, kind: np.ndarray) -> pa.RecordBatch:
        p = np.column_stack((p1, p2)).view(np.uint64)
        found = _near_places(p, max_bits, DENSE * len(p))
        if found:
            met = kind[found[0]] | kind[found[1]] == HOLDS | ASKS
            found = tuple(x[met] for x in found)
        ends = np.column_stack(found[:2]) if found else np.array(spanning(p, max_bits)).reshape(-1, 2)
        a, b = k[ends].min(axis=1), k[ends].max(axis=1)
        columns = [pa.array(a), pa.array(b), pa.array(np.full(len(a), part, np.int32)), pa.array(np.full(len(a), value, np.int64))]
        return pa.RecordBatch.from_arrays([*columns, pa.array(np.full(len(a), found is None))], ["a", "b", "part", "value", "dense"])

    with configured(wide.sparkSession, _FEW_GROUPS):
        met = _in_blocks(values, crowded, ["p1", "p2", "kind"], compare, "a long, b long, part int, value long, dense boolean")
        met = stored(met, f"{work}/crowded-pairs")
    pairs = stored(inside.unionByName(met.select("a", "b")).distinct(), f"{work}/candidates")
    return pairs, met.where("dense").drop("dense"), values, crowded, at


def _forest(k: np.ndarray, sets: list[np.ndarray], least: float) -> list[tuple[int, int]]:
    """Links (a, b) that join all members whose sets have a similarity of ``least`` or more, no more than members less one."""
    sizes = np.array([len(x) for x in sets])
    flat, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), sizes)
    order = np.argsort(flat, kind="stable")
    flat, owner = flat[order], owner[order]
    starts, ends = (np.split(np.searchsorted(flat, np.concatenate(sets), side), np.cumsum(sizes)[:-1]) for side in ("left", "right"))
    group, out = np.arange(len(sets)), []
    for i in range(len(sets)):
        met = np.concatenate([owner[a:b] for a, b in zip(starts[i], ends[i])])
        shared = np.bincount(met[met > i], minlength=len(sets))
        for j in np.flatnonzero((shared > 0) & (shared >= least * (sizes[i] + sizes - shared))):
            if group[i] != group[j]:
                group[group == group[j]] = group[i]
                out.append((int(min(k[i], k[j])), int(max(k[i], k[j]))))
    return out


def _short_links(single: DataFrame, least: float, work: str) -> DataFrame:
    """Links (a, b) of all texts of SHORT shingles or fewer whose similarity is ``least`` or more; exact.

    Two such sets share one of their first n - least * n + 1 shingles in any common order; in that of frequency, the
    rarest first, a shingle that many texts have is seldom among these. Crowded buckets are compared in blocks.
    """
    key = ["part", "value"]
    short = single.where(F.size("few") > 1).select("k", "few")
    each = short.select("k", "few", F.explode("few").alias("value"))
    often = each.groupBy("value").agg(F.count(F.lit(1)).alias("f")).where("f > 1")
    first = F.slice(F.array_sort(F.collect_list(F.struct("f", "value"))), 1, F.max(F.size("few") - F.ceil(F.lit(least) * F.size("few") - 1e-9) + 1).cast("int"))
    # shingles of one text only come first in the order but join nothing
    ranked = each.join(often, "value", "left").withColumn("f", F.coalesce("f", F.lit(1))).groupBy("k").agg(first.alias("first"), F.first("few").alias("few"))
    values = stored(ranked.select("k", "few", F.explode("first").alias("x")).where("x.f > 1").select(F.lit(-1).alias("part"), F.col("x.value").alias("value"), "k", "few"), f"{work}/short")
    sizes = values.groupBy(*key).agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    crowded = stored(sizes.where(F.col("n") > PAIR_BUCKET), f"{work}/short-crowded")
    shared = lambda x, y: F.size(F.array_intersect(x["few"], y["few"]))
    alike = lambda x, y: shared(x, y) >= least * (F.size(x["few"]) + F.size(y["few"]) - shared(x, y))
    small = values.join(crowded, key, "left_anti").groupBy(*key).agg(F.collect_list(F.struct("k", "few")).alias("m")).where(F.size("m") > 1)
    pairs = F.flatten(F.transform("m", lambda x: F.transform(F.filter("m", lambda y: (x["k"] < y["k"]) & alike(x, y)), lambda y: F.struct(x["k"].alias("a"), y["k"].alias("b")))))

    def compare(part: int, value: int, k: np.ndarray, few: np.ndarray) -> pa.RecordBatch:
        found = np.array(_forest(k, list(few), least), np.int64).reshape(-1, 2)
        return pa.RecordBatch.from_arrays([pa.array(found[:, 0]), pa.array(found[:, 1])], ["a", "b"])

    with configured(single.sparkSession, _FEW_GROUPS):
        met = stored(_in_blocks(values, crowded, ["few"], compare, "a long, b long"), f"{work}/short-met")
    return small.select(F.explode(pairs).alias("p")).select("p.a", "p.b").unionByName(met).distinct()


#: Bytes of a batch of texts or sets, and groups of a batch: each has up to two blocks of members.
_SMALL_BATCHES = {"spark.sql.execution.arrow.maxBytesPerBatch": "8m"}
_FEW_GROUPS = {"spark.sql.execution.arrow.maxRecordsPerBatch": "64"}


def _linked(wide: DataFrame, rows: DataFrame, words: int, least: float, work: str, max_bits: int = 33) -> DataFrame:
    """Rows (u, root) of the components of all verified near pairs.

    Texts of the same shingles are linked without a test. Large groups of near copies become classes first: their
    members are not dealt out by bucket, but once for each class, with every text that meets it in any crowded bucket.
    Where a forest's links all hold, or join keys that others join, its block needs no more. A block with a link that
    fails, and a class beside texts that it does not reach, are compared again: near pairs between different components
    are verified, the nearest of each two components first, until none is left.
    """
    if "holes" not in wide.columns:  # each text asks where it is held
        hole = lambda v, i: F.struct(i.alias("part"), v.alias("value"), F.lit(HOLDS | ASKS).alias("kind"))
        wide = wide.withColumn("holes", F.transform("parts", hole))
    having = wide.where(F.size("holes") > 0)
    heads = stored(having.groupBy("same").agg(F.min("k").alias("head"), F.count(F.lit(1)).alias("n")).where("n > 1"), f"{work}/heads")
    twins = having.select("k", "same").join(heads, "same").where("k <> head").select(F.col("head").alias("a"), F.col("k").alias("b"))
    twins = stored(twins, f"{work}/twins")
    single = having.join(twins.select(F.col("b").alias("k")), "k", "left_anti")
    joined, classes = _classes(single, wide, rows, words, least, work, max_bits)
    pairs, forests, values, crowded, at = _candidates(single, classes, work, max_bits)
    sides = _sides(values, at, classes, work)
    short = _short_links(single, least, work)
    links = stored(_verified(pairs, wide, rows, words, least, f"{work}/round=0").unionByName(twins).unionByName(short).unionByName(joined).distinct(), f"{work}/links=0")
    reached = stored(components(links, f"{work}/components=0"), f"{work}/reached=0")
    most, turn = ROUND_PAIRS, 0
    while True:
        roots = reached.select(F.col("u").alias("k"), "root")
        named = lambda df, end, name: df.join(roots.select(F.col("k").alias(end), F.col("root").alias(name)), end, "left").withColumn(name, F.coalesce(name, end))  # noqa: B023, E731
        apart = named(named(forests, "a", "ra"), "b", "rb").where("ra <> rb").select("part", "value").distinct()
        again = stored(crowded.join(apart, ["part", "value"], "left_semi"), f"{work}/again={turn}")
        beyond = named(named(sides.where("asks"), "k", "root"), "value", "top").where("root <> top").select("part", "value", "k", "asks")
        beyond = stored(beyond, f"{work}/beyond={turn}")
        if again.isEmpty() and beyond.isEmpty():
            return reached
        open_sides = beyond.unionByName(sides.where("NOT asks").join(beyond.select("value").distinct(), "value", "left_semi"))
        turn += 1
        if turn == 1:  # later rounds come back to some of these buckets only
            asked = values.join(again.drop("n"), ["part", "value"], "left_semi").select("k").unionByName(open_sides.select("k")).distinct()
            prints = _long_prints(asked, wide, rows, words, f"{work}/prints")

        def compare(part: int, value: int, k: np.ndarray, *of: np.ndarray, most: int = most) -> pa.RecordBatch:
            *side, root, whole, size = of
            p = np.frombuffer(b"".join(whole), np.uint64).reshape(len(k), -1)
            i, j, more = crossing(p, root, np.where(size < SMALL, LONG_BITS[1], LONG_BITS[0]), most, *side)
            return pa.RecordBatch.from_arrays([pa.array(k[i]), pa.array(k[j]), pa.array(more)], ["a", "b", "more"])

        with configured(wide.sparkSession, _FEW_GROUPS):
            printed = stored(named(prints, "k", "root"), f"{work}/printed={turn}")  # a row a text, not one for each of its buckets
            mine = values.select("part", "value", "k").join(again.drop("n"), ["part", "value"], "left_semi").join(printed, "k")
            given, schema = ["root", "print", "size"], "a long, b long, more boolean"
            met = _in_blocks(mine, again, given, compare, schema).unionByName(_across(open_sides.join(printed, "k"), given, compare, schema))
            met = stored(met, f"{work}/met={turn}")
        new = stored(met.select("a", "b").distinct().join(pairs, ["a", "b"], "left_anti"), f"{work}/new={turn}")
        links = _verified(new, wide, rows, words, least, f"{work}/round={turn}")
        # new links join whole components: only their roots are linked anew
        between = named(named(links, "a", "ra"), "b", "rb").where("ra <> rb").select(F.col("ra").alias("a"), F.col("rb").alias("b"))
        joined = components(between, f"{work}/components={turn}").withColumnRenamed("root", "top")
        moved = reached.join(joined.select(F.col("u").alias("root"), "top"), "root", "left").select("u", F.coalesce("top", "root").alias("root"))
        added = joined.join(reached.select("u"), "u", "left_anti").select("u", F.col("top").alias("root"))
        reached = stored(moved.unionByName(added), f"{work}/reached={turn}")
        if not met.where("more").head(1):
            return reached
        most *= 8


def _texts(asked: DataFrame, wide: DataFrame, rows: DataFrame, path: str) -> DataFrame:
    """Rows (k, text) of the keys asked for."""
    located_keys = stored(asked.join(wide.select("k", *LOCATOR), "k").withColumn("n", F.lit(1)), path)
    return rows.select(*LOCATOR, "text").join(located_keys.where("n > 0"), list(LOCATOR)).select("k", "text")


def _long_prints(asked: DataFrame, wide: DataFrame, rows: DataFrame, words: int, path: str) -> DataFrame:
    """Rows (k, print, size): LONG_WORDS * 64 bits of SimHash and the number of shingles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hashes = [shingle_hashes(t, words) for t in batch.column("text").to_pylist()]
            data = [np.packbits(_words_of_bits(h, LONG_WORDS)).tobytes() for h in hashes]
            yield pa.RecordBatch.from_arrays([batch.column("k"), pa.array(data, pa.binary()), pa.array([len(h) for h in hashes], pa.int32())], ["k", "print", "size"])

    with configured(rows.sparkSession, BLOOM_CONF):
        return stored(_texts(asked, wide, rows, f"{path}-asked").mapInArrow(run, "k long, print binary, size int"), path)


def _verified(pairs: DataFrame, wide: DataFrame, rows: DataFrame, words: int, least: float, work: str) -> DataFrame:
    """The pairs whose sets of word shingles (by 64 bits of their hashes) have a Jaccard similarity of ``least`` or more."""
    asked = pairs.select(F.explode(F.array("a", "b")).alias("k")).distinct()

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data = [shingle_hashes(t, words).tobytes() for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("k"), pa.array(data, pa.binary())], ["k", "set"])
        give_back()

    def alike(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("sa"), batch.column("sb")):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                shared = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(shared >= least * (len(x) + len(y) - shared))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))
        give_back()

    with configured(rows.sparkSession, BLOOM_CONF):
        found = stored(_texts(asked, wide, rows, f"{work}/asked").mapInArrow(sets, "k long, set binary"), f"{work}/sets")
    both = pairs.join(found.select(F.col("k").alias("a"), F.col("set").alias("sa")), "a").join(found.select(F.col("k").alias("b"), F.col("set").alias("sb")), "b")
    return stored(both.select("a", "b", "sa", "sb").mapInArrow(alike, "a long, b long"), f"{work}/verified")


def _rooted(docs: DataFrame, words: int, least: float, id_col: str, text_col: str) -> DataFrame:
    """One row per document: id, root (a key that its group alone has) and LOCATOR.

    Groups are components of pairs of verified similarity ``least`` or more. Pairs
    to verify come from wide SimHashes by the generalised pigeonhole principle: all
    that differ in fewer bits than there are partitions, and with them a pair of
    similarity 0.8 with chance 0.95, one of 0.9 with chance 0.999. Texts of few
    shingles are joined on these as well. Such a pair is linked however many members
    the value's bucket has. The partitions get wider, and more, with the rows.
    """
    work = work_dir(docs.sparkSession, "similar")
    rows = located(docs).select(F.col(id_col).alias("id"), *LOCATOR, whole_text(text_col).alias("text"))
    with configured(docs.sparkSession, _SMALL_BATCHES):
        n_parts, bits = width(rows.count())
        prints = stored(_wide(rows, words, n_parts, bits).withColumn("k", F.monotonically_increasing_id()), f"{work}/prints")
        wide = stored(_allotted(prints, n_parts, bits), f"{work}/wide")
        discard(docs.sparkSession, f"{work}/prints")
        reached = _linked(wide, rows, words, least, work)
    rooted = wide.select("id", "k", *LOCATOR).join(reached.withColumnRenamed("u", "k"), "k", "left")
    return rooted.select("id", F.coalesce("root", "k").alias("root"), *LOCATOR)


def similar_groups(docs: DataFrame, words: int = 5, least: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, component_id (smallest id of its group, null if it has none) and LOCATOR; groups as in ``_rooted``."""
    rooted = _rooted(docs, words, least, id_col, text_col)
    names = rooted.groupBy("root").agg(F.min("id").alias("component_id"))
    return rooted.join(names, "root").select(F.col("id").alias(id_col), "component_id", *LOCATOR)


def one_of_each_group(docs: DataFrame, words: int = 5, least: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one row of each group of similar texts, columns as given.

    The row with the smallest identifier stays, of several the first by LOCATOR; a null identifier comes after all
    others. Rows are told apart by LOCATOR, so dissimilar texts with the same or no identifier all stay.
    """
    rows = located(docs)
    groups = stored(_rooted(rows, words, least, id_col, text_col), work_dir(docs.sparkSession, "similar-groups"))
    first = groups.groupBy("root").agg(F.min(F.struct(F.col("id").isNull(), "id", *LOCATOR)).alias("stays"))
    dropped = groups.join(first.select(*(F.col("stays")[c].alias(c) for c in LOCATOR)), list(LOCATOR), "left_anti").select(*LOCATOR)
    return rows.join(dropped, list(LOCATOR), "left_anti").select(*docs.columns)
