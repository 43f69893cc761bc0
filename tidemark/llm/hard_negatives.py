"""Hard-negative mining over rotated one-bit codes with stored alignments.

Vectors become integers, ``floor(scale * x)``. A vector is coded in levels: it is
rotated (random signs and Hadamard transforms, from a seed), the signs of its
components are one bit each, and its inner product with that unit code vector,
the alignment, is stored with the norm of what is left; what is left is coded
again under the next rotation. So a vector is its codes times their alignments,
plus a rest.

A query is rotated likewise and rounded to bit planes. Counts of common bits of
the planes and a code (popcounts) give the query's product with each code vector;
with the alignments they estimate the inner product. How far the estimate can be
off is bounded for certain: by Cauchy-Schwarz the product of the rest with the
part of the query that is orthogonal to the last code (to which the rest is
orthogonal as well) is at most the product of their norms, and the rounding of
the planes has a known sum. Rows whose interval cannot reach what is asked for
are dropped level by level; only the others are scored, by whole numbers. The
bound is no guess, so the result is exact.

Anchors are dealt into blocks of at most ``anchor_bytes``; each block is sent to
the workers and meets all rows where they are, so rows are never shuffled or
paired through a join. A task keeps the best few of each anchor while its rows
pass, which also tightens what the next rows must reach, and hands out these
alone. A first pass finds each anchor's positives, a second the negatives inside
the band that each positive's score opens. Codes, blocks and results are written
to the shared folder.

Defined results: rows take no part with a null identifier, label or vector, with
a null or non-finite component, or with another length than most have (of equally
common lengths the longest counts). Components are clipped so that every score
fits 64 bits (beyond 2 ** 28 for up to 64 dimensions). Repeated identifiers are
rows of their own, but an anchor never meets rows of its own identifier; equal
scores go by identifier. An anchor without positives, or a positive score below
zero, gives no rows; neither does an empty table. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from math import ceil, log2

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import stored, work_dir

_LOW = np.iinfo(np.int64).min


class Coder:
    """Rotations of all levels, codes of rows and bit planes of queries."""

    def __init__(self, dims: int, levels: int, planes: int, seed: int):
        self.dims, self.levels, self.planes = dims, levels, planes
        self.size = max(64, 1 << (dims - 1).bit_length())
        signs = np.random.default_rng(seed).integers(0, 2, (levels, 3, self.size))
        self.signs = (2 * signs - 1).astype(np.int8)

    def _mixed(self, x: np.ndarray) -> np.ndarray:
        """The orthonormal Hadamard transform of each row."""
        n, half = len(x), 1
        while half < self.size:
            y = x.reshape(n, -1, 2, half)
            x = np.stack((y[:, :, 0] + y[:, :, 1], y[:, :, 0] - y[:, :, 1]), axis=2).reshape(n, self.size)
            half *= 2
        return x / np.sqrt(self.size)

    def rotated(self, x: np.ndarray, level: int) -> np.ndarray:
        for s in self.signs[level]:
            x = self._mixed(x * s)
        return x

    def _back(self, x: np.ndarray, level: int) -> np.ndarray:
        for s in self.signs[level][::-1]:
            x = self._mixed(x) * s
        return x

    def padded(self, v: np.ndarray) -> np.ndarray:
        out = np.zeros((len(v), self.size))
        out[:, : self.dims] = v
        return out

    def encode(self, v: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(codes, alignments, rests): bits as 64-bit words (rows, levels * words), and numbers (rows, levels)."""
        left = self.padded(v)
        codes, gains, rests = [], [], []
        for k in range(self.levels):
            turned = self.rotated(left, k)
            bits = turned >= 0
            unit = np.where(bits, 1.0, -1.0) / np.sqrt(self.size)
            gain = (turned * unit).sum(axis=1)
            left = left - self._back(unit * gain[:, None], k)
            codes.append(np.packbits(bits, axis=1, bitorder="little").view(np.int64))
            gains.append(gain)
            rests.append(np.sqrt((left * left).sum(axis=1)))
        return np.hstack(codes), np.column_stack(gains), np.column_stack(rests)

    def query(self, q: np.ndarray) -> list[tuple[np.ndarray, float, float, float, float]]:
        """For each level: bit planes, lowest value, step, sum of the rounded query, and how far a product may be off."""
        out = []
        for k in range(self.levels):
            turned = self.rotated(self.padded(q[None, :].astype(float)), k)[0]
            low, high = turned.min(), turned.max()
            step = (high - low) / (2**self.planes - 1) or 1.0
            whole = np.rint((turned - low) / step).astype(np.int64)
            bits = ((whole[None, :] >> np.arange(self.planes)[:, None]) & 1).astype(bool)
            planes = np.packbits(bits, axis=1, bitorder="little").view(np.uint64)
            near = low + step * whole
            out.append((planes, low, step, near.sum(), np.abs(turned - near).sum() / np.sqrt(self.size)))
        return out

    def products(self, codes: np.ndarray, part: tuple) -> np.ndarray:
        """The rounded query's product with each code vector (rows of 64-bit words), by counts of bits."""
        planes, low, step, total, _ = part
        count = lambda bits: np.bitwise_count(bits).sum(axis=1, dtype=np.int64)
        weighed = np.zeros(len(codes), np.int64)
        for p, plane in enumerate(planes):
            weighed += count(codes & plane) << p
        return (2 * (low * count(codes) + step * weighed) - total) / np.sqrt(self.size)


class Rows:
    """A batch of coded rows."""

    def __init__(self, batch: pa.RecordBatch, coder: Coder):
        n = batch.num_rows
        matrix = lambda name: batch.column(name).flatten().to_numpy(zero_copy_only=False).reshape(n, -1)
        self.coder = coder
        self.ids, self.labels = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("id", "label"))
        self.v = matrix("v")
        words = matrix("codes").view(np.uint64).reshape(n, coder.levels, -1)
        self.codes = [np.ascontiguousarray(words[:, k]) for k in range(coder.levels)]
        self.gains, self.rests = matrix("gains"), matrix("rests")
        self.exact = self.v.astype(np.float64)
        self.top = float(np.sqrt((self.exact * self.exact).sum(axis=1).max(initial=0)))

    def scores(self, at: np.ndarray, q: np.ndarray) -> np.ndarray:
        """Integer inner products; doubles hold them exactly where they are small enough."""
        norm = float(np.sqrt((q.astype(np.float64) ** 2).sum()))
        if norm * self.top < 2**52:
            return (self.exact[at] @ q.astype(np.float64)).astype(np.int64)
        return self.v[at] @ q

    def candidates(self, at: np.ndarray, q: np.ndarray, least: Callable[[], float], most: float, score: Callable[[np.ndarray], None], first: int = 64) -> None:
        """Score the rows ``at`` whose product may lie between least() and most; ``least`` may rise meanwhile."""
        parts = self.coder.query(q)
        norm = float(np.sqrt((q.astype(np.float64) ** 2).sum()))
        slack = 1e-9 * norm * self.top + 1e-6
        estimate, off = np.zeros(len(at)), np.zeros(len(at))
        for k, part in enumerate(parts):
            product = self.coder.products(self.codes[k][at], part)
            gain, rest = self.gains[at, k], self.rests[at, k]
            estimate = estimate + gain * product
            off = off + gain * part[-1]
            along = np.maximum(0, np.abs(product) - part[-1])
            half = np.sqrt(np.maximum(0, norm**2 - along**2)) * rest + off + slack
            if k == 0 and len(at) > first:
                # the best estimates are scored at once: what they reach is what others must reach
                fits = np.where(estimate - half <= most, estimate, -np.inf)
                best = np.argpartition(-np.where(fits <= most, fits, -np.inf), first)[:first]
                score(at[best])
                rest_of = np.ones(len(at), bool)
                rest_of[best] = False
            else:
                rest_of = np.ones(len(at), bool)
            stay = rest_of & (estimate + half >= least()) & (estimate - half <= most)
            at, estimate, off = at[stay], estimate[stay], off[stay]
            if not len(at):
                return
        score(at)


class Best:
    """The ``k`` highest scores so far, equal ones by identifier."""

    def __init__(self, k: int):
        self.k, self.scores, self.ids = k, np.zeros(0, np.int64), np.zeros(0, np.int64)

    @property
    def least(self) -> int:
        return int(self.scores[-1]) if len(self.scores) == self.k else _LOW

    def add(self, scores: np.ndarray, ids: np.ndarray) -> None:
        fits = scores >= self.least
        if fits.any():
            scores, ids = np.concatenate((self.scores, scores[fits])), np.concatenate((self.ids, ids[fits]))
            order = np.lexsort((ids, -scores))[: self.k]
            self.scores, self.ids = scores[order], ids[order]


def _usable(vector: Column) -> Column:
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.coalesce(vector.isNotNull() & (F.size(vector) > 0) & finite, F.lit(False))


def _coded(rows: DataFrame, coder: Coder) -> DataFrame:
    lists = lambda x, kind: pa.FixedSizeListArray.from_arrays(pa.array(np.ascontiguousarray(x).ravel(), kind), x.shape[1]).cast(pa.list_(kind))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                v = batch.column("v").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
                codes, gains, rests = coder.encode(v)
                columns = [lists(codes, pa.int64()), lists(gains, pa.float64()), lists(rests, pa.float64())]
                yield pa.RecordBatch.from_arrays([*batch.columns, *columns], [*batch.schema.names, "codes", "gains", "rests"])

    return rows.mapInArrow(run, "id long, label long, anchor boolean, v array<long>, codes array<long>, gains array<double>, rests array<double>")


def _positives(index: DataFrame, block, coder: Coder, k: int) -> DataFrame:
    """Rows (a, id, score): each task's best ``k`` rows of each anchor's label."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        anchors = block.value
        best = [Best(k) for _ in anchors["id"]]
        for batch in batches:
            rows = Rows(batch, coder)
            for a, (own, label, q) in enumerate(zip(anchors["id"], anchors["label"], anchors["v"])):
                score = lambda at, a=a, q=q: best[a].add(rows.scores(at, q), rows.ids[at])
                rows.candidates(np.flatnonzero((rows.labels == label) & (rows.ids != own)), q, lambda a=a: best[a].least, np.inf, score)
        for a, b in enumerate(best):
            n = len(b.ids)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(n, anchors["a"][a]), pa.int64()), pa.array(b.ids, pa.int64()), pa.array(b.scores, pa.int64())], ["a", "id", "score"])

    return index.select("id", "label", "v", "codes", "gains", "rests").mapInArrow(run, "a long, id long, score long")


def _negatives(index: DataFrame, block, bands, coder: Coder, k: int) -> DataFrame:
    """Rows (a, place, id, score): each task's best ``k`` rows of other labels in the band of each anchor's positives."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        anchors, asked = block.value, bands.value
        best = {(a, place): Best(k) for a, of in asked.items() for place, _, _ in of}
        for batch in batches:
            rows = Rows(batch, coder)
            for a, of in asked.items():
                q = anchors["v"][a]

                def score(at: np.ndarray, a=a, of=of, q=q) -> None:
                    found, ids = rows.scores(at, q), rows.ids[at]
                    for place, low, high in of:
                        fits = (found >= low) & (found <= high)
                        best[a, place].add(found[fits], ids[fits])

                least = lambda a=a, of=of: min(max(low, best[a, place].least) for place, low, _ in of)
                others = np.flatnonzero((rows.labels != anchors["label"][a]) & (rows.ids != anchors["id"][a]))
                rows.candidates(others, q, least, max(high for _, _, high in of), score)
        for (a, place), b in best.items():
            n = len(b.ids)
            columns = [np.full(n, anchors["a"][a]), np.full(n, place), b.ids, b.scores]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["a", "place", "id", "score"])

    return index.select("id", "label", "v", "codes", "gains", "rests").mapInArrow(run, "a long, place long, id long, score long")


def _first(rows: DataFrame, keys: list[str], k: int, name: str) -> DataFrame:
    order = Window.partitionBy(*keys).orderBy(F.desc("score"), "id")
    return rows.withColumn(name, F.row_number().over(order)).where(F.col(name) <= k)


def hard_negatives(
    vectors: DataFrame,
    is_anchor: Column,
    n_positives: int = 5,
    n_negatives: int = 10,
    low: int = 30,
    high: int = 90,
    scale: int = 256,
    levels: int = 4,
    planes: int = 8,
    anchor_bytes: int = 8 << 20,
    seed: int = 41,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    label_col: str = "label",
) -> DataFrame:
    """Rows (anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    An anchor's positives are the ``n_positives`` best other rows of its label; each gets the ``n_negatives`` best rows
    of other labels whose score lies between ``low`` and ``high`` percent of the positive's.
    """
    spark = vectors.sparkSession
    work = work_dir(spark, "hard-negatives")
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("long").alias("label"), F.coalesce(is_anchor, F.lit(False)).alias("anchor"), F.col(vector_col).alias("v"))
    rows = rows.where(_usable(F.col("v")) & F.col("id").isNotNull() & F.col("label").isNotNull())
    common = rows.groupBy(F.size("v").alias("dims")).count().orderBy(F.desc("count"), F.desc("dims")).first()
    if common is None:
        return spark.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    coder = Coder(common.dims, levels, planes, seed)
    most = float(2 ** ((62 - ceil(log2(common.dims))) // 2))
    clipped = lambda x: F.greatest(F.lit(-most), F.least(F.lit(most), F.lit(float(scale)) * x.cast("double")))
    whole = F.transform("v", lambda x: F.floor(clipped(x)).cast("long"))
    index = stored(_coded(rows.where(F.size("v") == common.dims).withColumn("v", whole), coder), f"{work}/index")
    anchors = stored(index.where("anchor").select("id", "label", "v", F.monotonically_increasing_id().alias("a")), f"{work}/anchors")
    turns = max(1, ceil(anchors.count() * 8 * common.dims / anchor_bytes))
    out = None
    for turn in range(turns):
        found = anchors.where(F.pmod("a", F.lit(turns)) == turn).toArrow()  # at most about anchor_bytes
        v = found["v"].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(found.num_rows, -1) if found.num_rows else np.zeros((0, common.dims), np.int64)
        block = spark.sparkContext.broadcast({"v": v, **{c: found[c].to_numpy() for c in ("a", "id", "label")}})
        positives = stored(_first(_positives(index, block, coder, n_positives), ["a"], n_positives, "place"), f"{work}/positives={turn}")
        # n_positives numbers for each anchor of the block; scores of a band are whole numbers
        seat, asked = {a: i for i, a in enumerate(block.value["a"].tolist())}, {}
        for r in positives.select("a", "place", "score").toArrow().to_pylist():
            least, top = -(-low * r["score"] // 100), high * r["score"] // 100
            if least <= top:
                asked.setdefault(seat[r["a"]], []).append((r["place"], least, top))
        bands = spark.sparkContext.broadcast(asked)
        negatives = stored(_first(_negatives(index, block, bands, coder, n_negatives), ["a", "place"], n_negatives, "rank"), f"{work}/negatives={turn}")
        out = negatives if out is None else out.unionByName(negatives)
    near = None
    for turn in range(turns):
        part = spark.read.parquet(f"{work}/positives={turn}")
        near = part if near is None else near.unionByName(part)
    near = near.select("a", F.col("place").cast("long").alias("place"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score"))
    named = near.join(anchors.select("a", F.col("id").alias("anchor_id")), "a")
    return out.join(named, ["a", "place"]).select("anchor_id", "positive_id", "rank", F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
