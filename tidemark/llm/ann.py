"""Approximate nearest neighbours by multiprobe p-stable hashing.

Largest inner product is reduced to smallest Euclidean distance by giving each
candidate the coordinate sqrt(M^2 - |x|^2), M being the largest norm. A table
hashes a vector to the cells floor((a . x + b) / w) of a few Gaussian
(2-stable) directions, made orthogonal. A query visits the cells of each table
in the order of their estimated success: how likely a near vector falls into
the cell against how likely any vector does, which favours cells next to the
query and beyond. Both follow from the mean and the covariance of all vectors
with their added coordinate: a near vector is one whose inner product with the
query is as large as only ``k`` of all are. It visits cells until they hold a
share of all candidates. That share is fitted: the true neighbours of at most
``fit_queries`` queries among all vectors tell how far each of them must go, and
the share that finds ``recall`` of them is taken for all. The candidates of all
tables are reranked by the exact inner product of the original vectors in double
precision.

Equal vectors are one class in the index, with its smallest ``k + 1``
identifiers: no others can be among the k nearest; each task keeps only these of
the copies that it meets. Cells with many classes are dealt out in blocks of
bounded size, so no bucket lands in one task, and those that are not told apart
(beyond ``max_cells``) in blocks that every query visits.

The directions, offsets and the table of cell counts are all that is sent to
tasks; their sizes are set by the parameters (``max_cells``), not the input.

Defined results: vectors that are null, empty, zero or hold a null or
non-finite component take no part, as queries or as candidates; so do those of
another length than most have. Repeated identifiers are candidates of their
own; a query's own identifier never is one. Queries that share an identifier are
searched each and share one list of the k best. An empty table gives an empty
result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil
from statistics import NormalDist

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import stored, work_dir


def usable(vector: Column) -> Column:
    """Whether a vector takes part."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.coalesce(vector.isNotNull() & finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def _classes(vectors: DataFrame, k: int) -> DataFrame:
    """One row per distinct vector: class_id (its smallest id), ids (the smallest k + 1), v."""
    own = Window.partitionBy("v").orderBy("id")
    first = vectors.withColumn("rn", F.row_number().over(own)).where(F.col("rn") <= k + 1)
    return first.groupBy("v").agg(F.array_sort(F.collect_list("id")).alias("ids")).select(F.col("ids")[0].alias("class_id"), "ids", "v")


class Tables:
    """Hash functions of all tables, and how to order cells for a query.

    ``unit`` scales vectors, ``top`` is their largest norm then, ``mean`` and ``cov``
    are those of all scaled vectors with the added coordinate, and ``z`` says by how
    many deviations a near vector's inner product exceeds the mean.
    """

    def __init__(self, n_tables: int, n_functions: int, width: float, unit: float, top: float, mean: np.ndarray, cov: np.ndarray, z: float, seed: int):
        rng = np.random.default_rng(seed)
        self.unit, self.top, self.mean, self.cov, self.z = unit, top, mean, cov, z
        self.a = [np.linalg.qr(rng.standard_normal((len(mean), n_functions)))[0] for _ in range(n_tables)]
        # the spread of the data along each direction sets its cells' width
        self.sd = [np.sqrt(np.maximum(np.einsum("ij,ik,kj->j", a, cov, a), 1e-18)) for a in self.a]
        self.w = [width * s for s in self.sd]
        self.b = [rng.uniform(0, 1, n_functions) * w for w in self.w]

    def cells(self, x: np.ndarray, table: int) -> np.ndarray:
        """The cell number (64 bits) of each candidate."""
        away = lifted(x / self.unit, self.top) - self.mean
        at = np.floor((away @ self.a[table] + self.b[table]) / self.w[table]).astype(np.int64)
        code = np.zeros(len(x), np.int64)
        for j in range(at.shape[1]):
            code = code * 64 + np.clip(at[:, j] + 32, 0, 63)
        return code

    def gains(self, q: np.ndarray, codes: np.ndarray, table: int) -> np.ndarray:
        """(queries, cells): log of the chance of a near vector in the cell against that of any vector."""
        a, b, w, sd = self.a[table], self.b[table], self.w[table], self.sd[table]
        n = a.shape[1]
        way = q / self.unit
        way = np.column_stack((way / np.sqrt((way * way).sum(axis=1))[:, None], np.zeros(len(q))))
        along = np.sqrt(np.maximum(np.einsum("qi,ij,qj->q", way, self.cov, way), 1e-18))
        shared = way @ self.cov @ a / along[:, None]  # covariance with the inner product, in its deviations
        total = np.zeros((len(q), len(codes)))
        grid = np.arange(-32, 32)
        for j in range(n):
            low, high = grid * w[j] - b[j], (grid + 1) * w[j] - b[j]
            low[0], high[-1] = -np.inf, np.inf
            near = np.sqrt(np.maximum(sd[j] ** 2 - shared[:, j] ** 2, (0.05 * sd[j]) ** 2))[:, None]
            middle = self.z * shared[:, j][:, None]
            chance = _normal((high - middle) / near) - _normal((low - middle) / near)
            base = _normal(high / sd[j]) - _normal(low / sd[j])
            ratio = np.log(np.maximum(chance, 1e-12)) - np.log(np.maximum(base, 1e-12))
            total += ratio[:, (codes // 64 ** (n - 1 - j)) % 64]
        return total


def lifted(x: np.ndarray, top: float) -> np.ndarray:
    """Vectors with the coordinate that makes all norms equal."""
    return np.column_stack((x, np.sqrt(np.maximum(top**2 - (x * x).sum(axis=1), 0))))


def _normal(z: np.ndarray) -> np.ndarray:
    """The normal distribution function, to about 1e-4 (a logistic form): it only orders cells."""
    z = np.clip(z, -8, 8)
    return 1 / (1 + np.exp(-(1.5976 * z + 0.070566 * z**3)))


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1) if len(column) else np.empty((0, 0))


def nearest(
    vectors: DataFrame,
    queries: DataFrame,
    k: int = 20,
    n_tables: int = 2,
    n_functions: int = 6,
    width: float = 2.0,
    recall: float = 0.95,
    fit_queries: int = 128,
    block_rows: int = 16384,
    query_rows: int = 4096,
    max_cells: int = 65536,
    seed: int = 29,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
) -> DataFrame:
    """Rows (query_id, rank, id, score): the k nearest candidates found for each query."""
    spark = vectors.sparkSession
    work = work_dir(spark, "ann")
    kind = vectors.schema[id_col].dataType.simpleString()
    out_schema = f"query_id {kind}, rank int, {id_col} {kind}, score double"

    def prepared(df: DataFrame) -> DataFrame:
        v = F.col(vector_col).cast("array<double>")
        return df.select(F.col(id_col).alias("id"), v.alias("v")).where(usable(F.col("v")))

    largest = F.max(F.array_max(F.transform("v", F.abs)))
    sizes = prepared(vectors).groupBy(F.size("v").alias("d")).agg(F.count(F.lit(1)).alias("n"), largest.alias("unit")).orderBy(F.desc("n"), "d").limit(1).collect()
    if not sizes:
        return spark.createDataFrame([], out_schema)
    dims, unit = sizes[0].d, sizes[0].unit
    candidates = prepared(vectors).where(F.size("v") == dims)
    asked = prepared(queries).where(F.size("v") == dims)
    classes = stored(_classes(candidates, k), f"{work}/classes")
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + (x / F.lit(unit)) * (x / F.lit(unit))))
    top = classes.agg(F.max(norm).alias("top")).first().top * (1 + 1e-12)

    # sums and products over all classes: (dims + 1) x (dims + 2) numbers a partition
    def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros((dims + 1, dims + 2)), 0
        for batch in batches:
            x = _matrix(batch.column("v"))
            if len(x):
                x = lifted(x / unit, top)
                total[:, 1:] += x.T @ x
                total[:, 0] += x.sum(axis=0)
                n += len(x)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(total.size)), pa.array(total.ravel()), pa.array(np.full(total.size, n))], ["at", "s", "n"])

    found = classes.select("v").mapInArrow(moments, "at long, s double, n long")
    rows = found.groupBy("at").agg(F.sum("s").alias("s"), F.sum("n").alias("n")).collect()
    total, n_classes = np.zeros((dims + 1) * (dims + 2)), rows[0]["n"]
    for r in rows:
        total[r["at"]] = r["s"] / n_classes
    total = total.reshape(dims + 1, dims + 2)
    mean, cov = total[:, 0], total[:, 1:] - np.outer(total[:, 0], total[:, 0])
    z = NormalDist().inv_cdf(min(1 - 1e-12, max(0.7, 1 - k / n_classes)))
    tables = Tables(n_tables, n_functions, width, unit, top, mean, cov, z, seed)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(batch.column("v"))
            for t in range(n_tables):
                if len(x):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(x), t, np.int32)), pa.array(tables.cells(x, t)), *(batch.column(c) for c in ("class_id", "ids", "v"))],
                        ["t", "cell", "class_id", "ids", "v"],
                    )

    index = stored(classes.select("class_id", "ids", "v").mapInArrow(place, f"t int, cell long, class_id {kind}, ids array<{kind}>, v array<double>"), f"{work}/index")
    counts = stored(index.groupBy("t", "cell").agg(F.count(F.lit(1)).alias("n")), f"{work}/cells")
    # at most max_cells cells a table are told apart
    held = counts.withColumn("rn", F.row_number().over(Window.partitionBy("t").orderBy(F.desc("n"), "cell"))).where(F.col("rn") <= max_cells).drop("rn")
    cells = {t: ([], []) for t in range(n_tables)}
    for r in held.orderBy("t", "cell").collect():
        cells[r.t][0].append(r.cell)
        cells[r.t][1].append(r.n)
    cells = {t: (np.array(c, np.int64), np.array(n, np.int64)) for t, (c, n) in cells.items()}
    block_rows = min(block_rows, max(1024, ceil(n_classes / 16)))
    # neighbouring cells go into one block until it is full; full cells into several; the rest into blocks of its own
    blocks, rest = {}, {}
    for t, (_, n) in cells.items():
        blocks[t] = (np.cumsum(n) - n) // block_rows
        rest[t] = ceil((n_classes - int(n.sum())) / block_rows)
    wanted = max(_fitted(classes, asked, tables, cells, k, recall, fit_queries), min(n_classes, 4 * k))
    sent = spark.sparkContext.broadcast((tables, cells, blocks, rest))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, cells, blocks, rest = sent.value
        for batch in batches:
            t, cell, h = (batch.column(c).to_numpy() for c in ("t", "cell", "h"))
            block = np.full(len(t), -1, np.int64)
            for table, (codes, n) in cells.items():
                mine = np.flatnonzero(t == table)
                at = np.minimum(np.searchsorted(codes, cell[mine]), len(codes) - 1)
                known = codes[at] == cell[mine]
                turn = h[mine] % np.maximum(1, -(-n[at] // block_rows))
                block[mine] = np.where(known, blocks[table][at] + turn, -1 - h[mine] % max(1, rest[table]))
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in ("t",)), pa.array(block), *(batch.column(c) for c in ("cell", "class_id", "ids", "v"))],
                ["t", "block", "cell", "class_id", "ids", "v"],
            )

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables, cells, blocks, rest = sent.value
        for batch in batches:
            for part in range(0, batch.num_rows, 128):
                some = batch.slice(part, 128)
                q = _matrix(some.column("v"))
                for t, (codes, n) in cells.items():
                    gain = tables.gains(q, codes, t)
                    order = np.argsort(-gain, axis=1, kind="stable")
                    before = np.cumsum(n[order], axis=1) - n[order]
                    visit = before < wanted
                    rows, b, seen = [], [], []
                    for r in range(len(q)):
                        mine = order[r][visit[r]]
                        first, last = blocks[t][mine], blocks[t][mine] + np.maximum(1, -(-n[mine] // block_rows)) - 1
                        pairs: dict[int, list[int]] = {-1 - x: [] for x in range(rest[t])}
                        for c, lo, hi in zip(mine.tolist(), first.tolist(), last.tolist()):
                            for x in range(lo, hi + 1):
                                pairs.setdefault(x, []).append(int(codes[c]))
                        rows += [r] * len(pairs)
                        b += list(pairs)
                        seen += list(pairs.values())
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(np.full(len(rows), t, np.int32)),
                            pa.array(b, pa.int64()),
                            some.column("id").take(pa.array(rows, pa.int32())),
                            pa.array(seen, pa.list_(pa.int64())),
                            some.column("v").take(pa.array(rows, pa.int32())),
                        ],
                        ["t", "block", "query_id", "visited", "v"],
                    )

    hashed = index.withColumn("h", F.xxhash64("class_id").bitwiseAND(F.lit(0x7FFFFFFF)))
    dealt = hashed.mapInArrow(deal, f"t int, block long, cell long, class_id {kind}, ids array<{kind}>, v array<double>")
    # a block meets at most about query_rows queries at once: with more queries, it is sent to several tasks
    turns = max(1, ceil(asked.count() * max(wanted / n_classes, 0.05) / query_rows))
    probes = asked.mapInArrow(probe, f"t int, block long, query_id {kind}, visited array<long>, v array<double>").withColumn(
        "turn", F.pmod(F.xxhash64("query_id"), F.lit(turns)).cast("int")
    )
    # a block goes only to the turns of which some query visits it
    visits = stored(probes.select("t", "block", "turn").distinct(), f"{work}/visits")
    dealt = dealt.join(visits, ["t", "block"])

    def rerank(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        """The k best of one block for each query that visits it."""
        if left.empty or right.empty:
            return pd.DataFrame({"query_id": [], id_col: [], "score": []})
        x, owners, cell = np.stack(left["v"].to_numpy()), left["ids"].to_numpy(), left["cell"].to_numpy()
        at_block = int(left["block"].iloc[0])
        kinds, kind_of = np.unique(cell, return_inverse=True)
        out_q, out_i, out_s = [], [], []
        for part in range(0, len(right), 256):
            some = right.iloc[part : part + 256]
            scores = np.stack(some["v"].to_numpy()) @ x.T
            for r, (query, visited) in enumerate(zip(some["query_id"], some["visited"])):
                mine = np.flatnonzero(np.isin(kinds, visited)[kind_of]) if at_block >= 0 else np.arange(len(cell))
                s = scores[r, mine]
                if len(s) > k + 1:
                    cut = np.partition(s, len(s) - k - 1)[len(s) - k - 1]
                    mine, s = mine[s >= cut - 1e-9], s[s >= cut - 1e-9]
                pairs = sorted((-v, i) for m, v in zip(mine.tolist(), s.tolist()) for i in owners[m] if i != query)[: k + 4]
                out_q += [query] * len(pairs)
                out_i += [i for _, i in pairs]
                out_s += [-v for v, _ in pairs]
        return pd.DataFrame({"query_id": out_q, id_col: out_i, "score": out_s})

    found = (
        dealt.groupBy("t", "block", "turn").cogroup(probes.groupBy("t", "block", "turn")).applyInPandas(rerank, f"query_id {kind}, {id_col} {kind}, score double")
    )
    merged = found.groupBy("query_id", id_col).agg(F.max("score").alias("near"))
    return _exact(merged, asked, candidates, k, id_col)


def _fitted(classes: DataFrame, asked: DataFrame, tables: Tables, cells: dict, k: int, recall: float, fit_queries: int) -> int:
    """How many candidates of each table a query visits, so that ``recall`` of the true neighbours of some queries are found.

    At most ``fit_queries`` queries, those of least hash, are compared with all vectors; each task returns the k + 1 best
    of each query, so ``fit_queries * (k + 1)`` rows reach the driver.
    """
    some = asked.orderBy(F.xxhash64("id"), "id").limit(fit_queries).collect()
    if not some:
        return 1
    q = np.array([r.v for r in some])
    names = [r.id for r in some]
    n_tables = len(tables.a)

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        top: list[list[tuple[float, list[int], list]]] = [[] for _ in names]
        for batch in batches:
            x = _matrix(batch.column("v"))
            if not len(x):
                continue
            scores, owners = q @ x.T, batch.column("ids")
            codes = np.column_stack([tables.cells(x, t) for t in range(n_tables)])
            for i in range(len(names)):
                s = scores[i]
                keep = np.argpartition(-s, k)[: k + 1] if len(s) > k + 1 else np.arange(len(s))
                top[i] += [(float(s[m]), codes[m].tolist(), owners[int(m)].as_py()) for m in keep.tolist()]
                top[i] = sorted(top[i], key=lambda c: -c[0])[: k + 1]
        flat = [(i, *c) for i, found in enumerate(top) for c in found]
        n_ids = [sum(o != names[i] for o in owned) for i, _, _, owned in flat]
        yield pa.RecordBatch.from_arrays(
            [pa.array([f[0] for f in flat], pa.int32()), pa.array([f[1] for f in flat], pa.float64()), pa.array([f[2] for f in flat], pa.list_(pa.int64())), pa.array(n_ids, pa.int32())],
            ["q", "score", "cells", "n"],
        )

    found = classes.select("ids", "v").mapInArrow(best, "q int, score double, cells array<long>, n int").where("n > 0")
    first = Window.partitionBy("q").orderBy(F.desc("score"))
    found = found.withColumn("rn", F.row_number().over(first)).where(F.col("rn") <= k).orderBy("q", "rn").collect()
    needs, left = [], [k] * len(names)
    order = {}
    for t, (codes, n) in cells.items():
        gain = tables.gains(q, codes, t)
        ranked = np.argsort(-gain, axis=1, kind="stable")
        before = np.empty_like(ranked)
        np.put_along_axis(before, ranked, np.cumsum(n[ranked], axis=1) - n[ranked], axis=1)
        order[t] = before
    for r in found:
        need = None
        for t, (codes, _) in cells.items():
            at = min(int(np.searchsorted(codes, r.cells[t])), len(codes) - 1)
            go = int(order[t][r.q, at]) + 1 if codes[at] == r.cells[t] else 0
            need = go if need is None else min(need, go)
        weight = min(r.n, left[r.q])
        left[r.q] -= weight
        needs += [need] * weight
    return int(np.quantile(needs, recall, method="higher")) if needs else 1


def _exact(found: DataFrame, asked: DataFrame, candidates: DataFrame, k: int, id_col: str) -> DataFrame:
    """Rank by the inner product of the original vectors, summed in order in double precision."""
    most = Window.partitionBy("query_id").orderBy(F.desc("near"), id_col)
    few = found.withColumn("rn", F.row_number().over(most)).where(F.col("rn") <= 2 * k).drop("rn")
    q = asked.select(F.col("id").alias("query_id"), F.col("v").alias("qv"))
    c = candidates.select(F.col("id").alias(id_col), F.col("v").alias("cv"))
    product = F.aggregate(F.zip_with("qv", "cv", lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x)
    scored = few.join(c, id_col).join(q, "query_id").select("query_id", id_col, product.alias("score"))
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), id_col)
    return scored.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", id_col, "score")
