"""Quality classifier: hashed word n-gram logistic regression trained by FTRL.

Features are hashed words and word pairs of the lower-cased text with counts
damped by log1p and the vector scaled to unit length. Training takes a bounded,
documented sample of the labelled rows (``train_docs`` in expectation, chosen by
a hash of the identifier). Shards of the sample are trained side by side with
follow-the-regularised-leader updates, each in its own task, and their weights
are averaged by feature. The model has a fixed size (``2 ** bits`` weights), so
it is sent to every task; scoring is a sparse dot product per document.

Defined results: null text counts as empty and scores by the bias alone; rows
with a null label or identifier are not trained on; repeated rows are scored
each; without labels of both kinds every score is the share of label 1 (the bias
is its log-odds, 1e-6 away from 0 and 1), or 0.5 if there is none; other columns
are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import give_back, kept_for, stored, whole_text, work_dir

_MIX = 0x9E3779B97F4A7C15
#: Words whose hashes a worker keeps for the next time.
_MEMO_ENTRIES = 200_000
#: Rows of a batch whose texts are Python strings at a time.
_AT_ONCE = 512


def _word_hash(word: str, known: dict[str, int]) -> int:
    if len(known) >= _MEMO_ENTRIES:
        known.clear()
    h = known[word] = crc32(word.encode("utf-8", "surrogatepass"))
    return h


def features(text: str, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Indices and values of the text's hashed word n-grams (n = 1, 2), of unit length."""
    words = text.lower().split()
    if not words:
        return np.empty(0, np.int64), np.empty(0)
    known = kept_for("quality")
    hashes = np.fromiter((known[w] if w in known else _word_hash(w, known) for w in words), np.uint64, len(words))
    with np.errstate(over="ignore"):
        one = hashes * np.uint64(_MIX)
        two = (hashes[:-1] * np.uint64(31) + hashes[1:]) * np.uint64(_MIX) + np.uint64(1)
    slot = (np.concatenate((one, two)) >> np.uint64(64 - bits)).astype(np.int64)
    index, count = np.unique(slot, return_counts=True)
    value = np.log1p(count)
    return index, value / np.sqrt(value @ value)


class Ftrl:
    """FTRL-proximal for logistic loss; the last weight is the bias."""

    def __init__(self, bits: int, alpha: float, beta: float, l1: float, l2: float):
        self.z, self.n = np.zeros((1 << bits) + 1), np.zeros((1 << bits) + 1)
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2

    def weights(self, index: np.ndarray | slice = slice(None)) -> np.ndarray:
        z, n = self.z[index], self.n[index]
        w = -(z - np.sign(z) * self.l1) / ((self.beta + np.sqrt(n)) / self.alpha + self.l2)
        return np.where(np.abs(z) <= self.l1, 0.0, w)

    def learn(self, index: np.ndarray, value: np.ndarray, label: float) -> None:
        w = self.weights(index)
        p = 1 / (1 + np.exp(-np.clip(w @ value, -35, 35)))
        g = (p - label) * value
        n = self.n[index]
        self.z[index] += g - (np.sqrt(n + g * g) - np.sqrt(n)) / self.alpha * w
        self.n[index] = n + g * g


def train(
    labelled: DataFrame,
    train_docs: int = 20_000,
    shard_docs: int = 2_500,
    bits: int = 18,
    epochs: int = 10,
    alpha: float = 2.0,
    beta: float = 1.0,
    l1: float = 0.05,
    l2: float = 0.01,
) -> tuple[np.ndarray, float]:
    """Weights (bias last) and the share of label 1, from rows (id, text, label) of a bounded sample."""
    spark = labelled.sparkSession
    labelled = labelled.where("id IS NOT NULL AND label IS NOT NULL")
    counts = {r.label: r.n for r in labelled.groupBy((F.col("label") == 1).cast("int").alias("label")).agg(F.count(F.lit(1)).alias("n")).collect()}
    total = sum(counts.values())
    size = (1 << bits) + 1
    if min(counts.get(0, 0), counts.get(1, 0)) == 0:
        return np.zeros(size), (counts.get(1, 0) / total if total else 0.5)
    share = min(1.0, train_docs / total)
    shards = max(1, round(min(total, train_docs) / shard_docs))
    place = F.pmod(F.xxhash64(F.col("id").cast("string"), F.lit(7)), F.lit(1 << 20)) / float(1 << 20)
    shard = F.pmod(F.xxhash64(F.col("id").cast("string"), F.lit(8)), F.lit(shards)).cast("int")
    sample = labelled.where(place < share).select("id", "text", (F.col("label") == 1).cast("double").alias("label"), shard.alias("shard"))
    def learn(rows: pd.DataFrame) -> pd.DataFrame:
        model = Ftrl(bits, alpha, beta, l1, l2)
        rows = rows.sort_values(["id", "text", "label"])  # rows of one id come in one order whatever the shuffle
        examples = []
        for text, label in zip(rows["text"], rows["label"]):
            index, value = features(text, bits)
            examples.append((np.append(index, size - 1), np.append(value, 1.0).astype(np.float32), label))
        order = np.random.default_rng(13)
        for _ in range(epochs):
            for k in order.permutation(len(examples)):
                index, value, label = examples[k]
                model.learn(index, value, label)
        w = model.weights()
        at = np.flatnonzero(w)
        del examples, model
        give_back()
        return pd.DataFrame({"feature": at, "w": w[at]})

    found = sample.groupBy("shard").applyInPandas(learn, "feature long, w double")
    # a feature that a shard has not got counts as 0 there
    mean = stored(found.groupBy("feature").agg(F.sum("w").alias("w"), F.count(F.lit(1)).alias("n")), work_dir(spark, "quality-model"))
    weights = np.zeros(size)
    for r in mean.collect():  # at most 2 ** bits + 1 rows, whatever the input
        weights[r.feature] = r.w / shards
    return weights, counts[1] / total


def scoring_weights(labelled: DataFrame) -> np.ndarray:
    """Weights to score with: those of ``train``, or the share of label 1 as a bias where labels are of one kind."""
    weights, share = train(labelled)
    if share in (0, 1):
        held = np.clip(share, 1e-6, 1 - 1e-6)
        weights[-1] = np.log(held / (1 - held))
    return weights


def score(docs: DataFrame, weights: np.ndarray, bits: int = 18, id_col: str = "doc_id", text_col: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
    """Rows (id, carried columns, score): the probability of label 1."""
    rows = docs.select(F.col(id_col).alias("id"), *carry, whole_text(text_col).alias("text"))
    sent = docs.sparkSession.sparkContext.broadcast(weights.astype(np.float64))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = sent.value
        for batch in batches:
            raw = []
            for text in batch.column("text").to_pylist():
                index, value = features(text, bits)
                raw.append(w[index] @ value + w[-1])
            p = 1 / (1 + np.exp(-np.clip(np.array(raw, np.float64), -35, 35)))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("id", *carry)), pa.array(p)], ["id", *carry, "score"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name != "text")
    return rows.mapInArrow(run, f"{schema}, score double").withColumnRenamed("id", id_col)


def keep_good(docs: DataFrame, weights: np.ndarray, threshold: float = 0.7, bits: int = 18, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that score at least ``threshold``, columns as given; no row is shuffled."""
    sent = docs.sparkSession.sparkContext.broadcast(weights.astype(np.float64))
    least = np.log(threshold / (1 - threshold))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = sent.value
        for batch in batches:
            for at in range(0, batch.num_rows, _AT_ONCE):
                some, good = batch.slice(at, _AT_ONCE), []
                for text in some.column(text_col).to_pylist():
                    index, value = features(text or "", bits)
                    good.append(bool(w[index] @ value + w[-1] >= least))
                yield some.filter(pa.array(good, pa.bool_()))
        batch = some = None
        kept_for("quality").clear()
        give_back()

    return docs.mapInArrow(run, docs.schema)


def held_out(id_col: str = "doc_id"):
    """Rows whose crc32 of the identifier as text leaves 2 modulo 4: never trained on."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def labelled_rows(docs: DataFrame, labels: DataFrame, label_col: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (id, text, label) that may be learned from."""
    names = labels.select(F.col(id_col).alias("label_id"), F.col(label_col).alias("label")).where("label IS NOT NULL")
    texts = docs.where(~held_out(id_col)).select(F.col(id_col).alias("id"), whole_text(text_col).alias("text"))
    return texts.join(names, F.col("id") == F.col("label_id")).select("id", "text", "label")
