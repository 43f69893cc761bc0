"""The corpus pipeline from end to end on small tables."""

import random
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

pytest.importorskip("tidemark.llm")
corpus_pipeline = pytest.importorskip("corpus_pipeline")

from tidemark.llm import common, packing, quality, simhash  # noqa: E402
from tidemark.llm.common import stored, work_dir  # noqa: E402
from tidemark.llm.queries import tokenizer_path  # noqa: E402

DOCS = "doc_id long, text string, lang string, source string, n_chars long, repeats string, kept boolean, root long, k int"
RNG = random.Random(23)
GOOD = ["".join(RNG.choice("abcdefgh") for _ in range(RNG.randint(2, 8))) for _ in range(400)]
BAD = ["".join(RNG.choice("qrstuvw") for _ in range(RNG.randint(2, 8))) for _ in range(400)]


def folder(spark, texts, labels):
    """texts: rows (doc_id, text, source)."""
    path = work_dir(spark, "pipeline-test")
    spark.createDataFrame([(i, t, None, s, None, "r", None, None, 1) for i, t, s in texts], DOCS).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int").write.parquet(f"{path}/labels.parquet")
    return path


def test_pipeline_of_odd_rows(spark):
    words = lambda of, n: " ".join(RNG.choice(of) for _ in range(n))
    texts = [(i, words(GOOD if i % 3 else BAD, 80), RNG.choice(["a", "b", None])) for i in range(300)]
    labels = [(i, int(i % 3 > 0)) for i in range(300)] + [(None, 1), (7, None)]
    long = words(GOOD, 9000)
    edited = texts[1][1].split()
    edited[40] = "changed"
    texts += [(500, long, "a"), (501, long, "b"), (None, long, None), (None, texts[2][1], "a"), (2, words(GOOD, 50), "a"), (502, " ".join(edited), "b"), (503, None, "a"), (504, "", None), (505, " ", None)]
    path = folder(spark, texts, labels)
    rows = corpus_pipeline.run(spark, path).collect()
    # the same stages in plain Python
    docs = spark.read.parquet(f"{path}/documents.parquet")
    weights = quality.scoring_weights(quality.labelled_rows(docs, spark.read.parquet(f"{path}/labels.parquet"), "quality"))
    kept = []
    for i, text, source in texts:
        index, value = quality.features(text or "", 18)
        if 1 / (1 + np.exp(-(weights[index] @ value + weights[-1]))) >= 0.7:
            kept.append((i, text, source))
    good = {i for i, *_ in kept}
    assert len(good & set(range(300))) > 150 and not any(i is not None and i < 300 and i % 3 == 0 for i in good)
    by_text = {}
    for row in kept:
        by_text.setdefault(row[1] or "", []).append(row)
    single = [max(same, key=lambda r: -1 if r[0] is None else r[0]) for same in by_text.values()]
    sets = [set(simhash.shingle_hashes(r[1] or "", 5).tolist()) for r in single]
    dropped = set()
    for x in range(len(single)):
        for y in range(x):
            if sets[x] and len(sets[x] & sets[y]) >= 0.8 * len(sets[x] | sets[y]):
                dropped.add(max(x, y, key=lambda n: (single[n][0] is None, single[n][0] or 0)))
    assert len(dropped) == 1
    left = [r for n, r in enumerate(single) if n not in dropped]
    encoder = packing.Encoder(tokenizer_path("byte_bpe_50k.json"))
    crcs = {zlib.crc32(encoder.whole(t or "") + bytes(4)) for _, t, _ in left}
    whole = {}
    for r in rows:
        whole.setdefault((r.doc_id, r.doc_tokens), []).append(r)
    assert {r.ids_crc32 for r in rows if r.length == r.doc_tokens} <= crcs
    taken = Counter((i, n) for (i, n), pieces in whole.items() for _ in range(sum(p.length for p in pieces) // n))
    lengths = Counter((i, len(encoder.whole(t or "")) // 4 + 1) for i, t, _ in left)
    assert set(taken) <= set(lengths) and all(n <= 2 * lengths[k] for k, n in taken.items())
    total = sum(len((t or "").split()) for _, t, _ in left)
    got = sum(n * len(next(t or "" for i, t, _ in left if (i, len(encoder.whole(t or "")) // 4 + 1) == k).split()) for k, n in taken.items())
    assert got == pytest.approx(1.5 * total, rel=0.1)


@pytest.mark.parametrize("texts", [[], [(1, None, None)], [(None, "same words here", "a")] * 5])
def test_pipeline_of_little(spark, texts):
    path = folder(spark, texts, [(1, 1), (2, 1)] if texts else [])
    ids = {r.doc_id for r in corpus_pipeline.run(spark, path).collect()}
    assert ids <= {i for i, *_ in texts}


def test_stages_keep_the_columns(spark):
    path = folder(spark, [(i, f"{i} some words", "a") for i in range(6)], [(i, 1) for i in range(6)])
    docs = spark.read.parquet(f"{path}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, path)
        assert out.columns == docs.columns
        docs = stored(out, work_dir(spark, "stage"))


def test_workers_keep_nothing_of_the_quality_stage(spark):
    docs = spark.createDataFrame([(i, f"{i} some words") for i in range(2000)], "doc_id long, text string").repartition(4)
    weights = np.zeros((1 << 18) + 1)
    weights[-1] = 2.0
    assert quality.keep_good(docs, weights).count() == 2000

    def kept(batches):
        for batch in batches:
            sizes = [len(common._KEPT.get("quality", {}))] * batch.num_rows
            yield pa.RecordBatch.from_arrays([pa.array(sizes, pa.int64())], ["id"])

    assert {r.id for r in spark.range(8, numPartitions=4).mapInArrow(kept, "id long").collect()} == {0}
