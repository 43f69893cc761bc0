"""Token counts with overlap resynchronisation for huge documents.

Ordinary documents are encoded whole. A document of more than ``huge_chars``
characters becomes overlapping chunks that are dealt out over the cluster and
encoded on their own, with the offset of every token. Two neighbouring chunks
are spliced at a boundary that both encodings have and that is proven stable:
the characters on its two sides stand next to each other in no piece of the
vocabulary, so no merge can cross it, whatever stands around it. Where the
overlap holds no such boundary, or an encoding does not have it, the document is
done again with overlaps eight times as wide on both sides, up to the whole text.

Defined results: null text counts as empty (0 bytes, 0 tokens); repeated rows
are counted each; an empty table gives an empty result; other columns are
ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import LOCATOR, configured, located, stored, whole_text, work_dir

SPACE = "▁"  # how the model writes a space


@lru_cache(maxsize=2)
def _model(path: str):
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=path)


@lru_cache(maxsize=2)
def _inner_pairs(path: str) -> frozenset[str]:
    """Every two characters that stand next to each other in some piece of the vocabulary."""
    model = _model(path)
    pieces = (model.id_to_piece(i) for i in range(model.get_piece_size()) if not model.is_byte(i))
    return frozenset(p[k : k + 2] for p in pieces for k in range(len(p) - 1))


def first_stable(text: str, start: int, inner: frozenset[str]) -> int:
    """The first position from ``start`` on that no token can span; -1 if there is none."""
    if start <= 0:
        return 0
    for at in range(start, len(text)):
        if text[at - 1 : at + 1].replace(" ", SPACE) not in inner:
            return at
    return -1


def token_starts(text: str, path: str) -> list[int]:
    """The offset in characters of each token of the text, encoded on its own.

    The model maps characters one to one (identity normalisation) and puts a
    space before the text; a character outside the vocabulary is several byte
    tokens that all start where it does.
    """
    model = _model(path)
    starts, at, lead, rest = [], 0, 1, 0
    for i, piece in zip(model.encode(text), model.encode(text, out_type=str)):
        starts.append(max(0, at - lead))
        if not model.is_byte(i):
            at += len(piece)
            continue
        byte = int(piece[3:5], 16)
        rest = rest - 1 if rest else (0 if byte < 0x80 else 1 if byte < 0xE0 else 2 if byte < 0xF0 else 3)
        at += rest == 0
    return starts


def _count_chunk(text: str, begin: int, end: int, whole: bool, last: bool, path: str) -> int:
    """Tokens of ``text`` between the splices at or after ``begin`` and ``end``; -1 if it has no splice.

    ``whole``: the chunk reaches the end of its document; ``last``: no chunk follows.
    """
    inner = _inner_pairs(path)
    low = first_stable(text, begin, inner)
    high = len(text) if last else first_stable(text, end, inner)
    if high < 0:
        if not whole:
            return -1
        high = len(text)
    if low < 0 or low >= high:  # this chunk lies between two splices of its neighbours
        return 0
    starts = token_starts(text, path)
    if (low > 0 and low not in starts) or (high < len(text) and high not in starts):
        return -1
    return sum(low <= s < high for s in starts)


def cut(text: str, step: int, overlap: int) -> Iterator[tuple[str, int, int, bool, bool]]:
    """Chunks (text, begin, end, whole, last) of ``step`` characters with an overlap on both sides, in one pass.

    An overlap as wide as the text gives the text itself as its one chunk.
    """
    n = len(text)
    if overlap >= n:
        yield text, 0, n, True, True
        return
    for at in range(0, n, step):
        low, high = max(0, at - overlap), at + step + overlap
        yield text[low:high], at - low, at + step - low, high >= n, at + step >= n


def _count_whole(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = _model(path)
        for batch in batches:
            texts = batch.column("text").to_pylist()
            counts: list[int] = []
            for k in range(0, len(texts), 256):
                counts += map(len, model.encode(texts[k : k + 256], num_threads=1))
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), batch.column("n_bytes"), pa.array(counts, pa.int64())], ["id", "n_bytes", "n_tokens"]
            )

    return run


def _count_chunks(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.to_pylist()
            counts = [_count_chunk(r["text"], r["begin"], r["end"], r["whole"], r["last"], path) for r in rows]
            keys = [batch.column(c) for c in ("id", "n_bytes", *LOCATOR)]
            yield pa.RecordBatch.from_arrays([*keys, pa.array(counts, pa.int64())], ["id", "n_bytes", *LOCATOR, "n_tokens"])

    return run


def _chunks(huge: DataFrame, step: int, overlap: int) -> DataFrame:
    """Rows (id, n_bytes, LOCATOR, i, text, begin, end, whole, last): the chunks of each text."""
    keys = ["id", "n_bytes", *LOCATOR]
    kind = huge.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["text", "begin", "end", "whole", "last"]
        kinds = [pa.string(), pa.int64(), pa.int64(), pa.bool_(), pa.bool_()]
        for batch in batches:
            for r in range(batch.num_rows):
                one = batch.slice(r, 1)
                for i, chunk in enumerate(cut(one.column("text")[0].as_py(), step, overlap)):
                    yield pa.RecordBatch.from_arrays(
                        [*(one.column(c) for c in keys), pa.array([i], pa.int64()), *(pa.array([v], k) for v, k in zip(chunk, kinds))], [*keys, "i", *names]
                    )

    schema = f"id {kind}, n_bytes long, {LOCATOR[0]} string, {LOCATOR[1]} long, i long, text string, begin long, end long, whole boolean, last boolean"
    return huge.select(*keys, "text").mapInArrow(run, schema)


def token_counts(
    docs: DataFrame,
    model_path: str,
    limit: int = 4096,
    huge_chars: int = 65536,
    overlap_chars: int = 256,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """One row per document: id, n_bytes, n_tokens, over_limit."""
    work = work_dir(docs.sparkSession, "token-counts")
    rows = located(docs).select(F.col(id_col).alias("id"), whole_text(text_col).alias("text"), *LOCATOR)
    rows = rows.withColumn("n_bytes", F.octet_length("text").cast("long"))
    kind = rows.schema["id"].dataType.simpleString()
    is_huge = F.char_length("text") > huge_chars
    counted = (
        rows.where(~is_huge).select("id", "n_bytes", "text").mapInArrow(_count_whole(model_path), f"id {kind}, n_bytes long, n_tokens long")
    )
    todo, overlap, turn = rows.where(is_huge), max(1, overlap_chars), 0
    while True:
        schema = f"id {kind}, n_bytes long, {LOCATOR[0]} string, {LOCATOR[1]} long, n_tokens long"
        parts = _chunks(todo, huge_chars, overlap).repartition(*LOCATOR, "i").mapInArrow(_count_chunks(model_path), schema)
        sums = parts.groupBy("id", "n_bytes", *LOCATOR).agg(F.sum("n_tokens").alias("n_tokens"), F.min("n_tokens").alias("worst"))
        with configured(docs.sparkSession, {"spark.sql.execution.arrow.maxRecordsPerBatch": "64"}):
            sums = stored(sums, f"{work}/turn={turn}")
        counted = counted.unionByName(sums.where("worst >= 0").select("id", "n_bytes", "n_tokens"))
        left = sums.where("worst < 0").select(*LOCATOR)
        if left.isEmpty():
            break
        todo, overlap, turn = todo.join(left, list(LOCATOR), "left_semi"), overlap * 8, turn + 1
    return counted.select(F.col("id").alias(id_col), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
