"""Order-preserving packing of token sequences by dynamic programming.

The documents of a partition, each followed by an end id, form a stream in
their given order. The stream is cut into windows of at most ``window`` ids.
Cuts are wanted at document ends, are cheap at sentence ends and dearer
elsewhere; a window shorter than ``window`` is padded, unless its length is a
power of two. The cheapest cuts come from a dynamic program over the places
where a cut makes sense: since padding is linear in the window's start, the
best start is the minimum over a sliding range, which a monotone queue keeps.

The stream is packed in blocks of documents, so memory holds one block, and
every partition on its own, so nothing is shuffled; the rest of a block is cut
into powers of two, which need no padding. Sequence numbers combine the
partition's number and a counter: the same partitions give the same rows again
after an executor is lost.

Token ids are those of the tokenizer on the whole text. Text is encoded in
units that begin at a space which follows a character other than white space:
the byte-level pre-tokenizer always ends a pre-token there, so units are
independent and their ids are kept for the next time. Texts with an added
token's string, or with a unit that ends in white space, are encoded whole.

Defined results: a null or empty text has only the end id; repeated rows are
packed each; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from array import array
from collections import deque
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import kept_for, whole_text

SENTENCE_COST, CUT_COST = 2.0, 6.0
#: Elsewhere, places for a cut lie so far apart.
GRID = 64
#: Documents are packed together up to so many ids.
BLOCK_IDS = 1 << 18
#: Units kept for the next time; those met first, so the frequent ones.
_MEMO_ENTRIES = 600_000
#: Letters of ASCII and Latin-1, a mark or none; and two of these around a line break.
_WORD = r"([A-Za-zÀ-ÖØ-öø-ÿ]+)([.,]?)"
_WORDS = re.compile(rf"{_WORD}(?:(\n){_WORD})?")
#: How a byte-level vocabulary writes bytes: printable ones as themselves, the others from 256 on.
_PRINTED = {*range(33, 127), *range(161, 173), *range(174, 256)}
_WRITTEN = {b: b if b in _PRINTED else 256 + sum(c not in _PRINTED for c in range(b)) for b in range(256)}


class Encoder:
    """Ids of whole texts as little-endian 32-bit bytes, by the tokenizers library."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.model = Tokenizer.from_file(path)
        self.added = [t.content for t in self.model.get_added_tokens_decoder().values()]
        self.marks = {m: self.model.token_to_id(w) for m, w in ((".", "."), (",", ","), ("\n", "Ċ"))}
        self.memo: dict[str, bytes] = {}

    def whole(self, text: str) -> bytes:
        return array("I", self.model.encode(text, add_special_tokens=False).ids).tobytes()

    def _letters(self, text: str) -> list[int]:
        """Ids of one pre-token."""
        return [t.id for t in self.model.model.tokenize(text.encode().decode("latin-1").translate(_WRITTEN))]

    def _unit(self, unit: str) -> bytes | None:
        """Ids of a unit after its space; None if it cannot be encoded on its own."""
        if words := _WORDS.fullmatch(unit):  # each part is a pre-token: no need to find these
            first, mark, line, second, last = words.groups()
            ids = self._letters(" " + first)
            for part in (mark, line, second, last):
                if part:
                    ids += [self.marks[part]] if part in self.marks else self._letters(part)
            return array("I", ids).tobytes()
        return None if not unit or unit[-1].isspace() else self.whole(" " + unit)

    def _learn(self, units: set[str]) -> dict[str, bytes] | None:
        """Ids of units not met before; None if one of them cannot be encoded on its own."""
        found = {}
        for unit in units:
            if (ids := self._unit(unit)) is None:
                return None
            found[unit] = ids
        if len(self.memo) < _MEMO_ENTRIES:
            self.memo.update((u, i) for u, i in found.items() if len(u) <= 64)
        return found

    def encode(self, text: str) -> bytes:
        if not text:
            return b""
        if any(a in text for a in self.added):
            return self.whole(text)
        first, *units = text.split(" ")
        if not units or not first or first[-1].isspace():
            return self.whole(text)
        out = list(map(self.memo.get, units))
        if None in out:
            ids = self._learn({u for u, i in zip(units, out) if i is None})
            if ids is None:
                return self.whole(text)
            out = [ids[u] if i is None else i for u, i in zip(units, out)]
        return self.whole(first) + b"".join(out)

    @lru_cache(maxsize=1)
    def sentence_ids(self) -> np.ndarray:
        """The ids whose text ends a sentence."""
        marks = {self.model.token_to_id(s) for s in (".", "!", "?", ".ĊĊ", ".Ċ", "Ċ", "ĊĊ", "?\"", ".\"")}
        return np.array(sorted(m for m in marks if m is not None), np.uint32)


def _encoder(path: str) -> Encoder:
    kept = kept_for("packing")
    if path not in kept:
        kept[path] = Encoder(path)
    return kept[path]


def _padding(length: int, window: int) -> int:
    return 0 if length & (length - 1) == 0 else window - length


def window_cuts(places: list[int], costs: list[float], end: int, window: int) -> list[int]:
    """Cuts of least padding and truncation cost over the stream [0, end); the last is ``end``.

    ``places`` ascend in (0, end) and are at most ``window`` apart, as are 0 and the
    first; ``costs`` are what a cut there costs. After the last of the cuts so found,
    the rest is one window or powers of two at ``CUT_COST`` a cut.
    """
    total, came = [0.0], [-1]
    at = [0, *places]
    queue: deque[tuple[float, int]] = deque([(0.0, 0)])  # (cost so far + place, index), ascending
    for k in range(1, len(at)):
        here = at[k]
        while at[queue[0][1]] < here - window:
            queue.popleft()
        low, start = queue[0]
        cost = low + window - here + costs[k - 1]  # padding is window - (here - start)
        total.append(cost)
        came.append(start)
        value = cost + here
        while queue and queue[-1][0] >= value:
            queue.pop()
        queue.append((value, k))
    # the tail: from any place within a window of the end, powers of two
    finish = None
    for k in range(len(at) - 1, -1, -1):
        rest = end - at[k]
        if rest > window:
            break
        pieces = bin(rest).count("1")
        cost = total[k] + (0 if pieces <= 1 else min(_padding(rest, window), (pieces - 1) * CUT_COST))
        if finish is None or cost < finish[0]:
            finish = (cost, k)
    k, cuts = finish[1], [end]
    rest, here = end - at[k], at[k]
    if rest and _padding(rest, window) > (bin(rest).count("1") - 1) * CUT_COST:
        for bit in reversed(range(rest.bit_length())):
            if rest >> bit & 1:
                here += 1 << bit
                cuts.append(here)
    while k > 0:
        cuts.append(at[k])
        k = came[k]
    return sorted(set(cuts) - {0})


def _places(ids: np.ndarray, doc_ends: np.ndarray, stops: np.ndarray, window: int) -> tuple[list[int], list[float]]:
    """Where a cut makes sense, with its cost: document ends, sentence ends, and a grid."""
    end = int(doc_ends[-1])
    cost = np.full(end + 1, CUT_COST)
    sentence = np.flatnonzero(np.isin(ids, stops)) + 1
    cost[sentence] = SENTENCE_COST
    cost[doc_ends] = 0.0
    wanted = np.zeros(end + 1, bool)
    wanted[:: min(GRID, window)] = wanted[sentence] = wanted[doc_ends] = True
    wanted[0] = wanted[end] = False
    places = np.flatnonzero(wanted)
    return places.tolist(), cost[places].tolist()


def pack_block(docs: list[bytes], stops: np.ndarray, window: int) -> Iterator[tuple[int, int, int, int, int, int]]:
    """Pieces (document, start, length, crc32, sequence, offset) of documents given as id bytes."""
    stream = b"".join(docs)
    ids = np.frombuffer(stream, "<u4")
    doc_ends = np.cumsum([len(d) // 4 for d in docs])
    cuts = np.array(window_cuts(*_places(ids, doc_ends, stops, window), int(doc_ends[-1]), window))
    begins = np.unique(np.concatenate(([0], doc_ends, cuts)))
    stops_at = begins[1:]
    begins = begins[:-1]
    owner = np.searchsorted(doc_ends, begins, side="right")
    sequence = np.searchsorted(cuts, begins, side="right")
    doc_start = np.concatenate(([0], doc_ends[:-1]))[owner]
    seq_start = np.concatenate(([0], cuts[:-1]))[sequence]
    for d, a, b, s, ds, ss in zip(owner.tolist(), begins.tolist(), stops_at.tolist(), sequence.tolist(), doc_start.tolist(), seq_start.tolist()):
        yield d, a - ds, b - a, zlib.crc32(stream[4 * a : 4 * b]), s, a - ss


def pack(
    docs: DataFrame, tokenizer_path: str, window: int = 1024, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """One row per piece: id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    rows = docs.select(F.col(id_col).alias("id"), whole_text(text_col).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    closing = int(end_id).to_bytes(4, "little")
    names = ["start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(tokenizer_path)
        stops = encoder.sentence_ids()
        numbered = TaskContext.get().partitionId() << 36
        keys: list = []
        block: list[bytes] = []
        held = 0

        def flush() -> pa.RecordBatch:
            nonlocal numbered, held
            pieces = list(pack_block(block, stops, window))
            out = [
                pa.array([keys[p[0]] for p in pieces], id_type),
                *(pa.array([p[k] for p in pieces], pa.int64()) for k in (1, 2, 3)),
                pa.array([len(block[p[0]]) // 4 for p in pieces], pa.int64()),
                pa.array([numbered + p[4] for p in pieces], pa.int64()),
                pa.array([p[5] for p in pieces], pa.int64()),
            ]
            numbered += pieces[-1][4] + 1
            keys.clear()
            block.clear()
            held = 0
            return pa.RecordBatch.from_arrays(out, ["id", *names])

        for batch in batches:
            id_type = batch.schema.field("id").type
            for key, text in zip(batch.column("id").to_pylist(), batch.column("text").to_pylist()):
                keys.append(key)
                block.append(encoder.encode(text) + closing)
                held += len(block[-1]) // 4
                if held >= BLOCK_IDS:
                    yield flush()
        if block:
            yield flush()

    packed = rows.mapInArrow(run, f"id {kind}, " + ", ".join(f"{n} long" for n in names))
    return packed.select(F.col("id").alias(id_col), *names)
