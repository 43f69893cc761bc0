"""Benchmark decontamination by a generalised suffix automaton of the test items.

Texts are lower-cased (A-Z) and read as words: runs of ASCII letters and digits
and of characters beyond ASCII. The automaton holds every run of words of every
item. A document's words stream through it; the state and the length reached
say how many words up to here some item has too. A match counts as soon as it
holds ``length`` words of an item or the share ``coverage`` of its words,
whichever is less: such runs are an item's windows. Each state knows its nearest
suffix that is a window, and each window the items that have it. Words inside a
window are hit; they are cut out, and documents of which more than ``max_share``
is hit are dropped.

A document's words are first looked up in the items' vocabulary and its word
pairs in a bit table of the items' pairs (arrays, no loop): no match of two words
or more crosses a pair that no item has, so only runs of pairs that items have
go through the automaton.

Items are cut into overlapping pieces that keep every window and dealt by hash
into shards of about ``shard_words`` words; each shard's automaton is built in a
task. They are sent to the workers one after another, so what is broadcast has a
size set by that parameter, whatever the benchmark's; one shard takes one pass
over the documents, and what several found is put together by row. Documents are
not shuffled for the first shard, and only the spans found are for others.

Defined results: null texts have no words; an item without words matches
nothing; rows that repeat an item's identifier are parts of one item, and a null
identifier counts as an empty one; repeated documents are documents of their
own; empty tables give empty results, or documents without hits; other columns
are kept by ``remove_leaks`` and ignored by ``find_leaks``.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from math import ceil

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import LOCATOR, located, stored, whole_text, work_dir

WORD = re.compile(rb"[0-9a-z\x80-\xff]+")
BREAK = re.compile(rb"[^0-9A-Za-z\x80-\xff]")
#: Bytes of a text that are split into words at a time.
STEP = 1 << 20
_SPANS = "array<struct<first:long,last:long,start:long,end:long>>"


def _slices(raw: bytes) -> Iterator[tuple[int, bytes]]:
    """(offset, lower-cased part) of a text; no word is cut."""
    at = 0
    while at < len(raw):
        cut = BREAK.search(raw, at + STEP) if at + STEP < len(raw) else None
        end = cut.start() if cut else len(raw)
        yield at, raw[at:end].lower()
        at = end


class Automaton:
    """A generalised suffix automaton over word numbers, with the windows of the pieces it was built from."""

    def __init__(self, pieces: list[tuple[str, int, list[bytes]]]):
        """``pieces``: (item, words of a window, words)."""
        self.vocabulary: dict[bytes, int] = {}
        number = lambda w: self.vocabulary.setdefault(w, len(self.vocabulary) + 1)
        coded = [(item, wide, [number(w) for w in words]) for item, wide, words in pieces]
        self.base = len(self.vocabulary) + 1
        self.step, self.link, self.length = {}, [-1], [0]  # step: state * base + word -> state
        leaving: list[list[int]] = [[]]  # the words that lead out of each state
        for _, _, words in coded:
            last = 0
            for w in words:
                last = self._extend(last, w, leaving)
        self.items = sorted({item for item, _, _ in coded})
        place = {item: i for i, item in enumerate(self.items)}
        windows: dict[int, dict[int, set[int]]] = {}
        for item, wide, words in coded:
            state = reached = 0
            for w in words:
                state, reached = self.step[state * self.base + w], min(wide, reached + 1)
                while self.length[self.link[state]] >= reached:
                    state = self.link[state]
                if reached == wide:
                    windows.setdefault(state, {}).setdefault(wide, set()).add(place[item])
        self.windows = {s: sorted(((w, tuple(sorted(i))) for w, i in ws.items()), reverse=True) for s, ws in windows.items()}
        self.shortest = min((wide for _, wide, _ in coded), default=0)
        self.up = self._nearest_windows()
        size = 1 << max(12, (16 * sum(len(w) for _, _, w in coded)).bit_length())
        self.pairs = np.zeros(size, bool)
        for _, _, words in coded:
            self.pairs[self._pair(words[:-1], words[1:])] = True

    def _extend(self, last: int, w: int, leaving: list[list[int]]) -> int:
        step, link, length, base = self.step, self.link, self.length, self.base

        def clone(p: int, q: int) -> int:
            new = len(length)
            length.append(length[p] + 1)
            link.append(link[q])
            leaving.append(list(leaving[q]))
            for x in leaving[q]:
                step[new * base + x] = step[q * base + x]
            link[q] = new
            while p >= 0 and step.get(p * base + w) == q:
                step[p * base + w] = new
                p = link[p]
            return new

        q = step.get(last * base + w)
        if q is not None:
            return q if length[q] == length[last] + 1 else clone(last, q)
        new = len(length)
        length.append(length[last] + 1)
        link.append(0)
        leaving.append([])
        p = last
        while p >= 0 and (q := step.get(p * base + w)) is None:
            step[p * base + w] = new
            leaving[p].append(w)
            p = link[p]
        if p >= 0:
            link[new] = q if length[q] == length[p] + 1 else clone(p, q)
        return new

    def _nearest_windows(self) -> list[int]:
        """For each state the nearest one on its way to the root that has windows (itself, or -1)."""
        up = [-1] * len(self.link)
        for s in sorted(range(len(self.link)), key=self.length.__getitem__):
            up[s] = s if s in self.windows else up[self.link[s]] if s else -1
        return up

    def _pair(self, words, following) -> np.ndarray:
        """Where word pairs stand in the bit table."""
        key = np.asarray(words, np.uint64) * np.uint64(self.base) + np.asarray(following, np.uint64)
        return (key * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(65 - len(self.pairs).bit_length())

    def numbers(self, raw: bytes) -> np.ndarray:
        """The number of each word of a text; 0 if no item has it."""
        get = self.vocabulary.get
        return np.concatenate([np.zeros(0, np.int32), *(np.array([get(w, 0) for w in WORD.findall(part)], np.int32) for _, part in _slices(raw))])

    def runs(self, words: np.ndarray) -> Iterator[tuple[int, int]]:
        """(first, end) of the places that may hold a window."""
        if not self.shortest or not len(words):
            return
        known = words > 0
        joined = known[:-1] & known[1:]
        at = np.flatnonzero(joined)
        joined[at] = self.pairs[self._pair(words[at], words[at + 1])]
        # a run starts at a known word that is not joined to the one before
        start = np.flatnonzero(known & ~np.concatenate(([False], joined)))
        end = np.flatnonzero(known & ~np.concatenate((joined, [False]))) + 1
        long = end - start >= self.shortest
        yield from zip(start[long].tolist(), end[long].tolist())

    def matches(self, words: np.ndarray) -> tuple[list[tuple[int, int]], set[int]]:
        """(spans, items): runs of hit words (first, end), and the items whose windows occur."""
        step, link, length, base = self.step, self.link, self.length, self.base
        spans: list[tuple[int, int]] = []
        items: set[int] = set()
        met: set[tuple[int, int]] = set()
        for first, end in self.runs(words):
            state = reached = 0
            for i, w in enumerate(words[first:end].tolist(), first):
                while (to := step.get(state * base + w)) is None and state:
                    state = link[state]
                    reached = length[state]
                state, reached = (to, reached + 1) if to is not None else (0, 0)
                at, widest = self.up[state], 0
                while at >= 0:
                    for wide, who in self.windows[at]:
                        if wide <= reached:
                            widest = max(widest, wide)
                            if (at, wide) not in met:
                                met.add((at, wide))
                                items.update(who)
                    at = self.up[link[at]] if at else -1
                if widest:
                    low = i + 1 - widest
                    while spans and spans[-1][1] >= low:
                        low = min(low, spans.pop()[0])
                    spans.append((low, i + 1))
        return spans, items


def _places(raw: bytes, spans: list[tuple[int, int]]) -> list[dict[str, int]]:
    """Spans with the code points where they start and end."""
    asked = iter(sorted({x for first, end in spans for x in (first, end - 1)}))
    found, wanted, k, counted, chars = {}, next(asked), 0, 0, 0
    for offset, part in _slices(raw):
        for word in WORD.finditer(part):
            if k == wanted:
                a, b = offset + word.start(), offset + word.end()
                for at in (a, b):
                    chars += int(np.count_nonzero((np.frombuffer(raw, np.uint8, at - counted, counted) & 0xC0) != 0x80))
                    counted = at
                    found.setdefault(k, []).append(chars)
                wanted = next(asked, -1)
            k += 1
    return [{"first": first, "last": end - 1, "start": found[first][0], "end": found[end - 1][1]} for first, end in spans]


def _pieces(items: DataFrame, length: int, coverage: float, piece_words: int, id_col: str, text_col: str) -> DataFrame:
    """Rows (item, wide, words, n), each once: parts of items that overlap by all but one word of a window."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for item, text in zip(batch.column("item").to_pylist(), batch.column("text")):
                words = [w for _, part in _slices(text.as_py().encode()) for w in WORD.findall(part)]
                if words:
                    wide = min(length, max(1, ceil(coverage * len(words) - 1e-9)))
                    for at in range(0, max(1, len(words) - wide + 1), piece_words):
                        part = words[at : at + piece_words + wide - 1]
                        out.append((item, wide, b" ".join(part), len(part)))
            kinds = [pa.string(), pa.int32(), pa.binary(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], kind) for k, kind in enumerate(kinds)], ["item", "wide", "words", "n"])

    rows = items.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("item"), whole_text(text_col).alias("text"))
    return rows.mapInArrow(run, "item string, wide int, words binary, n long").distinct()


def _automata(items: DataFrame, length: int, coverage: float, shard_words: int, id_col: str, text_col: str, work: str) -> Iterator[Automaton]:
    """The automata of all shards, one after another; at least one."""
    import pickle

    pieces = stored(_pieces(items, length, coverage, max(1, shard_words // 50), id_col, text_col), f"{work}/pieces")
    shards = max(1, ceil((pieces.agg(F.sum("n").alias("n")).first().n or 0) / shard_words))

    def build(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["item", "wide", "words"])
        made = Automaton([(r.item, int(r.wide), r.words.split(b" ")) for r in rows.itertuples()])
        return pd.DataFrame({"shard": [rows["shard"].iloc[0]], "automaton": [pickle.dumps(made)]})

    dealt = pieces.withColumn("shard", F.pmod(F.xxhash64("item", "words"), F.lit(shards)).cast("int"))
    built = stored(dealt.groupBy("shard").applyInPandas(build, "shard int, automaton binary"), f"{work}/automata")
    for k in range(shards):
        row = built.where(F.col("shard") == k).first()
        yield pickle.loads(row.automaton) if row else Automaton([])


def _finder(shared):
    @F.arrow_udf(f"struct<n_words:long,spans:{_SPANS},items:array<string>>")
    def find(texts: pa.Array) -> pa.Array:
        automaton: Automaton = shared.value
        counts, spans, items = [], [], []
        for text in texts:
            raw = text.as_buffer().to_pybytes()
            words = automaton.numbers(raw)
            runs, who = automaton.matches(words)
            counts.append(len(words))
            spans.append(_places(raw, runs) if runs else [])
            items.append(sorted(automaton.items[i] for i in who))
        kind = pa.list_(pa.struct([(n, pa.int64()) for n in ("first", "last", "start", "end")]))
        return pa.StructArray.from_arrays([pa.array(counts, pa.int64()), pa.array(spans, kind), pa.array(items, pa.list_(pa.string()))], ["n_words", "spans", "items"])

    return find


def _merged(spans: list[dict[str, int]]) -> list[dict[str, int]]:
    """Spans without overlaps, in order."""
    out: list[dict[str, int]] = []
    for s in sorted(spans, key=lambda s: (s["first"], s["last"])):
        if not out or s["first"] > out[-1]["last"] + 1:
            out.append(dict(s))
        elif s["last"] > out[-1]["last"]:
            out[-1] |= {"last": s["last"], "end": s["end"]}
    return out


def _united(spans: Column) -> Column:
    @F.arrow_udf(_SPANS)
    def unite(lists: pa.Array) -> pa.Array:
        return pa.array([_merged(spans) for spans in lists.to_pylist()], lists.type)

    return unite(spans)


def _found(docs: DataFrame, items: DataFrame, length: int, coverage: float, shard_words: int, text_col: str, item_col: str, item_text: str) -> DataFrame:
    """``docs`` with LOCATOR and __found (n_words, spans, items)."""
    spark = docs.sparkSession
    work = work_dir(spark, "decontaminate")
    rows = located(docs)
    out, more = None, None
    for k, automaton in enumerate(_automata(items, length, coverage, shard_words, item_col, item_text, work)):
        find = _finder(spark.sparkContext.broadcast(automaton))
        if out is None:
            out = rows.withColumn("__found", find(whole_text(text_col)))
            continue
        part = rows.select(*LOCATOR, find(whole_text(text_col)).alias("f")).where(F.size("f.spans") > 0)
        part = stored(part.select(*LOCATOR, "f.spans", "f.items"), f"{work}/shard={k}")
        more = part if more is None else more.unionByName(part)
    if more is None:
        return out
    others = more.groupBy(*LOCATOR).agg(F.flatten(F.collect_list("spans")).alias("__spans"), F.flatten(F.collect_list("items")).alias("__items"))
    both = out.join(others, list(LOCATOR), "left")
    none = lambda c, like: F.coalesce(F.col(c), F.slice(like, 1, 0))
    found = F.struct(
        F.col("__found.n_words").alias("n_words"),
        _united(F.concat("__found.spans", none("__spans", F.col("__found.spans")))).alias("spans"),
        F.array_sort(F.array_union("__found.items", none("__items", F.col("__found.items")))).alias("items"),
    )
    return both.withColumn("__found", found).drop("__spans", "__items")


def hit_words(spans: Column) -> Column:
    return F.aggregate(spans, F.lit(0).cast("long"), lambda n, s: n + s["last"] - s["first"] + 1)


def find_leaks(
    docs: DataFrame,
    items: DataFrame,
    length: int = 10,
    coverage: float = 1.0,
    shard_words: int = 200_000,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text: str = "text",
) -> DataFrame:
    """One row per document: id, n_words, n_hit, items (sorted), spans (words first to last, code points start to end)."""
    found = _found(docs, items, length, coverage, shard_words, text_col, item_col, item_text)
    rows = found.select(F.col(id_col).alias("id"), "__found.*")
    return rows.select(F.col("id").alias(id_col), "n_words", hit_words(F.col("spans")).alias("n_hit"), "items", "spans")


def remove_leaks(
    docs: DataFrame,
    items: DataFrame,
    length: int = 10,
    coverage: float = 1.0,
    max_share: float = 0.5,
    shard_words: int = 200_000,
    text_col: str = "text",
    item_col: str = "item_id",
    item_text: str = "text",
) -> DataFrame:
    """``docs`` without the spans that items cover, and without documents of whose words more than ``max_share`` are hit."""
    found = _found(docs, items, length, coverage, shard_words, text_col, item_col, item_text)
    spans = F.col("__found.spans")
    clean = found.where(hit_words(spans) <= F.lit(float(max_share)) * F.col("__found.n_words"))
    # what is left lies between the end of each span (or the start) and the start of the next (or the end)
    starts = F.concat(F.array(F.lit(0).cast("long")), F.transform(spans, lambda s: s["end"]))
    ends = F.concat(F.transform(spans, lambda s: s["start"]), F.array(F.char_length(text_col).cast("long")))
    kept = F.transform(F.arrays_zip(starts.alias("a"), ends.alias("b")), lambda g: F.substring(F.col(text_col), (g["a"] + 1).cast("int"), (g["b"] - g["a"]).cast("int")))
    text = F.when(F.size(spans) > 0, F.array_join(kept, "")).otherwise(F.col(text_col))
    return clean.withColumn(text_col, text).select(*docs.columns)
