"""Benchmark decontamination: a generalised suffix automaton of the test items reads training texts word by word.

Words are `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+` after A-Z were lower-cased. A window is WINDOW consecutive words of an
item; an item of fewer words, but not none, is one window. A word inside any occurrence of a window is hit.
Null and empty texts have no words; null items and items without words have no windows. Rows are looked at one by one,
so repeated rows and other columns do no harm. Items with one id count as one item. An item's null id reads "null".

Items are collected in blocks of at most BLOCK_WORDS words (or one item), and an automaton of a block is all that the
driver or a worker holds unpacked at once. A pass over the texts carries GROUP packed blocks; with more blocks there are more
passes. With one block its automaton is unpacked once for a task, with several each once for HELD bytes of texts. Texts of
any length are read whole. An empty table of documents gives no rows, one of items no hits.
"""

from __future__ import annotations

import pickle
import re
import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import alnum_words, lean, shielded, stored

WINDOW = 10
BLOCK_WORDS = 100_000
GROUP = 16
#: Bytes of texts that a task reads before it unpacks the next of several automata.
HELD = 64 << 20
_PAIRS = 1 << 22


class Automaton:
    """Generalised suffix automaton over items' words, with the windows that each state holds."""

    def __init__(self, items: list[tuple[str, list[bytes]]], window: int = WINDOW):
        self.ids: dict[bytes, int] = {}
        self.next: dict[int, int] = {}
        self.link, self.size = [-1], [0]
        self.edges: list[list[int]] = [[]]
        coded = []
        for name, words in items:
            if words:
                coded.append((name, [self.ids.setdefault(w, len(self.ids) + 1) for w in words]))
        self.width = len(self.ids) + 1
        for _, seq in coded:
            last = 0
            for w in seq:
                last = self._extend(last, w)
        windows: dict[tuple[int, int], set[str]] = defaultdict(set)
        for name, seq in coded:
            n = min(window, len(seq))
            state = length = 0
            for w in seq:
                state, length = self.step(state, length, w)
                if length >= n:
                    while self.size[self.link[state]] >= n:
                        state = self.link[state]
                    length = n
                    windows[state, n].add(name)
        self.windows = {k: sorted(v) for k, v in windows.items()}
        self.least = min((n for _, n in self.windows), default=0)
        #: The lengths of windows at each state, and the nearest state at or above it on the suffix path that has any.
        self.at: dict[int, list[int]] = defaultdict(list)
        for state, n in self.windows:
            self.at[state].append(n)
        self.near = [-1] * len(self.link)
        for s in sorted(range(1, len(self.link)), key=self.size.__getitem__):
            self.near[s] = s if s in self.at else self.near[self.link[s]]
        self.pairs = np.zeros(_PAIRS, bool)
        for _, seq in coded:
            x = np.array(seq, np.int64)
            self.pairs[self._pair(x[:-1], x[1:])] = True
        del self.edges

    def _pair(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return (a * 2654435761 + b * 40503) & (_PAIRS - 1)

    def _state(self, size: int, link: int) -> int:
        self.size.append(size)
        self.link.append(link)
        self.edges.append([])
        return len(self.size) - 1

    def _set(self, state: int, w: int, to: int) -> None:
        key = state * self.width + w
        if key not in self.next:
            self.edges[state].append(w)
        self.next[key] = to

    def _split(self, p: int, w: int, q: int) -> int:
        """A state for the strings of q that p's reach through w, taken out of q."""
        new = self._state(self.size[p] + 1, self.link[q])
        for x in self.edges[q]:
            self._set(new, x, self.next[q * self.width + x])
        self.link[q] = new
        while p >= 0 and self.next.get(p * self.width + w) == q:
            self.next[p * self.width + w] = new
            p = self.link[p]
        return new

    def _extend(self, last: int, w: int) -> int:
        q = self.next.get(last * self.width + w)
        if q is not None:  # another item has this prefix's continuation
            return q if self.size[q] == self.size[last] + 1 else self._split(last, w, q)
        new = self._state(self.size[last] + 1, 0)
        p = last
        while p >= 0 and (q := self.next.get(p * self.width + w)) is None:
            self._set(p, w, new)
            p = self.link[p]
        if p >= 0:
            self.link[new] = q if self.size[q] == self.size[p] + 1 else self._split(p, w, q)
        return new

    def step(self, state: int, length: int, w: int) -> tuple[int, int]:
        """State and longest matching length after one more word."""
        while (to := self.next.get(state * self.width + w)) is None:
            if not state:
                return 0, 0
            state = self.link[state]
            length = self.size[state]
        return to, length + 1

    def scan(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[str]]:
        """Hit stretches [start, end) of words, apart and ascending, and the items whose windows occur."""
        if not self.least or len(words) < self.least:
            return [], set()
        seq = np.fromiter(map(self.ids.get, words, [0] * len(words)), np.int64, len(words))
        ok = seq > 0
        if self.least > 1:  # windows stand only where every pair of neighbours is a pair of some item
            ok = ok[:-1] & ok[1:] & self.pairs[self._pair(seq[:-1], seq[1:])]
        edge = np.flatnonzero(np.diff(np.concatenate(([False], ok, [False])).view(np.int8)))
        starts, ends = edge[::2], edge[1::2] + (self.least > 1)
        hits: list[tuple[int, int]] = []
        items: set[str] = set()
        for a, b in zip(starts.tolist(), ends.tolist(), strict=True):
            if b - a < self.least:
                continue
            state = length = 0
            for i, w in enumerate(seq[a:b].tolist(), a):
                state, length = self.step(state, length, w)
                if length < self.least or (s := self.near[state]) < 0:
                    continue
                longest = 0
                while s >= 0:
                    for n in self.at[s]:
                        if n <= length:
                            items.update(self.windows[s, n])
                            longest = max(longest, n)
                    s = self.near[self.link[s]] if self.link[s] > 0 else -1
                if longest:
                    start = i + 1 - longest
                    while hits and hits[-1][1] >= start:
                        start = min(start, hits.pop()[0])
                    hits.append((start, i + 1))
        return hits, items


def _blocks(benchmark: DataFrame, window: int) -> Iterator[bytes]:
    block, size = [], 0
    for row in benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("null")).alias("item_id"), "text").toLocalIterator():
        words = alnum_words((row.text or "").encode())
        if block and size + len(words) > BLOCK_WORDS:
            yield zlib.compress(pickle.dumps(Automaton(block, window)), 1)
            block, size = [], 0
        block.append((row.item_id, words))
        size += len(words)
    yield zlib.compress(pickle.dumps(Automaton(block, window)), 1)


def _join(a: list[tuple[int, int]], b: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for x, y in sorted(a + b):
        if out and x <= out[-1][1]:
            out[-1] = (out[-1][0], max(y, out[-1][1]))
        else:
            out.append((x, y))
    return out


_HITS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))


def find(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, keep_text: bool = False, finish=None) -> DataFrame:
    """The rows of docs (all columns, the text only if asked) with _sw_n_words, _sw_hits (stretches of words, [start, end)) and _sw_items (ids, sorted), which docs must not have itself.

    finish, given a text, its number of words and its hits, gives the text to keep, or False to drop the row; the columns are then those of docs alone.
    """
    spark = docs.sparkSession
    if taken := [c for c in docs.columns if c in ("_sw_n_words", "_sw_hits", "_sw_items")]:
        raise ValueError(f"columns that find adds itself: {', '.join(taken)}")
    names = [c for c in docs.columns if c != "text"]
    kinds = dict(docs.dtypes)

    def run(models, first, last):
        def words(batch):
            return [alnum_words((x.as_py() or "").encode()) for x in batch.column("text")]

        def looked(batches, loaded):
            """Batches with their words and what each model finds in them."""
            if loaded:
                for batch in batches:
                    split = words(batch)
                    yield batch, split, [list(map(loaded.scan, split))]
                return
            held, size, ended = [], 0, False
            while not ended:
                batch = next(batches, None)
                ended = batch is None
                if batch is not None:
                    held.append(batch)
                    size += batch.column("text").nbytes
                if held and (ended or size >= HELD):
                    found = [[] for _ in held]
                    for m in models:
                        model = pickle.loads(zlib.decompress(m.value))
                        for b, out in zip(held, found, strict=True):
                            out.append(list(map(model.scan, words(b))))
                    yield from ((b, words(b), out) for b, out in zip(held, found, strict=True))
                    held, size = [], 0

        def go(batches):
            loaded = pickle.loads(zlib.decompress(models[0].value)) if len(models) == 1 else None
            for batch, split, found in looked(batches, loaded):
                hits = [[(h["start"], h["end"]) for h in x] for x in batch.column("_sw_hits").to_pylist()] if not first else [[]] * len(split)
                items = [set(x) for x in batch.column("_sw_items").to_pylist()] if not first else [set()] * len(split)
                for of_model in found:
                    hits = [_join(a, b) if a and b else a or b for a, (b, _) in zip(hits, of_model, strict=True)]
                    items = [a | b if b else a for a, (_, b) in zip(items, of_model, strict=True)]
                if last and finish:
                    texts = [finish(x.as_py(), len(w), h) if h else x.as_py() for x, w, h in zip(batch.column("text"), split, hits, strict=True)]
                    rows = [row for row, x in enumerate(texts) if x is not False]
                    at = pa.array(rows, pa.int32())
                    yield pa.RecordBatch.from_arrays([*(batch.column(c).take(at) for c in names), pa.array([texts[row] for row in rows], pa.string())], names=[*names, "text"])
                    continue
                arrays = [batch.column(c) for c in names]
                if not last or keep_text:
                    arrays.append(batch.column("text"))
                arrays += [pa.array(map(len, split), pa.int64()), pa.array([[{"start": a, "end": b} for a, b in x] for x in hits], _HITS), pa.array(list(map(sorted, items)), pa.list_(pa.string()))]
                yield pa.RecordBatch.from_arrays(arrays, names=[*names, *(["text"] if not last or keep_text else []), "_sw_n_words", "_sw_hits", "_sw_items"])

        return go

    now, group, first = docs.select(*names, "text"), [], True

    def apply(last):
        if last and finish:
            return now.mapInArrow(lean(run(group, first, last)), ", ".join(f"`{c}` {kinds[c]}" for c in [*names, "text"]))
        kept = [*names, *(["text"] if not last or keep_text else [])]
        schema = ", ".join([*(f"`{c}` {kinds[c]}" for c in kept), "_sw_n_words long, _sw_hits array<struct<start:long,end:long>>, _sw_items array<string>"])
        return now.mapInArrow(lean(run(group, first, last)), schema)

    for packed in _blocks(benchmark, window):
        if len(group) == GROUP:
            now, group, first = stored(apply(False), "decontaminate"), [], False
        group.append(spark.sparkContext.broadcast(packed))
    return apply(True)


def report(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256 and contaminated of each row."""
    found = find(docs.select("doc_id", "text"), benchmark, window)
    n_hit = F.aggregate("_sw_hits", F.lit(0).cast("long"), lambda s, x: s + x["end"] - x["start"])
    return found.select("doc_id", F.col("_sw_n_words").alias("n_words"), n_hit.alias("n_hit"), F.size("_sw_items").cast("long").alias("n_items"), F.sha2(F.array_join("_sw_items", ",").cast("binary"), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"))


_WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def clean(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, max_coverage: float = 0.5) -> DataFrame:
    """docs without benchmark passages: hit stretches are cut out of the text; a row of which more than max_coverage of the words are hit goes whole.

    Rows without a hit stay as they are, null and empty texts included. n_chars, where there is such a column, follows the text.
    """
    docs, restore = shielded(docs)

    def cut(text, n_words, spans):
        if sum(b - a for a, b in spans) > n_words * max_coverage:
            return False
        raw = text.encode()
        places = [m.span() for m in _WORD.finditer(raw.lower())]
        parts, at = [], 0
        for a, b in spans:
            parts.append(raw[at : places[a][0]])
            at = places[b - 1][1]
        return b"".join([*parts, raw[at:]]).decode()

    kinds = dict(docs.dtypes)
    done = find(docs, benchmark, window, finish=cut)
    if "n_chars" in kinds:
        done = done.withColumn("n_chars", F.length("text").cast(kinds["n_chars"]))
    return restore(done.select(*docs.columns))
