"""Alignment of two tokenizers' tokens by a dangling-suffix transducer.

Both token sequences of a text spell the same bytes. The transducer's state is which side leads and the bytes that the other
side has not matched yet; it takes the next token of the side that trails (the first side, when nothing dangles), and an empty residual closes
a group. Transitions are remembered by state and token, so most steps are one look-up. Two tokens are linked where their bytes overlap, which is
what one step sees: a token taken while a residual dangles overlaps the token that left it.

Texts are cut before a blank that follows no white space. Neither side has a token across such a place (the first splits there by
its pattern, the second has no piece with a blank after another character, which is looked up in its vocabulary), so the residual is empty
there, and what the transducer found for a cut is remembered by a worker for the cuts it meets most lately. Cuts of any length are aligned whole.

Links are counted over the corpus: the number of documents that hold a pair of ids. Pairs are summed by task before the shuffle. To meet the counts, the
most frequent pairs, HEAD at most, go to all tasks; the others, each in few documents, are joined by pair.

Null and empty texts, and those whose tokens on either side don't spell a blank and the text, have no tokens. Ids may be null or repeat: rows are told apart by
where they are stored. Extra columns are left out, and an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from array import array
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import public_tokenizers
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import _ODD_SPACE
from .common import lean, stored
from .wavelet import _byte_letters

#: Pairs whose counts every task holds; they are the most frequent, so any other is in a share of 1 / HEAD of all links at most.
HEAD = 1 << 19
#: Cuts that a worker remembers, up to this length.
CUTS, LONGEST = 150_000, 64
#: Distinct pairs of so many rows are summed in a task before they are sent on.
FLUSH = 1 << 22


class Transducer:
    """Aligns ids of two sides by the bytes they stand for.

    States are numbered: 0 is the empty residual; a state is odd while the first side leads, so the second's token comes next.
    """

    #: Transitions that are remembered at once.
    KEPT = 400_000

    def __init__(self, left: list[bytes], right: list[bytes]):
        self.left, self.right = left, right
        self.number: dict[tuple[bool, bytes], int] = {}
        self.residual: list[bytes] = [b"", b""]
        #: By state, the states after tokens.
        self.memo: list[dict[int, int]] = [{}, {}]
        self.kept = 0

    def _state(self, first_leads: bool, residual: bytes) -> int:
        if not residual:
            return 0
        if (n := self.number.get((first_leads, residual))) is None:
            n = self.number[first_leads, residual] = len(self.residual) + (len(self.residual) & 1 ^ first_leads)
            self.residual += [residual] * (n + 1 - len(self.residual))
            self.memo += [{} for _ in range(n + 1 - len(self.memo))]
        return n

    def step(self, state: int, token: int) -> int:
        """The state after a token of the side that trails; ValueError if it doesn't spell on."""
        odd = state & 1
        spelt = self.right[token] if odd else self.left[token]
        held = self.residual[state] if state else b""
        if not spelt:
            raise ValueError(f"token {token} has no bytes")
        if len(spelt) <= len(held):
            if not held.startswith(spelt):
                raise ValueError("the sides spell different bytes")
            out = self._state(bool(odd), held[len(spelt) :])
        else:
            if not spelt.startswith(held):
                raise ValueError("the sides spell different bytes")
            out = self._state(not odd, spelt[len(held) :])
        if self.kept == self.KEPT:
            self.kept = 0
            for known in self.memo:
                known.clear()
        self.memo[state][token] = out
        self.kept += 1
        return out

    def align(self, a: list[int], b: list[int]) -> tuple[list[tuple[int, int]], list[int]]:
        """The ends (places in a and in b) of the groups, and the linked ids (first << 32 | second)."""
        groups, links, memo = [], [], self.memo
        i = j = state = left = right = 0
        na, nb = len(a), len(b)
        while i < na or state:
            if state & 1:
                if j == nb:
                    break
                right = b[j]
                j += 1
                now = memo[state].get(right)
                if now is None:
                    now = self.step(state, right)
                links.append(left << 32 | right)
            else:
                if i == na:
                    break
                left = a[i]
                i += 1
                now = memo[state].get(left)
                if now is None:
                    now = self.step(state, left)
                if state:
                    links.append(left << 32 | right)
            state = now
            if not state:
                groups.append((i, j))
        if state or j < nb:
            raise ValueError("the sides spell different bytes")
        return groups, links


class Aligned(NamedTuple):
    """Of a cut: number of ids of each side, of groups and links, the groups as text, and the linked pairs (first id * 2**32 + second id, 64-bit) as bytes."""

    n_a: int
    n_b: int
    n_groups: int
    text: str
    pairs: bytes


class Sides:
    """Two tokenizers and the transducer between them: a tokenizers file and a sentencepiece model that puts a blank before a text."""

    _held: dict[tuple, Sides] = {}
    #: A blank before anything and after a character that is no white space; the lookbehind sees both.
    _CUT = re.compile(f" (?<=[^ \t\n\r{_ODD_SPACE}] )(?=[\\s\\S])")

    #: Printable ASCII characters, line feeds and the letters of Latin-1, to a length that any library takes at once.
    _PLAIN = re.compile(r"[\n -~À-ÖØ-öø-ÿ]{0,1000}").fullmatch

    def __init__(self, first: str | None = None, second: str | None = None):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        from tokenizers import Tokenizer

        file = first or public_tokenizers.path("byte_bpe_50k.json")
        self.a = Tokenizer.from_file(file)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=second or public_tokenizers.path("piece_bpe_32k.model"))
        letters = {c: b for b, c in ((b, _byte_letters().get(b, chr(b))) for b in range(256))}
        spelt: list[bytes] = [b""] * self.a.get_vocab_size()
        for token, k in self.a.get_vocab().items():
            spelt[k] = bytes(map(letters.__getitem__, token)) if all(c in letters for c in token) else token.encode()
        pieces = [self.b.id_to_piece(k) for k in range(self.b.get_piece_size())]
        theirs = [bytes([int(p[3:5], 16)]) if self.b.IsByte(k) else p.replace("▁", " ").encode() for k, p in enumerate(pieces)]
        self.spelt, self.transducer = (spelt, theirs), Transducer(spelt, theirs)
        self.names = [str(k) for k in range(max(map(len, self.spelt)))]
        self.merges = self._merges(file)
        #: Whether no piece goes on with a blank, so that texts can be cut.
        self.cuttable = not any(re.search("[^▁]▁", p) for p in pieces)
        self.new: dict[str, Aligned | None] = {}
        self.old: dict[str, Aligned | None] = {}

    @classmethod
    def shared(cls, first: str | None = None, second: str | None = None) -> Sides:
        """One for all tasks of a worker process, which keeps what it has learnt."""
        if (first, second) not in cls._held:
            cls._held[first, second] = cls(first, second)
        return cls._held[first, second]

    def cuts(self, text: str) -> list[str]:
        """The cuts of a text, each without the blank before it."""
        return self._CUT.split(text) if self.cuttable else [text]

    def _merges(self, file: str):
        """The first side's merges as ranks, which give the same ids several times as fast; None if its file is not byte-level BPE whose ids are in the order of merges."""
        import tiktoken

        with open(file, encoding="utf-8") as f:
            told = json.load(f)
        model, ranks = told["model"], {}
        split = told.get("pre_tokenizer") or {}
        if model.get("type") != "BPE" or told.get("normalizer") or (split.get("type"), split.get("add_prefix_space"), split.get("use_regex", True)) != ("ByteLevel", False, True):
            return None
        added = {x["id"] for x in told.get("added_tokens", [])}
        for token, k in model["vocab"].items():
            if k not in added:
                ranks[self.spelt[0][k]] = k
        merged = [model["vocab"]["".join(m.split(" ") if isinstance(m, str) else m)] for m in model["merges"]]
        if merged != sorted(merged) or len(merged) + 256 != len(ranks) or model.get("dropout") or model.get("ignore_merges"):
            return None
        return tiktoken.Encoding("merges", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    def ids(self, cuts: list[str]) -> tuple[list[list[int]], list[list[int]]]:
        """Ids of both sides for a blank and each cut. Cuts of plain characters, on whose kinds all libraries agree, are encoded by ranks, the others by the first side's own library."""
        if not self.merges:
            return self._library(cuts), self.b.encode(cuts, num_threads=1)
        encode, plain = self.merges.encode_ordinary, self._PLAIN
        a = [encode(" " + x) if plain(x) else None for x in cuts]
        if None in a:
            rest = [k for k, x in enumerate(a) if x is None]
            for k, x in zip(rest, self._library([cuts[k] for k in rest]), strict=True):
                a[k] = x
        return a, self.b.encode(cuts, num_threads=1)

    def _library(self, cuts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.a.encode_batch_fast([" " + x for x in cuts], add_special_tokens=False)]

    def groups(self, text: str) -> list[tuple[list[int], list[int]]] | None:
        """Ids of both sides in each group of a whole text; None if they don't spell it."""
        (a,), (b,) = self.ids([text])
        own = (" " + text).encode()
        if any(b"".join(map(s.__getitem__, x)) != own for s, x in zip(self.spelt, (a, b), strict=True)):
            return None
        ends, _ = self.transducer.align(a, b)
        return [(a[i:k], b[j:m]) for (i, j), (k, m) in zip([(0, 0), *ends[:-1]], ends, strict=True)]

    def _align(self, cut: str, a: list[int], b: list[int]) -> Aligned | None:
        if b"".join(map(self.spelt[0].__getitem__, a)) != (" " + cut).encode():
            return None
        try:
            ends, links = self.transducer.align(a, b)
        except ValueError:  # then the second side spells something else
            return None
        name, text, i, j = self.names.__getitem__, [], 0, 0
        for k, m in ends:
            text.append(f"{name(a[i])}|{name(b[j])}" if k - i == m - j == 1 else f"{','.join(map(name, a[i:k]))}|{','.join(map(name, b[j:m]))}")
            i, j = k, m
        return Aligned(len(a), len(b), len(ends), ";".join(text), array("Q", links).tobytes())

    def learn(self, unknown: list[str]) -> dict[str, Aligned | None]:
        return {x: self._align(x, a, b) for x, a, b in zip(unknown, *self.ids(unknown), strict=True)}

    def documents(self, texts: list[str]) -> list[list[Aligned]]:
        """What each text's cuts give, in order; an empty list for a text without tokens."""
        cut = [self.cuts(x) if x else [] for x in texts]
        unknown = {x for cuts in cut for x in cuts}.difference(self.new)
        found = {x: self.old[x] for x in unknown if x in self.old}
        found |= self.learn([x for x in unknown if x not in found])
        self.new |= found
        out = []
        for text, cuts in zip(texts, cut, strict=True):
            got = list(map(self.new.__getitem__, cuts))
            if None in got:  # then the whole text decides
                got = [self.learn([text])[text]]
            out.append([] if None in got else got)
        for x in found:
            if len(x) > LONGEST:
                del self.new[x]
        if len(self.new) > CUTS:
            self.old, self.new = self.new, {}
        return out


def alignments(docs: DataFrame, first: str | None = None, second: str | None = None) -> DataFrame:
    """doc_id and groups of each document: an array of (a: ids of the first side, b: ids of the second) in order; null where the text has no tokens."""

    def run(batches):
        kind = pa.list_(pa.struct([("a", pa.list_(pa.int32())), ("b", pa.list_(pa.int32()))]))
        for batch in batches:
            sides = Sides.shared(first, second)
            for k in range(batch.num_rows):
                text = batch.column("text")[k].as_py()
                found = sides.groups(text) if text else None
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(k, 1), pa.array([found and [{"a": a, "b": b} for a, b in found]], kind)], names=["doc_id", "groups"])

    return docs.select("doc_id", "text").mapInArrow(lean(run), f"doc_id {dict(docs.dtypes)['doc_id']}, groups array<struct<a:array<int>,b:array<int>>>")


_LINKED = "rid long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs binary"


def linked(docs: DataFrame, first: str | None = None, second: str | None = None) -> DataFrame:
    """A stored row for each document: rid (a number of its own), doc_id, counts, the digest of its groups, and its distinct pairs with how often each is linked, packed."""

    def run(batches):
        from pyspark import TaskContext

        sides, rid = Sides.shared(first, second), TaskContext.get().partitionId() << 40
        pack = zstandard.ZstdCompressor(level=3).compress
        for batch in batches:
            texts, out = batch.column("text").to_pylist(), []
            for cuts in sides.documents(texts):
                pairs, times = np.unique(np.frombuffer(b"".join([c.pairs for c in cuts]), "<u8"), return_counts=True)
                counts = [sum([c[k] for c in cuts]) for k in range(3)]
                digest = hashlib.sha256(";".join([c.text for c in cuts]).encode()).hexdigest() if cuts else ""
                out.append((rid, *counts, int(times.sum()), digest, packed(pairs, times, pack)))
                rid += 1
            kinds = [pa.int64()] * 5 + [pa.string(), pa.binary()]
            names = [x.split(" ")[0] for x in _LINKED.split(", ")]
            yield pa.RecordBatch.from_arrays([*(pa.array(x, kind) for x, kind in zip(zip(*out, strict=True), kinds, strict=True)), batch.column("doc_id")] if out else [*(pa.array([], kind) for kind in kinds), batch.column("doc_id")], names=[*names, "doc_id"])

    return stored(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(lean(run), f"{_LINKED}, doc_id long"), "linked")


def packed(pairs: np.ndarray, times: np.ndarray, pack) -> bytes:
    """Sorted pairs as differences of first ids and second ids, and how often each stands, compressed."""
    a, b = pairs >> np.uint64(32), pairs & np.uint64(0xFFFFFFFF)
    return pack(np.concatenate([np.diff(a, prepend=np.uint64(0)), b, times]).astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes())


def unpacked(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Pairs and how often each stands."""
    if not len(raw := zstandard.ZstdDecompressor().decompress(data)):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    a, b, times = np.frombuffer(raw, np.uint8).reshape(4, -1).T.copy().view("<u4").reshape(3, -1).astype(np.uint64)
    return np.cumsum(a, dtype=np.uint64) << np.uint64(32) | b, times.astype(np.int64)


def pair_counts(table: DataFrame, flush: int = FLUSH) -> DataFrame:
    """pair, n (documents that hold it linked) and best (whether n is the highest of its first id), stored. The highest counts, a row for each id of the first vocabulary, are broadcast."""

    def run(batches):
        held, size = [], 0

        def summed():
            pairs, n = np.unique(np.concatenate(held), return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array(pairs.astype(np.int64)), pa.array(n.astype(np.int64))], names=["pair", "n"])

        for batch in batches:
            for data in batch.column("pairs").to_pylist():
                held.append(unpacked(data)[0])
                size += len(held[-1])
                if size >= flush:
                    yield summed()
                    held, size = [], 0
        if held:
            yield summed()

    counts = stored(table.select("pairs").mapInArrow(lean(run), "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n")), "pair_counts")
    side = F.shiftright("pair", 32)
    most = counts.groupBy(side.alias("a")).agg(F.max("n").alias("most"))
    return counts.join(F.broadcast(most), side == F.col("a")).select("pair", "n", (F.col("n") == F.col("most")).alias("best"))


def score(docs: DataFrame, first: str | None = None, second: str | None = None, head: int = HEAD) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum and groups_sha256 of each document.

    n_best: links whose pair is in as many documents as any pair of its first id; count_sum: sum of those numbers over the links.
    """
    spark = docs.sparkSession
    table = linked(docs, first, second)
    counts = stored(pair_counts(table), "pairs")
    # pairs by powers of two of their number of documents: from which power on are there no more than head?
    sizes = {r.p: r.c for r in counts.groupBy(F.floor(8 * F.log2("n")).cast("int").alias("p")).agg(F.count("*").alias("c")).collect()}
    least, held = None, 0
    for p in sorted(sizes, reverse=True):
        if held + sizes[p] > head:
            break
        least, held = p, held + sizes[p]
    frequent = F.lit(False) if least is None else F.floor(8 * F.log2("n")).cast("int") >= least
    known = counts.where(frequent).toArrow().sort_by("pair")
    shared = spark.sparkContext.broadcast((known["pair"].to_numpy().astype(np.uint64), known["n"].to_numpy().astype(np.int64), known["best"].to_numpy().astype(np.int64)))
    whole = held == sum(sizes.values())

    def run(batches):
        pairs, n, best = shared.value
        for batch in batches:
            sums = []
            for data in batch.column("pairs").to_pylist():
                own, times = unpacked(data)
                at = np.minimum(np.searchsorted(pairs, own), max(0, len(pairs) - 1))
                met = pairs[at] == own if len(pairs) else np.zeros(len(own), bool)
                at, some = at[met], times[met]
                sums.append((int((best[at] * some).sum()), int((n[at] * some).sum()), own[~met].astype(np.int64), times[~met]))
            ends = np.cumsum([0, *(len(r[2]) for r in sums)]).astype(np.int32)
            rest = pa.ListArray.from_arrays(pa.array(ends), pa.StructArray.from_arrays([pa.array(np.concatenate([np.zeros(0, np.int64), *(r[k] for r in sums)])) for k in (2, 3)], ["pair", "times"]))
            kept = [batch.column(c) for c in ("rid", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256")]
            yield pa.RecordBatch.from_arrays([*kept, pa.array([r[0] for r in sums], pa.int64()), pa.array([r[1] for r in sums], pa.int64()), rest], names=["rid", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "n_best", "count_sum", "rest"])

    met = table.mapInArrow(lean(run), "rid long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, n_best long, count_sum long, rest array<struct<pair:long,times:long>>")
    columns = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    if whole:
        return met.select(columns)
    met = stored(met, "met")
    rest = met.select("rid", F.inline("rest")).join(counts.where(~frequent), "pair").groupBy("rid").agg(F.sum(F.col("best").cast("long") * F.col("times")).alias("b"), F.sum(F.col("n") * F.col("times")).alias("s"))
    added = met.drop("rest").join(rest, "rid", "left")
    return added.withColumns({"n_best": F.col("n_best") + F.coalesce("b", F.lit(0)), "count_sum": F.col("count_sum") + F.coalesce("s", F.lit(0))}).select(columns)
