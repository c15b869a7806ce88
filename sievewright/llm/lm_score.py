"""Cross-entropy difference: two matched bigram models, of target documents and of all, share one vocabulary.

Words are `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+` after A-Z were lower-cased. The vocabulary is every word, by its 64-bit hash,
and the unknown word. (With RARE over 0, words that make up less than RARE of all are the unknown word.) Counts are of all documents.
p(w | v) = (c(v, w) + MASS * p(w)) / (c(v) + MASS), p(w) = (c(w) + 1) / (N + vocabulary); a document's first word has p(w).
A document's losses are the means of -log p over its words, and its score is target loss - background loss: lower is closer
to the target.

Unigrams are summed by word. Words that make up at least HEAD of all, so at most 1 / HEAD, are broadcast. Pairs of the at
most 1 / COMMON words that are common are counted in a square table; every other pair is less than COMMON of all. All
occurrences of such a pair of broadcast words meet in one task, and all occurrences of any other word, with their
neighbours, in one task too. It counts them, then scores them, and sends back sums for each document. A partition is made
for each PART words, but the occurrences of one pair are not split, so the largest task may have COMMON of all pairs and grows with the corpus.

Null and empty texts: no words, null losses and score. Texts of any length are read whole, and an empty table gives no
rows. doc_id has to be of an integer type. Repeated rows are documents of their own. Labels of one document are
merged by their largest value; documents without a label, or with a null one, aren't target documents. Without target words the target model is p(w) = 1 / vocabulary.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import alnum_words, groups, integer_ids, lean, mix64, stored, WordIds

RARE, HEAD, COMMON, MASS, PART, BATCH, COUNTED = 0.0, 2e-5, 1 / 400, 50.0, 6_000_000, 2000, 1_500_000
#: Labels of more bytes than this aren't broadcast.
BROADCAST = 32 << 20


class Vocabulary:
    """Numbers of broadcast words (0: others), their counts in target and in all documents, and both unigram models; size: all words told apart, if others are not one unknown word."""

    def __init__(self, hashes: np.ndarray, everywhere: np.ndarray, target: np.ndarray, total: tuple[int, int], size: int | None = None):
        order = np.argsort(hashes)
        self.hashes = hashes[order]
        counts = np.zeros((2, len(hashes) + 1))
        counts[0, 1:], counts[1, 1:] = target[order], everywhere[order]
        counts[:, 0] = np.array(total[::-1]) - counts.sum(1)
        self.counts = counts
        self.whole = size is not None
        self.mass = counts.sum(1, keepdims=True) + (size + 1 if self.whole else counts.shape[1])
        self.p = (counts + 1) / self.mass
        common = np.flatnonzero(counts[1] >= COMMON * max(1, total[0]))
        common = common[common > 0] if self.whole else common
        self.common = np.full(counts.shape[1], -1, np.int32)
        self.common[common] = np.arange(len(common))
        self.n_common = len(common)

    def loss(self, pairs: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """-log p(b | a) under both models, given the pairs' counts in both (2 x n)."""
        return -np.log((pairs + MASS * self.p[:, b]) / (self.counts[:, a] + MASS))


class Numbers(dict):
    """Numbers of words, kept while there are not too many."""

    def __init__(self, vocabulary: Vocabulary):
        self.v, self.ids = vocabulary, WordIds.shared()

    def __missing__(self, word: bytes) -> int:
        if len(self) >= 150_000:
            self.clear()
        h = np.uint64(self.ids[word])
        at = int(np.searchsorted(self.v.hashes, h))
        n = self[word] = at + 1 if at < len(self.v.hashes) and self.v.hashes[at] == h else 0
        return n

    def of(self, text) -> np.ndarray:
        return self.both(text)[0]

    def both(self, text) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of a text's words, and the hashes of those that have none."""
        words = alnum_words((text or "").encode())
        n = np.fromiter(map(self.__getitem__, words), np.int64, len(words))
        other = np.flatnonzero(n == 0) if self.v.whole else n[:0]
        return n, self.ids.of([words[i] for i in other.tolist()])


def _flagged(docs: DataFrame, target: DataFrame) -> DataFrame:
    """doc_id, text and whether the document is in the target (a table of distinct doc_id)."""
    rows = target.select("doc_id", F.lit(True).alias("target"))
    small = target.count() * 16 <= BROADCAST
    joined = docs.select("doc_id", "text").join(F.broadcast(rows) if small else rows, "doc_id", "left").select("doc_id", "text", F.coalesce("target", F.lit(False)).alias("target"))
    # Rows from a shuffle come in any order; a task that is run again has to make the same batches.
    return joined if small else joined.sortWithinPartitions("doc_id", "text")


def vocabulary(rows: DataFrame) -> Vocabulary:
    def count(batches):
        ids, words, flags = WordIds.shared(), [], []

        def sums():
            w = np.concatenate([np.zeros(0, np.uint64), *words])
            flag = np.repeat(np.array(flags, bool), list(map(len, words)))
            h, place, n = np.unique(w, return_inverse=True, return_counts=True)
            t = np.bincount(place[flag], minlength=len(h)) if len(h) else np.zeros(0, np.int64)
            return pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(n, pa.int64()), pa.array(t, pa.int64())], names=["h", "n", "t"])

        for batch in batches:
            words += [ids.of(alnum_words((x.as_py() or "").encode())) for x in batch.column("text")]
            flags += batch.column("target").to_pylist()
            if sum(map(len, words)) > COUNTED:
                yield sums()
                words, flags = [], []
        yield sums()

    counts = rows.select("text", "target").mapInArrow(lean(count), "h long, n long, t long").groupBy("h").agg(F.sum("n").alias("n"), F.sum("t").alias("t"))
    counts = stored(counts, "words")
    n, t, size = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("t"), F.lit(0)), F.count("*")).first()
    held = counts.where(F.col("n") >= (RARE or HEAD) * n).toArrow()
    return Vocabulary(held.column("h").to_numpy().view(np.uint64), held.column("n").to_numpy(), held.column("t").to_numpy(), (n, t), None if RARE else size)


def _common_pairs(rows: DataFrame, shared) -> np.ndarray:
    """Counts of pairs of common words in target and in all documents, 2 x common x common."""

    def count(batches):
        v = shared.value
        numbers, k = Numbers(v), v.n_common
        total = np.zeros((2, k * k), np.int64)
        for batch in batches:
            for x, target in zip(batch.column("text"), batch.column("target").to_pylist(), strict=True):
                c = v.common[numbers.of(x.as_py())]
                both = (c[:-1] >= 0) & (c[1:] >= 0)
                pairs = c[:-1][both].astype(np.int64) * k + c[1:][both]
                np.add.at(total[1], pairs, 1)
                if target:
                    np.add.at(total[0], pairs, 1)
        at = np.flatnonzero(total[1])
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[0, at]), pa.array(total[1, at])], names=["pair", "t", "n"])

    k = shared.value.n_common
    got = rows.select("text", "target").mapInArrow(lean(count), "pair long, t long, n long").groupBy("pair").agg(F.sum("t").alias("t"), F.sum("n").alias("n")).toArrow()
    out = np.zeros((2, k * k))
    out[0, got.column("pair").to_numpy()], out[1, got.column("pair").to_numpy()] = got.column("t").to_numpy(), got.column("n").to_numpy()
    return out.reshape(2, k, k)


_SENT = "p long, part long, seq long, kind int, codes binary, rows binary, docs array<long>, words array<long>, sums binary"


def _dealt(hashes: np.ndarray, parts: int):
    """Partitions and the places of the hashes that go to each."""
    where = (hashes % np.uint64(parts)).astype(np.int64)
    order = np.argsort(where, kind="stable")
    where = where[order]
    cuts = [0, *(np.flatnonzero(where[1:] != where[:-1]) + 1).tolist(), len(where)]
    for s, e in zip(cuts, cuts[1:], strict=False):
        if e > s:
            yield int(where[s]), order[s:e]


def _send(shared, parts: int):
    """For each batch of documents: one row with their ids and what is scored at once (kind 1), and for each partition a row with pairs (0) and one with words that aren't broadcast (2)."""

    def row(p, part, seq, kind, codes=b"", rows=b"", docs=(), words=(), sums=b""):
        values = (p, part, seq, kind, codes, rows, list(docs), list(words), sums)
        types = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary())
        return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, types, strict=True)], names=[x.split()[0] for x in _SENT.split(", ")])

    def run(batches):
        from pyspark import TaskContext

        part, seq = TaskContext.get().partitionId(), 0
        v, pairs = shared.value
        numbers, width = Numbers(v), len(v.hashes) + 1
        for batch in batches:
            for start in range(0, batch.num_rows, BATCH):
                some = batch.slice(start, BATCH)
                seqs, other = zip(*(numbers.both(x.as_py()) for x in some.column("text")), strict=True)
                size = np.array(list(map(len, seqs)), np.int64)
                w = np.concatenate([np.zeros(0, np.int64), *seqs])
                doc = np.repeat(np.arange(len(seqs)), size)
                first = np.ones(len(w), bool)
                first[1:] = doc[1:] != doc[:-1]
                held = (w > 0) | (not v.whole)
                inner = ~first[1:] & held[:-1] & held[1:]
                a, b, d = w[:-1][inner], w[1:][inner], doc[1:][inner]
                both = (v.common[a] >= 0) & (v.common[b] >= 0)
                x, y = a[both], b[both]
                loss = v.loss(pairs[:, v.common[x], v.common[y]], x, y)
                top = first & held
                sums = np.stack([np.bincount(d[both], z, len(seqs)) + np.bincount(doc[top], -np.log(u[w[top]]), len(seqs)) for z, u in zip(loss, v.p, strict=True)])
                yield row(int(mix64(np.array([part * 1_000_003 + seq], np.uint64))[0] % np.uint64(parts)), part, seq, 1, docs=some.column("doc_id").cast(pa.int64()).to_pylist(), words=size.tolist(), sums=sums.tobytes())
                flag = np.array(some.column("target").to_pylist(), bool)
                code = (a[~both] * width + b[~both]).astype(np.uint64)
                for p, at in _dealt(mix64(code), parts):
                    rows = d[~both][at]
                    yield row(p, part, seq, 0, code[at].astype("<u4" if width < 1 << 16 else "<u8").tobytes(), (rows * 2 + flag[rows]).astype("<u2").tobytes())
                if v.whole:
                    at = np.flatnonzero(~held)
                    name = w.astype(np.uint64)
                    name[at] = np.concatenate([np.zeros(0, np.uint64), *other])
                    before, after = np.zeros(len(w), np.uint64), np.zeros(len(w), "<u4")
                    before[1:] = np.where(first[1:], 0, name[:-1])
                    after[:-1] = np.where(first[1:], 0, np.where(held[1:], w[1:], width))
                    for p, some_at in _dealt(mix64(name[at]), parts):
                        some_at = at[some_at]
                        rows = doc[some_at]
                        yield row(p, part, seq, 2, name[some_at].tobytes() + before[some_at].tobytes() + after[some_at].tobytes(), (rows * 2 + flag[rows]).astype("<u2").tobytes())
                seq += 1

    return run


def _others(v: Vocabulary, codes: list[bytes], flag: np.ndarray) -> np.ndarray:
    """Losses (2 x n) that words which aren't broadcast add, given all their occurrences, each with the words before (0: none) and after (0: none, the vocabulary's width: not broadcast).

    -log p(b | a) falls into -log(c(a, b) + MASS * p(b)) and log(c(a) + MASS); what only the other word's task knows is added there.
    """
    n, width = [len(c) // 20 for c in codes], len(v.hashes) + 1
    word, before = (np.concatenate([np.frombuffer(c, "<u8", k, 8 * k * i) for c, k in zip(codes, n, strict=True)]) for i in (0, 1))
    after = np.concatenate([np.frombuffer(c, "<u4", k, 16 * k) for c, k in zip(codes, n, strict=True)])

    def counted(key: np.ndarray, target: np.ndarray) -> np.ndarray:
        _, place, every = np.unique(key, return_inverse=True, return_counts=True)
        return np.stack([np.bincount(place[target], minlength=len(every))[place], every[place]]).astype(float)

    own = counted(word, flag)
    p = (own + 1) / v.mass
    start = before == 0
    loss = -np.log(np.where(start, p, counted(mix64(word) + before * np.uint64(0x9E3779B97F4A7C15), flag) + MASS * p))
    known = np.flatnonzero(~start & (before < width))
    loss[:, known] += np.log(v.counts[:, before[known].astype(np.int64)] + MASS)
    loss += np.where(after > 0, np.log(own + MASS), 0)
    next_ = np.flatnonzero((after > 0) & (after < width))
    key = mix64(word[next_]) + after[next_].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    loss[:, next_] -= np.log(counted(key, flag[next_]) + MASS * v.p[:, after[next_]])
    return loss


def _score(shared):
    """Over rows sorted by partition: counts the pairs and words of each partition and sums the losses of each document in it; rows with ids pass."""
    types = (pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary())
    names = ["part", "seq", "kind", "rows", "docs", "words", "sums"]

    def run(batches):
        v, _ = shared.value
        width = len(v.hashes) + 1
        kind = "<u4" if width < 1 << 16 else "<u8"
        for unit in groups(batches, ["p", "kind"]):
            if unit.column("kind")[0].as_py() == 1:
                yield unit.select(names)
                continue
            rows = [np.frombuffer(x, "<u2") for x in unit.column("rows").to_pylist()]
            flag = (np.concatenate(rows) & 1).astype(bool)
            if unit.column("kind")[0].as_py() == 2:
                loss = _others(v, unit.column("codes").to_pylist(), flag)
                place = np.arange(len(flag))
            else:
                code, place, n = np.unique(np.frombuffer(b"".join(unit.column("codes").to_pylist()), kind), return_inverse=True, return_counts=True)
                code = code.astype(np.int64)
                loss = v.loss(np.stack([np.bincount(place[flag], minlength=len(code)), n]), code // width, code % width)
            at, out = 0, [[] for _ in names]
            for part, seq, r in zip(unit.column("part").to_pylist(), unit.column("seq").to_pylist(), rows, strict=True):
                doc, back = np.unique(r >> 1, return_inverse=True)
                some = loss[:, place[at : at + len(r)]]
                at += len(r)
                sums = np.stack([np.bincount(back, z, len(doc)) for z in some]).astype("<f4")
                for c, x in zip(out, (part, seq, 0, doc.astype("<u2").tobytes(), [], [], sums.tobytes()), strict=True):
                    c.append(x)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types, strict=True)], names=names)

    return run


def _gather(batches):
    """Over rows sorted by batch of documents: their ids with means of the losses."""
    for unit in groups(batches, ["part", "seq"]):
        kinds = unit.column("kind").to_pylist()
        top = kinds.index(1)
        docs, words = unit.column("docs")[top].as_py(), np.array(unit.column("words")[top].as_py(), np.int64)
        sums = np.frombuffer(unit.column("sums")[top].as_py(), "<f8").reshape(2, -1).copy()
        for k, r, s in zip(kinds, unit.column("rows"), unit.column("sums"), strict=True):
            if k == 0:
                at = np.frombuffer(r.as_py(), "<u2")
                sums[:, at] += np.frombuffer(s.as_py(), "<f4").reshape(2, -1)
        empty = words == 0
        mean = sums / np.maximum(words, 1)
        yield pa.RecordBatch.from_arrays([pa.array(docs, pa.int64()), pa.array(words), *(pa.array(x, pa.float64(), mask=empty) for x in (mean[0], mean[1], mean[0] - mean[1]))], names=["doc_id", "n_words", "target_loss", "background_loss", "score"])


def score(docs: DataFrame, target: DataFrame) -> DataFrame:
    """doc_id, n_words, target_loss, background_loss and score of each row; target: a table of the doc_ids of target documents."""
    integer_ids(docs)
    spark = docs.sparkSession
    rows = _flagged(docs, target.where("doc_id is not null").select("doc_id").distinct())
    v = vocabulary(rows)
    shared = spark.sparkContext.broadcast(v)
    both = spark.sparkContext.broadcast((v, _common_pairs(rows, shared)))
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), int(v.counts[1].sum() / PART) + 1)
    sent = rows.mapInArrow(lean(_send(both, parts)), _SENT).repartition(parts, "p").sortWithinPartitions("p", "kind", "part", "seq")
    scored = sent.mapInArrow(lean(_score(both)), "part long, seq long, kind int, rows binary, docs array<long>, words array<long>, sums binary")
    back = scored.repartition(parts, "part", "seq").sortWithinPartitions("part", "seq", "kind")
    return back.mapInArrow(lean(_gather), "doc_id long, n_words long, target_loss double, background_loss double, score double")
