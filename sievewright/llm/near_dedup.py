"""MinHash near-dedup by a multi-index Hamming join over b-bit signatures.

A document's words are `[^\\x20\\x09-\\x0D]+` after A-Z were lower-cased; its set holds its distinct shingles of SHINGLE
words (64-bit hashes), or the whole sequence as one if it has fewer words; without words it is empty and linked with
nothing. Documents are linked if 100 * |intersection| >= PERCENT * |union|.

1. A signature has SLOTS minima of hashed shingles, b bits each. Equal sets are one class (by a 128-bit sum over the set).
2. The slots are CHUNKS chunks of WIDTH. By pigeonhole, signatures that differ in at most DISTANCE slots, which is less than
   CHUNKS * (ERRORS + 1) = 32, differ in at most ERRORS = 1 slot of some chunk, so they share one of the keys that leave
   one slot of a chunk out: those are the allowed errors, enumerated. So every pair within DISTANCE meets.
3. Within a key, signatures with at most DISTANCE slots apart are joined: each group gives a spanning forest, not its
   pairs. The forests' components are candidate groups. Sets of the least similarity, 0.8, are more than DISTANCE = 31
   slots apart with a probability under 1e-7, and more similar ones more rarely.
4. Within a candidate group, full sets are compared, and links give spanning forests again; their components are the answer.

Groups over a block's size are dealt out as pairs of blocks, so no task holds a whole group. Of full sets, each block first
meets itself and one other; then only rows outside a group's largest component meet the rest, so a group of copies costs
as many block pairs as it has blocks.
Nulls and empty texts: no words. Equal texts, repeated rows and repeated doc_ids: linked like any others. Texts of any
length are read whole; a task holds the sets of one block of a candidate group. An empty table gives no rows. Other columns
are left out. Classes of different sets share their 64-bit id with a probability of n * n / 2 ** 65.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, forest, groups, lean, mix64, salted, shielded, space_words, stored, WordIds

SHINGLE, PERCENT = 2, 80
CHUNKS, WIDTH, ERRORS = 16, 4, 1
SLOTS = CHUNKS * WIDTH
#: The most that the pigeonhole principle covers.
DISTANCE = CHUNKS * (ERRORS + 1) - 1
KEY_BLOCK, SET_BLOCK = 2048, 256
_rng = np.random.default_rng(20240229)
_A = _rng.integers(0, 1 << 31, SLOTS, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
_B = _rng.integers(0, 1 << 32, SLOTS, dtype=np.uint32)


def shingles(text: str | None, ids: WordIds, width: int = SHINGLE) -> np.ndarray:
    """The distinct shingles of a text, as sorted 64-bit hashes."""
    h = ids.of(space_words((text or "").encode()))
    if not len(h):
        return h
    n = width if len(h) >= width else len(h)
    out = np.full(len(h) - n + 1, n, np.uint64)
    for k in range(n):
        out = mix64(out * np.uint64(0x9E3779B97F4A7C15) + h[k : len(h) - n + 1 + k])
    return np.unique(out)


def signature(s: np.ndarray) -> np.ndarray:
    """SLOTS minima of a set that isn't empty, 16 mixed bits each."""
    low = (s ^ (s >> np.uint64(32))).astype(np.uint32)
    least = np.full(SLOTS, 0xFFFFFFFF, np.uint32)
    for a in range(0, len(low), 2048):
        np.minimum(least, (_A[:, None] * low[None, a : a + 2048] + _B[:, None]).min(1), out=least)
    return (mix64(least.astype(np.uint64) + np.uint64(1)) >> np.uint64(48)).astype("<u2")


def set_key(s: np.ndarray) -> tuple[int, int]:
    """128 bits that stand for a set."""
    a, b = mix64(s).sum(dtype=np.uint64), mix64(s ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64)
    return int(a.astype(np.int64)), int(b.astype(np.int64))


def sketch(docs: DataFrame, width: int = SHINGLE) -> DataFrame:
    """doc_id, t (a hash of the text), n (size of the set), k1, k2 (the set's key) and sig of each row."""
    kind = dict(docs.dtypes)["doc_id"]

    def run(batches):
        ids = WordIds.shared()
        for batch in batches:
            n, k1, k2, sig = [], [], [], []
            for x in batch.column("text"):
                s = shingles(x.as_py(), ids, width)
                a, b = set_key(s) if len(s) else (0, 0)
                n.append(len(s))
                k1.append(a)
                k2.append(b)
                sig.append(signature(s).tobytes() if len(s) else None)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("t"), pa.array(n, pa.int64()), pa.array(k1, pa.int64()), pa.array(k2, pa.int64()), pa.array(sig, pa.binary())], names=["doc_id", "t", "n", "k1", "k2", "sig"])

    return docs.select("doc_id", "text", F.xxhash64("text").alias("t")).mapInArrow(lean(run), f"doc_id {kind}, t long, n long, k1 long, k2 long, sig binary")


def _keys(classes: DataFrame) -> DataFrame:
    """key and cid: each class under each chunk with ERRORS slots left out."""

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            sig = np.frombuffer(b"".join(batch.column("sig").to_pylist()), "<u2").reshape(batch.num_rows, SLOTS).astype(np.uint64)
            cid = batch.column("cid").to_numpy()
            made = []
            for chunk in range(CHUNKS):
                for left in combinations(range(WIDTH), WIDTH - ERRORS):
                    key = np.full(len(cid), len(made) + 1, np.uint64)
                    for k in left:
                        key = mix64(key * np.uint64(0x9E3779B97F4A7C15) + sig[:, chunk * WIDTH + k])
                    made.append(key.astype(np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(made)), pa.array(np.tile(cid, len(made)))], names=["key", "cid"])

    return classes.select("cid", "sig").mapInArrow(lean(run), "key long, cid long")


def _units(rows: DataFrame, group: str, size: str, block: int) -> DataFrame:
    """Rows dealt into units of at most two blocks of their group, so that each two rows of a group meet in a unit: columns g, i, j, b added."""
    blocks = F.ceil(F.col(size) / block).cast("int")
    dealt = rows.withColumn("nb", blocks).withColumn("b", F.pmod(F.xxhash64("cid"), F.col("nb")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("nb") - 1))
    dealt = dealt.withColumn("o", other).withColumn("i", F.least("b", "o")).withColumn("j", F.greatest("b", "o")).withColumnRenamed(group, "g").drop("o", "nb", size)
    return dealt.repartition("g", "i", "j").sortWithinPartitions("g", "i", "j", "cid")


def _first_units(rows: DataFrame, block: int) -> DataFrame:
    """Rows of groups (g) dealt into units of a block with itself and with block 0: as many units as twice the blocks."""
    dealt = rows.withColumn("nb", F.ceil(F.col("size") / block).cast("int")).withColumn("b", F.pmod(F.xxhash64("cid"), F.col("nb")).cast("int"))
    meets = F.when(F.col("b") == 0, F.sequence(F.lit(0), F.col("nb") - 1)).otherwise(F.array(F.lit(0), F.col("b")))
    dealt = dealt.withColumn("o", F.explode(meets)).withColumn("i", F.when(F.col("o") == F.col("b"), F.col("b")).otherwise(0)).withColumn("j", F.greatest("b", "o")).drop("o", "nb", "size")
    return dealt.repartition("g", "i", "j").sortWithinPartitions("g", "i", "j", "cid")


def _last_units(rows: DataFrame, joined: DataFrame, block: int) -> DataFrame:
    """Rows of large groups that aren't one component yet, dealt so that each two rows meet of which at least one is outside the group's largest component."""
    parts = rows.where(F.col("size") > block).select("g", "cid").join(joined.select(F.col("node").alias("cid"), F.col("component").alias("part")), "cid", "left").withColumn("part", F.coalesce("part", "cid"))
    sizes = parts.groupBy("g", "part").agg(F.count("*").alias("n"))
    split = sizes.groupBy("g").agg(F.max(F.struct("n", "part")).alias("top"), F.sum("n").alias("all")).where("all > top.n")
    blocks = lambda n: F.ceil(n / block).cast("int")
    split = split.select("g", F.col("top.part").alias("main"), blocks(F.col("all") - F.col("top.n")).alias("nr"), blocks(F.col("top.n")).alias("nm"))
    placed = parts.join(split, "g").withColumn("rest", F.col("part") != F.col("main"))
    b = F.when(F.col("rest"), F.pmod(F.xxhash64("cid"), F.col("nr"))).otherwise(F.col("nr") + F.pmod(F.xxhash64("cid"), F.col("nm"))).cast("int")
    meets = F.sequence(F.lit(0), F.when(F.col("rest"), F.col("nr") + F.col("nm")).otherwise(F.col("nr")) - 1)
    dealt = placed.withColumn("b", b).withColumn("o", F.explode(meets)).select("g", "cid", "b", F.least("b", "o").alias("i"), F.greatest("b", "o").alias("j"))
    met = dealt.join(rows.where(F.col("size") > block).select("g", "cid", "set"), ["g", "cid"])
    return met.repartition("g", "i", "j").sortWithinPartitions("g", "i", "j", "cid")


def _edges(pairs: list[tuple[int, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([x for x, _ in pairs], pa.int64()), pa.array([x for _, x in pairs], pa.int64())], names=["a", "b"])


def _near(batches):
    """Spanning forests of signatures that are near each other, unit by unit."""
    out: list[tuple[int, int]] = []
    for unit in groups(batches, ["g", "i", "j"]):
        cid = unit.column("cid").to_numpy()
        if len(cid) < 2:
            continue
        sig = np.frombuffer(b"".join(unit.column("sig").to_pylist()), "<u2").reshape(len(cid), SLOTS).astype(np.uint8)
        size, block = unit.column("n").to_numpy(), unit.column("b").to_numpy()
        cross = unit.column("i")[0].as_py() != unit.column("j")[0].as_py()

        def near(i):
            to = np.arange(i + 1, len(cid))
            fits = (100 * np.minimum(size[to], size[i]) >= PERCENT * np.maximum(size[to], size[i])) & ((block[to] != block[i]) | (not cross))
            to = to[fits]
            return to[(sig[to] != sig[i]).sum(1) <= DISTANCE]

        out += [(int(cid[x]), int(cid[y])) for x, y in forest(near, np.arange(len(cid)))]
        if len(out) > 20_000:
            yield _edges(out)
            out = []
    yield _edges(out)


def intersections(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of each two sets."""
    n = len(sets)
    if n <= 6:
        out = np.zeros((n, n), np.int64)
        for x, y in combinations(range(n), 2):
            out[x, y] = out[y, x] = len(np.intersect1d(sets[x], sets[y], assume_unique=True))
        return out
    _, place, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = times > 1
    number = np.cumsum(shared) - 1
    row = np.repeat(np.arange(n), [len(s) for s in sets])[shared[place]]
    column = number[place[shared[place]]]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    total = np.zeros((n, n), np.float64)
    for start in range(0, int(shared.sum()), 4096):
        a, b = np.searchsorted(column, (start, start + 4096))
        x = np.zeros((n, 4096), np.float32)
        x[row[a:b], column[a:b] - start] = 1
        total += x @ x.T
    return total.astype(np.int64)


def _linked(percent: int):
    def run(batches):
        out: list[tuple[int, int]] = []
        for unit in groups(batches, ["g", "i", "j"]):
            cid, first = np.unique(unit.column("cid").to_numpy(), return_index=True)
            if len(cid) < 2:
                continue
            held = unit.column("set")
            sets = [np.frombuffer(held[int(k)].as_py(), "<u8") for k in first]
            block = unit.column("b").to_numpy()[first]
            cross = unit.column("i")[0].as_py() != unit.column("j")[0].as_py()
            size, both = np.array([len(s) for s in sets]), intersections(sets)
            link = 100 * both >= percent * (size[:, None] + size[None, :] - both)
            if cross:
                link &= block[:, None] != block[None, :]
            np.fill_diagonal(link, False)
            out += [(int(cid[x]), int(cid[y])) for x, y in forest(lambda i: np.flatnonzero(link[i]), np.arange(len(cid)))]  # noqa: B023
            if len(out) > 20_000:
                yield _edges(out)
                out = []
        yield _edges(out)

    return run


def _sets(docs: DataFrame, members: DataFrame, width: int) -> DataFrame:
    """g, cid, size and the full set of each member, whose text is that of its class's first document."""

    def run(batches):
        ids = WordIds.shared()
        for batch in batches:
            keep, sets = [], []
            for row, (x, k1, k2) in enumerate(zip(batch.column("text"), batch.column("k1").to_pylist(), batch.column("k2").to_pylist(), strict=True)):
                s = shingles(x.as_py(), ids, width)
                if len(s) and set_key(s) == (k1, k2):  # else another document with that doc_id
                    keep.append(row)
                    sets.append(s.astype("<u8").tobytes())
            at = pa.array(keep, pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column("g").take(at), batch.column("cid").take(at), batch.column("size").take(at), pa.array(sets, pa.binary())], names=["g", "cid", "size", "set"])

    found = docs.select(F.col("doc_id").alias("rep"), "text").join(members, "rep")
    return found.select("g", "cid", "size", "k1", "k2", "text").mapInArrow(lean(run), "g long, cid long, size long, set binary")


def near_duplicates(docs: DataFrame, percent: int = PERCENT, width: int = SHINGLE) -> DataFrame:
    """doc_id, n_shingles, component_id (smallest doc_id reachable over links), kept, and cid (the class of equal sets; null for empty sets), root (the same for linked classes), t (a hash of the text)."""
    if percent < PERCENT:
        raise ValueError(f"signatures are made for similarities of at least {PERCENT} %")
    sketches = stored(sketch(docs, width), "sketch")
    filled = sketches.where("n > 0")
    classes = stored(filled.groupBy("k1", "k2", "n").agg(F.min("doc_id").alias("rep"), F.first("sig").alias("sig")).withColumn("cid", F.xxhash64("k1", "k2", "n")), "classes")

    keys = _keys(classes)
    shared = keys.groupBy("key").agg(F.count("*").alias("size")).where("size > 1")
    met = keys.join(shared, "key").join(classes.select("cid", "n", "sig"), "cid")
    near = _units(met, "key", "size", KEY_BLOCK).select("g", "i", "j", "b", "cid", "n", "sig").mapInArrow(lean(_near), "a long, b long")
    loose = stored(components(near), "loose")

    sizes = loose.groupBy("component").agg(F.count("*").alias("size"))
    members = salted(loose, sizes, ["component"]).select(F.col("component").alias("g"), F.col("node").alias("cid"), "size").join(classes.select("cid", "rep", "k1", "k2"), "cid")
    sets = stored(_sets(docs, members, width), "sets")
    link = lambda units: units.select("g", "i", "j", "b", "cid", "set").mapInArrow(lean(_linked(percent)), "a long, b long")
    links = stored(link(_first_units(sets, SET_BLOCK)), "links")
    joined = stored(components(links), "joined")
    if not sets.where(F.col("size") > SET_BLOCK).isEmpty():
        joined = components(links.union(link(_last_units(sets, joined, SET_BLOCK))))

    ids = classes.select("cid", "k1", "k2", "n", "rep").join(joined.withColumnRenamed("node", "cid"), "cid", "left").withColumn("root", F.coalesce("component", "cid"))
    least = ids.where(F.col("component").isNotNull()).groupBy("root").agg(F.min("rep").alias("least"))
    ids = ids.join(least, "root", "left").select("k1", "k2", "n", "cid", "root", F.coalesce("least", "rep").alias("component_id"))
    out = salted(sketches.select("doc_id", "t", "n", "k1", "k2"), ids, ["k1", "k2", "n"], "left")
    component = F.coalesce("component_id", "doc_id")
    return out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(False)).alias("kept"), "cid", "root", "t")


def one_of_each(docs: DataFrame, percent: int = PERCENT, width: int = 5) -> DataFrame:
    """docs with one row of each group of near-duplicates: that of the smallest doc_id and, among its rows, of the smallest hash of the text.

    Rows are told apart by doc_id and text, so a row whose doc_id stands in a group's row too goes only with its own group.
    Rows without words or without doc_id stay, but of rows with equal doc_id and text one does.
    """
    docs, restore = shielded(docs)
    found = stored(near_duplicates(docs, percent, width).where("doc_id is not null").select("doc_id", "t", "root"), "kept")
    first = found.where("root is not null").groupBy("root").agg(F.min(F.struct("doc_id", "t")).alias("least"))
    gone = salted(found.where("root is not null"), first, ["root"]).where("doc_id <> least.doc_id or t <> least.t").select("doc_id", F.col("t").alias("_sw_t")).distinct()
    told = docs.withColumn("_sw_t", F.xxhash64("text"))
    left = told.join(gone, ["doc_id", "_sw_t"], "left_anti")
    if not found.groupBy("doc_id", "t").count().where("count > 1").limit(1).isEmpty():
        left = left.where("doc_id is null").unionByName(left.where("doc_id is not null").dropDuplicates(["doc_id", "_sw_t"]))
    return restore(left.select(*docs.columns))
