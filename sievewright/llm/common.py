"""Helpers that several operators of this subpackage share."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import tempfile
import uuid

import numpy as np
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes that end a word when only ASCII white space does.
_SEPARATORS = bytes([*range(0x00, 0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)])
#: Lower-cases A-Z and turns every ASCII byte that is neither letter nor digit into a blank.
_ALNUM = bytes((b + 32 if 0x41 <= b <= 0x5A else 0x20 if b in _SEPARATORS else b) for b in range(256))


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{table}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir; where that is unset, as in tests, a temporary one, but on a local master alone."""
    sc = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if found:
        return found
    held = sc._jsc.sc().getCheckpointDir()
    if held.isDefined():
        return held.get()
    if not sc.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir has to name a folder that driver and executors share")
    made = tempfile.mkdtemp(prefix="sievewright-")
    sc.setCheckpointDir(made)
    return made


def _delete(sc, path: str) -> None:
    try:
        p = sc._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(sc._jsc.hadoopConfiguration()).delete(p, True)
    except Exception:  # the session may have ended; the folder then stays for the cluster's own cleaning
        pass


_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def kept_path(spark: SparkSession, name: str) -> str:
    """A new place in the shared folder, which goes when this process ends."""
    sc = spark.sparkContext
    path = f"{shared_dir(spark).rstrip('/')}/sievewright-{sc.applicationId}/{name}-{uuid.uuid4().hex[:12]}"
    atexit.register(_delete, sc, path)
    return path


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write a table into the shared folder and read it again, which cuts its lineage and survives lost executors. Shuffle files of the write go when it has ended."""
    spark = df.sparkSession
    path = kept_path(spark, name)
    before = spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(_CLEANUP, before)
    out = spark.read.schema(df.schema).parquet(path)
    out._sw_path = path
    return out


def spent(*tables: DataFrame) -> None:
    """Delete stored tables of which nothing that is still to run reads."""
    for t in tables:
        _delete(t.sparkSession.sparkContext, t._sw_path)


#: Rows of a key below which a join does not deal it out.
HOT = 1000


def salted(left: DataFrame, right: DataFrame, on: list[str], how: str = "inner") -> DataFrame:
    """Join in which the left rows of a frequent key are dealt out over several tasks, and its right rows copied to each.

    Frequent is a key with more than HOT rows that holds more than 1 / (4 * partitions) of left's: at most 4 * partitions
    keys, so the table of them can be broadcast. left should be a stored table, as it is read twice. how: inner or left.
    """
    n = int(left.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    counts = left.groupBy(*on).agg(F.count("*").alias("_sw_n")).where(F.col("_sw_n") > HOT)
    if counts.limit(1).isEmpty():
        return left.join(right, on, how)
    most = max(HOT, left.count() // (4 * n))
    hot = F.broadcast(stored(counts.where(F.col("_sw_n") > most).select(*on, F.ceil(F.col("_sw_n") / most).cast("int").alias("_sw_salts")), "hot"))
    own = [c for c in left.columns if c not in on]
    salt = F.coalesce(F.pmod(F.xxhash64(*own), F.col("_sw_salts")).cast("int"), F.lit(0))
    mine = left.join(hot, on, "left").withColumn("_sw_salt", salt).drop("_sw_salts")
    copies = F.sequence(F.lit(0), F.coalesce("_sw_salts", F.lit(1)) - 1)
    theirs = right.join(hot, on, "left").withColumn("_sw_salt", F.explode(copies)).drop("_sw_salts")
    return mine.join(theirs, [*on, "_sw_salt"], how).drop("_sw_salt")


def shielded(docs: DataFrame):
    """docs with columns of its own that begin with _sw_ under other names, and a function that gives them back."""
    names = {c: f"_kept_{k}_{c}" for k, c in enumerate(docs.columns) if c.startswith("_sw_")}
    return docs.withColumnsRenamed(names), lambda df: df.withColumnsRenamed({v: k for k, v in names.items()})


def integer_ids(docs: DataFrame) -> None:
    """ValueError unless doc_id is of an integer type, as results carry it as a long."""
    if dict(docs.dtypes)["doc_id"] not in ("tinyint", "smallint", "int", "bigint"):
        raise ValueError("doc_id has to be of an integer type")


def alnum_words(text: bytes) -> list[bytes]:
    """Words [^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+ of a text with A-Z lower-cased."""
    return text.translate(_ALNUM).split()


def space_words(text: bytes) -> list[bytes]:
    """Words [^\\x20\\x09-\\x0D]+ of a text with A-Z lower-cased."""
    return text.lower().split()


def _lower(session: SparkSession) -> None:
    """Keep Arrow batches small enough for several Python workers beside an executor's heap; smaller settings stay."""
    for name, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", 500), ("spark.sql.execution.arrow.maxBytesPerBatch", 4 << 20)):
        now = "".join(c for c in (session.conf.get(name, None) or "") if c.isdigit())
        if not now or int(now) > most:
            session.conf.set(name, str(most))


def lean(run):
    """A function for mapInArrow that gives memory back when its task ends; workers live on and run other operators' tasks."""
    if session := SparkSession.getActiveSession():
        _lower(session)

    def go(batches):
        yield from run(batches)
        trim()

    return go


def trim() -> None:
    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    with contextlib.suppress(AttributeError, OSError):  # only glibc has it
        ctypes.CDLL(None).malloc_trim(0)


class WordIds(dict):
    """64-bit hashes of words, kept while there are not too many."""

    LIMIT = 100_000
    _held: WordIds | None = None

    @classmethod
    def shared(cls) -> WordIds:
        """One table for all tasks of a worker process."""
        if cls._held is None:
            cls._held = cls()
        return cls._held

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.LIMIT:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def mix64(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64, a bijection of 64-bit values."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def groups(batches, keys: list[str]):
    """Record batches, one for each run of equal integer keys in rows that come sorted by them."""
    import pyarrow as pa

    held, at = [], None
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch.column(k).to_numpy(zero_copy_only=False) for k in keys]
        change = np.zeros(batch.num_rows, bool)
        for c in columns:
            change[1:] |= c[1:] != c[:-1]
        cuts = [0, *np.flatnonzero(change).tolist(), batch.num_rows]
        for a, b in zip(cuts, cuts[1:], strict=False):
            key = tuple(c[a] for c in columns)
            if held and key != at:
                yield held[0] if len(held) == 1 else pa.Table.from_batches(held).combine_chunks().to_batches()[0]
                held = []
            held.append(batch.slice(a, b - a))
            at = key
    if held:
        yield held[0] if len(held) == 1 else pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def forest(linked_to, labels: np.ndarray) -> list[tuple[int, int]]:
    """Pairs that join all linked places: linked_to(i) gives the places linked with i; labels are equal for places known to be joined, and are changed."""
    out = []
    for i in range(len(labels)):
        to = linked_to(i)
        to = to[labels[to] != labels[i]]
        while len(to):
            j = int(to[0])
            out.append((i, j))
            labels[labels == labels[j]] = labels[i]
            to = to[labels[to] != labels[i]]
    return out


def components(edges: DataFrame) -> DataFrame:
    """node and component (its smallest node) of every node of edges (a, b), by alternating large-star and small-star steps.

    Each step groups and joins by node; a hub's rows are summed before the shuffle and its join can be split.
    """
    now = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u != v").distinct()
    now, last = stored(now, "edges"), None
    while True:
        both = now.union(now.select("v", "u"))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").union(least.select("u", "m")).distinct()
        now = stored(small, "edges")
        seen = now.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("x")).first()
        if seen == last:
            break
        last = seen
    roots = now.select("v").distinct().select(F.col("v").alias("node"), F.col("v").alias("component"))
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(roots)
