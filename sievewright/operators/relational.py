"""Building blocks: first-wins, all-agree, running totals, chains, prefixes and spans, in forms that hold for large tables."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def first_by(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row of each group. A minimum of structs, summed before the shuffle, where a window would sort each group."""
    rest = [c for c in df.columns if c not in keys]
    led = F.struct(*order, *(c for c in rest if c not in order))
    return df.groupBy(*keys).agg(F.min(led).alias("_first")).select(*((F.col(c) if c in keys else F.col(f"_first.{c}")).alias(c) for c in df.columns))


def tally(df: DataFrame, key: str, count: str = "n") -> DataFrame:
    """Rows of each value, most first, then by value."""
    return df.groupBy(key).agg(F.count("*").alias(count)).orderBy(F.desc(count), key)


def unique(df: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose key no other row has. The groups are counted before the shuffle; rows then meet counts of one only."""
    single = df.groupBy(*(F.col(k).alias(f"_key_{k}") for k in keys)).agg(F.count("*").alias("_n")).where("_n = 1").drop("_n")
    same = None
    for k in keys:  # a null key is a key like any other
        one = F.col(k).eqNullSafe(F.col(f"_key_{k}"))
        same = one if same is None else same & one
    return df.join(single, same, "left_semi")


def proven(df: DataFrame, keys: list[str], ok: Column) -> DataFrame:
    """Groups all of whose rows are ok; an unknown row is not ok."""
    return df.groupBy(*keys).agg(F.bool_and(F.coalesce(ok, F.lit(False))).alias("_ok"), F.count("*").alias("n")).where("_ok").drop("_ok")


def agreed(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """The one value of each group, null where rows differ or one is null."""
    one = (F.min(value) == F.max(value)) & (F.count(value) == F.count("*"))
    return df.groupBy(*keys).agg(F.when(one, F.min(value)).alias(value))


def classify(df: DataFrame, rules: list[tuple[str, Column]], column: str = "class", otherwise: str | None = None) -> DataFrame:
    """The first rule that holds, in order; an unknown condition doesn't hold."""
    chain = None
    for name, condition in rules:
        chain = F.when(condition, F.lit(name)) if chain is None else chain.when(condition, F.lit(name))
    return df.withColumn(column, chain.otherwise(F.lit(otherwise)) if otherwise is not None else chain)


#: Rows of a range of a running total.
RANGE = 500_000


def running_total(df: DataFrame, order: Column, value: Column, column: str, ties: list[str], blocks: int | None = None) -> DataFrame:
    """The sum of value over this row and all before it, without putting all rows in one task.

    blocks: so many ranges; by default 64, and more where a range would have over RANGE rows. Rows fall into ranges between approximate quantiles of a numeric order; totals of the ranges before are added to a window within each range. Ties of the order stay in one range.
    """
    keyed = df.withColumn("_order", order.cast("double"))
    blocks = blocks or max(64, -(-keyed.count() // RANGE))
    cuts = sorted(set(keyed.stat.approxQuantile("_order", [k / blocks for k in range(1, blocks)], min(0.005, 0.3 / blocks)))) if blocks > 1 else []
    bounds = F.array(*map(F.lit, cuts)) if cuts else F.array().cast("array<double>")
    keyed = keyed.withColumn("_range", F.when(F.col("_order").isNull(), -1).otherwise(F.size(F.filter(bounds, lambda b: b < F.col("_order"))))).withColumn("_value", value)
    totals = keyed.groupBy("_range").agg(F.sum("_value").alias("_sum"))
    before = totals.select("_range", F.coalesce(F.sum("_sum").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    within = Window.partitionBy("_range").orderBy("_order", *ties).rowsBetween(Window.unboundedPreceding, 0)
    done = keyed.withColumn("_within", F.sum("_value").over(within)).join(F.broadcast(before), "_range")
    return done.withColumn(column, F.coalesce("_within", F.lit(0)) + F.col("_before")).drop("_order", "_range", "_value", "_within", "_before")


def limited(df: DataFrame, order: Column, counts: Column, most: int, ties: list[str]) -> DataFrame:
    """Rows up to and with the one that brings the number of counted rows to `most`; 0: all. Other rows are free."""
    if not most:
        return df
    cost = F.when(counts, 1).otherwise(0)
    total = running_total(df.withColumn("_cost", cost), order, F.col("_cost"), "_total", ties)
    return total.where(F.col("_total") - F.col("_cost") < most).drop("_cost", "_total")


def closure(edges: DataFrame, start: DataFrame) -> DataFrame:
    """All nodes that start's (node) reach over edges (src, dst). Each round looks only from nodes that are new, so it ends on cycles too; written between rounds by checkpoint."""
    spark = start.sparkSession
    found = new = start.select("node").distinct()
    while True:
        new = new.join(edges, F.col("node") == F.col("src")).select(F.col("dst").alias("node")).distinct().join(found, "node", "left_anti")
        new = _cut(spark, new)
        if new.isEmpty():
            return found
        found = _cut(spark, found.union(new))


def _shared(spark) -> str:
    """The folder that spark.checkpoint.dir names; a temporary one where it is unset, as in tests, but on a local master alone."""
    sc = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if folder:
        return folder
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        if not sc.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir has to name a folder that driver and executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="sievewright-"))
    return sc._jsc.sc().getCheckpointDir().get()


#: The largest side of a join that Spark may broadcast by itself once tables are cut, in bytes as they are stored.
BROADCAST = 1 << 17


def _modest(spark) -> None:
    """Lower the sizes up to which Spark broadcasts. It goes by stored bytes; texts that are alike have many times those in memory, and each join collects its table to the driver."""
    name = "spark.sql.autoBroadcastJoinThreshold"
    for of in (name, name.replace("sql.", "sql.adaptive.")):
        most = spark.conf.get(of, None) or spark.conf.get(name)
        if not most.removesuffix("b").lstrip("-").isdigit() or int(most.removesuffix("b")) > BROADCAST:
            spark.conf.set(of, str(BROADCAST))


#: The largest part of a join's smaller side that is held by its keys instead of sorted, in bytes as they are shuffled.
HASHED = 64 << 20


@contextlib.contextmanager
def hashed(spark):
    """Joins that run within keep the smaller side of each part by its keys, where all parts are small; sorting long keys on both sides costs several times that. The setting is as before in the end."""
    name = "spark.sql.adaptive.maxShuffledHashJoinLocalMapThreshold"
    before = spark.conf.get(name)
    if before in ("0", "0b"):
        spark.conf.set(name, f"{HASHED}b")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def _cut(spark, df: DataFrame) -> DataFrame:
    """df with its lineage cut by a table written into the shared folder, which costs one pass; it goes when the process ends."""
    _modest(spark)
    sc = spark.sparkContext
    path = f"{_shared(spark).rstrip('/')}/sievewright-{sc.applicationId}/cut-{uuid.uuid4().hex}"
    df.write.parquet(path)
    atexit.register(_delete, sc, path)
    return spark.read.schema(df.schema).parquet(path)


def _delete(sc, path: str) -> None:
    with contextlib.suppress(Exception):  # the session may have ended; the folder then stays for the cluster's own cleaning
        p = sc._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(sc._jsc.hadoopConfiguration()).delete(p, True)


def checkpointed(df: DataFrame) -> DataFrame:
    """df with its lineage cut: computed once, and kept in the shared folder."""
    return _cut(df.sparkSession, df)


#: So many rows go to every task of a join.
FEW_ROWS = 1000


def small(df: DataFrame) -> DataFrame:
    """df, sent to every task of a join if it has few rows: Spark doesn't know the size of a table made in the driver, and would deal out the other side by keys of which there are few."""
    return F.broadcast(df) if df.limit(FEW_ROWS + 1).count() <= FEW_ROWS else df


def dealt(df: DataFrame, *keys: str) -> DataFrame:
    """df dealt out evenly by keys, for costly work on each row: a small compressed table is read by one task, however many rows it has."""
    spark = df.sparkSession
    return df.repartition(max(4 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))), *keys)


def ancestors(df: DataFrame, path: str, column: str = "directory") -> DataFrame:
    """A row for each directory above a path, the root ("") included."""
    parts = F.split(path, "/")
    n = F.size(parts) - 1
    return df.withColumn(column, F.explode(F.transform(F.sequence(F.lit(0), n), lambda k: F.array_join(F.slice(parts, F.lit(1), k), "/"))))


def nearest(files: DataFrame, modules: DataFrame, path: str, directory: str, value: str) -> DataFrame:
    """For each file the value of the module whose directory is the nearest above it; null if none is. An equality join over the file's ancestors, not a scan of prefixes."""
    up = ancestors(files.select(path).distinct(), path, directory).join(modules.select(directory, value), directory)
    best = up.groupBy(path).agg(F.max_by(value, F.length(directory)).alias(value))
    return files.join(best, path, "left")


def contained(points: DataFrame, spans: DataFrame, key: str, at: str, start: str, end: str, width: int = 4096) -> DataFrame:
    """Points with the spans [start, end) that hold them, joined by bins of offsets instead of all pairs of a key."""
    binned = spans.withColumn("_bin", F.explode(F.sequence(F.floor(F.col(start) / width), F.floor((F.col(end) - 1) / width)))).where(F.col(start) < F.col(end))
    placed = points.withColumn("_bin", F.floor(F.col(at) / width))
    return placed.join(binned, [key, "_bin"]).where((F.col(start) <= F.col(at)) & (F.col(at) < F.col(end))).drop("_bin")


def outside(points: DataFrame, spans: DataFrame, key: str, at: str, start: str, end: str) -> DataFrame:
    """Points that no span holds."""
    held = contained(points, spans, key, at, start, end).select(key, at).distinct()
    return points.join(held, [key, at], "left_anti")


def difference(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows of either table that the other lacks, as often as they are over, with `side`."""
    return a.exceptAll(b).withColumn("side", F.lit("left")).unionByName(b.exceptAll(a).withColumn("side", F.lit("right")))


def follow(links: DataFrame, start: DataFrame, most: int = 40) -> DataFrame:
    """name and end: each start followed along links (src, dst) to where they end; null on a cycle. Links double their reach each round."""
    spark = start.sparkSession
    jump = links.groupBy("src").agg(F.min("dst").alias("dst"))
    now = start.select(F.col("node").alias("name")).distinct().withColumn("end", F.col("name"))
    for _ in range(most):
        now = _cut(spark, now.join(jump, F.col("end") == F.col("src"), "left").select("name", F.coalesce("dst", "end").alias("end")))
        far = jump.alias("a").join(jump.alias("b"), F.col("a.dst") == F.col("b.src"), "left").select(F.col("a.src").alias("src"), F.coalesce("b.dst", "a.dst").alias("dst"))
        jump = _cut(spark, far)
        if now.join(links.select("src").distinct(), F.col("end") == F.col("src"), "left_semi").isEmpty():
            return now
        if _ >= 12:  # 2 ** 12 links on: what still moves goes round
            break
    loops = links.select("src").distinct()
    return now.join(loops, F.col("end") == F.col("src"), "left").select("name", F.when(F.col("src").isNull(), F.col("end")).alias("end"))
