"""Nearest neighbours by largest inner product: stable projections of few dimensions, indexed by kd-trees.

Inner products become distances: with M the largest norm, x goes to (x, sqrt(M * M - x.x)) and a query q to (q, 0), so the
nearest x has the largest q.x. DIMENSIONS Gaussian (2-stable) projections keep distances: the squared projected distance
over the squared true one is chi-square distributed with DIMENSIONS degrees of freedom. Projected neighbours are taken
from kd-tree leaves in order of distance and verified on the original vectors, until the next leaf's squared projected
distance passes the CONFIDENCE quantile of chi-square times the squared true distance of the k-th best so far: a true
neighbour beyond has been missed with a probability of 1 - CONFIDENCE at most.

A kd-tree over a sample of at most SAMPLE projected vectors cuts space into cells; every vector is in one. A query is
searched in its own cell first, and the distance found there rules out cells by the same test. Many queries share a
vector's work: equal vectors are one class, of which the k + 1 smallest ids are kept, more than which no query can return.

An empty table gives no rows. Null vectors, zero vectors, vectors holding null or non-finite components, vectors of another length than most, and rows
without an id take no part. Ties go to the smaller id. Rows that repeat an id are that id's own rows to a query.
"""

from __future__ import annotations

from statistics import NormalDist

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import lean, stored

DIMENSIONS, CONFIDENCE, LEAF = 8, 0.98, 256
#: Rows of a cell: at most about CELL, and no fewer than LEAST_CELL for the sake of more tasks; a cell's best come close to the answer.
CELL, LEAST_CELL, SAMPLE, QUERY_BLOCK = 131_072, 4096, 50_000, 50_000


def chi_square(p: float, m: int) -> float:
    """The p-quantile of chi-square with m degrees of freedom (Wilson and Hilferty's approximation)."""
    return m * (1 - 2 / (9 * m) + NormalDist().inv_cdf(p) * (2 / (9 * m)) ** 0.5) ** 3


def _projection(d: int) -> np.ndarray:
    return np.random.default_rng(97).standard_normal((d + 1, DIMENSIONS))


def _projected(x: np.ndarray, norm: float, query: bool) -> np.ndarray:
    last = np.zeros(len(x)) if query else np.sqrt(np.maximum(norm * norm - (x * x).sum(1), 0))
    return np.column_stack((x, last)) @ _projection(x.shape[1])


def split(p: np.ndarray, leaf: int) -> list[np.ndarray]:
    """Rows of each kd-tree leaf: halves along the widest side, until no more than `leaf` rows are left."""
    done, todo = [], [np.arange(len(p))]
    while todo:
        rows = todo.pop()
        side = p[rows].max(0) - p[rows].min(0) if len(rows) else np.zeros(p.shape[1])
        if len(rows) <= leaf or not side.max():
            done.append(rows)
            continue
        order = rows[np.argpartition(p[rows, side.argmax()], len(rows) // 2)]
        todo += [order[: len(rows) // 2], order[len(rows) // 2 :]]
    return done


class Cells:
    """A kd-tree over the whole space: planes fitted to a sample, and a number for each cell."""

    def __init__(self, sample: np.ndarray, count: int):
        m = sample.shape[1]
        self.nodes: list[tuple[int, float, int, int]] = []  # side, place, below, above; or -1, 0, cell, 0
        self.low, self.high = [], []

        def grow(rows: np.ndarray, n: int, low: np.ndarray, high: np.ndarray) -> int:
            at = len(self.nodes)
            self.nodes.append((-1, 0.0, len(self.low), 0))
            spread = np.ptp(sample[rows], axis=0) if len(rows) else np.zeros(m)
            if n <= 1 or not spread.max(initial=0):
                self.low.append(low)
                self.high.append(high)
                return at
            side = int(spread.argmax())
            place = float(np.quantile(sample[rows, side], (n // 2) / n))
            under, over = high.copy(), low.copy()
            under[side] = over[side] = place
            below = grow(rows[sample[rows, side] <= place], n // 2, low, under)
            above = grow(rows[sample[rows, side] > place], n - n // 2, over, high)
            self.nodes[at] = (side, place, below, above)
            return at

        grow(np.arange(len(sample)), count, np.full(m, -np.inf), np.full(m, np.inf))
        self.low, self.high = np.array(self.low), np.array(self.high)

    def of(self, p: np.ndarray) -> np.ndarray:
        out, todo = np.zeros(len(p), np.int32), [(0, np.arange(len(p)))]
        while todo:
            node, rows = todo.pop()
            side, place, below, above = self.nodes[node]
            if side < 0:
                out[rows] = below
            else:
                under = p[rows, side] <= place
                todo += [(below, rows[under]), (above, rows[~under])]
        return out

    def squared(self, p: np.ndarray) -> np.ndarray:
        """Squared distances of points to cells."""
        gap = np.maximum(np.maximum(self.low[None] - p[:, None], p[:, None] - self.high[None]), 0)
        return (gap * gap).sum(2)


class Index:
    """The vectors of one cell, under a kd-tree of their projections."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, norm: float):
        p = _projected(x, norm, False)
        self.leaves = split(p, LEAF)
        self.ids, self.x, self.norm = ids, x, norm
        self.low = np.array([p[r].min(0) for r in self.leaves])
        self.high = np.array([p[r].max(0) for r in self.leaves])

    def search(self, q: np.ndarray, k: int, bound: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places and inner products of the k best of each query, -1 and -inf where there are fewer; bound: k-th best inner products known before."""
        pq, stop = _projected(q, self.norm, True), chi_square(CONFIDENCE, DIMENSIONS)
        gap = np.maximum(np.maximum(self.low[None] - pq[:, None], pq[:, None] - self.high[None]), 0)
        near = (gap * gap).sum(2)
        order = np.argsort(near, axis=1, kind="stable")
        square = (q * q).sum(1) + self.norm**2
        place, score = np.full((len(q), k), -1, np.int64), np.full((len(q), k), -np.inf)
        active, start, step = np.arange(len(q)), 0, 1
        while len(active) and start < len(self.leaves):
            take = order[active, start : start + step]
            distance = np.maximum(square[active] - 2 * np.maximum(score[active, -1], bound[active]), 0)
            wanted = ~(near[active[:, None], take] > stop * distance[:, None])
            for leaf in np.unique(take[wanted]):
                rows, who = self.leaves[leaf], active[((take == leaf) & wanted).any(1)]
                found = np.concatenate((score[who], q[who] @ self.x[rows].T), 1)
                at = np.concatenate((place[who], np.broadcast_to(rows, (len(who), len(rows)))), 1)
                # The larger product first, then the smaller id.
                best = np.argsort(-found, axis=1, kind="stable")[:, :k] if found.shape[1] <= 2 * k else self._best(found, at, k)
                score[who], place[who] = np.take_along_axis(found, best, 1), np.take_along_axis(at, best, 1)
            active = active[wanted[:, -1]]
            start, step = start + step, step * 2
        return place, score

    def _best(self, found: np.ndarray, at: np.ndarray, k: int) -> np.ndarray:
        least = np.partition(found, -k, axis=1)[:, -k]
        out = np.empty((len(found), k), np.int64)
        for row in range(len(found)):
            c = np.flatnonzero(found[row] >= least[row])
            out[row] = c[np.lexsort((self.ids[at[row, c]], -found[row, c]))][:k]
        return out


def _floats(column) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), "<f8").reshape(len(column), -1) if len(column) else np.zeros((0, 1))


def _classes(vectors: DataFrame, k: int, is_query: Column) -> DataFrame:
    """cid, vec (doubles as bytes), first (smallest id), ids (the k + 1 smallest), asked (whether a query has this vector)."""
    good = F.col("embedding").isNotNull() & F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))) & F.exists("embedding", lambda x: x != 0)
    rows = vectors.select("vec_id", F.col("embedding").cast("array<double>").alias("embedding")).where(F.col("vec_id").isNotNull() & good)
    length = rows.groupBy(F.size("embedding").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).select("d").limit(1)
    rows = rows.join(F.broadcast(length), F.size("embedding") == F.col("d")).select("vec_id", F.xxhash64("embedding").alias("cid"), "embedding", is_query.alias("asked"))
    rank = F.row_number().over(Window.partitionBy("cid").orderBy("vec_id"))
    ids = rows.select("cid", "vec_id").withColumn("r", rank).where(F.col("r") <= k + 1).groupBy("cid").agg(F.array_sort(F.collect_list("vec_id")).alias("ids"))
    found = rows.groupBy("cid").agg(F.first("embedding").alias("embedding"), F.min("vec_id").alias("first"), F.max("asked").alias("asked")).join(ids, "cid")

    def pack(batches):
        for b in batches:
            vec = [np.array(v, "<f8").tobytes() for v in b.column("embedding").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("cid"), pa.array(vec, pa.binary()), b.column("first"), b.column("ids"), b.column("asked")], names=["cid", "vec", "first", "ids", "asked"])

    return found.select("cid", "embedding", "first", "ids", "asked").mapInArrow(lean(pack), "cid long, vec binary, first long, ids array<long>, asked boolean")


def _searched(norm: float, k: int):
    """Over rows sorted by cell, salt and kind (0: vectors, 1: queries): the k best of the cell's vectors for each query."""

    def answers(index, queries):
        cid, bound = queries.column("cid").to_numpy(), queries.column("bound").to_numpy()
        place, score = index.search(_floats(queries.column("vec")), k, bound)
        row, column = np.nonzero((place >= 0) & (score >= bound[:, None]))
        q, at = _floats(queries.column("vec")), place[row, column]
        exact = np.concatenate([np.cumsum(q[row[a : a + 4096]] * index.x[at[a : a + 4096]], axis=1)[:, -1] for a in range(0, len(row), 4096)]) if len(row) else np.zeros(0)
        return pa.RecordBatch.from_arrays([pa.array(cid[row]), pa.array(index.names[at]), pa.array(index.ids[at]), pa.array(exact)], names=["query", "cid", "first", "score"])

    def run(batches):
        at, parts, index = None, [], None
        for batch in batches:
            if not batch.num_rows:
                continue
            key = [batch.column(c).to_numpy() for c in ("cell", "salt", "kind")]
            change = np.flatnonzero((key[0][1:] != key[0][:-1]) | (key[1][1:] != key[1][:-1]) | (key[2][1:] != key[2][:-1])) + 1
            cuts = [0, *change.tolist(), batch.num_rows]
            for a, b in zip(cuts, cuts[1:], strict=False):
                part, unit = batch.slice(a, b - a), (key[0][a], key[1][a])
                if unit != at:
                    at, parts, index = unit, [], None
                if key[2][a] == 0:
                    parts.append((part.column("cid").to_numpy(), part.column("first").to_numpy(), _floats(part.column("vec"))))
                elif parts or index:
                    if index is None:
                        index = Index(np.concatenate([x[1] for x in parts]), np.concatenate([x[2] for x in parts]), norm)
                        index.names = np.concatenate([x[0] for x in parts])
                        parts = []
                    for s in range(0, part.num_rows, 256):
                        yield answers(index, part.slice(s, 256))

    return run


def neighbours(vectors: DataFrame, k: int, is_query: Column) -> DataFrame:
    """The k nearest of each query row: query_id, rank, vec_id, score."""
    spark = vectors.sparkSession
    schema = "query long, cid long, first long, score double"
    classes = stored(_classes(vectors, k, is_query), "vectors")

    def norms(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array((_floats(b.column("vec")) ** 2).sum(1) if b.num_rows else [], pa.float64())], names=["square"])

    n, square = classes.select("vec").mapInArrow(lean(norms), "square double").agg(F.count("*"), F.max("square")).first()
    if not n:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    norm = square**0.5
    picked = classes.where(F.pmod("cid", F.lit(1 << 20)) < max(1, int(2**20 * min(1.0, 0.9 * SAMPLE / n)))).select("vec").limit(SAMPLE).toPandas()["vec"]
    sample = _projected(np.array([np.frombuffer(v, "<f8") for v in picked]), norm, False) if len(picked) else np.zeros((0, DIMENSIONS))
    cells = spark.sparkContext.broadcast(Cells(sample, min(max(-(-n // CELL), min(int(spark.conf.get("spark.sql.shuffle.partitions")), n // LEAST_CELL)), max(1, len(sample) // 8))))

    def place(batches):
        for b in batches:
            if b.num_rows:
                yield pa.RecordBatch.from_arrays([pa.array(cells.value.of(_projected(_floats(b.column("vec")), norm, False))), *(b.column(c) for c in ("cid", "vec", "first", "asked"))], names=["cell", "cid", "vec", "first", "asked"])

    placed = stored(classes.select("cid", "vec", "first", "asked").mapInArrow(lean(place), "cell int, cid long, vec binary, first long, asked boolean"), "cells")
    queries = placed.where("asked")

    def search(asking):
        """asking: cell, cid, vec, first, bound. A cell's queries are dealt out by QUERY_BLOCK, and its vectors are copied to each part; cells that no query asks are left out."""
        salts = F.broadcast(asking.groupBy("cell").agg(F.ceil(F.count("*") / QUERY_BLOCK).cast("int").alias("salts")))
        stock = placed.join(salts, "cell").select("cell", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), F.lit(0).alias("kind"), "cid", "vec", "first", F.lit(0.0).alias("bound"))
        rows = stock.union(asking.join(salts, "cell").select("cell", F.pmod("cid", F.col("salts")).cast("int").alias("salt"), F.lit(1).alias("kind"), "cid", "vec", "first", "bound"))
        dealt = rows.repartition("cell", "salt").sortWithinPartitions("cell", "salt", "kind")
        return dealt.mapInArrow(lean(_searched(norm, k + 1)), schema)

    home = stored(search(queries.select("cell", "cid", "vec", "first", F.lit(float("-inf")).alias("bound"))), "home")
    known = home.groupBy("query").agg(F.when(F.count("*") > k, F.min("score")).otherwise(F.lit(float("-inf"))).alias("bound"))
    bounded = queries.join(known.withColumnRenamed("query", "cid"), "cid", "left").withColumn("bound", F.coalesce("bound", F.lit(float("-inf"))))

    def reach(batches):
        for b in batches:
            if not b.num_rows:
                continue
            q, bound = _floats(b.column("vec")), b.column("bound").to_numpy()
            distance = np.maximum((q * q).sum(1) + norm**2 - 2 * bound, 0)
            for s in range(0, len(q), 512):
                near = cells.value.squared(_projected(q[s : s + 512], norm, True)) <= chi_square(CONFIDENCE, DIMENSIONS) * distance[s : s + 512, None]
                near[np.arange(len(near)), b.column("cell").to_numpy()[s : s + 512]] = False
                row, cell = np.nonzero(near)
                at = pa.array(row + s)
                yield pa.RecordBatch.from_arrays([pa.array(cell.astype(np.int32)), *(b.column(c).take(at) for c in ("cid", "vec", "first", "bound"))], names=["cell", "cid", "vec", "first", "bound"])

    asks = stored(bounded.select("cell", "cid", "vec", "first", "bound").mapInArrow(lean(reach), "cell int, cid long, vec binary, first long, bound double"), "asks")
    far = search(asks)
    best = Window.partitionBy("query").orderBy(F.desc("score"), "first")
    top = home.union(far).withColumn("r", F.row_number().over(best)).where(F.col("r") <= k + 1)
    rows = top.join(classes.select("cid", "ids"), "cid").select("query", "score", F.explode("ids").alias("vec_id"))
    order = Window.partitionBy("query").orderBy(F.desc("score"), "vec_id")
    lists = rows.withColumn("r", F.row_number().over(order)).where(F.col("r") <= k + 1).groupBy("query").agg(F.array_sort(F.collect_list(F.struct("r", "vec_id", "score"))).alias("found"))

    good = F.forall("embedding", lambda x: x.isNotNull())
    askers = vectors.where(is_query & good).select(F.col("vec_id").cast("long").alias("query_id"), F.xxhash64(F.col("embedding").cast("array<double>")).alias("query"))
    others = F.slice(F.filter("found", lambda x: x["vec_id"] != F.col("query_id")), 1, k)
    out = askers.join(lists, "query").select("query_id", F.posexplode(others).alias("p", "x"))
    return out.select("query_id", (F.col("p") + 1).alias("rank"), F.col("x.vec_id").alias("vec_id"), F.col("x.score").alias("score"))
