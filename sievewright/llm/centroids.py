"""Centroid clustering of integer vectors with block-norm screening.

Vectors are quantised once to integers x and stored with a compressed form (codes of a few bits times a power of two,
x^) and the norms of the segments of x^ and of the rest r = x - x^; centroids c = c^ + s get the same. By Cauchy-Schwarz on
each segment b, x.c is at most x^.c^ + sum of |x^_b||s_b| + |r_b|(|c^_b| + |s_b|), so |x|^2 + |c|^2 less twice that is a lower
bound of the squared distance. It tells most centroids to be further away than one already met; only the others get a
distance, in exact integers. The bound is taken down by more than its rounding error, so results are those of all
distances, ties included.

Each round is one pass over the stored vectors: a task sums its vectors by centroid (k rows of sums), and sums of tasks are added
by Spark. Centroids, k vectors of fixed length, are all that goes through the driver.
"""

from __future__ import annotations

import hashlib
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import lean, stored

#: Integers beyond this are refused: 2 * LARGEST, squared and summed over 1,024 components, still fits 63 bits.
LARGEST = 1 << 25
SEGMENT = 8
#: Bits of a code, besides its sign.
BITS = 5
#: Vectors screened at once.
BLOCK = 4096
#: Share of the squares by which a bound is lowered before it rules anything out; rounding errs by under 1e-12 of them.
SLACK = 1e-9


class Clusters(NamedTuple):
    """assigned: (id, cluster, distance), a stored table; centroids: one row of integers each."""

    assigned: DataFrame
    centroids: np.ndarray


class Screen(NamedTuple):
    """What bounds are made of, a row for each vector: codes (8-bit), the power of two they are multiplied by, segment norms of what that gives and of the rest, and the vector's own square."""

    codes: np.ndarray
    power: np.ndarray
    norms: np.ndarray
    rest: np.ndarray
    square: np.ndarray

    def bounds(self, other: Screen) -> np.ndarray:
        """A lower bound of the squared distance of each vector to each of the other's."""
        dot = np.ldexp(self.codes.astype(np.float64), self.power[:, None]) @ np.ldexp(other.codes.astype(np.float64), other.power[:, None]).T
        most = dot + self.norms @ other.rest.T + self.rest @ (other.norms + other.rest).T
        size = self.square[:, None] + other.square
        return size * (1 - SLACK) - 2 * most


def screen(q: np.ndarray) -> Screen:
    """The screen of vectors of integers up to LARGEST."""
    power = np.maximum(0, np.frexp(np.abs(q).max(1, initial=0).astype(np.float64))[1] - BITS).astype(np.int32)
    codes = np.round(np.ldexp(q.astype(np.float64), -power[:, None])).astype(np.int8)
    near = np.ldexp(codes.astype(np.float64), power[:, None])
    norms = [np.sqrt(np.add.reduceat(v * v, np.arange(0, q.shape[1], SEGMENT), axis=1)) for v in (near, q - near)]
    return Screen(codes, power, *norms, (q.astype(np.int64) ** 2).sum(1).astype(np.float64))


def nearest(q: np.ndarray, own: Screen, centroids: np.ndarray, theirs: Screen) -> tuple[np.ndarray, np.ndarray, int]:
    """The nearest centroid of each row (ties: the smaller number), its exact squared distance, and how many distances were taken.

    Centroids are met in the order of their bounds; a row is done when the next bound exceeds its best distance.
    """
    bound = own.bounds(theirs)
    order = np.argsort(bound, axis=1, kind="stable")
    best, who = np.full(len(q), np.iinfo(np.int64).max), np.full(len(q), len(centroids))
    rows, taken = np.arange(len(q)), 0
    for rank in range(len(centroids)):
        c = order[rows, rank]
        open_ = bound[rows, c] <= best[rows]
        rows, c = rows[open_], c[open_]
        if not len(rows):
            break
        taken += len(rows)
        d = ((q[rows] - centroids[c]) ** 2).sum(1)
        better = (d < best[rows]) | (d == best[rows]) & (c < who[rows])
        best[rows[better]], who[rows[better]] = d[better], c[better]
    return who, best, taken


def quantised(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", size: int = 64, scale: int = 64) -> DataFrame:
    """id, q (floor(scale * x) of each component, little-endian 32-bit) and its screen (codes, power, norms as 64-bit floats, square), stored.

    Vectors that are null, of another length, or hold a null or non-finite component take no part. Ids may be null or repeat. A component
    beyond +-LARGEST after scaling is an error, as distances to it may not fit a long. Extra columns are left out.
    """

    def run(batches):
        for batch in batches:
            column = batch.column("x")
            q = np.floor(scale * column.values.slice(column.offsets[0].as_py(), len(column) * size).to_numpy(zero_copy_only=False).reshape(-1, size))
            if len(q) and np.abs(q).max() > LARGEST:
                raise ValueError(f"a component is beyond {LARGEST} / {scale}")
            q = q.astype("<i4")
            own = screen(q)
            packed = [pa.array([r.tobytes() for r in rows], pa.binary()) for rows in (q, own.codes, np.hstack([own.norms, own.rest]).astype("<f8"))]
            yield pa.RecordBatch.from_arrays([batch.column("id"), *packed, pa.array(own.power), pa.array(own.square)], names=["id", "q", "codes", "norms", "power", "square"])

    x = F.col(embedding).cast("array<double>")
    whole = (F.size(x) == size) & F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    kept = vectors.select(F.col(vec_id).alias("id"), x.alias("x")).where(F.coalesce(whole, F.lit(False)))
    return stored(kept.mapInArrow(lean(run), f"id {dict(vectors.dtypes)[vec_id]}, q binary, codes binary, norms binary, power int, square double"), "quantised")


def _arrays(batch: pa.RecordBatch, size: int) -> tuple[np.ndarray, Screen]:
    q, codes, norms = (np.frombuffer(b"".join(batch.column(c).to_pylist()), kind).reshape(batch.num_rows, -1) for c, kind in (("q", "<i4"), ("codes", np.int8), ("norms", "<f8")))
    half = norms.shape[1] // 2
    return q.astype(np.int64), Screen(codes, batch.column("power").to_numpy(), norms[:, :half], norms[:, half:], batch.column("square").to_numpy())


def _sums(table: DataFrame, centroids: np.ndarray) -> dict[int, tuple[int, list[int]]]:
    """Count and componentwise sums of the vectors of each centroid that has some: k * size rows to the driver."""
    k, size = centroids.shape

    def run(batches):
        their, total, count = screen(centroids), np.zeros((k, size), np.int64), np.zeros(k, np.int64)
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK):
                q, own = _arrays(batch.slice(at, BLOCK), size)
                who, _, _ = nearest(q, own, centroids, their)
                np.add.at(total, who, q)
                count += np.bincount(who, minlength=k)
        some = np.flatnonzero(count)
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(some, size), pa.int32()), pa.array(np.tile(np.arange(size), len(some)), pa.int32()), pa.array(total[some].ravel()), pa.array(np.repeat(count[some], size))], names=["c", "i", "s", "n"])

    rows = table.drop("id").mapInArrow(lean(run), "c int, i int, s long, n long").groupBy("c", "i").agg(F.sum(F.col("s").cast("decimal(38,0)")).alias("s"), F.sum("n").alias("n")).collect()
    out: dict[int, tuple[int, list[int]]] = {}
    for r in rows:
        out.setdefault(r.c, (r.n, [0] * size))[1][r.i] = int(r.s)
    return out


def cluster(table: DataFrame, start: np.ndarray, rounds: int = 3) -> Clusters:
    """Lloyd's rounds over a `quantised` table from the centroids `start` (k by size integers), and a last assignment.

    A centroid becomes the componentwise floor of its vectors' mean; one without vectors stays. Ties go to the smaller number, equal
    vectors to the same centroid. An empty table gives no rows. k * size numbers are held by every task.
    """
    centroids = np.asarray(start, np.int64)
    size = centroids.shape[1]
    for _ in range(rounds):
        now = centroids.copy()
        for c, (n, sums) in _sums(table, centroids).items():
            now[c] = [s // n for s in sums]
        centroids = now

    def run(batches):
        their = screen(centroids)
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK):
                some = batch.slice(at, BLOCK)
                who, best, _ = nearest(*_arrays(some, size), centroids, their)
                yield pa.RecordBatch.from_arrays([some.column("id"), pa.array(who, pa.int32()), pa.array(best, pa.int64())], names=["id", "cluster", "distance"])

    kind = dict(table.dtypes)["id"]
    return Clusters(stored(table.mapInArrow(lean(run), f"id {kind}, cluster int, distance long"), "clusters"), centroids)


def first_by_hash(table: DataFrame, k: int = 16, seed: int = 1) -> np.ndarray:
    """The k vectors of a `quantised` table with the smallest sha256 of `seed:id`, in that order; all, if fewer. Ties are put in order by their bytes; null ids are no candidates."""
    name = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string")), 256)
    rows = table.where("id is not null").select(name.alias("h"), "q").orderBy("h", "q").limit(k).collect()
    size = len(rows[0].q) // 4 if rows else 1
    return np.array([np.frombuffer(r.q, "<i4") for r in rows], np.int64).reshape(-1, size)


def report(vectors: DataFrame, k: int = 16, rounds: int = 3, size: int = 64, scale: int = 64, seed: int = 1) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia and centroid_sha256 of each vector that takes part.

    Repeated rows count each. If no vector has an id, none can be a centroid, and the result is empty.
    """
    table = quantised(vectors, size=size, scale=scale)
    start = first_by_hash(table, k, seed)
    if not len(start):
        return table.limit(0).selectExpr("id AS vec_id", "0 AS cluster", "0L AS distance", "0L AS cluster_inertia", "0L AS inertia", "'' AS centroid_sha256")
    found = cluster(table, start, rounds)
    sums = {r.cluster: r.s for r in found.assigned.groupBy("cluster").agg(F.sum("distance").alias("s")).collect()}  # k rows
    facts = [(c, s, sum(sums.values()), hashlib.sha256(",".join(map(str, found.centroids[c].tolist())).encode()).hexdigest()) for c, s in sums.items()]
    of = table.sparkSession.createDataFrame(facts, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return found.assigned.join(F.broadcast(of), "cluster").select(F.col("id").alias("vec_id"), "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
