"""Centroid clustering of integer vectors with Drake's adaptive distance bounds.

Each vector keeps, between rounds, an upper bound on the distance to its centroid, lower bounds on the distances to its
several next nearest centroids, in their order, and one remainder bound for all centroids behind them. When centroids
move, the bounds give way by as much as each has moved. From the last to the first, a bound is lowered to those behind it,
so that the first one above the upper bound certifies all centroids at and behind its place. If that is the first place, the
vector stays where it is without a distance computed; if a later one, only the centroids before that place are compared;
if none, all are. How many bounds are kept adapts: it starts at a quarter of the number of centroids, and shrinks to the
number that settled nearly all vectors, an eighth at least.

Results are exact. Vectors and centroids are integers, distances are compared as squared integers with ties to the
smaller number, and a bound certifies only with a margin far above what rounding can add up to; otherwise the centroids
are compared again. New centroids are exact floors of sums by counts. So the result is that of comparing all.

The state is a table in the shared folder, written once a round and removed after the next one: a lost executor costs a
re-read. A round moves nothing but partial sums (a row a centroid, component and task), and only centroids reach the driver.

Defined results: only vectors of exactly ``dims`` components, none null or not finite, take part. Among repeated ids, equal
hashes of first centroids are ordered by the vectors. With fewer vectors than ``k``, each is a centroid at first; an
empty table gives no rows. Centroids without vectors stay where they are. A component beyond 2^27 after scaling raises, as
squared distances would not fit a long. Repeated rows are vectors of their own; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.llm.shared import dropped, persisted

#: Relative margin within which bounds don't certify: rounding of a few operations stays below a millionth of it.
MARGIN = 1e-9
#: Components up to this keep sums of squared differences of up to 64 components within a long.
LARGEST = 1 << 27
#: Share of all vectors that the kept bounds should settle.
SETTLED = 0.99

_STATE = "vec_id long, v array<int>, cluster int, upper double, near array<int>, lower array<double>, rest double, looked int"


def integers(vector: Column, dims: int, scale: int) -> Column:
    """floor(scale * x) of each component, or null if the vector takes no part."""
    sound = (F.size(vector) == dims) & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))

    def whole(x: Column) -> Column:
        n = F.floor(x.cast("double") * scale)
        return F.when(n.between(-LARGEST, LARGEST), n).otherwise(F.raise_error(F.lit(f"a component is beyond {LARGEST} after scaling"))).cast("int")

    return F.when(F.coalesce(sound, F.lit(False)), F.transform(vector, whole))


def squares(v: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Squared distances, exactly: of each row of ``v`` to each centroid, or to its own if these are three-dimensional."""
    if centroids.ndim == 2:
        return np.stack([((v - c) ** 2).sum(axis=1) for c in centroids], axis=1)
    return ((v[:, None, :] - centroids) ** 2).sum(axis=2)


class Bounds:
    """Assignments of some vectors with their bounds. ``looked``: places compared in the last round, -1 for all."""

    def __init__(self, cluster: np.ndarray, upper: np.ndarray, near: np.ndarray, lower: np.ndarray, rest: np.ndarray):
        self.cluster, self.upper, self.near, self.lower, self.rest = cluster, upper, near, lower, rest
        self.looked = np.zeros(len(cluster), dtype=np.int32)

    @classmethod
    def of(cls, v: np.ndarray, centroids: np.ndarray, kept: int) -> Bounds:
        n = len(v)
        self = cls(np.zeros(n, dtype=np.int32), np.zeros(n), np.zeros((n, kept), dtype=np.int32), np.zeros((n, kept)), np.zeros(n))
        self._scan(np.arange(n), v, centroids)
        return self

    def _scan(self, rows: np.ndarray, v: np.ndarray, centroids: np.ndarray) -> None:
        """Compares all centroids."""
        found, kept = squares(v[rows], centroids), self.near.shape[1]
        order = np.argsort(found, axis=1, kind="stable")
        far = np.sqrt(np.take_along_axis(found, order, axis=1).astype(np.float64))
        self.cluster[rows], self.upper[rows] = order[:, 0], far[:, 0]
        self.near[rows], self.lower[rows] = order[:, 1 : kept + 1], far[:, 1 : kept + 1]
        self.rest[rows] = far[:, kept + 1] if far.shape[1] > kept + 1 else np.inf
        self.looked[rows] = -1

    def shrink(self, kept: int) -> None:
        """Keeps fewer bounds; the remainder takes the others in."""
        if kept < self.lower.shape[1]:
            self.rest = np.minimum(self.rest, self.lower[:, kept:].min(axis=1))
            self.near, self.lower = self.near[:, :kept].copy(), self.lower[:, :kept].copy()

    def _place(self) -> np.ndarray:
        """The first place whose bound certifies it and all behind; one past the remainder's if none does."""
        bound = np.concatenate([self.lower, self.rest[:, None]], axis=1)
        bound = np.minimum.accumulate(bound[:, ::-1], axis=1)[:, ::-1]
        sure = bound > (self.upper + MARGIN * (self.upper + 1))[:, None]
        return np.where(sure.any(axis=1), sure.argmax(axis=1), bound.shape[1])

    def move(self, v: np.ndarray, centroids: np.ndarray, moved: np.ndarray) -> None:
        """Reassigns after each centroid has moved as far as ``moved`` says."""
        self.upper = self.upper + moved[self.cluster]
        self.lower = self.lower - moved[self.near]
        self.rest = self.rest - (moved.max() if len(moved) else 0)
        self.looked = np.zeros(len(v), dtype=np.int32)
        open_ = np.flatnonzero(self._place() > 0)
        if len(open_):  # the upper bound may be all that is loose
            self.upper[open_] = np.sqrt(((v[open_] - centroids[self.cluster[open_]]) ** 2).sum(axis=1).astype(np.float64))
        place = self._place()
        for p in range(1, self.lower.shape[1] + 1):
            rows = np.flatnonzero(place == p)
            if not len(rows):
                continue
            some = np.concatenate([self.cluster[rows, None], self.near[rows, :p]], axis=1)
            found = squares(v[rows], centroids[some])
            order = np.lexsort((some, found), axis=1)
            some, far = np.take_along_axis(some, order, axis=1), np.sqrt(np.take_along_axis(found, order, axis=1).astype(np.float64))
            self.cluster[rows], self.upper[rows] = some[:, 0], far[:, 0]
            self.near[rows, :p], self.lower[rows, :p] = some[:, 1:], far[:, 1:]
            self.looked[rows] = p
        rows = np.flatnonzero(place > self.lower.shape[1])
        if len(rows):
            self._scan(rows, v, centroids)


def _matrix(column: pa.ListArray, kind: type) -> np.ndarray:
    flat = np.array(column.flatten().to_numpy(zero_copy_only=False), dtype=kind)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 0)


def _lists(values: np.ndarray, kind: pa.DataType) -> pa.ListArray:
    ends = np.arange(len(values) + 1, dtype=np.int32) * values.shape[1]
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(values.reshape(-1), kind))


def _assigned(table: DataFrame, centroids: np.ndarray, moved: np.ndarray | None, kept: int) -> DataFrame:
    """The next state, from vectors (at first) or from the state before."""

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            v = _matrix(batch["v"], np.int64)
            if moved is None:
                b = Bounds.of(v, centroids, kept)
            else:
                b = Bounds(
                    batch["cluster"].to_numpy(zero_copy_only=False).copy(), batch["upper"].to_numpy(zero_copy_only=False).copy(),
                    _matrix(batch["near"], np.int32), _matrix(batch["lower"], np.float64), batch["rest"].to_numpy(zero_copy_only=False).copy(),
                )
                b.shrink(kept)
                b.move(v, centroids, moved)
            columns = [batch["vec_id"], batch["v"], pa.array(b.cluster, pa.int32()), pa.array(b.upper), _lists(b.near, pa.int32()), _lists(b.lower, pa.float64()), pa.array(b.rest), pa.array(b.looked, pa.int32())]
            yield pa.RecordBatch.from_arrays(columns, names=["vec_id", "v", "cluster", "upper", "near", "lower", "rest", "looked"])

    return table.mapInArrow(assign, _STATE)


def _sums(state: DataFrame) -> DataFrame:
    """(cluster, i, n, total): how many vectors a cluster has, and the exact sum of their ``i``-th components."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            if batch.num_rows:
                v, cluster = _matrix(batch["v"], np.int64), batch["cluster"].to_numpy(zero_copy_only=False)
                for c in np.unique(cluster).tolist():
                    own = v[cluster == c]
                    total[c] = total.get(c, 0) + np.append(own.sum(axis=0), len(own))
        for c, sums in total.items():
            yield pa.RecordBatch.from_pydict({"cluster": pa.array([c], pa.int32()), "n": pa.array([sums[-1]], pa.int64()), "s": pa.array([sums[:-1]], pa.list_(pa.int64()))})

    partial = state.select("cluster", "v").mapInArrow(add, "cluster int, n long, s array<long>")
    wide = "decimal(38,0)"
    return partial.select("cluster", "n", F.posexplode("s").alias("i", "s")).groupBy("cluster", "i").agg(F.sum("n").alias("n"), F.sum(F.col("s").cast(wide)).alias("total"))


def _moved_centroids(state: DataFrame, centroids: np.ndarray) -> np.ndarray:
    after = centroids.copy()
    for row in _sums(state).collect():  # k times dims rows
        after[row.cluster, row.i] = int(row.total) // row.n
    return after


def _distances(state: DataFrame, centroids: np.ndarray) -> DataFrame:
    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                own = centroids[batch["cluster"].to_numpy(zero_copy_only=False)]
                apart = ((_matrix(batch["v"], np.int64) - own) ** 2).sum(axis=1)
                yield pa.RecordBatch.from_arrays([batch["vec_id"], batch["cluster"], pa.array(apart, pa.int64())], names=["vec_id", "cluster", "distance"])

    return state.select("vec_id", "v", "cluster").mapInArrow(measure, "vec_id long, cluster int, distance long")


def _enough(state: DataFrame, kept: int, least: int) -> int:
    """The number of bounds that settled nearly all vectors of the last round that did not need all centroids."""
    count = {r.looked: r["count"] for r in state.groupBy("looked").count().collect()}  # kept + 2 rows
    within, wanted = 0, SETTLED * sum(n for p, n in count.items() if p >= 0)
    for p in range(kept + 1):
        within += count.get(p, 0)
        if within >= wanted:
            return max(least, p)
    return kept


def cluster(
    table: DataFrame, k: int = 16, rounds: int = 3, dims: int = 64, scale: int = 64, seed: int = 1, key: str = "vec_id", vector: str = "embedding"
) -> DataFrame:
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256, centroid_size) of every vector that takes part."""
    made = table.select(F.col(f"`{key}`").cast("long").alias("vec_id"), integers(F.col(f"`{vector}`"), dims, scale).alias("v")).where("v is not null")
    drawn = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))).cast("binary"), 256)
    first = made.orderBy(drawn, "v").limit(k).collect()  # k rows
    centroids = np.array([r.v for r in first], dtype=np.int64).reshape(len(first), dims)
    k = len(centroids)
    kept, least = min(max(1, k // 4), max(k - 1, 0)), min(max(1, k // 8), max(k - 1, 0))
    state = persisted(_assigned(made, centroids, None, kept), "bounds")
    for done in range(rounds):
        after = _moved_centroids(state, centroids)
        if done:
            kept = _enough(state, kept, least)
        moved = np.sqrt(((after - centroids) ** 2).sum(axis=1).astype(np.float64))
        then = persisted(_assigned(state, after, moved, kept), "bounds")
        dropped(state)
        state, centroids = then, after

    placed = _distances(state, centroids)
    weight = {r.cluster: (r.inertia, r.n) for r in placed.groupBy("cluster").agg(F.sum("distance").alias("inertia"), F.count("*").alias("n")).collect()}  # k rows
    whole = sum(i for i, _ in weight.values())
    rows = [(c, i, whole, hashlib.sha256(",".join(map(str, centroids[c].tolist())).encode()).hexdigest(), n) for c, (i, n) in weight.items()]
    told = table.sparkSession.createDataFrame(rows, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string, centroid_size long")
    return placed.join(F.broadcast(told), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256", "centroid_size")
