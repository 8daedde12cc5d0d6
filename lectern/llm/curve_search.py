"""Approximate nearest neighbours by shifted space-filling curves.

Several times over, the vectors are projected at random to a few dimensions, shifted, cut to a grid and ordered along
a Hilbert curve. Each ordering is range-partitioned in Spark and cut into blocks of consecutive keys. A query looks
through the blocks around its own key in every ordering; what it meets is reranked by the exact inner product in double
precision, and the best of all orderings are merged.

How many blocks a query looks through is not guessed: ``calibrate`` finds the true neighbours of a bounded sample of
queries in one pass over all vectors, and takes the smallest window with which that sample reaches the wanted recall.
Clustered vectors need narrow windows; vectors without structure need windows that span much of the table, which the
calibration then says.

Equal vectors collapse to one, which keeps its k + 1 smallest ids: no more can be among k nearest, as ties go to the
smaller id. So a group of copies of any size is one point on every curve.

Defined results: vectors that are null, zero, of another length than most, or that hold a null or non-finite component
take no part, neither as queries nor as candidates; rows that repeat an id take part once for each different vector, and
a query never finds its own id; with fewer than k candidates all are returned; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lectern.llm.shared import persisted

#: Orderings, dimensions projected to, bits a dimension, and vectors a block.
ORDERINGS, DIMENSIONS, BITS, BLOCK = 8, 4, 8, 1024
#: Queries of the calibration sample, at most, and the recall that it has to show.
SAMPLE, RECALL = 96, 0.97


def hilbert_keys(cells: np.ndarray, bits: int) -> np.ndarray:
    """Positions on the Hilbert curve of integer cells (rows x dimensions, ``bits`` bits each), at most 63 bits together.

    The axes' bits are turned level by level, from coarse to fine: each level undoes the rotation and reflection that
    the curve has at the levels above, then the turned bits are read off as a Gray code.
    """
    x = cells.astype(np.int64).copy()
    n = x.shape[1]
    level = 1 << (bits - 1)
    while level > 1:
        below = level - 1
        for i in range(n):
            set_ = (x[:, i] & level) != 0
            swap = np.where(set_, 0, (x[:, 0] ^ x[:, i]) & below)
            x[:, 0] = np.where(set_, x[:, 0] ^ below, x[:, 0] ^ swap)
            if i:
                x[:, i] ^= swap
        level >>= 1
    for i in range(1, n):
        x[:, i] ^= x[:, i - 1]
    turn = np.zeros(len(x), dtype=np.int64)
    level = 1 << (bits - 1)
    while level > 1:
        turn = np.where((x[:, n - 1] & level) != 0, turn ^ (level - 1), turn)
        level >>= 1
    x ^= turn[:, None]
    key = np.zeros(len(x), dtype=np.int64)
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            key = (key << 1) | ((x[:, i] >> b) & 1)
    return key


@dataclass
class Curves:
    """The random projections, shifts and grid of the orderings."""

    projections: np.ndarray  # orderings x vector length x dimensions
    shifts: np.ndarray  # orderings x dimensions
    scale: float

    @staticmethod
    def draw(length: int, scale: float, orderings: int = ORDERINGS, seed: int = 11) -> Curves:
        rng = np.random.default_rng(seed)
        p = np.stack([np.linalg.qr(rng.standard_normal((length, max(length, DIMENSIONS))))[0][:, :DIMENSIONS] for _ in range(orderings)])
        return Curves(p, rng.random((orderings, p.shape[2])), max(scale, 1e-12))

    def keys(self, vectors: np.ndarray, ordering: int) -> np.ndarray:
        cells = vectors @ self.projections[ordering] / self.scale  # about standard normal for vectors without structure
        grid = np.floor(((cells / 8 + 0.5) + self.shifts[ordering] / 4) / 1.25 * (1 << BITS))
        return hilbert_keys(np.clip(grid, 0, (1 << BITS) - 1).astype(np.int64), BITS)


class _Best:
    """The ``k`` best of each query so far; what is held grows with the queries met, not with the candidates."""

    def __init__(self, k: int):
        self.k, self.size, self.due = k, 0, 1 << 18
        self.parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

    def add(self, query: np.ndarray, found: np.ndarray, score: np.ndarray) -> None:
        self.parts.append((query, found, score))
        self.size += len(query)
        if self.size > self.due:
            self.parts = [self.reduced()]
            self.size = len(self.parts[0][0])
            self.due = max(self.due, 2 * self.size)

    def reduced(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        if not self.parts:
            return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64), np.zeros(0)
        query, found, score = (np.concatenate(x) for x in zip(*self.parts))
        order = np.lexsort((found, -score, query))
        query, found, score = query[order], found[order], score[order]
        new = np.ones(len(query), dtype=bool)  # orderings may have met the same vector
        new[1:] = (query[1:] != query[:-1]) | (found[1:] != found[:-1]) | (score[1:] != score[:-1])
        query, found, score = query[new], found[new], score[new]
        keep = np.arange(len(query)) - np.searchsorted(query, query) < self.k
        return query[keep], found[keep], score[keep]


def _matrix(column: pa.Array, length: int) -> np.ndarray:
    flat = column.flatten() if not isinstance(column, pa.ChunkedArray) else column.combine_chunks().flatten()
    return np.asarray(flat, dtype=np.float64).reshape(-1, length)


def usable(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """(vec_id, v): the vectors that take part."""
    v = F.col(f"`{embedding}`")
    return vectors.select(F.col(f"`{vec_id}`").cast("long").alias("vec_id"), v.cast("array<double>").alias("v")).where(
        F.col("vec_id").isNotNull() & F.col("v").isNotNull() & (F.size("v") > 0)
        & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0)
    )


def _ordered(points: DataFrame, curves: Curves, length: int) -> DataFrame:
    """(ordering, rank, block-ready row) of every point in every ordering: (ordering, place, point, v)."""
    shared = points.sparkSession.sparkContext.broadcast(curves)

    def key(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                m = _matrix(b["v"], length)
                for o in range(len(shared.value.projections)):
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(m), o, dtype=np.int32)), pa.array(shared.value.keys(m, o)), b["point"]], ["ordering", "key", "point"])

    keyed = points.select("point", "v").mapInArrow(key, "ordering int, key long, point long")
    keyed = keyed.repartitionByRange("ordering", "key", "point").sortWithinPartitions("ordering", "key", "point")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task = TaskContext.get().partitionId()
        seen: dict[int, int] = {}
        for b in batches:
            o = b["ordering"].to_numpy()
            place = np.zeros(len(o), dtype=np.int64)
            for one in np.unique(o):
                at = np.flatnonzero(o == one)
                place[at] = seen.get(int(one), 0) + np.arange(len(at))
                seen[int(one)] = seen.get(int(one), 0) + len(at)
            yield pa.RecordBatch.from_arrays([b["ordering"], pa.array(np.full(len(o), task, dtype=np.int32)), pa.array(place), b["point"]], ["ordering", "task", "place", "point"])

    placed = persisted(keyed.mapInArrow(count, "ordering int, task int, place long, point long"), "placed")
    sizes = placed.groupBy("ordering", "task").agg(F.count("*").alias("n"))
    bases = sizes.withColumn("base", F.sum("n").over(Window.partitionBy("ordering").orderBy("task")) - F.col("n"))
    return placed.join(bases.select("ordering", "task", "base"), ["ordering", "task"]).select("ordering", "point", (F.col("base") + F.col("place")).alias("rank"))


def calibrate(points: DataFrame, ranked: DataFrame, queries: DataFrame, k: int, length: int, recall: float = RECALL, sample: int = SAMPLE) -> int:
    """Blocks on either side of its own that a query has to look through for ``recall``, found on a bounded sample."""
    drawn = queries.select("point", "v").dropDuplicates(["point"]).orderBy(F.xxhash64("point", F.lit(5)), "point").limit(sample).toPandas()
    if drawn.empty:
        return 0
    matrix = np.stack([np.asarray(v, dtype=np.float64) for v in drawn["v"]])
    shared = points.sparkSession.sparkContext.broadcast((drawn["point"].to_numpy(), matrix))

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, q = shared.value
        scores, found = np.zeros((len(ids), 0)), np.zeros((len(ids), 0), dtype=np.int64)
        for b in batches:
            if b.num_rows:
                p = b["point"].to_numpy()
                s = np.where(p[None, :] == ids[:, None], -np.inf, q @ _matrix(b["v"], length).T)
                scores, found = np.concatenate([scores, s], axis=1), np.concatenate([found, np.broadcast_to(p, s.shape)], axis=1)
                top = np.argsort(-scores, axis=1, kind="stable")[:, :k]
                scores, found = np.take_along_axis(scores, top, 1), np.take_along_axis(found, top, 1)
        keep = np.isfinite(scores)
        yield pa.RecordBatch.from_pydict({"query": np.repeat(ids, keep.sum(axis=1)), "point": found[keep], "score": scores[keep]})

    near = points.select("point", "v").mapInArrow(best, "query long, point long, score double")
    near = near.withColumn("nth", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "point"))).where(F.col("nth") <= k)
    blocks = ranked.select("ordering", "point", F.floor(F.col("rank") / BLOCK).alias("block"))
    wanted = near.select("query", F.col("point").alias("hit"))
    ids = persisted(wanted, "wanted")  # at most k rows a sample query
    distance = (
        F.broadcast(ids).join(blocks.select("ordering", F.col("point").alias("query"), F.col("block").alias("qb")), "query")
        .join(blocks.select("ordering", F.col("point").alias("hit"), F.col("block").alias("hb")), ["ordering", "hit"])
        .groupBy("query", "hit").agg(F.min(F.abs(F.col("qb") - F.col("hb"))).alias("d")).select("d").toPandas()["d"].to_numpy()
    )
    return int(np.sort(distance)[max(0, int(np.ceil(recall * len(distance))) - 1)]) if len(distance) else 0


def search(vectors: DataFrame, is_query, k: int = 20, vec_id: str = "vec_id", embedding: str = "embedding", recall: float = RECALL, window: int | None = None) -> DataFrame:
    """The ``k`` vectors of largest inner product for each row where ``is_query`` (a function of the id column) holds:
    query_id, rank, vec_id, score."""
    schema = "query_id long, rank int, vec_id long, score double"
    spark = vectors.sparkSession
    rows = usable(vectors, vec_id, embedding)
    lengths = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").limit(1).collect()
    if not lengths:
        return spark.createDataFrame([], schema)
    length = int(lengths[0]["n"])
    rows = rows.where(F.size("v") == length).withColumn("print", F.xxhash64("v"))
    # equal vectors are one point, named by its smallest id; it keeps as many ids as k results can hold
    nth = F.row_number().over(Window.partitionBy("v").orderBy("vec_id"))
    distinct = rows.select("vec_id", "v").groupBy("v", "vec_id").agg(F.lit(1).alias("one"))
    few = distinct.withColumn("nth", nth).where(F.col("nth") <= k + 1).groupBy("v").agg(F.min("vec_id").alias("point"), F.sort_array(F.collect_list("vec_id")).alias("ids"))
    points = persisted(few, "points")
    scale = points.select(F.avg(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)).alias("s")).first()["s"]
    curves = Curves.draw(length, float(np.sqrt(scale / length)))
    queries = persisted(rows.where(is_query(F.col("vec_id"))).select("vec_id", "v").distinct().join(points.select("point", F.col("v").alias("w")), F.expr("v = w")).select(F.col("vec_id").alias("query_id"), "point", "v"), "queries")
    ranked = persisted(_ordered(points, curves, length), "ranked")
    reach = calibrate(points, ranked, queries, k, length, recall) if window is None else window
    last = ranked.groupBy("ordering").agg(F.max("rank").alias("most"))
    # a copy of the query for each block it looks through; windows that would leave the curve's ends are moved inwards
    block = F.floor(F.col("rank") / BLOCK)
    asked = (
        queries.join(ranked.select("ordering", F.col("point").alias("p"), "rank"), F.expr("point = p")).join(F.broadcast(last), "ordering")
        .select("query_id", "v", "ordering", block.alias("own"), F.floor(F.col("most") / BLOCK).alias("end"))
        .select("query_id", "v", "ordering", F.explode(F.sequence(F.greatest(F.col("own") - reach, F.lit(0)), F.least(F.col("own") + reach, F.col("end")))).alias("block"))
    )
    stored = points.join(ranked, "point").select("ordering", block.alias("block"), "point", "v", "ids")
    both = asked.select("ordering", "block", "query_id", "v", F.lit(None).cast("array<long>").alias("ids")).unionByName(
        stored.select("ordering", "block", F.lit(None).cast("long").alias("query_id"), "v", "ids")
    )

    def near(groups: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # a block's vectors come first; its queries follow in batches. A task has many blocks of a query's window, and
        # returns the best of all of them
        block_of, base, ids, owners = None, [], [], []
        best = _Best(k)
        for b in groups:
            where = b["ordering"].to_numpy().astype(np.int64) << 40 | b["block"].to_numpy()
            asks = np.asarray(b["query_id"].is_valid())
            starts = np.flatnonzero(np.concatenate([[True], (where[1:] != where[:-1]) | (asks[1:] != asks[:-1])]))
            for s, e in zip(starts, [*starts[1:], b.num_rows]):
                part = b.slice(s, e - s)
                if where[s] != block_of:
                    block_of, base, ids, owners = where[s], [], [], []
                if not asks[s]:
                    base.append(_matrix(part["v"], length))
                    lists = part["ids"].to_pylist()
                    ids.append(np.array([x for one in lists for x in one], dtype=np.int64))
                    owners.append(np.repeat(np.arange(len(lists)) + sum(len(x) for x in base[:-1]), [len(x) for x in lists]))
                    continue
                if not base:
                    continue
                stored_, id_, owner = np.concatenate(base), np.concatenate(ids), np.concatenate(owners)
                base, ids, owners = [stored_], [id_], [owner]
                order = np.argsort(id_, kind="stable")
                id_, owner = id_[order], owner[order]
                for at in range(0, e - s, 512):
                    asking = part.slice(at, 512)
                    q = asking["query_id"].to_numpy()
                    asked_ = _matrix(asking["v"], length)
                    score = (asked_ @ stored_.T)[:, owner]
                    score[q[:, None] == id_[None, :]] = -np.inf
                    width = min(k + 8, score.shape[1])  # some more: equal scores are settled later, exactly
                    top = np.argpartition(-score, width - 1, axis=1)[:, :width]
                    edge = np.take_along_axis(score, top, 1).min(axis=1, keepdims=True) - 1e-9
                    kth = np.partition(-score, min(k, score.shape[1]) - 1, axis=1)[:, min(k, score.shape[1]) - 1]
                    row, col = np.nonzero((score >= np.maximum(edge, -kth[:, None] - 1e-9)) & np.isfinite(score))
                    # of candidates that tie at the edge only the smallest ids can matter
                    first = np.lexsort((id_[col], -np.round(score[row, col], 9), row))
                    row, col = row[first], col[first]
                    place = np.arange(len(row)) - np.searchsorted(row, row)
                    keep = place < k + 8
                    row, col = row[keep], col[keep]
                    # component by component in order, so that equal vectors score equally to the last bit
                    exact = np.cumsum(asked_[row] * stored_[owner[col]], axis=1)[:, -1] if len(row) else np.zeros(0)
                    best.add(q[row], id_[col], exact)
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in best.reduced()], ["query_id", "vec_id", "score"])

    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = both.repartitionByRange(2 * parts, "ordering", "block").sortWithinPartitions("ordering", "block", F.col("query_id").isNotNull())
    found = dealt.mapInArrow(near, "query_id long, vec_id long, score double")
    scored = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return scored.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
