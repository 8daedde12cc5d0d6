"""Best-fit packing of tokenised documents into sequences of a fixed capacity.

1. Documents become token ids plus an end token; only those longer than the capacity are cut, into full pieces after a
   first piece that takes the remainder. Each task counts its pieces by length and numbers them within a length.
2. Documents and gaps are kept sorted by length in runs: all pieces of one length are a run, and all sequences filled
   alike are a run of gaps, so the state has at most ``capacity`` lengths on either side, whatever the number of rows.
   Bulk-synchronous supersteps go down the lengths. In each, a sweep takes the successor of the length among the gaps
   (the tightest gap that fits), the j-th piece of the run goes to the j-th sequence of that gap (conflicts are resolved
   by rank), the gap's run is split into filled and unfilled sequences and moved to its new place, and the sweep goes on
   to the next successor until the run is placed or no gap fits; then new sequences are opened. One pass down the
   lengths places everything, exactly as sequential best-fit decreasing would.
3. The supersteps' record, (length, from rank, count) -> (first sequence, offset), is applied to all pieces in parallel:
   a piece's rank is its task's base for the length plus its own number, and a search of the record gives its place.

Only lengths and counts ever leave the tasks: what the driver holds is bounded by the capacity, not by the input.

Defined results: null and empty texts are the end token alone; each row is packed on its own, so repeated rows are
packed repeatedly; an empty table gives no rows.
"""

from __future__ import annotations

import bisect
import functools
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lectern.llm.shared import persisted, small_batches

CAPACITY = 1024
END = 2
#: The vocabulary's own special string, which the library reads as one id wherever it stands in a text.
_SPECIAL = "<|endoftext|>"
_encoders: dict = {}


def encoder(vocabulary: str):
    """A function from text to token ids (numpy, unsigned 32 bits) equal to those of the ``tokenizers`` library.

    ``vocabulary`` is the path of its JSON file. Where the same vocabulary lies beside it as a rank file, the faster
    library for rank files encodes; texts that it refuses or that hold the special string go to ``tokenizers``.
    """
    if vocabulary not in _encoders:
        import base64
        import os

        ranks_file = os.path.splitext(vocabulary)[0] + ".tiktoken"
        fast = None
        if os.path.exists(ranks_file):
            import tiktoken
            from public_tokenizers import PATTERN

            with open(ranks_file, "rb") as f:
                ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
            fast = tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
            del ranks

        @functools.cache
        def slow():
            from tokenizers import Tokenizer

            return Tokenizer.from_file(vocabulary)

        def encode(text: str) -> np.ndarray:
            if fast is not None and _SPECIAL not in text:
                try:
                    return fast.encode_to_numpy(text, disallowed_special=())
                except Exception:  # the pattern library gives up on some very long runs
                    pass
            return np.array(slow().encode(text, add_special_tokens=False).ids, dtype=np.uint32)

        _encoders[vocabulary] = encode
    return _encoders[vocabulary]


def cut(ids: np.ndarray, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces: whole if it fits, else a remainder first and then full ones."""
    n = len(ids)
    if n <= capacity:
        return [(0, n)]
    first = n % capacity
    return ([(0, first)] if first else []) + [(s, capacity) for s in range(first, n, capacity)]


def pieces(docs: DataFrame, vocabulary: str, capacity: int = CAPACITY, end: int = END, with_ids: bool = False) -> DataFrame:
    """A row a piece: doc_id, piece, start, length, ids_crc32, (ids,) task, and number among the task's pieces of that length."""
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long, task int, number long" + ", ids array<int>" * with_ids

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(vocabulary)
        task = TaskContext.get().partitionId()
        seen = np.zeros(capacity + 1, dtype=np.int64)
        names = [c.split()[0] for c in schema.split(", ")]
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                batch = whole.slice(at, 256)
                rows: list[list] = [[] for _ in names]
                for doc_id, text in zip(batch["doc_id"].to_pylist(), batch["text"].to_pylist()):
                    ids = np.append(encode(text), np.uint32(end)) if text else np.array([end], dtype=np.uint32)
                    ids = np.ascontiguousarray(ids, dtype="<u4")
                    for k, (start, length) in enumerate(cut(ids, capacity)):
                        part = ids[start : start + length]
                        values = [doc_id, k, start, length, zlib.crc32(part), task, int(seen[length])]
                        seen[length] += 1
                        for column, value in zip(rows, values + [part.astype(np.int32)] * with_ids):
                            column.append(value)
                types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.list_(pa.int32())]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(rows, types)], names)

    return docs.select("doc_id", "text").mapInArrow(build, schema)


def supersteps(counts: dict[int, int], capacity: int) -> tuple[np.ndarray, int]:
    """Packs runs: ``counts`` of pieces by length -> record rows (length, from rank, count, first sequence, offset), and the number of sequences."""
    gaps: dict[int, list[tuple[int, int]]] = {}  # gap -> runs (first sequence, sequences)
    order: list[int] = []  # the gaps that have runs, sorted
    record: list[tuple[int, int, int, int, int]] = []
    opened = 0

    def put(gap: int, first: int, count: int) -> None:
        if gap and count:
            if gap not in gaps:
                gaps[gap] = []
                bisect.insort(order, gap)
            gaps[gap].append((first, count))

    for length in sorted((x for x in counts if counts[x] > 0), reverse=True):
        rank, left = 0, counts[length]
        while left:
            at = bisect.bisect_left(order, length)  # the successor: the tightest gap that fits
            if at == len(order):
                break
            gap = order[at]
            first, room = gaps[gap].pop()
            taken = min(left, room)
            record.append((length, rank, taken, first, capacity - gap))
            if taken < room:
                gaps[gap].append((first + taken, room - taken))
            elif not gaps[gap]:
                del gaps[gap]
                order.pop(at)
            put(gap - length, first, taken)
            rank, left = rank + taken, left - taken
        each = capacity // length
        whole, rest = divmod(left, each)
        for k in range(each):  # the k-th slot of new sequences that are filled up with this length
            if whole:
                record.append((length, rank + k * whole, whole, opened, k * length))
        put(capacity - each * length, opened, whole)
        rank, opened = rank + each * whole, opened + whole
        if rest:
            for k in range(rest):
                record.append((length, rank + k, 1, opened, k * length))
            put(capacity - rest * length, opened, 1)
            opened += 1
    return np.array(record, dtype=np.int64).reshape(-1, 5), opened


def pack(docs: DataFrame, vocabulary: str, capacity: int = CAPACITY, end: int = END, with_ids: bool = False) -> DataFrame:
    """Packs ``docs`` (doc_id, text): a row a piece with sequence_id and offset, gapless within each sequence."""
    small_batches(docs.sparkSession)
    cutup = persisted(pieces(docs, vocabulary, capacity, end, with_ids), "pieces")
    per_task = cutup.groupBy("task", "length").agg(F.count("*").alias("n"))
    bases = per_task.withColumn("base", F.sum("n").over(Window.partitionBy("length").orderBy("task")) - F.col("n"))
    counts = {r["length"]: r["n"] for r in per_task.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most ``capacity`` rows
    record, _ = supersteps(counts, capacity)
    shared = docs.sparkSession.sparkContext.broadcast(record)  # bounded by the capacity

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        steps = shared.value
        steps = steps[np.lexsort((steps[:, 1], steps[:, 0]))]
        for batch in batches:
            length, rank = batch["length"].to_numpy(), batch["rank"].to_numpy()
            # ranks of different lengths don't mix: search by (length, rank) as one key
            span = int(steps[:, 1].max()) + 1 if len(steps) else 1
            at = np.searchsorted(steps[:, 0] * span + steps[:, 1], length * span + np.minimum(rank, span - 1), side="right") - 1
            names = batch.schema.names[:-1]
            arrays = [batch[n] for n in names] + [pa.array(steps[at, 3] + rank - steps[at, 1]), pa.array(steps[at, 4])]
            yield pa.RecordBatch.from_arrays(arrays, [*names, "sequence_id", "offset"])

    columns = ["doc_id", "piece", "start", "length", "ids_crc32"] + ["ids"] * with_ids
    ranked = cutup.join(bases.select("task", "length", "base"), ["task", "length"]).select(*columns, (F.col("base") + F.col("number")).alias("rank"))
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long, " + "ids array<int>, " * with_ids + "sequence_id long, offset long"
    return ranked.mapInArrow(place, schema)
