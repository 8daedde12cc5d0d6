"""What several operators of this folder need: shared storage, expression bindings, fixed-size bitmaps, components."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Java/RE2 class of what separates words: space and the controls tab to carriage return.
BLANK = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors can see, which ``spark.checkpoint.dir`` names.

    Where it is unset, a local folder serves on one machine; on a cluster executors would not see it, so that is an error."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir has to name a folder that the driver and all executors share")
        named = "file://" + tempfile.mkdtemp(prefix="lectern-")
        spark.conf.set("spark.checkpoint.dir", named)
    return named.rstrip("/")


def persisted(df: DataFrame, label: str) -> DataFrame:
    """Writes ``df`` as Parquet into the shared folder and reads it back.

    This cuts lineage, survives lost executors, and gives the planner a true size, so that
    later joins broadcast the table only while it is small.
    """
    spark = df.sparkSession
    at = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(at)
    return spark.read.schema(df.schema).parquet(at)


#: Rows of an Arrow batch for operators that pass whole texts to Python: their memory grows with it.
BATCH_ROWS = 1000


def small_batches(spark: SparkSession) -> SparkSession:
    """Has whole texts reach Python in smaller batches, unless the session sets a size of its own."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(name) == "10000":
        spark.conf.set(name, str(BATCH_ROWS))
    return spark


def dropped(*tables: DataFrame) -> None:
    """Removes tables that ``persisted`` wrote and that nothing reads any more."""
    for table in tables:
        spark = table.sparkSession
        jvm = spark._jvm
        for name in {f.rsplit("/", 1)[0] for f in table.inputFiles()}:
            path = jvm.org.apache.hadoop.fs.Path(name)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` with ``value`` evaluated once per row.

    A column that is used inside a lambda may be inlined there by the optimizer and then be
    evaluated per element; a lambda variable never is.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def fold(doc_id: Column) -> Column:
    """crc32 of the id's text, modulo 4; fold 2 is held out."""
    return F.pmod(F.crc32(doc_id.cast("string")), F.lit(4))


def held_out(doc_id: Column) -> Column:
    return F.coalesce(fold(doc_id) == 2, F.lit(False))


BITMAP_BITS = 1 << 21


def bitmap_of(ids: DataFrame, column: str, bits: int = BITMAP_BITS) -> np.ndarray:
    """A fixed-size bitmap of ids modulo ``bits``: at most ``bits`` / 64 words reach the driver, however many ids there are.

    Hits may be false, misses never are; it only saves traffic.
    """
    at = F.pmod(F.col(column).cast("long"), F.lit(bits))
    words = (
        ids.select(at.alias("at"))
        .groupBy(F.floor(F.col("at") / 64).alias("word"))
        .agg(F.bit_or(F.expr("shiftleft(1L, cast(at % 64 as int))")).alias("mask"))
    )
    out = np.zeros(bits // 64, dtype=np.int64)
    for row in words.collect():  # at most bits / 64 rows
        out[row.word] = row.mask
    return out


def in_bitmap(ids: np.ndarray, bitmap: np.ndarray) -> np.ndarray:
    at = np.mod(ids, len(bitmap) * 64)
    return (bitmap[at >> 6] >> (at & 63)) & 1 == 1


def release() -> None:
    """Gives memory that a fit on the driver has freed back to the system; allocators would keep it for later."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # only where the C library has it
        ctypes.CDLL(None).malloc_trim(0)


def fresh(df: DataFrame, name: str) -> str:
    """``name``, lengthened until no column of ``df`` has it."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def chunks(values: list, size: int) -> Iterator[list]:
    for i in range(0, len(values), size):
        yield values[i : i + size]


def components(edges: DataFrame, label: str = "cc") -> DataFrame:
    """Connected components of an undirected graph by alternating stars: (node, component = smallest node reachable).

    ``edges`` has long columns ``a`` and ``b``. Each round every node links its larger neighbours, then its
    smaller ones, to the smallest node it sees; the edge count never grows and rounds grow with the logarithm
    of the diameter. Hubs are handled by a minimum per node and a join back, which the planner can split, so no
    neighbour list is ever gathered. Nodes without edges are not returned.
    """
    both = lambda e: e.select("a", "b").unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))

    def signature(e: DataFrame):
        return e.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()

    now = persisted(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), label)
    seen = signature(now)
    while seen["n"]:
        sym = both(now)
        least = sym.groupBy("a").agg(F.min("b").alias("m"))
        large = (
            sym.join(least, "a")
            .where("b > a")
            .select(F.col("b").alias("a"), F.least("a", "m").alias("b"))
            .distinct()
        )
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a")
        # every smaller neighbour, and the node itself, points at the smallest one
        small = small.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(small.select("a", F.col("m").alias("b"))).where("a <> b").distinct()
        after = persisted(small, label)
        found = signature(after)
        dropped(now)
        now = after
        if tuple(found) == tuple(seen):
            break
        seen = found
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(
        now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    )
