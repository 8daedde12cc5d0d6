"""Writing: upsert, insert-if-absent with a check, cascading removal, content-addressed files, JSON lines (SRC11 to SRC17)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F


def upserted(stored: DataFrame, incoming: DataFrame, keys: Sequence[str], version: str) -> DataFrame:
    """The last version of each key of both tables; of equal versions the incoming row wins (SRC13)."""
    both = stored.withColumn("from_", F.lit(0)).unionByName(incoming.withColumn("from_", F.lit(1)))
    order = Window.partitionBy(*keys).orderBy(F.desc(version), F.desc("from_"))
    return both.withColumn("nth_", F.row_number().over(order)).where("nth_ = 1").drop("nth_", "from_")


def inserted_if_absent(stored: DataFrame, incoming: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``stored`` and the rows of ``incoming`` whose key it doesn't have (SRC14)."""
    return stored.unionByName(incoming.join(stored.select(*keys), list(keys), "left_anti"))


def mismatches(stored: DataFrame, incoming: DataFrame, keys: Sequence[str], content: str) -> DataFrame:
    """Keys that both tables have with different content: a violation of an insert-only table (SRC14, PF14)."""
    left = stored.select(*keys, F.col(content).alias("stored_content"))
    right = incoming.select(*keys, F.col(content).alias("incoming_content"))
    return left.join(right, list(keys)).where(~F.col("stored_content").eqNullSafe(F.col("incoming_content")))


def removed(table: DataFrame, retired: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``table`` without the rows of retired keys (SRC15)."""
    return table.join(retired.select(*keys), list(keys), "left_anti")


def removed_counts(tables: dict[str, DataFrame], retired: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(name, n): rows that a removal of retired keys takes from each table (SRC15, J10)."""
    out = None
    for name, table in tables.items():
        n = table.join(retired.select(*keys), list(keys), "left_semi").agg(F.count("*").alias("n")).select(F.lit(name).alias("name"), "n")
        out = n if out is None else out.unionByName(n)
    return out


_STORED = "sha256 string, content binary, shard string"


def store_immutable(found: DataFrame, at: str) -> DataFrame:
    """Adds (path, content) under the content's hash where the store lacks that hash; nothing stored is ever replaced (SRC12).

    Returns (path, sha256, stored_at)."""
    hashed = found.withColumn("sha256", F.sha2("content", 256)).withColumn("shard", F.substring("sha256", 1, 2))
    new = hashed.dropDuplicates(["sha256"])
    if _exists(found.sparkSession, at):
        new = new.join(found.sparkSession.read.schema(_STORED).parquet(at).select("sha256"), "sha256", "left_anti")
    new.select("sha256", F.col("content").cast("binary").alias("content"), "shard").write.mode("append").partitionBy("shard").parquet(at)
    return hashed.select("path", "sha256", F.concat(F.lit(at.rstrip("/") + "/shard="), "shard").alias("stored_at"))


def read_immutable(spark: SparkSession, at: str) -> DataFrame:
    """(sha256, content, intact): what is stored, checked against its hash (SRC12)."""
    return spark.read.schema(_STORED).parquet(at).select("sha256", "content", (F.sha2("content", 256) == F.col("sha256")).alias("intact"))


def _exists(spark: SparkSession, at: str) -> bool:
    path = spark._jvm.org.apache.hadoop.fs.Path(at)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path)


def write_jsonl(df: DataFrame, at: str) -> None:
    """JSON lines; Spark's committer makes the folder appear whole (SRC17)."""
    df.write.mode("overwrite").json(at)


def read_jsonl(spark: SparkSession, at: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).json(at)


def write_segments(df: DataFrame, at: str, segment: str) -> None:
    """Writes one folder a segment and skips those that are complete, so a stopped run resumes where it was (SRC11).

    One job writes all missing segments, dealt out by segment and a hash of the row, so that a task that runs again deals its
    rows as before; then a marker a segment that this job has written makes them count."""
    spark = df.sparkSession
    done = f"{at}/_segments"
    missing = df
    if _exists(spark, done):
        missing = df.join(spark.read.schema("name string").json(done), df[segment].cast("string") == F.col("name"), "left_anti")
    salt = F.pmod(F.xxhash64(F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns]))), F.lit(8))
    seen = Observation()
    dealt = missing.select(*[F.col(f"`{c}`") for c in df.columns]).repartition(segment, salt)
    dealt.observe(seen, F.collect_set(F.coalesce(F.col(segment).cast("string"), F.lit(""))).alias("names")).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(segment).parquet(at)
    names = seen.get["names"]  # as many as there are folders
    if names:
        spark.createDataFrame([(n,) for n in names], "name string").coalesce(1).write.mode("append").json(done)
