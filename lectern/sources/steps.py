"""Tables written between the steps of a plan, where all executors can read them."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """What ``spark.checkpoint.dir`` names. Where it is unset, a local folder serves on one machine, and a cluster is an error."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir has to name a folder that the driver and all executors share")
    named = "file://" + tempfile.mkdtemp(prefix="lectern-steps-")
    spark.conf.set("spark.checkpoint.dir", named)
    return named


def stored(rows: DataFrame, label: str) -> DataFrame:
    """``rows`` written once and read back: later uses don't compute them again, and lost executors cost a re-read."""
    at = f"{shared_folder(rows.sparkSession)}/{label}-{uuid.uuid4().hex}"
    rows.write.parquet(at)
    return rows.sparkSession.read.schema(rows.schema).parquet(at)
