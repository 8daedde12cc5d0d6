"""Session settings for retrieval workloads."""

from __future__ import annotations

from pyspark.sql import SparkSession

#: Adaptive execution re-plans joins and partition counts at run time; Arrow carries what Python has to do.
SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.parquet.filterPushdown": "true",
}


def session(master: str | None = None, **extra: str) -> SparkSession:
    builder = SparkSession.builder.appName("lectern")
    if master:
        builder = builder.master(master)
    for key, value in (SETTINGS | extra).items():
        builder = builder.config(key, value)
    return builder.getOrCreate()
