"""Reading tables, inline relations, and the chunk tables that retrieval runs on."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A base table; filters and column choice reach its Parquet scan (SRC1)."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def values(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A list of rows as a relation (SRC2)."""
    return spark.createDataFrame(rows, schema)


#: One token counter for chunking and packing: words of letters, digits and underscores, and single other characters.
TOKEN = r"[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s]"


def token_count(text: Column) -> Column:
    return F.size(F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0))).cast("long")


def line_chunks(documents: DataFrame) -> DataFrame:
    """(doc_id, ordinal, content): the lines of documents that aren't blank, numbered from 0."""
    lines = documents.select("doc_id", F.posexplode(F.filter(F.split("text", "\n"), lambda x: F.btrim(x) != "")).alias("ordinal", "content"))
    return lines.select("doc_id", F.col("ordinal").cast("long").alias("ordinal"), "content")


def chunk_id(doc_id: Column, ordinal: Column) -> Column:
    """A key whose order is that of (document, ordinal), for up to a million chunks a document."""
    return doc_id * 1_000_000 + ordinal
