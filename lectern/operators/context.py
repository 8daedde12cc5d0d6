"""Retrieval over several real lanes: evidence groups, fusion, completion by source context, evidence rows."""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.functions.vectors import cosine_distance
from lectern.operators import pruned, ranking
from lectern.operators.lanes import COMPLETION_POOL, TEXT_GATE
from lectern.operators.scope import best_row, neighbours

# Order of a chunk's representations of equal distance.
REPRESENTATIONS = ("text", "caption_text", "ocr_text", "table_text")


def representation_order(kind: Column) -> Column:
    """text, caption, OCR, table (PF11)."""
    out = F.lit(len(REPRESENTATIONS) - 1)
    for n, name in reversed(list(enumerate(REPRESENTATIONS[:-1]))):
        out = F.when(kind == name, n).otherwise(out)
    return out


def best_representation(hits: DataFrame) -> DataFrame:
    """One hit (query_id, chunk_id, representation, distance, ...) a query and chunk: the nearest, then by kind (PF11)."""
    return best_row(hits, ["query_id", "chunk_id"], "distance", representation_order(F.col("representation")))


def measured(hits: DataFrame, queries: DataFrame, vectors: DataFrame) -> DataFrame:
    """Hits (query_id, chunk_id, ...) with the distance of their chunk's own vector: a lookup of few rows, not a search."""
    asked = queries.select("query_id", "query")
    own = vectors.select("chunk_id", "embedding")
    return hits.drop("distance").join(asked, "query_id").join(own, "chunk_id").withColumn("distance", cosine_distance(F.col("query"), F.col("embedding"))).drop("query", "embedding")


def without_self(hits: DataFrame, k: int) -> DataFrame:
    """The first ``k`` of k + 1 hits when the query's own row is left out, ranked anew."""
    rest = hits.where("query_id <> chunk_id")
    return rest.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("rank"))).where(F.col("rank") <= k)


def in_groups(hits: DataFrame, groups: DataFrame) -> DataFrame:
    """A hit stands for every evidence group that its chunk belongs to, or for its chunk (R7): ``groups`` has (chunk_id, group_key).

    A group belongs to a version of a document, so groups of one name in two versions are two.
    """
    keyed = hits.join(groups.select("chunk_id", "group_key").distinct(), "chunk_id", "left")
    own = F.coalesce("group_key", F.col("chunk_id").cast("string"))
    return keyed.withColumn("group_key", F.concat_ws("/", F.col("version").cast("string"), own))


def hybrid(lanes: dict[str, DataFrame], chunks: DataFrame, groups: DataFrame, weights: dict[str, int], k: int) -> DataFrame:
    """Lanes (query_id, chunk_id, rank, distance) fused by evidence groups.

    ``chunks``: chunk_id, version, modality, text, representation. In each lane a group scores once, by its first hit.
    """
    hits = functools.reduce(DataFrame.unionByName, [rows.select("query_id", "chunk_id", "rank", "distance", F.lit(name).alias("lane")) for name, rows in lanes.items()])
    told = hits.join(chunks.select("chunk_id", "version", "modality", "text", "representation"), "chunk_id")
    return ranking.weighted_rrf(in_groups(told, groups), weights, k)


def compatible_table(a: dict[str, Column], b: dict[str, Column]) -> Column:
    """A neighbouring table goes with its anchor (PF9): no known section border between them, one surface, pages at most one apart."""
    same_section = (F.size(a["path"]) <= 0) | (F.size(b["path"]) <= 0) | (a["path"] == b["path"])
    near = (a["surface"] != "page") | (F.abs(a["page"] - b["page"]) <= 1)
    return F.coalesce(a["modality"].isin("text", "table") & (b["modality"] == "table") & same_section & a["surface"].eqNullSafe(b["surface"]) & near, F.lit(False))


def source_supplements(queries: DataFrame, vectors: DataFrame, chunks: DataFrame, core: DataFrame, gate: float = TEXT_GATE) -> DataFrame:
    """(query_id, chunk_id, distance): tables beside what a wider read finds, that the core pool doesn't have.

    The wider read gives anchors only: hits among the first hundred that pass the gate. ``chunks``: chunk_id, version,
    ordinal, modality, path, surface, page.
    """
    wide = pruned.nearest(queries, vectors, COMPLETION_POOL).where(F.round(1 - F.col("distance"), 9) >= gate)
    place = ["version", "ordinal", "modality", "path", "surface", "page"]
    anchors = wide.select("query_id", "chunk_id").join(chunks.select("chunk_id", *place), "chunk_id").where(F.col("modality").isin("text", "table"))
    anchors = anchors.select("query_id", F.col("version").alias("doc_id"), "ordinal", *[F.col(c).alias(f"a_{c}") for c in place[2:]])
    beside = neighbours(anchors.select("doc_id", "ordinal").distinct(), chunks.withColumnRenamed("version", "doc_id").select("chunk_id", "doc_id", *place[1:]))
    met = beside.join(anchors.withColumnRenamed("ordinal", "anchor"), ["doc_id", "anchor"])
    fits = compatible_table({c: F.col(f"a_{c}") for c in place[2:]}, {c: F.col(c) for c in place[2:]})
    new = met.where(fits & (F.col("query_id") != F.col("chunk_id"))).select("query_id", "chunk_id").distinct().join(core, ["query_id", "chunk_id"], "left_anti")
    return measured(new, queries, vectors)


def with_source_context(queries: DataFrame, core: DataFrame, supplements: DataFrame, k: int) -> DataFrame:
    """(query_id, chunk_id, score, rank, supplement): the core's first half stays, supplements compete with the rest.

    ``core`` and ``supplements``: query_id, chunk_id, terms, distance. All are scored with the core's statistics alone, so
    supplements change no core hit's score.
    """
    both = core.select("query_id", "chunk_id", "terms", "distance", F.lit(False).alias("supplement")).unionByName(
        supplements.select("query_id", "chunk_id", "terms", "distance", F.lit(True).alias("supplement"))
    )
    scored = ranking.blended(queries, both, core).select("query_id", "chunk_id", "score").join(both.drop("terms"), ["query_id", "chunk_id"])
    best = [F.desc("score"), "distance", "chunk_id"]
    nth = F.row_number().over(Window.partitionBy("query_id", "supplement").orderBy(*best))
    guarded = (~F.col("supplement")) & (nth <= (k + 1) // 2)
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("guarded"), *best))
    ranked = scored.withColumn("guarded", guarded).withColumn("rank", place).where(F.col("rank") <= k)
    return ranked.select("query_id", "chunk_id", "score", "rank", "supplement")


def evidence(ranked: DataFrame, chunks: DataFrame, score_kind: str) -> DataFrame:
    """Ranked hits (query_id, chunk_id, rank, score, distance) as evidence (PF12): their place in the source, hierarchy and kind of score.

    Adjacent chunks have no similarity of their own: their score is 0 and the similarity null.
    """
    adjacent = score_kind == "adjacency"
    rows = ranked.join(chunks.select("chunk_id", "version", "ordinal", "modality", "path", "surface", "page"), "chunk_id")
    similarity = F.lit(None).cast("double") if adjacent else F.round(1 - F.col("distance"), 9)
    location = F.struct(F.col("surface").alias("surface_type"), F.col("page").alias("surface_start"))
    return rows.select(
        "query_id", "rank", "chunk_id", "version", "ordinal", "modality", location.alias("source_location"), F.col("path").alias("hierarchy"),
        (F.lit(0.0) if adjacent else F.col("score")).alias("score"), F.lit(score_kind).alias("score_kind"), similarity.alias("vector_similarity"),
    )
