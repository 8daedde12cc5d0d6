"""What a reader may see, and the relational core around it: scoped joins, best rows, adjacency, catalogues."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def serving_scope(kbs: DataFrame, revisions: DataFrame, targets: DataFrame, documents: DataFrame, versions: DataFrame, chunks: DataFrame) -> DataFrame:
    """Chunks that reads may return (PF1, J1): the base's active revision, ready and serving targets, documents and
    versions that are there, chunks that aren't excluded. Each predicate sits beside its table's scan."""
    kb = kbs.where("deleted_at is null").select("kb_id", F.col("active_revision_id").alias("revision_id"))
    return (
        targets.where("build_status = 'ready' and serving_status = 'serving'")
        .join(kb, ["kb_id", "revision_id"])
        .join(revisions.where("status = 'active'").select("revision_id"), "revision_id", "left_semi")
        .join(documents.where("deleted_at is null").select("document_id"), "document_id", "left_semi")
        .join(versions.where("status = 'available'").select("version_id"), "version_id", "left_semi")
        .join(chunks.where("excluded_at is null"), "target_id")
    )


def in_scopes(rows: DataFrame, scopes: DataFrame) -> DataFrame:
    """Rows of a run's frozen (kb_id, revision_id) snapshots (PF13)."""
    return rows.join(scopes.select("kb_id", "revision_id").distinct(), ["kb_id", "revision_id"], "left_semi")


def best_row(rows: DataFrame, keys: Sequence[str], *order: Column | str) -> DataFrame:
    """One row a key, the first by ``order`` (DISTINCT ON: AG3, AG4, J4, J7)."""
    nth = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return rows.withColumn("nth_", nth).where("nth_ = 1").drop("nth_")


def first_rows(rows: DataFrame, keys: Sequence[str], n: int, *order: Column | str) -> DataFrame:
    """The first ``n`` rows of each key with their ``nth``."""
    return rows.withColumn("nth", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("nth") <= n)


def left_top(left: DataFrame, right: DataFrame, keys: Sequence[str], n: int, *order: Column | str) -> DataFrame:
    """Each left row with its first ``n`` right rows, kept when it has none (LEFT JOIN LATERAL: J3)."""
    return left.join(first_rows(right, keys, n, *order), list(keys), "left")


def introductions(chunks: DataFrame, most_chars: int = 2048) -> DataFrame:
    """(doc_id, introduction): the start of each document's first chunk."""
    first = F.min_by("content", F.struct("ordinal", "content"))
    return chunks.groupBy("doc_id").agg(F.substring(first, 1, most_chars).alias("introduction"))


def neighbours(anchors: DataFrame, chunks: DataFrame) -> DataFrame:
    """Anchors (doc_id, ordinal) with the chunks one before and one after (J6): an equi-join on both columns."""
    near = anchors.select("doc_id", F.col("ordinal").alias("anchor"), F.explode(F.array(F.col("ordinal") - 1, F.col("ordinal") + 1)).alias("ordinal"))
    return near.join(chunks, ["doc_id", "ordinal"])


def adjacency_read(anchors: DataFrame, chunks: DataFrame, most_anchors: int = 2) -> DataFrame:
    """The neighbours of the first anchors as evidence of score 0 (R10); a chunk met twice is returned once."""
    few = anchors.orderBy("rank").limit(most_anchors)
    met = neighbours(few, chunks).join(few.select("doc_id", "ordinal"), ["doc_id", "ordinal"], "left_anti")
    return best_row(met, ["doc_id", "ordinal"], "anchor").withColumn("score", F.lit(0.0)).withColumn("score_kind", F.lit("adjacency"))


def table_neighbour(anchor_kind: Column, kind: Column, anchor_path: Column, path: Column, anchor_page: Column, page: Column, anchor_surface: Column, surface: Column) -> Column:
    """A neighbouring table belongs to its anchor (PF9): same headings, same surface, at most a page apart."""
    return (
        anchor_kind.isin("text", "table") & (kind == "table") & (F.size(path) > 0) & anchor_path.eqNullSafe(path)
        & anchor_surface.eqNullSafe(surface) & (F.abs(anchor_page - page) <= 1)
    )


def relation_endpoints(relations: DataFrame, chunks: DataFrame, picked: DataFrame, most: int = 500) -> DataFrame:
    """Relations one of whose three columns is picked, with both chunks (J8): the OR becomes a union of semi-joins."""
    hit = None
    for column in ("parent_id", "visual_id", "asset_id"):
        some = relations.join(picked.select(F.col("picked_id").alias(column)).distinct(), column, "left_semi").select(*relations.columns)
        hit = some if hit is None else hit.unionByName(some)
    parent, visual = (chunks.select(F.col("chunk_id").alias(f"{k}_id"), F.col("content").alias(f"{k}_content")) for k in ("parent", "visual"))
    return hit.distinct().join(parent, "parent_id").join(visual, "visual_id").orderBy("parent_id", "visual_id").limit(most)


def first_matching_rule(pairs: DataFrame, rules: Sequence[tuple[str, Column]]) -> Column:
    """The first rule that holds for a pair."""
    out = F.lit(None).cast("string")
    for name, holds in reversed(rules):
        out = F.when(holds, F.lit(name)).otherwise(out)
    return out


def merged_lanes(dense: DataFrame, lexical: DataFrame, key: str = "chunk_id") -> DataFrame:
    """Dense and lexical hits by chunk (J14): the dense lane's attributes win, the lexical rank is attached."""
    right = lexical.select(key, "lexical_rank", F.col("distance").alias("lexical_distance"))
    both = dense.join(right, key, "full_outer")
    return both.withColumn("distance", F.coalesce("distance", "lexical_distance")).drop("lexical_distance")


def pivoted_roles(bindings: DataFrame) -> DataFrame:
    """(revision_id, a column a role) from binding rows."""
    return bindings.groupBy("revision_id").pivot("role", ["text_retrieval", "semantic_analysis", "cross_modal_retrieval"]).agg(F.first("space_id"))


def catalogue(documents: DataFrame, chunks: DataFrame, titles: DataFrame, after: object = None, page: int = 50, most_titles: int = 8) -> DataFrame:
    """A page of documents with chunk counts and first titles (R12, AG1, AG2, W1, T6, PF5), by id after a cursor.

    The page is cut before chunks and titles are joined; one row more than a page tells whether it is truncated.
    """
    rows = documents if after is None else documents.where(F.col("doc_id") > F.lit(after))
    rows = rows.orderBy("doc_id").limit(page + 1).withColumn("n_", F.row_number().over(Window.orderBy("doc_id")))  # at most page + 1 rows
    rows = rows.withColumn("truncated", F.max("n_").over(Window.partitionBy()) > page).where(F.col("n_") <= page).drop("n_")
    ids = rows.select("doc_id")
    counts = chunks.join(ids, "doc_id", "left_semi").groupBy("doc_id").agg(F.count("*").alias("n_chunks"))
    near = titles.join(ids, "doc_id", "left_semi")
    depth = near.groupBy("doc_id").agg(F.min("depth").alias("depth"))
    seen = best_row(near.join(depth, ["doc_id", "depth"]), ["doc_id", "title"], "ordinal")
    outline = first_rows(seen, ["doc_id"], most_titles, "ordinal", "title").groupBy("doc_id").agg(
        F.transform(F.sort_array(F.collect_list(F.struct("nth", "title"))), lambda x: x["title"]).alias("titles")
    )
    return rows.join(counts, "doc_id", "left").join(outline, "doc_id", "left").withColumn("n_chunks", F.coalesce("n_chunks", F.lit(0)))


def keyset_page(rows: DataFrame, sort: str, key: str, after: tuple | None, n: int, descending: bool = False) -> DataFrame:
    """Rows after (sort, key), one more than a page to tell whether there are more (T4)."""
    if after is not None:
        s, k = F.col(sort), F.col(key)
        a, b = F.lit(after[0]), F.lit(after[1])
        rows = rows.where((s < a) | ((s == a) & (k < b)) if descending else (s > a) | ((s == a) & (k > b)))
    order = [F.desc(sort), F.desc(key)] if descending else [F.asc(sort), F.asc(key)]
    return rows.orderBy(*order).limit(n + 1)


def round_robin(views: DataFrame, protected: int = 3) -> DataFrame:
    """Views (query_id, view, position, item) interleaved: the first of view 0 first, then by position, an item once."""
    guard = F.when((F.col("view") == 0) & (F.col("position") <= protected), 0).otherwise(1)
    ranked = best_row(views.withColumn("guard", guard), ["query_id", "item"], "guard", "position", "view")
    place = F.row_number().over(Window.partitionBy("query_id").orderBy("guard", "position", "view"))
    return ranked.withColumn("rank", place).select("query_id", "item", "rank")


def protected_merge(baseline: DataFrame, others: DataFrame, k: int) -> DataFrame:
    """(query_id, item, rank): the first half of the baseline (rounded up), then the best of the rest by score."""
    kept = (k + 1) // 2
    base = baseline.select("query_id", "item", "score", "rank").withColumn("tier", F.when(F.col("rank") <= kept, 0).otherwise(1))
    rest = others.select("query_id", "item", "score").withColumn("rank", F.lit(1 << 30)).withColumn("tier", F.lit(1))
    one = best_row(base.unionByName(rest), ["query_id", "item"], "tier", "rank")
    order = Window.partitionBy("query_id").orderBy("tier", F.when(F.col("tier") == 0, F.col("rank")), F.desc("score"), "item")
    return one.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k).select("query_id", "item", F.col("place").alias("rank"))


def decorative_images(images: DataFrame) -> DataFrame:
    """``images`` (asset_id, digest, width, height, area_ratio) with ``decorative``: tiny, or repeated and small (PF10, AG21)."""
    repeats = F.count("*").over(Window.partitionBy("digest"))
    return images.withColumn("decorative", (F.least("width", "height") < 64) | ((repeats >= 3) & (F.col("area_ratio") < 0.08)))
