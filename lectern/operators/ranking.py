"""Fusion and scoring: weighted reciprocal ranks, in-pool BM25, the blended score, frozen statistics, policies."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.functions import text as tx
from lectern.functions.vectors import sigmoid
from lectern.operators import pruned
from lectern.operators.scope import best_row

# Rank fusion's constant, BM25's parameters, the blend.
RRF_K, K1, B = 60, 1.2, 0.75
VECTOR_WEIGHT, LEXICAL_WEIGHT, PHRASE_BONUS = 0.65, 0.35, 0.08


def modality_order(modality: Column) -> Column:
    return F.when(modality == "text", 0).when(modality == "table", 1).when(modality == "image", 2).otherwise(3)


def weighted_rrf(hits: DataFrame, weights: dict[str, int], k: int, rrf_k: int = RRF_K) -> DataFrame:
    """Weighted reciprocal rank fusion (F1, AG8, AG9, W4, SO2).

    ``hits``: query_id, lane, rank, chunk_id, group_key, text, modality, distance, representation. In each lane a group
    counts once, by its first hit; the group's shown hit is the best of these. Groups are in order of sums of decimals
    (28 places), so ties are real ties, broken by the best lane rank, modality, id and group; scores are shown with 12 places.
    ``weights`` are in millionths.
    """
    micros = F.create_map(*[F.lit(x) for pair in weights.items() for x in pair])
    first = best_row(hits, ["query_id", "lane", "group_key"], "rank", "chunk_id")
    weight = (micros[F.col("lane")].cast("decimal(20,0)") * F.lit(0.000001).cast("decimal(7,6)")).cast("decimal(29,27)")
    part = (weight / (F.col("rank") + rrf_k).cast("decimal(10,0)")).cast("decimal(38,28)")
    ranks = [F.min(F.when(F.col("lane") == lane, F.col("rank"))).alias(f"{lane}_rank") for lane in weights]
    scored = first.groupBy("query_id", "group_key").agg(F.sum(part).alias("exact_"), F.min("rank").alias("best_rank"), *ranks)
    shown = best_row(
        first.withColumn("m_", modality_order(F.col("modality"))), ["query_id", "group_key"], F.desc(F.length(F.coalesce("text", F.lit(""))) > 0), "m_", "distance", "chunk_id"
    ).select("query_id", "group_key", "chunk_id", F.col("m_").alias("modality_order"))
    kinds = hits.groupBy("query_id", "group_key").agg(F.sort_array(F.collect_set("representation")).alias("representations"))
    order = Window.partitionBy("query_id").orderBy(F.desc("exact_"), "best_rank", "modality_order", "chunk_id", "group_key")
    both = scored.join(shown, ["query_id", "group_key"]).join(kinds, ["query_id", "group_key"])
    top = both.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return top.withColumn("score", F.bround("exact_", 12).cast("double")).drop("exact_")


def plain_rrf(hits: DataFrame, rrf_k: int = RRF_K, places: int = 12) -> DataFrame:
    """(query_id, item, score): the sum over lists of 1 / (k + rank)."""
    return hits.groupBy("query_id", "item").agg(F.round(F.sum(1.0 / (F.col("rank") + rrf_k)), places).alias("score"))


def pool_statistics(pool: DataFrame) -> DataFrame:
    """(query_id, n_docs, average_length) of each query's pool (query_id, chunk_id, terms) (AG7)."""
    return pool.groupBy("query_id").agg(F.count("*").alias("n_docs"), F.greatest(F.avg(F.size("terms")), F.lit(1.0)).alias("average_length"))


def document_frequency(pool: DataFrame) -> DataFrame:
    """(query_id, term, df) (AG7)."""
    return pool.select("query_id", F.explode(F.array_distinct("terms")).alias("term")).groupBy("query_id", "term").agg(F.count("*").alias("df"))


def bm25_in_pool(queries: DataFrame, pool: DataFrame, reference: DataFrame | None = None) -> DataFrame:
    """(query_id, chunk_id, lexical_score, coverage): BM25 over its maximum, with the pool's own or a frozen pool's
    statistics (F3, F6). ``queries``: (query_id, query_terms); pools: (query_id, chunk_id, terms)."""
    base = pool if reference is None else reference
    wanted = queries.select("query_id", F.explode(F.array_distinct("query_terms")).alias("term"))
    wanted = wanted.join(document_frequency(base), ["query_id", "term"], "left").join(pool_statistics(base), "query_id")
    df = F.coalesce("df", F.lit(0))
    wanted = wanted.withColumn("idf", F.log1p((F.col("n_docs") - df + 0.5) / (df + 0.5))).select("query_id", "term", "idf", "average_length")
    counts = pool.select("query_id", "chunk_id", F.explode("terms").alias("term")).groupBy("query_id", "chunk_id", "term").agg(F.count("*").alias("tf"))
    lengths = pool.select("query_id", "chunk_id", F.greatest(F.size("terms"), F.lit(1)).alias("length"))
    grid = wanted.join(lengths, "query_id").join(counts, ["query_id", "chunk_id", "term"], "left")
    tf, norm = F.coalesce("tf", F.lit(0)), 1 - B + B * F.col("length") / F.col("average_length")
    return grid.groupBy("query_id", "chunk_id").agg(
        F.round(F.least(F.lit(1.0), F.sum(F.col("idf") * tf * (K1 + 1) / (tf + K1 * norm)) / F.sum(F.col("idf") * (K1 + 1) / (K1 * norm + 1))), 9).alias("lexical_score"),
        F.round(F.avg((tf > 0).cast("double")), 9).alias("coverage"),
    )


def blended(queries: DataFrame, pool: DataFrame, reference: DataFrame | None = None) -> DataFrame:
    """The pool's blended score (F2): cosine and BM25, and a bonus for the query's terms in one piece.

    ``pool`` also has distance. Queries without terms score by cosine alone.
    """
    lexical = bm25_in_pool(queries, pool, reference)
    rows = pool.join(queries.select("query_id", "query_terms"), "query_id").join(lexical, ["query_id", "chunk_id"], "left")
    cosine = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), 1 - F.col("distance")))
    phrase = (F.size("query_terms") > 0) & (F.instr(F.array_join("terms", ""), F.array_join("query_terms", "")) > 0)
    score = VECTOR_WEIGHT * ((cosine + 1) / 2) + LEXICAL_WEIGHT * F.coalesce("lexical_score", F.lit(0.0))
    score = F.round(F.when(phrase, F.least(F.lit(1.0), score + PHRASE_BONUS)).otherwise(score), 9)
    return rows.select("query_id", "chunk_id", score.alias("score"), F.coalesce("lexical_score", F.lit(0.0)).alias("lexical_score"), F.coalesce("coverage", F.lit(0.0)).alias("coverage"))


def corpus_bm25(queries: DataFrame, chunks: DataFrame, k: int = 40) -> DataFrame:
    """(query_id, chunk_id, score, rank) over a whole corpus (chunk_id, terms) by a block-max search.

    One pass counts in how many chunks each wanted term is, a second one searches; no posting becomes a row.
    """
    asked = pruned.asked_terms(queries.select("query_id", F.col("query_terms").alias("terms")))
    impacts = [Bm25.of(*pruned.statistics(chunks, terms)) for terms in asked]
    return pruned.best_matches(chunks, asked, impacts, k, places=6).select("query_id", "chunk_id", "score", "rank")


@dataclass
class Bm25:
    """Impacts of terms by their numbers."""

    idf: np.ndarray
    average_length: float

    @classmethod
    def of(cls, df: np.ndarray, n_docs: int, n_terms: int) -> Bm25:
        return cls(np.log1p((n_docs - df + 0.5) / (df + 0.5)), n_terms / max(n_docs, 1))

    def __call__(self, term: np.ndarray, n: np.ndarray, length: np.ndarray) -> np.ndarray:
        norm = 1 - B + B * length / max(self.average_length, 1e-9)
        return self.idf[term] * n * (K1 + 1) / (n + K1 * norm)


def minimal_idf(queries: DataFrame, chunks: DataFrame) -> DataFrame:
    """(query_id, chunk_id, score): the sum of idf of the matched terms, each counted once."""
    wanted = queries.select("query_id", F.explode(F.array_distinct("query_terms")).alias("term"))
    docs = chunks.select("chunk_id", F.explode(F.array_distinct("terms")).alias("term")).join(wanted.select("term").distinct(), "term", "left_semi")
    n = chunks.agg(F.count("*").alias("n_docs"))
    df = docs.groupBy("term").agg(F.count("*").alias("df"))
    idf = F.log1p((F.col("n_docs") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    return wanted.join(df, "term").join(docs, "term").join(F.broadcast(n)).groupBy("query_id", "chunk_id").agg(F.round(F.sum(idf), 6).alias("score"))


def best_window(windows: DataFrame) -> DataFrame:
    """(query_id, chunk_id, score, window): the strongest window's logit through a sigmoid, and its index (AG10)."""
    top = windows.groupBy("query_id", "chunk_id").agg(F.max("logit").alias("logit"), F.max_by("window", F.struct("logit", -F.col("window"))).alias("window"))
    return window_scores(top)


def window_scores(top: DataFrame) -> DataFrame:
    """Logits of each chunk's strongest window as scores."""
    return top.select("query_id", "chunk_id", F.round(sigmoid(F.col("logit")), 9).alias("score"), "window")


def model_rerank(hits: DataFrame, score: Column, most: int = 20) -> DataFrame:
    """New order of the first ``most`` text and table hits by a model's score; other hits keep their places."""
    movable = F.col("modality").isin("text", "table") & (F.col("rank") <= most)
    rows = hits.withColumn("model_score", score).withColumn("movable", movable)
    slots = rows.where("movable").withColumn("slot", F.row_number().over(Window.partitionBy("query_id").orderBy("rank")))
    moved = rows.where("movable").withColumn("slot", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("model_score"), "chunk_id")))
    placed = moved.drop("rank").join(slots.select("query_id", "slot", "rank"), ["query_id", "slot"]).drop("slot")
    return placed.unionByName(rows.where(~F.col("movable"))).drop("movable")


def path_scores(paths: DataFrame) -> DataFrame:
    """(query_id, path_id, score, rank): a path is as strong as its weakest chunk (F8). ``paths``: a row a (path, chunk score)."""
    weakest = paths.groupBy("query_id", "path_id").agg(F.min("score").alias("score"))
    return weakest.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "path_id")))


def policy_scores(cases: DataFrame, policies: DataFrame) -> DataFrame:
    """(policy, case_id, chunk_id, score): every policy's weights over every case's hits (F11). Policies are a bounded grid."""
    if policies.limit(1001).count() > 1000:
        raise ValueError("a grid holds at most 1000 policies")
    both = cases.join(F.broadcast(policies))
    return both.select("policy", "case_id", "chunk_id", F.round(F.col("vector_weight") * F.col("vector_score") + F.col("lexical_weight") * F.col("lexical_score"), 9).alias("score"))


def chosen_policy(results: DataFrame, baseline: str) -> DataFrame:
    """The policy of most hits among those that lose no case of the baseline (F12). ``results``: (policy, case_id, hit)."""
    base = results.where((F.col("policy") == baseline) & F.col("hit")).select("case_id", F.lit(True).alias("had"))
    rows = results.join(base, "case_id", "left")
    summed = rows.groupBy("policy").agg(F.count_if("hit").alias("hits"), F.count_if(F.coalesce("had", F.lit(False)) & ~F.col("hit")).alias("lost"))
    return summed.where("lost = 0").orderBy(F.desc("hits"), F.col("policy") != baseline, "policy").limit(1)


def fused_views(views: Sequence[DataFrame]) -> DataFrame:
    """Several views of a query (query_id, item, rank) fused by reciprocal ranks."""
    out = views[0]
    for view in views[1:]:
        out = out.unionByName(view)
    return plain_rrf(out)


def text_similarity(a: Column, b: Column) -> Column:
    return tx.jaccard(tx.terms(a), tx.terms(b))
