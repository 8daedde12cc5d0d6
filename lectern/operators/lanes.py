"""Retrieval lanes: exact vectors, questions, lexemes, another space, and what joins them. All take batches of queries."""

from __future__ import annotations

import functools
from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.functions import text as tx
from lectern.functions import values as vl
from lectern.functions.vectors import dot, norm
from lectern.operators import pruned
from lectern.operators.scope import best_row
from lectern.sources.steps import stored

# Admission gates, and candidates of a lane.
TEXT_GATE, CROSS_GATE = 0.35, 0.25
CANDIDATES_PER_HIT, MAX_CANDIDATES, COMPLETION_POOL = 4, 40, 100


def candidate_count(k: int) -> int:
    return max(k, min(CANDIDATES_PER_HIT * k, MAX_CANDIDATES))


def distances(queries: DataFrame, vectors: DataFrame, exclude_self: bool = True) -> DataFrame:
    """(query_id, chunk_id, distance) of a batch (query_id, query) against all vectors (chunk_id, embedding).

    All pairs of the stated queries, for plans that need every distance; ``pruned.nearest`` finds the nearest without them.
    """
    keep = F.col("query_id") != F.col("chunk_id") if exclude_self else F.lit(True)
    # norms once a vector, not once a pair
    sized = vectors.select("chunk_id", "embedding", norm(F.col("embedding")).alias("size"))
    asks = queries.select("query_id", "query", norm(F.col("query")).alias("query_size"))
    blocks = pruned.query_blocks(asks, pruned.BLOCK_QUERIES)
    pairs = functools.reduce(DataFrame.unionByName, [sized.join(F.broadcast(block), keep) for block in blocks])
    size = F.col("size") * F.col("query_size")
    distance = F.round(1.0 - F.when(size > 0, dot(F.col("query"), F.col("embedding")) / size), 9) + F.lit(0.0)
    return pairs.select("query_id", "chunk_id", distance.alias("distance"))


def vector_lane(queries: DataFrame, vectors: DataFrame, k: int, gate: float | None = TEXT_GATE, exclude_self: bool = True) -> DataFrame:
    """The exact lane (R1, R6, T1, PF7): candidates by distance, gate on similarity, rank, score = 1 - distance."""
    pool = pruned.nearest(queries, vectors, candidate_count(k), exclude_self)
    admitted = pool if gate is None else pool.where(F.round(1 - F.col("distance"), 9) >= gate)
    ranked = admitted.where(F.col("rank") <= k)  # the gate cuts a tail off, so ranks stay as they are
    return ranked.select("query_id", "chunk_id", "rank", "distance", F.round(1 - F.col("distance"), 9).alias("score"))


def common_lane(queries: DataFrame, rows: DataFrame, k: int, *order: Column | str) -> DataFrame:
    """(query_id, ..., rank): each query's first ``k`` rows (chunk_id, ...) in an order that is the same for all queries, its own left out.

    They are among the first k + 1 of all rows, so no row meets a query beyond these.
    """
    few = rows.orderBy(*order).limit(k + 1)
    met = queries.select("query_id").join(F.broadcast(few), F.col("query_id") != F.col("chunk_id"))
    return met.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(*order))).where(F.col("rank") <= k)


def placed(rows: DataFrame, first: str, second: str) -> DataFrame:
    """``rows`` with ``place`` from 1, by two columns: numbered within the first one's values, behind the rows of smaller values."""
    sizes = rows.groupBy(first).agg(F.count("*").alias("n_"))
    before = sizes.withColumn("before_", F.coalesce(F.sum("n_").over(Window.orderBy(first).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("n_")  # a row a value
    nth = F.row_number().over(Window.partitionBy(first).orderBy(second))
    return rows.withColumn("nth_", nth).join(F.broadcast(before), rows[first].eqNullSafe(before[first])).drop(before[first]).withColumn("place", F.col("before_") + F.col("nth_")).drop("before_", "nth_")


def merged_with_all(few: DataFrame, every: DataFrame, among: Column) -> DataFrame:
    """(query_id, chunk_id, distance, rank, dense): a short lane merged with one that holds all pairs whose chunk is ``among`` its rows.

    The short lane's hits are ``dense``: those among the long lane's rows mark them, the others come beside (J14). Only the
    short lane goes to all tasks, in blocks of queries, and the long one's pairs stay where they are made.
    """
    few = stored(few, "few")
    marks = few.where(among).select("query_id", "chunk_id", F.lit(True).alias("dense_"))
    marked = every.join(F.broadcast(marks), ["query_id", "chunk_id"], "left").select("query_id", "chunk_id", "distance", "rank", F.coalesce("dense_", F.lit(False)).alias("dense"))
    return marked.unionByName(few.where(~among).select("query_id", "chunk_id", "distance", F.lit(None).cast("int").alias("rank"), F.lit(True).alias("dense")))


def dual_quota(source: DataFrame, questions: DataFrame, k_source: int, k_question: int) -> DataFrame:
    """Body hits and question hits with separate quotas (T3, R2, SO1, W2).

    ``source`` has (query_id, chunk_id, distance); ``questions`` also question_ordinal, with the question's distance and
    ``source_distance``, the chunk's own. Questions add chunks but never change a chunk's own distance.
    """
    by_source = Window.partitionBy("query_id").orderBy("distance", "chunk_id")
    body = source.withColumn("n_", F.row_number().over(by_source)).where(F.col("n_") <= k_source)
    body = body.select("query_id", "chunk_id", F.col("distance").alias("source_distance"), F.lit(None).cast("double").alias("question_distance"), F.lit(None).cast("long").alias("question_ordinal"), F.lit(0).alias("origin"))
    one = best_row(questions, ["query_id", "chunk_id"], "distance", "question_ordinal")
    asked = one.withColumn("n_", F.row_number().over(Window.partitionBy("query_id").orderBy("distance", "chunk_id"))).where(F.col("n_") <= k_question)
    asked = asked.select("query_id", "chunk_id", "source_distance", F.col("distance").alias("question_distance"), F.col("question_ordinal").cast("long").alias("question_ordinal"), F.lit(1).alias("origin"))
    both = body.unionByName(asked)
    spread = Window.partitionBy("query_id", "chunk_id")
    both = both.withColumn("question_distance", F.min("question_distance").over(spread)).withColumn("question_ordinal", F.max("question_ordinal").over(spread))
    kept = best_row(both, ["query_id", "chunk_id"], "origin")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.asc_nulls_last("source_distance"), "chunk_id"))
    return kept.withColumn("rank", rank)


def lexeme_index(chunks: DataFrame, lexemes: Column | None = None) -> DataFrame:
    """(chunk_id, lexemes, lexical_hash): what the lexical store keeps of a chunk."""
    found = lexemes if lexemes is not None else tx.lexemes(F.col("content"))
    rows = chunks.select("chunk_id", found.alias("lexemes")).where(F.size("lexemes") > 0)
    return rows.withColumn("lexical_hash", F.sha2(F.array_join("lexemes", " "), 256))


def lexical_lane(queries: DataFrame, index: DataFrame, k: int) -> DataFrame:
    """OR match and rank (R3, R4, R5): ``queries`` has (query_id, lexemes); more matched lexemes first, then the id.

    score is 1 / rank; lexical_score is the cover score of so many matched positions. A block-max search: no posting
    becomes a row.
    """
    asked = pruned.asked_terms(queries.select("query_id", F.col("lexemes").alias("terms")))
    found = pruned.best_matches(index.select("chunk_id", F.col("lexemes").alias("terms")), asked, [_once] * len(asked), k)
    r = F.col("score") * 0.1
    return found.select("query_id", "chunk_id", "rank", F.col("score").cast("long").alias("matched"), F.round(r / (r + 1), 9).alias("lexical_score"), F.round(1 / F.col("rank"), 9).alias("score"))


def _once(term: np.ndarray, n: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Each matched lexeme counts one."""
    return np.ones(len(term))


def manifest(index: DataFrame, analyzer: str, target: str = "target_id") -> DataFrame:
    """(target, n, manifest_hash): one hash over each target's chunks and their lexical hashes, in order (AG5)."""
    rows = F.collect_list(F.concat(F.col("chunk_id").cast("string"), F.lit(":"), F.col("lexical_hash")))
    return index.groupBy(target).agg(F.count("*").alias("n"), vl.list_hash(analyzer, rows).alias("manifest_hash"))


def manifest_status(serving: DataFrame, manifests: DataFrame, target: str = "target_id") -> DataFrame:
    """One row: targets served, targets with a manifest, and whether the sets are equal."""
    a, b = serving.select(target).distinct().withColumn("s", F.lit(1)), manifests.select(target).distinct().withColumn("m", F.lit(1))
    return a.join(b, target, "full_outer").agg(
        F.count("s").alias("n_serving"), F.count("m").alias("n_manifested"), F.coalesce(F.bool_and(F.col("s").isNotNull() & F.col("m").isNotNull()), F.lit(True)).alias("complete")
    )


def eligible(kind: Column, score: Column, lexical_rank: Column, cosine: Column, coverage: Column, hop: Column, has_path: Column, cross: Column, gate: float = 0.45) -> Column:
    """Whether evidence may be shown, by the kind of its score (PF8)."""
    cosine_gate = cosine >= F.when(cross, CROSS_GATE).otherwise(TEXT_GATE)
    strong = (coverage > 0) | (score >= max(0.55, gate + 0.10))
    decided = (
        F.when(score.isNull() | (kind == "adjacency"), False)
        .when(kind == "lexical", lexical_rank.isNotNull())
        .when(kind == "graph", has_path & hop.isin(1, 2, 3) & (score > 0))
        .when(kind == "rrf", lexical_rank.isNotNull() | cosine_gate)
        .when(kind == "hybrid", cosine_gate & (score >= gate) & strong)
        .otherwise(score >= gate)
    )
    return F.coalesce(decided, F.lit(False))


# Fixed value: rounds of follow-up queries after the first.
FOLLOW_UP_ROUNDS = 2


def anchored(asked: DataFrame, shown: DataFrame, terms: DataFrame) -> DataFrame:
    """Follow-ups (query_id, ..., terms) that have a term of the evidence shown for their query.

    ``shown``: query_id, chunk_id; ``terms``: chunk_id, terms. A semi-join on terms, so no text is searched for each of them.
    """
    seen = shown.select("query_id", "chunk_id").join(terms, "chunk_id").select("query_id", F.explode("terms").alias("term")).distinct()
    named = asked.select("query_id", "ask_id", F.explode(F.array_distinct("terms")).alias("term"))
    good = named.join(seen, ["query_id", "term"], "left_semi").select("query_id", "ask_id").distinct()
    return asked.join(good, ["query_id", "ask_id"], "left_semi")


def follow_up_rounds(
    first: DataFrame, asked: DataFrame, terms: DataFrame, search: Callable[[DataFrame], DataFrame], rounds: int = FOLLOW_UP_ROUNDS
) -> DataFrame:
    """(query_id, round, ask_id, chunk_id, rank): evidence of a first search and of follow-up rounds.

    ``asked``: query_id, round, ask_id, terms, what would be asked next; only what is anchored in the evidence shown so far is
    searched for, and only new chunks count: the first ask's that finds one. A query goes on while its last round has
    shown something new. Each round is stored, so a later one doesn't search again, and so is what is asked in it, as a search
    takes its asks more than once.
    """
    shown = stored(first.select("query_id", F.lit(0).alias("round"), F.lit(None).cast("long").alias("ask_id"), "chunk_id", F.col("rank").cast("int").alias("rank")), "round-0")
    for n in range(1, rounds + 1):
        going = shown.where(F.col("round") == n - 1).select("query_id").distinct()
        now = anchored(asked.where(F.col("round") == n).join(going, "query_id", "left_semi"), shown, terms)
        found = search(stored(now.select("query_id", "ask_id", "terms"), f"asked-{n}")).join(shown.select("query_id", "chunk_id"), ["query_id", "chunk_id"], "left_anti")
        new = best_row(found, ["query_id", "chunk_id"], "rank", "ask_id").select("query_id", F.lit(n).alias("round"), "ask_id", "chunk_id", F.col("rank").cast("int").alias("rank"))
        shown = shown.unionByName(stored(new, f"round-{n}"))
    return shown
