"""Which pictures are shown with the evidence of an answer, and why not the others (T16, PF15).

Candidates compete by priority, and a picture, its file and its evidence group are shown once. As no more than four may be
shown, the greedy choice is four steps of a minimum a query, each against the marks of those before: no query's candidates are
gathered, and ties have one order.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.sources.steps import stored

# Relations that count, weights in millionths, the constant of ranks, and pictures shown at most.
STRONG = ("explicit_figure_reference", "caption_of", "inline_figure", "ocr_of", "table_of")
EXPLICIT, DUAL, RELATED, OWN_DUAL, OWN, BOTH_RANKS = 4_000_000, 3_250_000, 3_000_000, 2_000_000, 1_000_000, 250_000
RANK_CONSTANT, HARD_MOST = 60, 4


def priority_micros(weight: Column, text_rank: Column, cross_rank: Column) -> Column:
    """A relation's weight, a share for each rank, and a bonus for both."""
    share = lambda rank: F.coalesce(F.when(rank > 0, F.floor(F.lit(1_000_000) / (rank + RANK_CONSTANT))), F.lit(0))
    both = F.when(text_rank.isNotNull() & cross_rank.isNotNull(), BOTH_RANKS).otherwise(0)
    return (weight + share(text_rank) + share(cross_rank) + both).cast("long")


def _first(rank: Column) -> Column:
    """Ranks of 0 and null come after all others."""
    return F.coalesce(F.when(rank > 0, rank), F.lit(2**31)).cast("long")


def visual_rows(evidence: DataFrame, visuals: DataFrame) -> DataFrame:
    """All pictures beside evidence, in the order in which they are judged, with whether and how they compete.

    ``evidence``: query_id, rank, unit, version, modality, asset_id, checksum, group_key, text_rank, cross_rank, usable.
    ``visuals``, related to it: query_id, rank, nth, unit, asset_id, checksum, relation_type, group_key, text_rank, cross_rank.
    """
    parent = evidence.select("query_id", "rank", "version", "usable", F.col("text_rank").alias("own_rank"))
    near = visuals.join(parent, ["query_id", "rank"])
    text, cross, kind = F.coalesce(F.when(F.col("text_rank") > 0, F.col("text_rank")), F.col("own_rank")), F.col("cross_rank"), F.col("relation_type")
    strong, explicit = kind.isin(*STRONG), kind == "explicit_figure_reference"
    reason = F.when(explicit, "selected_explicit_reference").when(cross.isNotNull(), "selected_dual_lane").otherwise("selected_strong_relation")
    weight = F.when(explicit, EXPLICIT).when(cross.isNotNull(), DUAL).otherwise(RELATED)
    related = near.select(
        "query_id", "rank", F.col("nth").cast("long").alias("nth"), "unit", "asset_id", "checksum", F.concat_ws("/", F.col("version").cast("string"), "group_key").alias("group_key"), text.alias("text_rank"), "cross_rank",
        F.when(~F.col("usable"), "rejected_parent_not_admitted").when(~strong, "rejected_weak_relation").alias("barred"),
        (F.col("usable") & strong & (explicit | cross.isNotNull() | (F.col("rank") == 1))).alias("competes"), reason.alias("reason"), priority_micros(weight, text, cross).alias("priority_micros"),
    )
    own = evidence.where(F.col("modality").isin("image", "table") & F.col("asset_id").isNotNull())
    dual = F.col("text_rank").isNotNull() & cross.isNotNull()
    shown = own.select(
        "query_id", "rank", F.lit(1 << 40).alias("nth"), "unit", "asset_id", "checksum", F.concat_ws("/", F.col("version").cast("string"), F.coalesce("group_key", F.col("unit").cast("string"))).alias("group_key"), "text_rank", "cross_rank",
        F.when(~F.col("usable"), "rejected_low_similarity").alias("barred"), F.col("usable").alias("competes"),
        F.when(dual, "selected_dual_lane").otherwise("selected_image_only").alias("reason"), priority_micros(F.when(dual, OWN_DUAL).otherwise(OWN), F.col("text_rank"), cross).alias("priority_micros"),
    )
    return related.unionByName(shown)


def ranked_visuals(rows: DataFrame) -> DataFrame:
    """(query_id, place, asset_id, checksum, group_key, unit, reason, priority_micros): the first four that share nothing."""
    order = F.struct(-F.col("priority_micros"), _first(F.col("text_rank")), _first(F.col("cross_rank")), "unit", "asset_id", "rank", "nth")
    shown = F.struct("asset_id", "checksum", "group_key", "unit", "reason", "priority_micros")
    left, picks = rows.where("competes"), []
    for place in range(1, HARD_MOST + 1):
        free = left
        for pick in picks:  # a row a query each
            taken = pick.select("query_id", *[F.col(c).alias(f"{c}_") for c in ("asset_id", "checksum", "group_key")])
            clash = functools.reduce(Column.__or__, [F.col(c).eqNullSafe(F.col(f"{c}_")) for c in ("asset_id", "checksum", "group_key")])
            free = free.join(taken, "query_id").where(~clash).select(*left.columns)
        best = free.groupBy("query_id").agg(F.min_by(shown, order).alias("x")).select("query_id", F.lit(place).alias("place"), "x.*")
        picks.append(stored(best, f"picture-{place}"))
    return functools.reduce(DataFrame.unionByName, picks)


def visual_decisions(rows: DataFrame, most: int = 2) -> DataFrame:
    """(query_id, position, asset_id, unit, reason, priority_micros): a decision a picture, the first reason that holds (PF15).

    Pictures are judged in order of evidence and relation; a picture met before is a duplicate whatever was decided then.
    """
    if not 1 <= most <= HARD_MOST:
        raise ValueError(f"between one and {HARD_MOST} pictures are shown")
    picks = ranked_visuals(rows).select("query_id", "asset_id", "place", F.col("unit").alias("pick_unit"), F.col("reason").alias("pick_reason"), F.col("priority_micros").alias("pick_priority"))
    met = F.row_number().over(Window.partitionBy("query_id", "asset_id").orderBy("rank", "nth")) > 1
    position = F.row_number().over(Window.partitionBy("query_id").orderBy("rank", "nth"))
    judged = rows.withColumn("met", met).withColumn("position", position).join(picks, ["query_id", "asset_id"], "left")
    reason = (
        F.when(F.col("barred").isNotNull(), F.col("barred")).when(F.col("place").isNull() | F.col("met"), "rejected_duplicate")
        .when(F.col("place") > most, "rejected_visual_budget").otherwise(F.col("pick_reason"))
    )
    chosen = reason.startswith("selected")
    return judged.select("query_id", "position", "asset_id", F.when(chosen, F.col("pick_unit")).otherwise(F.col("unit")).alias("unit"), reason.alias("reason"), F.coalesce("pick_priority", F.lit(0)).cast("long").alias("priority_micros"))
