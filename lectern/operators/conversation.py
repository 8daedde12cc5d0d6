"""Conversations: turn pairs, context under a budget, evidence references, citations, compaction."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.sources.tables import token_count

# Turns and tokens of context, rounds kept whole, characters of an excerpt.
MAX_TURNS, MAX_TOKENS, KEPT_ROUNDS, EXCERPT = 6, 4000, 3, 800


def turn_pairs(messages: DataFrame) -> DataFrame:
    """(conv_id, turn, question, answer): each user turn with the assistant turn right after it."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    rows = messages.withColumn("next_role", F.lead("role").over(w)).withColumn("answer", F.lead("text").over(w))
    return rows.where("role = 'user' and next_role = 'assistant'").select("conv_id", "turn", F.col("text").alias("question"), "answer")


def context_window(pairs: DataFrame, most_turns: int = MAX_TURNS, most_tokens: int = MAX_TOKENS) -> DataFrame:
    """The newest pairs that fit the budgets, newest first until the first that doesn't fit."""
    rows = pairs.withColumn("tokens", token_count(F.col("question")) + token_count(F.col("answer")))
    newest = Window.partitionBy("conv_id").orderBy(F.desc("turn"))
    rows = rows.withColumn("nth", F.row_number().over(newest)).withColumn("used", F.sum("tokens").over(newest.rowsBetween(Window.unboundedPreceding, 0)))
    return rows.where((F.col("nth") <= most_turns) & (F.col("used") <= most_tokens)).select("conv_id", "turn", "tokens", "used")


def evidence_refs(seen: DataFrame) -> DataFrame:
    """(run_id, chunk_id, ref): ``ev_N`` in the order in which chunks were first seen (SV3)."""
    first = seen.groupBy("run_id", "chunk_id").agg(F.min(F.struct("round", "place")).alias("at"))
    n = F.row_number().over(Window.partitionBy("run_id").orderBy("at", "chunk_id"))
    return first.select("run_id", "chunk_id", F.concat(F.lit("ev_"), n.cast("string")).alias("ref"))


# How an answer names evidence.
_OPEN, _CLOSE, _BETWEEN = r"[\[［【(（]", r"[\]］】)）]", r"\s*[,，;；、]\s*"
_GROUP = rf"(?i){_OPEN}\s*ev_[0-9]+(?:{_BETWEEN}ev_[0-9]+)*\s*{_CLOSE}"


def _refs(group: Column) -> Column:
    return F.transform(F.regexp_extract_all(group, F.lit("(?i)ev_[0-9]+"), F.lit(0)), F.lower)


def citations(answers: DataFrame, known: DataFrame) -> DataFrame:
    """(answer_id, ref, number): references an answer uses, numbered by first use; unknown ones are left out."""
    groups = F.regexp_extract_all("text", F.lit(_GROUP), F.lit(0))
    refs = answers.select("answer_id", F.posexplode(F.flatten(F.transform(groups, _refs))).alias("at", "ref"))
    used = refs.join(known.select("answer_id", "ref"), ["answer_id", "ref"], "left_semi").groupBy("answer_id", "ref").agg(F.min("at").alias("at"))
    return used.select("answer_id", "ref", F.row_number().over(Window.partitionBy("answer_id").orderBy("at")).alias("number"))


def rendered(answers: DataFrame, numbered: DataFrame) -> DataFrame:
    """(answer_id, text): citation groups as ``[1][2]``; groups without a known reference vanish."""
    maps = numbered.groupBy("answer_id").agg(F.map_from_entries(F.collect_list(F.struct("ref", "number"))).alias("numbers"))
    rows = answers.join(maps, "answer_id", "left").withColumn("numbers", F.coalesce("numbers", F.expr("cast(map() as map<string,int>)")))
    parts, groups = F.split("text", _GROUP, -1), F.regexp_extract_all("text", F.lit(_GROUP), F.lit(0))

    def shown(g):
        found = F.transform(_refs(g), lambda r: F.try_element_at(F.col("numbers"), r))
        return F.array_join(F.transform(F.array_distinct(F.filter(found, lambda n: n.isNotNull())), lambda n: F.concat(F.lit("["), n.cast("string"), F.lit("]"))), "")

    body = F.array_join(F.zip_with(parts, F.transform(groups, shown), lambda a, b: F.concat(a, F.coalesce(b, F.lit("")))), "")
    return rows.select("answer_id", body.alias("text"))


def compacted(messages: DataFrame, kept: int = KEPT_ROUNDS, excerpt: int = EXCERPT) -> DataFrame:
    """``messages`` with older turns cut to an excerpt; the last ones stay whole (SV2)."""
    age = F.row_number().over(Window.partitionBy("conv_id").orderBy(F.desc("turn")))
    return messages.withColumn("text", F.when(age > kept, F.left("text", F.lit(excerpt))).otherwise(F.col("text")))


def usage(attempts: DataFrame) -> DataFrame:
    """(run_id, prompt_tokens, completion_tokens, attempts): totals over a run's attempts (AG19)."""
    return attempts.groupBy("run_id").agg(F.sum("prompt_tokens").alias("prompt_tokens"), F.sum("completion_tokens").alias("completion_tokens"), F.count("*").alias("attempts"))
