"""Evaluation: hit rates, evidence sets, paired changes, gates, percentiles, bootstraps, samples."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.functions import text as tx

# The bootstraps' seed and draws.
SEED, DRAWS, PROJECTION_DRAWS = 20260905, 10_000, 5_000


def rank_metrics(ranks: DataFrame, *group: str) -> DataFrame:
    """Cases, hit@1, hit@10 and MRR@10 (E1, AG14). ``rank`` is null where nothing was found."""
    rank = F.col("rank")
    return ranks.groupBy(*group).agg(
        F.count("*").alias("cases"), F.round(F.avg(F.coalesce(rank <= 1, F.lit(False)).cast("double")), 9).alias("hit_1"),
        F.round(F.avg(F.coalesce(rank <= 10, F.lit(False)).cast("double")), 9).alias("hit_10"),
        F.round(F.avg(F.when(rank <= 10, 1 / rank).otherwise(0.0)), 9).alias("mrr_10"),
    )


def evidence_found(cases: DataFrame) -> DataFrame:
    """``cases`` (case_id, found, paths: array of arrays) with any_found, complete and fraction: the best over the
    alternative paths, which are sets (E2, SO5)."""
    share = F.transform("paths", lambda p: F.when(F.size(p) > 0, F.size(F.array_intersect(p, F.col("found"))) / F.size(F.array_distinct(p))).otherwise(1.0))
    rows = cases.withColumn("fraction", F.round(F.coalesce(F.array_max(share), F.lit(0.0)), 9))
    return rows.withColumn("any_found", F.exists("paths", lambda p: F.arrays_overlap(p, F.col("found")))).withColumn("complete", F.exists("paths", lambda p: F.size(F.array_except(p, F.col("found"))) == 0))


def paired_changes(before: DataFrame, after: DataFrame) -> DataFrame:
    """One row: cases gained and lost, as counts and sorted lists (J20, E3). Both: (case_id, hit)."""
    both = before.select("case_id", F.col("hit").alias("b")).join(after.select("case_id", F.col("hit").alias("a")), "case_id", "full_outer")
    b, a = F.coalesce("b", F.lit(False)), F.coalesce("a", F.lit(False))
    return both.agg(
        F.count_if(a & ~b).alias("gained"), F.count_if(b & ~a).alias("lost"),
        F.sort_array(F.collect_list(F.when(a & ~b, F.col("case_id")))).alias("gained_cases"), F.sort_array(F.collect_list(F.when(b & ~a, F.col("case_id")))).alias("lost_cases"),
    )


def rank_changes(before: DataFrame, after: DataFrame) -> DataFrame:
    """(case_id, change): improved, worsened, same; not found is worse than any rank."""
    far = F.lit(1 << 30)
    both = before.select("case_id", F.coalesce("rank", far).alias("b")).join(after.select("case_id", F.coalesce("rank", far).alias("a")), "case_id")
    return both.select("case_id", F.when(F.col("a") < F.col("b"), "improved").when(F.col("a") > F.col("b"), "worsened").otherwise("same").alias("change"))


def gate(metrics: DataFrame, baseline: DataFrame, names: list[str], slack: float = 0.0) -> DataFrame:
    """(metric, baseline, value, passed): no metric may fall below its baseline by more than ``slack``."""
    stack = lambda df, out: df.select(F.explode(F.map_from_arrays(F.array(*[F.lit(n) for n in names]), F.array(*[F.col(n).cast("double") for n in names]))).alias("metric", out))
    return stack(metrics, "value").join(stack(baseline, "baseline"), "metric").withColumn("passed", F.col("value") >= F.col("baseline") - slack)


def probes_complete(probes: DataFrame, found: DataFrame) -> DataFrame:
    """(probe_id, complete, missing): the chunks a probe requires against those in its top k (E5)."""
    got = found.groupBy("probe_id").agg(F.collect_set("chunk_id").alias("got"))
    rows = probes.join(got, "probe_id", "left").withColumn("missing", F.array_sort(F.array_except("required", F.coalesce("got", F.expr("cast(array() as array<long>)")))))
    return rows.select("probe_id", (F.size("missing") == 0).alias("complete"), "missing")


def evidence_matches(kind: Column, page: Column, first: Column, last: Column, quote: Column, text: Column, section: Column, path: Column) -> Column:
    """Whether a chunk is gold evidence, by the kind of its locator."""
    flat = tx.folded_spaces
    return F.coalesce(
        F.when(kind == "pdf_pages", (page >= first) & (page <= last))
        .when(kind == "text_spans", (F.instr(flat(text), flat(quote)) > 0) | (tx.word_overlap(quote, text) >= 0.6))
        .when(kind == "markdown_sections", F.instr(flat(path), flat(section)) > 0)
        .otherwise(kind == "absence"),
        F.lit(False),
    )


def aspect_scores(aspects: DataFrame) -> DataFrame:
    """(case_id, strict, partial, grounded, accuracy) from (case_id, correct, cited)."""
    return aspects.groupBy("case_id").agg(
        F.bool_and("correct").alias("strict"), F.bool_or("correct").alias("partial"),
        F.bool_and(F.col("correct") & F.col("cited")).alias("grounded"), F.round(F.avg(F.col("correct").cast("double")), 9).alias("accuracy"),
    )


def number_in_answer(answer: Column, expected: Column, tolerance: Column) -> Column:
    """A number of the answer lies within a tolerance of the expected one; commas and percent signs are read over."""
    numbers = F.transform(F.regexp_extract_all(F.regexp_replace(answer, r"(?<=[0-9]),(?=[0-9]{3})", ""), F.lit(r"-?[0-9]+(?:\.[0-9]+)?"), F.lit(0)), lambda x: x.cast("decimal(38,10)"))
    return F.exists(numbers, lambda x: F.abs(x - expected) <= tolerance)


def variant_in_answer(answer: Column, variants: Column) -> Column:
    return F.exists(variants, lambda v: F.instr(tx.folded_spaces(answer), tx.folded_spaces(v)) > 0)


def passages(sentences: DataFrame) -> DataFrame:
    """(doc_key, sentence, char_start, char_end): offsets of sentences in their joined document, which is named by the
    hash of its text and kept once (E9). ``sentences``: (title, sentence, text)."""
    text = F.transform(F.sort_array(F.collect_list(F.struct("sentence", "text"))), lambda x: x["text"])
    docs = sentences.groupBy("title").agg(text.alias("parts")).withColumn("doc_key", F.sha2(F.array_join("parts", ""), 256)).dropDuplicates(["doc_key"])
    rows = docs.select("doc_key", F.posexplode("parts").alias("sentence", "text"))
    w = Window.partitionBy("doc_key").orderBy("sentence").rowsBetween(Window.unboundedPreceding, 0)
    end = F.sum(F.length("text")).over(w)
    return rows.select("doc_key", "sentence", (end - F.length("text")).alias("char_start"), end.alias("char_end"))


def stratified(rows: DataFrame, key: str, stratum: str, share: float, seed: int = SEED) -> DataFrame:
    """A proportional sample: the first rows of each stratum by a hash of key and seed, rounded up."""
    w = Window.partitionBy(stratum)
    nth = F.row_number().over(w.orderBy(F.xxhash64(key, F.lit(seed)), key))
    return rows.withColumn("n_", F.count("*").over(w)).withColumn("nth_", nth).where(F.col("nth_") <= F.ceil(F.col("n_") * share)).drop("n_", "nth_")


def required_recall(cases: DataFrame) -> DataFrame:
    """``cases`` (case_id, required, found) with the share of required documents found."""
    hit = F.size(F.array_intersect("required", "found"))
    return cases.select("case_id", F.round(F.when(F.size(F.array_distinct("required")) > 0, hit / F.size(F.array_distinct("required"))).otherwise(1.0), 9).alias("recall"))


def percentiles(values: DataFrame, column: str, *group: str) -> DataFrame:
    """Median, and the nearest-rank 95th percentile with its index rounded half to even (AG15).

    Ranks come from a window and not from a gathered list, so a group may be of any size.
    """
    w = Window.partitionBy(*group)
    rows = values.where(F.col(column).isNotNull()).select(*group, F.col(column).alias("v_"))
    rows = rows.withColumn("i_", F.row_number().over(w.orderBy("v_")) - 1).withColumn("n_", F.count("*").over(w))
    at = F.bround(0.95 * (F.col("n_") - 1)).cast("int")
    low, high = F.floor((F.col("n_") - 1) / 2), F.floor(F.col("n_") / 2)
    return rows.groupBy(*group).agg(F.max("n_").alias("n"), F.avg(F.when((F.col("i_") == low) | (F.col("i_") == high), F.col("v_"))).alias("p50"), F.max(F.when(F.col("i_") == at, F.col("v_"))).alias("p95"))


def cluster_bootstrap(rows: DataFrame, draws: int = DRAWS, seed: int = SEED) -> DataFrame:
    """(arm, mean, low, high): mean difference with a 95 % interval; whole clusters are drawn (AG17).

    ``rows``: arm, cluster, difference. Clusters are summed in Spark; only sums, one a cluster, are resampled.
    """
    sums = rows.groupBy("arm", "cluster").agg(F.sum("difference").alias("s"), F.count("*").alias("n"))

    def draw(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("cluster")
        s, n = frame["s"].to_numpy(dtype=float), frame["n"].to_numpy(dtype=float)
        rng = np.random.default_rng(seed)
        means = []
        for _ in range(draws):
            pick = rng.integers(0, len(s), len(s))
            means.append(s[pick].sum() / n[pick].sum())
        low, high = np.quantile(means, [0.025, 0.975])
        return pd.DataFrame({"arm": [frame["arm"].iloc[0]], "mean": [s.sum() / n.sum()], "low": [low], "high": [high]})

    return sums.groupBy("arm").applyInPandas(draw, "arm string, mean double, low double, high double")


def projected_total(rows: DataFrame, targets: dict[str, int], draws: int = PROJECTION_DRAWS, seed: int = SEED) -> DataFrame:
    """(total, low, high): a pilot's cost carried on to ``targets`` cases a stratum, with a 95 % interval (AG18).

    A resample's mean depends only on how often each distinct cost is drawn, so Spark counts the cases by stratum and
    cost, and the draws are multinomial over those counts: the one task holds distinct costs, not cases. Cases without a
    cost are left out; no case at all gives no row.
    """
    counts = rows.where("cost IS NOT NULL").groupBy("stratum", F.col("cost").cast("double").alias("cost")).agg(F.count("*").alias("n"))

    def draw(frame: pd.DataFrame) -> pd.DataFrame:
        rng = np.random.default_rng(seed)
        total, runs = 0.0, np.zeros(draws)
        for stratum, part in sorted(frame.groupby("stratum")):
            part = part.sort_values("cost")
            cost, n = part["cost"].to_numpy(dtype=float), part["n"].to_numpy()
            cases, target = int(n.sum()), targets.get(stratum, 0)
            total += float(cost @ n) / cases * target
            step = max(1, (1 << 22) // len(cost))  # draws at a time, of bounded memory
            means = [rng.multinomial(cases, n / cases, min(step, draws - k)) @ cost / cases for k in range(0, draws, step)]
            runs += np.concatenate(means) * target
        low, high = np.quantile(runs, [0.025, 0.975])
        return pd.DataFrame({"total": [total], "low": [low], "high": [high]})

    return counts.withColumn("all_", F.lit(1)).groupBy("all_").applyInPandas(draw, "total double, low double, high double")


def pooled_vectors(windows: DataFrame, key: str = "chunk_id") -> DataFrame:
    """(key, embedding): windows' vectors averaged by weight and normalised (AG11)."""
    parts = windows.select(key, "weight", F.posexplode("embedding").alias("i", "x"))
    means = parts.groupBy(key, "i").agg((F.sum(F.col("x") * F.col("weight")) / F.sum("weight")).alias("x"))
    rows = means.groupBy(key).agg(F.transform(F.sort_array(F.collect_list(F.struct("i", "x"))), lambda s: s["x"]).alias("v"))
    size = F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x))
    return rows.select(key, F.transform("v", lambda x: F.round(x / size, 9)).alias("embedding"))
