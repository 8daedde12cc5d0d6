"""Quality classifier: a sparse rule ensemble that compiles to Spark column expressions.

1. Statistics of each whole text are Spark columns (``statistics``).
2. Small regression trees are boosted on a bounded sample of labelled rows; each path from a root to a node is a rule,
   a conjunction of threshold tests on statistics.
3. A lasso-penalised logistic regression over the rules keeps few of them; its weights are calibrated log-odds.
4. ``Ensemble.score`` turns the kept rules into one column expression, so scoring needs no Python at all.

Defined results: null text counts as empty; empty texts get the score of their (zero) statistics; without labelled rows
or with one class only, the score is the smoothed share of label 1 (0.5 without rows). Repeated rows get equal scores.
"""

from __future__ import annotations

import json
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.llm.shared import BLANK, fresh, let, release

#: Labelled rows used to fit, at most: the bound of the training sample.
SAMPLE_ROWS = 8000
TREES, DEPTH, LEAST_LEAF, BINS, RATE = 48, 3, 12, 32, 0.3
#: Score from which a text is predicted to be of quality.
THRESHOLD = 0.7

STATISTICS = (
    "log_words", "word_length", "symbol_share", "pipe_share", "exclaim_share", "upper_share", "digit_share", "distinct_share",
    "repeat_share", "dup_line_share", "line_words", "stop_share", "other_share",
)


def statistics(text: Column) -> Column:
    """A struct of statistics of a whole text."""
    body = F.coalesce(text, F.lit(""))
    trimmed = F.btrim(body, F.lit(" \t\n\u000b\f\r"))

    def count(pattern: str) -> Column:
        return F.length(F.regexp_replace(body, pattern, "")).cast("double")

    def less(char: str) -> Column:
        return (F.length(body) - F.length(F.replace(body, F.lit(char), F.lit("")))).cast("double")

    def of_words(words: Column) -> Column:
        n = F.when(F.length(trimmed) == 0, 0.0).otherwise(F.size(words).cast("double"))
        per = F.greatest(n, F.lit(1.0))
        letters = F.greatest(count(r"[^\p{L}]+"), F.lit(1.0))
        chars = F.greatest(F.length(body).cast("double"), F.lit(1.0))
        lines = F.split(body, "\n")
        # a word equal to the one before it
        repeats = F.size(F.filter(F.sequence(F.lit(1), F.size(words) - 1), lambda i: F.get(words, i) == F.get(words, i - 1)))
        repeats = F.when(F.size(words) > 1, repeats.cast("double")).otherwise(0.0)
        return F.struct(
            F.log1p(n).alias("log_words"),
            (letters / per).alias("word_length"),
            (count(r"[^#*$%&<>]+") / chars).alias("symbol_share"),
            (less("|") / per).alias("pipe_share"),
            (less("!") / per).alias("exclaim_share"),
            (count(r"[^\p{Lu}]+") / letters).alias("upper_share"),
            (count(r"[^0-9]+") / chars).alias("digit_share"),
            (F.size(F.array_distinct(words)).cast("double") / per).alias("distinct_share"),
            (repeats / per).alias("repeat_share"),
            (1.0 - F.size(F.array_distinct(lines)) / F.size(lines)).alias("dup_line_share"),
            (n / F.size(lines)).alias("line_words"),
            (less(".") / per).alias("stop_share"),
            (count(r"[\p{L}0-9#*$%&<>|!.,\x20\x09-\x0D]+") / chars).alias("other_share"),
        )

    return let(F.split(trimmed, BLANK + "+"), of_words)


@dataclass
class Ensemble:
    """Rules are tuples of (statistic, "<=" or ">", threshold); weights are log-odds."""

    intercept: float
    rules: list[tuple[tuple[str, str, float], ...]]
    weights: list[float]

    def logit(self, stats: Column) -> Column:
        total = F.lit(float(self.intercept))
        for rule, weight in zip(self.rules, self.weights):
            fits = F.lit(True)
            for name, sign, edge in rule:
                value = stats[name]
                fits = fits & (value <= edge if sign == "<=" else value > edge)
            total = total + F.when(fits, float(weight)).otherwise(0.0)
        return total

    def score(self, stats: Column) -> Column:
        return 1.0 / (1.0 + F.exp(-self.logit(stats)))

    def decide(self, rows: np.ndarray) -> np.ndarray:
        """Scores of rows of statistics outside Spark, for tests."""
        z = np.full(len(rows), self.intercept)
        for rule, weight in zip(self.rules, self.weights):
            z += weight * _holds(rule, rows)
        return 1 / (1 + np.exp(-z))

    def dump(self) -> str:
        return json.dumps([self.intercept, self.rules, self.weights])


def _holds(rule, x: np.ndarray) -> np.ndarray:
    out = np.ones(len(x), dtype=bool)
    for name, sign, edge in rule:
        v = x[:, STATISTICS.index(name)]
        out &= v <= edge if sign == "<=" else v > edge
    return out


def _tree(x: np.ndarray, edges: list[np.ndarray], gradient: np.ndarray, hessian: np.ndarray, rules: list) -> None:
    """Grows one tree and appends the conjunction of each of its nodes but the root."""

    def grow(rows: np.ndarray, path: tuple) -> None:
        if path:
            rules.append(path)
        g, h = gradient[rows].sum(), hessian[rows].sum()
        best = None
        if len(path) < DEPTH:
            for k, cuts in enumerate(edges):
                v = x[rows, k]
                for cut in cuts:
                    left = v <= cut
                    n = int(left.sum())
                    if n < LEAST_LEAF or len(rows) - n < LEAST_LEAF:
                        continue
                    gl, hl = gradient[rows[left]].sum(), hessian[rows[left]].sum()
                    gain = gl * gl / (hl + 1) + (g - gl) ** 2 / (h - hl + 1) - g * g / (h + 1)
                    if gain > 1e-6 and (best is None or gain > best[0]):
                        best = (gain, k, float(cut), left)
        if best is None:
            return
        _, k, cut, left = best
        grow(rows[left], (*path, (STATISTICS[k], "<=", cut)))
        grow(rows[~left], (*path, (STATISTICS[k], ">", cut)))

    grow(np.arange(len(x)), ())


def _lasso(r: np.ndarray, y: np.ndarray, penalty: float, steps: int = 600) -> tuple[float, np.ndarray]:
    """Logistic regression with an L1 penalty on all but the intercept, by accelerated proximal gradient."""
    n, m = r.shape
    scale = np.maximum(r.std(axis=0), 0.05)
    z = np.ones((n, m + 1), dtype=np.float32)
    np.divide(r, scale, out=z[:, 1:], casting="unsafe")
    top = np.ones(m + 1)
    for _ in range(30):  # the largest singular value, for the step
        top = z.T @ (z @ top)
        size = np.linalg.norm(top)
        top /= size
    step = 3.8 * n / max(size, 1e-9)
    w = v = np.zeros(m + 1)
    t = 1.0
    shrink = np.full(m + 1, penalty * step)
    shrink[0] = 0
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(z @ v, -30, 30)))
        u = v - step * (z.T @ (p - y)) / n
        after = np.sign(u) * np.maximum(np.abs(u) - shrink, 0)
        t2 = (1 + np.sqrt(1 + 4 * t * t)) / 2
        v = after + (t - 1) / t2 * (after - w)
        w, t = after, t2
    return float(w[0]), w[1:] / scale


def fit_rows(x: np.ndarray, y: np.ndarray) -> Ensemble:
    """Fits on rows of statistics and labels 0 and 1."""
    share = (y.sum() + 1) / (len(y) + 2)
    if len(set(y.tolist())) < 2 or len(y) < 4 * LEAST_LEAF:
        return Ensemble(float(np.log(share / (1 - share))), [], [])
    edges = [np.unique(np.quantile(x[:, k], np.linspace(0, 1, BINS + 1)[1:-1])) for k in range(x.shape[1])]
    logit = np.full(len(y), np.log(share / (1 - share)))
    paths: list = []
    for _ in range(TREES):
        p = 1 / (1 + np.exp(-logit))
        found: list = []
        _tree(x, edges, y - p, p * (1 - p), found)
        deep = [r for r in found if not any(o[: len(r)] == r and len(o) > len(r) for o in found)]
        for r in deep:
            at = _holds(r, x)
            logit[at] += RATE * (y - p)[at].sum() / ((p * (1 - p))[at].sum() + 1)
        paths += found
    distinct: dict[bytes, tuple] = {}
    for r in dict.fromkeys(paths):  # rules that hold for the same rows are one rule
        distinct.setdefault(_holds(r, x).tobytes(), r)
    rules = list(distinct.values())
    matrix = np.stack([_holds(r, x) for r in rules], axis=1).astype(np.float32)
    check = np.arange(len(y)) % 5 == 0
    best = None
    for penalty in (0.01, 0.003, 0.001, 0.0003):
        b, w = _lasso(matrix[~check], y[~check], penalty, 250)
        p = np.clip(1 / (1 + np.exp(-(b + matrix[check] @ w))), 1e-6, 1 - 1e-6)
        loss = -np.mean(y[check] * np.log(p) + (1 - y[check]) * np.log(1 - p))
        if best is None or loss < best[0] - 1e-4:
            best = (loss, penalty)
    b, w = _lasso(matrix, y, best[1])
    kept = np.flatnonzero(np.abs(w) > 1e-3)
    return Ensemble(b, [rules[k] for k in kept], [float(w[k]) for k in kept])


def fit(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS) -> Ensemble:
    """Fits on at most ``rows`` of ``labels`` (doc_id, quality), drawn by a hash of the id, and their texts in ``docs``."""
    drawn = (
        labels.select("doc_id", F.col("quality").cast("double").alias("y_")).where("doc_id is not null and y_ in (0, 1)")
        .groupBy("doc_id").agg(F.max("y_").alias("y_")).orderBy(F.xxhash64("doc_id", F.lit(29)), "doc_id").limit(rows)
    )
    stats = (
        docs.select("doc_id", "text").join(F.broadcast(drawn), "doc_id")  # at most ``rows`` rows of two numbers
        .select("doc_id", "y_", statistics(F.col("text")).alias("s")).select("doc_id", "y_", "s.*").limit(2 * rows).toPandas()
    )
    stats = stats.sort_values(["doc_id", *STATISTICS]).drop_duplicates("doc_id")
    model = fit_rows(stats[list(STATISTICS)].to_numpy(dtype=np.float64), stats["y_"].to_numpy(dtype=np.float64))
    release()
    return model


def score(docs: DataFrame, model: Ensemble, text: str = "text", out: str = "quality_score") -> DataFrame:
    """``docs`` with the score added (in place of a column of that name)."""
    kept = [F.col(f"`{c}`") for c in docs.columns if c.lower() != out.lower()]
    name = fresh(docs, "stats_of_text")
    return docs.select(*kept, statistics(F.col(f"`{text}`")).alias(name)).select(*kept, model.score(F.col(name)).alias(out))
