"""Greedy selections over a query's bounded pool: diversity, packing under budgets, fair shares, visual candidates.

Each choice depends on those before it, so a query's pool (bounded by the lanes, some hundred rows) goes to one group
function; queries run in parallel.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame

# diversity's weight and its hard limit, chunks of paths, characters of a reply and of a chunk's overhead.
MMR_LAMBDA, MAX_SIMILARITY = 0.75, 0.45
PATH_SOFT, PATH_HARD, FAIR_CHARS, FAIR_OVERHEAD = 12, 16, 96_000, 256


def _similarity(a: frozenset, b: frozenset) -> float:
    return len(a & b) / len(a | b) if a and b else 0.0


def mmr(pool: DataFrame, k: int, drop_similar: bool = True, weight: float = MMR_LAMBDA) -> DataFrame:
    """(query_id, chunk_id, rank): maximal marginal relevance (T9; without dropping: T10).

    ``pool``: query_id, chunk_id, score, terms. A pick too similar to one before it is dropped. Ties go to the higher
    score, then the smaller id.
    """

    def choose(frame: pd.DataFrame) -> pd.DataFrame:
        left = [(r.chunk_id, r.score, frozenset(r.terms)) for r in frame.itertuples()]
        closest = [0.0] * len(left)  # similarity to the nearest pick, kept up to date
        picked: list = []
        while left and len(picked) < k:
            value = lambda i: weight * left[i][1] - (1 - weight) * closest[i] if picked else left[i][1]
            best = max(range(len(left)), key=lambda i: (value(i), left[i][1], -left[i][0]))
            item, near = left.pop(best), closest.pop(best)
            if drop_similar and picked and near >= MAX_SIMILARITY:
                continue
            picked.append(item)
            closest = [max(c, _similarity(x[2], item[2])) for c, x in zip(closest, left)]
        return pd.DataFrame({"query_id": frame["query_id"].iloc[0], "chunk_id": [p[0] for p in picked], "rank": range(1, len(picked) + 1)})

    return pool.select("query_id", "chunk_id", "score", "terms").groupBy("query_id").applyInPandas(choose, "query_id long, chunk_id long, rank int")


def packed(items: DataFrame, most_items: int, most_tokens: int) -> DataFrame:
    """(query_id, item, place): whole items in order under both budgets; one that doesn't fit is skipped."""

    def choose(frame: pd.DataFrame) -> pd.DataFrame:
        out, used = [], 0
        for r in frame.sort_values(["rank", "item"]).itertuples():
            if len(out) == most_items:
                break
            if used + r.tokens <= most_tokens:
                out.append(r.item)
                used += r.tokens
        return pd.DataFrame({"query_id": frame["query_id"].iloc[0], "item": out, "place": range(1, len(out) + 1)})

    return items.select("query_id", "item", "rank", "tokens").groupBy("query_id").applyInPandas(choose, "query_id long, item long, place int")


def packed_paths(paths: DataFrame, soft: int = PATH_SOFT, hard: int = PATH_HARD) -> DataFrame:
    """(query_id, path_id, chunk_id, place): whole paths in order of rank while they fit the hard limit; a path that
    would pass it is skipped, and ends the choice once the soft target is reached; shared chunks count once (T14).
    ``paths``: query_id, path_id, rank, chunks."""

    def choose(frame: pd.DataFrame) -> pd.DataFrame:
        places: dict = {}
        out = []
        for r in frame.sort_values(["rank", "path_id"]).itertuples():
            new = [c for c in dict.fromkeys(r.chunks) if c not in places]
            if len(places) + len(new) <= hard:
                for c in new:
                    places[c] = len(places) + 1
                    out.append((r.path_id, c, places[c]))
            elif len(places) >= soft:
                break
        rows = pd.DataFrame(out, columns=["path_id", "chunk_id", "place"])
        rows.insert(0, "query_id", frame["query_id"].iloc[0])
        return rows

    return paths.select("query_id", "path_id", "rank", "chunks").groupBy("query_id").applyInPandas(choose, "query_id long, path_id string, chunk_id long, place int")


def fair_shares(chunks: DataFrame, allowance: int = FAIR_CHARS) -> DataFrame:
    """(query_id, group_id, unit): whole units taken from the groups in turn while they fit the allowance.

    ``chunks``: query_id, group_id, unit, chunk_id, chars, sent, a row a chunk of a unit. A chunk costs its characters and
    an overhead, or nothing if it was sent before or is in a unit already taken. A unit that doesn't fit is left out, and
    its group goes on with the next one.
    """

    def choose(frame: pd.DataFrame) -> pd.DataFrame:
        have = set(frame.loc[frame["sent"].astype(bool), "chunk_id"])
        turns = frame[["group_id", "unit"]].drop_duplicates().sort_values(["group_id", "unit"])
        turns = turns.assign(turn=turns.groupby("group_id").cumcount()).sort_values(["turn", "group_id"])
        content = {key: list(zip(rows["chunk_id"], rows["chars"])) for key, rows in frame.groupby(["group_id", "unit"])}
        out, left = [], allowance
        for g, u in zip(turns["group_id"], turns["unit"]):
            cost = sum(chars + FAIR_OVERHEAD for c, chars in content[g, u] if c not in have)
            if cost <= left:
                left -= cost
                have.update(c for c, _ in content[g, u])
                out.append((g, u))
        rows = pd.DataFrame(out, columns=["group_id", "unit"])
        rows.insert(0, "query_id", frame["query_id"].iloc[0])
        return rows

    rows = chunks.select("query_id", "group_id", "unit", "chunk_id", "chars", "sent")
    return rows.groupBy("query_id").applyInPandas(choose, "query_id long, group_id long, unit long")


def visual_candidates(candidates: DataFrame, most: int, least_similarity: float = 0.25) -> DataFrame:
    """``candidates`` with a decision each (T16, PF15): selected, or the first reason against it.

    In order of priority (millionths), similarity and id; an asset, a checksum or an evidence group is shown once.
    ``candidates``: query_id, asset_id, checksum, group_key, priority, similarity, parent_admitted, relation_strong.
    """

    def choose(frame: pd.DataFrame) -> pd.DataFrame:
        rows = frame.sort_values(["priority", "similarity", "asset_id"], ascending=[False, False, True])
        seen: set = set()
        decisions, taken = [], 0
        for r in rows.itertuples():
            marks = {("asset", r.asset_id), ("checksum", r.checksum), ("group", r.group_key)}
            if not r.parent_admitted:
                decision = "parent_not_admitted"
            elif not r.relation_strong:
                decision = "weak_relation"
            elif marks & seen:
                decision = "duplicate"
            elif r.similarity < least_similarity:
                decision = "low_similarity"
            elif taken == most:
                decision = "budget"
            else:
                decision, taken = "selected", taken + 1
                seen |= marks
            decisions.append(decision)
        return rows.assign(decision=decisions)[["query_id", "asset_id", "decision"]]

    return candidates.groupBy("query_id").applyInPandas(choose, "query_id long, asset_id long, decision string")
