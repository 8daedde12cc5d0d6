"""Queries take all of their rows, and bootstraps their fixed numbers of draws."""

import numpy as np
import pytest
from conftest import SF

from lectern.operators import evaluation
from lectern.plans import registry

registry.load()


@pytest.mark.parametrize(("name", "table", "key"), [("page_cursors", "orders", "o_orderkey"), ("question_checks", "documents", "chunk_id")])
def test_one_row_for_each_of_the_table(spark, name, table, key):
    got = [r[0] for r in registry.QUERIES[name](spark, SF).select(key).collect()]
    rows = spark.read.parquet(f"{SF}/{table}.parquet")
    assert sorted(got) == sorted(r[0] for r in rows.select("o_orderkey" if table == "orders" else "doc_id").collect())


@pytest.mark.parametrize(("name", "operator", "draws"), [("bootstrap_interval", "cluster_bootstrap", 10_000), ("projected_cost", "projected_total", 5_000)])
def test_draws(spark, monkeypatch, name, operator, draws):
    done, asked = getattr(evaluation, operator), []

    def spy(*args, **named):
        out = done(*args, **named)
        asked.append(named.get("draws", done.__defaults__[0]))
        return out

    monkeypatch.setattr(evaluation, operator, spy)
    assert registry.QUERIES[name](spark, SF).count() > 0
    assert asked == [draws]


def test_projection_from_counts_of_costs(spark):
    """The total is exact, and the interval that of resampled cases; cases without a cost are left out."""
    costs = {"a": [float(i % 7) for i in range(400)], "b": [3.0] * 50, "c": [float(i * i) for i in range(90)]}
    rows = spark.createDataFrame([(s, i, c) for s, part in costs.items() for i, c in enumerate(part)] + [("a", 999, None)], "stratum string, case_id int, cost double")
    (got,) = evaluation.projected_total(rows, {"a": 1000, "b": 10, "c": 20}).collect()
    rng, runs = np.random.default_rng(1), np.zeros(5_000)
    for s, n in (("a", 1000), ("b", 10), ("c", 20)):
        part = np.array(costs[s])
        runs += part[rng.integers(0, len(part), (5_000, len(part)))].mean(axis=1) * n
    assert got.total == pytest.approx(sum(np.mean(costs[s]) * n for s, n in (("a", 1000), ("b", 10), ("c", 20))))
    low, high = np.quantile(runs, [0.025, 0.975])
    assert got.low == pytest.approx(low, rel=0.01) and got.high == pytest.approx(high, rel=0.01)
    (fixed,) = evaluation.projected_total(rows.where("stratum = 'b'"), {"b": 10}).collect()
    assert fixed.total == fixed.low == fixed.high == 30.0
    assert evaluation.projected_total(rows.where("stratum = 'none'"), {"b": 10}).count() == 0
