"""Paths of evidence are sets, and no case is left out."""

from conftest import SF

from lectern.operators import evaluation
from lectern.plans import registry

registry.load()


def test_paths_that_repeat_an_element(spark):
    rows = [(1, [5], [[5, 5]]), (2, [1, 5], [[1, 2, 2, 3]]), (3, [7], [[5, 5], [7, 8]]), (4, [7], [[5, 5]])]
    cases = spark.createDataFrame(rows, "case_id long, found array<long>, paths array<array<long>>")
    got = {r.case_id: r.fraction for r in evaluation.evidence_found(cases).collect()}
    assert got == {1: 1.0, 2: round(1 / 3, 9), 3: 0.5, 4: 0.0}


def test_all_cases(spark):
    users = {r[0] for r in spark.read.parquet(f"{SF}/events.parquet").select("user_id").distinct().collect()}
    assert any(u % 20 == 5 for u in users)
    assert {r.case_id for r in registry.QUERIES["evidence_complete"](spark, SF).select("case_id").collect()} == users
