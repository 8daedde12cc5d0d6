"""What a query passes on inside must not grow with pairs: no step of its plan gives more rows than its input accounts for."""

import pytest
from conftest import SF

from lectern.plans import registry

registry.load()


def most_rows(df):
    """The greatest number of rows that a step of the plan gave, after ``df`` has run once."""
    plan = df._jdf.queryExecution().executedPlan()
    df._jdf.collectToPython()

    def walk(node):
        kind = node.getClass().getSimpleName()
        if kind == "AdaptiveSparkPlanExec":
            return walk(node.executedPlan())
        if kind.endswith("QueryStageExec"):
            return walk(node.plan())
        told = [node.metrics().get(m) for m in ("numOutputRows", "pythonNumRowsReceived")]
        mine = [m.get().value() for m in told if m.isDefined()]
        below = node.children()
        return max([0, *mine, *[walk(below.apply(i)) for i in range(below.size())]])

    return walk(plan)


def count(spark, name):
    return spark.read.parquet(f"{SF}/{name}.parquet").count()


def test_supports_are_found_once_a_key(spark):
    parts, edges = count(spark, "part"), count(spark, "supplier") + count(spark, "nation")
    found = most_rows(registry.QUERIES["graph_hydrate"](spark, SF))
    assert 0 < found <= max(parts, 8 * edges) < parts * edges // 40


def test_units_are_cut_once_and_chunks_need_no_frame_a_document(spark):
    plan = registry.QUERIES["semantic_chunks"](spark, SF)._jdf.queryExecution().toString()
    assert "MapInPandas" not in plan and "FlatMapGroups" not in plan


def vector_pairs(spark):
    return count(spark, "embeddings") * spark.read.parquet(f"{SF}/embeddings.parquet").where("vec_id % 50 = 0").count()


#: Queries over vectors, and the part of all pairs that a step may give at most: the rows of the result, where these are pairs.
PARTS = {
    "rrf_weighted": 8,
    "dual_quota_union": 8,
    "protected_head": 8,
    "vector_group_best": 8,
    "best_window": 3,
    "round_robin_views": 8,
    "rrf_two_lane": 8,
    "policy_grid": 8,
    "lane_merge": 3,
    "representation_ties": 3,
}


@pytest.mark.parametrize("name", PARTS)
def test_pairs_of_vectors_are_no_rows(name, spark):
    found = most_rows(registry.QUERIES[name](spark, SF))
    assert 0 < found <= vector_pairs(spark) // PARTS[name] + count(spark, "embeddings")
