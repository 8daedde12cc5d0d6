"""Evidence groups, table neighbours and the protected merge on literal rows."""

from pyspark.sql import functions as F

from lectern.operators import context

PLACE = ("modality", "path", "surface", "page")


def test_table_neighbours_need_no_known_border_between(spark):
    cases = [  # anchor, neighbour, whether they go together
        (("text", ["a"], "page", 1), ("table", ["a"], "page", 2), True),
        (("table", ["a"], "page", 1), ("table", [], "page", 1), True),
        (("text", [], "page", 3), ("table", ["b"], "page", 2), True),
        (("text", ["a"], "page", 1), ("table", ["b"], "page", 1), False),
        (("text", ["a"], "page", 1), ("table", ["a"], "page", 3), False),
        (("text", ["a"], "sheet", 1), ("table", ["a"], "sheet", 9), True),
        (("text", ["a"], "sheet", 1), ("table", ["a"], "page", 1), False),
        (("image", ["a"], "page", 1), ("table", ["a"], "page", 1), False),
        (("text", ["a"], "page", 1), ("text", ["a"], "page", 1), False),
        (("text", ["a"], "page", None), ("table", ["a"], "page", 1), False),
    ]
    kind = "struct<modality:string,path:array<string>,surface:string,page:int>"
    df = spark.createDataFrame([(i, a, b) for i, (a, b, _) in enumerate(cases)], f"i int, a {kind}, b {kind}")
    fits = context.compatible_table({c: F.col(f"a.{c}") for c in PLACE}, {c: F.col(f"b.{c}") for c in PLACE})
    assert [r[0] for r in df.orderBy("i").select(fits).collect()] == [c[2] for c in cases]


def test_a_chunk_stands_for_all_its_groups(spark):
    hits = spark.createDataFrame([(1, 10, "v1"), (1, 11, "v1"), (1, 12, "v2")], "query_id long, chunk_id long, version string")
    groups = spark.createDataFrame([(10, "g"), (10, "h"), (10, "h"), (12, "g")], "chunk_id long, group_key string")
    assert sorted((r.chunk_id, r.group_key) for r in context.in_groups(hits, groups).collect()) == [(10, "v1/g"), (10, "v1/h"), (11, "v1/11"), (12, "v2/g")]


def test_supplements_compete_behind_the_protected_half(spark):
    schema = "query_id long, chunk_id long, terms array<string>, distance double"
    core = spark.createDataFrame([(1, i, ["x", f"c{i}"], 0.1 * i) for i in range(1, 5)], schema)
    more = spark.createDataFrame([(1, 90, ["x", "y", "y"], 0.05), (1, 91, ["z"], 0.9)], schema)
    asks = spark.createDataFrame([(1, ["x", "y"]), (2, ["x"])], "query_id long, query_terms array<string>")
    rows = {r.chunk_id: r for r in context.with_source_context(asks, core, more, 4).collect()}
    assert [i for i, r in sorted(rows.items(), key=lambda x: x[1].rank)] == [1, 2, 90, 3]  # two of four are protected
    assert rows[90].score > rows[1].score and rows[90].supplement and not rows[1].supplement
    alone = {r.chunk_id: r.score for r in context.with_source_context(asks, core, more.limit(0), 4).collect()}
    assert all(alone[i] == r.score for i, r in rows.items() if not r.supplement)  # the core's scores stay


def test_of_equal_distances_the_first_kind(spark):
    rows = [(1, 5, "table_text", 0.2), (1, 5, "ocr_text", 0.2), (1, 5, "caption_text", 0.3), (1, 6, "unknown", 0.1), (1, 6, "text", 0.1)]
    best = context.best_representation(spark.createDataFrame(rows, "query_id long, chunk_id long, representation string, distance double"))
    assert {r.chunk_id: r.representation for r in best.collect()} == {5: "ocr_text", 6: "text"}
