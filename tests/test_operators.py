"""Operators on small literal rows: branches that the driver's tables don't reach."""

import io
import random
import zipfile

import pytest
from pyspark.sql import functions as F

from lectern.functions import text as tx
from lectern.functions import values as vl
from lectern.functions import vectors as vc
from lectern.operators import chunking, conversation, evaluation, graph, lanes, lifecycle, pruned, ranking, scope, selection
from lectern.sources import admission, blocks, sinks
from lectern.streaming import jobs


@pytest.mark.parametrize(
    ("text", "expected"),
    [
        ("The state-of-the-art of A/B", ["state_of_the_art", "state", "art", "a_b", "b"]),
        ("Straße ÉCOLE école", ["strasse", "école"]),
        ("数据库 ok 库", ["数据", "据库", "ok", "库"]),
        ("v1.2.3 v1", ["v1_2_3", "v1", "2", "3"]),
        ("", []),
    ],
)
def test_lexemes(text, expected):
    assert tx.lexemes_of(text, 100) == expected


def test_lexeme_limit():
    assert len(tx.lexemes_of(" ".join(f"w{i}" for i in range(100)), 64)) == 64


def test_vectors(spark):
    df = spark.createDataFrame([([1.0, 0.0], [0.0, 1.0]), ([1.0, 0.0], [2.0, 0.0]), ([0.0, 0.0], [1.0, 0.0])], "a array<double>, b array<double>")
    assert [r[0] for r in df.select(vc.cosine_distance(F.col("a"), F.col("b"))).collect()] == [1.0, 0.0, None]
    assert df.select(vc.sigmoid(F.lit(-800.0))).first()[0] == 0.0


def test_ties_go_to_the_smaller_id_and_copies_do_not_crowd_out(spark):
    axis = lambda k: [1.0 if i == k else 0.0 for i in range(8)]
    vectors = spark.createDataFrame([(i, axis(0)) for i in range(5, 0, -1)] + [(9, axis(1))], "chunk_id long, embedding array<double>")
    asks = spark.createDataFrame([(100, axis(0))], "query_id long, query array<double>")
    rows = lanes.vector_lane(asks, vectors, 3).orderBy("rank").collect()
    assert [(r.chunk_id, r.distance) for r in rows] == [(1, 0.0), (2, 0.0), (3, 0.0)]


def test_questions_add_but_do_not_displace(spark):
    source = spark.createDataFrame([(1, c, c / 10) for c in range(1, 6)], "query_id long, chunk_id long, distance double")
    questions = spark.createDataFrame([(1, 5, 0, 0.01, 0.5), (1, 5, 1, 0.01, 0.5), (1, 1, 0, 0.9, 0.1)], "query_id long, chunk_id long, question_ordinal long, distance double, source_distance double")
    rows = lanes.dual_quota(source, questions, 3, 1).orderBy("rank").collect()
    assert [(r.chunk_id, r.source_distance) for r in rows] == [(1, 0.1), (2, 0.2), (3, 0.3), (5, 0.5)]
    assert rows[-1].question_distance == 0.01 and rows[-1].question_ordinal == 0


def test_manifest_gap(spark):
    a = spark.createDataFrame([(1,), (2,)], "target_id long")
    assert not lanes.manifest_status(a, a.limit(1)).first().complete
    assert lanes.manifest_status(a, a).first().complete


def test_serving_scope(spark):
    kb = spark.createDataFrame([(1, 10, None), (2, 20, "x")], "kb_id long, active_revision_id long, deleted_at string")
    rev = spark.createDataFrame([(10, "active"), (20, "active"), (11, "active")], "revision_id long, status string")
    rows = [(100, 1, 10, 1, 5, "ready", "serving"), (101, 1, 11, 1, 5, "ready", "serving"), (102, 1, 10, 2, 5, "ready", "serving"), (103, 1, 10, 1, 6, "ready", "serving"), (104, 1, 10, 1, 5, "staged", "candidate"), (105, 2, 20, 1, 5, "ready", "serving")]
    targets = spark.createDataFrame(rows, "target_id long, kb_id long, revision_id long, document_id long, version_id long, build_status string, serving_status string")
    docs = spark.createDataFrame([(1, None), (2, "gone")], "document_id long, deleted_at string")
    versions = spark.createDataFrame([(5, "available"), (6, "withdrawn")], "version_id long, status string")
    chunks = spark.createDataFrame([(t, c, None if c else "x") for t in range(100, 106) for c in (0, 1)], "target_id long, chunk_id long, excluded_at string")
    assert [(r.target_id, r.chunk_id) for r in scope.serving_scope(kb, rev, targets, docs, versions, chunks).collect()] == [(100, 1)]


def test_mmr_drops_near_repeats(spark):
    pool = spark.createDataFrame([(1, 1, 0.9, ["a", "b", "c"]), (1, 2, 0.89, ["a", "b", "c", "d"]), (1, 3, 0.5, ["x", "y"]), (1, 4, 0.5, ["x", "z", "q"])], "query_id long, chunk_id long, score double, terms array<string>")
    assert [r.chunk_id for r in selection.mmr(pool, 3).orderBy("rank").collect()] == [1, 3, 4]
    assert [r.chunk_id for r in selection.mmr(pool, 2, drop_similar=False).orderBy("rank").collect()][0] == 1


def test_packing_skips_what_does_not_fit(spark):
    items = spark.createDataFrame([(1, i, i, t) for i, t in enumerate([50, 70, 40, 10])], "query_id long, item long, rank int, tokens long")
    assert [r.item for r in selection.packed(items, 3, 100).orderBy("place").collect()] == [0, 2, 3]
    paths = spark.createDataFrame([(1, "a", 1, list(range(10))), (1, "b", 2, list(range(5, 15))), (1, "c", 3, [1, 2, 30]), (1, "d", 4, [40])], "query_id long, path_id string, rank int, chunks array<long>")
    rows = selection.packed_paths(paths).collect()
    assert [(r.path_id, r.chunk_id) for r in sorted(rows, key=lambda r: r.place)][10:] == [("b", 10), ("b", 11), ("b", 12), ("b", 13), ("b", 14), ("c", 30)]
    # a path that would pass the limit is skipped below the soft target, and ends the choice from there on
    paths = spark.createDataFrame([(1, "a", 1, list(range(8))), (1, "b", 2, list(range(20, 30))), (1, "c", 3, list(range(30, 36))), (1, "d", 4, [50, 51, 52]), (1, "e", 5, [60])], "query_id long, path_id string, rank int, chunks array<long>")
    assert {r.path_id for r in selection.packed_paths(paths).collect()} == {"a", "c"}


def test_fair_shares_and_visual_candidates(spark):
    schema = "query_id long, group_id long, unit long, chunk_id long, chars long, sent boolean"
    units = [(1, g, u, 10 * g + u, 44, False) for g in (1, 2) for u in range(3)]
    taken = lambda rows, allowance: [(r.group_id, r.unit) for r in selection.fair_shares(spark.createDataFrame(rows, schema), allowance).collect()]
    assert taken(units, 900) == [(1, 0), (2, 0), (1, 1)]
    # a unit that doesn't fit is left out and its group goes on; what was sent, or is taken already, costs nothing
    units = [(1, 1, 0, 1, 1000, False), (1, 1, 1, 2, 44, False), (1, 1, 2, 3, 900, True), (1, 2, 0, 4, 44, False), (1, 2, 1, 2, 44, False), (1, 2, 1, 4, 44, False)]
    assert taken(units, 600) == [(2, 0), (1, 1), (2, 1), (1, 2)]
    rows = [(1, 1, "c1", "g1", 9, 0.9, True, True), (1, 2, "c1", "g2", 8, 0.9, True, True), (1, 3, "c3", "g3", 7, 0.1, True, True), (1, 4, "c4", "g4", 6, 0.9, False, True), (1, 5, "c5", "g5", 5, 0.9, True, False), (1, 6, "c6", "g6", 4, 0.9, True, True), (1, 7, "c7", "g7", 3, 0.9, True, True)]
    found = selection.visual_candidates(spark.createDataFrame(rows, "query_id long, asset_id long, checksum string, group_key string, priority long, similarity double, parent_admitted boolean, relation_strong boolean"), 2)
    assert {r.asset_id: r.decision for r in found.collect()} == {1: "selected", 2: "duplicate", 3: "low_similarity", 4: "parent_not_admitted", 5: "weak_relation", 6: "selected", 7: "budget"}


def test_paths_without_loops(spark):
    edges = spark.createDataFrame([(1, "a", "b", 1), (2, "b", "c", 2), (3, "c", "a", 3), (4, "a", "a", 4), (5, "a", "b", 5)], "edge_id long, source string, target string, rank long")
    seeds = spark.createDataFrame([(1, "a")], "query_id long, entry string")
    found = {tuple(r.edges) for r in graph.paths(seeds, edges).collect()}
    assert ("4",) not in found and ("1", "5") not in found
    assert ("1", "2") in found and ("3", "2") in found and len(found) == 6


def test_structural_and_semantic_chunks(spark):
    assert chunking.choose_boundaries([100] * 5, [None] * 5) == []
    cuts = chunking.choose_boundaries([200] * 6, [0, 0, 900000, 0, 0, None])
    assert cuts == [2]
    assert chunking.choose_boundaries([700, 700, 100], [None] * 3) == [0, 1] or chunking.choose_boundaries([700, 700, 100], [None] * 3) == [0]
    text = "One. Two! " * 200
    assert "".join(chunking.split_units(text)) == text
    assert max(chunking.tokens(u) for u in chunking.split_units("word " * 1000)) <= chunking.UNIT_MAX
    table = ["| a | b |", "|---|---|"] + [f"| {i} | x |" for i in range(100)]
    parts = chunking.split_table(table, 100)
    assert all(p.startswith("| a | b |\n|---|---|") for p in parts)
    assert sum(p.count("\n") - 1 for p in parts) == 100
    windows = chunking.token_windows(" ".join(map(str, range(2000))), 800, 100)
    assert windows[1].split()[0] == "700" and windows[-1].split()[-1] == "1999"
    folded = chunking.fold_blocks([("heading", "A", "A"), ("text", "A", "hello"), ("table", "A", "| x |"), ("heading", "B", "B")])
    assert folded == [("A", "A\nhello"), ("A", "| x |"), ("A", "B")]


def test_only_cuts_between_sections_are_merged():
    cuts = [(0, "table"), (1, "section"), (2, "section")]
    assert chunking.merge_sections([100, 100, 500, 100], cuts) == [(0, "table")]
    assert chunking.merge_sections([100, 500, 100], [(0, "table"), (1, "block")]) == [(0, "table"), (1, "block")]
    # the next one first, the one before if that doesn't fit, and again after a merge
    assert chunking.merge_sections([300, 100, 750], [(0, "section"), (1, "section")]) == [(1, "section")]
    assert chunking.merge_sections([100, 100, 100, 700], [(0, "section"), (1, "section"), (2, "section")]) == [(2, "section")]
    # merging comes after the choice: a region that was cut keeps its semantic cuts
    sizes, reasons = [300, 300, 100], [None, None, "section"]
    assert chunking.span_cuts(sizes, [9, 0, 0], reasons) == []
    # one score is its own threshold, so this cut has no gain and is for size
    assert chunking.span_cuts([400, 500, 100], [900000, 0, 0], reasons) == [(0, "max_tokens")]
    assert chunking.span_cuts([400, 500, 100], [900000, 0, 0], [None, None, "table"]) == [(0, "max_tokens"), (1, "table")]


def brute_boundaries(sizes, scores):
    """All ways to cut, by the rules of the choice; ties settled step by step as a table over ends would."""
    n = len(sizes)
    limit = chunking._threshold([x for x in scores[: n - 1] if x is not None])
    best = {0: (0, 0, ())}
    for end in range(1, n + 1):
        options = []
        for start in range(end):
            size = sum(sizes[start:end])
            if start in best and chunking.CHUNK_MIN <= size <= chunking.CHUNK_MAX:
                gain = max(0, scores[end - 1] - limit) if end < n and scores[end - 1] is not None else 0
                miss = abs(size - chunking.CHUNK_TARGET)
                reward, chunks, cuts = best[start]
                options.append((-(reward + gain - chunking._half_up(miss * chunking.SIZE_WEIGHT, chunking.CHUNK_TARGET)), miss, chunks + 1, cuts + ((end - 1,) if end < n else ())))
        if options:
            o = min(options)
            best[end] = (-o[0], o[2], o[3])
    return list(best[n][2]) if n in best else None


def test_boundaries_against_all_ways():
    rng = random.Random(8)
    for _ in range(200):
        sizes = [rng.choice([40, 80, 110, 160]) for _ in range(rng.randint(6, 24))]
        scores = [rng.choice([None, 0, 100_000, 400_000, 900_000]) for _ in sizes]
        if sum(sizes) > chunking.CHUNK_MAX and (expected := brute_boundaries(sizes, scores)) is not None:
            assert chunking.choose_boundaries(sizes, scores) == expected


def test_common_prefix(spark):
    df = spark.createDataFrame([([["a", "b", "c"], ["a", "b"], ["a", "b", "d"]],), ([["x"], ["y"]],), ([["q", "r"]],)], "p array<array<string>>")
    assert [r[0] for r in df.select(chunking.common_prefix(F.col("p"))).collect()] == [["a", "b"], [], ["q", "r"]]


def test_life_cycle(spark):
    import datetime

    now = F.lit(datetime.datetime(2024, 1, 1, 12)).cast("timestamp")
    t = lambda s: datetime.datetime(2024, 1, 1, 11, 59, s)
    rows = [(1, "running", 1, None, t(0), 1.0, datetime.datetime(2024, 1, 1, 11)), (2, "running", 3, None, t(0), 1.0, datetime.datetime(2024, 1, 1, 11)), (3, "running", 1, None, t(0), 1.0, t(50)), (4, "completed", 1, None, t(0), 1.0, None)]
    df = spark.createDataFrame(rows, "job_id long, status string, attempt int, next_attempt_at timestamp, created_at timestamp, size double, heartbeat_at timestamp")
    assert {r.job_id: r.status for r in lifecycle.reconciled(df, now).collect()} == {1: "retry_wait", 2: "failed", 3: "running", 4: "completed"}
    targets = spark.createDataFrame([(1, 7, "serving"), (2, 7, "candidate"), (3, 8, "serving")], "target_id long, document_id long, serving_status string")
    done = lifecycle.served(targets, spark.createDataFrame([(2, "serving")], "target_id long, decision string"))
    assert {r.target_id: r.serving_status for r in done.collect()} == {1: "retired", 2: "serving", 3: "serving"}
    slices = spark.createDataFrame([(3, t(55))], "job_id long, slice_end timestamp")
    assert {r.job_id: (r.status, r.attempt) for r in lifecycle.continued(df, slices).collect()}[3] == ("queued", 1)


def test_sinks(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a"), (2, "b")], "k long, v string")
    at = str(tmp_path / "x.jsonl")
    sinks.write_jsonl(rows, at)
    assert sorted(map(tuple, sinks.read_jsonl(spark, at, "k long, v string").collect())) == [(1, "a"), (2, "b")]
    sinks.write_segments(rows, str(tmp_path / "s"), "k")
    sinks.write_segments(rows, str(tmp_path / "s"), "k")
    assert spark.read.parquet(str(tmp_path / "s")).count() == 2
    found = spark.createDataFrame([("a", bytearray(b"x")), ("b", bytearray(b"x"))], "path string, content binary")
    stored = sinks.store_immutable(found, str(tmp_path / "f"))
    assert stored.select("sha256").distinct().count() == 1
    assert spark.read.parquet(str(tmp_path / "f")).count() == 1


def test_admission(spark, tmp_path):
    zipped = io.BytesIO()
    with zipfile.ZipFile(zipped, "w") as z:
        z.writestr("a.md", "# hi")
        z.writestr("../b.md", "no")
    book = io.BytesIO()
    with zipfile.ZipFile(book, "w") as z:
        z.writestr("xl/workbook.xml", '<workbook xmlns="n"><sheets><sheet name="S"/></sheets></workbook>')
        z.writestr("xl/worksheets/sheet1.xml", '<worksheet xmlns="n"><c/><c/></worksheet>')
    for name, content in {"a.txt": "﻿x\r\ny".encode(), "b.txt": b"\xff\xfe", "c.exe": b"1", "e.mdz": zipped.getvalue(), "f.xlsx": book.getvalue(), "g.csv": b"a;b\n1;2\n"}.items():
        (tmp_path / name).write_bytes(content)
    found = admission.files(spark, str(tmp_path))
    rows = {r.path.rsplit("/", 1)[1]: r for r in admission.admitted(found).collect()}
    assert rows["a.txt"].text == "x\ny" and rows["a.txt"].reject is None
    assert [rows[n].reject for n in ("b.txt", "c.exe")] == ["invalid_utf8", "unsupported_type"]
    entries = {r.entry: r.reject for r in admission.bundle_entries(found.where("path like '%.mdz'")).collect()}
    assert entries == {"a.md": None, "../b.md": "unsafe_path"}
    assert [(r.sheet, r.cells) for r in admission.workbook_sheets(found.where("path like '%.xlsx'")).collect()] == [("S", 2)]
    shape = admission.admitted(found.where("path like '%.csv'")).select(admission.csv_shape("text").alias("s")).first().s
    assert (shape.delimiter, shape.rows, shape.columns) == (";", 2, 2)


def test_blocks():
    html = "<html><head><title>t</title></head><body><nav>n</nav><h2>Head</h2><p>a <b>bold</b> c</p><table><tr><td>1</td><td>2</td></tr></table><ul><li>x</li></ul><img src='i.png' alt='pic'></body></html>"
    assert blocks.html_rows(html) == [("heading", 2, "Head", None), ("text", 0, "a bold c", None), ("table_row", 0, "1 | 2", None), ("list_item", 0, "x", None), ("image", 0, "pic", "i.png")]
    md = "# T\n\npara ![p](u.png) more\n| a | b |\n|---|---|\n| 1 | 2 |\n- x"
    assert [r[0] for r in blocks.markdown_rows(md)] == ["heading", "image", "text", "table_row", "table_row", "list_item"]


def test_cursor_round_trip(spark):
    df = spark.createDataFrame([(1, "ü?>"), (22, "b")], "k long, v string")
    back = df.withColumn("c", vl.cursor("k", "v")).select("*", vl.read_cursor(F.col("c"), "k long, v string").alias("x"))
    assert all((r.k, r.v) == tuple(r.x) and "=" not in r.c and "+" not in r.c for r in back.collect())


def test_bootstrap_keeps_clusters_together(spark):
    rows = spark.createDataFrame([("x", c, 1.0 if c % 2 else -1.0) for c in range(10) for _ in range(5)], "arm string, cluster long, difference double")
    r = evaluation.cluster_bootstrap(rows, draws=500).first()
    assert r["mean"] == 0 and r.low < -0.3 and r.high > 0.3


def test_frozen_statistics_keep_core_scores(spark):
    asks = spark.createDataFrame([(1, ["a", "b"])], "query_id long, query_terms array<string>")
    core = [(1, 1, ["a", "c"]), (1, 2, ["b", "b", "d"])]
    pool = spark.createDataFrame(core, "query_id long, chunk_id long, terms array<string>")
    more = spark.createDataFrame(core + [(1, 3, ["a", "b"])], "query_id long, chunk_id long, terms array<string>")
    one = {r.chunk_id: r.lexical_score for r in ranking.bm25_in_pool(asks, pool).collect()}
    two = {r.chunk_id: r.lexical_score for r in ranking.bm25_in_pool(asks, more, pool).collect()}
    assert {k: two[k] for k in one} == one and 3 in two


def test_citations(spark):
    answers = spark.createDataFrame([(1, "x [ev_2, ev_1] y [ev_7]")], "answer_id int, text string")
    known = spark.createDataFrame([(1, "ev_1"), (1, "ev_2")], "answer_id int, ref string")
    numbered = conversation.citations(answers, known)
    assert conversation.rendered(answers, numbered).first().text == "x [1][2] y "
    # brackets, separators and cases that an answer may use
    answers = spark.createDataFrame([(1, "a（ev_2；EV_1）b【 ev_1 】c [ev_2、ev_9] (Ev_1, ev_2) (even) ［ev_9］.")], "answer_id int, text string")
    numbered = conversation.citations(answers, known)
    assert {r.ref: r.number for r in numbered.collect()} == {"ev_2": 1, "ev_1": 2}
    assert conversation.rendered(answers, numbered).first().text == "a[1][2]b[2]c [1] [2][1] (even) ."


def test_fusion_shows_the_best_first_hit_of_a_lane(spark):
    hits = [
        (1, "dense_text", 1, 10, "g", "t", "text", 0.5, "r"), (1, "dense_text", 2, 11, "g", "t", "text", 0.1, "q"),  # a later hit never represents
        (1, "lexical", 1, 12, "g", "t", "image", 0.2, "r"), (1, "dense_text", 3, 13, "h", "", "text", 0.1, "r"), (1, "lexical", 2, 14, "h", "t", "table", 0.9, "r"),
    ]
    df = spark.createDataFrame(hits, "query_id long, lane string, rank int, chunk_id long, group_key string, text string, modality string, distance double, representation string")
    out = {r.group_key: r for r in ranking.weighted_rrf(df, {"dense_text": 1_000_000, "lexical": 700_000}, 5).collect()}
    assert (out["g"].chunk_id, out["g"].representations, out["g"].rank) == (10, ["q", "r"], 1)
    assert out["h"].chunk_id == 14 and out["g"].score == round(1 / 61 + 0.7 / 61, 12)
    # scores that differ beyond the 12 places shown are no tie: 1/(60+r) sums for ranks far out
    many = [(1, lane, rank, c, f"g{c}", "t", "text", 0.1, "r") for c, (lane, rank) in enumerate([("dense_text", 2_000_000), ("dense_text", 2_000_001)])]
    order = ranking.weighted_rrf(spark.createDataFrame(many[::-1], df.schema), {"dense_text": 1_000_000, "lexical": 700_000}, 5).orderBy("rank").collect()
    assert [r.group_key for r in order] == ["g0", "g1"] and order[0].score == order[1].score


def test_cuts_without_a_gain_are_for_size():
    assert {why for _, why in chunking.span_cuts([400] * 6, [0] * 6, [None] * 6)} == {"max_tokens"}
    assert {why for _, why in chunking.span_cuts([700, 700, 100], [None] * 3, [None] * 3)} == {"max_tokens"}
    assert chunking.span_cuts([200] * 6, [0, 0, 900_000, 0, 0, None], [None] * 6) == [(2, "semantic")]


def test_seeds_without_a_path_have_their_places_all_the_same(spark):
    rows = [(1, f"s{i}", i, ["e"], [1], 0, 1, f"p{i}", True, False, False) for i in (1, 3, 4, 5, 6, 7, 8, 9)]  # of nine seeds the second has no path
    df = spark.createDataFrame(rows, "query_id long, entry string, seed_place int, edges array<string>, ranks array<long>, reversals int, hops int, path_id string, seed boolean, chain boolean, explicit boolean")
    assert {r.path_id for r in graph.ranked_paths(df).where("tier = 0").collect()} == {"p1", "p3", "p4", "p5", "p6", "p7", "p8"}


def test_seeds_keep_a_path_each(spark):
    def rows(chain, explicit, seed):
        found = [("a", 1, ["1"], [5], 0), ("a", 1, ["1", "2"], [5, 6], 0), ("b", 2, ["3"], [9], 0), ("b", 2, ["3", "4", "5"], [9, 1, 1], 1)]
        return spark.createDataFrame([(1, e, place, edges, ranks, rev, len(edges), f"{e}{len(edges)}", seed, chain, explicit) for e, place, edges, ranks, rev in found],
            "query_id long, entry string, seed_place int, edges array<string>, ranks array<long>, reversals int, hops int, path_id string, seed boolean, chain boolean, explicit boolean")

    reserved = lambda *flags: [r.path_id for r in graph.ranked_paths(rows(*flags)).where("tier = 0").orderBy("rank").collect()]
    assert reserved(True, True, True) == ["a2", "b3"]  # an explicit chain: the first by the full key, long ones first
    assert reserved(True, False, True) == ["a1", "b1"]  # an inferred one: the cheapest direct fact
    assert reserved(True, True, False) == ["b3", "a2"]  # nothing grounded: entries by their first path
    assert reserved(False, False, True) == ["a1", "b1"]


def test_entities_written_in_other_ways(spark):
    names = ["Open Data Platform (ODP)", "某某基金会", "Müller", "X", None, "蓝天服务有限公司"]
    df = spark.createDataFrame([(n,) for n in names], "n string").select(tx.surface_variants("n").alias("v"))
    assert [r.v for r in df.collect()] == [["opendataplatformodp", "odpo", "odp"], ["某某基金会", "某某"], ["müller", "ml"], [], None, ["蓝天服务有限公司", "蓝天服务", "蓝天服务有限"]]


@pytest.mark.parametrize(("text", "expected"), [
    ("0x10/2", "syntax"), ("1e99999", "syntax"), ("9" * 65, "syntax"), ("1/0", "division_by_zero"), ("0/0", "numeric_limit"), ("+".join(["1"] * 40), "too_complex"),
    ("a+1", "unsupported_ast"), ("True", "unsupported_ast"), ("1 if 1 else 2", "unsupported_ast"), ("1" + " " * 600, "expression_too_long"), (" ", "expression_empty"),
    ("1" * 64 + "*" + "1" * 64, None), ("*".join(["9" * 60] * 6), "numeric_limit"),
])
def test_calculator_bounds(text, expected):
    assert vl.calculate(text)[1] == expected


def test_csv_that_cannot_be_read(spark):
    texts = ["a,b\n1,2\n", "a;b\n1;2\n3;4", "x:y\n1:2", "plain", "", 'a,"b\n' + "x" * 200_000, "," * 1100]
    got = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", admission.csv_shape("t").alias("s")).select("i", "s.*").orderBy("i").collect()
    assert [r.reject for r in got] == [None] * 5 + ["csv_structure", "too_many_columns"]
    assert [(r.delimiter, r.rows, r.columns) for r in got[:4]] == [(",", 2, 2), (";", 3, 2), (":", 2, 2), (",", 1, 1)]


def test_immutable_store_keeps_what_it_holds(spark, tmp_path):
    at = tmp_path.as_uri() + "/store"
    one = spark.createDataFrame([("a", b"x"), ("b", b"y"), ("c", b"x")], "path string, content binary")
    sinks.store_immutable(one, at).collect()
    files = {f: f.stat().st_mtime_ns for f in (tmp_path / "store").rglob("*.parquet")}
    sinks.store_immutable(spark.createDataFrame([("d", b"x"), ("e", b"z")], "path string, content binary"), at).collect()
    assert {f: f.stat().st_mtime_ns for f in files} == files
    stored = sinks.read_immutable(spark, at).collect()
    assert sorted(bytes(r.content) for r in stored) == [b"x", b"y", b"z"] and all(r.intact for r in stored)


def test_segments_resume(spark, tmp_path):
    at = tmp_path.as_uri() + "/segments"
    sinks.write_segments(spark.range(10).selectExpr("id", "id % 2 as part"), at, "part")
    sinks.write_segments(spark.range(100).selectExpr("id", "id % 3 as part"), at, "part")  # only part 2 is missing
    got = spark.read.parquet(*[f"{at}/part={p}" for p in range(3)]).count()
    assert got == 10 + 33


def test_unclosed_parts_end_where_content_begins():
    parse = blocks.html_rows
    html = "<html><head><title>t</title><body><nav><a>menu</a><main><p>kept</p></main><footer>foot</body></html><p>after</p>"
    assert [r[2] for r in parse(html)] == ["kept", "after"]
    assert [r[2] for r in parse("<div><nav><ul><li>x</div><p>text</p>")] == ["text"]


def test_batches_of_any_size_are_answered(spark, monkeypatch):
    rows = [(i, [float(i % 7) + 1, float(i % 5)]) for i in range(60)]
    vectors = spark.createDataFrame(rows, "chunk_id long, embedding array<double>")
    asks = vectors.select(F.col("chunk_id").alias("query_id"), F.col("embedding").alias("query"))
    whole = sorted(map(tuple, lanes.distances(asks, vectors).collect()))
    monkeypatch.setattr(pruned, "BLOCK_QUERIES", 7)
    assert sorted(map(tuple, lanes.distances(asks, vectors).collect())) == whole and len(whole) == 60 * 59


def test_progress_that_is_too_large_is_named(spark, tmp_path):
    schema = "run_id long, seq long, payload string"
    spark.createDataFrame([(1, 1, "a"), (1, 2, "b"), (2, 1, "x" * 5000), (3, 1, None)], schema).coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
    query = jobs.rate_limited(stream, (tmp_path / "out").as_uri(), str(tmp_path / "cp")).start()
    try:
        query.processAllAvailable()
    finally:
        query.stop()
    got = {r.run_id: (r.payload, r.seq, r.oversized) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == {1: ("b", 2, False), 2: (None, 1, True), 3: (None, 1, False)}
