"""Follow-up rounds: anchors, new evidence only, and when a query stops."""

from pyspark.sql import functions as F

from lectern.operators import lanes

CORPUS = {1: ["apple", "tree"], 2: ["apple", "pie"], 3: ["pie", "oven"], 4: ["oven", "steel"], 5: ["moon"]}


def run(spark, first, asked, rounds=2):
    chunks = spark.createDataFrame(list(CORPUS.items()), "chunk_id long, terms array<string>")

    def search(now):
        hits = []
        for r in now.collect():
            found = sorted(i for i, t in CORPUS.items() if set(t) & set(r.terms))
            hits += [(r.query_id, r.ask_id, i, n + 1) for n, i in enumerate(found[:3])]
        return spark.createDataFrame(hits, "query_id long, ask_id long, chunk_id long, rank int")

    one = spark.createDataFrame(first, "query_id long, chunk_id long, rank int")
    more = spark.createDataFrame(asked, "query_id long, round int, ask_id long, terms array<string>")
    return sorted((r.query_id, r.round, r.ask_id, r.chunk_id) for r in lanes.follow_up_rounds(one, more, chunks, search, rounds).collect() if r.round)


def test_follow_ups_are_anchored_in_what_was_shown(spark):
    first = [(1, 1, 1), (2, 1, 1)]
    asked = [
        (1, 1, 10, ["apple", "pie"]),  # anchored by apple: shows 2 and 3, not 1 again
        (1, 1, 11, ["moon"]),  # not anchored
        (1, 2, 12, ["oven"]),  # anchored by what the first round showed: 4 is new
        (2, 1, 20, ["moon"]),  # not anchored, so nothing is new and the query stops
        (2, 2, 21, ["apple", "pie"]),
    ]
    assert run(spark, first, asked) == [(1, 1, 10, 2), (1, 1, 10, 3), (1, 2, 12, 4)]
    assert run(spark, first, asked, rounds=1) == [(1, 1, 10, 2), (1, 1, 10, 3)]


def test_a_chunk_is_shown_once_a_query(spark):
    asked = [(1, 1, 10, ["apple"]), (1, 1, 11, ["pie", "apple"]), (1, 2, 12, ["tree", "apple"])]
    assert run(spark, [(1, 1, 1)], asked) == [(1, 1, 10, 2), (1, 1, 11, 3)]


def test_asks_of_a_round_are_made_once(spark):
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in CORPUS.items()], "chunk_id long, text string")
    terms = docs.select("chunk_id", F.split("text", " ").alias("terms"))
    one = spark.createDataFrame([(1, 1, 1)], "query_id long, chunk_id long, rank int")
    more = spark.createDataFrame([(1, 1, 10, ["apple"]), (1, 2, 11, ["pie"])], "query_id long, round int, ask_id long, terms array<string>")
    plans = []

    def search(now):
        plans.append(now._jdf.queryExecution().optimizedPlan().toString())
        return now.select("query_id", "ask_id", F.lit(2).cast("long").alias("chunk_id"), F.lit(1).alias("rank"))

    assert lanes.follow_up_rounds(one, more, terms, search).count() == 2
    assert len(plans) == 2 and not any("Join" in p for p in plans)  # read back, not made again at each use
