"""Evaluation analytics over benchmark, labels and events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lectern.functions import text as tx
from lectern.operators import evaluation, ranking
from lectern.plans.registry import query
from lectern.sources.tables import table, values

#: Ranks of cases before and after a change, invented from the labels.
_RANKS = """
    ranks AS (SELECT doc_id AS case_id, CASE WHEN doc_id % 5 <> 0 THEN doc_id % 13 + 1 END AS before_, CASE WHEN doc_id % 4 <> 0 THEN doc_id % 11 + 1 END AS after_, quality FROM labels)"""


def _ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = F.col("doc_id")
    return table(spark, sf_dir, "labels").select(d.alias("case_id"), F.when(d % 5 != 0, d % 13 + 1).alias("before"), F.when(d % 4 != 0, d % 11 + 1).alias("after"), "quality")


@query(
    f"""WITH {_RANKS} SELECT quality, count(*) AS cases, round(avg(coalesce(before_ <= 1, false)::INT::DOUBLE), 9) AS hit_1, round(avg(coalesce(before_ <= 10, false)::INT::DOUBLE), 9) AS hit_10,
    round(avg(CASE WHEN before_ <= 10 THEN 1.0::DOUBLE / before_ ELSE 0.0::DOUBLE END), 9) AS mrr_10 FROM ranks GROUP BY 1"""
)
def eval_hit_mrr(spark: SparkSession, sf_dir: str) -> DataFrame:
    """E1, AG14."""
    return evaluation.rank_metrics(_ranks(spark, sf_dir).withColumnRenamed("before", "rank"), "quality")


@query(
    f"""WITH {_RANKS}, h AS (SELECT case_id, coalesce(before_ <= 10, false) AS b, coalesce(after_ <= 10, false) AS a FROM ranks)
    SELECT count(*) FILTER (a AND NOT b) AS gained, count(*) FILTER (b AND NOT a) AS lost, list(case_id ORDER BY case_id) FILTER (a AND NOT b) AS gained_cases, list(case_id ORDER BY case_id) FILTER (b AND NOT a) AS lost_cases FROM h"""
)
def paired_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J20, E3."""
    r = _ranks(spark, sf_dir)
    hit = lambda c: r.select("case_id", F.coalesce(F.col(c) <= 10, F.lit(False)).alias("hit"))
    return evaluation.paired_changes(hit("before"), hit("after"))


@query(f"""WITH {_RANKS} SELECT case_id, CASE WHEN coalesce(after_, 1 << 30) < coalesce(before_, 1 << 30) THEN 'improved' WHEN coalesce(after_, 1 << 30) > coalesce(before_, 1 << 30) THEN 'worsened' ELSE 'same' END AS change FROM ranks""")
def rank_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """W9."""
    r = _ranks(spark, sf_dir)
    return evaluation.rank_changes(r.select("case_id", F.col("before").alias("rank")), r.select("case_id", F.col("after").alias("rank")))


@query(
    f"""WITH {_RANKS}, m AS (SELECT round(avg(coalesce(before_ <= 1, false)::INT::DOUBLE), 9) AS b1, round(avg(coalesce(before_ <= 10, false)::INT::DOUBLE), 9) AS b10, round(avg(coalesce(after_ <= 1, false)::INT::DOUBLE), 9) AS a1, round(avg(coalesce(after_ <= 10, false)::INT::DOUBLE), 9) AS a10 FROM ranks)
    SELECT 'hit_1' AS metric, a1 AS value, b1 AS baseline, a1 >= b1 AS passed FROM m UNION ALL SELECT 'hit_10', a10, b10, a10 >= b10 FROM m"""
)
def regression_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """E4."""
    r = _ranks(spark, sf_dir)
    metrics = lambda c: evaluation.rank_metrics(r.select("case_id", F.col(c).alias("rank")))
    return evaluation.gate(metrics("after"), metrics("before"), ["hit_1", "hit_10"])


_SETS = """
    c AS (SELECT user_id AS case_id, list_sort(list(DISTINCT event_id % 20)) AS found, [[1, 2, 3], [user_id % 20, 5]] AS paths FROM events GROUP BY user_id)"""


def _sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("case_id")).agg(F.collect_set(F.col("event_id") % 20).alias("found"))
    long = lambda *v: F.array(*[F.lit(x).cast("long") if isinstance(x, int) else x for x in v])
    return e.withColumn("paths", F.array(long(1, 2, 3), long(F.col("case_id") % 20, 5)))


@query(
    f"""WITH {_SETS} SELECT case_id, round(list_max(list_transform(paths, lambda p: len(list_intersect(p, found))::DOUBLE / len(list_distinct(p)))), 9) AS fraction, len(list_filter(paths, lambda p: list_has_any(p, found))) > 0 AS any_found,
    len(list_filter(paths, lambda p: list_has_all(found, p))) > 0 AS complete FROM c"""
)
def evidence_complete(spark: SparkSession, sf_dir: str) -> DataFrame:
    """E2, SO5: alternative sets of required evidence."""
    return evaluation.evidence_found(_sets(spark, sf_dir)).select("case_id", "fraction", "any_found", "complete")


@query(f"WITH {_SETS} SELECT case_id AS probe_id, len(m) = 0 AS complete, m AS missing FROM (SELECT case_id, list_sort(list_filter([1, 2, 3]::BIGINT[], lambda x: NOT list_contains(found, x))) AS m FROM c)")
def probe_complete(spark: SparkSession, sf_dir: str) -> DataFrame:
    """E5."""
    s = _sets(spark, sf_dir)
    probes = s.select(F.col("case_id").alias("probe_id"), F.expr("array(1L, 2L, 3L)").alias("required"))
    return evaluation.probes_complete(probes, s.select(F.col("case_id").alias("probe_id"), F.explode("found").alias("chunk_id")))


@query(f"WITH {_SETS} SELECT case_id, round(len(list_intersect([1, 2, case_id % 20], found))::DOUBLE / len(list_distinct([1, 2, case_id % 20])), 9) AS recall FROM c")
def required_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """E11."""
    s = _sets(spark, sf_dir)
    return evaluation.required_recall(s.withColumn("required", F.array(F.lit(1).cast("long"), F.lit(2).cast("long"), F.col("case_id") % 20)))


@query("""SELECT doc_id AS case_id, bool_and(quality = 1) AS strict, bool_or(quality = 1) AS partial, bool_and(quality = 1 AND toxic = 0) AS grounded, round(avg(quality::DOUBLE), 9) AS accuracy FROM (SELECT doc_id // 5 AS doc_id, quality, toxic FROM labels) GROUP BY 1""")
def aspect_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five labels a case."""
    return evaluation.aspect_scores(table(spark, sf_dir, "labels").select(F.expr("doc_id div 5").alias("case_id"), (F.col("quality") == 1).alias("correct"), (F.col("toxic") == 0).alias("cited")))


@query("SELECT p_partkey, p_size % 2 = 0 AS number, p_size % 3 = 0 AS variant FROM part")
def answer_aspects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The price and a variant in an answer about each part."""
    p = table(spark, sf_dir, "part")
    price = F.col("p_retailprice").cast("decimal(12,2)")
    answer = F.concat(F.lit("It costs "), F.format_number(price, 2), F.lit(" euros "), F.when(F.col("p_size") % 3 == 0, "in  Total.").otherwise("apiece."))
    expected = F.when(F.col("p_size") % 2 == 0, price).otherwise(price * 2).cast("decimal(38,10)")
    within = F.lit(0.01).cast("decimal(10,4)")
    return p.select("p_partkey", evaluation.number_in_answer(answer, expected, within).alias("number"), evaluation.variant_in_answer(answer, F.array(F.lit("in total"))).alias("variant"))


@query(
    """WITH d AS (SELECT title, list(text ORDER BY sentence) AS parts FROM (SELECT conv_id AS title, turn AS sentence, text FROM conversations) GROUP BY 1), k AS (SELECT DISTINCT sha256(array_to_string(parts, '')) AS doc_key, parts FROM d),
    u AS (SELECT doc_key, unnest(parts) AS text, unnest(range(len(parts))) AS sentence FROM k)
    SELECT doc_key, sentence::INTEGER AS sentence, (sum(length(text)) OVER w - length(text))::BIGINT AS char_start, (sum(length(text)) OVER w)::BIGINT AS char_end FROM u WINDOW w AS (PARTITION BY doc_key ORDER BY sentence)"""
)
def passage_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as documents of sentences with character offsets."""
    return evaluation.passages(table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("title"), F.col("turn").alias("sentence"), "text"))


@query(
    """WITH r(policy, case_id, hit) AS (SELECT 'base', doc_id, quality = 1 FROM labels UNION ALL SELECT 'more', doc_id, quality = 1 OR toxic = 1 FROM labels UNION ALL SELECT 'other', doc_id, toxic = 1 FROM labels)
    SELECT policy, hits, 0::BIGINT AS lost FROM (SELECT policy, count(*) FILTER (hit) AS hits, count(*) FILTER (NOT hit AND case_id IN (SELECT case_id FROM r WHERE policy = 'base' AND hit)) AS lost FROM r GROUP BY 1) WHERE lost = 0 ORDER BY hits DESC, policy <> 'base', policy LIMIT 1"""
)
def policy_choice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """the best policy that loses no case of the baseline."""
    labels = table(spark, sf_dir, "labels")
    rules = {"base": F.col("quality") == 1, "more": (F.col("quality") == 1) | (F.col("toxic") == 1), "other": F.col("toxic") == 1}
    out = None
    for name, hit in rules.items():
        rows = labels.select(F.lit(name).alias("policy"), F.col("doc_id").alias("case_id"), hit.alias("hit"))
        out = rows if out is None else out.unionByName(rows)
    return ranking.chosen_policy(out, "base")


@query(
    """WITH t AS (SELECT vec_id // 4 AS chunk_id, vec_id % 4 + 1 AS weight, unnest(embedding::DOUBLE[]) AS x, unnest(range(64)) AS i FROM embeddings), m AS (SELECT chunk_id, i, sum(x * weight) / sum(weight) AS x FROM t GROUP BY 1, 2),
    n AS (SELECT chunk_id, sqrt(sum(x * x)) AS n FROM m GROUP BY 1) SELECT chunk_id::BIGINT AS chunk_id, round(sum(round(x / n, 9) * (i + 1)), 6) AS checksum FROM m JOIN n USING (chunk_id) GROUP BY 1"""
)
def pooled_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AG11: four windows a chunk pooled by weight; a weighted sum of components stands for the vector."""
    rows = table(spark, sf_dir, "embeddings").select(F.expr("vec_id div 4").alias("chunk_id"), (F.col("vec_id") % 4 + 1).alias("weight"), "embedding")
    pooled = evaluation.pooled_vectors(rows)
    return pooled.select("chunk_id", F.round(F.aggregate(F.transform("embedding", lambda x, i: x * (i + 1)), F.lit(0.0), lambda s, x: s + x), 6).alias("checksum"))


@query()
def stratified_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A tenth of each language, by hash."""
    return evaluation.stratified(table(spark, sf_dir, "documents").select("doc_id", "lang"), "doc_id", "lang", 0.1)


@query()
def bootstrap_interval(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AG17: the mean difference of each quality group, clusters of ten cases drawn whole."""
    r = _ranks(spark, sf_dir)
    d = F.coalesce(1 / F.col("after"), F.lit(0.0)) - F.coalesce(1 / F.col("before"), F.lit(0.0))
    return evaluation.cluster_bootstrap(r.select(F.col("quality").cast("string").alias("arm"), F.expr("case_id div 10").alias("cluster"), d.alias("difference")))


@query()
def projected_cost(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AG18: the documents' token cost, as a pilot, carried on to a thousand cases a language."""
    d = table(spark, sf_dir, "documents").select(F.col("lang").alias("stratum"), F.col("doc_id").alias("case_id"), F.size(tx.terms(F.col("text"))).cast("double").alias("cost"))
    return evaluation.projected_total(d, {"en": 1000, "de": 1000, "fr": 1000, "es": 1000})


@query(
    """WITH p AS (SELECT o_custkey AS query_id, o_orderkey AS path_id, min(l_quantity) AS score FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1, 2)
    SELECT query_id, path_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, path_id)::INTEGER AS rank FROM p"""
)
def weakest_chunk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F8: paths (orders) by their weakest chunk (line)."""
    lines = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "orders"), F.expr("l_orderkey = o_orderkey"))
    return ranking.path_scores(lines.select(F.col("o_custkey").alias("query_id"), F.col("o_orderkey").alias("path_id"), F.col("l_quantity").alias("score")))


@query(
    """WITH h AS (SELECT user_id AS query_id, event_id AS chunk_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rank, CASE event_type WHEN 'view' THEN 'image' WHEN 'click' THEN 'table' ELSE 'text' END AS modality, value AS s FROM events),
    m AS (SELECT *, modality <> 'image' AND rank <= 20 AS mv FROM h), a AS (SELECT query_id, rank, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS slot FROM m WHERE mv),
    b AS (SELECT query_id, chunk_id, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, chunk_id) AS slot FROM m WHERE mv)
    SELECT query_id, chunk_id, rank::INTEGER AS rank FROM a JOIN b USING (query_id, slot) UNION ALL SELECT query_id, chunk_id, rank::INTEGER FROM m WHERE NOT mv"""
)
def model_rerank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """a model's order among movable hits; images keep their places."""
    kind = F.when(F.col("event_type") == "view", "image").when(F.col("event_type") == "click", "table").otherwise("text")
    e = table(spark, sf_dir, "events")
    hits = e.select(F.col("user_id").alias("query_id"), F.col("event_id").alias("chunk_id"), F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")).alias("rank"), kind.alias("modality"), "value")
    return ranking.model_rerank(hits, F.col("value")).select("query_id", "chunk_id", "rank")


@query(
    """WITH q AS (SELECT doc_id AS chunk_id, text AS content, left(text, 30) AS quote FROM documents), x AS (
        SELECT chunk_id, content, n AS ordinal, 'Q' || (CASE WHEN chunk_id % 3 = 0 THEN 0 ELSE n END) AS question, CASE WHEN chunk_id % 4 = 0 THEN quote || '#' ELSE quote END AS quote FROM q CROSS JOIN range(3) t(n))
    SELECT chunk_id, count(*) AS n, bool_and(trim(question, ' ') <> '' AND length(question) <= 200 AND contains(content, quote)) AND count(DISTINCT lower(question)) = count(*) AND max(ordinal) + 1 = count(*) AND count(DISTINCT ordinal) = count(*) AND count(*) <= 5 AS complete FROM x GROUP BY 1"""
)
def question_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AG23, C17: three invented questions a chunk, some of them repeated or with fabricated quotes."""
    from lectern.operators import chunking

    c = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("chunk_id"), F.col("text").alias("content"))
    q = c.select("chunk_id", F.left("content", F.lit(30)).alias("quote"), F.explode(F.expr("array(0L, 1L, 2L)")).alias("ordinal"))
    q = q.select("chunk_id", "ordinal", F.concat(F.lit("Q"), F.when(F.col("chunk_id") % 3 == 0, 0).otherwise(F.col("ordinal")).cast("string")).alias("question"), F.when(F.col("chunk_id") % 4 == 0, F.concat("quote", F.lit("#"))).otherwise(F.col("quote")).alias("quote"))
    return chunking.question_checks(q, c)
