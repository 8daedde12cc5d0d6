"""The relational core over the star schema, events and conversations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lectern.functions import values as vl
from lectern.operators import conversation, evaluation, lifecycle, scope
from lectern.plans.registry import CHUNKS, query
from lectern.sources import sinks
from lectern.sources.tables import line_chunks, table, values


@query(
    """SELECT l_orderkey, l_linenumber, o_custkey, c_mktsegment, n_name, r_name, p_brand, s_name FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey
    JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey JOIN part ON p_partkey = l_partkey JOIN supplier ON s_suppkey = l_suppkey
    WHERE o_orderstatus = 'O' AND l_returnflag = 'N' AND c_acctbal > 0 AND r_name = 'ASIA' AND p_size <= 25"""
)
def scope_core(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J1, PF1, SRC1: an eight-way equi-join with predicates beside their tables."""
    t = lambda n: table(spark, sf_dir, n)
    lines = t("lineitem").where("l_returnflag = 'N'")
    orders = t("orders").where("o_orderstatus = 'O'")
    customers = t("customer").where("c_acctbal > 0").join(t("nation").join(t("region").where("r_name = 'ASIA'"), F.expr("n_regionkey = r_regionkey")), F.expr("c_nationkey = n_nationkey"))
    return (
        lines.join(orders, F.expr("l_orderkey = o_orderkey")).join(customers, F.expr("o_custkey = c_custkey"))
        .join(t("part").where("p_size <= 25"), F.expr("l_partkey = p_partkey")).join(t("supplier"), F.expr("l_suppkey = s_suppkey"))
        .select("l_orderkey", "l_linenumber", "o_custkey", "c_mktsegment", "n_name", "r_name", "p_brand", "s_name")
    )


@query(
    """SELECT c_custkey, o_orderkey, o_totalprice, nth::INTEGER AS nth FROM customer LEFT JOIN (
        SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS nth FROM orders) WHERE nth <= 3) ON o_custkey = c_custkey"""
)
def lateral_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each customer's three dearest orders; customers without orders stay."""
    orders = table(spark, sf_dir, "orders").withColumnRenamed("o_custkey", "c_custkey")
    return scope.left_top(table(spark, sf_dir, "customer"), orders, ["c_custkey"], 3, F.desc("o_totalprice"), "o_orderkey").select("c_custkey", "o_orderkey", "o_totalprice", "nth")


@query(f"SELECT doc_id, left(arg_min(content, ordinal), 2048) AS introduction FROM ({CHUNKS}) GROUP BY doc_id")
def first_chunk_intro(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J4, R16, S29."""
    return scope.introductions(line_chunks(table(spark, sf_dir, "documents")))


@query(
    f"""WITH c AS ({CHUNKS}) SELECT a.doc_id, a.ordinal AS anchor, b.ordinal, b.content FROM c a JOIN c b ON a.doc_id = b.doc_id AND abs(a.ordinal - b.ordinal) = 1"""
)
def adjacency(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks beside each chunk, by an equi-join."""
    chunks = line_chunks(table(spark, sf_dir, "documents"))
    return scope.neighbours(chunks.select("doc_id", "ordinal"), chunks).select("doc_id", "anchor", "ordinal", "content")


@query(
    f"""WITH c AS ({CHUNKS}), a AS (SELECT * FROM (VALUES (1, 5, 0), (2, 17, 0), (3, 20, 1)) t(rank, doc_id, ordinal) ORDER BY rank LIMIT 2),
    m AS (SELECT c.*, a.ordinal AS anchor FROM a JOIN c ON c.doc_id = a.doc_id AND abs(c.ordinal - a.ordinal) = 1)
    SELECT doc_id, ordinal, min(anchor)::BIGINT AS anchor, 0.0::DOUBLE AS score, 'adjacency' AS score_kind FROM m WHERE (doc_id, ordinal) NOT IN (SELECT (doc_id, ordinal) FROM a) GROUP BY 1, 2"""
)
def adjacency_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    """R10, SRC2: neighbours of the first two of three anchors."""
    anchors = values(spark, [(1, 5, 0), (2, 17, 0), (3, 20, 1)], "rank int, doc_id long, ordinal long")
    return scope.adjacency_read(anchors, line_chunks(table(spark, sf_dir, "documents"))).select("doc_id", "ordinal", "anchor", "score", "score_kind")


@query("SELECT c_custkey, c_name FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders) ORDER BY c_custkey LIMIT 100")
def anti_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J11, SO3: the first hundred customers without orders (the feature is a batch of n)."""
    orders = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey"))
    return table(spark, sf_dir, "customer").join(orders, "c_custkey", "left_anti").select("c_custkey", "c_name").orderBy("c_custkey").limit(100)


@query("SELECT o_orderkey FROM orders o WHERE EXISTS (SELECT 1 FROM orders p WHERE p.o_custkey = o.o_custkey AND p.o_orderdate > o.o_orderdate)")
def semi_later_change(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders after which their customer ordered again; one maximum a customer stands for the theta join."""
    orders = table(spark, sf_dir, "orders")
    last = orders.groupBy("o_custkey").agg(F.max("o_orderdate").alias("last"))
    return orders.join(last, "o_custkey").where("last > o_orderdate").select("o_orderkey")


@query(
    """SELECT c_mktsegment, count(*) AS eligible, count(o.o_custkey) AS completed, count(*) - count(o.o_custkey) AS missing FROM customer
    LEFT JOIN (SELECT DISTINCT o_custkey FROM orders WHERE o_orderstatus = 'F') o ON o.o_custkey = c_custkey GROUP BY c_mktsegment"""
)
def coverage_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Eligible and completed keys."""
    done = table(spark, sf_dir, "orders").where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("c_custkey")).distinct().withColumn("done", F.lit(1))
    rows = table(spark, sf_dir, "customer").join(done, "c_custkey", "left")
    return rows.groupBy("c_mktsegment").agg(F.count("*").alias("eligible"), F.count("done").alias("completed"), F.count_if(F.col("done").isNull()).alias("missing"))


@query("""SELECT o_orderkey, o_custkey, o_orderdate FROM orders WHERE (o_orderdate, o_orderkey) > (TIMESTAMP '1995-01-01', 100) ORDER BY o_orderdate, o_orderkey LIMIT 51""")
def keyset_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page after a cursor, and one row more."""
    orders = table(spark, sf_dir, "orders")
    after = (F.lit("1995-01-01 00:00:00").cast(orders.schema["o_orderdate"].dataType), 100)
    return scope.keyset_page(orders, "o_orderdate", "o_orderkey", after, 50).select("o_orderkey", "o_custkey", "o_orderdate")


@query("""SELECT o_orderkey, rtrim(translate(to_base64(encode('{"o_orderkey":' || o_orderkey || ',"o_orderstatus":"' || o_orderstatus || '"}')), '+/', '-_'), '=') AS cursor FROM orders""")
def page_cursors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T5: opaque cursors of all orders."""
    return table(spark, sf_dir, "orders").select("o_orderkey", vl.cursor("o_orderkey", "o_orderstatus").alias("cursor"))


_JOBS = """
    SELECT event_id AS job_id, CASE event_type WHEN 'signup' THEN 'queued' WHEN 'error' THEN 'retry_wait' WHEN 'click' THEN 'running' WHEN 'view' THEN 'completed' ELSE 'failed' END AS status,
        (user_id % 4)::BIGINT AS attempt, CASE WHEN user_id % 3 = 0 THEN ts + INTERVAL 1 DAY END AS next_attempt_at, ts AS created_at, value AS size, ts AS heartbeat_at FROM events
"""


def _jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events stand for jobs."""
    kinds = {"signup": "queued", "error": "retry_wait", "click": "running", "view": "completed"}
    status = F.lit("failed")
    for k, v in kinds.items():
        status = F.when(F.col("event_type") == k, v).otherwise(status)
    ts = F.col("ts")
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("job_id"), status.alias("status"), (F.col("user_id") % 4).alias("attempt"),
        F.when(F.col("user_id") % 3 == 0, ts + F.expr("interval 1 day")).alias("next_attempt_at"), ts.alias("created_at"), F.col("value").alias("size"), ts.alias("heartbeat_at"),
    )


_NOW = "2024-01-15 00:00:00"
_NOW_SQL = f"TIMESTAMP '{_NOW}'"


def _now(jobs: DataFrame):
    return F.lit(_NOW).cast(jobs.schema["created_at"].dataType)


@query(
    f"""WITH j AS ({_JOBS}) SELECT job_id, status, attempt FROM j WHERE (next_attempt_at IS NULL OR next_attempt_at <= {_NOW_SQL}) AND (status = 'queued' OR (status = 'retry_wait' AND attempt < 3))
    ORDER BY coalesce(next_attempt_at, created_at), size, created_at, job_id LIMIT 5"""
)
def claim_next(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ST1, T7, PF6: the next five jobs (the feature is a batch of n)."""
    jobs = _jobs(spark, sf_dir)
    return lifecycle.next_jobs(jobs, _now(jobs), 5).select("job_id", "status", "attempt")


@query("SELECT o_orderkey, o_clerk FROM (SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE o_custkey END AS o_clerk FROM orders) ORDER BY o_clerk NULLS FIRST, o_orderkey LIMIT 20")
def nulls_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Claims without a time come first."""
    rows = table(spark, sf_dir, "orders").select("o_orderkey", F.when(F.col("o_orderkey") % 3 != 0, F.col("o_custkey")).alias("o_clerk"))
    return rows.orderBy(F.asc_nulls_first("o_clerk"), "o_orderkey").limit(20)


@query("SELECT o_orderkey, o_clerk FROM (SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE o_custkey END AS o_clerk FROM orders) ORDER BY o_clerk NULLS LAST, o_orderkey LIMIT 20")
def nulls_last(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T2."""
    rows = table(spark, sf_dir, "orders").select("o_orderkey", F.when(F.col("o_orderkey") % 3 != 0, F.col("o_custkey")).alias("o_clerk"))
    return rows.orderBy(F.asc_nulls_last("o_clerk"), "o_orderkey").limit(20)


@query(
    f"""WITH j AS ({_JOBS}) SELECT job_id, CASE WHEN s AND attempt >= 3 THEN 'failed' WHEN s THEN 'retry_wait' ELSE status END AS status,
        CASE WHEN s AND attempt < 3 THEN {_NOW_SQL} + to_seconds(least(30 * pow(2, attempt - 1), 3600)::BIGINT) ELSE next_attempt_at END AS next_attempt_at
    FROM (SELECT *, status = 'running' AND floor(epoch({_NOW_SQL})) - floor(epoch(heartbeat_at)) > 120 AS s FROM j)"""
)
def stale_reconciled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ST2, S23: running jobs without a heartbeat wait for a retry or fail."""
    jobs = _jobs(spark, sf_dir)
    return lifecycle.reconciled(jobs, _now(jobs)).select("job_id", "status", "next_attempt_at")


@query("""WITH l AS (SELECT user_id, max(ts) AS last FROM events GROUP BY 1), n AS (SELECT max(ts) AS newest FROM events)
    SELECT user_id, last, (floor(epoch(newest)) - floor(epoch(last)))::BIGINT AS silent, floor(epoch(newest)) - floor(epoch(last)) > 86400 AS stale FROM l CROSS JOIN n""")
def heartbeat_stale(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ST2, ST12: each user's last event against the latest of all."""
    return lifecycle.stale_keys(table(spark, sf_dir, "events"), "user_id", "ts", 86_400)


@query("SELECT user_id, arg_max(event_type, (ts, event_id)) AS state, max(ts) AS at FROM events GROUP BY user_id")
def job_latest_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ST8: the last state of each key."""
    return table(spark, sf_dir, "events").groupBy("user_id").agg(F.max_by("event_type", F.struct("ts", "event_id")).alias("state"), F.max("ts").alias("at"))


@query(
    """WITH r AS (SELECT user_id AS key, event_id AS seq, event_type AS hash FROM events)
    SELECT key, seq, CASE WHEN row_number() OVER w = 1 THEN 'applied' WHEN hash = first_value(hash) OVER w THEN 'replayed' ELSE 'rejected' END AS outcome FROM r WINDOW w AS (PARTITION BY key ORDER BY seq)"""
)
def idempotent_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ST9: a repeated request replays, one of another content is rejected."""
    rows = table(spark, sf_dir, "events").select(F.col("user_id").alias("key"), F.col("event_id").alias("seq"), F.col("event_type").alias("hash"))
    return lifecycle.replays(rows).select("key", "seq", "outcome")


@query(
    """WITH c AS (SELECT o_orderkey AS target_id, o_custkey AS document_id, o_orderkey AS version, o_orderpriority = '1-URGENT' AS deleted, o_custkey % 10 <> 0 AS kb_active FROM orders WHERE o_orderstatus = 'O'),
    n AS (SELECT o_custkey AS document_id, max(o_orderkey) AS latest FROM orders GROUP BY 1), b AS (SELECT *, max(version) OVER (PARTITION BY document_id) AS best FROM c)
    SELECT target_id, CASE WHEN deleted THEN 'retired:deleted' WHEN NOT kb_active THEN 'retired:inactive' WHEN version < best THEN 'retired:superseded' WHEN latest > version THEN 'retired:later_change' ELSE 'serving' END AS decision
    FROM b JOIN n USING (document_id)"""
)
def promotion_decision(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ST4, J9: orders stand for versions of their customer's document."""
    orders = table(spark, sf_dir, "orders")
    ready = orders.where("o_orderstatus = 'O'").select(
        F.col("o_orderkey").alias("target_id"), F.col("o_custkey").alias("document_id"), F.col("o_orderkey").alias("version"), (F.col("o_orderpriority") == "1-URGENT").alias("deleted"), (F.col("o_custkey") % 10 != 0).alias("kb_active")
    )
    return lifecycle.promotion(ready, orders.select(F.col("o_custkey").alias("document_id"), F.col("o_orderkey").alias("version")))


@query(
    """WITH l AS (SELECT o_custkey AS document_id, arg_max(o_orderkey, (o_orderdate, o_orderkey)) AS version, arg_max(o_orderstatus, (o_orderdate, o_orderkey)) AS s FROM orders GROUP BY 1)
    SELECT document_id, version FROM l WHERE s <> 'P'"""
)
def live_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ST10: the last change of each document, unless it is a deletion (status P)."""
    changes = table(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("document_id"), F.col("o_orderkey").alias("version"), F.when(F.col("o_orderstatus") == "P", "delete").otherwise("upsert").alias("operation"), F.struct("o_orderdate", "o_orderkey").alias("seq")
    )
    return lifecycle.live_documents(changes)


@query(
    """WITH b AS (SELECT c_custkey AS k, c_name AS v, 0 AS version, 0 AS f FROM customer UNION ALL SELECT o_custkey, o_orderpriority, (o_orderkey % 3)::INTEGER, 1 FROM (SELECT o_custkey, o_orderpriority, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS n FROM orders) WHERE n = 1)
    SELECT k, v, version FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY version DESC, f DESC) AS n FROM b) WHERE n = 1"""
)
def upserted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC13: the last version of each key."""
    stored = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"), F.col("c_name").alias("v"), F.lit(0).alias("version"))
    first = scope.best_row(table(spark, sf_dir, "orders"), ["o_custkey"], "o_orderkey")
    return sinks.upserted(stored, first.select(F.col("o_custkey").alias("k"), F.col("o_orderpriority").alias("v"), (F.col("o_orderkey") % 3).cast("int").alias("version")), ["k"], "version")


@query("""SELECT doc_id, lang, source FROM documents WHERE doc_id % 3 <> 0 UNION ALL SELECT doc_id, lang, source FROM documents WHERE doc_id % 3 = 0""")
def insert_absent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC14, J11: rows of all documents inserted where two thirds are stored already."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "source")
    return sinks.inserted_if_absent(docs.where("doc_id % 3 <> 0"), docs, ["doc_id"])


@query("""SELECT l.doc_id AS doc_id, d.lang AS stored_content, CASE WHEN l.quality = 1 THEN d.lang END AS incoming_content FROM documents d JOIN labels l USING (doc_id) WHERE d.lang IS DISTINCT FROM CASE WHEN l.quality = 1 THEN d.lang END""")
def immutable_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PF14, SRC14: rows of an immutable table that differ, null-safely, from what comes in."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang")
    new = docs.join(table(spark, sf_dir, "labels"), "doc_id").select("doc_id", F.when(F.col("quality") == 1, F.col("lang")).alias("lang"))
    return sinks.mismatches(docs, new, ["doc_id"], "lang")


@query(
    """WITH r AS (SELECT c_custkey FROM customer WHERE c_acctbal < 0)
    SELECT 'orders' AS name, count(*) AS n FROM orders WHERE o_custkey IN (SELECT * FROM r) UNION ALL SELECT 'customer', count(*) FROM customer WHERE c_custkey IN (SELECT * FROM r)"""
)
def cascade_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC15, J10: rows that go with retired customers."""
    customers = table(spark, sf_dir, "customer")
    orders = table(spark, sf_dir, "orders").withColumnRenamed("o_custkey", "c_custkey")
    return sinks.removed_counts({"orders": orders, "customer": customers}, customers.where("c_acctbal < 0"), ["c_custkey"])


@query("""SELECT o_orderkey FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0)""")
def cascade_kept(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC15: orders after the removal."""
    retired = table(spark, sf_dir, "customer").where("c_acctbal < 0").select(F.col("c_custkey").alias("o_custkey"))
    return sinks.removed(table(spark, sf_dir, "orders"), retired, ["o_custkey"]).select("o_orderkey")


@query(
    """SELECT s.s_suppkey AS s_suppkey, s_name, count(l_orderkey) AS live_lines FROM supplier s LEFT JOIN lineitem l ON l.l_suppkey = s.s_suppkey AND l_returnflag <> 'R' GROUP BY 1, 2"""
)
def correlated_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AG1: a count for each row, zero where there is none."""
    n = table(spark, sf_dir, "lineitem").where("l_returnflag <> 'R'").groupBy(F.col("l_suppkey").alias("s_suppkey")).agg(F.count("*").alias("live_lines"))
    return table(spark, sf_dir, "supplier").join(n, "s_suppkey", "left").select("s_suppkey", "s_name", F.coalesce("live_lines", F.lit(0)).alias("live_lines"))


@query(
    """WITH t AS (SELECT o_custkey AS doc_id, o_orderpriority AS title, o_orderkey AS ordinal, (o_orderkey % 2 + 1)::INTEGER AS depth FROM orders), d AS (SELECT c_custkey AS doc_id, c_name FROM customer WHERE c_custkey > 40 ORDER BY 1 LIMIT 50),
    m AS (SELECT doc_id, min(depth) AS depth FROM t GROUP BY 1), f AS (SELECT doc_id, title, min(ordinal) AS ordinal FROM t JOIN m USING (doc_id, depth) GROUP BY 1, 2),
    o AS (SELECT doc_id, list(title ORDER BY ordinal, title) AS titles FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY ordinal, title) AS n FROM f) WHERE n <= 8 GROUP BY 1)
    SELECT d.doc_id, c_name, (SELECT count(*) FROM customer WHERE c_custkey > 40) > 50 AS truncated, (SELECT count(*) FROM orders WHERE o_custkey = d.doc_id) AS n_chunks, titles FROM d LEFT JOIN o USING (doc_id)"""
)
def catalog_outline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """R12, AG1, AG2, AG4, W1, T6, PF5: a page of customers as documents, orders as chunks, priorities as titles."""
    docs = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("doc_id"), "c_name")
    orders = table(spark, sf_dir, "orders").withColumnRenamed("o_custkey", "doc_id")
    titles = orders.select("doc_id", F.col("o_orderpriority").alias("title"), F.col("o_orderkey").alias("ordinal"), (F.col("o_orderkey") % 2 + 1).cast("int").alias("depth"))
    return scope.catalogue(docs, orders, titles, after=40)


@query("""SELECT o_custkey AS revision_id, max(CASE WHEN r = 0 THEN o_orderkey END) AS text_retrieval, max(CASE WHEN r = 1 THEN o_orderkey END) AS semantic_analysis, max(CASE WHEN r = 2 THEN o_orderkey END) AS cross_modal_retrieval
    FROM (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS r FROM orders) WHERE r < 3 GROUP BY 1""")
def role_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three bindings a revision as columns."""
    roles = F.array(*[F.lit(x) for x in ("text_retrieval", "semantic_analysis", "cross_modal_retrieval")])
    rows = scope.first_rows(table(spark, sf_dir, "orders"), ["o_custkey"], 3, "o_orderkey")
    return scope.pivoted_roles(rows.select(F.col("o_custkey").alias("revision_id"), F.element_at(roles, F.col("nth")).alias("role"), F.col("o_orderkey").alias("space_id")))


@query("SELECT max(o_orderkey) + 1 AS next_version, count(*) AS n FROM orders")
def next_version(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AG12, AG20."""
    return table(spark, sf_dir, "orders").agg((F.max("o_orderkey") + 1).alias("next_version"), F.count("*").alias("n"))


@query("""SELECT count(*) FILTER (a IS NOT NULL) AS expected, count(*) FILTER (b IS NOT NULL) AS stored, count(*) FILTER (b IS NULL) AS missing, count(*) FILTER (a IS NULL) AS surplus, count(*) FILTER (a IS NOT NULL AND b IS NOT NULL AND quality <> (CASE WHEN b % 7 = 0 THEN 1 - quality ELSE quality END)) AS changed
    FROM (SELECT doc_id AS a, quality FROM labels) x FULL JOIN (SELECT doc_id AS b FROM documents) y ON a = b""")
def completeness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AG20, AG24, J13: labels expected against documents stored."""
    labels = table(spark, sf_dir, "labels").select("doc_id", "quality")
    stored = table(spark, sf_dir, "documents").select("doc_id").join(labels, "doc_id", "left").select("doc_id", F.when(F.col("doc_id") % 7 == 0, 1 - F.col("quality")).otherwise(F.col("quality")).alias("quality"))
    return lifecycle.completeness(labels, stored, "doc_id", "quality")


@query("SELECT sha256(text) AS digest, count(*) AS n FROM documents GROUP BY 1 HAVING count(*) > 1")
def duplicate_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AG22, S6: texts that occur more than once."""
    return lifecycle.duplicates(table(spark, sf_dir, "documents").select(F.sha2("text", 256).alias("digest")), "digest")


@query("""SELECT conv_id, turn, question, answer FROM (SELECT conv_id, turn, role, text AS question, lead(role) OVER w AS r, lead(text) OVER w AS answer FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)) WHERE role = 'user' AND r = 'assistant'""")
def turn_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J15."""
    return conversation.turn_pairs(table(spark, sf_dir, "conversations"))


@query(
    """WITH p AS (SELECT conv_id, turn, question, answer FROM (SELECT conv_id, turn, role, text AS question, lead(role) OVER w AS r, lead(text) OVER w AS answer FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)) WHERE role = 'user' AND r = 'assistant'),
    t AS (SELECT conv_id, turn, (len(regexp_extract_all(question, '[\\p{L}\\p{N}_]+|[^\\p{L}\\p{N}_\\s]')) + len(regexp_extract_all(answer, '[\\p{L}\\p{N}_]+|[^\\p{L}\\p{N}_\\s]')))::BIGINT AS tokens FROM p)
    SELECT conv_id, turn, tokens, used::BIGINT AS used FROM (SELECT *, sum(tokens) OVER (PARTITION BY conv_id ORDER BY turn DESC) AS used, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS n FROM t) WHERE n <= 6 AND used <= 200"""
)
def context_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest pairs within 200 tokens."""
    return conversation.context_window(conversation.turn_pairs(table(spark, sf_dir, "conversations")), most_tokens=200)


@query("""SELECT conv_id, turn, role, CASE WHEN row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) > 3 THEN left(text, 800) ELSE text END AS text FROM conversations""")
def compacted_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SV2."""
    return conversation.compacted(table(spark, sf_dir, "conversations")).select("conv_id", "turn", "role", "text")


@query("""WITH f AS (SELECT user_id AS run_id, event_type AS chunk_id, min((ts, event_id)) AS seen FROM events GROUP BY 1, 2) SELECT run_id, chunk_id, 'ev_' || row_number() OVER (PARTITION BY run_id ORDER BY seen, chunk_id) AS ref FROM f""")
def evidence_refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SV3: references in first-seen order."""
    return conversation.evidence_refs(table(spark, sf_dir, "events").select(F.col("user_id").alias("run_id"), F.col("event_type").alias("chunk_id"), F.col("ts").alias("round"), F.col("event_id").alias("place")))


@query(
    """WITH a AS (SELECT conv_id * 1000 + turn AS answer_id, left(text, 60) AS head, turn % 4 + 1 AS a, conv_id % 3 + 1 AS b, (conv_id + turn % 4 + 1) % 5 <> 0 AS ka, (conv_id + conv_id % 3 + 1) % 5 <> 0 AS kb FROM conversations WHERE role = 'assistant')
    SELECT answer_id, head || ' ' || CASE WHEN ka AND kb AND a <> b THEN '[1][2]' WHEN ka OR kb THEN '[1]' ELSE '' END || ' and ' || CASE WHEN ka THEN '[1]' ELSE '' END || ' then .' AS text FROM a"""
)
def cite_renumber(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Citations behind assistants' turns, numbered by first use; unknown ones are dropped."""
    said = table(spark, sf_dir, "conversations").where("role = 'assistant'").withColumn("answer_id", F.col("conv_id") * 1000 + F.col("turn"))
    a, b = (F.concat(F.lit("ev_"), x.cast("string")) for x in (F.col("turn") % 4 + 1, F.col("conv_id") % 3 + 1))
    answers = said.select("answer_id", F.concat(F.left("text", F.lit(60)), F.lit(" ["), a, F.lit(", "), b, F.lit("] and ["), a, F.lit("] then [ev_9].")).alias("text"))
    some = F.filter(F.sequence(F.lit(1), F.lit(4)), lambda n: (F.col("conv_id") + n) % 5 != 0)
    known = said.select("answer_id", F.explode(some).alias("n")).select("answer_id", F.concat(F.lit("ev_"), F.col("n").cast("string")).alias("ref"))
    return conversation.rendered(answers, conversation.citations(answers, known))


@query("SELECT user_id AS run_id, sum(event_id % 100)::BIGINT AS prompt_tokens, sum(event_id % 7)::BIGINT AS completion_tokens, count(*) AS attempts FROM events GROUP BY 1")
def usage_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AG19."""
    return conversation.usage(table(spark, sf_dir, "events").select(F.col("user_id").alias("run_id"), (F.col("event_id") % 100).alias("prompt_tokens"), (F.col("event_id") % 7).alias("completion_tokens")))


@query("""WITH n AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) - 1 AS i, count(*) OVER (PARTITION BY event_type) AS n FROM events WHERE value IS NOT NULL)
    SELECT event_type, max(n) AS n, avg(value) FILTER (i IN ((n - 1) // 2, n // 2)) AS p50, max(value) FILTER (i = round_even(0.95 * (n - 1), 0)::BIGINT) AS p95 FROM n GROUP BY 1""")
def percentile_latency(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AG15."""
    return evaluation.percentiles(table(spark, sf_dir, "events"), "value", "event_type")


@query("""SELECT doc_id AS a_id, 'labelled' AS source FROM labels UNION ALL SELECT item_id, 'benchmark' FROM benchmark""")
def tagged_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SO1, SO6: two tables in one, with where each row is from."""
    a = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("a_id"), F.lit("labelled").alias("source"))
    return a.unionByName(table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("a_id"), F.lit("benchmark").alias("source")))


@query("""SELECT event_id, json_extract_string(props, '$.' || k) AS v, json_exists(props, '$.' || k) AS has FROM (SELECT event_id, props, json_keys(props)[1] AS k FROM events)""")
def json_access(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S28, PF4: the first key's value of each event's properties."""
    e = table(spark, sf_dir, "events").withColumn("m", F.from_json("props", "map<string,string>")).withColumn("k", F.get(F.json_object_keys("props"), F.lit(0)))
    return e.select("event_id", F.try_element_at("m", F.col("k")).alias("v"), F.coalesce(F.map_contains_key("m", F.col("k")), F.lit(False)).alias("has"))


@query("SELECT o_orderkey, l_linenumber, l_quantity FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey AND l_linenumber = 1")
def latest_child(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An outer join on pointer columns."""
    child = table(spark, sf_dir, "lineitem").where("l_linenumber = 1").withColumnRenamed("l_orderkey", "o_orderkey")
    return table(spark, sf_dir, "orders").join(child, "o_orderkey", "left").select("o_orderkey", "l_linenumber", "l_quantity")


@query(
    """WITH r AS (SELECT o_orderkey AS parent_id, o_custkey AS visual_id, (o_orderkey % 50) AS asset_id FROM orders), c AS (SELECT p_partkey AS chunk_id, p_name AS content FROM part), h AS (SELECT DISTINCT * FROM r WHERE parent_id IN (7, 32, 96) OR visual_id IN (7, 32, 96) OR asset_id IN (7, 32, 96))
    SELECT h.*, p.content AS parent_content, v.content AS visual_content FROM h JOIN c p ON p.chunk_id = parent_id JOIN c v ON v.chunk_id = visual_id ORDER BY parent_id, visual_id LIMIT 500"""
)
def relation_endpoints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Relations with one of three columns picked, and both of their chunks (500 at most is the feature)."""
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("parent_id"), F.col("o_custkey").alias("visual_id"), (F.col("o_orderkey") % 50).alias("asset_id"))
    chunks = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("chunk_id"), F.col("p_name").alias("content"))
    return scope.relation_endpoints(rows, chunks, values(spark, [(7,), (32,), (96,)], "picked_id long")).select("parent_id", "visual_id", "asset_id", "parent_content", "visual_content")


@query("""WITH s AS (SELECT DISTINCT o_custkey AS kb_id, o_orderstatus AS revision_id FROM orders WHERE o_orderpriority = '1-URGENT') SELECT o_orderkey FROM orders JOIN s ON kb_id = o_custkey AND revision_id = o_orderstatus""")
def frozen_scopes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PF13: rows of frozen (base, revision) snapshots."""
    rows = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority", F.col("o_custkey").alias("kb_id"), F.col("o_orderstatus").alias("revision_id"))
    return scope.in_scopes(rows, rows.where("o_orderpriority = '1-URGENT'")).select("o_orderkey")


@query("""SELECT p_partkey AS asset_id, least(w, h) < 64 OR (count(*) OVER (PARTITION BY p_brand) >= 3 AND ratio < 0.08) AS decorative FROM (SELECT p_partkey, p_brand, (p_size * 10)::INTEGER AS w, (p_size * 7 + 20)::INTEGER AS h, p_size / 250.0::DOUBLE AS ratio FROM part)""")
def decorative_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PF10, AG21: parts stand for images, brands for digests."""
    rows = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("asset_id"), F.col("p_brand").alias("digest"), (F.col("p_size") * 10).alias("width"), (F.col("p_size") * 7 + 20).alias("height"), (F.col("p_size") / 250.0).alias("area_ratio"))
    return scope.decorative_images(rows).select("asset_id", "decorative")


@query("""SELECT event_type, count(*) AS n, max(value) AS top, arg_max(event_id, (value, -event_id)) AS top_event FROM events GROUP BY 1""")
def top_of_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AG10, AG14: a maximum and where it is."""
    return table(spark, sf_dir, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.max("value").alias("top"), F.max_by("event_id", F.struct("value", -F.col("event_id"))).alias("top_event"))


@query("""WITH e AS (SELECT user_id AS run_id, event_id AS seq, event_type AS state, event_id % 2 = 0 AS stored FROM events), m AS (SELECT run_id, seq, CASE state WHEN 'error' THEN 'failed' WHEN 'purchase' THEN 'completed' ELSE state END AS state, stored FROM e)
    SELECT run_id, arg_max(state, ((stored AND state IN ('completed', 'failed', 'cancelled'))::INT, seq)) AS state FROM m GROUP BY run_id""")
def delivered_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ST8, ST7: ephemeral and stored events in one state; a stored terminal one wins."""
    state = F.when(F.col("event_type") == "error", "failed").when(F.col("event_type") == "purchase", "completed").otherwise(F.col("event_type"))
    rows = table(spark, sf_dir, "events").select(F.col("user_id").alias("run_id"), F.col("event_id").alias("seq"), state.alias("state"))
    return lifecycle.delivered(rows.where("seq % 2 = 1"), rows.where("seq % 2 = 0"))


@query(f"""WITH j AS ({_JOBS}) SELECT job_id AS target_id, created_at AS due_at FROM j WHERE created_at <= {_NOW_SQL} ORDER BY created_at, job_id LIMIT 25""")
def cleanup_due(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ST11: the next 25 targets to clean up (the feature is a batch of n)."""
    jobs = _jobs(spark, sf_dir)
    return lifecycle.cleanup_due(jobs.select(F.col("job_id").alias("target_id"), F.col("created_at").alias("due_at")), _now(jobs), 25)


@query(f"""WITH j AS ({_JOBS}), t AS (SELECT job_id FROM j WHERE (next_attempt_at IS NULL OR next_attempt_at <= {_NOW_SQL}) AND (status = 'queued' OR (status = 'retry_wait' AND attempt < 3)) ORDER BY coalesce(next_attempt_at, created_at), size, created_at, job_id LIMIT 10)
    SELECT job_id, CASE WHEN t.job_id IS NULL THEN status ELSE 'running' END AS status, attempt + (t.job_id IS NOT NULL)::INT AS attempt FROM j LEFT JOIN t USING (job_id)""")
def claimed_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ST1, ST3: ten jobs claimed, their attempt raised."""
    jobs = _jobs(spark, sf_dir)
    return lifecycle.claimed(jobs, _now(jobs), 10).select("job_id", "status", "attempt")


@query(f"""WITH j AS ({_JOBS}) SELECT u.job_id AS job_id, u.attempt AS attempt FROM (SELECT job_id, (job_id % 4)::BIGINT AS attempt FROM j) u JOIN j ON j.job_id = u.job_id AND j.attempt = u.attempt AND j.status = 'running'""")
def owned_updates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ST3: updates of the present lease."""
    jobs = _jobs(spark, sf_dir)
    return lifecycle.owned(jobs.select("job_id", (F.col("job_id") % 4).alias("attempt")), jobs)


@query("""SELECT o_orderkey, o_custkey, sum(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey) AS used FROM orders QUALIFY used <= 300000""")
def running_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows before a running sum passes a budget."""
    w = Window.partitionBy("o_custkey").orderBy(F.desc("o_orderdate"), "o_orderkey").rowsBetween(Window.unboundedPreceding, 0)
    return table(spark, sf_dir, "orders").withColumn("used", F.sum("o_totalprice").over(w)).where("used <= 300000").select("o_orderkey", "o_custkey", "used")
