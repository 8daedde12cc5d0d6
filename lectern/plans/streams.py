"""The life cycle as streams: ``events`` arrive as files, late and repeated, and give what the batch forms give."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.plans.registry import query
from lectern.sources.tables import table
from lectern.streaming import jobs

# How the replay is dealt, and the silence after which a job of these tables is stale, in seconds.
PARTS, LATE, SILENCE = 8, 21_600, 43_200

def _beats(events: DataFrame) -> DataFrame:
    """Events as signs of life of jobs: five jobs a user, three attempts, five kinds of states."""
    kind, value = F.col("event_type"), F.col("value")
    status = F.when((kind == "purchase") & (value > 20), "completed").when(kind == "error", "retry_wait").when(kind == "signup", "queued").otherwise("running")
    attempt = 1 + (value > 15).cast("long") + (value > 30).cast("long")
    job = F.col("user_id") * 10 + F.floor(F.dayofmonth("ts") / 6)
    return events.select("event_id", "ts", job.cast("long").alias("job_id"), attempt.alias("attempt"), status.alias("status"))


#: A fixed delay, above what any replay of a month in eight parts needs, so that SQL can state it.
DELAY = 432_000


def _delayed(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))  # watermarks need an instant
    stream, needed = jobs.replayed(events, PARTS, LATE)
    if needed > DELAY:
        raise ValueError(f"the replay needs a delay of {needed} seconds")
    return stream


@query(
    f"""WITH e AS (
        SELECT event_id, ts, user_id * 10 + day(ts) // 6 AS job_id, 1 + (value > 15)::BIGINT + (value > 30)::BIGINT AS attempt,
            CASE WHEN event_type = 'purchase' AND value > 20 THEN 'completed' WHEN event_type = 'error' THEN 'retry_wait' WHEN event_type = 'signup' THEN 'queued' ELSE 'running' END AS status,
            (SELECT date_trunc('milliseconds', max(ts)) - INTERVAL {DELAY} SECOND FROM events) AS as_of
        FROM events
    ), k AS (SELECT * FROM (SELECT *, max(attempt) OVER (PARTITION BY job_id ORDER BY ts, attempt, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS most FROM e WHERE ts < as_of) WHERE most IS NULL OR attempt >= most
    ), q AS (SELECT *, status = 'running' AND coalesce(lead(ts) OVER w, as_of) > ts + INTERVAL {SILENCE} SECOND AS quiet FROM k WINDOW w AS (PARTITION BY job_id ORDER BY ts, attempt, event_id)
    ), o AS (SELECT *, status IN ('completed', 'failed', 'cancelled') OR (quiet AND attempt >= 3) AS over_, lag(quiet) OVER w AS was_quiet, lag(attempt) OVER w AS was_attempt, lag(status) OVER w AS was_status FROM q WINDOW w AS (PARTITION BY job_id ORDER BY ts, attempt, event_id)
    ), alive AS (SELECT * FROM (SELECT *, coalesce(bool_or(over_) OVER (PARTITION BY job_id ORDER BY ts, attempt, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS dead FROM o) WHERE NOT dead)
    SELECT job_id, attempt, status, ts AS at FROM alive WHERE NOT coalesce(was_attempt = attempt AND CASE WHEN was_quiet THEN 'retry_wait' ELSE was_status END = status, false)
    UNION ALL SELECT job_id, attempt, CASE WHEN attempt >= 3 THEN 'failed' ELSE 'retry_wait' END, ts + INTERVAL {SILENCE} SECOND FROM alive WHERE quiet"""
)
def stream_job_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ST1, ST2, ST3 as a stream: changes of state of jobs up to the last watermark, with timers for silent ones."""
    states = jobs.job_states(_beats(_delayed(spark, sf_dir)), lateness=f"{DELAY} seconds", silence=SILENCE)
    changes = jobs.drained(states, tasks=max(16, 2 * spark.sparkContext.defaultParallelism))  # a task costs more than some of the groups
    return changes.withColumn("at", F.col("at").cast("timestamp_ntz"))


@query("SELECT event_id, user_id, ts, event_type FROM events")
def stream_unique_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ST9 as a stream: each request once, though every tenth comes again."""
    once = jobs.unique_requests(_delayed(spark, sf_dir), "event_id", lateness=f"{DELAY} seconds")
    return jobs.drained(once.select("event_id", "user_id", "ts", "event_type")).withColumn("ts", F.col("ts").cast("timestamp_ntz"))


@query(
    f"""SELECT time_bucket(INTERVAL 6 HOUR, ts, TIMESTAMP '1970-01-01') AS start, event_type, count(*) AS n FROM events
    WHERE time_bucket(INTERVAL 6 HOUR, ts, TIMESTAMP '1970-01-01') + INTERVAL 6 HOUR <= (SELECT date_trunc('milliseconds', max(ts)) - INTERVAL {DELAY} SECOND FROM events) GROUP BY 1, 2"""
)
def stream_window_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ST12 as a stream: counts a window and kind, each given once, when the watermark has passed its window."""
    once = _delayed(spark, sf_dir).withWatermark("ts", f"{DELAY} seconds").dropDuplicatesWithinWatermark(["event_id"])
    counts = once.groupBy(F.window("ts", "6 hours"), "event_type").agg(F.count("*").alias("n"))
    return jobs.drained(counts.select(F.col("window.start").alias("start"), "event_type", "n")).withColumn("start", F.col("start").cast("timestamp_ntz"))
