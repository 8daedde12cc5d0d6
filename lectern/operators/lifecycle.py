"""Index life cycle in batch form: claims, leases, promotion, idempotency, deletion, cleanup (ST1 to ST12)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.functions import values as vl

# Seconds of silence after which a job is stale, attempts, retry delays, a graph lease.
STALE_SECONDS, MAX_ATTEMPTS = 120, 3
RETRY_BASE, RETRY_MOST = 30, 3600
GRAPH_LEASE_SECONDS, GRAPH_HEARTBEAT_SECONDS = 180, 30
TERMINAL = ("completed", "failed", "cancelled")


def claimable(now: Column) -> Column:
    """A job that may be claimed: queued, or waiting for a retry that is due, with attempts left (PF6)."""
    due = F.col("next_attempt_at").isNull() | (F.col("next_attempt_at") <= now)
    fresh = (F.col("status") == "queued") & due
    again = (F.col("status") == "retry_wait") & due & (F.col("attempt") < MAX_ATTEMPTS)
    return fresh | again


def next_jobs(jobs: DataFrame, now: Column, n: int = 1) -> DataFrame:
    """The next jobs to claim (ST1, T7): by due time, then size, creation and id. One writer claims; there are no locks."""
    return jobs.where(claimable(now)).orderBy(F.coalesce("next_attempt_at", "created_at"), "size", "created_at", "job_id").limit(n)


def claimed(jobs: DataFrame, now: Column, n: int = 1) -> DataFrame:
    """``jobs`` with the next ones running, their attempt raised as the lease's token (ST1, ST3)."""
    taken = next_jobs(jobs, now, n).select("job_id", F.lit(True).alias("taken"))
    rows = jobs.join(F.broadcast(taken), "job_id", "left")
    hit = F.coalesce("taken", F.lit(False))
    return rows.withColumns({"status": F.when(hit, "running").otherwise(F.col("status")), "attempt": F.col("attempt") + hit.cast("int"), "heartbeat_at": F.when(hit, now).otherwise(F.col("heartbeat_at"))}).drop("taken")


def owned(updates: DataFrame, jobs: DataFrame) -> DataFrame:
    """Updates whose attempt is the job's present one (ST3); those of an older lease are ignored."""
    return updates.join(jobs.where("status = 'running'").select("job_id", "attempt"), ["job_id", "attempt"], "left_semi")


def reconciled(jobs: DataFrame, now: Column) -> DataFrame:
    """``jobs`` with stale running ones waiting for a retry, or failed when no attempt is left (ST2, S23)."""
    stale = (F.col("status") == "running") & (F.unix_timestamp(now) - F.unix_timestamp("heartbeat_at") > STALE_SECONDS)
    over = F.col("attempt") >= MAX_ATTEMPTS
    wait = F.timestamp_seconds(F.unix_timestamp(now) + vl.backoff_seconds(F.col("attempt"), RETRY_BASE, RETRY_MOST))
    return jobs.withColumns({
        "next_attempt_at": F.when(stale & ~over, wait).otherwise(F.col("next_attempt_at")),
        "status": F.when(stale & over, "failed").when(stale, "retry_wait").otherwise(F.col("status")),
    })


def continued(jobs: DataFrame, slices: DataFrame) -> DataFrame:
    """Jobs that used up a time slice are queued again at the end of it, without another attempt (ST5)."""
    rows = jobs.join(slices.select("job_id", "slice_end"), "job_id", "left")
    hit = (F.col("status") == "running") & F.col("slice_end").isNotNull()
    return rows.withColumns({"next_attempt_at": F.when(hit, F.col("slice_end")).otherwise(F.col("next_attempt_at")), "status": F.when(hit, "queued").otherwise(F.col("status"))}).drop("slice_end")


def stale_keys(beats: DataFrame, key: str, ts: str, seconds: int = STALE_SECONDS) -> DataFrame:
    """(key, last, silent, stale): each key's last beat against the latest of all (ST2)."""
    last = beats.groupBy(key).agg(F.max(ts).alias("last"))
    newest = beats.agg(F.max(ts).alias("newest"))
    silent = F.unix_timestamp("newest") - F.unix_timestamp("last")
    return last.join(F.broadcast(newest)).select(key, "last", silent.alias("silent"), (silent > seconds).alias("stale"))  # one row


def state_changes(beats: DataFrame, as_of: Column, silence: int = STALE_SECONDS) -> DataFrame:
    """(job_id, attempt, status, at): changes of state of each job before ``as_of`` (ST1 to ST3), the batch form of the stream.

    ``beats``: job_id, ts, attempt, status, event_id. Events of an older attempt than one before are ignored. A running job
    that is silent for more than ``silence`` seconds waits for a retry, or fails when it has had its attempts; what follows a
    terminal state is ignored. Repeated events change nothing.
    """
    order = Window.partitionBy("job_id").orderBy("ts", "attempt", "event_id")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    known = beats.where(F.col("ts") < as_of).withColumn("most", F.max("attempt").over(before)).where("most is null or attempt >= most")
    ends = F.col("ts") + F.make_dt_interval(secs=F.lit(silence))
    quiet = (F.col("status") == "running") & (F.coalesce(F.lead("ts").over(order), as_of) > ends)
    over = F.col("status").isin(*TERMINAL) | (quiet & (F.col("attempt") >= MAX_ATTEMPTS))
    rows = known.withColumns({"quiet": quiet, "over": over, "was_quiet": F.lag(quiet).over(order), "was": F.lag(F.struct("attempt", "status")).over(order)})
    alive = rows.withColumn("dead", F.coalesce(F.max("over").over(before), F.lit(False))).where(~F.col("dead"))
    same = (F.col("was.attempt") == F.col("attempt")) & (F.when(F.col("was_quiet"), "retry_wait").otherwise(F.col("was.status")) == F.col("status"))
    own = alive.where(~F.coalesce(same, F.lit(False))).select("job_id", "attempt", "status", F.col("ts").alias("at"))
    given_up = F.when(F.col("attempt") >= MAX_ATTEMPTS, "failed").otherwise("retry_wait")
    return own.unionByName(alive.where("quiet").select("job_id", "attempt", given_up.alias("status"), ends.alias("at")))


def promotion(candidates: DataFrame, changes: DataFrame) -> DataFrame:
    """(target_id, decision) for ready candidates (ST4, J9): the newest version of a document serves; others are retired.

    ``candidates``: target_id, document_id, version, deleted, kb_active; ``changes``: document_id, version of the source
    change log. The first reason wins: deleted, inactive, superseded, later_change.
    """
    newest = changes.groupBy("document_id").agg(F.max("version").alias("latest"))
    best = F.max("version").over(Window.partitionBy("document_id"))
    rows = candidates.withColumn("best", best).join(newest, "document_id", "left")
    return rows.select("target_id", F.when(F.col("deleted"), "retired:deleted").when(~F.col("kb_active"), "retired:inactive").when(F.col("version") < F.col("best"), "retired:superseded").when(F.col("latest") > F.col("version"), "retired:later_change").otherwise("serving").alias("decision"))


def served(targets: DataFrame, decisions: DataFrame) -> DataFrame:
    """``targets`` after a promotion: a document's former target retires when another one is promoted."""
    rows = targets.join(decisions, "target_id", "left")
    wins = F.max(F.when(F.col("decision") == "serving", 1).otherwise(0)).over(Window.partitionBy("document_id"))
    status = F.when(F.col("decision") == "serving", "serving").when(F.col("decision").isNotNull(), "retired").when((F.col("serving_status") == "serving") & (wins == 1), "retired").otherwise(F.col("serving_status"))
    return rows.withColumn("serving_status", status).drop("decision")


def replays(requests: DataFrame) -> DataFrame:
    """``requests`` (key, seq, hash) with ``outcome``: applied, replayed (same hash as the first) or rejected (ST9)."""
    w = Window.partitionBy("key").orderBy("seq")
    first = F.first("hash").over(w)
    return requests.withColumn("outcome", F.when(F.row_number().over(w) == 1, "applied").when(F.col("hash").eqNullSafe(first), "replayed").otherwise("rejected"))


def live_documents(changes: DataFrame) -> DataFrame:
    """(document_id, version): documents whose last change is no deletion (ST10)."""
    last = changes.groupBy("document_id").agg(F.max_by(F.struct("version", "operation"), "seq").alias("x"))
    return last.where("x.operation <> 'delete'").select("document_id", "x.version")


def cleanup_due(retired: DataFrame, now: Column, n: int) -> DataFrame:
    """Retired targets whose time has come, oldest first (ST11)."""
    return retired.where(F.col("due_at") <= now).orderBy("due_at", "target_id").limit(n)


def delivered(preview: DataFrame, stored: DataFrame) -> DataFrame:
    """One state a run from two event lists (run_id, seq, state): a stored terminal state wins, else the last event (ST8)."""
    both = preview.withColumn("sure", F.lit(0)).unionByName(stored.withColumn("sure", F.when(F.col("state").isin(*TERMINAL), 2).otherwise(1)))
    return both.groupBy("run_id").agg(F.max_by("state", F.struct((F.col("sure") == 2).cast("int"), "seq", "sure")).alias("state"))


def completeness(expected: DataFrame, stored: DataFrame, key: str, content: str) -> DataFrame:
    """One row: expected, stored, missing, surplus and changed keys (AG20, AG24)."""
    a, b = expected.select(key, F.col(content).alias("a")), stored.select(key, F.col(content).alias("b"))
    both = a.withColumn("in_a", F.lit(True)).join(b.withColumn("in_b", F.lit(True)), key, "full_outer")
    return both.agg(
        F.count("in_a").alias("expected"), F.count("in_b").alias("stored"), F.count_if(F.col("in_b").isNull()).alias("missing"),
        F.count_if(F.col("in_a").isNull()).alias("surplus"), F.count_if(F.col("in_a") & F.col("in_b") & ~F.col("a").eqNullSafe(F.col("b"))).alias("changed"),
    )


def duplicates(rows: DataFrame, *keys: str) -> DataFrame:
    """Keys that occur more than once (AG22): a unique index as a check."""
    return rows.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")
