"""Streams over files that come late and again, against their batch forms and a plain loop."""

import datetime as dt
import random

from pyspark.sql import functions as F

from lectern.operators import lifecycle
from lectern.streaming import jobs

START = dt.datetime(2024, 1, 1)


def beats(rng, n=400, jobs_=25):
    kinds = ["queued", "running", "running", "running", "retry_wait", "completed", "cancelled"]
    return [(i, START + dt.timedelta(seconds=rng.randint(0, 40_000), microseconds=rng.randint(0, 999_999)), rng.randint(1, jobs_), rng.randint(1, 3), rng.choice(kinds)) for i in range(n)]


def plain(rows, as_of, silence):
    out = []
    for job in {r[2] for r in rows}:
        attempt, status, last = 0, "", None
        mine = sorted((ts, a, i, s) for i, ts, j, a, s in rows if j == job and ts < as_of)
        for ts, a, _, s in [*mine, (as_of, None, None, None)]:
            if a is not None and (a < attempt or status in lifecycle.TERMINAL):
                continue
            if status == "running" and ts > last + dt.timedelta(seconds=silence):
                status = "failed" if attempt >= 3 else "retry_wait"
                out.append((job, attempt, status, last + dt.timedelta(seconds=silence)))
            if a is None or status in lifecycle.TERMINAL:
                continue
            if (a, s) != (attempt, status):
                out.append((job, a, s, ts))
            attempt, status, last = a, s, ts
    return sorted(out)


def test_stream_and_batch_against_a_plain_loop(spark):
    rows = beats(random.Random(6))
    df = spark.createDataFrame(rows, "event_id long, ts timestamp, job_id long, attempt long, status string")
    stream, delay = jobs.replayed(df, 4, 1800)
    newest = max(r[1] for r in rows)
    as_of = newest.replace(microsecond=newest.microsecond // 1000 * 1000) - dt.timedelta(seconds=delay)
    want = plain(rows, as_of, 900)
    assert {r[2] for r in want} >= {"failed", "retry_wait", "completed", "running"}
    batch = lifecycle.state_changes(df, F.lit(as_of), 900)
    assert sorted(map(tuple, batch.collect())) == want
    assert sorted(map(tuple, lifecycle.state_changes(df.unionByName(df.limit(50)), F.lit(as_of), 900).collect())) == want  # repeated events
    got = jobs.drained(jobs.job_states(stream, lateness=f"{delay} seconds", silence=900))
    assert sorted(map(tuple, got.collect())) == want


def test_repeated_requests_pass_once(spark):
    rows = [(i, START + dt.timedelta(seconds=7 * i), "x") for i in range(300)]
    df = spark.createDataFrame(rows, "event_id long, ts timestamp, kind string")
    stream, delay = jobs.replayed(df, 3, 600)
    arrived = spark.read.parquet(spark.conf.get("spark.checkpoint.dir") + "/replay-*/landed").where("kind = 'x'").count()
    assert arrived > 300
    once = jobs.drained(jobs.unique_requests(stream, "event_id", lateness=f"{delay} seconds"))
    assert sorted(r.event_id for r in once.collect()) == list(range(300))
