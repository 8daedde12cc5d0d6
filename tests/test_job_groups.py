"""Jobs of a stream share the states of groups, and odd events give what SQL gives."""

import datetime as dt
import glob

import duckdb
import pytest
from conftest import canonical
from pyspark.sql import functions as F

from lectern.operators import lifecycle
from lectern.plans import registry
from lectern.streaming import jobs

registry.load()
START = dt.datetime(2024, 1, 1)


@pytest.fixture
def own_folder(tmp_path, monkeypatch):
    """Streams of a test keep their files apart from those of other tests."""
    monkeypatch.setattr(jobs, "shared_folder", lambda spark: tmp_path.as_uri())
    return tmp_path


def test_jobs_share_states_and_a_stream_its_tasks(spark, own_folder):
    rows = [(i, START + dt.timedelta(seconds=i), i % 600, 1 + i % 7 % 3, "completed" if i % 11 == 0 else "running") for i in range(3000)]
    df = spark.createDataFrame(rows, "event_id long, ts timestamp, job_id long, attempt long, status string")
    df.write.parquet(f"{own_folder}/in")
    stream = spark.readStream.schema(df.schema).parquet(f"{own_folder}/in")
    got = jobs.drained(jobs.job_states(stream, lateness="60 seconds", silence=400))
    want = lifecycle.state_changes(df, F.lit(START + dt.timedelta(seconds=2999 - 60)), 400)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    (progress,) = glob.glob(f"{own_folder}/stream-*/progress")
    assert spark.read.format("statestore").load(progress).count() <= jobs.JOB_GROUPS  # 600 before, a call of Python each
    usual = spark.conf.get("spark.sql.shuffle.partitions")
    again = jobs.drained(jobs.job_states(stream, lateness="60 seconds", silence=400), tasks=2)
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, want.collect()))
    assert sorted(len(glob.glob(f"{at}/state/0/[0-9]*")) for at in glob.glob(f"{own_folder}/stream-*/progress")) == [2, int(usual)]
    assert spark.conf.get("spark.sql.shuffle.partitions") == usual


def test_events_without_a_user_or_value(spark, duck, own_folder):
    odd = """SELECT event_id, date_trunc('hour', ts) AS ts, CASE WHEN event_id % 7 > 0 THEN user_id % 50 END AS user_id, event_type,
        CASE WHEN event_id % 5 > 0 THEN value END AS value, props FROM events"""
    duck.execute(f"COPY ({odd}) TO '{own_folder}/events.parquet'")
    df = registry.QUERIES["stream_job_states"](spark, str(own_folder))
    mine = canonical(df.collect(), df.columns)
    own = duckdb.connect()
    own.execute(f"CREATE VIEW events AS FROM '{own_folder}/events.parquet'")
    found = own.execute(registry.ORACLES["stream_job_states"])
    assert mine == canonical(found.fetchall(), [d[0] for d in found.description])
    assert any("None" in row for row in mine[1])
