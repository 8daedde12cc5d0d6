"""Jobs, heartbeats and requests as streams: the event-time forms of ``lectern.operators.lifecycle``."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from lectern.operators.lifecycle import MAX_ATTEMPTS, STALE_SECONDS, TERMINAL
from lectern.sources.steps import shared_folder

#: How late an event may come; the same as the silence after which a job is stale.
LATENESS = f"{STALE_SECONDS} seconds"
#: Jobs are dealt by a hash to so many groups, and a group has one state.
JOB_GROUPS = 256


def unique_requests(events: DataFrame, key: str = "key", ts: str = "ts", lateness: str = LATENESS) -> DataFrame:
    """The first request of each key within the watermark (ST9)."""
    return events.withWatermark(ts, lateness).dropDuplicatesWithinWatermark([key])


def windowed_counts(events: DataFrame, ts: str = "ts", width: str = "1 hour", by: str = "event_type", lateness: str = LATENESS) -> DataFrame:
    """Counts a window and kind; a window is final once the watermark passed it."""
    return events.withWatermark(ts, lateness).groupBy(F.window(ts, width), by).agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), by, "n")


def _packed(rows: pa.Table) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, rows.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        out.write_table(rows)
    return sink.getvalue().to_pybytes()


def _unpacked(packed: bytes) -> pa.Table:
    return pa.ipc.open_stream(packed).read_all()


def job_states(beats: DataFrame, ts: str = "ts", lateness: str = LATENESS, silence: int = STALE_SECONDS, groups: int = JOB_GROUPS) -> DataFrame:
    """(job_id, attempt, status, at): changes of state of each job from its events (ST1 to ST3), in event time.

    ``beats``: job_id, ts, attempt, status, event_id. Events wait in the state until the watermark has passed them, so
    those that come out of order count in theirs, and the changes are those of ``lifecycle.state_changes`` as of the
    watermark. Events of an older attempt than the state's are ignored, terminal states are final, and an event-time timer
    after so many seconds of silence sets a job to retry_wait, or to failed after three attempts. Python is called once a
    group of jobs and trigger, as a call costs far more than an event. A state holds the last state of each job of its group
    and their events within the watermark's delay; ``groups`` can't change between runs of one checkpoint.
    """
    quiet = silence * 1_000_000
    whole = isinstance(beats.schema["event_id"].dataType, T.IntegralType)
    events = pa.schema([("job_id", pa.int64()), ("at", pa.int64()), ("attempt", pa.int64()), ("event_id", pa.int64() if whole else pa.string()), ("status", pa.string())])
    states = pa.schema([("job_id", pa.int64()), ("attempt", pa.int64()), ("status", pa.string()), ("last", pa.int64())])

    def update(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        known, waiting = map(_unpacked, state.get) if state.exists else (states.empty_table(), events.empty_table())
        if not state.hasTimedOut:
            waiting = pa.concat_tables([waiting, *(pa.Table.from_pandas(frame, events, preserve_index=False) for frame in frames)])
        now = max(state.getCurrentWatermarkMs(), 0) * 1000  # microseconds
        passed = pc.less(waiting["at"], now)
        due = waiting.filter(passed).sort_by([(c, "ascending") for c in ("job_id", "at", "attempt", "event_id")])  # nulls last
        waiting = waiting.filter(pc.invert(passed))
        held = {job: past for job, *past in zip(*(c.to_pylist() for c in known.columns))}
        out, before = [], None

        def silent_until(at: int, job: int | None) -> None:
            attempt, status, last = past = held[job]
            if status == "running" and at > last + quiet:
                past[1] = "failed" if attempt is not None and attempt >= MAX_ATTEMPTS else "retry_wait"
                out.append((job, attempt, past[1], last + quiet))

        for event in zip(*(c.to_pylist() for c in due.columns)):
            if event == before:  # it came again
                continue
            before = event
            job, at, number, _, told = event
            past = held.setdefault(job, [None, "", 0])
            if past[1] in TERMINAL or (past[0] is not None and (number is None or number < past[0])):
                continue
            silent_until(at, job)
            if past[1] in TERMINAL:
                continue
            if number is None or [number, told] != past[:2]:
                out.append((job, number, told, at))
            past[:] = number, told, at
        for job in held:
            silent_until(now, job)
        known = pa.table([[*held], *([past[n] for past in held.values()] for n in range(3))], schema=states)
        state.update((_packed(known), _packed(waiting)))
        wake = [pc.min(waiting["at"]).as_py()] if waiting.num_rows else []
        wake += [last + quiet for _, status, last in held.values() if status == "running"]
        if wake:
            state.setTimeoutTimestamp(max(min(wake) // 1000, state.getCurrentWatermarkMs()))
        if out:
            yield pd.DataFrame(out, columns=["job_id", "attempt", "status", "at"], dtype=object)  # a null turns no id into a float

    dealt = beats.withWatermark(ts, lateness).select(
        F.pmod(F.xxhash64(F.col("job_id").cast("long")), F.lit(groups)).alias("group_"), F.col(ts).alias("ts"), F.unix_micros(F.col(ts)).alias("at"),
        F.col("job_id").cast("long").alias("job_id"), F.col("attempt").cast("long").alias("attempt"), F.col("event_id").cast("long" if whole else "string").alias("event_id"), "status",
    )
    changes = dealt.groupBy("group_").applyInPandasWithState(update, "job_id long, attempt long, status string, at long", "known binary, waiting binary", "append", GroupStateTimeout.EventTimeTimeout)
    return changes.withColumn("at", F.timestamp_micros("at"))


def replayed(events: DataFrame, parts: int, late: int, ts: str = "ts", key: str = "event_id") -> tuple[DataFrame, int]:
    """``events`` as a stream of files in order of arrival, a part a trigger, and the delay in seconds that its watermark needs.

    An event comes up to half of ``late`` seconds late, by a hash; every tenth comes again by the other half later. Files of a
    part may be taken in any order, so the delay is ``late`` and a part's width.
    """
    spark, half = events.sparkSession, late // 2
    come = events.withColumn("come_", F.unix_timestamp(ts) + F.pmod(F.xxhash64(key), F.lit(half)))
    again = come.where(F.pmod(F.xxhash64(key, F.lit(7)), F.lit(10)) == 0).withColumn("come_", F.col("come_") + half)
    both = come.unionByName(again)
    first, last = both.agg(F.min("come_"), F.max("come_")).first()
    width = max(1, -(-((last or 0) - (first or 0) + 1) // parts))
    root = f"{shared_folder(spark)}/replay-{uuid.uuid4().hex}"
    both.withColumn("part_", F.floor((F.col("come_") - F.lit(first or 0)) / width).cast("int")).drop("come_").write.partitionBy("part_").parquet(f"{root}/dealt")
    dealt = spark.read.schema(T.StructType([*events.schema.fields, T.StructField("part_", T.IntegerType())])).parquet(f"{root}/dealt")
    for n in range(parts):  # a part is a partition's folder; files are taken in order of the time they were written
        dealt.where(F.col("part_") == n).select(*events.columns).write.mode("append").parquet(f"{root}/landed")
    files = len(spark.read.schema(events.schema).parquet(f"{root}/landed").inputFiles())
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", max(1, files // parts)).parquet(f"{root}/landed")
    return stream, late + width


def drained(stream: DataFrame, tasks: int | None = None) -> DataFrame:
    """What a stream has given when all that is available is taken: its appended files, read back.

    Its state has a part and a task a trigger for each shuffle partition of the session, or ``tasks`` where these are fewer.
    """
    root, conf = f"{shared_folder(stream.sparkSession)}/stream-{uuid.uuid4().hex}", stream.sparkSession.conf
    usual = conf.get("spark.sql.shuffle.partitions")
    try:  # a stream keeps the settings it started with
        conf.set("spark.sql.shuffle.partitions", min(int(usual), tasks or int(usual)))
        run = stream.writeStream.format("parquet").option("path", f"{root}/out").option("checkpointLocation", f"{root}/progress").outputMode("append").trigger(availableNow=True).start()
    finally:
        conf.set("spark.sql.shuffle.partitions", usual)
    run.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{root}/out")


def rate_limited(progress: DataFrame, path: str, checkpoint: str, seconds: int = 1):
    """Writes the last progress of each run in each trigger (ST6): one small batch an interval. A payload above 4,000 bytes
    is not delivered; its row says so."""

    def last_of_each(batch: DataFrame, batch_id: int) -> None:
        last = batch.groupBy("run_id").agg(F.max_by("payload", "seq").alias("payload"), F.max("seq").alias("seq"))
        last = last.withColumn("oversized", F.coalesce(F.octet_length("payload") > 4000, F.lit(False)))
        last.withColumn("payload", F.when(~F.col("oversized"), F.col("payload"))).write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return progress.writeStream.foreachBatch(last_of_each).option("checkpointLocation", checkpoint).trigger(processingTime=f"{seconds} seconds")
