"""Structured Streaming: windows over late events, idempotent ingestion, silent workers, run ledgers."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..sources.keyed import KeyedTable


def windowed(events: DataFrame, late: str = "10 minutes", width: str = "1 hour") -> DataFrame:
    """Count and sum by hour and type; each event counts once, and closed windows drop what comes later.

    A table that is all there gives the same windows, as nothing in it is late.
    """
    timed = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    once = timed.dropDuplicatesWithinWatermark(["event_id"]) if events.isStreaming else timed.dropDuplicates(["event_id"])
    return once.groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("debut"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    s = F.session_window("ts", gap).alias("s")
    return events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late).groupBy(s, "user_id").agg(F.count("*").alias("n")).select("user_id", F.col("s.start").alias("debut"), F.col("s.end").alias("fin"), "n")


def ingest(stream: DataFrame, path: str, checkpoint: str, keys: list[str]):
    """Append rows whose key is not stored yet; running a batch again changes nothing."""

    def write(batch: DataFrame, _: int) -> None:
        new = batch.dropDuplicates(keys)
        try:
            stored = batch.sparkSession.read.schema(batch.schema).parquet(path).select(*keys)
            new = new.join(stored, keys, "left_anti")
        except Exception as error:  # the first batch finds no table
            if "PATH_NOT_FOUND" not in str(error):
                raise
        new.write.mode("append").parquet(path)

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def ingest_keyed(stream: DataFrame, index: KeyedTable, path: str, checkpoint: str):
    """Append rows whose key is not stored yet, looking only into the parts of the key index that a batch falls into.

    `index` holds each key with the batch that brought it. A batch reads the index folders of its own keys, one
    each however many batches there were, writes its new rows to a folder of its own, and then their keys. A
    replayed batch takes its own keys for new and so writes the same folder again; other batches leave known
    rows out, also when they come by another checkpoint. What is written so far is at `path`, by `batch`.
    """
    source = hashlib.md5(checkpoint.encode()).hexdigest()[:12]

    def write(batch: DataFrame, number: int) -> None:
        tag = f"{source}-{number}"
        rows = batch.dropDuplicates(index.keys).persist()
        try:
            known = index.known(rows)
            new = rows if known is None else rows.join(known.where(F.col("batch") != tag).select(*index.keys), index.keys, "left_anti")
            new.write.mode("overwrite").parquet(f"{path}/batch={tag}")
            index.merge(batch.sparkSession.read.schema(batch.schema).parquet(f"{path}/batch={tag}").select(*index.keys).withColumn("batch", F.lit(tag)))
        finally:
            rows.unpersist()

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def silent_workers(beats: DataFrame, silence_ms: int = 60_000) -> DataFrame:
    """(worker_id, last_seen) of workers that stay silent for a minute of event time."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            (last,) = state.get
            state.remove()
            yield pd.DataFrame({"worker_id": [key[0]], "last_seen": [pd.Timestamp(last, unit="ms")]})
            return
        last = max([state.get[0] if state.exists else 0, *(int(b["ts"].max().timestamp() * 1000) for b in batches)])
        state.update((last,))
        state.setTimeoutTimestamp(max(last + silence_ms, state.getCurrentWatermarkMs() + 1))

    return beats.withWatermark("ts", "0 seconds").groupBy("worker_id").applyInPandasWithState(step, "worker_id string, last_seen timestamp", "last long", "append", GroupStateTimeout.EventTimeTimeout)


def stale_jobs(jobs: DataFrame, beats: DataFrame, now) -> DataFrame:
    """Running jobs with an owner who has not been heard of for a minute."""
    alive = beats.where(F.col("last_seen_at") > F.lit(now) - F.expr("INTERVAL 1 MINUTE")).select(F.col("worker_id").alias("owner"))
    return jobs.where("status = 'running' AND owner IS NOT NULL").join(alive, "owner", "left_anti")


RECLAIMED = "reclaimed: worker heartbeat expired"


def reclaim(jobs: DataFrame, beats: DataFrame, now) -> DataFrame:
    """`jobs` with those of silent owners put back, or failed after the last attempt they have.

    Takes (id, status, owner, attempts, max_attempts, error). A reclaimed job has no owner; an error it already
    had stays.
    """
    stale = stale_jobs(jobs, beats, now).select("id", F.lit(True).alias("_stale"))
    rows = jobs.join(stale, "id", "left")
    status = F.when(F.col("attempts") >= F.col("max_attempts"), "failed").otherwise("pending")
    gone = F.col("_stale").isNotNull()
    return rows.withColumns({"status": F.when(gone, status).otherwise(F.col("status")), "owner": F.when(~gone, F.col("owner")), "error": F.when(gone, F.coalesce("error", F.lit(RECLAIMED))).otherwise(F.col("error"))}).drop("_stale")


def reclaimed_stream(happenings: DataFrame, silence_ms: int = 60_000, late: str = "0 seconds") -> DataFrame:
    """(job_id, worker_id, status) as a stream of what workers do: done, and pending or failed once a worker is silent.

    Takes (worker_id, ts, kind, job_id, attempts, max_attempts) of the kinds `beat`, `claim` and `done`. Any of them
    is a sign of life. A minute of event time after a worker's last sign its running jobs are reclaimed: failed if
    the attempt was their last, pending otherwise. A worker that reports one of them done afterwards is not its owner
    any more, and the report is ignored. The state of a worker is its last sign and its running jobs.
    """
    out = ["job_id", "worker_id", "status"]

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last, ids, left = state.get if state.exists else (0, [], [])
        running = dict(zip(ids, left, strict=True))
        if state.hasTimedOut:
            state.remove()
            yield pd.DataFrame([(j, key[0], "failed" if last_try else "pending") for j, last_try in sorted(running.items())], columns=out)
            return
        told = []
        for rows in batches:
            for x in rows.sort_values(["ts", "kind"]).itertuples():
                at = int(x.ts.timestamp() * 1000)
                if running and at >= last + silence_ms:
                    told += [(j, key[0], "failed" if last_try else "pending") for j, last_try in sorted(running.items())]
                    running = {}
                last = max(last, at)
                if x.kind == "claim":
                    running[int(x.job_id)] = bool(x.attempts >= x.max_attempts)
                elif x.kind == "done" and running.pop(int(x.job_id), None) is not None:
                    told.append((int(x.job_id), key[0], "done"))
        state.update((last, list(running), list(running.values())))
        state.setTimeoutTimestamp(max(last + silence_ms - 1, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame(told, columns=out)

    timed = happenings.withWatermark("ts", late)
    return timed.groupBy("worker_id").applyInPandasWithState(step, "job_id long, worker_id string, status string", "last long, jobs array<long>, last_try array<boolean>", "append", GroupStateTimeout.EventTimeTimeout)
