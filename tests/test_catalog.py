"""Every query against its SQL in DuckDB, and the streaming side."""

import datetime
import os

import duckdb
import numpy as np
import pandas as pd
import pytest

from scrutable.plans import catalog, ingest_queries, run_queries  # noqa: F401
from scrutable.streaming import events

FOLDER = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables here")


def cell(v):
    if v is None or v is pd.NaT or v is pd.NA or (isinstance(v, float) and np.isnan(v)):
        return ""
    if isinstance(v, (bool, np.bool_)):
        return str(bool(v))
    if isinstance(v, (int, float, np.integer, np.floating)):
        return f"{float(v):.9g}"
    if isinstance(v, (datetime.date, pd.Timestamp, np.datetime64)):
        return str(pd.Timestamp(v))[:19]
    return str(v)


def rows(df):
    return sorted(tuple(cell(v) for v in r) for r in df[sorted(df.columns)].itertuples(index=False))


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.sql("SET timezone = 'UTC'")
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_same_rows_as_sql(spark, duck, name):
    got, want = catalog.QUERIES[name](spark, FOLDER).toPandas(), duck.sql(catalog.ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


def test_stream_windows_equal_batch(spark, tmp_path):
    table = spark.read.parquet(f"{FOLDER}/events.parquet").select("event_id", "ts", "event_type", "value", "user_id")
    table.coalesce(1).orderBy("ts").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(table.schema).parquet(str(tmp_path / "in"))
    q = events.windowed(stream).writeStream.outputMode("append").format("memory").queryName("windows").start()
    q.processAllAvailable()
    q.stop()
    got = {(r.debut, r.event_type): r.n for r in spark.table("windows").collect()}
    want = {(r.w.start, r.event_type): r["count"] for r in table.dropDuplicates(["event_id"]).selectExpr("window(ts, '1 hour') AS w", "event_type").groupBy("w", "event_type").count().collect()}
    assert got and all(want[k] == n for k, n in got.items())


def test_ingest_twice_changes_nothing(spark, tmp_path):
    table = spark.range(50).selectExpr("id", "id * 2 AS v")
    table.write.parquet(str(tmp_path / "in"))
    for run in ("a", "b"):
        stream = spark.readStream.schema(table.schema).parquet(str(tmp_path / "in"))
        events.ingest(stream, str(tmp_path / "out"), str(tmp_path / f"check-{run}"), ["id"]).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 50


def test_stale_jobs(spark):
    now = datetime.datetime(2024, 1, 1, 12)
    jobs = spark.createDataFrame([(1, "running", "w1"), (2, "running", "w2"), (3, "done", "w3")], "id long, status string, owner string")
    beats = spark.createDataFrame([("w1", now - datetime.timedelta(seconds=30)), ("w2", now - datetime.timedelta(seconds=90))], "worker_id string, last_seen_at timestamp")
    assert [r.id for r in events.stale_jobs(jobs, beats, now).collect()] == [2]
