"""Versions, keyed tables, the search index, ingestion by key state and reclaimed jobs."""

import datetime
import random
import time
import uuid
from collections import Counter

import pytest
from pyspark.sql import functions as F

from scrutable.functions import text as X
from scrutable.sources.keyed import KeyedTable
from scrutable.sources.search import SearchIndex, blocks, literals
from scrutable.sources.store import Runs, Store, Versions
from scrutable.streaming import events


@pytest.fixture
def store(spark):
    return Store(spark, uuid.uuid4().hex)


def test_a_failing_refresh_leaves_the_old_version_readable(spark, store):
    first = store.table("t", lambda: spark.range(3))
    assert first.count() == 3

    def bad():
        return spark.range(5).select(F.when(F.col("id") == 4, F.raise_error(F.lit("no"))).otherwise(F.col("id")).cast("long").alias("id"))

    with pytest.raises(Exception, match="no"):
        store.table("t", bad, again=True)
    assert store.table("t", bad).count() == 3
    assert store.table("t", lambda: spark.range(7), again=True).count() == 7
    assert first.count() == 3  # who has begun on the version before goes on
    assert store.table("t", bad).count() == 7


def test_two_writers_never_share_a_number(spark, store):
    one, two = Versions(spark, f"{store.folder}/x"), Versions(spark, f"{store.folder}/x")
    a, b = one.claim(), two.claim()
    assert a != b and one.current() is None
    two.complete(b)
    assert one.current() == b
    runs = Runs(store, "r"), Runs(store, "r")
    assert runs[0].open() != runs[1].open()


def test_keyed_merges_equal_a_dictionary_and_write_few_buckets(spark, store):
    rng, table, want = random.Random(1), KeyedTable(store, "k", ["a", "b"], buckets=16), {}
    assert table.read() is None
    for n in (400, 3, 0, 120):
        batch = {(rng.randint(0, 300), rng.choice(["x", "y"])): rng.choice([None, 1, 2]) for _ in range(n)}
        changed = {k for k, v in batch.items() if k not in want or want[k] != v}
        rows = spark.createDataFrame([(*k, v) for k, v in batch.items()], "a long, b string, v int")
        dirty = table.merge(rows)
        want |= batch
        got = {} if table.read() is None else {(r.a, r.b): r.v for r in table.read().collect()}
        assert got == want and table.read().count() == len(want)
        assert len(dirty) <= len(changed) and (n != 3 or len(dirty) <= 3)
        before = set(table._folders().values())
        assert table.merge(rows) == [] and set(table._folders().values()) == before
    assert table.changes().where("v = 1").count() == table.read(version=1).count()
    with pytest.raises(Exception, match="a key is null"):
        table.merge(spark.createDataFrame([(None, "x", 1)], "a long, b string, v int"))


def test_a_failed_merge_changes_nothing(spark, store):
    table = KeyedTable(store, "f", ["a"], buckets=4)
    table.merge(spark.range(20).select(F.col("id").alias("a"), F.lit(1).alias("v")))
    real, table.versions.complete = table.versions.complete, lambda n: 1 / 0
    with pytest.raises(ZeroDivisionError):
        table.merge(spark.range(20).select(F.col("id").alias("a"), F.lit(2).alias("v")))
    table.versions.complete = real
    assert {r.v for r in table.read().collect()} == {1}
    table.merge(spark.range(20).select(F.col("id").alias("a"), F.lit(3).alias("v")))
    assert {r.v for r in table.read().collect()} == {3}


def test_literals_of_patterns():
    assert literals("ab%c_d") == ["ab", "c", "d"] and literals(r"a\%b\\") == [r"a%b\ ".strip()] and literals("%_") == []


def test_search_equals_scan(spark, store):
    rng = random.Random(2)
    words = ["Mélenchon", "melon", "Ça", "été", "ab", "zz%z", "x_y", "🙂abc", "straße", "Œuvre", "a\\b"]
    rows = [(i, " ".join(rng.choices(words, k=rng.randint(0, 6)))) for i in range(300)] + [(300, None), (301, ""), (302, "éà"), (None, "melon"), (7, "Mélenchon twice")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    index = SearchIndex(store, "s", buckets=8, shards=8).build(df, "doc_id", F.col("text"))
    for q in ["melenchon", "MÉLEN", "mel%ab", "e_t", "ca", "", "%", "zz\\%z", "x\\_y", "nothing here", "🙂ab", "été été", "strasse", "on mel%ete%"]:
        want = sorted(map(str, (r.doc_id for r in df.where(X.matches(X.unaccent(F.col("text")), q)).collect())))
        for small in (100_000, 0):
            assert sorted(str(r.key) for r in index.search(q, small=small).collect()) == want, q


def test_search_reads_only_the_postings_of_its_grams(spark, store):
    rows = spark.range(3000).select("id", F.concat(F.lit("text "), F.when(F.col("id") == 77, "needle").otherwise("hay"), F.col("id").cast("string")).alias("text"))
    index = SearchIndex(store, "p", buckets=32, shards=32).build(rows, "id", F.col("text"))
    keys = index.candidates("needle")
    plan = keys._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(bucket" in plan and "EqualTo(gram," in plan
    found = index.search("needle")
    opened = {f.split("shard=")[1].split("/")[0] for f in found.inputFiles() if "shard=" in f}
    assert [r.key for r in found.collect()] == [77] and len(opened) <= 32
    texts = [f for f in index._read("texts").where(F.col("shard").isin([r[0] for r in keys.select(F.pmod(F.xxhash64("key"), F.lit(32))).collect()])).select("_metadata.file_path").distinct().collect()]
    assert len(texts) == 1


def test_ingestion_opens_only_its_buckets_and_a_replay_changes_nothing(spark, store, tmp_path):
    index, out = KeyedTable(store, "index", ["id"], buckets=8), str(tmp_path / "out")
    source = tmp_path / "in"
    schema = "id long, v long"
    for batch in range(5):
        spark.range(batch * 10, batch * 10 + 25).selectExpr("id", f"id * 10 + {batch} AS v").coalesce(1).write.mode("append").parquet(str(source))
        stream = spark.readStream.schema(schema).parquet(str(source))
        events.ingest_keyed(stream, index, out, str(tmp_path / "check")).awaitTermination()
        one = spark.createDataFrame([(3,)], "id long")
        assert len(index.known(one).inputFiles()) == 1  # however many batches there were
    got = {r.id: r.v for r in spark.read.parquet(out).collect()}
    assert sorted(got) == list(range(65)) and spark.read.parquet(out).count() == 65
    assert all(v == i * 10 + max(0, (i - 15) // 10) for i, v in got.items())
    again = spark.readStream.schema(schema).parquet(str(source))
    events.ingest_keyed(again, index, out, str(tmp_path / "other")).awaitTermination()
    assert {r.id: r.v for r in spark.read.parquet(out).collect()} == got and spark.read.parquet(out).count() == 65


def test_a_batch_broken_off_after_its_keys_is_written_whole_again(spark, store, tmp_path, monkeypatch):
    index, out = KeyedTable(store, "broken", ["id"], buckets=4), str(tmp_path / "out")
    spark.range(30).selectExpr("id", "id AS v").write.parquet(str(tmp_path / "in"))
    start = lambda: events.ingest_keyed(spark.readStream.schema("id long, v long").parquet(str(tmp_path / "in")), index, out, str(tmp_path / "check"))
    real = index.merge

    def broken(rows):
        real(rows.where("id < 10"))
        raise RuntimeError("lost")

    monkeypatch.setattr(index, "merge", broken)
    with pytest.raises(Exception, match="lost"):
        start().awaitTermination()
    monkeypatch.setattr(index, "merge", real)
    start().awaitTermination()
    assert sorted(r.id for r in spark.read.parquet(out).collect()) == list(range(30)) and index.read().count() == 30


def test_reclaim_by_attempts(spark):
    now = datetime.datetime(2024, 1, 1, 12)
    jobs = spark.createDataFrame([(1, "running", "w1", 1, 3, None), (2, "running", "w2", 1, 3, None), (3, "running", "w2", 3, 3, "old"), (4, "running", None, 3, 3, None), (5, "done", "w2", 1, 3, None), (6, "running", "w3", 1, 3, None)], "id long, status string, owner string, attempts int, max_attempts int, error string")
    beats = spark.createDataFrame([("w1", now - datetime.timedelta(seconds=59)), ("w2", now - datetime.timedelta(seconds=60))], "worker_id string, last_seen_at timestamp")
    got = {r.id: (r.status, r.owner, r.error) for r in events.reclaim(jobs, beats, now).collect()}
    gone = events.RECLAIMED
    assert got == {1: ("running", "w1", None), 2: ("pending", None, gone), 3: ("failed", None, "old"), 4: ("running", None, None), 5: ("done", "w2", None), 6: ("pending", None, gone)}


def test_silent_and_late_workers(spark, tmp_path):
    at = lambda s: datetime.datetime(2024, 1, 1, 12) + datetime.timedelta(seconds=s)
    batches = [
        [("a", at(0), "claim", 1, 1, 3), ("a", at(1), "claim", 2, 3, 3), ("b", at(0), "claim", 3, 1, 3), ("c", at(5), "claim", 4, 1, 3)],
        [("b", at(40), "beat", None, None, None), ("c", at(50), "done", 4, 1, 3), ("c", at(51), "done", 4, 1, 3)],
        [("b", at(90), "beat", None, None, None)],
        [("a", at(95), "done", 1, 1, 3), ("b", at(96), "done", 3, 1, 3)],
        [("z", at(400), "beat", None, None, None)],
        [("z", at(401), "beat", None, None, None)],
    ]
    schema = "worker_id string, ts timestamp, kind string, job_id long, attempts int, max_attempts int"
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / f"in/{i}"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("latestFirst", "false").parquet(str(tmp_path / "in/*"))
    q = events.reclaimed_stream(stream).writeStream.format("memory").queryName("reclaimed").outputMode("append").option("checkpointLocation", str(tmp_path / "check")).start()
    q.processAllAvailable()
    q.stop()
    got = sorted((r.job_id, r.worker_id, r.status) for r in spark.table("reclaimed").collect())
    assert got == [(1, "a", "pending"), (2, "a", "failed"), (3, "b", "done"), (4, "c", "done")]


def test_entries_of_one_archive_are_spread_over_tasks(spark, tmp_path):
    import hashlib
    import zipfile

    from scrutable.sources.archives import read_zips

    with zipfile.ZipFile(tmp_path / "a.zip", "w") as z:
        for i in range(100_000):
            z.writestr(f"json/{'acteur/' if i % 3 == 0 else ''}PA{i}.json" if i % 50 else f"other/{i}.txt", f'{{"n": {i}}}')
    with zipfile.ZipFile(tmp_path / "b.zip", "w") as z:
        z.writestr("json/organe/PO1.json", '{"é": 1}')
    zipfile.ZipFile(tmp_path / "c.zip", "w").close()
    docs = read_zips(spark, str(tmp_path))
    assert docs.rdd.getNumPartitions() == 51
    rows = docs.drop("raw").withColumn("part", F.spark_partition_id()).collect()
    assert max(Counter(r.part for r in rows).values()) <= 2000
    got = {(r.archive.rsplit("/", 1)[1], r.category, r.uid): r.content_hash for r in rows}
    want = {("b.zip", "organe", "PO1"): hashlib.sha256('{"é": 1}'.encode()).hexdigest()}
    with zipfile.ZipFile(tmp_path / "a.zip") as z:
        for name in z.namelist():
            parts = name.split("/")
            if parts[0] == "json":
                want["a.zip", parts[1] if len(parts) > 2 else "", parts[-1][:-5]] = hashlib.sha256(z.read(name)).hexdigest()
    assert got == want


def test_postings_are_blocks_of_keys(spark, store):
    """Far fewer rows than pairs of a text and a gram, whose counts and keys are those of all texts; nothing is computed twice to find ranges."""
    rows = spark.range(500).selectExpr("id", "concat('aaaa common é ', id % 7) AS text")
    index = SearchIndex(store, "b", buckets=4, shards=4).build(rows, "id", F.col("text"))
    want = {}
    for r in rows.collect():
        text = r.text.replace("é", "e")
        for g in {text[i : i + 3] for i in range(len(text) - 2)}:
            want.setdefault(g, set()).add(r.id)
    assert {r.gram: r.n for r in index.counts().collect()} == {g: len(ids) for g, ids in want.items()}
    assert all({r.key for r in index.postings(g).collect()} == want[g] for g in ("com", " e ", "e 3"))
    assert index._read("postings").count() * 10 < sum(map(len, want.values()))


def test_wildcards_between_runs_are_linear(spark):
    """LIKE tries every place of the first run against every place of the second; here that takes minutes for one text."""
    long = spark.range(1).select(F.repeat(F.lit("the ou "), 200_000).alias("text"))
    begun = time.monotonic()
    assert long.where(X.matches(F.col("text"), "the%ou_nt%the%zz")).count() == 0
    assert time.monotonic() - begun < 20
    cases = spark.createDataFrame([("a.the\nouxnt!",), ("ount the",), ("the ou.nt (x)",), ("theount",)], "text string").coalesce(1)
    assert [r[0] for r in cases.select(X.matches(F.col("text"), "ThÉ%où_nt")).collect()] == [True, False, True, False]
    assert [r[0] for r in cases.select(X.matches(F.col("text"), "the%(_)%")).collect()] == [False, False, True, False]


def test_blocks_cut_inside_a_batch_lose_nothing(spark):
    texts = ["", "ab", "🙂abc", "aaaa", None, "xyz abc", "abcabc"]
    rows = spark.createDataFrame(list(enumerate(texts)), "key int, text string").coalesce(1)
    want = sorted((i, g) for i, t in enumerate(texts) if t for g in {t[j : j + 3] for j in range(len(t) - 2)})
    for most in (1, 3, 1000):
        found = blocks(rows, most).collect()
        assert sorted((k, r.gram) for r in found for k in r["keys"]) == want and all(r.n == len(r["keys"]) for r in found)
