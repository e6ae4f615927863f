"""Tables written once and read many times, and runs of results of which readers see the current one.

Everything lies in the folder that spark.checkpoint.dir names, which all machines share; only a local session
may leave that setting out.
"""

from __future__ import annotations

import hashlib
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

_LOCAL: dict[str, str] = {}
_DONE: set[str] = set()


def shared_base(spark: SparkSession) -> str:
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all machines share")
        base = _LOCAL.setdefault("base", "file://" + tempfile.mkdtemp(prefix="scrutable-store-"))
    return base.rstrip("/")


def settled(df: DataFrame) -> DataFrame:
    """The rows written to the shared folder and read back: what depends on partitions stays as it was written."""
    path = f"{shared_base(df.sparkSession)}/scrutable-steps-{df.sparkSession.sparkContext.applicationId}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


class Versions:
    """Numbered folders of which readers see the last complete one.

    A writer claims a number by a file that must not exist yet, so two writers never share one; it fills the
    number's folder, and a second such file, written last, makes it current. A writer that fails leaves readers
    where they were. The version before the current one stays for readers that have begun on it.
    """

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(folder).getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())

    def _numbers(self, kind: str) -> list[int]:
        at = self._path(f"{self.folder}/{kind}")
        return sorted(int(x.getPath().getName()) for x in self._fs.listStatus(at)) if self._fs.exists(at) else []

    def claim(self) -> int:
        n = (self._numbers("_claimed") or [0])[-1] + 1
        while not self._fs.createNewFile(self._path(f"{self.folder}/_claimed/{n:09d}")):
            n += 1
        return n

    def complete(self, n: int) -> None:
        self._fs.createNewFile(self._path(f"{self.folder}/_complete/{n:09d}"))

    def current(self) -> int | None:
        return (self._numbers("_complete") or [None])[-1]

    def path(self, n: int) -> str:
        return f"{self.folder}/v={n}"

    def write(self, fill: Callable[[str], None], keep: int = 2) -> int:
        """Fill a new version's folder and make it current; only the last `keep` complete ones stay."""
        n = self.claim()
        fill(self.path(n))
        self.complete(n)
        for old in self._numbers("_complete")[:-keep]:
            self._fs.delete(self._path(self.path(old)), True)
            self._fs.delete(self._path(f"{self.folder}/_complete/{old:09d}"), False)
        return n

    def folders(self, pattern: str) -> list[str]:
        """Folders below this one that match, in order."""
        found = self._fs.globStatus(self._path(f"{self.folder}/{pattern}"))
        return sorted(x.getPath().toString() for x in found or [])


class Store:
    """The tables derived from one dataset, for one application."""

    def __init__(self, spark: SparkSession, dataset: str):
        self.spark = spark
        self.folder = f"{shared_base(spark)}/scrutable-store-{spark.sparkContext.applicationId}/{hashlib.md5(dataset.encode()).hexdigest()}"

    def table(self, name: str, derive: Callable[[], DataFrame], by: str | None = None, again: bool = False) -> DataFrame:
        """The stored table, written first if it is missing; ordered by `by`, so that readers of one key skip the rest.

        With `again` a new version is written beside the old one and takes its place when it is whole.
        """
        versions = Versions(self.spark, f"{self.folder}/{name}")
        if again or versions.current() is None:
            rows = derive()
            rows = rows.repartitionByRange(by).sortWithinPartitions(by) if by else rows
            versions.write(lambda path: rows.write.parquet(path))
        return self.spark.read.parquet(versions.path(versions.current()))


class Runs:
    """Results of numbered runs: tables with a folder a run, and a ledger that only grows.

    A run is opened, writes its tables, and is published by one row of the ledger, which is what makes it
    current; until then, and if it fails, readers keep the run before. Old runs stay readable.
    """

    LEDGER = "run_id long, at timestamp, status string, counters string"

    def __init__(self, store: Store, name: str):
        self.spark, self.folder = store.spark, f"{store.folder}/{name}"

    def ledger(self) -> DataFrame:
        path = f"{self.folder}/ledger"
        if path not in _DONE:
            self.spark.createDataFrame([], self.LEDGER).write.mode("append").parquet(path)
            _DONE.add(path)
        return self.spark.read.schema(self.LEDGER).parquet(path)

    def _note(self, run_id: int, status: str, counters: str | None = None) -> None:
        row = self.spark.range(1).select(F.lit(run_id).cast("long").alias("run_id"), F.current_timestamp().alias("at"), F.lit(status).alias("status"), F.lit(counters).cast("string").alias("counters"))
        row.coalesce(1).write.mode("append").parquet(f"{self.folder}/ledger")

    def open(self) -> int:
        run_id = Versions(self.spark, f"{self.folder}/ids").claim()
        self._note(run_id, "started")
        return run_id

    def write(self, run_id: int, name: str, rows: DataFrame, by: str | None = None) -> DataFrame:
        rows = rows.repartitionByRange(by).sortWithinPartitions(by) if by else rows
        rows.write.mode("overwrite").parquet(f"{self.folder}/{name}/run_id={run_id}")
        return self.read(run_id, name)

    def read(self, run_id: int, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}/run_id={run_id}")

    def publish(self, run_id: int, counters: str | None = None) -> None:
        self._note(run_id, "published", counters)

    def fail(self, run_id: int, why: str) -> None:
        self._note(run_id, "failed", why)

    def runs(self) -> DataFrame:
        """(run_id, status, at, counters, is_current): the last word on each run, one current at most."""
        last = self.ledger().groupBy("run_id").agg(F.max_by("status", "at").alias("status"), F.max("at").alias("at"), F.max_by("counters", "at").alias("counters"))
        newest = self.ledger().where("status = 'published'").agg(F.max("run_id").alias("newest"))
        return last.crossJoin(F.broadcast(newest)).withColumn("is_current", F.coalesce(F.col("run_id") == F.col("newest"), F.lit(False))).drop("newest")

    def current_id(self) -> int | None:
        return self.ledger().where("status = 'published'").agg(F.max("run_id")).first()[0]

    def current(self, name: str) -> DataFrame:
        return self.read(self.current_id(), name)
