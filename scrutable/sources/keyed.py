"""Tables by key that are changed in place of being written anew.

Rows lie in folders by hash of their key. A merge reads the folders that its keys fall into, writes those anew
in which a row is new or differs, and leaves the others; what changed is kept beside them by version. A version
is whole before readers see it, and older folders stay, so a failed merge changes nothing and may be run again.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, functions as F

from ..operators.tables import merge
from .store import Store, Versions, settled


class KeyedTable:
    def __init__(self, store: Store, name: str, keys: list[str], buckets: int = 32):
        self.spark, self.keys, self.buckets = store.spark, keys, buckets
        self.versions = Versions(store.spark, f"{store.folder}/{name}")

    def _bucketed(self, rows: DataFrame) -> DataFrame:
        return rows.withColumn("bucket", F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int"))

    def _folders(self, version: int | None = None) -> dict[int, str]:
        """The newest folder of each bucket as of a complete version: at most `buckets` entries."""
        last = self.versions.current() if version is None else version
        found = {}
        for path in self.versions.folders("v=*/bucket=*"):
            v, b = map(int, re.search(r"/v=(\d+)/bucket=(\d+)$", path).groups())
            if last is not None and v <= last and v in self._complete():
                found[b] = max(found.get(b, (0, "")), (v, path))
        return {b: path for b, (_, path) in found.items()}

    def _complete(self) -> set[int]:
        return set(self.versions._numbers("_complete"))

    def read(self, buckets: list[int] | None = None, version: int | None = None) -> DataFrame | None:
        """The rows, or those of some buckets; None before the first merge."""
        folders = self._folders(version)
        paths = [p for b, p in folders.items() if buckets is None or b in buckets]
        if not folders:
            return None
        rows = self.spark.read.parquet(*(paths or list(folders.values())[:1]))
        return rows if paths else rows.limit(0)

    def known(self, rows: DataFrame) -> DataFrame | None:
        """The stored rows of all buckets that these keys fall into; None before the first merge."""
        return self.read([r[0] for r in self._bucketed(rows.select(*self.keys)).select("bucket").distinct().collect()])

    def merge(self, new: DataFrame) -> list[int]:
        """Put rows in by key: new ones are added, those that differ replaced; gives the buckets that were written.

        `new` has a row a key at most, and null keys are refused. Without a difference nothing is written and the version stays.
        """
        whole = [F.when(F.col(k).isNull(), F.raise_error(F.lit(f"{k}: a key is null"))).otherwise(F.col(k)).alias(k) for k in self.keys]
        rows = settled(self._bucketed(new.select(*whole, *[c for c in new.columns if c not in self.keys])))
        touched = [r[0] for r in rows.select("bucket").distinct().collect()]  # at most `buckets`
        old = self.read(touched) if touched else None
        old = rows.drop("bucket").limit(0) if old is None else old
        merged = settled(merge(old.select(*new.columns), rows.drop("bucket"), self.keys))
        changed = merged.where("change IN ('created', 'updated')")
        dirty = [r[0] for r in self._bucketed(changed.select(*self.keys)).select("bucket").distinct().collect()]
        if dirty:
            n = self.versions.claim()
            whole = self._bucketed(merged.drop("change")).where(F.col("bucket").isin(dirty))
            whole.repartition("bucket").write.partitionBy("bucket").parquet(self.versions.path(n))
            changed.write.parquet(f"{self.versions.folder}/_changes/v={n}")
            self.versions.complete(n)
        return sorted(dirty)

    def changes(self) -> DataFrame:
        """(v, keys, values, change) of every merge."""
        return self.spark.read.option("basePath", f"{self.versions.folder}/_changes").parquet(*[f"{self.versions.folder}/_changes/v={n}" for n in sorted(self._complete())])
