"""Accent-insensitive substring search by a stored inverted index of trigrams.

Postings are rows of a gram and a block of keys, in folders by hash of the gram and sorted by gram, so that a search
reads the postings of the grams it asks for; a gram that most texts hold is cut into several files. Texts are stored
in folders by hash of the key. A pattern's rarest grams, by stored counts, give the candidates; only folders that
hold a candidate are opened, and candidates are verified, so a search gives exactly what a scan would.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from ..functions.text import matches, unaccent
from .store import Store, Versions

SIZE = 3


def blocks(texts: DataFrame, most: int = 1_000_000) -> DataFrame:
    """(gram, keys, n): the keys of texts that hold a gram, once a text, in blocks.

    Texts of (key, text) stream through their tasks; a task gives out what it holds whenever it holds `most` keys, so
    there are far fewer rows to shuffle and sort than pairs of a text and a gram.
    """
    kind = texts.schema["key"].dataType

    def block(grams, owners, keys):
        """Sorted by gram; a gram is three code points of 21 bits."""
        found = np.concatenate(grams)
        order = np.argsort(found, kind="stable")
        found = found[order]
        starts = np.flatnonzero(np.append(True, found[1:] != found[:-1]))
        u, ends = found[starts], np.append(starts, len(found))
        spelled = np.stack([u >> 42, u >> 21 & 0x1FFFFF, u & 0x1FFFFF], axis=1).astype("<u4").tobytes().decode("utf-32-le")
        values = pa.concat_arrays(keys).take(pa.array(np.concatenate(owners)[order]))
        lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), values)
        return pa.RecordBatch.from_arrays([pa.array([spelled[i : i + SIZE] for i in range(0, len(spelled), SIZE)], pa.string()), lists, pa.array(np.diff(ends), pa.int64())], ["gram", "keys", "n"])

    def gather(batches):
        grams, owners, keys, row, n = [], [], [], 0, 0
        for batch in batches:
            column = batch.column("key")
            keys.append(column)
            for at, text in enumerate(batch.column("text").to_pylist(), 1):
                if text and len(text) >= SIZE:
                    c = np.frombuffer(text.encode("utf-32-le"), "<u4").astype(np.int64)
                    found = np.unique(c[:-2] << 42 | c[1:-1] << 21 | c[2:])
                    grams.append(found)
                    owners.append(np.full(len(found), row))
                    n += len(found)
                row += 1
                if n >= most:
                    yield block(grams, owners, keys)
                    grams, owners, keys, row, n = [], [], [column.slice(at)], 0, 0
        if n:
            yield block(grams, owners, keys)

    return texts.select("key", "text").mapInArrow(gather, T.StructType([T.StructField("gram", T.StringType()), T.StructField("keys", T.ArrayType(kind)), T.StructField("n", T.LongType())]))


def literals(pattern: str) -> list[str]:
    """The runs of a LIKE pattern between its wildcards; a backslash takes the next character as it is."""
    runs, at = [""], 0
    while at < len(pattern):
        c = pattern[at]
        if c in "%_":
            runs.append("")
        else:
            at += c == "\\" and at + 1 < len(pattern)
            runs[-1] += pattern[at]
        at += 1
    return [r for r in runs if r]


class SearchIndex:
    """The index of one column of texts by key, in the store of its dataset."""

    def __init__(self, store: Store, name: str, buckets: int = 64, shards: int = 64):
        self.spark, self.buckets, self.shards = store.spark, buckets, shards
        self.versions = Versions(store.spark, f"{store.folder}/{name}")

    def build(self, rows: DataFrame, key: str, text: Column) -> SearchIndex:
        """Index every row: texts without accents, postings, and how many texts hold each gram."""
        shard = F.pmod(F.xxhash64("key"), F.lit(self.shards)).cast("int").alias("shard")
        plain = rows.select(F.col(key).alias("key"), unaccent(text).alias("text")).select("*", shard)

        def fill(path: str) -> None:
            plain.repartition("shard", self._part(F.col("key"))).sortWithinPartitions("shard", "key").write.partitionBy("shard").parquet(f"{path}/texts")
            stored = self.spark.read.parquet(f"{path}/texts")
            postings = blocks(stored).withColumn("bucket", self._bucket(F.col("gram")))
            postings.repartition("bucket", self._part(F.get("keys", F.lit(0)))).sortWithinPartitions("bucket", "gram").write.partitionBy("bucket").parquet(f"{path}/postings")
            counts = self.spark.read.parquet(f"{path}/postings").groupBy("bucket", "gram").agg(F.sum("n").alias("n"))
            counts.repartition("bucket").sortWithinPartitions("bucket", "gram").write.partitionBy("bucket").parquet(f"{path}/counts")

        self.versions.write(fill)
        return self

    def built(self) -> bool:
        return self.versions.current() is not None

    def _bucket(self, gram: Column) -> Column:
        return F.pmod(F.xxhash64(gram), F.lit(self.buckets)).cast("int")

    def _part(self, key: Column) -> Column:
        """Cuts a folder into four by hash, so that it is the work of four tasks; unlike ranges that needs no first pass over the rows."""
        return F.pmod(F.hash(key), F.lit(4))

    def _read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.versions.path(self.versions.current())}/{name}")

    def counts(self) -> DataFrame:
        """(gram, n): how many texts hold each gram."""
        return self._read("counts").select("gram", "n")

    def postings(self, gram: str) -> DataFrame:
        return self._read("postings").where((F.col("bucket") == self._bucket(F.lit(gram))) & (F.col("gram") == gram)).select(F.explode("keys").alias("key"))

    def candidates(self, pattern: str, most: int = 3, small: int = 100_000) -> DataFrame | None:
        """Keys of the texts that hold the pattern's rarest grams; None if every text is one: it has no gram, or a tenth of all texts hold the rarest.

        `small` is the number of postings up to which the rarest gram's keys are sent to the others' rows; it
        changes how they meet, not what is found.
        """
        folded = self.spark.createDataFrame([(pattern,)], "p string").select(unaccent(F.col("p"))).first()[0]
        wanted = sorted({r[i : i + SIZE] for r in literals(folded) for i in range(len(r) - SIZE + 1)})
        if not wanted:
            return None
        of = self._read("counts")
        known = of.where(F.col("gram").isin(wanted) & F.col("bucket").isin(*[self._bucket(F.lit(g)) for g in wanted]))
        n = {r["gram"]: r["n"] for r in known.select("gram", "n").collect()}
        rarest = sorted(wanted, key=lambda g: (n.get(g, 0), g))[:most]
        if n.get(rarest[0], 0) * 10 >= self._read("texts").count():  # then reading them all is less work than meeting the keys
            return None
        keys = self.postings(rarest[0])
        if not n.get(rarest[0]):
            return keys
        for gram in rarest[1:]:
            keys = self.postings(gram).join(keys.hint("broadcast" if n[rarest[0]] <= small else "merge"), "key", "left_semi")
        return keys

    def search(self, pattern: str, most: int = 3, small: int = 100_000) -> DataFrame:
        """(key) of the texts that hold the pattern, accents and case aside; % and _ are wildcards."""
        texts, keys = self._read("texts"), self.candidates(pattern, most, small)
        if keys is not None:
            shards = [r[0] for r in keys.select(F.pmod(F.xxhash64("key"), F.lit(self.shards)).cast("int")).distinct().collect()]  # at most `shards`
            texts = texts.where(F.col("shard").isin(shards)).join(keys, "key", "left_semi")
        return texts.where(matches(F.col("text"), pattern)).select("key")
