"""Line dedup with levelled sorted runs.

Documents come in batches of rising doc_id. The index of seen line keys is a set of runs, each a table of
(key digest, owner) bucketed and sorted by digest. A batch reduces its lines to one row a key and is
merge-joined with every run on the shared bucketing, so no run is shuffled again: keys that no run holds
(the anti-join) are the batch's own run, of level 0, and keys that a run holds have their owner there. When
a level holds `fanout` runs they are merged, bucket by bucket, into one run of the next level, so n batches
leave of the order of log(n) runs. Since batches rise by doc_id, the owner of a key is the smallest document that holds
it, and the runs alone say which lines go: those of a key whose owner is another, smaller document.

An index that the caller names stays after the job; later batches of documents, given the same index, lose
the lines that any earlier batch held (whoever came first owns a key). Without one, runs are dropped, also
when the job fails.

A key is the line without ASCII white space at both ends, A-Z lower-cased; only keys of `min_chars` code
points or more are indexed, so blank and short lines stay. Null or empty text is one empty line. Repeated
rows of one doc_id are the same document, one output row each, whatever their texts. Rows whose doc_id is
null are kept whole and own nothing. Only id, text and carried columns are read; an empty table gives no
rows. Digests have 128 bits. Dropping is linear in a document's lines.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import cut, delete, discard, merged, shared_folder

BLANK = r"[\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def line_key(line):
    return F.translate(F.regexp_replace(line, f"^{BLANK}|{BLANK}$", ""), UPPER, LOWER)


class SortedRuns:
    """Levelled runs of (key, owner, fresh): bucketed and sorted tables of the session's catalogue, in the shared folder.

    Table names hold index and level, so the same name opens the same runs again. Only rows with `fresh`
    belong to a run; the others serve the batch that wrote them and go at the next merge.
    """

    def __init__(self, spark: SparkSession, name: str, fanout: int = 2, buckets: int | None = None):
        self.spark, self.name, self.fanout = spark, name, max(2, fanout)
        self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.levels: dict[int, list[str]] = {}
        for t in sorted(x.name for x in spark.catalog.listTables(pattern=f"{name}_level*")):
            self.levels.setdefault(int(t.removeprefix(f"{name}_level").split("_")[0]), []).append(t)

    def tables(self) -> list[str]:
        return [t for level in sorted(self.levels) for t in self.levels[level]]

    def _write(self, keys: DataFrame, level: int) -> str:
        t = f"{self.name}_level{level}_{uuid.uuid4().hex}"
        keys.write.format("parquet").option("path", shared_folder(self.spark)).bucketBy(self.buckets, "key").sortBy("key").saveAsTable(t)
        self.levels.setdefault(level, []).append(t)
        return t

    def _drop(self, level: int) -> None:
        for t in self.levels.pop(level):
            (row,) = self.spark.sql(f"DESCRIBE FORMATTED {t}").where("col_name = 'Location'").collect()
            self.spark.sql(f"DROP TABLE IF EXISTS {t}")
            delete(self.spark, row["data_type"])

    def run(self, t: str) -> DataFrame:
        return self.spark.table(t).where("fresh").select("key", "owner")

    def add(self, keys: DataFrame) -> DataFrame:
        """Join a batch's (key, low, high) with every run, keep the new keys as a run: (key, owner) of those that repeat.

        The rows returned lie in tables of the index, so they have to be used before the next batch is added.
        """
        owners = []
        for i, t in enumerate(self.tables()):
            owners.append(F.col(f"owner{i}"))
            keys = merged(keys, self.run(t).withColumnRenamed("owner", f"owner{i}"), "key", "left")
        seen = F.coalesce(*owners, F.lit(None).cast("long"))
        t = self._write(keys.select("key", F.coalesce(seen, "low").alias("owner"), seen.isNull().alias("fresh"), (seen.isNotNull() | (F.col("low") < F.col("high"))).alias("repeats")), 0)
        return self.spark.table(t).where("repeats").select("key", "owner")

    def compact(self) -> None:
        """Merge the runs of a full level into one of the next, on their bucketing and order."""
        level = 0
        while level in self.levels:
            if len(self.levels[level]) >= self.fanout:
                first, *rest = self.levels[level]
                both = self.run(first)
                for t in rest:
                    other = self.run(t).withColumnRenamed("owner", "other")
                    both = merged(both, other, "key", "full").select("key", F.coalesce("owner", "other").alias("owner"))
                self._write(both.select("key", "owner", F.lit(True).alias("fresh"), F.lit(False).alias("repeats")), level + 1)
                self._drop(level)
            level += 1

    def drop(self) -> None:
        for level in list(self.levels):
            self._drop(level)


def batch_bounds(docs: DataFrame, batches: int) -> list[int]:
    """Cut points in doc_id that deal documents into about equal batches; any cut points give the same result."""
    if batches < 2:
        return []
    found = docs.approxQuantile("doc_id", [i / batches for i in range(1, batches)], 0.02)
    return sorted({int(x) for x in found})


def dedup_lines(docs: DataFrame, batches: int = 4, fanout: int = 2, min_chars: int = 10, id_col: str = "doc_id", text_col: str = "text", carry: tuple[str, ...] = (), index: str | None = None) -> DataFrame:
    """(doc_id, text, n_lines, n_dropped): each document without the lines that a smaller doc_id holds.

    Columns named in `carry` are kept beside these. `index` names runs to open and to keep.

    Work and run storage follow the number of distinct keys; a key shared by very many documents is one
    row per task before anything is shuffled, and only rows of repeated keys meet their owner again.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), *carry)
    bounds = batch_bounds(docs, batches)
    batch = F.lit(0)
    for x in bounds:
        batch = batch + (F.col("doc_id") >= x).cast("int")
    lines = docs.where("doc_id IS NOT NULL").select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("pos", "line")).withColumn("line", line_key("line")).where(F.length("line") >= min_chars)
    lines = cut(lines.select("doc_id", "pos", F.unhex(F.md5("line")).alias("key"), batch.alias("batch")), by="batch")
    runs, dropped = SortedRuns(spark, index or f"line_runs_{uuid.uuid4().hex}", fanout), []
    try:
        for i in range(len(bounds) + 1):
            part = lines.where(F.col("batch") == i)
            # written plainly: with both sides shuffled, the join's hot keys are split, which a bucketed side would prevent
            repeated = cut(runs.add(part.groupBy("key").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high"))))
            gone = merged(part, repeated, "key").where("doc_id <> owner").select("doc_id", "pos").distinct()
            dropped.append(cut(gone.groupBy("doc_id").agg(F.collect_list("pos").alias("drop"))))
            discard(repeated)
            runs.compact()
    finally:
        if index is None:
            runs.drop()
    discard(lines)
    gone = dropped[0]
    for x in dropped[1:]:
        gone = gone.unionByName(x)
    # the join keeps the split lines a column, so that each is read by its place once
    each = merged(docs.select("doc_id", F.split("text", "\n", -1).alias("lines"), *carry), gone, "doc_id", "left")
    stay = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), F.coalesce("drop", F.array().cast("array<int>")))
    kept = F.when(F.col("drop").isNull(), F.array_join("lines", "\n")).otherwise(F.array_join(F.transform(stay, lambda i: F.get("lines", i)), "\n"))
    return each.select("doc_id", kept.alias("text"), *carry, F.size("lines").cast("long").alias("n_lines"), F.coalesce(F.size("drop"), F.lit(0)).cast("long").alias("n_dropped"))


ORACLE = r"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos FROM documents
), keyed AS (
  SELECT doc_id, pos, line, translate(regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k FROM lines
), owners AS (
  SELECT k, min(doc_id) AS owner FROM keyed WHERE length(k) >= 10 GROUP BY k HAVING count(DISTINCT doc_id) >= 2
), marked AS (
  SELECT keyed.*, coalesce(keyed.doc_id > owners.owner, FALSE) AS gone FROM keyed LEFT JOIN owners USING (k)
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""
