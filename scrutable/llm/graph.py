"""Connected components of a link table, by minimum labels with pointer jumping; everything stays in tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .common import cut, merged


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(v, comp) for every vertex of a link: the smallest vertex reachable from it.

    Each round takes the smallest label among neighbours, then the label which that vertex had, so the
    number of rounds follows the logarithm of the longest path. Rounds are written to the shared folder.
    """
    ends = links.select(F.col(a).alias("u"), F.col(b).alias("v"))
    both = cut(ends.union(ends.select("v", "u")).where("u <> v").distinct(), few=True)
    labels = cut(both.groupBy("u").agg(F.min("v").alias("low")).select("u", F.least("u", "low").alias("comp")), few=True)
    while True:
        near = merged(both, labels.select(F.col("u").alias("v"), "comp"), "v").groupBy("u").agg(F.min("comp").alias("low"))
        step = merged(labels, near, "u").select("u", F.col("comp").alias("old"), F.least("comp", "low").alias("low"))
        known = labels.select(F.col("u").alias("low"), "comp")
        new = cut(merged(step, known, "low").select("u", "old", F.least("low", "comp").alias("comp")), few=True)
        if new.where("comp <> old").isEmpty():
            return new.select(F.col("u").alias("v"), "comp")
        labels = new.select("u", "comp")
