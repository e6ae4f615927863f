"""Running values along sorted rows, for keys of any size.

A window function takes all rows of a key in one task. Here rows are sorted by key and order over range
partitions, so a key with most of the rows lies in many of them. Each partition works out its own part of a
key; what the parts before add up to is one row a partition, because only its first key can have begun before.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..sources.store import settled

#: how a partition's own rows are summed up along the way, how all of them together, and how what came before is put to it
_WAYS = {
    "sum": (lambda c, w: F.sum(c).over(w), lambda c, _: F.sum(c), lambda before, own: F.coalesce(before, F.lit(0)) + own),
    "max": (lambda c, w: F.max(c).over(w), lambda c, _: F.max(c), lambda before, own: F.greatest(before, own)),
    "last": (lambda c, w: F.last(c, ignorenulls=True).over(w), lambda c, order: F.max_by(c, F.when(c.isNotNull(), F.struct(*order))), lambda before, own: F.coalesce(own, before)),
}


def running(df: DataFrame, keys: list[str], order: list[str], **values: tuple[str, Column]) -> DataFrame:
    """`df` with a column for each value: its sum, maximum or last non-null one over the key's rows up to and with this one.

    Rows are in ascending order of the columns `order`, nulls first, which must tell the rows of a key apart. The
    rows are written once to the shared folder, so that all reads see the same partitions. Null keys are a key;
    without keys all rows are of one.
    """
    named = df.withColumns({f"_{n}": c for n, (_, c) in values.items()})
    rows = settled(named.repartitionByRange(*keys, *order).withColumn("_part", F.spark_partition_id()))
    along = Window.partitionBy("_part", *keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    parts = rows.groupBy("_part", *keys).agg(*[_WAYS[how][1](F.col(f"_{n}"), order).alias(f"_{n}") for n, (how, _) in values.items()])
    earlier = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    before = {f"_b_{n}": _WAYS[how][0](F.col(f"_{n}"), earlier) for n, (how, _) in values.items()}
    numbered = parts.withColumns(before | {"_k": F.row_number().over(Window.partitionBy(*keys).orderBy("_part"))})
    carried = numbered.where("_k > 1").select("_part", *[F.col(k).alias(f"_k_{k}") for k in keys], *before)
    same = F.col("_part") == F.col("_p")
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_k_{k}"))
    own = rows.withColumns({f"_{n}": _WAYS[how][0](F.col(f"_{n}"), along) for n, (how, _) in values.items()})
    joined = own.join(F.broadcast(carried.withColumnRenamed("_part", "_p")), same, "left")  # one row a partition at most
    return joined.select(*df.columns, *[_WAYS[how][2](F.col(f"_b_{n}"), F.col(f"_{n}")).alias(n) for n, (how, _) in values.items()])
