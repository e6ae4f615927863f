"""Embedding near-duplicates by collision-counting projections.

Bitwise equal vectors are one class with a multiplicity. Every class is projected on COUNTED random lines; a
pair collides on a line when its two projections lie within a window of width w around each other. w, and the
number of collisions that a pair needs, come from the wanted recall at the threshold cosine, at every size of
the table alike. Single projections are weak: even the windows of the closest pairs hold half of all others.
So that the work does not grow with the square of the table, it is dealt into tables of cells: a table cuts
the space into cells by the signs of g further projections, with g the logarithm of the number of vectors
over the cell size, and there are as many tables as it takes for a pair to share a cell of one of them. Within
a cell members are sorted by one of the projections, each member's window is taken, the collisions of its
pairs are counted over all lines, and pairs that reach the calibrated count are verified by cosine in double
precision. A pair is counted by the first table where it meets, so nothing is counted twice and no pair is
ever emitted: tasks return a number of links and one link to a root for each member. What is shuffled is a
class's id and vector once a table; projections and cells of other tables are worked out where they are needed.

Cells above the block size are dealt into block pairs, each a group of bounded size. Vectors that are
null, empty, zero or hold null or non-finite components link with nothing and are their own component, as
are vectors of other lengths to each other. Rows without vec_id have no links, no component and are not
kept. Repeated rows count as further vectors. Other columns are never read; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from .common import cut, hinted, ship
from .graph import components

CELL, BLOCK, COUNTED = 1000, 2000, 16
#: chance that a pair of the threshold cosine collides on a line, and the window's half width in deviations for it
WITHIN, DEVIATIONS = 0.99, 2.5758


class Plan:
    """Numbers of bits, tables and collisions for a recall at a cosine threshold and a number of vectors."""

    def __init__(self, n: int, threshold: float, miss: float):
        self.threshold = threshold
        self.bits = max(0, math.ceil(math.log2(max(n, 1) / CELL)))
        meet = (1 - math.acos(threshold) / math.pi) ** self.bits * WITHIN
        self.tables = max(2, math.ceil(math.log(miss) / math.log(1 - meet)))
        self.width = DEVIATIONS * math.sqrt(2 - 2 * threshold)
        tail, self.count = 0.0, 0
        for k in range(COUNTED + 1):
            tail += math.comb(COUNTED, k) * WITHIN**k * (1 - WITHIN) ** (COUNTED - k)
            if tail > miss / 2:
                break
            self.count = k + 1
        self._known: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def directions(self, dim: int) -> tuple[np.ndarray, np.ndarray]:
        """Lines to project on, and those whose signs make the cells of all tables."""
        if dim not in self._known:
            rng = np.random.RandomState(dim)
            self._known[dim] = rng.normal(size=(dim, COUNTED)), rng.normal(size=(dim, self.tables * self.bits))
        return self._known[dim]

    def projections(self, x: np.ndarray) -> np.ndarray:
        return (x @ self.directions(x.shape[1])[0]).astype(np.float32)

    def cells(self, x: np.ndarray, tables: int | None = None) -> np.ndarray:
        """The cell of each vector in the first tables."""
        n = self.tables if tables is None else tables
        if not self.bits:
            return np.zeros((len(x), n), np.int32)
        signs = (x @ self.directions(x.shape[1])[1][:, : n * self.bits] > 0).reshape(len(x), n, self.bits)
        return (signs << np.arange(self.bits)).sum(axis=2).astype(np.int32)

    def met_before(self, x: np.ndarray, u: np.ndarray, v: np.ndarray, table: int) -> np.ndarray:
        """Which pairs share a cell, and the window sorted there, in an earlier table."""
        out = np.zeros(len(u), bool)
        if not table or not len(u):
            return out
        members, back = np.unique(np.concatenate([u, v]), return_inverse=True)
        u, v = back[: len(u)], back[len(u) :]
        cells, proj = self.cells(x[members], table), self.projections(x[members])
        for t in range(table):
            line = proj[:, t % COUNTED]
            out |= (cells[u, t] == cells[v, t]) & (np.abs(line[u] - line[v]) <= np.float32(self.width))
        return out


def rows_by_length(column):
    """For each vector length, the valid rows of an Arrow list column and their values as a matrix."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    lengths = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    flat = column.flatten()
    values = flat.to_numpy(zero_copy_only=False).astype(np.float32 if pa.types.is_float32(flat.type) else np.float64, copy=False)
    begin = np.cumsum(lengths) - lengths
    for d in np.unique(lengths[lengths > 0]):
        rows = np.flatnonzero(lengths == d)
        x = values[begin[rows][:, None] + np.arange(d)]
        good = np.isfinite(x).all(axis=1) & (x != 0).any(axis=1)
        yield rows[good], x[good]


def unit(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.float64)
    x = x / np.abs(x).max(axis=1, keepdims=True)  # no overflow or underflow of squares
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def fingerprints(vectors: DataFrame) -> DataFrame:
    """(vec_id, key, vec): digest and bytes of each valid vector, null for the rest."""

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            keys, raw = [None] * batch.num_rows, [None] * batch.num_rows
            for rows, x in rows_by_length(batch.column("embedding")):
                x = x + 0.0  # one zero
                for r, v in zip(rows, x, strict=True):
                    raw[r] = v.tobytes()
                    keys[r] = hashlib.blake2b(raw[r], digest_size=16).digest()
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), pa.array(keys, pa.binary()), pa.array(raw, pa.binary())], ["vec_id", "key", "vec"])

    return vectors.mapInArrow(run, "vec_id long, key binary, vec binary")


def placed(classes: DataFrame, plan: Plan, kind: str) -> DataFrame:
    """(rep, mult, vec, dim, cells): the cell of each class in every table."""

    def run(batches):
        for batch in batches:
            raw = batch.column("vec").to_pylist()
            dims = np.array([len(v) // np.dtype(kind).itemsize for v in raw], np.int32)
            cells = np.zeros((len(raw), plan.tables), np.int32)
            for d in np.unique(dims):
                rows = np.flatnonzero(dims == d)
                cells[rows] = plan.cells(unit(np.stack([np.frombuffer(raw[r], kind) for r in rows])))
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, cells.size + 1, plan.tables, dtype=np.int32)), pa.array(cells.reshape(-1)))
            yield pa.RecordBatch.from_arrays([batch.column("rep"), batch.column("mult"), batch.column("vec"), pa.array(dims), lists], ["rep", "mult", "vec", "dim", "cells"])

    return classes.mapInArrow(run, "rep long, mult long, vec binary, dim int, cells array<int>")


def compare(group: pa.Table, plan: Plan, kind: str, rows: int = 256) -> pa.Table:
    """Links among one bounded group of a cell: (rep, n_links, root) of its linked members."""
    table, bi, bj = (group.column(c)[0].as_py() for c in ("table", "bi", "bj"))
    x = unit(np.stack([np.frombuffer(v, kind) for v in group.column("vec").to_pylist()]))
    proj = plan.projections(x)
    order = np.argsort(proj[:, table % COUNTED], kind="stable")
    x, proj = x[order], proj[order]
    sorted_line = proj[:, table % COUNTED]
    rep, mult, block = (group.column(c).to_numpy()[order] for c in ("rep", "mult", "block"))
    n, w = len(rep), np.float32(plan.width)
    links, parent = np.zeros(n, np.int64), np.arange(n)
    stop = np.searchsorted(sorted_line, sorted_line + w, side="right")
    for a in range(0, n, rows):
        b = min(n, a + rows)
        end = int(stop[b - 1])
        i, j = slice(a, b), slice(a, end)
        meet = np.abs(sorted_line[i, None] - sorted_line[None, j]) <= w
        meet &= np.arange(a, b)[:, None] < np.arange(a, end)[None]
        if bi != bj:
            meet &= block[i, None] != block[None, j]
        count = np.zeros(meet.shape, np.int8)
        for t in range(COUNTED):
            count += np.abs(proj[i, t, None] - proj[None, j, t]) <= w
        u, v = np.nonzero(meet & (count >= plan.count))
        if not len(u):
            continue
        u, v = u + a, v + a
        near = np.concatenate([(x[u[k : k + 65536]] * x[v[k : k + 65536]]).sum(axis=1) for k in range(0, len(u), 65536)]) >= plan.threshold
        u, v = u[near], v[near]
        new = ~plan.met_before(x, u, v, table)
        u, v = u[new], v[new]
        links += np.bincount(u, mult[v], minlength=n).astype(np.int64) + np.bincount(v, mult[u], minlength=n).astype(np.int64)
        while len(u):  # union by smaller root, all at once
            ru, rv = parent[u], parent[v]
            open_ = ru != rv
            if not open_.any():
                break
            low, high = np.minimum(ru, rv)[open_], np.maximum(ru, rv)[open_]
            np.minimum.at(parent, high, low)
            while (parent != parent[parent]).any():
                parent = parent[parent]
    parent = parent[parent]
    got = np.flatnonzero(links)
    return pa.table({"rep": rep[got], "n_links": links[got], "root": rep[parent[got]]})


def link(vectors: DataFrame, threshold: float = 0.9, miss: float = 5e-4, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every row."""
    ship(vectors.sparkSession)
    kind = "<f4" if isinstance(vectors.schema[vector_col].dataType.elementType, T.FloatType) else "<f8"
    values = F.col(vector_col) if kind == "<f4" else F.col(vector_col).cast("array<double>")
    keyed = cut(fingerprints(vectors.select(F.col(id_col).cast("long").alias("vec_id"), values.alias("embedding"))))
    good = keyed.where("key IS NOT NULL AND vec_id IS NOT NULL")
    classes = cut(good.groupBy("key").agg(F.min("vec_id").alias("rep"), F.count("*").alias("mult"), F.first("vec").alias("vec")))
    plan = Plan(classes.count(), threshold, miss)
    cells = cut(placed(classes.select("rep", "mult", "vec"), plan, kind))
    members = cells.select("rep", "mult", "vec", "dim", F.posexplode("cells").alias("table", "cell"))
    place = ["dim", "table", "cell"]
    sizes = cut(members.groupBy(*place).agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks")).where("blocks > 1"), few=True)
    members = members.join(hinted(sizes), place, "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    members = members.withColumn("block", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    members = members.withColumn("other", other).withColumn("bi", F.least("block", "other")).withColumn("bj", F.greatest("block", "other"))
    members = members.select(*place, "bi", "bj", "block", "rep", "mult", "vec")
    found = members.groupBy(*place, "bi", "bj").applyInArrow(lambda t: compare(t, plan, kind), "rep long, n_links long, root long")
    found = cut(found)
    comps = components(found.where("rep <> root").select("rep", "root"), "rep", "root").withColumnRenamed("v", "rep")
    links = found.groupBy("rep").agg(F.sum("n_links").alias("others"))
    known = classes.join(links, "rep", "left").join(comps, "rep", "left")
    known = cut(known.select("key", (F.coalesce("others", F.lit(0)) + F.col("mult") - 1).alias("n_links"), F.coalesce("comp", "rep").alias("component_id")))
    out = keyed.select("vec_id", F.when(F.col("vec_id").isNotNull(), F.col("key")).alias("key")).join(known, "key", "left")
    component = F.coalesce("component_id", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"))


ORACLE = """
WITH RECURSIVE v AS (
  SELECT vec_id, CAST(embedding AS DOUBLE[]) AS x FROM embeddings WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda e: e IS NULL OR NOT isfinite(e))) = 0
), u AS (
  SELECT vec_id, x, sqrt(list_dot_product(x, x)) AS norm FROM v WHERE list_dot_product(x, x) > 0
), pairs AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM u a JOIN u b ON a.vec_id < b.vec_id AND len(a.x) = len(b.x) WHERE list_dot_product(a.x, b.x) / (a.norm * b.norm) >= 0.9
), ends AS (
  SELECT a, b FROM pairs UNION ALL SELECT b, a FROM pairs
), reach AS (
  SELECT a AS v, a AS w FROM ends UNION SELECT r.v, ends.b FROM reach r JOIN ends ON ends.a = r.w
), least AS (
  SELECT v, min(w) AS c FROM reach GROUP BY v
), links AS (
  SELECT a, count(*) AS n FROM ends GROUP BY a
)
SELECT vec_id, coalesce(n, 0) AS n_links, coalesce(c, vec_id) AS component_id, coalesce(c, vec_id) = vec_id AS kept
FROM embeddings LEFT JOIN links ON links.a = vec_id LEFT JOIN least ON least.v = vec_id
"""
