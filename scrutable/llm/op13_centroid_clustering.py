"""Centroid clustering with an annulus search for the nearest centroid, in exact integers.

Every component x becomes the integer floor(256 * x), so squared distances and means are exact. Centroids are
sorted by norm. A vector's first bound is its distance to the centroid whose norm is nearest to its own; only
centroids whose norms differ from the vector's by no more than the bound can be as near (the triangle
inequality), and binary search finds where this annulus begins and ends. Its centroids are compared exactly,
the annulus narrows as nearer ones turn up, and its borders are widened by more than any rounding of norms,
so a tie on the border is compared too. Of equally near centroids the one of smallest number wins.

A round is one pass over the stored vectors: a task adds up its own vectors by centroid and returns one row a
centroid it used, so a cluster with most of the vectors is no larger to any task than another. The driver
holds `k` centroids and nothing else. An empty cluster keeps its centroid.

Vectors of another length than `dims`, null ones and those with null, infinite or NaN components take no part
and have no row. Rows without vec_id and repeated rows count as further vectors. Of equal hashes (repeated
ids) the smaller vector starts first; rows without id start last. With fewer vectors than `k` each is a
start; equal starts leave the later one empty. An empty table gives no rows; other columns are never read.
A component beyond 2**19 is an error, as its squared distances need not fit a long.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from .common import cut, ship

SCALE, LARGEST = 256, 2**27
ROWS = 4096  # vectors compared at once inside a task
SLACK = 1e-3  # norms stay below 2**31, where doubles are exact to 2**-22


def whole(vectors: DataFrame, dims: int = 64, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(vec_id, v): the vectors that take part, as integers."""
    x = F.col(vec_col).cast("array<double>")
    finite = F.forall(x, lambda e: F.coalesce(F.abs(e) < float("inf"), F.lit(False)))
    fits = F.forall(x, lambda e: F.abs(e * SCALE) <= LARGEST)
    ints = F.transform(x, lambda e: F.floor(e * SCALE).cast("int"))
    v = F.when(fits, ints).otherwise(F.raise_error(F.lit(f"a component beyond {LARGEST // SCALE}")))
    return vectors.where((F.size(vec_col) == dims) & finite).select(F.col(id_col).cast("long").alias("vec_id"), v.alias("v"))


def starts(vecs: DataFrame, k: int, seed: str) -> np.ndarray:
    """The k vectors of smallest hash of their id, in order."""
    order = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    first = vecs.select("v", order.alias("h")).orderBy(F.asc_nulls_last("h"), "v").limit(k).collect()
    return np.array([r["v"] for r in first], np.int64)


def squares(vectors: np.ndarray, centroid: np.ndarray) -> np.ndarray:
    apart = vectors - centroid
    return (apart * apart).sum(axis=1)


def nearest(vectors: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Number and squared distance of each vector's nearest centroid, by annulus search."""
    norm = lambda a: np.sqrt((a * a).sum(axis=1).astype(float))
    numbers = np.argsort(norm(centroids), kind="stable")
    ring, own = norm(centroids)[numbers], norm(vectors)
    right = np.minimum(np.searchsorted(ring, own), len(ring) - 1)
    left = np.maximum(right - 1, 0)
    begin = np.where(np.abs(ring[left] - own) < np.abs(ring[right] - own), left, right)
    best_number = numbers[begin]
    best = squares(vectors, centroids[best_number])
    reach = np.sqrt(best) + SLACK
    low, high = np.searchsorted(ring, own - reach, "left"), np.searchsorted(ring, own + reach, "right")
    for at, number in enumerate(numbers):
        rows = np.flatnonzero((low <= at) & (at < high) & (np.abs(ring[at] - own) <= reach))
        if len(rows):
            far = squares(vectors[rows], centroids[number])
            won = (far < best[rows]) | ((far == best[rows]) & (number < best_number[rows]))
            rows, far = rows[won], far[won]
            best[rows], best_number[rows] = far, number
            reach[rows] = np.sqrt(far) + SLACK
    return best_number, best


def _blocks(batches, dims: int):
    for batch in batches:
        for at in range(0, batch.num_rows, ROWS):
            part = batch.slice(at, ROWS)
            yield part, pc.list_flatten(part.column("v")).to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, dims)


def sums(vecs: DataFrame, centroids: np.ndarray) -> list:
    """(cluster, n, s0, s1, ...) of the vectors nearest to each centroid that has any: at most one row a centroid."""
    k, dims = centroids.shape

    def work(batches):
        counts, totals = np.zeros(k, np.int64), np.zeros((k, dims), np.int64)
        for _, v in _blocks(batches, dims):
            number, _ = nearest(v, centroids)
            np.add.at(totals, number, v)
            counts += np.bincount(number, minlength=k)
        used = np.flatnonzero(counts)
        yield pa.RecordBatch.from_pydict({"cluster": pa.array(used, pa.int32()), "n": counts[used], "s": pa.array(totals[used].tolist(), pa.list_(pa.int64()))})

    parts = vecs.select("v").mapInArrow(work, "cluster int, n long, s array<long>")
    each = [F.sum(F.get("s", F.lit(i)).cast("decimal(38,0)")).alias(f"s{i}") for i in range(dims)]
    return parts.groupBy("cluster").agg(F.sum("n").alias("n"), *each).collect()


def moved(centroids: np.ndarray, rows: list) -> np.ndarray:
    """Centroids at the exact floor of their vectors' mean; those without vectors stay."""
    new = centroids.copy()
    for r in rows:
        new[r["cluster"]] = [int(r[f"s{i}"]) // r["n"] for i in range(centroids.shape[1])]
    return new


def assign(vecs: DataFrame, centroids: np.ndarray) -> DataFrame:
    """(vec_id, cluster, distance) of every row of (vec_id, v): its nearest centroid and the squared distance."""
    ship(vecs.sparkSession)
    dims = centroids.shape[1]

    def work(batches):
        for part, v in _blocks(batches, dims):
            number, far = nearest(v, centroids)
            yield pa.RecordBatch.from_arrays([part.column("vec_id"), pa.array(number, pa.int32()), pa.array(far, pa.int64())], ["vec_id", "cluster", "distance"])

    return vecs.mapInArrow(work, "vec_id long, cluster int, distance long")


def cluster(vectors: DataFrame, k: int = 40, rounds: int = 5, dims: int = 64, seed: str = "2", id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid, centroid_sha256) of every vector that takes part."""
    spark = vectors.sparkSession
    ship(spark)
    vecs = cut(whole(vectors, dims, id_col, vec_col))
    centroids = starts(vecs, k, seed)
    schema = "cluster int, cluster_inertia long, inertia long, centroid array<long>, centroid_sha256 string"
    if not len(centroids):
        return vecs.select("vec_id").join(spark.createDataFrame([], schema).withColumn("distance", F.lit(0).cast("long")), F.lit(False)).select("vec_id", "cluster", "distance", *[c.split()[0] for c in schema.split(", ")[1:]])
    for _ in range(rounds):
        centroids = moved(centroids, sums(vecs, centroids))
    found = cut(assign(vecs, centroids))
    each = {r["cluster"]: int(r["d"]) for r in found.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("d")).collect()}
    text = lambda c: ",".join(map(str, c.tolist()))
    rows = [(c, d, sum(each.values()), centroids[c].tolist(), hashlib.sha256(text(centroids[c]).encode()).hexdigest()) for c, d in each.items()]
    return found.join(F.broadcast(spark.createDataFrame(rows, schema)), "cluster").select("vec_id", "cluster", "distance", *[c.split()[0] for c in schema.split(", ")[1:]])


def oracle(k: int = 40, rounds: int = 5) -> str:
    """The same in SQL: every vector meets every centroid."""
    away = "list_sum(list_transform(range(1, 65), lambda i: (x.v[i] - m.v[i]) * (x.v[i] - m.v[i])))"
    near = lambda r: f"SELECT x.id, arg_min(m.c, {{'d': {away}, 'c': m.c}}) AS c, min({away}) AS d FROM x, m{r} m GROUP BY x.id"
    steps = []
    for r in range(rounds):
        steps.append(f"a{r} AS MATERIALIZED ({near(r)})")
        steps.append(f"s{r} AS (SELECT c, i, CAST(sum(v[i]) AS HUGEINT) AS s, count(*) AS n FROM a{r} JOIN x USING (id), range(1, 65) t(i) GROUP BY c, i)")
        steps.append(f"n{r} AS (SELECT c, list(CAST((s - ((s % n) + n) % n) // n AS BIGINT) ORDER BY i) AS v FROM s{r} GROUP BY c)")
        steps.append(f"m{r + 1} AS MATERIALIZED (SELECT m{r}.c, coalesce(n{r}.v, m{r}.v) AS v FROM m{r} LEFT JOIN n{r} USING (c))")
    return f"""WITH x AS MATERIALIZED (
  SELECT row_number() OVER () AS id, vec_id, list_transform(embedding, lambda e: CAST(floor(256 * CAST(e AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda e: e IS NOT NULL AND isfinite(e))) = 64
), m0 AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY h, v) - 1 AS c, v FROM (SELECT sha256('2:' || vec_id) AS h, v FROM x ORDER BY h, v LIMIT {k})
), {", ".join(steps)}, final AS MATERIALIZED ({near(rounds)})
SELECT vec_id, CAST(c AS INTEGER) AS cluster, CAST(d AS BIGINT) AS distance, CAST(sum(d) OVER (PARTITION BY c) AS BIGINT) AS cluster_inertia, CAST(sum(d) OVER () AS BIGINT) AS inertia,
  sha256(array_to_string(m{rounds}.v, ',')) AS centroid_sha256
FROM final JOIN x USING (id) JOIN m{rounds} USING (c)"""


ORACLE = oracle()
