"""Near-duplicate documents by a chosen-path set similarity join over minwise tokens.

Documents with equal shingle sets are one class first. Each of several independent trees branches the
classes by the values of two chosen MinHash coordinates: a node holds the classes that agree on the values
along its path, and the next two coordinates are chosen by a hash of the node. The first nodes that are
compared are those of two branchings, four paths a tree: a pair of similarity 0.75 shares one in a tree with
probability 0.91, so four trees miss it with less than 1e-4 (and pairs of 0.85 with less than 1e-6), while
texts that share but a passage seldom meet.

Nodes are compared in two steps that lose no link between components. First every class meets the smallest
class of its node (linear in the node, however large); candidates pass a sketch filter set four standard
deviations below 0.75, and are confirmed on full shingle sets. A node that these links make one component
is done. Of the others, large ones branch again, a few times, where their branches hold at most half of
their pairs; small ones, tight ones that no branching would part, and what the last level still holds, are
compared exhaustively on full sets, in blocks of bounded size: tasks return links that join components, at
most one a member, never pairs. Links give components.

A document's set: distinct five-word shingles of its text, A-Z lower-cased, words split at ASCII white
space; with one to four words, the whole sequence as one; without, the empty set, linked with nothing. Null
and empty texts have the empty set. Each row gives one row; rows without doc_id have no component and are
not kept; rows that repeat a doc_id take the component of their own text. Other columns are never read; an
empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import cut, hinted, merged, ship
from .graph import components
from .kernels import mix, shingles, slices

COORDINATES, TREES, LEAF, DEPTH = 48, 4, 512, 3
LEAST_MATCHES = COORDINATES // 2  # four standard deviations below 0.75 * COORDINATES
BLOCK, BLOCK_BYTES = 512, 16 << 20  # members and bytes of text of one side of a block comparison
MEMBERS = 500  # documents that share one copy of a pivot's text while candidates are confirmed


def signatures(docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, f1, f2, sig): set size, 128-bit fingerprint of the set, MinHash coordinates."""
    ship(docs.sparkSession)
    seeds = np.random.RandomState(7).randint(1, 1 << 62, (COORDINATES, 2)).astype(np.uint64) | np.uint64(1)

    def run(batches):
        for batch in slices(batches):
            h, first = shingles(batch.column("text"))
            sizes = np.diff(first)
            full = np.flatnonzero(sizes)
            prints = []
            for salt in (0x5851F42D4C957F2D, 0x14057B7EF767814F):
                total = np.zeros(len(h) + 1, np.uint64)
                np.cumsum(mix(h ^ np.uint64(salt)), out=total[1:])
                prints.append((total[first[1:]] - total[first[:-1]]).view(np.int64))
            sig = np.zeros((len(sizes), COORDINATES), np.int32)
            if len(full):
                for t, (x, y) in enumerate(seeds):
                    v = (h ^ x) * y
                    v ^= v >> np.uint64(29)
                    v *= x
                    sig[full, t] = np.minimum.reduceat((v >> np.uint64(32)).astype(np.uint32), first[:-1][full]).view(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, sig.size + 1, COORDINATES, dtype=np.int32)), pa.array(sig.reshape(-1)))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(sizes.astype(np.int64)), pa.array(prints[0]), pa.array(prints[1]), lists], ["doc_id", "n_shingles", "f1", "f2", "sig"])

    return docs.mapInArrow(run, "doc_id long, n_shingles long, f1 long, f2 long, sig array<int>")


def confirm(pairs: DataFrame, docs: DataFrame, num: int = 75, den: int = 100) -> DataFrame:
    """The pairs (a, b) whose full sets have similarity num/den or more.

    Partners of one `a` are dealt to groups of about MEMBERS, each with its own copy of a's text, and
    streamed past it; no group of partners is ever held in memory.
    """
    ids = cut(pairs.select(F.col("a").alias("doc_id")).union(pairs.select("b")).distinct(), few=True)
    docs = cut(docs.join(hinted(ids), "doc_id", "left_semi"))
    counts = pairs.groupBy("a").agg(F.ceil(F.count("*") / MEMBERS).cast("int").alias("salts"))
    dealt = merged(pairs, counts, "a").select("a", "b", F.pmod(F.xxhash64("b"), F.col("salts")).cast("int").alias("salt"))
    others = merged(dealt, docs.select(F.col("doc_id").alias("b"), "text"), "b").select("a", "salt", "b", "text")
    pivots = merged(counts, docs.select(F.col("doc_id").alias("a"), "text"), "a").select("a", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), F.lit(None).cast("long").alias("b"), "text")

    def run(batches):
        pivot = None
        for batch in slices(batches):
            h, first = shingles(batch.column("text"))
            a, b = batch.column("a").to_pylist(), batch.column("b").to_pylist()
            links = []
            for i in range(len(a)):
                x = h[first[i] : first[i + 1]]
                if b[i] is None:
                    pivot = x
                    continue
                small, large = (x, pivot) if len(x) < len(pivot) else (pivot, x)
                if len(small) * den < num * len(large):
                    continue
                at = np.minimum(np.searchsorted(large, small), len(large) - 1)
                both = int((large[at] == small).sum())
                if den * both >= num * (len(x) + len(pivot) - both):
                    links.append((a[i], b[i]))
            yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in links], pa.int64()), pa.array([y for _, y in links], pa.int64())], ["a", "b"])

    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = pivots.unionByName(others).repartition(parts, "a", "salt").sortWithinPartitions("a", "salt", F.col("b").asc_nulls_first())
    return rows.mapInArrow(run, "a long, b long")


def compare_block(group: pa.Table, num: int = 75, den: int = 100, width: int = 8192) -> pa.Table:
    """Links (a, b) between components in one block pair of a node, at most one a member; exact, on full sets."""
    rep, comp, block = (group.column(c).to_numpy() for c in ("rep", "comp", "block"))
    h, first = shingles(group.column("text"))
    row, sizes = np.repeat(np.arange(len(rep)), np.diff(first)), np.diff(first)
    _, column, count = np.unique(h, return_inverse=True, return_counts=True)
    several = count > 1  # a shingle of one text adds to no intersection
    rank = np.cumsum(several) - 1
    row, column = row[several[column]], rank[column[several[column]]]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    both = np.zeros((len(rep), len(rep)), np.float32)  # counts stay far below 2**24
    for at in range(0, int(several.sum()), width):
        lo, hi = np.searchsorted(column, [at, at + width])
        part = np.zeros((len(rep), width), np.float32)
        part[row[lo:hi], column[lo:hi] - at] = 1
        both += part @ part.T
    both = both.astype(np.int64)
    near = den * both >= num * (sizes[:, None] + sizes[None] - both)
    near &= (comp[:, None] != comp[None]) & (sizes[:, None] > 0)
    if block.min() != block.max():
        near &= block[:, None] != block[None]
    root = {c: c for c in comp.tolist()}

    def find(c):
        while root[c] != c:
            root[c] = root[root[c]]
            c = root[c]
        return c

    links = []
    for i, j in zip(*np.nonzero(np.triu(near, 1)), strict=True):
        x, y = find(int(comp[i])), find(int(comp[j]))
        if x != y:
            root[max(x, y)] = min(x, y)
            links.append((int(rep[i]), int(rep[j])))
    return pa.table({"a": pa.array([x for x, _ in links], pa.int64()), "b": pa.array([y for _, y in links], pa.int64())})


def exhaust(nodes: DataFrame, docs: DataFrame) -> DataFrame:
    """Links (a, b) between components within each node of (node, rep, comp), every pair of members compared.

    A node above the block size becomes pairs of blocks, each a group of bounded size of its own. Members of
    the node's largest component are in blocks apart, which meet the blocks of the others but not each
    other: they are linked already, so a tight group costs by its outsiders, not by its square.
    """
    ids = cut(nodes.select(F.col("rep").alias("doc_id")).distinct(), few=True)
    texts = docs.join(hinted(ids), "doc_id", "left_semi").select(F.col("doc_id").alias("rep"), "text")
    rows = cut(merged(nodes, texts, "rep"))
    blocks = lambda n, b: F.greatest(F.ceil(n / BLOCK), F.ceil(b / BLOCK_BYTES)).cast("int")
    parts = rows.groupBy("node", "comp").agg(F.count("*").alias("n"), F.sum(F.octet_length("text")).alias("b"))
    sides = parts.groupBy("node").agg(F.sum("n").alias("n"), F.sum("b").alias("b"), F.max(F.struct("n", "b", "comp")).alias("main"))
    whole = blocks(F.col("n"), F.col("b")) <= 1
    ours = F.greatest(blocks(F.col("n") - F.col("main.n"), F.col("b") - F.col("main.b")), F.lit(1))
    sides = sides.select("node", F.when(~whole, F.col("main.comp")).alias("main"), F.when(whole, 1).otherwise(ours).alias("ours"), F.when(whole, 0).otherwise(blocks(F.col("main.n"), F.col("main.b"))).alias("mains"))
    rows = merged(rows, sides, "node").withColumn("in_main", F.coalesce(F.col("comp") == F.col("main"), F.lit(False)))
    rows = rows.withColumn("block", F.when(F.col("in_main"), F.col("ours") + F.pmod(F.xxhash64("rep"), F.col("mains"))).otherwise(F.pmod(F.xxhash64("rep"), F.col("ours"))).cast("int"))
    others = F.sequence(F.lit(0), F.when(F.col("in_main"), F.col("ours")).otherwise(F.col("ours") + F.col("mains")) - 1)
    rows = rows.withColumn("other", F.explode(others)).select("node", F.least("block", "other").alias("bi"), F.greatest("block", "other").alias("bj"), "block", "rep", "comp", "text")
    return rows.groupBy("node", "bi", "bj").applyInArrow(lambda group: compare_block(group), "a long, b long")


def alike(x, y):
    """Matching MinHash coordinates of two signatures."""
    return F.aggregate(F.zip_with(x, y, lambda p, q: (p == q).cast("int")), F.lit(0), lambda s, v: s + v)


def cluster(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of every row."""
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    sigs = cut(signatures(docs))
    key = ["f1", "f2", "n_shingles"]
    found = sigs.where("n_shingles > 0 AND doc_id IS NOT NULL")
    classes = cut(found.groupBy(*key).agg(F.min("doc_id").alias("rep"), F.min_by("sig", "doc_id").alias("sig")))
    sig = classes.select("rep", "sig")

    # two branchings: every tree has two coordinates of its own, and each node chooses two more
    roots = F.transform(F.sequence(F.lit(0), F.lit(2 * TREES - 1)), lambda t: F.xxhash64(t, F.get("sig", t)))
    members = sig.select("rep", "sig", F.explode(roots).alias("root"))
    chosen = lambda node, j: F.pmod(F.xxhash64(node, j), F.lit(COORDINATES)).cast("int")
    paths = [F.xxhash64("root", F.lit(j), F.get("sig", chosen("root", F.lit(j)))) for j in range(2)]
    members = members.select("rep", F.explode(F.array(*paths)).alias("node"))
    nodes = members.groupBy("node").agg(F.count("*").alias("n"), F.min("rep").alias("pivot")).where("n > 1")
    members = cut(merged(members, nodes, "node").select("node", "rep", "n", "pivot"))

    # every class meets the smallest of its node
    star = members.where("rep <> pivot").select(F.col("pivot").alias("a"), F.col("rep").alias("b")).distinct()
    star = merged(merged(star, sig.select(F.col("rep").alias("a"), F.col("sig").alias("x")), "a"), sig.select(F.col("rep").alias("b"), F.col("sig").alias("y")), "b")
    links = cut(confirm(cut(star.where(alike(F.col("x"), F.col("y")) >= LEAST_MATCHES).select("a", "b"), few=True), docs), few=True)
    comps = components(links)

    # nodes of several components: larger ones branch on where that halves the pairs, the others exhaustively
    left, todo = members.select("node", "rep", "n"), []
    for level in range(1, DEPTH + 1):
        left = merged(left, comps.withColumnRenamed("v", "rep"), "rep", "left").withColumn("comp", F.coalesce("comp", "rep"))
        mixed = left.groupBy("node").agg(F.min("comp").alias("low"), F.max("comp").alias("high")).where("low < high").select("node")
        left = cut(merged(left, mixed, "node", "left_semi"), few=True)
        if level == DEPTH:
            todo.append(left.select("node", "rep", "comp"))
            break
        paths = [F.xxhash64("node", F.lit(j), F.get("sig", chosen("node", F.lit(j)))) for j in range(2)]
        deeper = cut(merged(left.where(F.col("n") > LEAF), sig, "rep").select(F.col("node").alias("parent"), F.col("n").alias("of"), "rep", F.explode(F.array(*paths)).alias("node")), few=True)
        sizes = deeper.groupBy("parent", "of", "node").agg(F.count("*").alias("n"))
        paying = cut(sizes.groupBy("parent", "of").agg(F.sum(F.col("n") * F.col("n")).alias("cost")).where("2 * cost <= of * of").select("parent"), few=True)
        todo.append(merged(left, paying.select(F.col("parent").alias("node")), "node", "left_anti").select("node", "rep", "comp"))
        sizes = merged(sizes.where("n > 1"), paying, "parent", "left_semi").select("node", "n")
        left = merged(deeper, sizes, "node").select("node", "rep", "n")
    nodes = todo[0]
    for x in todo[1:]:
        nodes = nodes.union(x)
    more = exhaust(cut(nodes, few=True), docs)
    comps = components(links.union(more))
    classes = cut(merged(classes, comps.withColumnRenamed("v", "rep"), "rep", "left").select(*key, F.coalesce("comp", "rep").alias("component_id")))
    out = merged(sigs.select("doc_id", *key), classes, key, "left")
    component = F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
    component = F.when(F.col("doc_id").isNotNull(), component)
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(False)).alias("kept"))


ORACLE = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents
), sets AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS s FROM words
), sizes AS (
  SELECT doc_id, count(*) AS n FROM sets GROUP BY doc_id
), met AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared FROM sets a JOIN sets b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id
), pairs AS (
  SELECT a, b FROM met JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * shared >= 75 * (x.n + y.n - shared)
), ends AS (
  SELECT a, b FROM pairs UNION ALL SELECT b, a FROM pairs
), reach AS (
  SELECT a AS v, a AS w FROM ends UNION SELECT r.v, ends.b FROM reach r JOIN ends ON ends.a = r.w
), least AS (
  SELECT v, min(w) AS c FROM reach GROUP BY v
)
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, coalesce(c, d.doc_id) AS component_id, coalesce(c, d.doc_id) = d.doc_id AS kept
FROM documents d LEFT JOIN sizes ON sizes.doc_id = d.doc_id LEFT JOIN least ON least.v = d.doc_id
"""
