"""Benchmark decontamination by size-partitioned MinHash containment search; DataFrame functions only.

An item of q distinct five-word shingles is contained in a document that holds at least 0.75 q of them, so the
document misses at most floor(q / 4). The MinHash signature of an item is its floor(q / 4) + 1 smallest shingle
hashes: a document that contains the item shares at least one of them, however long it is, so no pair is lost.
Items are partitioned by set size (powers of two), and each partition has a ceiling, its largest signature
hash. A document's signature is the set of its shingle hashes up to the highest ceiling among the partitions
whose items it is long enough to contain; only those hashes leave the document. Shared signature hashes make
candidates, which are verified on the shingles as text, pair by pair, exactly.

A shingle that more than `common` items hold is no good signature: an item takes the smallest of its other
shingles first. A common one is used only by an item that consists of common shingles for over three quarters,
which a document with those shingles contains indeed, so posting lists stay short where pairs would be false.

Texts are lower-cased (A-Z) and split at ASCII white space. A text of one to four words has its whole word
sequence as its one shingle; null or empty texts have none, contain nothing and are contained in nothing.
Repeated rows of a document or item count once, rows without an id match nothing. Other columns are
never read; empty tables give no rows. The item side is broadcast only up to `most_bytes` measured bytes, and
shuffled beyond it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from .common import cut, hinted

SIZE = 5  # words of a shingle
WHITE = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words(text):
    return F.split(F.trim(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), F.lit(WHITE)), "[ \\t-\\r]+")


def places(df: DataFrame):
    """The starts of the shingles of column `words`, none for an empty text."""
    last = F.greatest(F.size("words") - SIZE, F.lit(0))
    return F.when(F.col("words")[0] != "", F.sequence(F.lit(0), last)).otherwise(F.array().cast("array<int>"))


def as_hash(i):
    return F.xxhash64(*[F.get("words", i + k) for k in range(SIZE)])


def as_text(i):
    return F.concat_ws(" ", F.slice("words", i + 1, SIZE))


def signatures(full: DataFrame, common: int) -> DataFrame:
    """(item_id, hash, n_item, part): the smallest hashes of each item, one more than a document may miss."""
    held = full.groupBy("hash").agg((F.count("*") > common).alias("common"))
    each = full.join(held, "hash")
    item = Window.partitionBy("item_id")
    ranked = each.withColumns({"n_item": F.count("*").over(item), "rank": F.row_number().over(item.orderBy("common", "hash"))})
    return ranked.where(F.col("rank") <= F.floor(F.col("n_item") / 4) + 1).select("item_id", "hash", F.col("n_item").cast("int").alias("n_item"), F.floor(F.log2("n_item")).cast("int").alias("part"))


def find_contained(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", doc_text: str = "text", item_id: str = "item_id", item_text: str = "text", common: int = 1000, most_bytes: int = 32 << 20) -> DataFrame:
    """(doc_id, item_id, n_shared, n_item, containment) of every pair with containment of 0.75 or more."""
    docs = docs.select(F.col(doc_id).alias("doc_id"), words(F.col(doc_text)).alias("words")).where("doc_id IS NOT NULL")
    items = items.select(F.col(item_id).alias("item_id"), words(F.col(item_text)).alias("words")).where("item_id IS NOT NULL")
    both = F.transform(places(items), lambda i: F.struct(as_hash(i).alias("hash"), as_text(i).alias("shingle")))
    full = cut(items.select("item_id", F.explode(both).alias("s")).select("item_id", "s.hash", "s.shingle").distinct())
    signed = cut(signatures(full, common))

    # one row for each power of two of item sizes: from how many shingles on, and up to which hash, a document takes part
    parts = signed.groupBy("part").agg(F.max("hash").alias("ceiling")).orderBy("part").collect()
    ceiling = F.lit(None).cast("long")
    for k in range(len(parts)):
        ceiling = F.when(F.size(places(docs)) * 4 >= 3 * 2 ** parts[k]["part"], F.lit(max(x["ceiling"] for x in parts[: k + 1]))).otherwise(ceiling)
    hashes = F.transform(places(docs), as_hash)
    own = docs.select("doc_id", hashes.alias("hashes"), ceiling.alias("ceiling")).select("doc_id", F.size("hashes").alias("n"), F.explode(F.filter("hashes", lambda h: h <= F.col("ceiling"))).alias("hash"))
    pairs = own.join(hinted(signed.select("item_id", "hash", "n_item"), most_bytes), "hash").where(F.col("n") * 4 >= F.col("n_item") * 3).select("doc_id", "item_id", "n_item").distinct()
    pairs = cut(pairs)

    # each pair's item shingles against the document's, as text
    wanted = cut(pairs.select("doc_id").distinct())
    again = docs.join(hinted(wanted, most_bytes), "doc_id", "left_semi").select("doc_id", F.explode(F.transform(places(docs), as_text)).alias("shingle"))
    known = hinted(cut(full.select("shingle").distinct()), most_bytes)
    again = again.join(known, "shingle", "left_semi").distinct()
    asked = pairs.join(full.select("item_id", "shingle"), "item_id")
    shared = asked.join(again, ["doc_id", "shingle"]).groupBy("doc_id", "item_id", "n_item").agg(F.count("*").alias("n_shared"))
    found = shared.where(F.col("n_shared") * 4 >= F.col("n_item") * 3)
    return cut(found.select("doc_id", "item_id", "n_shared", F.col("n_item").cast("long").alias("n_item"), (F.col("n_shared") / F.col("n_item")).alias("containment")))


def decontaminate(docs: DataFrame, items: DataFrame, **options) -> DataFrame:
    """`docs` without the documents that contain an item; rows without an id stay."""
    name = "_hit"
    while name in docs.columns:
        name += "_"
    hit = find_contained(docs, items, **options).select(F.col("doc_id").alias(name)).distinct()
    return docs.join(hit, F.col(options.get("doc_id", "doc_id")) == F.col(name), "left_anti")


def _sql_shingles(table: str, key: str) -> str:
    return rf"""SELECT DISTINCT {key}, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS s
  FROM (SELECT {key}, list_filter(string_split_regex(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM {table})"""


ORACLE = f"""
WITH d AS ({_sql_shingles("documents", "doc_id")}),
b AS ({_sql_shingles("benchmark", "item_id")}),
n AS (SELECT item_id, count(*) AS n_item FROM b GROUP BY item_id)
SELECT doc_id, item_id, count(*) AS n_shared, n_item, count(*) / n_item AS containment
FROM d JOIN b USING (s) JOIN n USING (item_id) GROUP BY doc_id, item_id, n_item HAVING count(*) * 4 >= n_item * 3
"""
