"""The corpus pipeline: documents through five operators of scrutable.llm, stage by stage.

Each stage takes (spark, docs, sf_dir), works on every row it is given and returns a DataFrame with the
columns of documents; the last one returns what encoding yields. The caller writes a stage's rows and
reads them again for the next.

Any row may hold nulls, also as doc_id or text, may repeat another row or share its doc_id, and further columns
of any name pass through; an empty table gives an empty result. What each stage does with such rows is said
there. Documents that end up without text are still documents: only toxicity, near-dedup and decontamination
take rows away.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from scrutable.llm import op01_toxicity as toxicity
from scrutable.llm import op03_bpe_codec as bpe
from scrutable.llm import op07_minhash_neardup as neardup
from scrutable.llm import op09_decontamination as decontamination
from scrutable.llm import op10_line_dedup as lines
from scrutable.llm.common import cut, discard, merged, table
from scrutable.llm.op05_language_id import held_out
from scrutable.llm.queries import tokenizer


def packed(docs: DataFrame) -> DataFrame:
    """(doc_id, text, rest): all columns but the text as one, so that no name of theirs can meet another."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != "text"]).alias("rest"))


def unpacked(rows: DataFrame, columns: list[str], **changed) -> DataFrame:
    changed = {"text": F.col("text")} | changed
    return rows.select(*[(changed[c] if c in changed else F.col("rest").getField(c)).alias(c) for c in columns])


def numbered(docs: DataFrame) -> DataFrame:
    """(row, doc_id, text, rest) with a number of its own for each row, fixed by writing it: doc_id may be null or repeat."""
    return cut(packed(docs).withColumn("row", F.monotonically_increasing_id()))


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model accepts; it learns labels of the training fold only.

    Rows without doc_id have no label and are scored like others, null and empty texts by the calibrated base;
    without labels of both kinds every row stays.
    """
    held = held_out(0, 5)
    model = toxicity.fit(docs.where(~held), table(spark, sf_dir, "labels", "doc_id", "toxic").where(~held))
    return toxicity.accepted(docs, model)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, without lines that a document of smaller doc_id holds; n_chars is counted again.

    Rows without doc_id are kept whole and own no line; rows that share a doc_id are one document and keep their
    lines alike; a null text stays null.
    """
    kept = lines.dedup_lines(packed(docs).withColumn("given", F.col("text").isNotNull()), carry=("rest", "given"))
    text = F.when(F.col("given"), F.col("text"))
    return unpacked(kept, docs.columns, text=text, n_chars=F.length(text).cast("long"))


def keep_one_of_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each near-duplicate component: the one of smallest doc_id, rows without doc_id last.

    Rows, not ids, are compared: of rows that share a doc_id each stays unless it is near another; null and
    empty texts are near nothing and stay.
    """
    rows = numbered(docs)
    found = neardup.cluster(rows, id_col="row").select(F.col("doc_id").alias("row"), "component_id")
    order = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "row")
    first = merged(rows.select("row", "doc_id"), found, "row").groupBy("component_id").agg(F.min(order).alias("first"))
    return unpacked(merged(rows, first.select("first.row"), "row", "left_semi"), docs.columns)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that contain no benchmark item, with a doc_id or without; null and empty texts contain none."""
    clean = decontamination.decontaminate(numbered(docs), table(spark, sf_dir, "benchmark", "item_id", "text"), doc_id="row")
    return unpacked(clean, docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, with their digests and those of the decoded text; one row for each row, null texts are empty."""
    return bpe.digests(bpe.encode_decode(docs, tokenizer("word_bpe_49k.json")))


STAGES = [
    ("toxicity", drop_toxic),
    ("line dedup", drop_repeated_lines),
    ("MinHash near-dedup", keep_one_of_near_duplicates),
    ("benchmark decontamination", drop_contaminated),
    ("BPE encoding and decoding", encode),
]
#: Toxicity scores and MinHash clusters are not SQL; tests hold run() against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    given = docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        before, docs = docs, cut(stage(spark, docs, sf_dir))
        if before is not given:
            discard(before)
    return STAGES[-1][1](spark, docs, sf_dir)
