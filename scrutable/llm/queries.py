"""One query for each operator, with production parameters over its whole table, and the same in SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import functions as F

from . import op01_toxicity as op1
from . import op02_license_scan as op2
from . import op03_bpe_codec as op3
from . import op04_substring_dedup as op4
from . import op05_language_id as op5
from . import op06_embedding_neardup as op6
from . import op07_minhash_neardup as op7
from . import op08_token_counts as op8
from . import op09_decontamination as op9
from . import op10_line_dedup as op10
from . import op11_pii as op11
from . import op12_conversation_repair as op12
from . import op13_centroid_clustering as op13
from .common import table


def tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_toxicity(spark, sf_dir):
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    held = op5.held_out(0, 5)
    model = op1.fit(docs.where(~held), table(spark, sf_dir, "labels", "doc_id", "toxic").where(~held))
    return op1.score(docs, model).select("doc_id", held.alias("held_out"), "score", "predicted", "n_restored")


def op2_license_scan(spark, sf_dir):
    found = op2.scan(table(spark, sf_dir, "documents", "doc_id", "text"))
    ids = F.concat_ws("", F.transform("sentence_ids", lambda x: F.concat(F.lit("<"), x, F.lit(">"))))
    names = F.concat_ws("", F.transform("licences", lambda x: F.concat(x, F.lit(";"))))
    return found.select("doc_id", ids.alias("sentence_ids"), names.alias("licences"))


def op3_bpe_codec(spark, sf_dir):
    return op3.digests(op3.encode_decode(table(spark, sf_dir, "documents", "doc_id", "text"), tokenizer("word_bpe_49k.json")))


def op4_substring_dedup(spark, sf_dir):
    kept = op4.dedup_substrings(table(spark, sf_dir, "documents", "doc_id", "text"))
    return kept.select("doc_id", "n_words", "n_removed", F.sha2(F.encode("text", "UTF-8"), 256).alias("kept_sha256"))


def op5_language_id(spark, sf_dir):
    docs = table(spark, sf_dir, "documents", "doc_id", "text", "lang")
    held = op5.held_out(2, 4)
    filters = op5.fit(docs.where(~held))
    return op5.predict(docs, filters).select("doc_id", held.alias("held_out"), "lang_pred", "score")


def op6_embedding_neardup(spark, sf_dir):
    return op6.link(table(spark, sf_dir, "embeddings", "vec_id", "embedding"))


def op7_minhash_neardup(spark, sf_dir):
    return op7.cluster(table(spark, sf_dir, "documents", "doc_id", "text"))


def op8_token_counts(spark, sf_dir):
    return op8.count_tokens(table(spark, sf_dir, "documents", "doc_id", "text"), tokenizer("byte_bpe_50k.json"))


def op9_decontamination(spark, sf_dir):
    return op9.find_contained(table(spark, sf_dir, "documents", "doc_id", "text"), table(spark, sf_dir, "benchmark", "item_id", "text"))


def op10_line_dedup(spark, sf_dir):
    kept = op10.dedup_lines(table(spark, sf_dir, "documents", "doc_id", "text"))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2(F.encode("text", "UTF-8"), 256).alias("kept_sha256"))


def op11_pii(spark, sf_dir):
    found = op11.find(table(spark, sf_dir, "documents", "doc_id", "text"))
    base = F.concat_ws(",", F.concat(*[op11.listed(k) for k in op11.KINDS]))
    counts = [F.size(k).cast("long").alias(f"n_{k}") for k in op11.KINDS]
    return found.select("doc_id", *counts, F.sha2(base, 256).alias("base_sha256"), F.concat_ws(",", F.concat(*[op11.listed(k) for k in (*op11.KINDS, "term")])).alias("spans"))


def op12_conversation_repair(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations", "conv_id", "turn", "role", "text")
    return op12.summarise(op12.damage(rows), rows)


def op13_centroid_clustering(spark, sf_dir):
    return op13.cluster(table(spark, sf_dir, "embeddings", "vec_id", "embedding")).drop("centroid")


QUERIES = {f.__name__: f for f in (op1_toxicity, op2_license_scan, op3_bpe_codec, op4_substring_dedup, op5_language_id, op6_embedding_neardup, op7_minhash_neardup, op8_token_counts, op9_decontamination, op10_line_dedup, op11_pii, op12_conversation_repair, op13_centroid_clustering)}
ORACLES = {"op2_license_scan": op2.ORACLE, "op4_substring_dedup": op4.ORACLE, "op6_embedding_neardup": op6.ORACLE, "op7_minhash_neardup": op7.ORACLE, "op9_decontamination": op9.ORACLE, "op10_line_dedup": op10.ORACLE, "op11_pii": op11.ORACLE, "op12_conversation_repair": op12.ORACLE, "op13_centroid_clustering": op13.ORACLE}
