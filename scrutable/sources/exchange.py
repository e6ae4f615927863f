"""Label exchange files: export to CSV and JSON rows, import with checks of form."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..operators.ordered import running

VERSION, MAX_ROWS = 1, 25_000
#: Columns of the CSV exchange file, in order.
COLUMNS = ["schema_version", "scrutin_uid", "legislature", "numero", "date", "titre", "type", "sort", "pour", "contre", "abstentions", "participation", "positions_groupes", "url_an", "theme", "poids", "position_pour", "confiance", "justification"]
NEEDED = ["schema_version", "scrutin_uid", "theme", "poids", "position_pour", "confiance", "justification"]


class MalformedImport(ValueError):
    """A file that cannot be read as an exchange file at all."""


def page_url(legislature: Column, number: Column) -> Column:
    return F.format_string("https://www.assemblee-nationale.fr/dyn/%s/scrutins/%s", legislature.cast("string"), number.cast("string"))


def export(rollcalls: DataFrame, groups: DataFrame, labels: DataFrame, status: str = "tous", theme: str | None = None, limit: int | None = None, participation_min: float = 0.5) -> DataFrame:
    """One row a roll-call of the corpus with its groups and labels as arrays, newest first.

    `groups` has (scrutin_id, rang, abrege, position_majoritaire), `labels` has (scrutin_id, theme, poids,
    position_pour, confiance, justification). `status` is non_categorises, categorises or tous.
    """
    corpus = rollcalls.where((F.col("chambre") == "assemblee") & (F.col("participation") >= participation_min))
    if status == "non_categorises":
        corpus = corpus.join(labels.select("scrutin_id").distinct(), "scrutin_id", "left_anti")
    elif status == "categorises":
        corpus = corpus.join(labels.select("scrutin_id").distinct(), "scrutin_id", "left_semi")
    elif status != "tous":
        raise ValueError(f"unknown status {status!r}")
    if theme is not None:
        corpus = corpus.join(labels.where(F.col("theme") == theme).select("scrutin_id").distinct(), "scrutin_id", "left_semi")
    corpus = corpus.orderBy(F.col("date_scrutin").desc(), "scrutin_id")
    corpus = corpus.limit(limit) if limit is not None else corpus
    by_group = groups.groupBy("scrutin_id").agg(F.array_sort(F.collect_list(F.struct("rang", "abrege", "position_majoritaire"))).alias("groupes"))
    three = lambda c: F.col(c).cast("decimal(4,3)").cast("string").alias(c)
    entry = F.struct("theme", three("poids"), three("position_pour"), three("confiance"), "justification")
    by_label = labels.groupBy("scrutin_id").agg(F.array_sort(F.collect_list(entry)).alias("categorisation"))
    return corpus.join(by_group, "scrutin_id", "left").join(by_label, "scrutin_id", "left").withColumn("url_an", page_url(F.col("legislature"), F.col("numero"))).orderBy(F.col("date_scrutin").desc(), "scrutin_id")


def csv_rows(exported: DataFrame) -> DataFrame:
    """The 19 columns as text: one row a label, or one row of context for an unlabelled roll-call."""
    groups = F.concat_ws(";", F.transform(F.coalesce("groupes", F.array().cast(exported.schema["groupes"].dataType)), lambda g: F.concat(g["abrege"], F.lit(":"), F.coalesce(g["position_majoritaire"], F.lit("égalité")))))
    rows = exported.withColumn("c", F.explode_outer("categorisation")).withColumn("positions_groupes", groups)
    participation = F.col("participation").cast("decimal(9,3)").cast("string")
    given = {"schema_version": F.lit(VERSION), "date": F.col("date_scrutin"), "type": F.col("type_code"), "sort": F.col("sort_code") if "sort_code" in exported.columns else F.lit(None), "participation": participation} | {c: F.col(f"c.{c}") for c in ("theme", "poids", "position_pour", "confiance", "justification")}
    return rows.select(*[F.coalesce(given.get(c, F.col(c) if c in rows.columns else F.lit(None)).cast("string"), F.lit("")).alias(c) for c in COLUMNS])


def json_documents(exported: DataFrame) -> DataFrame:
    """One JSON text a roll-call."""
    return exported.select("scrutin_id", F.to_json(F.struct(F.lit(VERSION).alias("schema_version"), "scrutin_uid", "legislature", "numero", F.col("date_scrutin").alias("date"), "titre", "pour", "contre", "abstentions", "url_an", F.coalesce("groupes", F.array().cast(exported.schema["groupes"].dataType)).alias("groupes"), F.coalesce("categorisation", F.array().cast(exported.schema["categorisation"].dataType)).alias("categorisation"))).alias("json"))


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """Import rows (source, scrutin_uid, theme, poids, position_pour, confiance, justification) of a CSV file.

    A byte-order mark is tolerated. Refused: semicolons as separator, missing columns, ragged rows, unknown or
    mixed versions, missing roll-call uid, no rows, too many rows. Rows without theme import nothing.
    """
    first = spark.read.text(path).limit(1).collect()
    if not first:
        raise MalformedImport("empty file")
    header = first[0]["value"].lstrip("﻿")
    if header.count(";") > header.count(","):
        raise MalformedImport("semicolon as separator")
    names = [x.strip().strip('"') for x in header.split(",")]
    missing = [c for c in NEEDED if c not in names]
    if missing:
        raise MalformedImport(f"missing columns: {', '.join(missing)}")
    schema = ", ".join(f"`{n}` string" for n in names) + ", `_bad` string"
    rows = spark.read.csv(path, header=True, schema=schema, mode="PERMISSIVE", columnNameOfCorruptRecord="_bad", multiLine=True, escape='"', enforceSchema=True, ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)
    rows = rows.withColumn("line", F.monotonically_increasing_id() + 2).cache()
    version = F.trim("schema_version").try_cast("int")
    seen = rows.agg(F.count("*").alias("n"), F.count_if(F.col("_bad").isNotNull()).alias("bad"), F.count_if(version.isNull()).alias("unversioned"), F.min(version).alias("low"), F.max(version).alias("high"), F.count_if(F.coalesce(F.trim("scrutin_uid"), F.lit("")) == "").alias("nameless")).first()
    for wrong, why in ((seen["n"] == 0, "no rows"), (seen["n"] > MAX_ROWS, "too many rows"), (seen["bad"] > 0, "rows that do not fit the header"), (seen["unversioned"] > 0, "schema_version missing"), (seen["low"] != seen["high"], "mixed schema_version"), (seen["low"] != VERSION, "unknown schema_version"), (seen["nameless"] > 0, "scrutin_uid missing")):
        if wrong:
            rows.unpersist()
            raise MalformedImport(why)
    clean = lambda c: F.trim(F.coalesce(c, F.lit(""))).alias(c)
    kept = rows.where(F.trim(F.coalesce("theme", F.lit(""))) != "")
    return kept.select(F.concat(F.lit("ligne "), F.col("line").cast("string")).alias("source"), clean("scrutin_uid"), clean("theme"), clean("poids"), F.nullif(F.trim("position_pour"), F.lit("")).alias("position_pour"), clean("confiance"), F.coalesce("justification", F.lit("")).alias("justification"))


ENTRY = "array<struct<theme:string,poids:string,position_pour:string,confiance:string,justification:string>>"
SCHEMA = f"schema_version int, scrutins array<struct<scrutin_uid:string,categorisation:{ENTRY}>>"


def read_json(spark: SparkSession, path: str) -> DataFrame:
    """Import rows of a JSON exchange document; refused unless it parses and has the known version."""
    doc = spark.read.schema(SCHEMA + ", _bad string").json(path, multiLine=True, columnNameOfCorruptRecord="_bad").cache()
    state = doc.agg(F.count("*").alias("n"), F.count_if(F.col("_bad").isNotNull()).alias("bad"), F.count_if(F.col("schema_version").eqNullSafe(VERSION)).alias("good"), F.sum(F.coalesce(F.aggregate("scrutins", F.lit(0), lambda a, s: a + F.size(F.coalesce(s["categorisation"], F.array().cast(ENTRY)))), F.lit(0))).alias("rows")).first()
    if not state["n"] or state["bad"]:
        raise MalformedImport("invalid JSON")
    if state["good"] != state["n"]:
        raise MalformedImport("unknown schema_version")
    if state["rows"] > MAX_ROWS:
        raise MalformedImport("too many rows")
    s = doc.select(F.posexplode("scrutins").alias("i", "s")).select("i", "s.scrutin_uid", F.posexplode("s.categorisation").alias("j", "c"))
    return s.select(F.format_string("scrutins[%d].categorisation[%d]", "i", "j").alias("source"), "scrutin_uid", "c.theme", "c.poids", "c.position_pour", "c.confiance", F.coalesce("c.justification", F.lit("")).alias("justification"))


def parse_answers(lines: DataFrame) -> DataFrame:
    """(source, columns) of tab-separated answer lines (source, value): blank lines, comments, fences and stray headers are skipped."""
    value = F.trim("value")
    kept = lines.where((value != "") & ~value.startswith("#") & ~value.startswith("```") & ~F.lower(value).startswith("uid\t") & ~F.lower(value).startswith("scrutin_uid\t"))
    return kept.select("source", F.split(value, "\t").alias("columns"))


def read_answers(spark: SparkSession, path: str) -> DataFrame:
    return parse_answers(spark.read.text(path).select(F.input_file_name().alias("source"), "value"))


def lots(rollcalls: DataFrame, size: int, key: Column, without: Column | None = None) -> DataFrame:
    """Roll-calls dealt into lots: texts in order of their first date, `size` texts a lot: (lot, texte, scrutins).

    The rank of a text is a running sum over range partitions of that order.
    """
    rows = rollcalls if without is None else rollcalls.where(~without)
    texts = rows.groupBy(key.alias("texte")).agg(F.min("date_scrutin").alias("debut"), F.array_sort(F.collect_list(F.struct("date_scrutin", "scrutin_uid", "titre"))).alias("scrutins"))
    ranked = running(texts, [], ["debut", "texte"], rang=("sum", F.lit(1).cast("long")))
    return ranked.select((F.floor((F.col("rang") - 1) / size) + 1).cast("int").alias("lot"), "texte", "scrutins")
