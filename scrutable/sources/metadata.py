"""External metadata from captured answers: a graph endpoint's hits, and image pages looked up by title."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions.text import commons_title, last_segment

TITLES_PER_CALL = 50  # fixed value: titles that one lookup may name


def graph_hits(answers: DataFrame) -> DataFrame:
    """(qid, an_uid, image_url) of the bindings of captured JSON answers in `raw`; bindings without person or number drop out."""
    value = "struct<value:string>"
    rows = answers.select(F.explode(F.from_json("raw", f"results struct<bindings array<struct<p:{value},an:{value},img:{value}>>>")["results"]["bindings"]).alias("b"))
    kept = rows.where("b.p IS NOT NULL AND b.an IS NOT NULL")
    return kept.select(last_segment(F.col("b.p.value")).alias("qid"), F.concat(F.lit("PA"), F.col("b.an.value")).alias("an_uid"), F.col("b.img.value").alias("image_url"))


def wanted_titles(resolved: DataFrame) -> DataFrame:
    """(an_uid, title) of resolved persons with an image."""
    return resolved.where("image_url IS NOT NULL").select("an_uid", commons_title(F.col("image_url")).alias("title"))


def calls(titles: DataFrame) -> DataFrame:
    """(call, titles): titles dealt into lookups of at most TITLES_PER_CALL, joined by a bar.

    Titles are dealt by ranges, and each range is cut by itself, so no step sees them all.
    """
    ranged = titles.select("title").distinct().repartitionByRange("title").sortWithinPartitions("title").withColumn("id", F.monotonically_increasing_id())
    part, place = F.shiftright("id", 33), F.col("id").bitwiseAND((1 << 33) - 1)
    return ranged.groupBy(part.alias("part"), F.floor(place / TITLES_PER_CALL).alias("call")).agg(F.array_join(F.array_sort(F.collect_list("title")), "|").alias("titles"), F.count("*").alias("n"))


def normal_title(title):
    """Titles are compared with blanks for underscores."""
    return F.replace(title, F.lit("_"), F.lit(" "))


def photos(pages: DataFrame, wanted: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Photos with a usable licence, and anomalies of the others: (an_uid, url, commons_file, licence, licence_url, auteur), (kind, subject_uid, detail).

    `pages` has one captured JSON answer in `raw`. A wanted title that no answer holds is an anomaly too.
    """
    value = "struct<value:string>"
    info = f"array<struct<url:string,extmetadata:struct<LicenseShortName:{value},LicenseUrl:{value},Artist:{value}>>>"
    page = F.explode(F.map_values(F.from_json("raw", f"query struct<pages map<string,struct<title:string,imageinfo:{info}>>>")["query"]["pages"])).alias("page")
    seen = pages.select(page).select(normal_title(F.col("page.title")).alias("title"), F.col("page.title").alias("commons_file"), F.get("page.imageinfo", F.lit(0)).alias("info"))
    asked = wanted.select("an_uid", normal_title(F.col("title")).alias("title"))
    met = asked.join(seen, "title")
    licence = F.nullif(F.trim("info.extmetadata.LicenseShortName.value"), F.lit(""))
    good = met.where("info IS NOT NULL").where(licence.isNotNull()).select("an_uid", F.col("info.url").alias("url"), "commons_file", licence.alias("licence"), F.col("info.extmetadata.LicenseUrl.value").alias("licence_url"), F.col("info.extmetadata.Artist.value").alias("auteur"))
    why = F.when(F.col("info").isNull(), "pas d'imageinfo").when(licence.isNull(), "pas de licence exploitable dans extmetadata")
    absent = asked.select("an_uid").subtract(met.select("an_uid")).select("an_uid", F.lit("titre Commons absent de la réponse").alias("raison"))
    bad = met.select("an_uid", why.alias("raison")).where("raison IS NOT NULL").unionByName(absent)
    return good, bad.select(F.lit("photo_sans_licence").alias("kind"), F.col("an_uid").alias("subject_uid"), F.to_json(F.struct("raison")).alias("detail"))
