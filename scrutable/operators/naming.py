"""Slugs, timelines and external identifiers."""

from __future__ import annotations

import heapq

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from ..functions.text import month_index, slugify
from ..sources.store import settled
from .ordered import running

TRAILING = "(-[0-9]+)+$"
NUMBERED = "^(.+)-([2-9]|[1-9][0-9]{1,17})$"


def _numbers(slugs: DataFrame) -> DataFrame:
    """(base, at) of each slug: it is the 0th choice of its own name, and the (n-1)th of the name before a number n."""
    named = slugs.where(F.col("slug").rlike(NUMBERED))
    parent = named.select(F.regexp_extract("slug", NUMBERED, 1).alias("base"), F.regexp_extract("slug", NUMBERED, 2).cast("long") - 1)
    return slugs.select(F.col("slug").alias("base"), F.lit(0).cast("long").alias("at")).union(parent)


def _disputes(new: DataFrame, bases: DataFrame, reserved: DataFrame) -> DataFrame:
    """(base, at) that a name cannot have because a longer name had it first, and the reverse.

    A slug like x-3 can be given to the third x, or to the first person whose own name is x-3. The latter wins if
    fewer x than it takes come before it in order of id. That is a count for each such slug, and the decisions
    follow one another from short to long names and small to large numbers.
    """
    long = bases.where(F.col("base").rlike(NUMBERED)).select(F.regexp_extract("base", NUMBERED, 1).alias("parent"), (F.regexp_extract("base", NUMBERED, 2).cast("long") - 1).alias("at"), F.col("base").alias("child"), "first_id")
    both = long.join(bases.select(F.col("base").alias("parent")), "parent", "left_semi")
    kids = settled(both.join(reserved.select(F.col("base").alias("parent"), "at"), ["parent", "at"], "left_anti"))
    people = new.join(kids.select(F.col("parent").alias("base")).distinct(), "base", "left_semi").select("base", F.col("person_id").alias("id"), F.lit(None).cast("long").alias("at"))
    firsts = kids.select(F.col("parent").alias("base"), F.col("first_id").alias("id"), "at")
    earlier = running(people.unionByName(firsts), ["base"], ["id", "at"], q=("sum", F.col("at").isNull().cast("long"))).where("at IS NOT NULL")
    marks = kids.select(F.col("parent").alias("base"), "at", "child").unionByName(reserved.withColumn("child", F.lit(None).cast("string")))
    held = running(marks, ["base"], ["at", "child"], res=("sum", F.col("child").isNull().cast("long"))).where("child IS NOT NULL")
    items = held.join(earlier.select("base", "at", "q"), ["base", "at"]).withColumn("stem", F.regexp_replace("base", TRAILING, ""))

    def decide(family: pd.DataFrame) -> pd.DataFrame:
        family = family.assign(depth=family["base"].str.count("-")).sort_values(["depth", "base", "at"])
        lost, out, base, gone = set(), [], None, 0
        for x in family.itertuples():
            if x.base != base:
                base, gone = x.base, int(x.base in lost)
            if x.at - x.res - gone >= x.q:
                gone += 1
                out.append((x.base, x.at))
            else:
                lost.add(x.child)
                out.append((x.child, 0))
        return pd.DataFrame(out, columns=["base", "at"])

    return items.groupBy("stem").applyInPandas(decide, "base string, at long")


def assign_slugs(persons: DataFrame, slugs: DataFrame) -> DataFrame:
    """(person_id, slug, from_identifier) for persons without a current slug, as if given one by one in order of id.

    Takes (person_id, an_uid, wikidata_qid, prenom, nom) and existing (person_id, slug, is_current). A slug once
    given stays reserved. A name that leaves nothing falls back to the identifier. The n-th person of a name takes
    the n-th of its choices (the name, name-2, name-3, ...) that is free: its place in order of id, and the number
    of choices taken before it, are running sums over range partitions, so that any number of equal names is
    spread over tasks. Names without a second bearer and without a taken choice keep theirs at once. Only slugs
    that two different names could have are settled one after the other, by counts and not by persons.
    """
    current = slugs.where("is_current").select("person_id")
    name = slugify(F.concat_ws(" ", F.coalesce("prenom", F.lit("")), F.coalesce("nom", F.lit(""))))
    base = F.when(name == "", F.lower(F.coalesce("an_uid", "wikidata_qid"))).otherwise(name)
    new = persons.join(current, "person_id", "left_anti").select("person_id", base.alias("base"), (name == "").alias("from_identifier"))
    bases = settled(new.groupBy("base").agg(F.count("*").alias("n"), F.min("person_id").alias("first_id")))
    reserved = settled(_numbers(slugs.select("slug").distinct()).join(bases.select("base"), "base", "left_semi"))
    taken = settled(reserved.unionByName(_disputes(new, bases, reserved)))
    shifted = running(taken, ["base"], ["at"], k=("sum", F.lit(1).cast("long"))).select("base", (F.col("at") - F.col("k") + 1).alias("place"), "at")
    busy = bases.where("n > 1").select("base").union(taken.select("base")).distinct()
    plain = new.join(busy, "base", "left_anti").select("person_id", F.col("base").alias("slug"), "from_identifier")
    ranked = running(new.join(busy, "base", "left_semi"), ["base"], ["person_id"], place=("sum", F.lit(1).cast("long"))).withColumn("place", F.col("place") - 1)
    both = ranked.withColumn("at", F.lit(None).cast("long")).unionByName(shifted, allowMissingColumns=True).withColumn("kind", F.when(F.col("at").isNull(), 1).otherwise(0))
    numbered = running(both, ["base"], ["place", "kind", "at"], passed=("sum", 1 - F.col("kind").cast("long"))).where("kind = 1")
    number = F.col("place") + F.col("passed") + 1
    slug = F.when(number == 1, F.col("base")).otherwise(F.concat_ws("-", "base", number.cast("string")))
    return plain.unionByName(numbered.select("person_id", slug.alias("slug"), "from_identifier"))


def place(segments: DataFrame, today) -> DataFrame:
    """Each segment's columns and row on its person's monthly grid.

    Takes (person_id, piste, key, debut, fin) with the last day in `fin`. The grid runs from the month of the
    person's first start to the month after the last end (today for open ones). Within a track, in order of
    start, end and key, a segment goes to the first row that is free; a day takes a whole column. Tracks stream
    sorted through their tasks; the state is a heap of the rows in use by end and one of the free ones, as large
    as segments lie on top of each other.
    """
    first, last = F.min(month_index(F.col("debut"))), F.max(month_index(F.coalesce("fin", F.lit(today)))) + 1
    domain = segments.groupBy("person_id").agg(first.alias("m0"), (last - first).alias("columns"))
    rows = segments.join(domain, "person_id")
    begin = month_index(F.col("debut")) - F.col("m0") + 1
    end = F.when(F.col("fin").isNull(), F.col("columns") + 1).otherwise(F.greatest(month_index(F.col("fin")) - F.col("m0") + 1, begin + 1))
    items = rows.select("person_id", "piste", "key", begin.cast("int").alias("column_start"), end.cast("int").alias("column_end"), "debut", F.coalesce("fin", F.lit("9999-12-31").cast("date")).alias("fin"))
    sorted_ = items.repartition("person_id", "piste").sortWithinPartitions("person_id", "piste", "debut", "fin", "key").drop("debut", "fin")

    def put(batches):
        track, used, free, n = None, [], [], 0
        for batch in batches:
            spots = []
            for person, piste, s, e in zip(*(batch.column(c).to_pylist() for c in ("person_id", "piste", "column_start", "column_end")), strict=True):
                if (person, piste) != track:
                    track, used, free, n = (person, piste), [], [], 0
                while used and used[0][0] <= s:
                    heapq.heappush(free, heapq.heappop(used)[1])
                if free:
                    spot = heapq.heappop(free)
                else:
                    spot, n = n, n + 1
                heapq.heappush(used, (e, spot))
                spots.append(spot)
            yield batch.append_column("row", pa.array(spots, pa.int32()))

    return sorted_.mapInArrow(put, T.StructType([*sorted_.schema.fields, T.StructField("row", T.IntegerType())]))


def year_markers(segments: DataFrame, today) -> DataFrame:
    """(person_id, year, column_start, column_end): the scale above a person's grid; a grid without a month has none."""
    first, last = F.min(month_index(F.col("debut"))), F.max(month_index(F.coalesce("fin", F.lit(today)))) + 1
    months = segments.groupBy("person_id").agg(first.alias("m0"), last.alias("m1")).where("m0 < m1").select("person_id", "m0", F.explode(F.sequence("m0", F.col("m1") - 1)).alias("m"))
    return months.groupBy("person_id", F.floor(F.col("m") / 12).cast("int").alias("year")).agg((F.min(F.col("m") - F.col("m0")) + 1).cast("int").alias("column_start"), (F.max(F.col("m") - F.col("m0")) + 2).cast("int").alias("column_end"))


def resolve_external_ids(hits: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Pairs (an_uid, qid) that are one-to-one both ways, and those that are not with the side at fault.

    The good pairs come from counts, however many partners a key has; only the others, for who reads them, list
    their partners.
    """
    pairs = hits.where("an_uid IS NOT NULL AND qid IS NOT NULL").groupBy("an_uid", "qid").agg(F.min("image_url").alias("image_url"))
    one_qid = pairs.groupBy("an_uid").agg(F.count("*").alias("n"), F.min("qid").alias("qid"), F.min("image_url").alias("image_url")).where("n = 1")
    one_uid = pairs.groupBy("qid").agg(F.count("*").alias("n")).where("n = 1").select("qid")
    good = one_qid.join(one_uid, "qid", "left_semi").select("an_uid", "qid", "image_url")
    by_uid = pairs.groupBy("an_uid").agg(F.array_sort(F.collect_list("qid")).alias("qids"))
    by_qid = pairs.groupBy("qid").agg(F.array_sort(F.collect_list("an_uid")).alias("an_uids"))
    side = F.when(F.size("qids") > 1, "an_uid").otherwise("qid")
    both = pairs.join(by_uid, "an_uid").join(by_qid, "qid").where("size(qids) > 1 OR size(an_uids) > 1")
    bad = both.select("an_uid", side.alias("cote"), F.when(F.size("qids") > 1, F.col("qids")).otherwise(F.col("an_uids")).alias("autres")).distinct()
    return good, bad
