"""Upserts, seeds and ledgers as pure functions of old and new frames."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window, functions as F


def merge(old: DataFrame, new: DataFrame, keys: list[str], keep_absent: bool = True) -> DataFrame:
    """`old` with `new` applied by key, plus `change`: created, updated, unchanged, or absent (only in old).

    A row counts as updated only if some other column differs, nulls being equal. With `keep_absent` false
    rows only in old are marked `removed` for the caller to filter.
    """
    values = [c for c in new.columns if c not in keys]
    o = old.select(*keys, F.struct(*values).alias("_o") if values else F.lit(1).alias("_o"))
    n = new.select(*keys, F.struct(*values).alias("_n") if values else F.lit(1).alias("_n"))
    both = o.join(n, keys, "full")
    change = F.when(F.col("_o").isNull(), "created").when(F.col("_n").isNull(), "absent" if keep_absent else "removed").when(F.col("_o").eqNullSafe(F.col("_n")), "unchanged").otherwise("updated")
    picked = F.coalesce("_n", "_o")
    return both.select(*keys, *[picked[c].alias(c) for c in values], change.alias("change"))


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """`new` by key whatever it holds, and the rows of `old` that it does not name."""
    return new.unionByName(old.join(new.select(*keys), keys, "left_anti").select(*new.columns))


def measured(old: DataFrame, new: DataFrame, key: str = "scrutin_id", status: str = "statut") -> DataFrame:
    """Measures after a rerun: written only where they changed; a row whose subject is refused now stays as it was."""
    return merge(old, new.where(F.col(status) == "ok"), [key])


def replace_all(old: DataFrame, new: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """A seed taken whole: the rows of `new`, and the keys of `old` that are gone."""
    return new, old.select(key).subtract(new.select(key))


def audit(merged: DataFrame, keys: list[str], who: str) -> DataFrame:
    """One row a change of a keyed merge: who, what, and the new values as JSON."""
    values = [c for c in merged.columns if c not in (*keys, "change")]
    return merged.where("change IN ('created', 'updated')").select(*keys, F.lit(who).alias("author"), F.col("change").alias("action"), F.to_json(F.struct(*values)).alias("detail"))


def change_counts(merged: DataFrame) -> DataFrame:
    return merged.groupBy("change").agg(F.count("*").alias("n"))


def latest(df: DataFrame, keys: list[str], *order) -> DataFrame:
    """The first row of each key in the given order."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_n = 1").drop("_n")


def archive(existing: DataFrame, documents: DataFrame) -> DataFrame:
    """Documents not yet archived: new by (source, uid, content_hash)."""
    keys = ["source", "uid", "content_hash"]
    return documents.dropDuplicates(keys).join(existing.select(*keys), keys, "left_anti")


def deactivate_absent(old: DataFrame, new: DataFrame, key: str, flag: str = "actif") -> DataFrame:
    """Seeded rows: present ones as given and active, absent ones kept but inactive."""
    gone = old.join(new.select(key), key, "left_anti").withColumn(flag, F.lit(False))
    return new.withColumn(flag, F.lit(True)).unionByName(gone.select(*new.columns, flag), allowMissingColumns=True)


def fill_ids(persons: DataFrame, resolved: DataFrame) -> DataFrame:
    """Persons with their external id set where it differs, and whether it changed."""
    found = resolved.select("an_uid", F.col("qid").alias("_q"))
    joined = persons.join(found, "an_uid", "left")
    return joined.withColumns({"changed": F.col("_q").isNotNull() & ~F.col("_q").eqNullSafe(F.col("wikidata_qid")), "wikidata_qid": F.coalesce("_q", "wikidata_qid")}).drop("_q")


def run_status(ledger: DataFrame) -> DataFrame:
    """Last outcome of each run or job of an append-only ledger of (run_id, at, status)."""
    return ledger.groupBy("run_id").agg(F.max_by("status", "at").alias("status"), F.max("at").alias("at"))


def fingerprint(df: DataFrame) -> DataFrame:
    """Order-free digest of a table: row count and sums of two row hashes; equal tables have equal digests."""
    row = [F.col(c) for c in sorted(df.columns)]
    return df.agg(F.count("*").alias("n"), F.sum(F.xxhash64(*row).cast("decimal(38,0)")).alias("h1"), F.sum(F.xxhash64(F.lit(1), *row).cast("decimal(38,0)")).alias("h2"))


def totals(votes: DataFrame) -> DataFrame:
    """(person_id, votes_total, premier_vote, dernier_vote) of votes with (person_id, date_scrutin)."""
    return votes.groupBy("person_id").agg(F.count("*").alias("votes_total"), F.min("date_scrutin").alias("premier_vote"), F.max("date_scrutin").alias("dernier_vote"))


def totals_after(old: DataFrame, added: DataFrame, removed: DataFrame, now: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Totals brought up to date from the votes that came and went, equal to those of all votes as they are now.

    Counts are added and taken off, the first and last day move outwards with what came. Only where a vote went
    that was a person's first or last are that person's votes read again: `now` gives the votes of the persons it
    is asked for. Persons left without votes go.
    """
    named = lambda rows, sign: totals(rows).select("person_id", *[F.col(c).alias(f"{c}{sign}") for c in ("votes_total", "premier_vote", "dernier_vote")])
    both = old.join(named(added, "_in"), "person_id", "full").join(named(removed, "_out"), "person_id", "left")
    n = F.coalesce("votes_total", F.lit(0)) + F.coalesce("votes_total_in", F.lit(0)) - F.coalesce("votes_total_out", F.lit(0))
    moved = both.select("person_id", n.alias("votes_total"), F.least("premier_vote", "premier_vote_in").alias("premier_vote"), F.greatest("dernier_vote", "dernier_vote_in").alias("dernier_vote"), "premier_vote_out", "dernier_vote_out").where("votes_total > 0")
    edge = F.coalesce((F.col("premier_vote_out") <= F.col("premier_vote")) | (F.col("dernier_vote_out") >= F.col("dernier_vote")), F.lit(False))
    again = totals(now(moved.where(edge).select("person_id")))
    return moved.where(~edge).select("person_id", "votes_total", "premier_vote", "dernier_vote").unionByName(again)
