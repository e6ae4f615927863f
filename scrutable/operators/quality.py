"""Data-quality rules: each gives the rows that break it."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .intervals import overlapping_pairs

DECLARED = ("pour", "contre", "abstention", "non_votant", "non_votant_volontaire")


def overlapping_memberships(memberships: DataFrame) -> DataFrame:
    """Pairs of memberships of one person in one group that overlap, the smaller id first."""
    pairs = overlapping_pairs(memberships, ["person_id", "organe_id"], "mandat_id")
    ids = (F.col("a.mandat_id"), F.col("b.mandat_id"))
    return pairs.select("person_id", "organe_id", F.least(*ids).alias("mandat_a"), F.greatest(*ids).alias("mandat_b"))


def causes_on_voters(votes: DataFrame) -> DataFrame:
    return votes.where("cause_non_vote IS NOT NULL AND position <> 'non_votant'")


def unknown_declarations(corrections: DataFrame) -> DataFrame:
    return corrections.where(~F.col("position_declaree").isin(*DECLARED))


def persons_without_identifier(persons: DataFrame) -> DataFrame:
    return persons.where("an_uid IS NULL AND wikidata_qid IS NULL")


def slug_conflicts(slugs: DataFrame) -> DataFrame:
    """Persons with several current slugs, and slugs given twice: (kind, key, n)."""
    current = slugs.where("is_current").groupBy(F.col("person_id").cast("string").alias("key")).agg(F.count("*").alias("n")).where("n > 1")
    twice = slugs.groupBy(F.col("slug").alias("key")).agg(F.count("*").alias("n")).where("n > 1")
    return current.select(F.lit("current").alias("kind"), "key", "n").unionByName(twice.select(F.lit("slug").alias("kind"), "key", "n"))


def half_poled_themes(themes: DataFrame) -> DataFrame:
    return themes.where("(libelle_pole_negatif IS NULL) <> (libelle_pole_positif IS NULL) OR trim(slug) = ''")


def labels_out_of_bounds(labels: DataFrame) -> DataFrame:
    return labels.where("NOT (poids > 0 AND poids <= 1) OR NOT (position_pour BETWEEN -1 AND 1) OR NOT (confiance BETWEEN 0 AND 1)" + (" OR length(trim(justification)) < 10" if "justification" in labels.columns else ""))


def label_provenance(labels: DataFrame) -> DataFrame:
    """Imports without import id (or the reverse), reviewers without date (or the reverse)."""
    return labels.where("(method = 'import') <> (import_id IS NOT NULL) OR (reviewed_by IS NULL) <> (reviewed_at IS NULL)")


def weights_not_one(labels: DataFrame) -> DataFrame:
    """Roll-calls whose label weights do not sum to exactly 1."""
    return labels.groupBy("scrutin_id").agg(F.sum(F.col("poids").cast("decimal(10,3)")).alias("somme")).where("somme <> 1")


def positions_against_axis(labels: DataFrame, themes: DataFrame) -> DataFrame:
    """Labels with a position on a theme without an axis, or without one on a theme with."""
    return labels.join(themes.select("theme_id", "libelle_pole_positif"), "theme_id").where("(position_pour IS NULL) <> (libelle_pole_positif IS NULL)").select("scrutin_id", "theme_id")


def idle_revisions(revisions: DataFrame) -> DataFrame:
    return revisions.where(F.col("avant").eqNullSafe(F.col("apres")))


def several_current(df: DataFrame) -> DataFrame:
    return df.agg(F.count_if("is_current").alias("n")).where("n > 1")


def estimates_out_of_range(estimates: DataFrame) -> DataFrame:
    return estimates.where("statut = 'ok' AND NOT (position_pour BETWEEN -1 AND 1 AND separation BETWEEN 0 AND 1 AND couverture BETWEEN 0 AND 1 AND votants_couverts >= 0 AND bipolarite BETWEEN 0 AND 1)")


def contribution_rules(contributions: DataFrame) -> DataFrame:
    """Abstentions with a value or weight, exclusions with weight, abstentions not marked as such."""
    absent = F.col("position") == "abstention"
    bad = (absent != F.col("apport").isNull()) | (absent & (F.col("poids") != 0)) | (F.col("exclusion").isNotNull() & (F.col("poids") != 0)) | (absent != F.col("exclusion").eqNullSafe(F.lit("abstention")))
    return contributions.where(bad)


def scores_out_of_range(scores: DataFrame) -> DataFrame:
    more = [f"NOT ({c} BETWEEN 0 AND 1)" for c in ("cohesion", "incertitude") if c in scores.columns]
    return scores.where(" OR ".join(["NOT (score BETWEEN -1 AND 1)", "contributions < 0", *more]))


def unsourced(candidates: DataFrame) -> DataFrame:
    return candidates.where("source_url IS NULL OR trim(source_url) = ''")


def unlicensed(photos: DataFrame) -> DataFrame:
    return photos.where("licence IS NULL OR trim(licence) = ''")


def bad_threshold(parameters: DataFrame) -> DataFrame:
    return parameters.where("NOT (participation_min > 0 AND participation_min <= 1)")


def tally_mismatches(rollcalls: DataFrame, votes: DataFrame) -> DataFrame:
    """Roll-calls whose nominal votes are not as many as voters and non-voters."""
    n = votes.groupBy("scrutin_id").agg(F.count("*").alias("nominatifs"))
    return rollcalls.join(n, "scrutin_id").where("nominatifs <> nombre_votants + non_votants").select("scrutin_id", "nominatifs", "nombre_votants", "non_votants")
