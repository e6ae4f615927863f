"""The anomaly ledger: every kind of finding as (kind, subject_uid, detail), appended by run, never stopping a job."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

#: The closed list of kinds.
KINDS = ("acteur_inconnu", "mandat_inclus", "mandat_charniere", "mandat_chevauchement", "groupe_fantome", "cause_non_vote_inconnue", "bloc_nominatif_inconnu", "compteurs_incoherents", "photo_sans_licence", "wikidata_qid_ambigu", "slug_derive_d_identifiant", "ancrage_insuffisant", "trop_peu_de_votants", "scrutin_unanime")
#: Kinds of the events of membership clean-up.
EVENTS = {"inclusion": "mandat_inclus", "charniere": "mandat_charniere", "chevauchement": "mandat_chevauchement"}


def found(rows: DataFrame, kind, subject, *detail) -> DataFrame:
    return rows.select((F.lit(kind) if isinstance(kind, str) else kind).alias("kind"), subject.cast("string").alias("subject_uid"), F.to_json(F.struct(*detail)).alias("detail"))


def refusals(estimates: DataFrame) -> DataFrame:
    """Roll-calls without a measure, by the reason."""
    return found(estimates.where("statut <> 'ok'"), F.col("statut"), F.col("scrutin_id"), "statut")


def membership_events(cleaned: DataFrame) -> DataFrame:
    """Events among the rows of intervals.cleaned."""
    names = F.create_map(*[F.lit(x) for kv in EVENTS.items() for x in kv])
    return found(cleaned.where(F.col("kind").isin(*EVENTS)), F.element_at(names, F.col("kind")), F.col("mandat_uid"), "person_id", "organe_id")


def derived_slugs(assigned: DataFrame) -> DataFrame:
    return found(assigned.where("from_identifier"), "slug_derive_d_identifiant", F.col("person_id"), "slug")


def ambiguous_ids(bad: DataFrame) -> DataFrame:
    return found(bad, "wikidata_qid_ambigu", F.col("an_uid"), "cote", "autres")


def unknown_actors(cast: DataFrame, persons: DataFrame) -> DataFrame:
    """Actors who voted and are in no register, once each."""
    return found(cast.select("acteur_uid").distinct().join(persons.select(F.col("an_uid").alias("acteur_uid")), "acteur_uid", "left_anti"), "acteur_inconnu", F.col("acteur_uid"), "acteur_uid")


def ledger(run_id: int, *frames: DataFrame) -> DataFrame:
    """(ingestion_run_id, kind, subject_uid, detail) of all findings; kinds outside the list are refused."""
    out = frames[0]
    for x in frames[1:]:
        out = out.unionByName(x)
    known = F.when(F.col("kind").isin(*KINDS), F.col("kind")).otherwise(F.raise_error(F.concat(F.lit("unknown kind "), F.col("kind"))))
    return out.select(F.lit(run_id).cast("long").alias("ingestion_run_id"), known.alias("kind"), "subject_uid", "detail")
