"""A score run: measures, contributions and scores of one dataset computed once, kept, and made current."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, functions as F

from ..sources.store import Runs
from . import axis, scoring

#: So many labels at most are sent to every task; a row has about a hundred bytes there.
BROADCAST_LABELS = 200_000
TABLES = ("estimate", "eligible", "contribution", "person_score", "group_score", "mandate_score")


def recompute(runs: Runs, votes: DataFrame, tallies: DataFrame, rollcalls: DataFrame, anchors: DataFrame, labels: DataFrame, themes: DataFrame, groups: DataFrame, memberships: DataFrame) -> dict:
    """Compute a whole run and publish it; if anything fails the run before stays current. Gives the run's counters.

    Contributions and scores are ordered by their key, so a reader of one person or group skips the rest. Votes
    that are stored by person stay in that order where the labels, of which a roll-call has a few, are few enough to
    go to every task: then contributions are not shuffled. Otherwise they are dealt by person again.
    Without an eligible theme the score tables are empty, as all their rows need one.
    """
    run_id = runs.open()
    try:
        estimates = runs.write(run_id, "estimate", axis.estimate(tallies, anchors))
        eligible = runs.write(run_id, "eligible", scoring.eligible_themes(themes, labels))
        labelled = runs.write(run_id, "labelled", scoring.measured_labels(labels, estimates, eligible))
        few = labelled.count() <= BROADCAST_LABELS
        given = runs.write(run_id, "contribution", scoring.contributions(votes, F.broadcast(labelled) if few else labelled), by=None if few else "person_id")
        written = {
            "contribution": given,
            "person_score": runs.write(run_id, "person_score", scoring.person_scores(given), by="person_id"),
            "group_score": runs.write(run_id, "group_score", scoring.group_scores(tallies, groups, labelled, memberships)),
            "mandate_score": runs.write(run_id, "mandate_score", scoring.mandate_scores(tallies, groups, labelled, memberships, rollcalls), by="mandat_id"),
        }
        ids = sorted(r["theme_id"] for r in eligible.select("theme_id").collect())
        counters = {"themes_eligibles": len(ids), "themes_eligibles_ids": ids} | {f"{name}_ecrites": rows.count() for name, rows in written.items()}
    except Exception as error:
        runs.fail(run_id, str(error)[:500])
        raise
    runs.publish(run_id, json.dumps(counters))
    return counters


def eligible_of_run(runs: DataFrame, themes: DataFrame) -> DataFrame:
    """Themes that the current run found eligible, by the list of ids in its counters; later changes of labels do not count."""
    ids = F.from_json("counters", "themes_eligibles_ids array<int>")["themes_eligibles_ids"]
    listed = runs.where("is_current").select(F.explode(ids).alias("theme_id"))
    return themes.join(listed, "theme_id", "left_semi")


def health(beats: DataFrame, now, threshold_s: int = 60) -> DataFrame:
    """One row (database, worker): ok, stale or unknown by the last heartbeat."""
    from ..functions.text import freshness

    return beats.agg(F.max("last_seen_at").alias("last")).select(F.lit("ok").alias("database"), freshness(F.col("last"), F.lit(now), threshold_s).alias("worker"))
