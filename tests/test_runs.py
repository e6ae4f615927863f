"""Stored tables and score runs: what is current, what stays, what a failure leaves."""

import pytest
from pyspark.sql import functions as F

from scrutable.operators import anomalies, score_run, tables
from scrutable.sources.store import Runs, Store


@pytest.fixture()
def store(spark, tmp_path):
    return Store(spark, str(tmp_path))


def inputs(spark, flip=1.0):
    votes = spark.createDataFrame([(s, p, "pour" if (s + p) % 3 else "contre") for s in range(30) for p in range(25)], "scrutin_id long, person_id long, position string")
    seats = votes.withColumn("organe_id", F.col("person_id") % 4)
    tallies = seats.groupBy("scrutin_id", "organe_id").agg(F.count_if(F.col("position") == "pour").alias("pour"), F.count_if(F.col("position") == "contre").alias("contre"))
    rollcalls = votes.select("scrutin_id").distinct().withColumn("date_scrutin", F.lit("2020-01-01").cast("date"))
    anchors = spark.createDataFrame([(0, -1.0), (1, -0.3), (2, 0.4), (3, 1.0)], "organe_id long, coordonnee double")
    labels = rollcalls.select("scrutin_id", F.lit(1).alias("theme_id"), F.lit(1.0).alias("poids"), F.lit(0.5 * flip).alias("position_pour"), F.lit(1.0).alias("confiance"), F.lit(True).alias("reviewed"))
    themes = spark.createDataFrame([(1, "t", "oui", False), (2, "u", None, False)], "theme_id int, slug string, libelle_pole_positif string, axe_gauche_droite boolean")
    groups = spark.createDataFrame([(i, False) for i in range(4)], "organe_id long, is_non_inscrit boolean")
    members = spark.createDataFrame([(p, p, p % 4, "2019-01-01", None) for p in range(25)], "mandat_id long, person_id long, organe_id long, debut string, fin_exclusive string").withColumns({c: F.col(c).cast("date") for c in ("debut", "fin_exclusive")})
    return votes, tallies, rollcalls, anchors, labels, themes, groups, members


def test_a_run_is_current_only_when_published(spark, store):
    runs = Runs(store, "scores")
    assert runs.current_id() is None
    first = score_run.recompute(runs, *inputs(spark))
    assert first["themes_eligibles_ids"] == [1] and first["person_score_ecrites"] > 0
    one = runs.current("person_score").agg(F.sum("score")).first()[0]
    score_run.recompute(runs, *inputs(spark, -1.0))
    assert runs.current_id() == 2 and runs.current("person_score").agg(F.sum("score")).first()[0] == pytest.approx(-one)
    assert runs.read(1, "person_score").agg(F.sum("score")).first()[0] == one
    broken = list(inputs(spark))
    broken[0] = broken[0].withColumn("position", F.raise_error(F.lit("no votes")).cast("string"))
    with pytest.raises(Exception, match="no votes"):
        score_run.recompute(runs, *broken)
    state = {r.run_id: (r.status, r.is_current) for r in runs.runs().collect()}
    assert state == {1: ("published", False), 2: ("published", True), 3: ("failed", False)}
    themes = inputs(spark)[5]
    assert [r.slug for r in score_run.eligible_of_run(runs.runs(), themes).collect()] == ["t"]


def test_a_stored_table_is_derived_once(spark, store):
    calls = []

    def derive():
        calls.append(1)
        return spark.range(10).withColumn("k", F.col("id") % 3)

    assert store.table("x", derive, by="k").count() == 10 and store.table("x", derive).count() == 10 and len(calls) == 1
    assert store.table("x", derive, again=True).count() == 10 and len(calls) == 2


def test_ledger_refuses_unknown_kinds(spark):
    good = anomalies.refusals(spark.createDataFrame([(1, "ok"), (2, "scrutin_unanime")], "scrutin_id long, statut string"))
    assert [(r.kind, r.subject_uid) for r in anomalies.ledger(7, good).collect()] == [("scrutin_unanime", "2")]
    with pytest.raises(Exception, match="unknown kind"):
        anomalies.ledger(7, anomalies.found(spark.range(1), "autre", F.col("id"), "id")).collect()


def test_refused_measures_stay(spark):
    old = spark.createDataFrame([(1, "ok", 0.5), (2, "ok", 0.1)], "scrutin_id long, statut string, position_pour double")
    new = spark.createDataFrame([(1, "scrutin_unanime", None), (2, "ok", 0.2)], old.schema)
    assert {r.scrutin_id: (r.position_pour, r.change) for r in tables.measured(old, new).collect()} == {1: (0.5, "absent"), 2: (0.2, "updated")}


def test_contributions_keep_the_order_of_votes(spark, store, monkeypatch):
    """Few labels: votes stored by person are not dealt again; many: they are, with the same rows."""
    given = list(inputs(spark))
    given[0] = store.table("vote", lambda: inputs(spark)[0], by="person_id")
    runs, plans = Runs(store, "scores"), []
    write = Runs.write

    def seen(self, run_id, name, rows, by=None):
        if name == "contribution":
            plans.append((by, rows._jdf.queryExecution().executedPlan().toString()))
        return write(self, run_id, name, rows, by)

    monkeypatch.setattr(Runs, "write", seen)
    score_run.recompute(runs, *given)
    monkeypatch.setattr(score_run, "BROADCAST_LABELS", 0)
    score_run.recompute(runs, *given)
    (few, plan), (many, _) = plans
    assert few is None and "Exchange hashpartitioning" not in plan and many == "person_id"
    for name in ("contribution", "person_score"):
        a, b = runs.read(1, name), runs.read(2, name)
        assert a.count() > 0 and a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()
