"""Kernels on hand-computed cases."""

import math

import pytest
from pyspark.sql import functions as F

from scrutable.functions import text as X
from scrutable.operators import axis, scoring


def estimate(spark, groups):
    """groups: (pour, contre, coordinate or None) of one roll-call."""
    tallies = spark.createDataFrame([(1, i, p, c) for i, (p, c, _) in enumerate(groups)], "scrutin_id long, organe_id long, pour long, contre long")
    anchors = spark.createDataFrame([(i, x) for i, (_, _, x) in enumerate(groups) if x is not None], "organe_id long, coordonnee double")
    return axis.estimate(tallies, anchors).first()


def test_two_opposed_camps(spark):
    row = estimate(spark, [(100, 0, -1.0), (0, 100, 1.0)])
    assert (row.statut, row.position_pour, row.separation, row.bipolarite, row.couverture) == ("ok", -1.0, 1.0, 0.0, 1.0)


def test_split_group(spark):
    row = estimate(spark, [(100, 0, -1.0), (30, 30, 0.0), (0, 100, 1.0)])
    assert row.separation == pytest.approx(2 * 230 / 260 - 1, abs=5e-4)


def test_opposition_from_both_sides(spark):
    row = estimate(spark, [(0, 20, -1.0), (100, 0, 0.0), (0, 80, 1.0)])
    assert row.bipolarite == pytest.approx(0.4)


@pytest.mark.parametrize(
    "groups, status",
    [
        ([(40, 40, None), (50, 50, 0.5)], "ancrage_insuffisant"),
        ([(0, 0, 0.5)], "ancrage_insuffisant"),
        ([(5, 5, 0.5), (4, 4, -0.5)], "trop_peu_de_votants"),
        ([(50, 0, 0.5), (40, 0, -0.5)], "scrutin_unanime"),
        ([(1, 1, None), (0, 9, 0.0)], "ancrage_insuffisant"),
    ],
)
def test_refusals_in_order(spark, groups, status):
    row = estimate(spark, groups)
    assert row.statut == status and row.position_pour is None and row.bipolarite is None


def test_one_coordinate_separates_nothing(spark):
    assert estimate(spark, [(60, 10, 0.25), (10, 60, 0.25)]).separation == 0.0


def test_a_light_uncovered_group_changes_no_measure(spark):
    with_it, without = estimate(spark, [(100, 0, -1.0), (0, 100, 1.0), (3, 2, None)]), estimate(spark, [(100, 0, -1.0), (0, 100, 1.0)])
    assert (with_it.position_pour, with_it.separation) == (without.position_pour, without.separation) and with_it.couverture < 1


def contributions(spark, rows):
    return spark.createDataFrame([(1, 1, i, p, a, w, x, r) for i, (p, a, w, x, r) in enumerate(rows)], "person_id long, theme_id int, scrutin_id long, position string, apport double, poids double, exclusion string, reviewed boolean")


def test_weighted_mean_and_error(spark):
    row = scoring.person_scores(contributions(spark, [("pour", 1.0, 0.5, None, True), ("contre", -1.0, 0.5, None, False), ("pour", 0.4, 1.0, None, False), ("abstention", None, 0.0, "abstention", True), ("pour", 0.9, 0.0, "desaccord_mesure", False)]), least=3).first()
    mean = 0.2
    spread = math.sqrt((0.5 * 0.64 + 0.5 * 1.44 + 0.04) / 2) / math.sqrt(3)
    assert (row.score, row.contributions, row.abstentions, row.relues, row.ecartes_desaccord) == (pytest.approx(mean), 3, 1, 2, 1)
    assert row.incertitude == pytest.approx(spread, abs=6e-4)


def test_threshold_gates_only_the_score(spark):
    rows = contributions(spark, [("pour", 1.0, 0.5, None, False)] * 4)
    assert scoring.person_scores(rows).count() == 0 and scoring.person_scores(rows, least=4).count() == 1


def test_no_weight_no_score(spark):
    assert scoring.person_scores(contributions(spark, [("pour", 1.0, 0.0, None, False)] * 6), least=0).count() == 0


def test_zero_label_differs_for_persons_and_groups(spark):
    """A zero label on a measured roll-call is kept for persons and dropped for groups."""
    labelled = spark.createDataFrame([(1, 1, 0.0, 1.0, 1.0, False, 0.5, 0.0, True)], "scrutin_id long, theme_id int, label double, poids_theme double, confiance double, reviewed boolean, measured double, bipolarite double, axe_gauche_droite boolean")
    votes = spark.createDataFrame([(1, 7, "pour")], "scrutin_id long, person_id long, position string")
    assert scoring.contributions(votes, labelled).first().exclusion is None
    assert scoring.agreeing(labelled).count() == 0


def test_vote_turns_the_sign_and_nonvoters_do_not_count(spark):
    labelled = spark.createDataFrame([(1, 1, 0.6, 0.5, 0.5, False, 0.5, 0.5, True), (2, 1, 0.6, 1.0, 1.0, False, -0.5, 0.0, True)], "scrutin_id long, theme_id int, label double, poids_theme double, confiance double, reviewed boolean, measured double, bipolarite double, axe_gauche_droite boolean")
    votes = spark.createDataFrame([(1, 7, "contre"), (1, 8, "non_votant"), (2, 7, "pour")], "scrutin_id long, person_id long, position string")
    rows = {r.scrutin_id: r for r in scoring.contributions(votes, labelled).collect()}
    assert rows[1].apport == -0.6 and rows[1].poids == pytest.approx(0.125) and rows[2].exclusion == "desaccord_mesure" and rows[2].poids == 0


def test_cohesion_takes_rows_without_weight(spark):
    rows = spark.createDataFrame([(1, 1, 60, 20, 0.5, 1.0, 1.0, 0.0), (1, 1, 20, 20, 0.5, 1.0, 1.0, 1.0)], "organe_id long, theme_id int, pour long, contre long, label double, poids_theme double, confiance double, bipolarite double")
    row = scoring.tally_scores(rows, "organe_id", "theme_id").first()
    assert (row.cohesion, row.contributions, row.score) == (pytest.approx(80 / 120, abs=5e-4), 80, 0.25)


def test_unanimous_and_median_counters(spark):
    rows = spark.createDataFrame([("ok", 0.9, 0.6), ("ok", 1.0, 0.2), ("scrutin_unanime", None, None)], "statut string, couverture double, bipolarite double")
    row = axis.run_counters(rows).first()
    assert (row.scrutins_examines, row.estimations_ecrites, row.refus_unanime, row.couverture_mediane, row.bipolarite_superieure_a_0_5) == (3, 2, 1, 0.95, 1)


def test_rounding_is_half_away_from_zero(spark):
    row = spark.range(1).select(axis.rounded(F.lit(0.2345)).alias("a"), axis.rounded(F.lit(-0.2345)).alias("b")).first()
    assert (row.a, row.b) == (0.235, -0.235)


def test_a_mean_half_way_does_not_depend_on_sums_of_doubles(spark):
    """-0.1475 exactly, which sums of doubles make -0.14749999999999996."""
    votes = [(1.0, 0.2184), (-0.8, 0.1048), (1.0, 0.156), (-0.7, 0.3384), (-0.5, 0.4944)]
    rows = contributions(spark, [("pour", a, w, None, True) for a, w in votes]).coalesce(1)
    assert scoring.person_scores(rows).first().score == -0.148
    assert scoring.person_scores(rows.withColumn("apport", -F.col("apport"))).first().score == 0.148
    tallies = rows.select(F.lit(1).alias("organe_id"), "theme_id", F.lit(1).alias("pour"), F.lit(0).alias("contre"), F.col("apport").alias("label"), F.col("poids").alias("poids_theme"), F.lit(1.0).alias("confiance"), F.lit(0.0).alias("bipolarite"))
    assert scoring.tally_scores(tallies, "organe_id", "theme_id").first().score == -0.148


def test_half_way_values_round_as_the_sql_casts_them(spark):
    """A thousand times the double 0.5045 lies below 504.5: twelve such values, of which 0.5045 shows in the second decimal."""
    import duckdb

    halves = [(k + 0.5) / 1000 for k in range(1000)]
    want = duckdb.sql(f"SELECT list(CAST(CAST(x AS DECIMAL(4,3)) AS DOUBLE)) FROM (SELECT unnest({halves}::DOUBLE[]) AS x)").fetchall()[0][0]
    assert sum(w < x for w, x in zip(want, halves)) == 12
    rows = spark.createDataFrame([(i, x) for i, x in enumerate(halves)], "i int, x double")
    assert [r.r for r in rows.orderBy("i").select(axis.rounded(F.col("x")).alias("r")).collect()] == want
    means = spark.createDataFrame([(i, 2 * i + 1, 2) for i in range(1000)], "i int, _a long, _n long")
    assert [r.r for r in means.orderBy("i").select(scoring.thousandths("_a", "_n").alias("r")).collect()] == want
    votes = contributions(spark, [("pour", a, w, None, False) for a, w in ((0.5, 0.276), (0.5, 0.164), (0.5, 0.097), (0.6, 0.054), (0.5, 0.609))])  # 0.5045 exactly, 0.504 for sums of doubles in any order
    row = scoring.person_scores(votes.coalesce(1)).select("score", X.orientation_label(F.col("score"), F.lit("Non"), F.lit("Oui")).alias("label")).first()
    assert (row.score, row.label) == (0.504, "plutôt Oui (+0.50)")
    assert scoring.person_scores(votes.withColumn("apport", -F.col("apport"))).first().score == -0.504


def test_scores_are_one_pass_over_one_shuffle(spark):
    """Values a thousandth apart under one light and one heavy weight, whose sums cancel in doubles, and a label beyond its bounds."""
    rows = contributions(spark, [("pour", 1.0, 1.0, None, False)] * 5 + [("pour", 0.999, 0.000000001, None, False), ("contre", None, 0.0, "abstention", False)])
    one = scoring.person_scores(rows)
    assert one._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1
    row = scoring.weighted(rows, "person_id", "theme_id").first()
    assert row.contributions == 6 and row.score == 1.0
    assert row.incertitude == pytest.approx(math.sqrt(1e-9 * 1e-6 * 5 / (5 + 1e-9) / (5 + 1e-9)) / math.sqrt(6), rel=1e-9)
    assert scoring.weighted(contributions(spark, [("pour", -9.999, 1.0, None, False)] * 3), "person_id", "theme_id").first().incertitude == 0.0
