"""Where a roll-call falls on the left-right axis, from the tallies of its groups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

#: Least covered share, least covered voters.
COVERAGE_MIN, VOTERS_MIN = 0.90, 20


def rounded(value: Column, scale: int = 3) -> Column:
    """Stored precision of a measure: half away from zero, given back as a double.

    What is rounded is the double times 10 ** scale, as DuckDB casts: 0.5045 times 1000 lies below 504.5. A cast to
    decimal here would round the shortest text of the double instead.
    """
    return (F.round(value * 10**scale) / 10**scale).cast(f"decimal({scale + 1},{scale})").cast("double")


def estimate(tallies: DataFrame, anchors: DataFrame) -> DataFrame:
    """One row a roll-call: (scrutin_id, statut, position_pour, separation, couverture, votants_couverts, bipolarite).

    `tallies` has (scrutin_id, organe_id, pour, contre), a roll-call's rows in any number; `anchors` has
    (organe_id, coordonnee). `statut` is ok, or the first refusal that applies: ancrage_insuffisant,
    trop_peu_de_votants, scrutin_unanime; refused roll-calls have no measures. One shuffle by roll-call
    serves every step: tallies are summed to one row for each coordinate before anything else is done.
    """
    covered = tallies.join(anchors, "organe_id", "left")
    by_x = covered.groupBy("scrutin_id", "coordonnee").agg(F.sum("pour").alias("p"), F.sum("contre").alias("c"))
    whole = Window.partitionBy("scrutin_id")
    known = F.col("coordonnee").isNotNull()
    inside = lambda x: F.sum(F.when(known, x).otherwise(0)).over(whole)
    steps = by_x.select(
        "*",
        F.sum(F.col("p") + F.col("c")).over(whole).alias("total"),
        inside(F.col("p")).alias("pp"),
        inside(F.col("c")).alias("cc"),
        inside(F.col("p") * F.col("coordonnee")).alias("px"),
        inside(F.col("c") * F.col("coordonnee")).alias("cx"),
    )
    before = whole.orderBy(F.col("coordonnee").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, 0)
    steps = steps.withColumns({"left_p": F.sum(F.when(known, F.col("p"))).over(before), "left_c": F.sum(F.when(known, F.col("c"))).over(before), "mu": F.try_divide("px", "pp")})
    side = F.greatest("left_p", "left_c") + F.greatest(F.col("pp") - F.col("left_p"), F.col("cc") - F.col("left_c"))
    one = steps.groupBy("scrutin_id").agg(
        F.first("total").alias("total"),
        F.first("pp").alias("pp"),
        F.first("cc").alias("cc"),
        F.first("mu").alias("mu"),
        F.first(F.try_divide("cx", "cc")).alias("mu_minus"),
        F.count_if(known).alias("points"),
        F.max(F.when(known, side)).alias("best"),
        F.coalesce(F.sum(F.when(F.col("coordonnee") < F.col("mu"), F.col("c"))), F.lit(0)).alias("g"),
        F.coalesce(F.sum(F.when(F.col("coordonnee") > F.col("mu"), F.col("c"))), F.lit(0)).alias("d"),
    )
    voters = F.col("pp") + F.col("cc")
    coverage = F.coalesce(F.try_divide(voters.cast("double"), F.col("total").cast("double")), F.lit(0.0))
    status = F.when(coverage < COVERAGE_MIN, "ancrage_insuffisant").when(voters < VOTERS_MIN, "trop_peu_de_votants").when((F.col("pp") == 0) | (F.col("cc") == 0), "scrutin_unanime").otherwise("ok")
    ok = status == "ok"
    position = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), (F.col("mu") - F.col("mu_minus")) / 2))
    rate = F.greatest(F.lit(0.5), F.try_divide(F.col("best").cast("double"), voters.cast("double")))
    separation = F.when(F.col("points") < 2, 0.0).otherwise(F.greatest(F.lit(0.0), rate * 2 - 1))
    bipolarity = F.least(F.try_divide(F.col("g").cast("double"), F.col("cc").cast("double")), F.try_divide(F.col("d").cast("double"), F.col("cc").cast("double"))) * 2
    return one.select(
        "scrutin_id",
        status.alias("statut"),
        F.when(ok, rounded(position)).alias("position_pour"),
        F.when(ok, rounded(separation)).alias("separation"),
        F.when(ok, rounded(coverage)).alias("couverture"),
        F.when(ok, voters).cast("long").alias("votants_couverts"),
        F.when(ok, rounded(bipolarity)).alias("bipolarite"),
    )


def run_counters(estimates: DataFrame) -> DataFrame:
    """One row of run counters: examined, written, the three refusals, medians and the bipolar count."""
    ok = F.col("statut") == "ok"
    return estimates.agg(
        F.count("*").alias("scrutins_examines"),
        F.count_if(ok).alias("estimations_ecrites"),
        F.count_if(F.col("statut") == "ancrage_insuffisant").alias("refus_couverture"),
        F.count_if(F.col("statut") == "trop_peu_de_votants").alias("refus_effectif"),
        F.count_if(F.col("statut") == "scrutin_unanime").alias("refus_unanime"),
        rounded(F.median("couverture")).alias("couverture_mediane"),
        rounded(F.median("bipolarite")).alias("bipolarite_mediane"),
        F.count_if(F.col("bipolarite") > 0.5).alias("bipolarite_superieure_a_0_5"),
    )
