import datetime

import pytest
from pyspark.sql import functions as F

from scrutable.functions import text as X
from scrutable.operators import imports, intervals, naming, quality, tables
from scrutable.plans import catalog

D = datetime.date.fromisoformat


def normalise(spark, rows):
    df = spark.createDataFrame([(1, 1, u, D(a), D(b) if b else None) for u, a, b in rows], "person_id long, organe_id long, mandat_uid string, debut date, fin date")
    row = intervals.normalise(df).first()
    return [(m.mandat_uid, str(m.debut), str(m.fin_exclusive) if m.fin_exclusive else None) for m in row.retained], [(e.kind, e.uid) for e in row.events]


@pytest.mark.parametrize(
    "rows, kept, events",
    [
        ([("A", "2020-01-01", "2022-01-01"), ("B", "2020-06-01", "2021-01-01")], ["A"], [("inclusion", "B")]),
        ([("A", "2020-01-01", "2020-06-01"), ("B", "2020-01-01", "2022-01-01")], ["B"], [("inclusion", "A")]),
        ([("A", "2020-01-01", "2020-06-01"), ("B", "2020-01-01", "2020-06-01")], ["A"], [("inclusion", "B")]),
        ([("A", "2020-01-01", "2020-06-15"), ("B", "2020-06-15", "2021-01-01")], ["A", "B"], [("charniere", "A")]),
        ([("A", "2020-01-01", "2020-06-15"), ("B", "2020-07-01", None)], ["A", "B"], []),
        ([("A", "2020-01-01", "2020-12-31"), ("B", "2020-10-01", "2021-01-31")], ["A"], [("chevauchement", "B")]),
        ([("A", "2020-01-01", "2020-03-31"), ("B", "2020-03-01", "2021-01-31")], ["B"], [("chevauchement", "A")]),
    ],
)
def test_normalisation(spark, rows, kept, events):
    got, told = normalise(spark, rows)
    assert [u for u, _, _ in got] == kept and told == events


def test_hinge_shortens_by_a_day_and_open_ends_stay_open(spark):
    got, _ = normalise(spark, [("A", "2020-01-01", "2020-06-15"), ("B", "2020-06-15", None)])
    assert got == [("A", "2020-01-01", "2020-06-15"), ("B", "2020-06-15", None)]


def test_cross_overlaps_name_the_shorter_and_skip_unattached(spark):
    rows = spark.createDataFrame([(1, "A", 1, D("2020-01-01"), D("2021-01-01"), False), (1, "B", 2, D("2020-12-01"), D("2020-12-20"), False), (1, "C", 3, D("2020-01-01"), None, True)], "person_id long, mandat_uid string, organe_id long, debut date, fin_exclusive date, is_non_inscrit boolean")
    assert [tuple(r) for r in intervals.cross_overlaps(rows).collect()] == [(1, "A", "B", "B")]


def test_as_of_takes_the_latest_start(spark):
    periods = spark.createDataFrame([(1, 11, 1, D("2020-01-01"), None), (1, 12, 2, D("2021-01-01"), D("2022-01-01"))], "person_id long, mandat_id long, organe_id long, debut date, fin_exclusive date")
    points = spark.createDataFrame([(1, D("2021-06-01")), (1, D("2022-01-01")), (1, D("2019-01-01"))], "person_id long, d date")
    got = {str(r.d): r.organe_id for r in intervals.as_of(points, periods, "person_id", "d", "debut", "fin_exclusive", "organe_id", "mandat_id").collect()}
    assert got == {"2021-06-01": 2, "2022-01-01": 1, "2019-01-01": None}


def test_slugs(spark):
    got = [r[0] for r in spark.createDataFrame([("Éric Ciotti-Dûpont",), ("  Œuvre  d'Été ",), ("Æ",), ("İstanbul Çağ",), (None,)], "t string").select(X.slugify(F.col("t"))).collect()]
    assert got == ["eric-ciotti-dupont", "uvre-d-ete", "", "istanbul-cag", None]


def test_slug_assignment_with_collisions(spark):
    people = spark.createDataFrame([(1, "PA1", None, "Jean", "Dupont"), (2, "PA2", None, "Jean", "Dupont"), (3, "PA3", None, "Jean", "Dupont-2"), (4, None, "Q4", "Æ", None), (5, "PA5", None, "Eve", "Kept")], "person_id long, an_uid string, wikidata_qid string, prenom string, nom string")
    old = spark.createDataFrame([("jean-dupont", 99, False), ("eve-kept", 5, True)], "slug string, person_id long, is_current boolean")
    got = {r.person_id: (r.slug, r.from_identifier) for r in naming.assign_slugs(people, old).collect()}
    assert got == {1: ("jean-dupont-2", False), 2: ("jean-dupont-3", False), 3: ("jean-dupont-2-2", False), 4: ("q4", True)}


def test_slugs_of_whole_texts(spark, tmp_path):
    import re
    import unicodedata

    texts = [None, "", "--", "Élan vital, " * 60 + "fin.", "Ça et là\n" * 500 + "Œuvre", "x" * 250 + " Y", "a" * 199 + " - été"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    plain = lambda t: "".join(c for c in unicodedata.normalize("NFD", t.lower()) if not unicodedata.combining(c))
    want = {i: None if t is None else re.sub("[^a-z0-9]+", "-", plain(t)).strip("-") for i, t in enumerate(texts)}
    assert {r.doc_id: r.slug for r in catalog.QUERIES["slugs_of_texts"](spark, str(tmp_path)).collect()} == want


def brute_rows(segments):
    ends, rows = [], []
    for s, e in segments:
        for i, x in enumerate(ends):
            if x <= s:
                ends[i] = e
                rows.append(i)
                break
        else:
            ends.append(e)
            rows.append(len(ends) - 1)
    return rows


def test_timeline_rows_match_greedy(spark):
    rows = [(1, "GP", f"k{i:02d}", D(a), D(b) if b else None) for i, (a, b) in enumerate([("2010-01-05", "2010-01-05"), ("2010-01-20", "2010-06-01"), ("2010-02-01", "2010-04-01"), ("2010-06-01", None), ("2010-07-01", "2011-01-01")])]
    placed = {r.key: r for r in naming.place(spark.createDataFrame(rows, "person_id long, piste string, key string, debut date, fin date"), D("2011-03-15")).collect()}
    order = [placed[f"k{i:02d}"] for i in range(5)]
    assert [r.row for r in order] == brute_rows([(r.column_start, r.column_end) for r in order])
    assert (order[0].column_start, order[0].column_end) == (1, 2) and order[3].column_end == 16


def test_external_ids_must_be_one_to_one(spark):
    hits = spark.createDataFrame([("PA1", "Q1"), ("PA1", "Q1"), ("PA2", "Q2"), ("PA2", "Q3"), ("PA3", "Q4"), ("PA4", "Q4")], "an_uid string, qid string").withColumn("image_url", F.lit(None).cast("string"))
    good, bad = naming.resolve_external_ids(hits)
    assert [tuple(r)[:2] for r in good.collect()] == [("PA1", "Q1")]
    assert sorted((r.an_uid, r.cote, tuple(r.autres)) for r in bad.collect()) == [("PA2", "an_uid", ("Q2", "Q3")), ("PA3", "qid", ("PA3", "PA4")), ("PA4", "qid", ("PA3", "PA4"))]


def test_external_ids_over_all_lines(spark, tmp_path):
    lines = [(1, 10, 50.0, 0.0), (1, 11, 1.0, 0.05), (2, 12, 3.0, 0.05), (2, 12, 50.0, 0.0), (3, 13, 50.0, 0.0), (4, 13, 2.0, 0.02), (5, 14, 7.0, 0.09)]
    spark.createDataFrame(lines, "l_suppkey long, l_partkey long, l_quantity double, l_discount double").write.parquet(str(tmp_path / "lineitem.parquet"))
    got = catalog.QUERIES["external_ids_all"](spark, str(tmp_path))
    assert sorted(map(tuple, got.collect())) == [("PA2", "Q12"), ("PA5", "Q14")]
    assert "collect_list" not in got._jdf.queryExecution().toString()


def test_display_strings(spark):
    d = lambda s: F.lit(s).cast("date")
    row = spark.range(1).select(
        X.group_label(F.lit("G"), d("2020-01-02"), d("2021-03-04"), F.lit(False)).alias("a"),
        X.group_label(F.lit("G"), d("2020-01-02"), F.lit(None).cast("date"), F.lit(True)).alias("b"),
        X.vote_label(F.lit("non_votant"), F.lit("PSE")).alias("c"),
        X.orientation_label(F.lit(-0.256), F.lit("Non"), F.lit("Oui")).alias("d"),
        X.evidence_label(F.lit(1), F.lit(0)).alias("e"),
        X.set_aside_label(F.lit(0)).alias("f"),
        X.hidden_themes_label(F.lit(2)).alias("g"),
        X.carrier_text(F.lit("l'article 2 du projet de loi de finances (première lecture).")).alias("h"),
        X.commons_title(F.lit("http://x/Special:FilePath/Jean_Dupont%20%28a%29.jpg")).alias("i"),
        X.cohesion_label(F.lit(0.583)).alias("j"),
        X.retry_seconds(F.lit(4)).alias("k"),
    ).first()
    assert row.a == "a siégé au groupe G du 02/01/2020 au 04/03/2021"
    assert row.b == "non-inscrit·e depuis le 02/01/2020"
    assert row.c == "n'a pas pris part au vote : présidait la séance"
    assert row.d == "plutôt Non (-0.26)" and row.e.startswith("1 scrutin — aucune") and row.f is None and row.g.startswith("2 thèmes")
    assert row.h == "projet de loi de finances" and row.i == "File:Jean Dupont (a).jpg" and row.j.startswith("cohésion : 58%") and row.k == 135


def test_merge_counts_real_changes_only(spark):
    old = spark.createDataFrame([(1, "a", None), (2, "b", 1), (3, "c", 2)], "k long, v string, w int")
    new = spark.createDataFrame([(1, "a", None), (2, "x", 1), (4, "d", 3)], "k long, v string, w int")
    got = {r.k: (r.v, r.change) for r in tables.merge(old, new, ["k"]).collect()}
    assert got == {1: ("a", "unchanged"), 2: ("x", "updated"), 3: ("c", "absent"), 4: ("d", "created")}
    assert tables.fingerprint(old).collect() == tables.fingerprint(old.orderBy(F.desc("k")).repartition(3)).collect()
    again = tables.merge(new, new, ["k"])
    assert again.where("change <> 'unchanged'").count() == 0


def test_import_rules(spark):
    themes = spark.createDataFrame([("t1", "Oui", True), ("t2", None, True), ("t3", "Oui", False)], "slug string, libelle_pole_positif string, actif boolean")
    known = spark.createDataFrame([("S1",), ("S2",)], "scrutin_uid string")
    ok = "une justification"
    rows = [("1", "S1", "t1", "1.000", "0.5", "0.9", ok), ("2", "S1", "t1", "1", "0.5", "0.9", ok), ("3", "S2", "t2", "0.5", "0.1", "0.9", ok), ("4", "S2", "t1", "0.1234", None, "1.2", "court"), ("5", "S9", "zz", "x", "y", "z", ""), ("6", "S2", "t3", "0", "-1.5", "abc", ok)]
    df = spark.createDataFrame(rows, "source string, scrutin_uid string, theme string, poids string, position_pour string, confiance string, justification string")
    got = sorted((r.source, r.problem) for r in imports.row_problems(df, themes, known).collect())
    assert got == sorted([("2", "doublon"), ("3", "position_sans_axe"), ("4", "poids_decimales"), ("4", "position_absente"), ("4", "confiance_hors_bornes"), ("4", "justification_courte"), ("5", "theme_inconnu"), ("5", "scrutin_inconnu"), ("6", "theme_inactif"), ("6", "poids_hors_bornes"), ("6", "position_hors_bornes"), ("6", "confiance_invalide")])


def test_import_is_all_or_nothing_and_stale_plans_are_seen(spark):
    themes = spark.createDataFrame([("t1", "Oui", True), ("t2", "Oui", True)], "slug string, libelle_pole_positif string, actif boolean")
    known = spark.createDataFrame([("S1",)], "scrutin_uid string")
    fields = "scrutin_uid string, theme string, poids string, position_pour string, confiance string, justification string"
    old = spark.createDataFrame([("S1", "t1", "1.000", "0.500", "0.900", "ancienne raison", "import", False), ("S7", "t1", "1.000", "0.500", "0.900", "intouchée ici", "manual", False)], fields + ", method string, reviewed boolean")
    half = spark.createDataFrame([("1", "S1", "t1", "0.600", "0.5", "0.9", "assez longue"), ("2", "S1", "t2", "0.300", "0.5", "0.9", "assez longue")], "source string, " + fields)
    shown, total, plan = imports.build_plan(half, themes, known, old)
    assert (total, plan, shown.first().problem) == (1, None, "somme_des_poids")
    full = half.withColumn("poids", F.when(F.col("theme") == "t2", "0.400").otherwise(F.col("poids")))
    _, total, plan = imports.build_plan(full, themes, known, old)
    assert total == 0 and [r.classement for r in plan.collect()] == ["modification"]
    after = imports.apply_plan(old, full, plan)
    assert sorted((r.scrutin_uid, r.theme) for r in after.collect()) == [("S1", "t1"), ("S1", "t2"), ("S7", "t1")]
    assert imports.revisions(plan).count() == 1
    assert not imports.stale(plan, plan) and imports.stale(plan, plan.withColumn("classement", F.lit("conflit")))


def test_quality_rules_both_ways(spark):
    labels = spark.createDataFrame([(1, "0.600"), (1, "0.400"), (2, "0.500")], "scrutin_id long, poids string")
    assert [r.scrutin_id for r in quality.weights_not_one(labels).collect()] == [2]
    votes = spark.createDataFrame([("pour", "MG"), ("non_votant", "MG"), ("pour", None)], "position string, cause_non_vote string")
    assert quality.causes_on_voters(votes).count() == 1
    rows = spark.createDataFrame([("abstention", None, 0.0, "abstention"), ("abstention", 0.5, 0.0, "abstention"), ("pour", 0.5, 0.2, "desaccord_mesure"), ("pour", 0.5, 0.2, None), ("pour", 0.5, 0.0, "abstention")], "position string, apport double, poids double, exclusion string")
    assert quality.contribution_rules(rows).count() == 3
    people = spark.createDataFrame([("PA1", None), (None, None)], "an_uid string, wikidata_qid string")
    assert quality.persons_without_identifier(people).count() == 1
    assert quality.bad_threshold(spark.createDataFrame([(0.0,), (0.5,)], "participation_min double")).count() == 1


def test_import_life_cycle(spark):
    asked = [
        (1, 1, "accept", 7), (1, 2, "stage", 1), (1, 3, "accept", 2), (1, 4, "accept", 2), (1, 5, "reject", None), (1, 6, "accept", 2),
        (2, 1, "stage", 1), (2, 2, "reject", None), (2, 3, "stage", 3),
        (3, 1, "reject", None), (4, 1, "stage", None), (4, 2, "accept", 5), (4, 3, "accept", 6), (4, 4, "accept", 6),
    ]
    got = imports.life_cycle(spark.createDataFrame(asked, "import_id long, at long, action string, preview long")).orderBy("import_id", "at").collect()
    assert [r.outcome for r in got] == ["unknown", "pending", "stale", "applied", "decided", "decided", "pending", "rejected", "decided", "unknown", "pending", "stale", "stale", "applied"]


def test_deleted_labels_leave_a_revision(spark):
    labels = spark.createDataFrame([("a", "t", "1.000", "0.500", "0.500", "because of it"), ("b", "t", "1.000", "0.500", "0.500", "because of it")], "scrutin_uid string, theme string, poids string, position_pour string, confiance string, justification string")
    after, told = imports.delete_labels(labels, spark.createDataFrame([("a",), ("c",)], "scrutin_uid string"), "me")
    assert [r.scrutin_uid for r in after.collect()] == ["b"]
    assert [(r.scrutin_uid, r.apres, r.author) for r in told.collect()] == [("a", "[]", "me")] and "because" in told.first().avant


def test_a_grid_that_ends_before_it_starts_has_no_years(spark):
    """Only an open period that begins after today's month: its grid has no month, and counting does not run backwards."""
    today = datetime.date(2000, 1, 1)
    for start, years in (("2000-02-01", []), ("2000-06-01", []), ("2000-01-31", [(2000, 1, 2)])):
        rows = spark.sql(f"SELECT 1L AS person_id, '1' AS piste, 'a' AS key, DATE '{start}' AS debut, CAST(NULL AS DATE) AS fin")
        assert [tuple(r)[1:] for r in naming.year_markers(rows, today).collect()] == years
