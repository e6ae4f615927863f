import json
import zipfile

import pytest
from pyspark.sql import functions as F

from scrutable.functions import text as X
from scrutable.sources import archives, documents, exchange, seeds


def rollcall(uid="VTANR5L17V1", **more):
    voter = lambda a, **k: {"acteurRef": a, "mandatRef": "PM1", "parDelegation": "false"} | k
    body = {
        "uid": uid,
        "numero": "1",
        "legislature": "17",
        "dateScrutin": "2024-10-08",
        "titre": "l'ensemble",
        "modePublicationDesVotes": "DecompteNominatif",
        "typeVote": {"codeTypeVote": "SPS"},
        "sort": {"code": "adopté"},
        "syntheseVote": {"nombreVotants": "4", "suffragesExprimes": "4", "decompte": {"pour": "3", "contre": "1", "nonVotants": "1"}},
        "ventilationVotes": {
            "organe": {
                "groupes": {
                    "groupe": [
                        {"organeRef": "PO1", "nombreMembresGroupe": "10", "vote": {"positionMajoritaire": "pour", "decompteVoix": {"pour": "3", "contre": "0"}, "decompteNominatif": {"pours": {"votant": [voter("PA1"), voter("PA2", parDelegation="true"), {"acteurRef": None}]}, "contres": None, "abstentions": [None, None], "surprises": {"votant": voter("PA9")}}}},
                        {"organeRef": "PO0", "nombreMembresGroupe": {"#text": "5"}, "vote": {"decompteVoix": {"contre": "1"}, "decompteNominatif": {"contre": {"votant": voter("PA3")}, "nonVotant": [voter("PA4", causePositionVote="ZZZ")]}}},
                    ]
                }
            }
        },
        "miseAuPoint": {"pours": {"votant": [{"acteurRef": "PA3"}]}, "nonVotantsVolontaires": [{"acteurRef": "PA4"}], "autre": {"votant": {"acteurRef": "PA5"}}},
    }
    return json.dumps({"scrutin": body | more})


@pytest.fixture()
def archive(tmp_path):
    actor = {"acteur": {"uid": {"#text": "PA1"}, "etatCivil": {"ident": {"civ": "M.", "prenom": "Jean", "nom": "Test"}, "infoNaissance": {"dateNais": "1970-02-30"}, "dateDeces": {"@xsi:nil": "true"}}, "mandats": {"mandat": {"uid": "PM1", "typeOrgane": "GP", "dateDebut": "2022-06-20", "organes": {"organeRef": "PO1"}}}}}
    no_list = {"acteur": {"uid": "PA2", "mandats": None}}
    with zipfile.ZipFile(tmp_path / "a.zip", "w") as z:
        z.writestr("json/acteur/PA1.json", json.dumps(actor))
        z.writestr("json/acteur/PA2.json", json.dumps(no_list))
        z.writestr("json/acteur/PA3.json", json.dumps({"acteur": {"uid": None}}))
        z.writestr("json/organe/PO1.json", json.dumps({"organe": {"uid": "PO1", "codeType": "GP", "libelle": "Groupe", "libelleAbrev": "NI", "viMoDe": {"dateDebut": "2022-06-20", "dateFin": "2024-06-09"}}}))
        z.writestr("json/VTANR5L17V1.json", rollcall())
        z.writestr("json/VTCGR5L17V2.json", rollcall("VTCGR5L17V2", dateScrutin="2023-01-01"))
        z.writestr("json/broken.json", rollcall("VTX", titre=None))
        z.writestr("readme.txt", "no")
    return str(tmp_path)


def test_archives(spark, archive):
    docs = archives.read_zips(spark, archive)
    assert docs.count() == 7 and {r.category for r in docs.select("category").distinct().collect()} == {"acteur", "organe", ""}
    assert docs.where("content_hash = sha2(raw, 256)").count() == 7
    assert spark.range(1).select(archives.archive_path(F.lit(16))).first()[0].startswith("16/")
    with pytest.raises(Exception, match="unknown legislature"):
        spark.range(1).select(archives.archive_path(F.lit(3))).collect()


def test_actors_and_organs(spark, archive):
    docs = archives.read_zips(spark, archive)
    people = documents.actors(docs.where("category = 'acteur'"))
    rows = {r.an_uid: r for r in people.collect()}
    assert set(rows) == {"PA1", "PA2"} and rows["PA1"].date_naissance is None and rows["PA1"].date_deces is None
    assert rows["PA1"].mandats[0].an_uid == "PM1" and rows["PA2"].mandats == []
    organs = documents.organs(docs.where("category = 'organe'"))
    assert organs.first().is_non_inscrit and str(organs.first().fin_exclusive) == "2024-06-10"
    assert [r.statut for r in documents.classify_memberships(people, organs).collect()] == ["ok"]
    assert [r.statut for r in documents.classify_memberships(people, organs.limit(0)).collect()] == ["organe_inconnu"]


def test_rollcalls(spark, archive):
    docs = archives.read_zips(spark, archive).where("category = ''")
    parsed = documents.rollcalls(docs)
    assert {r.an_uid: r.chambre for r in parsed.collect()} == {"VTANR5L17V1": "assemblee", "VTCGR5L17V2": "congres"}
    one = documents.since(parsed, "2024-01-01")
    groups, known = documents.group_rows(one), spark.createDataFrame([("PO1",)], "an_uid string")
    assert [(r.rang, r.organe_uid, r.nombre_membres, r.pour, r.contre) for r in groups.orderBy("rang").collect()] == [(1, "PO1", 10, 3, 0), (2, "PO0", 5, 0, 1)]
    cast = documents.votes(groups)
    assert sorted((r.acteur_uid, r.position, r.par_delegation) for r in cast.collect()) == [("PA1", "pour", False), ("PA2", "pour", True), ("PA3", "contre", False), ("PA4", "non_votant", False)]
    assert sorted(tuple(r) for r in documents.corrections(one).collect()) == [("VTANR5L17V1", "PA3", "pour"), ("VTANR5L17V1", "PA4", "non_votant_volontaire")]
    kinds = sorted(r.kind for r in documents.anomalies(one, groups, cast, known).collect())
    assert kinds == ["bloc_nominatif_inconnu", "cause_non_vote_inconnue", "compteurs_incoherents", "groupe_fantome"]
    assert documents.strength(groups).first().effectif == 15


HEADER = ",".join(exchange.COLUMNS)


def line(theme="t1", uid="S1", version="1", justification="une raison, longue"):
    return f'{version},{uid},17,1,2024-01-01,"titre",SPO,,1,2,0,0.6,,u,{theme},1.000,0.5,0.9,"{justification}"'


def write(path, text):
    path.write_text(text, encoding="utf-8")
    return str(path)


def test_csv_import(spark, tmp_path):
    rows = exchange.read_csv(spark, write(tmp_path / "ok.csv", "﻿" + HEADER + "\n" + line() + "\n" + line(theme="") + "\n")).collect()
    assert [(r.scrutin_uid, r.theme, r.poids, r.justification) for r in rows] == [("S1", "t1", "1.000", "une raison, longue")]


@pytest.mark.parametrize(
    "text, why",
    [
        ("", "empty"),
        (HEADER.replace(",", ";") + "\n", "semicolon"),
        (HEADER.replace("confiance,", "") + "\n" + line() + "\n", "missing columns"),
        (HEADER + "\n", "no rows"),
        (HEADER + "\n1,S1,17\n", "fit the header"),
        (HEADER + "\n" + line(version="2") + "\n", "unknown schema_version"),
        (HEADER + "\n" + line() + "\n" + line(version="3") + "\n", "mixed"),
        (HEADER + "\n" + line(version="") + "\n", "schema_version missing"),
        (HEADER + "\n" + line(uid=" ") + "\n", "scrutin_uid missing"),
    ],
)
def test_csv_refusals(spark, tmp_path, text, why):
    with pytest.raises(exchange.MalformedImport, match=why):
        exchange.read_csv(spark, write(tmp_path / "bad.csv", text))


def test_json_import(spark, tmp_path):
    entry = {"theme": "t1", "poids": "1.000", "position_pour": None, "confiance": "0.9", "justification": "une raison longue"}
    rows = exchange.read_json(spark, write(tmp_path / "a.json", json.dumps({"schema_version": 1, "scrutins": [{"scrutin_uid": "S1", "categorisation": [entry]}, {"scrutin_uid": "S2", "categorisation": []}]}))).collect()
    assert [(r.source, r.scrutin_uid, r.position_pour) for r in rows] == [("scrutins[0].categorisation[0]", "S1", None)]
    for text, why in (('{"schema_version": 1, "scrutins": [', "invalid JSON"), ('{"schema_version": 7, "scrutins": []}', "unknown")):
        with pytest.raises(exchange.MalformedImport, match=why):
            exchange.read_json(spark, write(tmp_path / f"{why[:3]}.json", text))


def test_export_round_trip(spark, tmp_path):
    import datetime

    calls = spark.createDataFrame([(1, "S1", 17, 1, datetime.date(2024, 1, 1), "titre, \"cité\"", "SPO", 5, 6, 0, "assemblee", 0.7), (2, "S2", 17, 2, datetime.date(2024, 1, 2), "nu", "SPO", 5, 6, 0, "assemblee", 0.7), (3, "S3", 17, 3, datetime.date(2024, 1, 2), "nu", "SPO", 5, 6, 0, "congres", 0.7)], "scrutin_id long, scrutin_uid string, legislature int, numero int, date_scrutin date, titre string, type_code string, pour long, contre long, abstentions long, chambre string, participation double")
    groups = spark.createDataFrame([(1, 2, "B", None), (1, 1, "A", "pour")], "scrutin_id long, rang int, abrege string, position_majoritaire string")
    labels = spark.createDataFrame([(1, "t1", 0.6, 0.5, 0.9, "une raison longue"), (1, "t2", 0.4, None, 1.0, "une autre raison")], "scrutin_id long, theme string, poids double, position_pour double, confiance double, justification string")
    rows = exchange.csv_rows(exchange.export(calls, groups, labels))
    assert rows.columns == exchange.COLUMNS and rows.count() == 3
    assert rows.where("theme = 't1'").first().positions_groupes == "A:pour;B:égalité"
    rows.coalesce(1).write.csv(str(tmp_path / "out"), header=True, escape='"')
    back = exchange.read_csv(spark, str(tmp_path / "out"))
    assert sorted((r.scrutin_uid, r.theme, r.poids, r.position_pour, r.confiance, r.justification) for r in back.collect()) == [("S1", "t1", "0.600", "0.500", "0.900", "une raison longue"), ("S1", "t2", "0.400", None, "1.000", "une autre raison")]
    assert exchange.export(calls, groups, labels, "non_categorises").first().scrutin_uid == "S2"
    assert exchange.export(calls, groups, labels, theme="t2").count() == 1
    assert json.loads(exchange.json_documents(exchange.export(calls, groups, labels)).where("scrutin_id = 1").first().json)["categorisation"][0]["poids"] == "0.600"


def test_answers_and_lots(spark, tmp_path):
    rows = exchange.read_answers(spark, write(tmp_path / "a.tsv", "uid\ttheme\n# c\n```\n\nS1\tt1\t1.0\n")).collect()
    assert [r.columns for r in rows] == [["S1", "t1", "1.0"]]
    calls = spark.sql("SELECT date'2020-01-01' + INT(id) AS date_scrutin, concat('S', id) AS scrutin_uid, concat('projet de loi ', INT(id / 3)) AS titre FROM range(30)")
    got = exchange.lots(calls, 4, X.carrier_text(F.col("titre"))).collect()
    assert sorted((int(r.texte.split()[-1]), r.lot) for r in got) == [(i, i // 4 + 1) for i in range(10)]


def test_seeds(spark, tmp_path):
    good = '[[candidat]]\nan_uid = "PA1"\nstatut = "declare"\nsource_url = "u"\nsource_date = 2024-01-01\n'
    assert seeds.candidates(spark, write(tmp_path / "c.toml", good)).first().an_uid == "PA1"
    for text in ("", good + "extra = 1\n", good + good, good.replace('an_uid = "PA1"\n', "")):
        with pytest.raises(seeds.BadSeed):
            seeds.candidates(spark, write(tmp_path / "bad.toml", text))
    theme = '[[theme]]\nslug = "a"\nlibelle = "A"\ndescription = "d"\nrang = 1\n'
    assert seeds.themes(spark, write(tmp_path / "t.toml", theme)).count() == 1
    with pytest.raises(seeds.BadSeed):
        seeds.themes(spark, write(tmp_path / "t2.toml", theme + 'pole_positif = "p"\n'))
    header, groups = seeds.axis(spark, write(tmp_path / "x.toml", 'version = "v1"\n[bloc]\ngauche = -1\n[[groupe]]\nan_uid = "PO1"\nbloc = "gauche"\n'))
    assert groups.first().coordonnee == -1.0
    seeds.check_version({"v1": header["content_hash"]}, header)
    with pytest.raises(seeds.BadSeed):
        seeds.check_version({"v1": "other"}, header)


def test_documents_are_parsed_once(spark):
    """No condition on a field moves below the parsing, where it would parse the text again for each field."""
    from scrutable.sources import documents

    docs = spark.createDataFrame([("a", '{"scrutin": {"uid": "a"}}')], "uid string, raw string")
    votes = documents.votes(documents.group_rows(documents.rollcalls(docs)))
    plan = votes._jdf.queryExecution().optimizedPlan().toString()
    assert plan.lower().count("parse_json") + plan.count("parseJson") == 1


def test_shapes_of_lists_and_scalars(spark):
    from pyspark.sql import functions as F

    from scrutable.sources import documents

    values = ['[1, "a"]', '{"b": 1}', '"c"', "null", '{"#text": "t"}', '{"@xsi:nil": "true", "#text": "t"}', "7", "[]"]
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, raw string").coalesce(1).select("i", F.parse_json("raw").alias("v"))
    got = rows.select(F.size(documents.listing(F.col("v"))).alias("n"), documents.scalar(F.col("v")).alias("s"), "i").orderBy("i").collect()
    assert [r.n for r in got] == [2, 1, 1, 0, 1, 1, 1, 0] and [r.s for r in got] == [None, None, "c", None, "t", None, None, None]


def test_anomalies_take_one_pass_over_a_document(spark):
    """Four kinds from one parsing and one join, whatever the shapes of groups, blocks and voters; each document's votes are its own."""
    from scrutable.sources import documents

    def doc(uid, groups, voters):
        head = {"uid": uid, "numero": "1", "legislature": "15", "dateScrutin": "2020-01-01", "titre": "t", "typeVote": {"codeTypeVote": "SPO"}, "modePublicationDesVotes": "D", "syntheseVote": {"nombreVotants": voters}}
        return uid, json.dumps({"scrutin": head | {"ventilationVotes": {"organe": {"groupes": {"groupe": groups}}}}})

    def group(organ, **blocks):
        return {"organeRef": organ, "vote": {"decompteNominatif": blocks}}

    voter = lambda ref, cause=None: {"acteurRef": ref, "causePositionVote": cause}
    docs = [
        doc("a", group("PO1", pours={"votant": voter("PA1", "ZZZ")}), "1"),
        doc("b", [group({"#text": "PO1"}, pour=[None, voter("PA1"), "x", voter({"#text": "PA2"})], nonVotants={"votant": [voter("PA3", "PSE"), voter("PA4", {"#text": "ZZZ"}), voter(7)]}), None, "PO1", group("PO0", contres=None, autres=None)], "4"),
        doc("c", [group("PO2", surprises={"votant": voter("PA1")}, contre="PA1", abstention={"votant": "PA1"}), group({"@xsi:nil": "true"}), group(1)], None),
        doc("d", None, "0"),
        doc("e", [{"organeRef": "PO1", "vote": None}, group("PO1", contre={"votant": voter("PA5")})], "3"),
    ]
    parsed = documents.rollcalls(spark.createDataFrame([*docs, ("f", "no json"), ("g", '{"scrutin": 1}')], "uid string, raw string"))
    known = spark.createDataFrame([("PO0",), ("PO1",), ("PO1",), ("b",)], "an_uid string")
    found = documents.document_anomalies(parsed, known)
    assert sorted((r.subject_uid, r.kind, r.detail) for r in found.collect()) == [
        ("b", "bloc_nominatif_inconnu", '{"rang":4,"bloc":"autres"}'),
        ("b", "cause_non_vote_inconnue", '{"acteur_uid":"PA4","cause_non_vote":"ZZZ"}'),
        ("b", "groupe_fantome", '{"rang":2}'),
        ("b", "groupe_fantome", '{"rang":3}'),
        ("b", "groupe_fantome", '{"rang":4,"organe_uid":"PO0"}'),
        ("c", "bloc_nominatif_inconnu", '{"rang":1,"bloc":"surprises"}'),
        ("c", "groupe_fantome", '{"rang":1,"organe_uid":"PO2"}'),
        ("c", "groupe_fantome", '{"rang":2}'),
        ("c", "groupe_fantome", '{"rang":3}'),
        ("e", "compteurs_incoherents", '{"nominatifs":1,"nombre_votants":3,"non_votants":0}'),
    ]
    groups = documents.group_rows(parsed)
    plan = documents.anomalies(parsed, groups, documents.votes(groups), known)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.lower().count("parse_json") + plan.count("parseJson") == 1 and plan.count("Join") == 1
