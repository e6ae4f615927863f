"""Queries over irregular JSON documents, display functions, rules and import steps, and the same in SQL.

The documents are made of the test tables: an order is a roll-call and its lines are the groups, with lists of
one as an object, bare lists with nulls, nil markers and both spellings of blocks, as the real ones have them.
"""

from __future__ import annotations

import datetime

from pyspark.sql import DataFrame, functions as F

from ..functions import text as X
from ..operators import imports, intervals, naming, quality, tables as T
from ..operators.ordered import running
from ..sources import archives, documents as D, exchange
from .adapter import Tables, ctes
from .catalog import _import_rows
from .registry import query

NOW = datetime.datetime(2024, 1, 2)


# --- documents ----------------------------------------------------------------------------------------

def _object(**fields):
    """JSON text of an object of JSON texts."""
    parts = [x for k, v in fields.items() for x in (F.lit(f'"{k}":'), v, F.lit(","))][:-1]
    return F.concat(F.lit("{"), *parts, F.lit("}"))


def _text(value):
    return F.concat(F.lit('"'), value.cast("string"), F.lit('"'))


def _group():
    """JSON text of a line as a group, with its voters, of which there are three at most."""
    k, flag, status, n = F.col("l_linenumber"), F.col("l_returnflag"), F.col("l_linestatus"), F.col("n")
    voter = lambda i: _object(acteurRef=_text(F.concat(F.lit("PA"), F.col("l_partkey") + i)), mandatRef=_text(F.lit("PM1")), causePositionVote=F.when((status == "O") & (k == 5), '"ZZZ"').otherwise("null"), parDelegation=F.when(k % 2 == 0, '"true"').otherwise('"false"'))
    voters = F.concat_ws(",", voter(1), F.when(n > 1, voter(2)), F.when(n > 2, voter(3)))
    block = F.when(k == 4, F.concat(F.lit("[null,"), voters, F.lit("]"))).when(n == 1, F.concat(F.lit('{"votant":'), voters, F.lit("}"))).otherwise(F.concat(F.lit('{"votant":['), voters, F.lit("]}")))
    plural = F.when(k % 2 == 0, "s").otherwise("")
    name = F.concat(F.when(flag == "R", "pour").when(flag == "A", "contre").when(status == "F", "abstention").otherwise("nonVotant"), plural)
    name = F.when(k == 7, F.lit("surprises")).otherwise(name)
    nominal = F.concat(F.lit('{"'), name, F.lit('":'), block, F.lit(',"autres":null}'))
    count = lambda x: F.when(flag == x, _text(n)).otherwise(F.lit('{"#text":"0"}'))
    return _object(organeRef=F.when(k == 6, "null").otherwise(_text(F.concat(F.lit("PO"), F.col("l_suppkey")))), nombreMembresGroupe=_text(F.col("l_quantity").cast("int")), vote=_object(positionMajoritaire=_text(flag), decompteVoix=_object(pour=count("R"), contre=count("A")), decompteNominatif=nominal))


def _rollcall_documents(t: Tables) -> DataFrame:
    """(uid, raw): one document an order that has lines.

    Lines are dealt by order as they are and written out there, as text is far larger. They stay in as many partitions
    as they are dealt to: merged by the size of what was dealt, a task would hold ten times as much text.
    """
    parts = int(t.spark.conf.get("spark.sql.shuffle.partitions"))
    n = F.pmod("l_linenumber", F.lit(3)) + 1
    lines = t.raw("lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_returnflag", "l_linestatus").repartition(parts, "l_orderkey").withColumn("n", n)
    lines = lines.groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey", _group().alias("g"), "n"))).alias("lines"))
    groups = F.concat_ws(",", F.col("lines.g"))
    groups = F.when(F.size("lines") == 1, groups).otherwise(F.concat(F.lit("["), groups, F.lit("]")))
    orders = t.raw("orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey", "o_orderdate", "o_orderstatus")
    rows = lines.join(orders, "l_orderkey")
    key = F.col("l_orderkey")
    uid = F.concat(F.when(key % 40 == 0, "VTCGR5L15V").otherwise("VTANR5L15V"), key)
    fixed = F.when(key % 5 == 0, F.concat(F.lit('{"pours":{"votant":{"acteurRef":"PA'), F.col("o_custkey"), F.lit('"}},"nonVotantsVolontaires":null,"autre":{"votant":{"acteurRef":"PA9"}}}'))).otherwise("null")
    total = F.aggregate("lines", F.lit(0), lambda a, x: a + x["n"])
    head = _object(
        uid=_text(uid), numero=_text(key), legislature=_object(**{"#text": _text(F.lit(15))}), dateScrutin=_text(F.to_date("o_orderdate")), modePublicationDesVotes=_text(F.lit("DecompteNominatif")),
        titre=F.when(key % 9 == 0, '{"@xsi:nil":"true"}').otherwise(_text(F.concat(F.lit("le texte "), key))), typeVote=_object(codeTypeVote=_text(F.col("o_orderstatus"))),
        syntheseVote=_object(nombreVotants=_text(total), decompte=_object(pour=_text(F.lit(1)), nonVotants=_text(F.lit(0)))), ventilationVotes=_object(organe=_object(groupes=_object(groupe=groups))), miseAuPoint=fixed,
    )
    return rows.select(uid.alias("uid"), _object(scrutin=head).alias("raw"))


LINES = """WITH doc AS (SELECT o_orderkey AS k, CASE WHEN o_orderkey % 40 = 0 THEN 'VTCGR5L15V' ELSE 'VTANR5L15V' END || o_orderkey AS an_uid, CAST(o_orderdate AS DATE) AS date_scrutin, o_orderstatus, o_custkey FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem)),
lines AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_returnflag, l_quantity) AS rang, l_linenumber % 3 + 1 AS n FROM lineitem)"""
GROUPS = LINES + """, grp AS (SELECT an_uid, date_scrutin, rang, l_linenumber, CASE WHEN l_linenumber <> 6 THEN 'PO' || l_suppkey END AS organe_uid, CAST(floor(l_quantity) AS INT) AS nombre_membres, l_returnflag, l_linestatus, l_partkey, n
 FROM lines JOIN doc ON k = l_orderkey WHERE l_orderkey % 9 <> 0)"""


def _parsed(t: Tables) -> DataFrame:
    return D.rollcalls(_rollcall_documents(t))


@query("parsed_rollcalls", LINES + " SELECT an_uid, k AS numero, 15 AS legislature, date_scrutin, CASE WHEN k % 40 = 0 THEN 'congres' ELSE 'assemblee' END AS chambre, 'le texte ' || k AS titre, o_orderstatus AS type_code, CAST((SELECT sum(n) FROM lines WHERE l_orderkey = k) AS INT) AS nombre_votants, 1 AS pour, 0 AS contre, (SELECT count(*) FROM lines WHERE l_orderkey = k) AS n_groupes FROM doc WHERE k % 9 <> 0 AND date_scrutin >= DATE '1994-01-01'")
def _(t):
    rows = D.since(_parsed(t), datetime.date(1994, 1, 1))
    return rows.select("an_uid", "numero", "legislature", "date_scrutin", "chambre", "titre", "type_code", "nombre_votants", "pour", "contre", F.size("groupes").cast("long").alias("n_groupes"))


@query("parsed_groups", GROUPS + " SELECT an_uid, count(*) AS groupes, CAST(sum(nombre_membres) AS BIGINT) AS membres, CAST(sum(CASE WHEN l_returnflag = 'R' THEN n ELSE 0 END) AS BIGINT) AS pour, CAST(sum(CASE WHEN l_returnflag = 'A' THEN n ELSE 0 END) AS BIGINT) AS contre, CAST(max(rang) AS INT) AS dernier_rang, count(organe_uid) AS nommes, string_agg(organe_uid, ',' ORDER BY organe_uid) AS organes FROM grp GROUP BY an_uid")
def _(t):
    return D.group_rows(_parsed(t)).groupBy("an_uid").agg(F.count("*").alias("groupes"), F.sum("nombre_membres").alias("membres"), F.sum("pour").alias("pour"), F.sum("contre").alias("contre"), F.max("rang").alias("dernier_rang"), F.count("organe_uid").alias("nommes"), F.nullif(F.array_join(F.array_sort(F.collect_list("organe_uid")), ","), F.lit("")).alias("organes"))


VOTED = GROUPS + """, cast_ AS (SELECT an_uid, organe_uid, CASE WHEN l_returnflag = 'R' THEN 'pour' WHEN l_returnflag = 'A' THEN 'contre' WHEN l_linestatus = 'F' THEN 'abstention' ELSE 'non_votant' END AS position, 'PA' || (l_partkey + unnest(range(1, n + 1))) AS acteur_uid,
 CASE WHEN l_linestatus = 'O' AND l_linenumber = 5 THEN 'ZZZ' END AS cause_non_vote, l_linenumber % 2 = 0 AS par_delegation FROM grp WHERE l_linenumber <> 7)"""


@query("parsed_votes", VOTED + " SELECT * FROM cast_")
def _(t):
    return D.votes(D.group_rows(_parsed(t))).select("an_uid", "organe_uid", "position", "acteur_uid", "cause_non_vote", "par_delegation")


@query("parsed_corrections", LINES + " SELECT an_uid, 'PA' || o_custkey AS acteur_uid, 'pour' AS position_declaree FROM doc WHERE k % 9 <> 0 AND k % 5 = 0")
def _(t):
    return D.corrections(_parsed(t))


@query("document_anomalies", VOTED + """ SELECT kind, count(*) AS n FROM (
 SELECT 'bloc_nominatif_inconnu' AS kind FROM grp, (SELECT unnest(['surprises', 'autres']) AS b) WHERE b = 'autres' OR l_linenumber = 7
 UNION ALL SELECT 'cause_non_vote_inconnue' FROM cast_ WHERE position = 'non_votant' AND cause_non_vote IS NOT NULL
 UNION ALL SELECT 'groupe_fantome' FROM grp WHERE organe_uid IS NULL OR organe_uid NOT IN (SELECT 'PO' || s_suppkey FROM supplier WHERE s_suppkey > 0)
 UNION ALL SELECT 'compteurs_incoherents' FROM (SELECT an_uid, sum(n) AS voters, sum(CASE WHEN l_linenumber <> 7 THEN n ELSE 0 END) AS nominal FROM grp GROUP BY an_uid) WHERE voters <> nominal) GROUP BY kind""")
def _(t):
    organs = t.raw("supplier").where("s_suppkey > 0").select(F.concat(F.lit("PO"), F.col("s_suppkey")).alias("an_uid"))
    return D.document_anomalies(_parsed(t), organs).groupBy("kind").agg(F.count("*").alias("n"))


@query("strength_of_rollcalls", GROUPS + " SELECT an_uid, CAST(sum(nombre_membres) AS BIGINT) AS effectif FROM grp GROUP BY an_uid")
def _(t):
    return D.strength(D.group_rows(_parsed(t)))


def _actor_documents(t: Tables) -> DataFrame:
    k = F.col("c_custkey")
    mandate = lambda i: _object(uid=_text(F.concat(F.lit("PM"), k * 10 + i)), typeOrgane=F.when(k % 4 == 3, '"COMPER"').otherwise('"GP"'), dateDebut=F.when(k % 11 == 0, "null").otherwise('"2020-01-01"'), dateFin=F.when(k % 6 == 0, '"2019-01-01"').when(k % 6 == 1, '"2021-02-30"').otherwise('"2021-03-01"'), legislature=_text(F.lit(15)), organes=_object(organeRef=_text(F.concat(F.lit("PO"), F.col("c_nationkey")))), infosQualite=_object(codeQualite=_text(F.lit("membre"))))
    mandates = F.when(k % 3 == 0, "null").when(k % 3 == 1, mandate(F.lit(1))).otherwise(F.concat(F.lit("["), mandate(F.lit(1)), F.lit(","), mandate(F.lit(2)), F.lit("]")))
    person = _object(
        uid=F.when(k % 50 == 49, "null").when(k % 2 == 0, _object(**{"#text": _text(F.concat(F.lit("PA"), k))})).otherwise(_text(F.concat(F.lit("PA"), k))),
        etatCivil=_object(ident=_object(civ=_text(F.lit("M.")), prenom=_text(F.col("c_mktsegment")), nom=_text(F.col("c_name"))), infoNaissance=_object(dateNais=F.when(k % 7 == 0, '"1970-02-30"').otherwise('"1970-02-20"'), villeNais=F.when(k % 5 == 0, '{"@xsi:nil":"true"}').otherwise('"Lyon"')), dateDeces=F.lit('{"@xsi:nil":"true"}')),
        mandats=_object(mandat=mandates),
    )
    return t.raw("customer").select(F.concat(F.lit("PA"), k).alias("uid"), _object(acteur=person).alias("raw"))


ACTOR = "WITH a AS (SELECT c_custkey AS k, 'PA' || c_custkey AS an_uid, * FROM customer WHERE c_custkey % 50 <> 49)"


@query("parsed_actors", ACTOR + " SELECT an_uid, 'M.' AS civilite, c_mktsegment AS prenom, c_name AS nom, CASE WHEN k % 7 <> 0 THEN DATE '1970-02-20' END AS date_naissance, CASE WHEN k % 5 <> 0 THEN 'Lyon' END AS ville_naissance, CAST(NULL AS DATE) AS date_deces, CAST(k % 3 AS BIGINT) AS n_mandats FROM a")
def _(t):
    return D.actors(_actor_documents(t)).select("an_uid", "civilite", "prenom", "nom", "date_naissance", "ville_naissance", "date_deces", F.size("mandats").cast("long").alias("n_mandats"))


def _organ_documents(t: Tables) -> DataFrame:
    k = F.col("n_nationkey")
    organ = _object(uid=_text(F.concat(F.lit("PO"), k)), codeType=F.when(k % 5 == 4, '"PARPOL"').otherwise('"GP"'), libelle=F.when(k == 7, "null").otherwise(_text(F.col("n_name"))), libelleAbrev=F.when(k % 10 == 3, '"NI"').otherwise(_text(F.left("n_name", F.lit(3)))), viMoDe=_object(dateDebut=_text(F.lit("2017-06-21")), dateFin=F.when(k % 2 == 0, '"2022-06-21"').otherwise("null")))
    return t.raw("nation").select(F.concat(F.lit("PO"), k).alias("uid"), _object(organe=organ).alias("raw"))


ORGAN = "SELECT 'PO' || n_nationkey AS an_uid, CASE WHEN n_nationkey % 5 = 4 THEN 'PARPOL' ELSE 'GP' END AS code_type, n_name AS libelle, DATE '2017-06-21' AS debut, CASE WHEN n_nationkey % 2 = 0 THEN DATE '2022-06-22' END AS fin_exclusive, n_nationkey % 10 = 3 AND n_nationkey % 5 <> 4 AS is_non_inscrit FROM nation WHERE n_nationkey <> 7"


@query("parsed_organs", ORGAN)
def _(t):
    return D.organs(_organ_documents(t)).select("an_uid", "code_type", "libelle", "debut", "fin_exclusive", "is_non_inscrit")


@query("classified_memberships", ACTOR + """ SELECT statut, count(*) AS n FROM (SELECT CASE WHEN c_nationkey = 7 THEN 'organe_inconnu' WHEN k % 11 = 0 THEN 'sans_debut' WHEN k % 6 = 0 THEN 'dates_inversees' ELSE 'ok' END AS statut FROM a, range(1, 3) i(i) WHERE i <= k % 3 AND k % 4 <> 3) GROUP BY statut""")
def _(t):
    return D.classify_memberships(D.actors(_actor_documents(t)), D.organs(_organ_documents(t))).groupBy("statut").agg(F.count("*").alias("n"))


@query("archived_documents", "SELECT 'PA' || c_custkey AS uid, sha256('v2 ' || c_name) AS content_hash FROM customer WHERE c_custkey % 3 = 0 UNION ALL SELECT 'PA' || c_custkey, sha256('v1 ' || c_name) FROM customer WHERE c_custkey % 3 <> 0 AND c_custkey % 2 = 1")
def _(t):
    """New by (source, uid, hash): changed documents, and those not yet archived; all others are known."""
    k = F.col("c_custkey")
    hashed = lambda v: F.sha2(F.concat(v, F.lit(" "), F.col("c_name")), 256).alias("content_hash")
    uid = F.concat(F.lit("PA"), k).alias("uid")
    rows = t.raw("customer")
    known = rows.where(k % 2 == 0).select(F.lit("acteur").alias("source"), uid, hashed(F.lit("v1")))
    fresh = rows.select(F.lit("acteur").alias("source"), uid, hashed(F.when(k % 3 == 0, "v2").otherwise("v1")))
    return T.archive(known, fresh.union(fresh)).select("uid", "content_hash")


@query("archive_paths", ctes("scrutin") + " SELECT DISTINCT legislature, legislature || '/loi/scrutins/' || CASE legislature WHEN 15 THEN 'Scrutins_XV.json.zip' ELSE 'Scrutins.json.zip' END AS path FROM scrutin")
def _(t):
    return t.scrutin().select("legislature").distinct().withColumn("path", archives.archive_path(F.col("legislature")))


# --- functions ------------------------------------------------------------------------------------------

@query("image_links", "SELECT c_custkey, 'Q' || c_custkey AS qid, 'File:' || replace(c_name, '_', ' ') || ' é+' || c_custkey || '.jpg' AS title, 'https://commons.wikimedia.org/wiki/Special:FilePath/' || replace(replace(c_name, '#', '%23'), ' ', '_') || '_%C3%A9%2B' || c_custkey || '.jpg?width=400' AS thumbnail, 'https://www.assemblee-nationale.fr/dyn/15/scrutins/' || c_custkey AS page FROM customer")
def _(t):
    k = F.col("c_custkey")
    title = X.commons_title(F.concat(F.lit("http://commons.wikimedia.org/wiki/Special:FilePath/"), F.replace("c_name", F.lit("#"), F.lit("%23")), F.lit("_%C3%A9+"), k, F.lit(".jpg")))
    return t.raw("customer").select("c_custkey", X.last_segment(F.concat(F.lit("http://www.wikidata.org/entity/Q"), k)).alias("qid"), title.alias("title"), X.thumbnail_url(title).alias("thumbnail"), exchange.page_url(F.lit(15), k).alias("page"))


@query("display_names", "SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN 'PA' || c_custkey ELSE trim(CASE WHEN c_custkey % 3 = 1 THEN 'Mme ' ELSE '' END || c_name) END AS nom, strftime(DATE '2020-01-31' + CAST(c_custkey % 400 AS INT), '%d/%m/%Y') AS jour, least(300, 5 * CAST(3 ** (c_custkey % 6) AS BIGINT)) AS attente, CAST(50 + c_custkey % 50 AS DOUBLE) AS curseur FROM customer")
def _(t):
    k = F.col("c_custkey")
    only = lambda c, x: F.when(c, x)
    name = X.display_name(only(k % 3 == 1, F.lit("Mme")), F.lit(None).cast("string"), only(k % 3 != 0, F.col("c_name")), F.concat(F.lit("PA"), k))
    return t.raw("customer").select("c_custkey", name.alias("nom"), X.french_date(F.date_add(F.lit("2020-01-31").cast("date"), (k % 400).cast("int"))).alias("jour"), X.retry_seconds((k % 6 + 1).cast("int")).alias("attente"), F.round(X.cursor_percent((k % 50) / 50.0), 6).alias("curseur"))


@query("freshness_of_users", "SELECT user_id, CASE WHEN extract(epoch FROM TIMESTAMP '2024-01-02' - date_trunc('second', max(ts))) <= 36000 THEN 'ok' ELSE 'stale' END AS etat FROM events WHERE ts < TIMESTAMP '2024-01-02' GROUP BY user_id")
def _(t):
    last = t.raw("events").where(F.col("ts") < F.lit(NOW).cast("timestamp_ntz")).groupBy("user_id").agg(F.max("ts").cast("timestamp").alias("last"))
    return last.select("user_id", X.freshness(F.col("last"), F.lit(NOW), 36_000).alias("etat"))


@query("parsed_numbers", "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE WHEN l_linenumber % 3 = 0 THEN NULL ELSE CAST(l_quantity AS INT) END AS entier, CASE WHEN l_linenumber % 4 = 0 THEN NULL ELSE CAST(l_discount AS DOUBLE) END AS exact, printf('%.3f', l_tax) AS arrondi FROM lineitem")
def _(t):
    """Whole numbers or null, exact three decimals or null (a fourth one is refused), and rounding for manual entry."""
    k = F.col("l_linenumber")
    cents = lambda c: F.col(c).cast("decimal(4,2)").cast("string")
    whole = F.when(k % 3 == 0, F.lit("n/a")).otherwise(F.col("l_quantity").cast("int").cast("string")).try_cast("int")
    exact = X.exact_three_decimals(F.when(k % 4 == 0, F.concat(cents("l_discount"), F.lit("01"))).otherwise(cents("l_discount")))
    return t.raw("lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", whole.alias("entier"), exact.cast("double").alias("exact"), X.three_decimals(F.col("l_tax") + 0.0001).alias("arrondi"))


@query("period_columns", "SELECT c_custkey, CAST(DATE '2020-01-01' + CAST(c_custkey % 900 AS INT) AS DATE) AS dernier, c_custkey % 900 < 366 AS en_2020 FROM customer")
def _(t):
    end = intervals.half_open(F.date_add(F.lit("2020-01-01").cast("date"), (F.col("c_custkey") % 900).cast("int")))
    begin, stop = F.lit("2020-01-01").cast("date"), F.lit("2021-01-01").cast("date")
    return t.raw("customer").select("c_custkey", intervals.last_day(end).alias("dernier"), intervals.covers(begin, stop, intervals.last_day(end)).alias("en_2020"))


# --- rules ------------------------------------------------------------------------------------------------

@query("broken_rules", VOTED + """ SELECT 'causes_on_voters' AS regle, count(*) AS n FROM cast_ WHERE cause_non_vote IS NOT NULL AND position <> 'non_votant'
 UNION ALL SELECT 'unknown_declarations', count(*) FROM orders WHERE o_orderkey % 13 = 0
 UNION ALL SELECT 'persons_without_identifier', count(*) FROM customer WHERE c_custkey % 10 = 0
 UNION ALL SELECT 'half_poled_themes', count(*) FROM nation WHERE n_nationkey % 2 = 1 OR n_nationkey % 5 = 0
 UNION ALL SELECT 'label_provenance', count(*) FROM part WHERE (p_partkey % 2 = 0) <> (p_partkey % 3 = 0) OR p_partkey % 7 = 0
 UNION ALL SELECT 'idle_revisions', count(*) FROM part WHERE p_size = 10
 UNION ALL SELECT 'several_current', CASE WHEN count(*) FILTER (WHERE s_nationkey = 3) > 1 THEN 1 ELSE 0 END FROM supplier
 UNION ALL SELECT 'estimates_out_of_range', count(*) FROM lineitem WHERE l_discount * 12 > 1
 UNION ALL SELECT 'scores_out_of_range', count(*) FROM customer WHERE c_acctbal / 9000 > 1
 UNION ALL SELECT 'unsourced', count(*) FROM supplier WHERE s_suppkey % 4 <> 1
 UNION ALL SELECT 'unlicensed', count(*) FROM supplier WHERE s_suppkey % 6 = 0
 UNION ALL SELECT 'bad_threshold', count(*) FROM lineitem WHERE l_tax = 0""")
def _(t):
    """Each rule over rows of which some break it: how many."""
    k = F.col("c_custkey")
    s, p = F.col("s_suppkey"), F.col("p_partkey")
    none = F.lit(None).cast("string")
    supplier, part, customer = t.raw("supplier"), t.raw("part"), t.raw("customer")
    nation = t.raw("nation").select(F.when(F.col("n_nationkey") % 5 == 0, " ").otherwise(F.col("n_name")).alias("slug"), F.col("n_name").alias("libelle_pole_positif"), F.when(F.col("n_nationkey") % 2 == 0, "x").alias("libelle_pole_negatif"))
    measures = t.raw("lineitem").select(F.lit("ok").alias("statut"), F.lit(0.0).alias("position_pour"), (F.col("l_discount") * 12).alias("separation"), F.lit(1.0).alias("couverture"), F.lit(20).alias("votants_couverts"), F.lit(0.5).alias("bipolarite"))
    broken = {
        "causes_on_voters": quality.causes_on_voters(D.votes(D.group_rows(_parsed(t)))),
        "unknown_declarations": quality.unknown_declarations(t.raw("orders").select(F.when(F.col("o_orderkey") % 13 == 0, "peut-être").otherwise("pour").alias("position_declaree"))),
        "persons_without_identifier": quality.persons_without_identifier(customer.select(F.when(k % 2 != 0, "PA").alias("an_uid"), F.when(k % 5 != 0, "Q").alias("wikidata_qid"))),
        "half_poled_themes": quality.half_poled_themes(nation),
        "label_provenance": quality.label_provenance(part.select(F.when(p % 2 == 0, "import").otherwise("manual").alias("method"), F.when(p % 3 == 0, 1).alias("import_id"), F.lit("r").alias("reviewed_by"), F.when(p % 7 != 0, "d").alias("reviewed_at"))),
        "idle_revisions": quality.idle_revisions(part.select(F.col("p_size").alias("avant"), F.lit(10).alias("apres"))),
        "several_current": quality.several_current(supplier.select((F.col("s_nationkey") == 3).alias("is_current"))),
        "estimates_out_of_range": quality.estimates_out_of_range(measures),
        "scores_out_of_range": quality.scores_out_of_range(customer.select((F.col("c_acctbal") / 9000).alias("score"), F.lit(5).alias("contributions"), F.lit(0.6).alias("cohesion"))),
        "unsourced": quality.unsourced(supplier.select(F.when(s % 4 == 1, "u").when(s % 4 == 2, " ").otherwise(none).alias("source_url"))),
        "unlicensed": quality.unlicensed(supplier.select(F.when(s % 6 != 0, "CC").alias("licence"))),
        "bad_threshold": quality.bad_threshold(t.raw("lineitem").select(F.col("l_tax").alias("participation_min"))),
    }
    out = None
    for name, rows in broken.items():
        one = rows.agg(F.count("*").alias("n")).select(F.lit(name).alias("regle"), "n")
        out = one if out is None else out.unionByName(one)
    return out


# --- seeds and upserts --------------------------------------------------------------------------------------

@query("deactivated_themes", "SELECT p_partkey, p_size > 25 AS actif, CASE WHEN p_size > 25 THEN 'nouveau' ELSE 'ancien' END AS libelle FROM part")
def _(t):
    rows = t.raw("part")
    old = rows.select("p_partkey", F.lit("ancien").alias("libelle"), F.lit(True).alias("actif"))
    return T.deactivate_absent(old, rows.where("p_size > 25").select("p_partkey", F.lit("nouveau").alias("libelle")), "p_partkey")


@query("filled_ids", "SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN 'Q' || c_custkey WHEN c_custkey % 3 = 0 THEN 'Qold' END AS wikidata_qid, c_custkey % 2 = 0 AND c_custkey % 4 <> 0 AS changed FROM customer")
def _(t):
    k = F.col("c_custkey")
    uid = F.concat(F.lit("PA"), k).alias("an_uid")
    now = F.when(k % 4 == 0, F.concat(F.lit("Q"), k)).when(k % 3 == 0, "Qold")
    found = t.raw("customer").where(k % 2 == 0).select(uid, F.concat(F.lit("Q"), k).alias("qid"))
    return T.fill_ids(t.raw("customer").select("c_custkey", uid, now.alias("wikidata_qid")), found).select("c_custkey", "wikidata_qid", "changed")


@query("equal_fingerprints", "SELECT count(*) AS n, TRUE AS pareil, FALSE AS autre FROM orders")
def _(t):
    """The digest of a table in another order equals its own; a table with one changed value has another."""
    rows = t.raw("orders")
    mine, shuffled, changed = (T.fingerprint(x) for x in (rows, rows.repartition(3, "o_custkey"), rows.withColumn("o_custkey", F.when(F.col("o_orderkey") == 7, -1).otherwise(F.col("o_custkey")))))
    both = mine.crossJoin(shuffled.toDF("n2", "a", "b")).crossJoin(changed.toDF("n3", "c", "d"))
    return both.select("n", F.expr("n = n2 AND h1 = a AND h2 = b").alias("pareil"), F.expr("h1 = c AND h2 = d").alias("autre"))


# --- imports --------------------------------------------------------------------------------------------------

@query("import_problems_shown", ctes("scrutin_label", "theme") + """, p AS (SELECT CAST(scrutin_id AS VARCHAR) AS source, unnest(list_filter([CASE WHEN theme_id = 4 THEN 'theme_inactif' END, CASE WHEN scrutin_id % 5 = 0 THEN 'poids_decimales' END, CASE WHEN scrutin_id % 7 = 0 THEN 'confiance_hors_bornes' END, CASE WHEN scrutin_id % 4 = 0 THEN 'justification_courte' END], lambda p: p IS NOT NULL)) AS problem, 'theme-' || theme_id AS theme FROM scrutin_label)
 SELECT source, theme, problem FROM p ORDER BY source, problem, theme LIMIT 50""")
def _(t):
    """The first fifty problems in order; the file is refused whole."""
    problems = imports.row_problems(_import_rows(t), t.theme(), t.scrutin())
    return problems.orderBy("source", "problem", "theme").limit(imports.MAX_PROBLEMS).select("source", "theme", "problem")


def _labels(t: Tables) -> tuple[DataFrame, DataFrame]:
    """Labels as they are and as a file would replace some of them; new files leave out roll-calls divisible by five."""
    three = lambda c: F.col(c).cast("decimal(4,3)").cast("string").alias(c)
    uids = t.scrutin().select("scrutin_id", "scrutin_uid")
    old = t.scrutin_label().join(uids, "scrutin_id").select("scrutin_id", "scrutin_uid", F.concat(F.lit("theme-"), F.col("theme_id")).alias("theme"), three("poids"), three("position_pour"), three("confiance"), F.lit("comme avant").alias("justification"), "method", "reviewed")
    new = old.where("scrutin_id % 5 <> 0").withColumn("justification", F.when(F.col("scrutin_id") % 4 == 1, F.col("justification")).otherwise("tout autre"))
    return old.where("scrutin_id % 4 <> 0"), new


IMPORT = ctes("scrutin", "scrutin_label") + ", l AS (SELECT *, scrutin_id % 4 <> 0 AS old, scrutin_id % 5 <> 0 AS new, scrutin_id % 5 <> 0 AND scrutin_id % 4 <> 1 AS touched FROM scrutin_label JOIN scrutin USING (scrutin_id))"


@query("import_applied", IMPORT + " SELECT scrutin_uid, 'theme-' || theme_id AS theme, CASE WHEN touched THEN 'tout autre' ELSE 'comme avant' END AS justification, CASE WHEN touched THEN 'import' ELSE method END AS method, NOT touched AND reviewed AS reviewed FROM l WHERE touched OR old")
def _(t):
    old, new = _labels(t)
    return imports.apply_plan(old, new, imports.plan(new, old)).select("scrutin_uid", "theme", "justification", "method", "reviewed")


@query("import_revisions", IMPORT + " SELECT scrutin_uid, CASE WHEN any_value(old) THEN count(*) ELSE 0 END AS avant, count(*) AS apres FROM l WHERE touched GROUP BY scrutin_uid")
def _(t):
    old, new = _labels(t)
    entries = lambda c: F.size(F.from_json(c, "array<struct<theme:string>>")).cast("long").alias(c)
    return imports.revisions(imports.plan(new, old)).select("scrutin_uid", entries("avant"), entries("apres"))


@query("import_preview", IMPORT + """, p AS (SELECT scrutin_uid, CASE WHEN scrutin_id % 4 = 0 THEN 'creation' WHEN scrutin_id % 4 = 1 THEN 'inchange' WHEN scrutin_id % 2 = 1 OR scrutin_id % 3 = 1 THEN 'conflit' ELSE 'modification' END AS classement FROM scrutin WHERE scrutin_id % 5 <> 0)
 SELECT CAST(row_number() OVER (ORDER BY CASE classement WHEN 'conflit' THEN 0 WHEN 'creation' THEN 1 WHEN 'modification' THEN 2 ELSE 3 END, scrutin_uid) AS INT) AS place, scrutin_uid, classement FROM p""")
def _(t):
    """The plan in order of display: conflicts first; the place is a running sum over ranges of the order."""
    old, new = _labels(t)
    rank = F.expr("CASE classement WHEN 'conflit' THEN 0 WHEN 'creation' THEN 1 WHEN 'modification' THEN 2 ELSE 3 END")
    shown = imports.plan(new, old).select("scrutin_uid", "classement", rank.alias("rang"))
    return running(shown, [], ["rang", "scrutin_uid"], place=("sum", F.lit(1))).select(F.col("place").cast("int").alias("place"), "scrutin_uid", "classement")


@query("label_export_columns", ctes("scrutin", "scrutin_label") + """ SELECT '1' AS schema_version, scrutin_uid, CAST(legislature AS VARCHAR) AS legislature, CAST(numero AS VARCHAR) AS numero, CAST(date_scrutin AS VARCHAR) AS date, titre, type_code AS type, '' AS sort, CAST(pour AS VARCHAR) AS pour, CAST(contre AS VARCHAR) AS contre, CAST(abstentions AS VARCHAR) AS abstentions, CAST(CAST(participation AS DECIMAL(9,3)) AS VARCHAR) AS participation,
 'https://www.assemblee-nationale.fr/dyn/' || legislature || '/scrutins/' || numero AS url_an, coalesce('theme-' || theme_id, '') AS theme, coalesce(CAST(poids AS VARCHAR), '') AS poids, coalesce(CAST(position_pour AS VARCHAR), '') AS position_pour, coalesce(CAST(confiance AS VARCHAR), '') AS confiance, CASE WHEN theme_id IS NULL THEN '' ELSE 'une raison' END AS justification
 FROM scrutin LEFT JOIN (SELECT * FROM scrutin_label WHERE scrutin_id % 2 = 0) USING (scrutin_id) WHERE chambre = 'assemblee' AND participation >= 0.5""")
def _(t):
    """The exchange file's columns but the groups', with one row of context for a roll-call without labels."""
    groups = t.scrutin_groupe().join(t.organe(), "organe_id").select("scrutin_id", "rang", F.col("libelle_abrege").alias("abrege"), F.lit(None).cast("string").alias("position_majoritaire"))
    labels = t.scrutin_label().where("scrutin_id % 2 = 0").select("scrutin_id", F.concat(F.lit("theme-"), F.col("theme_id")).alias("theme"), "poids", "position_pour", "confiance", F.lit("une raison").alias("justification"))
    return exchange.csv_rows(exchange.export(t.scrutin(), groups, labels)).drop("positions_groupes")


@query("json_export", ctes("scrutin", "scrutin_label") + """ SELECT scrutin_id, 1 AS version, scrutin_uid, (SELECT count(*) FROM scrutin_label l WHERE l.scrutin_id = s.scrutin_id) AS categorisations FROM scrutin s WHERE chambre = 'assemblee' AND participation >= 0.5""")
def _(t):
    groups = t.scrutin_groupe().join(t.organe(), "organe_id").select("scrutin_id", "rang", F.col("libelle_abrege").alias("abrege"), F.lit(None).cast("string").alias("position_majoritaire"))
    labels = t.scrutin_label().select("scrutin_id", F.concat(F.lit("theme-"), F.col("theme_id")).alias("theme"), "poids", "position_pour", "confiance", F.lit("une raison").alias("justification"))
    j = F.from_json("json", "schema_version int, scrutin_uid string, categorisation array<struct<theme:string>>").alias("j")
    return exchange.json_documents(exchange.export(t.scrutin(), groups, labels)).select("scrutin_id", j).select("scrutin_id", F.col("j.schema_version").alias("version"), "j.scrutin_uid", F.size("j.categorisation").cast("long").alias("categorisations"))
