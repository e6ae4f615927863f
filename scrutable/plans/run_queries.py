"""Queries over score runs, stored tables, persons, labels, ledgers and captured metadata, and the same in SQL."""

from __future__ import annotations

import datetime
import uuid

from pyspark.sql import DataFrame, functions as F

from ..operators import anomalies, imports, intervals, naming, quality, score_run, tables as T
from ..sources import exchange, metadata
from ..sources.keyed import KeyedTable
from ..sources.search import SearchIndex
from ..streaming import events as streaming
from . import reads
from .adapter import Tables, ctes
from .catalog import BASE, CONTRIBUTION, ELIGIBLE, FOLD, GROUPED, MANDATE, OVERVIEW, PERSON_SCORE, SCORED, _contributions, _overview, _raw_mandates, _tally, current, measures, recompute
from .registry import query

NOW = datetime.datetime(2024, 1, 2)


# --- stored tables and runs ------------------------------------------------------------------------------

@query("ingested_tables", ctes("scrutin", "scrutin_groupe") + " SELECT 'vote' AS name, count(*) AS n FROM vote UNION ALL SELECT 'scrutin', count(*) FROM scrutin UNION ALL SELECT 'scrutin_groupe', count(*) FROM scrutin_groupe")
def _(t):
    """Derive and store votes, tallies and roll-calls anew: how many rows each has."""
    out = None
    for name, rows in t.ingest().items():
        one = rows.agg(F.count("*").alias("n")).select(F.lit(name).alias("name"), "n")
        out = one if out is None else out.unionByName(one)
    return out


_GROUP_SCORE = _tally("organe_id, theme_id", "group_row")


@query("score_run", SCORED + GROUPED[GROUPED.index(",\nagreeing AS"):] + f""", group_score AS ({_GROUP_SCORE}), inside AS (SELECT m.mandat_id, g.* FROM mandat m JOIN group_row g ON g.organe_id = m.organe_id JOIN scrutin s ON s.scrutin_id = g.scrutin_id AND m.debut <= s.date_scrutin AND (m.fin_exclusive IS NULL OR s.date_scrutin < m.fin_exclusive)),
mandate_score AS ({_tally("mandat_id, theme_id", "inside")})
 SELECT CAST((SELECT count(*) FROM eligible) AS INT) AS themes_eligibles, (SELECT count(*) FROM contribution) AS contributions, (SELECT count(*) FROM person_score) AS person_scores, (SELECT count(*) FROM group_score) AS group_scores, (SELECT count(*) FROM mandate_score) AS mandate_scores, CAST(1 AS BIGINT) AS courants""")
def _(t):
    """Recompute and publish a run: its counters as the ledger keeps them, and how many runs are current."""
    recompute(t)
    runs = t.runs.runs()
    c = F.from_json("counters", "themes_eligibles int, contribution_ecrites long, person_score_ecrites long, group_score_ecrites long, mandate_score_ecrites long")
    one = runs.where("is_current").select(c.alias("c")).select(F.col("c.themes_eligibles").alias("themes_eligibles"), F.col("c.contribution_ecrites").alias("contributions"), F.col("c.person_score_ecrites").alias("person_scores"), F.col("c.group_score_ecrites").alias("group_scores"), F.col("c.mandate_score_ecrites").alias("mandate_scores"))
    return one.crossJoin(F.broadcast(runs.agg(F.count_if("is_current").alias("courants"))))


@query("current_person_scores", SCORED + " SELECT * FROM person_score")
def _(t):
    return current(t).current("person_score")


@query("current_mandate_scores", MANDATE + " SELECT * FROM mandate_score")
def _(t):
    return current(t).current("mandate_score")


@query("themes_of_run", BASE + ELIGIBLE + " SELECT theme_id, slug FROM eligible")
def _(t):
    return score_run.eligible_of_run(current(t).runs(), t.theme()).select("theme_id", "slug")


@query("fingerprint_tables", SCORED + GROUPED[GROUPED.index(",\nagreeing AS"):] + f""", g AS ({_GROUP_SCORE}), inside AS (SELECT m.mandat_id, g.* FROM mandat m JOIN group_row g ON g.organe_id = m.organe_id JOIN scrutin s ON s.scrutin_id = g.scrutin_id AND m.debut <= s.date_scrutin AND (m.fin_exclusive IS NULL OR s.date_scrutin < m.fin_exclusive)), m AS ({_tally("mandat_id, theme_id", "inside")})
 SELECT 'person' AS kind, person_id AS id, theme_id, score, contributions FROM person_score UNION ALL SELECT 'group', organe_id, theme_id, score, contributions FROM g UNION ALL SELECT 'mandate', mandat_id, theme_id, score, contributions FROM m""")
def _(t):
    """The three score tables as one, as a rerun is compared with the run before."""
    run, out = current(t), None
    for kind, name, key in (("person", "person_score", "person_id"), ("group", "group_score", "organe_id"), ("mandate", "mandate_score", "mandat_id")):
        one = run.current(name).select(F.lit(kind).alias("kind"), F.col(key).alias("id"), "theme_id", "score", "contributions")
        out = one if out is None else out.unionByName(one)
    return out


@query("contribution_rows_checked", BASE + ELIGIBLE + CONTRIBUTION + " SELECT count(*) AS n, count(*) FILTER (WHERE position = 'abstention') AS sans_apport, count(*) FILTER (WHERE poids = 0) AS sans_poids, CAST(0 AS BIGINT) AS fautes FROM contribution")
def _(t):
    """Contributions, those without value and without weight, and rows that break the rules between the three."""
    from ..operators import quality

    rows = current(t).current("contribution")
    bad = quality.contribution_rules(rows).agg(F.count("*").alias("fautes"))
    return rows.agg(F.count("*").alias("n"), F.count_if(F.col("apport").isNull()).alias("sans_apport"), F.count_if(F.col("poids") == 0).alias("sans_poids")).crossJoin(F.broadcast(bad))


# --- persons and roll-calls --------------------------------------------------------------------------------

def _documents(t: Tables) -> DataFrame:
    return t.raw("events").select(F.col("event_id").alias("document_id"), F.when(F.col("event_id") % 3 == 0, "an_scrutin").otherwise("an_acteur").alias("source"), F.concat(F.lit("PA"), F.col("user_id")).alias("uid"), F.concat(F.lit("https://data/"), F.col("event_id")).alias("url"), F.col("ts").alias("fetched_at"))


@query("person_detail", ctes("person", "person_slug", "candidate") + """ SELECT p.person_id, s.slug, p.civilite, p.prenom, p.nom, p.an_uid, CASE WHEN p.person_id % 7 = 0 THEN 'https://img/' || p.person_id END AS photo_url, CASE WHEN p.person_id % 7 = 0 THEN 'CC BY' END AS licence, c.statut, 'https://data/' || e.event_id AS source_url, e.ts AS source_fetched_at
 FROM person p LEFT JOIN person_slug s ON s.person_id = p.person_id AND is_current LEFT JOIN candidate c ON c.person_id = p.person_id LEFT JOIN (SELECT user_id, arg_max(event_id, (ts, event_id)) AS event_id, max(ts) AS ts FROM events WHERE event_id % 3 <> 0 GROUP BY user_id) e ON e.user_id = p.person_id""")
def _(t):
    photos = t.person().where("person_id % 7 = 0").select("person_id", F.concat(F.lit("https://img/"), F.col("person_id")).alias("photo_url"), F.lit("CC BY").alias("licence"))
    return reads.person_detail(t.person(), t.person_slug(), photos, t.candidate(), _documents(t))


SEEN = OVERVIEW + ", seen AS (SELECT o.*, coalesce(l.ls, []) AS ls FROM overview o LEFT JOIN (SELECT person_id, list_sort(list_distinct(list(legislature))) AS ls FROM vote JOIN scrutin USING (scrutin_id) GROUP BY person_id) l ON l.person_id = o.person_id)"


@query("person_legislatures", SEEN + " SELECT person_id, array_to_string(ls, ',') AS legislatures FROM seen")
def _(t):
    return reads.with_legislatures(_overview(t), t.vote(), t.scrutin()).select("person_id", F.array_join("legislatures", ",").alias("legislatures"))


@query("directory_page_legislature", SEEN + " SELECT person_id, slug, nom FROM seen WHERE slug IS NOT NULL AND list_contains(ls, 17) ORDER BY nom, prenom, person_id LIMIT 30")
def _(t):
    rows = reads.in_legislature(reads.with_legislatures(_overview(t), t.vote(), t.scrutin()), 17)
    return reads.directory(rows).select("person_id", "slug", "nom")


@query("directory_total", SEEN + " SELECT count(*) AS total FROM seen WHERE slug IS NOT NULL AND list_contains(ls, 17)")
def _(t):
    return reads.page_total(reads.in_legislature(reads.with_legislatures(_overview(t), t.vote(), t.scrutin()), 17).where("slug IS NOT NULL"))


def _authors(t: Tables) -> DataFrame:
    return t.raw("region").select(F.col("r_regionkey").cast("long").alias("author_id"), F.col("r_name").alias("display_name"))


def _label_entries(t: Tables) -> DataFrame:
    i = F.col("scrutin_id")
    return t.scrutin_label().withColumns({"author_id": i % 5, "reviewed_by": F.when(F.col("reviewed"), (i + 1) % 5), "import_id": F.when(F.col("method") == "import", i % 2)})


@query("rollcall_labels", ctes("scrutin_label", "theme") + " SELECT l.scrutin_id, t.slug, t.libelle, CAST(poids AS DOUBLE) AS poids, CAST(position_pour AS DOUBLE) AS position_pour, method, a.r_name AS author, CASE WHEN method = 'import' THEN 'lot-' || scrutin_id % 2 END AS filename, b.r_name AS reviewer FROM scrutin_label l JOIN theme t ON t.theme_id = l.theme_id JOIN region a ON a.r_regionkey = scrutin_id % 5 LEFT JOIN region b ON reviewed AND b.r_regionkey = (scrutin_id + 1) % 5")
def _(t):
    files = t.spark.range(2).select(F.col("id").alias("import_id"), F.concat(F.lit("lot-"), F.col("id")).alias("filename"))
    return reads.rollcall_labels(_label_entries(t), t.theme(), _authors(t), files)


@query("rollcall_revisions", "SELECT e.event_id AS revision_id, e.user_id AS scrutin_id, r.r_name AS display_name, e.ts AS created_at FROM events e JOIN region r ON r.r_regionkey = e.event_id % 5 WHERE e.user_id = 8")
def _(t):
    revisions = t.raw("events").select(F.col("event_id").alias("revision_id"), F.col("user_id").alias("scrutin_id"), F.col("ts").alias("created_at"), (F.col("event_id") % 5).alias("author_id"))
    return reads.rollcall_revisions(revisions, _authors(t), 8).select("revision_id", "scrutin_id", "display_name", "created_at")


@query("current_estimates", BASE + " SELECT scrutin_id, position_pour, separation, couverture, CASE WHEN scrutin_id % 2 = 0 THEN 'v2' END AS axis_version FROM estimate WHERE statut = 'ok' AND scrutin_id % 2 = 0")
def _(t):
    versions = t.spark.createDataFrame([("v1", False), ("v2", True)], "version string, is_current boolean")
    rows = measures(t).withColumn("axis_version", F.when(F.col("scrutin_id") % 2 == 0, "v2").otherwise("v1"))
    return reads.current_estimate(rows, versions)


@query("theme_by_slug", ctes("theme") + " SELECT * FROM theme WHERE slug = 'theme-3'")
def _(t):
    return reads.theme_by_slug(t.theme(), "theme-3")


@query("group_by_uid", ctes("organe") + " SELECT * FROM organe WHERE organe_uid = 'PO4'")
def _(t):
    return reads.group_by_uid(t.organe(), "PO4").unionByName(reads.group_by_uid(t.organe(), "PO23"))


@query("corpus_by_parameter", ctes("scrutin") + " SELECT * FROM scrutin WHERE chambre = 'assemblee' AND participation >= 0.4")
def _(t):
    return reads.corpus_by_parameter(t.scrutin(), t.spark.range(1).select(F.lit(0.4).alias("participation_min")))


@query("recent_jobs", "SELECT event_id AS job_id, event_type AS kind, ts AS scheduled_at FROM events ORDER BY ts DESC, event_id DESC LIMIT 50")
def _(t):
    return reads.recent_jobs(t.raw("events").select(F.col("event_id").alias("job_id"), F.col("event_type").alias("kind"), F.col("ts").alias("scheduled_at")))


@query("both_positions", ctes("vote") + " SELECT person_id FROM vote WHERE position = 'pour' INTERSECT SELECT person_id FROM vote WHERE position = 'contre'")
def _(t):
    """Persons who voted for some roll-call and against another."""
    return t.vote().where("position = 'pour'").select("person_id").intersect(t.vote().where("position = 'contre'").select("person_id"))


@query("worker_health", "SELECT 'ok' AS database, CASE WHEN max(ts) >= TIMESTAMP '2024-01-01 23:59:00' THEN 'ok' ELSE 'stale' END AS worker FROM events WHERE ts < TIMESTAMP '2024-01-02'")
def _(t):
    beats = t.raw("events").where(F.col("ts") < F.lit(NOW).cast("timestamp_ntz")).select(F.col("ts").cast("timestamp").alias("last_seen_at"))
    return score_run.health(beats, NOW)


@query("stale_jobs", "SELECT event_id AS id FROM events WHERE event_type = 'click' AND user_id NOT IN (SELECT user_id FROM events WHERE ts >= TIMESTAMP '2024-01-01 23:59:00' AND ts < TIMESTAMP '2024-01-02')")
def _(t):
    rows = t.raw("events")
    jobs = rows.select(F.col("event_id").alias("id"), F.when(F.col("event_type") == "click", "running").otherwise("done").alias("status"), F.col("user_id").alias("owner"))
    beats = rows.where(F.col("ts") < F.lit(NOW).cast("timestamp_ntz")).select(F.col("user_id").alias("worker_id"), F.col("ts").cast("timestamp").alias("last_seen_at"))
    return streaming.stale_jobs(jobs, beats, NOW).select("id")


# --- writes ------------------------------------------------------------------------------------------------

@query("upserted_tallies", ctes("scrutin_groupe") + " SELECT scrutin_id, organe_id, CASE WHEN organe_id < 10 THEN pour + 1 ELSE pour END AS pour FROM scrutin_groupe")
def _(t):
    old = t.scrutin_groupe().select("scrutin_id", "organe_id", "pour")
    return T.upsert(old.where("organe_id >= 5"), old.where("organe_id < 10").withColumn("pour", F.col("pour") + 1), ["scrutin_id", "organe_id"])


@query("estimates_after_rerun", BASE + " SELECT scrutin_id, position_pour, CASE WHEN scrutin_id % 3 = 0 THEN 'absent' WHEN scrutin_id % 3 = 1 THEN 'unchanged' ELSE 'updated' END AS change FROM (SELECT scrutin_id, CASE WHEN scrutin_id % 3 = 2 THEN 0.5 ELSE position_pour END AS position_pour FROM estimate WHERE statut = 'ok' AND position_pour <> 0.5)")
def _(t):
    """A third refused now (rows stay), a third the same, a third with a new measure."""
    i = F.col("scrutin_id")
    old = measures(t).where("statut = 'ok' AND position_pour <> 0.5").select("scrutin_id", "statut", "position_pour")
    new = old.select("scrutin_id", F.when(i % 3 == 0, "scrutin_unanime").otherwise("ok").alias("statut"), F.when(i % 3 == 2, 0.5).otherwise(F.col("position_pour")).alias("position_pour"))
    return T.measured(old, new).select("scrutin_id", "position_pour", "change")


@query("replaced_seed", "SELECT s_suppkey AS parti FROM supplier WHERE s_nationkey > 12")
def _(t):
    rows = t.raw("supplier").select("s_suppkey", "s_nationkey")
    return T.replace_all(rows, rows.where("s_nationkey <= 12"), "s_suppkey")[1].select(F.col("s_suppkey").alias("parti"))


@query("audit_of_changes", "SELECT s_suppkey, 'admin' AS author, CASE WHEN s_suppkey % 2 = 0 THEN 'created' ELSE 'updated' END AS action FROM supplier WHERE s_suppkey % 2 = 0 OR s_suppkey % 3 = 0")
def _(t):
    k = F.col("s_suppkey")
    rows = t.raw("supplier").select("s_suppkey", "s_name")
    new = rows.withColumn("s_name", F.when(k % 3 == 0, F.concat("s_name", F.lit("!"))).otherwise(F.col("s_name")))
    return T.audit(T.merge(rows.where(k % 2 == 1), new, ["s_suppkey"]), ["s_suppkey"], "admin").select("s_suppkey", "author", "action")


@query("import_states", "SELECT user_id AS run_id, arg_max(CASE event_type WHEN 'click' THEN 'staged' WHEN 'error' THEN 'rejected' ELSE 'accepted' END, (ts, event_id)) AS status FROM events GROUP BY user_id")
def _(t):
    """Staged, accepted or rejected: the last word on each import of an append-only ledger."""
    state = F.when(F.col("event_type") == "click", "staged").when(F.col("event_type") == "error", "rejected").otherwise("accepted")
    return T.run_status(t.raw("events").select(F.col("user_id").alias("run_id"), F.struct("ts", "event_id").alias("at"), state.alias("status"))).select("run_id", "status")


def _entries(t: Tables) -> DataFrame:
    three = lambda c: F.col(c).cast("decimal(4,3)").cast("string").alias(c)
    return t.scrutin_label().join(t.scrutin().select("scrutin_id", "scrutin_uid"), "scrutin_id").select("scrutin_uid", F.concat(F.lit("theme-"), F.col("theme_id")).alias("theme"), three("poids"), three("position_pour"), three("confiance"), F.lit("comme avant").alias("justification"), "method", "reviewed")


@query("replaced_labels", ctes("scrutin", "scrutin_label") + " SELECT scrutin_uid, 'theme-' || theme_id AS theme, CASE WHEN numero = 399012 THEN 'une autre raison' ELSE 'comme avant' END AS justification, CASE WHEN numero = 399012 THEN 'manual' ELSE method END AS method, CAST(1 AS BIGINT) AS revisions FROM scrutin JOIN scrutin_label USING (scrutin_id)")
def _(t):
    """One roll-call's labels replaced by hand, and another's by equal ones, which makes no revision."""
    old = _entries(t)
    found = t.scrutin().where("numero = 399012").select("scrutin_uid").first()
    uid = found[0] if found else ""  # tables without that roll-call have nothing to replace
    after, first = imports.replace_one(old, old.withColumn("justification", F.lit("une autre raison")), uid, "admin")
    again, second = imports.replace_one(after, after, uid, "admin")
    n = first.unionByName(second).agg(F.count("*").alias("revisions"))
    return again.select("scrutin_uid", "theme", "justification", "method").crossJoin(F.broadcast(n))


def _answers(t: Tables) -> DataFrame:
    """Tab-separated answer lines as a model gives them, some broken, with fences, comments and headers between."""
    i = F.col("scrutin_id")
    three = lambda c: F.col(c).cast("decimal(4,3)").cast("string")
    rows = t.scrutin_label().join(t.scrutin().select("scrutin_id", "scrutin_uid"), "scrutin_id")
    cells = [F.when(i % 11 == 0, F.lit("VX")).otherwise(F.col("scrutin_uid")), F.when(i % 7 == 0, "theme-9").otherwise(F.concat(F.lit("theme-"), F.col("theme_id"))), three("poids"), F.when(i % 13 == 0, "").otherwise(three("position_pour")), F.when(i % 5 == 0, "1.5").otherwise(three("confiance"))]
    line = F.concat_ws("\t", *cells, F.when(i % 17 != 0, F.lit("  une raison valable  ")))
    lines = F.array(F.lit("```tsv"), F.lit("# commentaire"), F.lit("uid\ttheme\tpoids"), F.lit("  "), line)
    return rows.select(F.format_string("lot:%s:%s", i.cast("string"), F.col("theme_id").cast("string")).alias("source"), F.explode(lines).alias("value"))


ANSWERED = ctes("scrutin", "scrutin_label") + ", a AS (SELECT scrutin_uid, 'theme-' || theme_id AS theme, CASE WHEN scrutin_id % 17 = 0 THEN 'colonnes' WHEN scrutin_id % 11 = 0 THEN 'scrutin_inconnu' WHEN scrutin_id % 7 = 0 THEN 'theme_inconnu' WHEN scrutin_id % 5 = 0 THEN 'confiance_hors_bornes' WHEN scrutin_id % 13 = 0 THEN 'position_absente' END AS problem FROM scrutin JOIN scrutin_label USING (scrutin_id))"


@query("answer_problems", ANSWERED + " SELECT coalesce(problem, '') AS problem, count(*) AS n FROM a GROUP BY ALL")
def _(t):
    rows = imports.check_answers(exchange.parse_answers(_answers(t)), t.theme(), t.scrutin())
    return rows.groupBy(F.coalesce("problem", F.lit("")).alias("problem")).agg(F.count("*").alias("n"))


@query("assembled_import", ANSWERED + " SELECT scrutin_uid, count(*) AS categorisations, string_agg(theme, ',' ORDER BY theme) AS themes, 'une raison valable' AS justification FROM a WHERE problem IS NULL GROUP BY scrutin_uid")
def _(t):
    checked = imports.check_answers(exchange.parse_answers(_answers(t)), t.theme(), t.scrutin())
    j = F.from_json("json", "categorisation array<struct<theme:string,poids:string,justification:string>>")["categorisation"].alias("c")
    return imports.assemble(checked, t.scrutin()).select("scrutin_uid", j).select("scrutin_uid", F.size("c").cast("long").alias("categorisations"), F.array_join(F.array_sort("c.theme"), ",").alias("themes"), F.get("c", F.lit(0))["justification"].alias("justification"))


# --- captured metadata and the anomaly ledger ---------------------------------------------------------------

def _hits(t: Tables) -> DataFrame:
    k = F.col("c_custkey")
    v = lambda name, x: F.concat(F.lit(f'"{name}":{{"value":"'), x, F.lit('"}'))
    number = F.when(k % 9 == 0, F.lit('"x":null')).otherwise(v("an", F.when(k % 8 == 0, k - k % 16).otherwise(k).cast("string")))
    image = F.when(k % 3 != 0, F.concat(F.lit(","), v("img", F.concat(F.lit("http://commons/Special:FilePath/Photo_"), k, F.lit(".jpg"))))).otherwise("")
    one = F.concat(F.lit('{"results":{"bindings":[{'), v("p", F.concat(F.lit("http://www.wikidata.org/entity/Q"), k)), F.lit(","), number, image, F.lit("}]}}"))
    return metadata.graph_hits(t.raw("customer").select(one.alias("raw")))


HITS = "WITH h AS (SELECT 'Q' || c_custkey AS qid, 'PA' || CASE WHEN c_custkey % 8 = 0 THEN c_custkey - c_custkey % 16 ELSE c_custkey END AS an_uid, CASE WHEN c_custkey % 3 <> 0 THEN 'http://commons/Special:FilePath/Photo_' || c_custkey || '.jpg' END AS image_url, c_custkey AS k FROM customer WHERE c_custkey % 9 <> 0)"
GOOD = HITS + ", good AS (SELECT * FROM h WHERE an_uid IN (SELECT an_uid FROM h GROUP BY an_uid HAVING count(*) = 1))"


@query("graph_hits", HITS + " SELECT qid, an_uid, image_url FROM h")
def _(t):
    return _hits(t)


@query("lookup_calls", GOOD + " SELECT count(DISTINCT image_url) AS titres, TRUE AS bornes FROM good")
def _(t):
    rows = metadata.calls(metadata.wanted_titles(naming.resolve_external_ids(_hits(t))[0]))
    return rows.agg(F.sum("n").alias("titres"), (F.max("n") <= metadata.TITLES_PER_CALL).alias("bornes"))


def _photos(t: Tables) -> tuple[DataFrame, DataFrame]:
    k = F.col("c_custkey")
    meta = F.when(k % 5 == 0, F.lit('{"LicenseShortName":{"value":" "}}')).otherwise('{"LicenseShortName":{"value":"CC BY-SA 4.0"},"Artist":{"value":"A"}}')
    info = F.when(k % 7 == 0, F.lit("null")).otherwise(F.concat(F.lit('[{"url":"http://img/'), k, F.lit('","extmetadata":'), meta, F.lit("}]")))
    page = F.concat(F.lit('{"query":{"pages":{"1":{"title":"File:Photo '), k, F.lit('.jpg","imageinfo":'), info, F.lit("}}}}"))
    pages = t.raw("customer").where(k % 10 != 1).select(page.alias("raw"))
    return metadata.photos(pages, metadata.wanted_titles(naming.resolve_external_ids(_hits(t))[0]))


@query("photos", GOOD + " SELECT an_uid, 'http://img/' || k AS url, 'File:Photo ' || k || '.jpg' AS commons_file, 'CC BY-SA 4.0' AS licence, 'A' AS auteur FROM good WHERE image_url IS NOT NULL AND k % 10 <> 1 AND k % 7 <> 0 AND k % 5 <> 0")
def _(t):
    return _photos(t)[0].select("an_uid", "url", "commons_file", "licence", "auteur")


@query("photo_anomalies", GOOD + " SELECT an_uid AS subject_uid, CASE WHEN k % 10 = 1 THEN 'titre Commons absent de la réponse' WHEN k % 7 = 0 THEN 'pas d''imageinfo' ELSE 'pas de licence exploitable dans extmetadata' END AS raison FROM good WHERE image_url IS NOT NULL AND (k % 10 = 1 OR k % 7 = 0 OR k % 5 = 0)")
def _(t):
    return _photos(t)[1].select("subject_uid", F.get_json_object("detail", "$.raison").alias("raison"))


@query("anomaly_ledger", BASE + HITS.replace("WITH h AS", ", h AS") + """, g AS (SELECT CASE WHEN n_nationkey % 3 = 0 THEN 'PA' || n_nationkey END AS x FROM nation)
 SELECT statut AS kind, count(*) AS n FROM estimate WHERE statut <> 'ok' GROUP BY statut
 UNION ALL SELECT 'wikidata_qid_ambigu', count(*) FROM (SELECT DISTINCT an_uid FROM h WHERE an_uid IN (SELECT an_uid FROM h GROUP BY an_uid HAVING count(*) > 1)) HAVING count(*) > 0
 UNION ALL SELECT 'acteur_inconnu', count(*) FROM customer WHERE c_custkey % 50 = 3 AND c_custkey IN (SELECT o_custkey FROM orders)
 UNION ALL SELECT 'slug_derive_d_identifiant', count(*) FROM nation WHERE n_nationkey % 4 = 0""")
def _(t):
    """Findings of several jobs as rows of one ledger, counted by kind."""
    k = F.col("c_custkey")
    uid = lambda c: F.concat(F.lit("PA"), c)
    cast = t.raw("orders").select(uid(F.col("o_custkey")).alias("acteur_uid"))
    persons = t.raw("customer").where(k % 50 != 3).select(uid(k).alias("an_uid"))
    n = F.col("n_nationkey")
    people = t.raw("nation").select((n + 1_000_000_000_000).cast("long").alias("person_id"), uid(n).alias("an_uid"), F.lit(None).cast("string").alias("wikidata_qid"), F.lit(None).cast("string").alias("prenom"), F.when(n % 4 == 0, "---").otherwise(F.col("n_name")).alias("nom"))
    found = anomalies.ledger(1, anomalies.refusals(measures(t)), anomalies.ambiguous_ids(naming.resolve_external_ids(_hits(t))[1]), anomalies.unknown_actors(cast, persons), anomalies.derived_slugs(naming.assign_slugs(people, t.person_slug())))
    return found.groupBy("kind").agg(F.count("*").alias("n"))


_KINDS = FOLD.replace("CAST(0 AS INT) AS n", "CAST([] AS VARCHAR[]) AS n").replace(
    "n + CASE WHEN len(k) = 0 OR x.debut > k[len(k)].fin THEN 0 ELSE 1 END",
    "list_append(n, CASE WHEN len(k) = 0 OR x.debut > k[len(k)].fin THEN '' WHEN x.fin <= k[len(k)].fin OR x.debut = k[len(k)].debut THEN 'mandat_inclus' WHEN x.debut = k[len(k)].fin THEN 'mandat_charniere' ELSE 'mandat_chevauchement' END)",
)


@query("membership_events", _KINDS + " SELECT kind, count(*) AS n FROM (SELECT unnest(n) AS kind FROM done) WHERE kind <> '' GROUP BY kind")
def _(t):
    """Clean-up events of memberships by kind."""
    return anomalies.membership_events(intervals.cleaned(_raw_mandates(t))).groupBy("kind").agg(F.count("*").alias("n"))


# --- reclaiming, keyed writes, search -------------------------------------------------------------------------

@query("reclaimed_jobs", """WITH alive AS (SELECT user_id FROM events WHERE ts > TIMESTAMP '2024-01-01 23:59:00' AND ts < TIMESTAMP '2024-01-02'),
 j AS (SELECT event_id AS id, CASE WHEN event_type = 'click' THEN 'running' ELSE 'done' END AS status, CASE WHEN event_id % 10 <> 0 THEN user_id END AS owner, event_id % 4 AS attempts, CASE WHEN event_id % 6 = 0 THEN 'earlier' END AS error FROM events),
 s AS (SELECT *, status = 'running' AND owner IS NOT NULL AND owner NOT IN (SELECT user_id FROM alive) AS stale FROM j)
 SELECT id, CASE WHEN NOT stale THEN status WHEN attempts >= 3 THEN 'failed' ELSE 'pending' END AS status, CASE WHEN NOT stale THEN owner END AS owner, CASE WHEN stale THEN coalesce(error, 'reclaimed: worker heartbeat expired') ELSE error END AS error FROM s""")
def _(t):
    """Running jobs of silent owners put back, or failed after their last attempt; a job without an owner is left alone."""
    rows, k = t.raw("events"), F.col("event_id")
    jobs = rows.select(k.alias("id"), F.when(F.col("event_type") == "click", "running").otherwise("done").alias("status"), F.when(k % 10 != 0, F.col("user_id")).alias("owner"), (k % 4).alias("attempts"), F.lit(3).alias("max_attempts"), F.when(k % 6 == 0, "earlier").alias("error"))
    beats = rows.where(F.col("ts") < F.lit(NOW).cast("timestamp_ntz")).select(F.col("user_id").alias("worker_id"), F.col("ts").cast("timestamp").alias("last_seen_at"))
    return streaming.reclaim(jobs, beats, NOW).select("id", "status", "owner", "error")


def _orders(t: Tables, name: str) -> KeyedTable:
    """Every order, put into a fresh table by key."""
    table = KeyedTable(t.store, f"{name}-{uuid.uuid4().hex}", ["o_orderkey"])
    table.merge(t.raw("orders").select("o_orderkey", "o_orderstatus", "o_custkey"))
    return table


@query("bulk_upserts", "SELECT o_orderkey, CASE WHEN o_orderkey % 100 = 7 THEN 'X' ELSE o_orderstatus END AS o_orderstatus, o_custkey FROM orders UNION ALL SELECT -o_orderkey, 'N', o_custkey FROM orders WHERE o_orderkey % 200 = 1")
def _(t):
    """A keyed table after a batch of changed, equal and new orders, merged twice; the second time writes nothing."""
    table, rows, k = _orders(t, "orders_keyed"), t.raw("orders"), F.col("o_orderkey")
    changed = rows.where(k % 50 == 7).select("o_orderkey", F.when(k % 100 == 7, "X").otherwise(F.col("o_orderstatus")).alias("o_orderstatus"), "o_custkey")
    batch = changed.unionByName(rows.where(k % 200 == 1).select((-k).alias("o_orderkey"), F.lit("N").alias("o_orderstatus"), "o_custkey"))
    table.merge(batch)
    table.merge(batch)
    return table.read()


@query("bulk_upsert_changes", "SELECT 2 AS v, 'updated' AS change, count(*) AS n FROM orders WHERE o_orderkey % 100 = 7 AND o_orderstatus <> 'X' HAVING count(*) > 0 UNION ALL SELECT 2, 'created', count(*) FROM orders WHERE o_orderkey % 200 = 1 HAVING count(*) > 0 UNION ALL SELECT 1, 'created', count(*) FROM orders")
def _(t):
    """What each merge changed, from the change table beside the keyed one."""
    table, rows, k = _orders(t, "orders_changes"), t.raw("orders"), F.col("o_orderkey")
    changed = rows.where(k % 50 == 7).select("o_orderkey", F.when(k % 100 == 7, "X").otherwise(F.col("o_orderstatus")).alias("o_orderstatus"), "o_custkey")
    table.merge(changed.unionByName(rows.where(k % 200 == 1).select((-k).alias("o_orderkey"), F.lit("N").alias("o_orderstatus"), "o_custkey")))
    return table.changes().groupBy("v", "change").agg(F.count("*").alias("n"))


def _text_index(t: Tables, again: bool = False) -> SearchIndex:
    index = SearchIndex(t.store, "document_search")
    return index if index.built() and not again else index.build(t.raw("documents"), "doc_id", F.col("text"))


FOLDED = "strip_accents(lower(text))"


@query("search_grams", f"SELECT gram, count(*) AS n FROM (SELECT DISTINCT doc_id, unnest(list_transform(range(1, length(f) - 1), lambda i: substr(f, i, 3))) AS gram FROM (SELECT doc_id, {FOLDED} AS f FROM documents)) GROUP BY gram")
def _(t):
    """The index built anew: how many texts hold each run of three characters."""
    return _text_index(t, again=True).counts()


@query("indexed_search", f"SELECT doc_id FROM documents WHERE {FOLDED} LIKE '%cionrr%'")
def _(t):
    return _text_index(t).search("cIÓnrr").select(F.col("key").alias("doc_id"))


@query("indexed_search_wildcards", f"SELECT doc_id FROM documents WHERE {FOLDED} LIKE '%the%ou_nt%'")
def _(t):
    return _text_index(t).search("ThÉ%où_nt").select(F.col("key").alias("doc_id"))


@query("directory_search", OVERVIEW + " SELECT person_id, slug, nom FROM overview WHERE slug IS NOT NULL AND recherche LIKE '%building customer#0000000%'")
def _(t):
    """Persons of the directory by part of their name, through the index of names."""
    overview, index = _overview(t), SearchIndex(t.store, "person_search", buckets=16, shards=16)
    if not index.built():
        index.build(overview, "person_id", F.col("recherche"))
    found = index.search("Buïlding CUSTOMER#0000000").select(F.col("key").alias("person_id"))
    return overview.where("slug IS NOT NULL").join(found, "person_id", "left_semi").select("person_id", "slug", "nom")


@query("totals_refreshed", ctes("scrutin") + " SELECT person_id, count(*) AS votes_total, min(date_scrutin) AS premier_vote, max(date_scrutin) AS dernier_vote FROM vote JOIN scrutin USING (scrutin_id) WHERE scrutin_id % 10 NOT IN (1, 3) GROUP BY person_id")
def _(t):
    """Vote totals after votes came (those of roll-calls ending in 0 or 2) and went (1 or 3), from the totals before and these alone."""
    votes = t.vote().join(t.scrutin().select("scrutin_id", "date_scrutin"), "scrutin_id")
    last = F.col("scrutin_id") % 10
    now = votes.where(~last.isin(1, 3))
    return T.totals_after(T.totals(votes.where(~last.isin(0, 2))), votes.where(last.isin(0, 2)), votes.where(last.isin(1, 3)), lambda persons: now.join(persons, "person_id", "left_semi"))


@query("contribution_rules_broken", BASE + ELIGIBLE + CONTRIBUTION + """ SELECT person_id, theme_id, scrutin_id FROM contribution WHERE (position = 'abstention' AND scrutin_id % 4 IN (0, 1)) OR (position <> 'abstention' AND (scrutin_id % 4 = 2 OR (exclusion IS NOT NULL AND scrutin_id % 4 = 3)))""")
def _(t):
    """Contributions made to break the rules one way or another, and those that are found to."""
    rows = _contributions(t)
    k, absent = F.col("scrutin_id") % 4, F.col("position") == "abstention"
    broken = rows.withColumns({
        "poids": F.when(absent & (k == 0), 0.5).when(~absent & F.col("exclusion").isNotNull() & (k == 3), 0.25).otherwise(F.col("poids")),
        "apport": F.when(~absent & (k == 2), None).otherwise(F.col("apport")),
        "exclusion": F.when(absent & (k == 1), None).otherwise(F.col("exclusion")),
    })
    return quality.contribution_rules(broken).select("person_id", "theme_id", "scrutin_id")


@query("import_life_cycle", """WITH RECURSIVE r AS (SELECT user_id AS import_id, event_id, CASE WHEN event_type = 'click' THEN 'stage' WHEN event_id % 17 = 0 THEN 'reject' ELSE 'accept' END AS action, event_id % 3 AS preview, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events),
 s AS (SELECT DISTINCT import_id, CAST(0 AS BIGINT) AS i, CAST(NULL AS BIGINT) AS event_id, '' AS outcome, FALSE AS known, FALSE AS done, CAST(NULL AS BIGINT) AS shown FROM r
 UNION ALL SELECT s.import_id, r.i, r.event_id, CASE WHEN NOT (s.known OR r.action = 'stage') THEN 'unknown' WHEN s.done THEN 'decided' WHEN r.action = 'stage' THEN 'pending' WHEN r.action = 'reject' THEN 'rejected' WHEN r.preview = s.shown THEN 'applied' ELSE 'stale' END,
  s.known OR r.action = 'stage', s.done OR (s.known AND (r.action = 'reject' OR (r.action = 'accept' AND r.preview = s.shown))), CASE WHEN s.known OR r.action = 'stage' THEN r.preview END FROM s JOIN r ON r.import_id = s.import_id AND r.i = s.i + 1)
 SELECT event_id, outcome FROM s WHERE i > 0""")
def _(t):
    """Every event as a request on the import of its user: staged, accepted with the preview of the moment, or rejected."""
    k = F.col("event_id")
    action = F.when(F.col("event_type") == "click", "stage").when(k % 17 == 0, "reject").otherwise("accept")
    requests = t.raw("events").select(F.col("user_id").alias("import_id"), F.struct("ts", "event_id").alias("at"), action.alias("action"), (k % 3).alias("preview"), k)
    return imports.life_cycle(requests).select("event_id", "outcome")


@query("deleted_labels", ctes("scrutin", "scrutin_label") + " SELECT scrutin_uid, count(*) AS avant, CAST(0 AS BIGINT) AS apres, (SELECT count(*) FROM scrutin_label WHERE scrutin_id % 6 <> 0) AS restants FROM scrutin_label JOIN scrutin USING (scrutin_id) WHERE scrutin_id % 6 = 0 GROUP BY scrutin_uid")
def _(t):
    """The labels of every sixth roll-call deleted: a revision each, and how many labels stay."""
    three = lambda c: F.col(c).cast("decimal(4,3)").cast("string").alias(c)
    labels = t.scrutin_label().join(t.scrutin().select("scrutin_id", "scrutin_uid"), "scrutin_id").select("scrutin_uid", F.concat(F.lit("theme-"), F.col("theme_id")).alias("theme"), three("poids"), three("position_pour"), three("confiance"), F.lit("une raison").alias("justification"))
    after, told = imports.delete_labels(labels, t.scrutin().where("scrutin_id % 6 = 0"), "admin")
    n = lambda c: F.size(F.from_json(c, "array<struct<theme:string>>")).cast("long").alias(c)
    return told.select("scrutin_uid", n("avant"), n("apres")).crossJoin(F.broadcast(after.agg(F.count("*").alias("restants"))))


@query("csv_round_trip", ctes("scrutin", "scrutin_label") + """ SELECT scrutin_uid, 'theme-' || theme_id AS theme, CAST(poids AS VARCHAR) AS poids, CAST(position_pour AS VARCHAR) AS position_pour, CAST(confiance AS VARCHAR) AS confiance, 'dit "ainsi", et' || chr(10) || 'pas autrement' AS justification
 FROM scrutin JOIN scrutin_label USING (scrutin_id) WHERE chambre = 'assemblee' AND participation >= 0.5""")
def _(t):
    """The label file written whole and read back as an import: what a file keeps of the labels, line breaks and quotes too."""
    groups = t.scrutin_groupe().join(t.organe(), "organe_id").select("scrutin_id", "rang", F.col("libelle_abrege").alias("abrege"), F.lit(None).cast("string").alias("position_majoritaire"))
    labels = t.scrutin_label().select("scrutin_id", F.concat(F.lit("theme-"), F.col("theme_id")).alias("theme"), "poids", "position_pour", "confiance", F.lit('dit "ainsi", et\npas autrement').alias("justification"))
    path = f"{t.store.folder}/label_files/{uuid.uuid4().hex}"
    exchange.csv_rows(exchange.export(t.scrutin(), groups, labels)).write.csv(path, header=True, escape='"')
    return exchange.read_csv(t.spark, path).drop("source")
