"""Read queries over votes, memberships and scores: f(tables, filters) -> DataFrame.

Optional filters are added to the plan only when given. Nulls sort last going up and first going down, spelled
out everywhere. Pages are top-k by key; lists that scroll far use a keyset instead of an offset.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.text import matches, search_text
from ..operators.tables import latest

DIRECTORY_PAGE, VOTES_PAGE, LABELLED_PAGE, RECENT, REVIEW = 30, 50, 30, 10, 50


def person_overview(persons: DataFrame, votes: DataFrame, rollcalls: DataFrame, memberships: DataFrame, groups: DataFrame, slugs: DataFrame, candidates: DataFrame) -> DataFrame:
    """One row a person: current slug, vote totals without joint sittings, last known group, search text.

    Votes are counted before they meet persons; the last group is one row a person before its name is joined.
    """
    kept = rollcalls.where("chambre = 'assemblee'").select("scrutin_id", "date_scrutin")
    totals = votes.join(kept, "scrutin_id").groupBy("person_id").agg(F.count("*").alias("votes_total"), F.min("date_scrutin").alias("premier_vote"), F.max("date_scrutin").alias("dernier_vote"))
    last = latest(memberships, ["person_id"], F.col("fin_exclusive").desc_nulls_first(), F.col("debut").desc_nulls_last(), F.col("mandat_id").desc()).select("person_id", F.col("organe_id").alias("dernier_groupe_id"))
    names = groups.select(F.col("organe_id").alias("dernier_groupe_id"), F.col("libelle").alias("dernier_groupe_libelle"))
    out = persons.join(slugs.where("is_current").select("person_id", "slug"), "person_id", "left").join(totals, "person_id", "left").join(last, "person_id", "left").join(names, "dernier_groupe_id", "left")
    out = out.join(candidates.select("person_id", F.lit(True).alias("est_candidat")), "person_id", "left")
    return out.select("person_id", "slug", "civilite", "prenom", "nom", F.coalesce("votes_total", F.lit(0)).alias("votes_total"), "premier_vote", "dernier_vote", "dernier_groupe_id", "dernier_groupe_libelle", F.coalesce("est_candidat", F.lit(False)).alias("est_candidat"), search_text(F.col("prenom"), F.col("nom")).alias("recherche"))


def directory(overview: DataFrame, q: str | None = None, page: int = 1) -> DataFrame:
    rows = overview.where("slug IS NOT NULL")
    rows = rows.where(matches(F.col("recherche"), q)) if q is not None else rows
    order = (F.col("nom").asc_nulls_last(), F.col("prenom").asc_nulls_last(), F.col("person_id"))
    return rows.orderBy(*order).offset((max(page, 1) - 1) * DIRECTORY_PAGE).limit(DIRECTORY_PAGE)


def candidate_list(overview: DataFrame, candidates: DataFrame, q: str | None = None) -> DataFrame:
    rows = overview.where("slug IS NOT NULL").join(candidates, "person_id")
    rows = rows.where(matches(F.col("recherche"), q)) if q is not None else rows
    return rows.orderBy(F.col("nom").asc_nulls_last(), F.col("prenom").asc_nulls_last(), "person_id")


def resolve_slug(slugs: DataFrame, slug: str) -> DataFrame:
    """The person behind any slug with its current one; nothing for an unknown slug."""
    current = slugs.where("is_current").select("person_id", F.col("slug").alias("current_slug"))
    return slugs.where(F.col("slug") == slug).select("person_id", "is_current").join(current, "person_id")


def person_votes(votes: DataFrame, rollcalls: DataFrame, person_id: int, legislature: int | None = None, position: str | None = None, first_day: str | None = None, last_day: str | None = None, before: tuple[str, int] | None = None, size: int = VOTES_PAGE) -> DataFrame:
    """A page of a person's votes, newest first, one row more than the page to tell whether there is another."""
    rows = votes.where(F.col("person_id") == person_id).join(rollcalls, "scrutin_id")
    for value, test in ((legislature, F.col("legislature") == F.lit(legislature)), (position, F.col("position") == F.lit(position)), (first_day, F.col("date_scrutin") >= F.lit(first_day).cast("date")), (last_day, F.col("date_scrutin") <= F.lit(last_day).cast("date"))):
        rows = rows.where(test) if value is not None else rows
    if before is not None:
        day, key = F.lit(before[0]).cast("date"), F.lit(before[1])
        rows = rows.where((F.col("date_scrutin") < day) | ((F.col("date_scrutin") == day) & (F.col("scrutin_id") < key)))
    return rows.orderBy(F.col("date_scrutin").desc(), F.col("scrutin_id").desc()).limit(size + 1).select("scrutin_id", "scrutin_uid", "legislature", "numero", "titre", "date_scrutin", "chambre", "position")


def recent_votes(votes: DataFrame, rollcalls: DataFrame, person_id: int) -> DataFrame:
    return person_votes(votes, rollcalls, person_id, size=RECENT - 1)


def person_orientations(person_id: int, eligible: DataFrame, scores: DataFrame, contributions: DataFrame) -> DataFrame:
    """One row for each eligible left-right theme with the person's counts, and a score where there is one."""
    mine = contributions.where(F.col("person_id") == person_id).groupBy("theme_id").agg(F.count_if(F.col("poids") > 0).alias("contributions"), F.count_if(F.col("position") == "abstention").alias("abstentions"))
    score = scores.where(F.col("person_id") == person_id).select("theme_id", "score", "incertitude", "relues", "ecartes_desaccord")
    rows = eligible.where("axe_gauche_droite").join(score, "theme_id", "left").join(mine, "theme_id", "left")
    return rows.select("theme_id", "slug", "rang", "score", "incertitude", "relues", "ecartes_desaccord", F.coalesce("contributions", F.lit(0)).alias("contributions"), F.coalesce("abstentions", F.lit(0)).alias("abstentions")).orderBy("rang")


def hidden_themes(eligible: DataFrame) -> DataFrame:
    return eligible.agg(F.count_if(~F.col("axe_gauche_droite")).alias("n"))


def theme_contributions(person_id: int, theme_id: int, contributions: DataFrame, rollcalls: DataFrame) -> DataFrame:
    """Every contribution of a person to a theme, newest first, never cut short."""
    rows = contributions.where((F.col("person_id") == person_id) & (F.col("theme_id") == theme_id)).join(rollcalls.select("scrutin_id", "scrutin_uid", "titre", "date_scrutin"), "scrutin_id")
    return rows.orderBy(F.col("date_scrutin").desc(), F.col("scrutin_id").desc())


def mandate_orientations(person_id: int, memberships: DataFrame, groups: DataFrame, scores: DataFrame, themes: DataFrame) -> DataFrame:
    """A person's memberships with the scores of their group in that period, one row a membership."""
    rows = memberships.where(F.col("person_id") == person_id).join(scores, "mandat_id").join(themes.where("axe_gauche_droite").select("theme_id", "rang"), "theme_id").join(groups.select("organe_id", "organe_uid", "libelle"), "organe_id")
    item = F.struct("rang", "theme_id", "score", "cohesion", "contributions")
    return rows.groupBy("mandat_id", "organe_uid", "libelle", "debut", F.date_sub("fin_exclusive", 1).alias("fin")).agg(F.array_sort(F.collect_list(item)).alias("orientations")).orderBy(F.col("debut").asc_nulls_first(), F.col("fin").asc_nulls_last())


def group_orientations(organe_id: int, scores: DataFrame, themes: DataFrame) -> DataFrame:
    return scores.where(F.col("organe_id") == organe_id).join(themes.where("axe_gauche_droite").select("theme_id", "slug", "rang"), "theme_id").orderBy("rang")


def rollcall_detail(rollcalls: DataFrame, tallies: DataFrame, groups: DataFrame, legislature: int | None = None, number: int | None = None, uid: str | None = None) -> DataFrame:
    """One roll-call, by uid or by legislature and number, with its groups in order of rank."""
    one = rollcalls.where(F.col("scrutin_uid") == uid) if uid is not None else rollcalls.where((F.col("legislature") == legislature) & (F.col("numero") == number))
    item = F.struct("rang", "organe_uid", "libelle", "nombre_membres", "pour", "contre", "abstentions", "non_votants")
    rows = tallies.join(one.select("scrutin_id"), "scrutin_id", "left_semi").join(groups.select("organe_id", "organe_uid", "libelle"), "organe_id", "left")
    return one.join(rows.groupBy("scrutin_id").agg(F.array_sort(F.collect_list(item)).alias("groupes")), "scrutin_id", "left")


def labelled(rollcalls: DataFrame, labels: DataFrame, themes: DataFrame, theme: str | None = None, legislature: int | None = None, page: int = 1) -> DataFrame:
    """A page of labelled roll-calls with their theme names, newest first."""
    named = labels.join(themes.select("theme_id", "slug", "libelle"), "theme_id")
    rows = rollcalls.join(named.where(F.col("slug") == theme) if theme is not None else named, "scrutin_id", "left_semi")
    rows = rows.where(F.col("legislature") == legislature) if legislature is not None else rows
    cut = rows.orderBy(F.col("date_scrutin").desc(), "scrutin_id").offset((max(page, 1) - 1) * LABELLED_PAGE).limit(LABELLED_PAGE)
    names = named.join(cut.select("scrutin_id"), "scrutin_id", "left_semi").groupBy("scrutin_id").agg(F.concat_ws(";", F.array_sort(F.collect_list("libelle"))).alias("themes"))
    return cut.join(names, "scrutin_id", "left").select("scrutin_id", "legislature", "numero", "titre", "date_scrutin", "themes")


def active_themes(themes: DataFrame) -> DataFrame:
    return themes.where("actif").orderBy("rang")


def comparable(labels: DataFrame, estimates: DataFrame, themes: DataFrame) -> DataFrame:
    """Labels and measures of one roll-call that both have a sign."""
    measure = estimates.where("position_pour <> 0").select("scrutin_id", F.col("position_pour").alias("mesuree"), "separation")
    return labels.where("position_pour IS NOT NULL AND position_pour <> 0").select("scrutin_id", "theme_id", F.col("position_pour").cast("double").alias("saisie"), "method", "reviewed").join(measure, "scrutin_id").join(themes.select("theme_id", "slug", "axe_gauche_droite"), "theme_id")


def agreement(rows: DataFrame, *keys: Column) -> DataFrame:
    """Share of labels whose sign the measure confirms, by the given keys."""
    agree = F.count_if(F.signum("saisie") == F.signum("mesuree"))
    return rows.groupBy(*keys).agg(F.count("*").alias("comparables"), agree.alias("accords"), F.round(agree * 100.0 / F.count("*"), 1).cast("double").alias("pct"))


def review_queue(rows: DataFrame, rollcalls: DataFrame) -> DataFrame:
    """Disagreements, the clearest measures first."""
    bad = rows.where(F.signum("saisie") != F.signum("mesuree")).join(rollcalls.select("scrutin_id", "legislature", "numero", F.left("titre", F.lit(90)).alias("titre")), "scrutin_id")
    return bad.orderBy(F.col("separation").desc_nulls_last(), F.abs("mesuree").desc(), "scrutin_id", "theme_id").limit(REVIEW).select("scrutin_id", "legislature", "numero", "slug", "saisie", "mesuree", "separation", "method", "reviewed", "titre")


def work_corpus(rollcalls: DataFrame, labels: DataFrame, priority: Column, participation_min: float = 0.5) -> DataFrame:
    """Roll-calls worth labelling with priority, minority share and whether they are labelled."""
    done = labels.select("scrutin_id", F.lit(True).alias("_done")).distinct()
    share = F.least("pour", "contre").cast("double") / F.nullif("suffrages_exprimes", F.lit(0)).cast("double")
    rows = rollcalls.where((F.col("chambre") == "assemblee") & (F.col("participation") >= participation_min)).join(done, "scrutin_id", "left")
    return rows.select("scrutin_id", "legislature", "numero", "date_scrutin", "titre", "type_code", share.alias("part_minoritaire"), priority.alias("rang_priorite"), F.coalesce("_done", F.lit(False)).alias("est_categorise"))


def next_to_label(corpus: DataFrame, skipped: list[int] = ()) -> DataFrame:
    rows = corpus.where("NOT est_categorise")
    rows = rows.where(~F.col("scrutin_id").isin(*skipped)) if skipped else rows
    return rows.orderBy("rang_priorite", F.col("part_minoritaire").desc_nulls_last(), F.col("date_scrutin").desc(), "scrutin_id").limit(1)


def coverage(corpus: DataFrame) -> DataFrame:
    return corpus.agg(F.count("*").alias("corpus"), F.count_if("est_categorise").alias("categorises"), F.count_if(~F.col("est_categorise")).alias("restants"))


def with_legislatures(overview: DataFrame, votes: DataFrame, rollcalls: DataFrame) -> DataFrame:
    """The overview with the legislatures in which a person voted, in order."""
    seen = votes.join(rollcalls.select("scrutin_id", "legislature"), "scrutin_id").groupBy("person_id").agg(F.array_sort(F.collect_set("legislature")).alias("legislatures"))
    return overview.join(seen, "person_id", "left").withColumn("legislatures", F.coalesce("legislatures", F.array().cast("array<int>")))


def in_legislature(overview: DataFrame, legislature: int) -> DataFrame:
    return overview.where(F.array_contains("legislatures", legislature))


def page_total(rows: DataFrame) -> DataFrame:
    return rows.agg(F.count("*").alias("total"))


def person_detail(persons: DataFrame, slugs: DataFrame, photos: DataFrame, candidates: DataFrame, documents: DataFrame, person_id: int | None = None) -> DataFrame:
    """Persons (or one) with current slug, photo, candidacy and the latest source document of the actor."""
    rows = persons if person_id is None else persons.where(F.col("person_id") == person_id)
    last = documents.where("source = 'an_acteur'").groupBy(F.col("uid").alias("an_uid")).agg(F.max_by(F.struct("url", "fetched_at"), F.struct("fetched_at", "document_id")).alias("d"))
    out = rows.join(slugs.where("is_current").select("person_id", "slug"), "person_id", "left").join(photos, "person_id", "left").join(candidates, "person_id", "left").join(last, "an_uid", "left")
    return out.select("person_id", "slug", "civilite", "prenom", "nom", "an_uid", "photo_url", "licence", "statut", F.col("d.url").alias("source_url"), F.col("d.fetched_at").alias("source_fetched_at"))


def rollcall_labels(labels: DataFrame, themes: DataFrame, authors: DataFrame, files: DataFrame, scrutin_id: int | None = None) -> DataFrame:
    """Labels of a roll-call (or of all) with theme, author, file and reviewer by name, in order of theme."""
    rows = labels if scrutin_id is None else labels.where(F.col("scrutin_id") == scrutin_id)
    rows = rows.join(themes.select("theme_id", "slug", "libelle"), "theme_id").join(authors.select("author_id", F.col("display_name").alias("author")), "author_id")
    rows = rows.join(authors.select(F.col("author_id").alias("reviewed_by"), F.col("display_name").alias("reviewer")), "reviewed_by", "left").join(files, "import_id", "left")
    return rows.select("scrutin_id", "slug", "libelle", F.col("poids").cast("double").alias("poids"), F.col("position_pour").cast("double").alias("position_pour"), "method", "author", "filename", "reviewer").orderBy("scrutin_id", "slug")


def rollcall_revisions(revisions: DataFrame, authors: DataFrame, scrutin_id: int | None = None) -> DataFrame:
    """Revisions of a roll-call (or of all) with their authors, newest first."""
    rows = revisions if scrutin_id is None else revisions.where(F.col("scrutin_id") == scrutin_id)
    return rows.join(authors.select("author_id", "display_name"), "author_id").orderBy("scrutin_id", F.col("created_at").desc(), F.col("revision_id").desc())


def current_estimate(estimates: DataFrame, axis_versions: DataFrame, scrutin_id: int | None = None) -> DataFrame:
    """The measure of a roll-call (or of all) under the axis version that is current."""
    rows = estimates if scrutin_id is None else estimates.where(F.col("scrutin_id") == scrutin_id)
    return rows.join(axis_versions.where("is_current").select(F.col("version").alias("axis_version")), "axis_version").where("statut = 'ok'").select("scrutin_id", "position_pour", "separation", "couverture", "axis_version")


def theme_by_slug(themes: DataFrame, slug: str) -> DataFrame:
    return themes.where(F.col("slug") == slug)


def group_by_uid(groups: DataFrame, uid: str) -> DataFrame:
    """A group by its uid; the non-attached one is no group."""
    return groups.where((F.col("organe_uid") == uid) & ~F.col("is_non_inscrit"))


def corpus_by_parameter(rollcalls: DataFrame, parameters: DataFrame) -> DataFrame:
    """Roll-calls of the corpus, its threshold from the one-row parameter table."""
    one = parameters.select("participation_min").limit(1)
    return rollcalls.crossJoin(F.broadcast(one)).where("chambre = 'assemblee' AND participation >= participation_min").drop("participation_min")


def recent_jobs(jobs: DataFrame, size: int = 50) -> DataFrame:
    return jobs.orderBy(F.col("scheduled_at").desc(), F.col("job_id").desc()).limit(size)
