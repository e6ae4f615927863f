"""Irregular JSON documents to typed rows, by VARIANT functions; nothing leaves the JVM.

Scalars come as a string, as {"#text": ...}, as {"@xsi:nil": "true"} or as null; a list of one comes as
its element; the keys of nominal blocks are data.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

#: Spelling of nominal blocks and of corrections, and what they mean.
BLOCKS = {"pours": "pour", "pour": "pour", "contres": "contre", "contre": "contre", "abstentions": "abstention", "abstention": "abstention", "nonVotants": "non_votant", "nonVotant": "non_votant"}
DECLARED = {"pours": "pour", "contres": "contre", "abstentions": "abstention", "nonVotants": "non_votant", "nonVotantsVolontaires": "non_votant_volontaire"}
CAUSES = ("PSE", "PAN", "MG")


def read(v: Column, kind: str, *keys: str) -> Column:
    """A nested field as a type, null wherever the way there ends or the type does not fit.

    Each variant in the type is written anew with all below it, so that what is large is best read as what it holds.
    """
    return F.try_variant_get(v, "$" + "".join(f"['{k}']" for k in keys), kind)


def field(v: Column, *keys: str) -> Column:
    """A nested field as a variant, null wherever the way there ends."""
    return read(v, "variant", *keys)


def shape(v: Column) -> Column:
    return F.schema_of_variant(v)


def scalar(v: Column) -> Column:
    """The string, or the text of an object that is not nil; only an object has these fields."""
    return F.when(shape(v) == "STRING", read(v, "string")).when(~read(v, "string", "@xsi:nil").eqNullSafe("true"), read(v, "string", "#text"))


def listing(v: Column, *keys: str) -> Column:
    """A list, or a list of the one element, or an empty list; what is no list cannot be read as one.

    The shape of a large value is not asked for: that would name the types of everything in it.
    """
    none, one = F.array().cast("array<variant>"), field(v, *keys) if keys else v
    return F.coalesce(read(v, "array<variant>", *keys), F.when(one.isNull() | F.is_variant_null(one), none).otherwise(F.array(one)))


def text(v: Column, *keys: str) -> Column:
    return scalar(field(v, *keys))


def whole(v: Column, *keys: str) -> Column:
    return text(v, *keys).try_cast("int")


def day(v: Column, *keys: str) -> Column:
    return F.try_to_date(text(v, *keys), "yyyy-MM-dd")


def parse(documents: DataFrame, *root: str) -> DataFrame:
    """Documents with column `v`, the whole document or the object under `root`, parsed once each.

    Conditions on fields move below a projection and would parse anew for every field; they stay above the
    explosion of an array of one.
    """
    v = F.try_parse_json("raw")
    return documents.withColumn("v", F.explode(F.array(field(v, *root) if root else v)))


def actors(documents: DataFrame) -> DataFrame:
    """Person rows with their memberships as an array; documents without uid drop out."""
    d, v = parse(documents, "acteur"), F.col("v")
    m = lambda x: F.struct(
        text(x, "uid").alias("an_uid"),
        text(x, "organes", "organeRef").alias("organe_uid"),
        text(x, "typeOrgane").alias("type_organe"),
        day(x, "dateDebut").alias("debut"),
        day(x, "dateFin").alias("fin"),
        text(x, "infosQualite", "codeQualite").alias("qualite"),
        whole(x, "legislature").alias("legislature"),
    )
    rows = d.select(
        text(v, "uid").alias("an_uid"),
        text(v, "etatCivil", "ident", "civ").alias("civilite"),
        text(v, "etatCivil", "ident", "prenom").alias("prenom"),
        text(v, "etatCivil", "ident", "nom").alias("nom"),
        day(v, "etatCivil", "infoNaissance", "dateNais").alias("date_naissance"),
        text(v, "etatCivil", "infoNaissance", "villeNais").alias("ville_naissance"),
        text(v, "etatCivil", "infoNaissance", "depNais").alias("departement_naissance"),
        text(v, "etatCivil", "infoNaissance", "paysNais").alias("pays_naissance"),
        day(v, "etatCivil", "dateDeces").alias("date_deces"),
        text(v, "uri_hatvp").alias("uri_hatvp"),
        F.filter(F.transform(listing(field(v, "mandats", "mandat")), m), lambda x: x["an_uid"].isNotNull()).alias("mandats"),
    )
    return rows.where("an_uid IS NOT NULL")


def organs(documents: DataFrame) -> DataFrame:
    """Organ rows; uid, type and label are mandatory."""
    d, v = parse(documents, "organe"), F.col("v")
    rows = d.select(
        text(v, "uid").alias("an_uid"),
        text(v, "codeType").alias("code_type"),
        text(v, "libelle").alias("libelle"),
        text(v, "libelleAbrege").alias("libelle_abrege"),
        text(v, "libelleAbrev").alias("libelle_abrev"),
        whole(v, "legislature").alias("legislature"),
        day(v, "viMoDe", "dateDebut").alias("debut"),
        F.date_add(day(v, "viMoDe", "dateFin"), 1).alias("fin_exclusive"),
    )
    return rows.where("an_uid IS NOT NULL AND code_type IS NOT NULL AND libelle IS NOT NULL").withColumn("is_non_inscrit", F.coalesce((F.col("code_type") == "GP") & (F.col("libelle_abrev") == "NI"), F.lit(False)))


RETAINED = ("GP", "PARPOL", "ASSEMBLEE")


def classify_memberships(people: DataFrame, known: DataFrame) -> DataFrame:
    """Memberships of retained types with `statut`: ok, organe_inconnu, sans_debut or dates_inversees."""
    rows = people.select("an_uid", F.explode("mandats").alias("m")).select(F.col("an_uid").alias("person_uid"), "m.*").where(F.col("type_organe").isin(*RETAINED))
    rows = rows.join(known.select(F.col("an_uid").alias("organe_uid"), F.lit(True).alias("known")), "organe_uid", "left")
    status = F.when(F.col("known").isNull(), "organe_inconnu").when(F.col("debut").isNull(), "sans_debut").when(F.col("fin") < F.col("debut"), "dates_inversees").otherwise("ok")
    return rows.withColumn("statut", status).drop("known")


def rollcalls(documents: DataFrame) -> DataFrame:
    """Roll-call headers beside their groups and corrections as variants; mandatory fields or nothing."""
    d, v, s = parse(documents), F.col("v"), "scrutin"
    count = lambda *keys: F.coalesce(whole(v, s, "syntheseVote", *keys), F.lit(0))
    rows = d.select(
        text(v, s, "uid").alias("an_uid"),
        whole(v, s, "numero").alias("numero"),
        whole(v, s, "legislature").alias("legislature"),
        day(v, s, "dateScrutin").alias("date_scrutin"),
        F.when(text(v, s, "uid").startswith("VTCGR"), "congres").otherwise("assemblee").alias("chambre"),
        text(v, s, "organeRef").alias("organe_uid"),
        text(v, s, "sessionRef").alias("session_ref"),
        text(v, s, "seanceRef").alias("seance_ref"),
        text(v, s, "typeVote", "codeTypeVote").alias("type_code"),
        text(v, s, "typeVote", "libelleTypeVote").alias("type_libelle"),
        text(v, s, "typeVote", "typeMajorite").alias("type_majorite"),
        text(v, s, "sort", "code").alias("sort_code"),
        text(v, s, "titre").alias("titre"),
        text(v, s, "demandeur", "texte").alias("demandeur"),
        text(v, s, "objet", "dossierLegislatif", "dossierRef").alias("dossier_ref"),
        text(v, s, "modePublicationDesVotes").alias("mode_publication"),
        text(v, s, "lieuVote").alias("lieu_vote"),
        count("nombreVotants").alias("nombre_votants"),
        count("suffragesExprimes").alias("suffrages_exprimes"),
        *[count("decompte", k).alias(n) for k, n in (("pour", "pour"), ("contre", "contre"), ("abstentions", "abstentions"), ("nonVotants", "non_votants"), ("nonVotantsVolontaires", "non_votants_volontaires"))],
        listing(v, s, "ventilationVotes", "organe", "groupes", "groupe").alias("groupes"),
        field(v, s, "miseAuPoint").alias("mise_au_point"),
    )
    need = ("an_uid", "numero", "legislature", "date_scrutin", "type_code", "titre", "mode_publication")
    return rows.where(" AND ".join(f"{c} IS NOT NULL" for c in need))


def since(parsed: DataFrame, first_day) -> DataFrame:
    return parsed.where(F.col("date_scrutin") >= F.lit(first_day))


def group_rows(parsed: DataFrame) -> DataFrame:
    """One row a group of a roll-call, numbered by its place, with its nominal blocks."""
    g = F.col("g")
    count = lambda k: F.coalesce(whole(g, "vote", "decompteVoix", k), F.lit(0))
    rows = parsed.select("an_uid", "date_scrutin", F.posexplode_outer("groupes").alias("rang", "g")).where("rang IS NOT NULL")  # the inner form would read the list twice more, to drop empty ones
    return rows.select(
        "an_uid",
        "date_scrutin",
        (F.col("rang") + 1).alias("rang"),
        text(g, "organeRef").alias("organe_uid"),
        F.coalesce(whole(g, "nombreMembresGroupe"), F.lit(0)).alias("nombre_membres"),
        text(g, "vote", "positionMajoritaire").alias("position_majoritaire"),
        count("pour").alias("pour"),
        count("contre").alias("contre"),
        count("abstentions").alias("abstentions"),
        count("nonVotants").alias("non_votants"),
        field(g, "vote", "decompteNominatif").alias("blocs"),
    )


def _blocks(rows: DataFrame, column: str) -> DataFrame:
    """Explode an object of blocks to (…, bloc, entry list); a block is {votant: …} or a bare list."""
    mapped = F.try_variant_get(F.col(column), "$", "map<string,variant>")  # null for what is no object
    out = rows.select(*[c for c in rows.columns if c != column], F.explode_outer(mapped).alias("bloc", "content")).where("bloc IS NOT NULL")
    entries = F.coalesce(read(F.col("content"), "array<variant>"), listing(F.col("content"), "votant"))
    return out.withColumn("entries", entries)


def _lookup(column: Column, values: dict[str, str]) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in values.items() for x in kv]), column)


def votes(groups: DataFrame) -> DataFrame:
    """One row a nominal vote; entries without an actor and unknown blocks drop out."""
    rows = _blocks(groups.select("an_uid", "date_scrutin", "rang", "organe_uid", "blocs"), "blocs").withColumn("position", _lookup(F.col("bloc"), BLOCKS)).where("position IS NOT NULL")
    e = F.col("e")
    rows = rows.select("an_uid", "date_scrutin", "rang", "organe_uid", "position", F.explode("entries").alias("e"))
    rows = rows.select("an_uid", "date_scrutin", "rang", "organe_uid", "position", text(e, "acteurRef").alias("acteur_uid"), text(e, "mandatRef").alias("mandat_uid"), text(e, "causePositionVote").alias("cause_non_vote"), F.coalesce(text(e, "parDelegation") == "true", F.lit(False)).alias("par_delegation"))
    return rows.where("acteur_uid IS NOT NULL")


def corrections(parsed: DataFrame) -> DataFrame:
    """(an_uid, acteur_uid, position_declaree) of declarations after the vote."""
    rows = _blocks(parsed.select("an_uid", "mise_au_point"), "mise_au_point").withColumn("position_declaree", _lookup(F.col("bloc"), DECLARED)).where("position_declaree IS NOT NULL")
    return rows.select("an_uid", "position_declaree", F.explode("entries").alias("e")).select("an_uid", text(F.col("e"), "acteurRef").alias("acteur_uid"), "position_declaree").where("acteur_uid IS NOT NULL")


VOTER = "struct<acteurRef:variant,causePositionVote:variant>"
DETAILS = {"bloc_nominatif_inconnu": ("rang", "bloc"), "cause_non_vote_inconnue": ("acteur_uid", "cause_non_vote"), "groupe_fantome": ("rang", "organe_uid"), "compteurs_incoherents": ("nominatifs", "nombre_votants", "non_votants")}


def _voters(content: Column) -> Column:
    """The entries of a block, those that are no objects null."""
    return F.coalesce(read(content, f"array<{VOTER}>"), read(content, f"array<{VOTER}>", "votant"), F.array(read(content, VOTER, "votant")))


def document_anomalies(parsed: DataFrame, known_organs: DataFrame) -> DataFrame:
    """(kind, subject_uid, detail): unknown blocks, unknown causes, phantom groups, tallies that do not add up.

    A group is a phantom whose organ is missing, PO0 or not in the registry. A document is gone through once, and its nominal votes are counted within it; only its groups then meet the
    registry. Groups without organ, which no organ can match, are spread by their document.
    """
    blocks = lambda g: F.map_entries(F.coalesce(read(g, "map<string,variant>", "vote", "decompteNominatif"), F.create_map().cast("map<string,variant>")))
    away = [k for k, v in BLOCKS.items() if v == "non_votant"]
    cell = lambda i: lambda b: F.struct((i + 1).alias("rang"), b["key"].alias("bloc"), _voters(b["value"]).alias("entries"))
    vote = lambda c: lambda e: F.struct(scalar(e["acteurRef"]).alias("acteur_uid"), F.when(c["bloc"].isin(*away), scalar(e["causePositionVote"])).alias("cause_non_vote"))
    rows = parsed.select(
        "an_uid",
        "nombre_votants",
        "non_votants",
        F.transform("groupes", lambda g, i: F.struct((i + 1).alias("rang"), text(g, "organeRef").alias("organe_uid"))).alias("groups"),
        F.flatten(F.transform("groupes", lambda g, i: F.transform(blocks(g), cell(i)))).alias("cells"),
    )
    cast = F.flatten(F.transform(F.filter("cells", lambda c: c["bloc"].isin(*BLOCKS)), lambda c: F.transform(c["entries"], vote(c))))
    rows = rows.withColumn("cast", F.filter(cast, lambda e: e["acteur_uid"].isNotNull())).withColumn("nominatifs", F.size("cast"))
    kinds = {"rang": "int", "organe_uid": "string", "bloc": "string", "acteur_uid": "string", "cause_non_vote": "string"}
    found = lambda kind, **given: F.struct(F.lit(kind).alias("kind"), *[given.get(c, F.lit(None)).cast(t).alias(c) for c, t in kinds.items()])
    all_found = F.concat(
        F.transform(F.filter("cells", lambda c: ~c["bloc"].isin(*BLOCKS)), lambda c: found("bloc_nominatif_inconnu", rang=c["rang"], bloc=c["bloc"])),
        F.transform(F.filter("cast", lambda e: e["cause_non_vote"].isNotNull() & ~e["cause_non_vote"].isin(*CAUSES)), lambda e: found("cause_non_vote_inconnue", acteur_uid=e["acteur_uid"], cause_non_vote=e["cause_non_vote"])),
        F.transform("groups", lambda g: found("groupe_fantome", rang=g["rang"], organe_uid=g["organe_uid"])),
        F.when(F.col("nominatifs") != F.col("nombre_votants") + F.col("non_votants"), F.array(found("compteurs_incoherents"))).otherwise(F.array().cast("array<struct<kind:string,rang:int,organe_uid:string,bloc:string,acteur_uid:string,cause_non_vote:string>>")),
    )
    rows = rows.select("an_uid", "nominatifs", "nombre_votants", "non_votants", F.explode(all_found).alias("a")).select("an_uid", "nominatifs", "nombre_votants", "non_votants", "a.*")
    rows = rows.withColumns({"_named": F.col("organe_uid").isNotNull(), "_organ": F.coalesce("organe_uid", "an_uid")})
    known = known_organs.where("an_uid <> 'PO0'").select(F.lit(True).alias("_named"), F.col("an_uid").alias("_organ"))
    rows = rows.join(known, ["_named", "_organ"], "left_anti")
    detail = F.coalesce(*[F.when(F.col("kind") == k, F.to_json(F.struct(*c))) for k, c in DETAILS.items()])
    return rows.select("kind", F.col("an_uid").alias("subject_uid"), detail.alias("detail"))


def anomalies(parsed: DataFrame, groups: DataFrame, cast: DataFrame, known_organs: DataFrame) -> DataFrame:
    """`document_anomalies`; the groups and votes of the documents are in `parsed` and not read again."""
    return document_anomalies(parsed, known_organs)


def strength(groups: DataFrame) -> DataFrame:
    return groups.groupBy("an_uid").agg(F.sum("nombre_membres").alias("effectif"))
