"""String, number and display functions as column expressions."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column, functions as F


def _bases() -> tuple[str, str]:
    """Characters whose canonical decomposition starts with an ASCII letter or digit, and those letters."""
    found = {}
    for c in map(chr, range(0xC0, 0x3000)):
        base = unicodedata.normalize("NFD", c)[0]
        if base != c and base.isascii() and base.isalnum():
            found[c] = base.lower()
    return "".join(found), "".join(found.values())


_ACCENTED, _PLAIN = _bases()


def unaccent(text: Column) -> Column:
    """Lower case without accents or combining marks; ligatures stay."""
    return F.regexp_replace(F.translate(F.lower(text), _ACCENTED, _PLAIN), "\\p{M}", "")


def slugify(text: Column) -> Column:
    """Lower case, accents dropped, every other run of characters one dash; ligatures vanish."""
    return F.regexp_replace(F.regexp_replace(unaccent(text), "[^a-z0-9]+", "-"), "^-|-$", "")


def search_text(*parts: Column) -> Column:
    return unaccent(F.concat_ws(" ", *[F.coalesce(p, F.lit("")) for p in parts]))


def matches(haystack: Column, query: str) -> Column:
    """Accent- and case-insensitive substring; % and _ typed by the user stay wildcards.

    Runs between % are looked for one after the other, each at its first place after the one before, which finds
    whatever any choice of places would; LIKE itself tries the places of all runs against each other.
    """
    folded = unaccent(F.lit(query))
    if "%" not in query or "\\" in query:
        return F.like(haystack, F.concat(F.lit("%"), folded, F.lit("%")))
    runs = F.replace(F.regexp_replace(folded, "([\\p{Punct}&&[^%_]])", "\\\\$1"), F.lit("_"), F.lit("."))
    return F.rlike(haystack, F.concat(F.lit("(?s)\\A(?>.*?"), F.regexp_replace(runs, "%+", ")(?>.*?"), F.lit(")")))


#: The markers of a carrier text and of its reading.
CARRIER = "(?i)(projet de loi.*|proposition de loi.*|proposition de résolution.*|projet de loi organique.*)"
READING = "(?i)\\s*\\((première|deuxième|nouvelle|troisième|lecture définitive|texte de la commission)[^)]*\\)\\.?\\s*$"
AMENDMENT = "(?i)^(l['’]amendement|les amendements|le sous-amendement|les sous-amendements)"


def carrier_text(title: Column) -> Column:
    """The text a roll-call title is about, without its reading and final dots; the whole title if none is named."""
    found = F.regexp_extract(title, CARRIER, 1)
    raw = F.when(found == "", title).otherwise(found)
    return F.regexp_replace(F.trim(F.regexp_replace(raw, READING, "")), "\\.+$", "")


def is_amendment(title: Column) -> Column:
    return title.rlike(AMENDMENT)


def priority(type_code: Column, title: Column) -> Column:
    """1 for solemn votes and motions, 2 for whole texts, 3 for articles, else 4; both apostrophes."""
    return F.when(type_code.isin("SPS", "MOC"), 1).when(title.rlike("(?i)^l['’]ensemble"), 2).when(title.rlike("(?i)^l['’]article"), 3).otherwise(4)


def last_segment(iri: Column) -> Column:
    return F.substring_index(iri, "/", -1)


def commons_title(url: Column) -> Column:
    """File title from an image URL: last segment decoded, underscores as blanks, plus signs kept."""
    return F.concat(F.lit("File:"), F.replace(F.url_decode(F.replace(last_segment(url), F.lit("+"), F.lit("%2B"))), F.lit("_"), F.lit(" ")))


def thumbnail_url(title: Column, width: int = 400) -> Column:
    name = F.replace(F.regexp_replace(title, "^File:", ""), F.lit(" "), F.lit("_"))
    return F.concat(F.lit("https://commons.wikimedia.org/wiki/Special:FilePath/"), F.url_encode(name), F.lit(f"?width={width}"))


def three_decimals(value: Column) -> Column:
    return value.cast("decimal(4,3)").cast("string")


def exact_three_decimals(text: Column) -> Column:
    """A number of at most three decimals, or null for anything else."""
    wide = text.try_cast("decimal(38,30)")
    return F.when(wide == wide.cast("decimal(11,3)"), wide.cast("decimal(11,3)"))


def display_name(civility: Column, first: Column, last: Column, fallback: Column) -> Column:
    return F.coalesce(F.nullif(F.trim(F.concat_ws(" ", civility, first, last)), F.lit("")), fallback)


def french_date(day: Column) -> Column:
    return F.date_format(day, "dd/MM/yyyy")


def month_index(day: Column) -> Column:
    """Months counted by year and month alone."""
    return F.year(day) * 12 + F.month(day) - 1


def retry_seconds(attempts: Column) -> Column:
    """Backoff min(300, 5 * 3 ** (attempts - 1)) seconds."""
    return F.least(F.lit(300.0), F.pow(F.lit(3.0), attempts - 1) * 5).cast("long")


def cursor_percent(score: Column) -> Column:
    return (score + 1) / 2 * 100


def plural(count: Column, word: str) -> Column:
    return F.concat(count.cast("string"), F.lit(f" {word}"), F.when(count != 1, "s").otherwise(""))


def dated(subject: Column, start: Column, last: Column) -> Column:
    """Subject with its period: since a day, or from one day to another."""
    ended = F.concat(subject, F.lit(" du "), french_date(start), F.lit(" au "), french_date(last))
    return F.when(last.isNull(), F.concat(subject, F.lit(" depuis le "), french_date(start))).otherwise(ended)


def group_label(name: Column, start: Column, last: Column, unattached: Column) -> Column:
    return dated(F.when(unattached, "non-inscrit·e").otherwise(F.concat(F.lit("a siégé au groupe "), name)), start, last)


def party_label(name: Column, start: Column) -> Column:
    return F.concat(F.lit("rattaché·e au parti "), name, F.lit(" au titre du financement de la vie politique, déclaration du "), french_date(start))


def mandate_label(legislature: Column, start: Column, last: Column) -> Column:
    term = F.when(F.coalesce(legislature, F.lit(0)) != 0, F.concat(F.lit(" ("), legislature.cast("string"), F.lit("e législature)"))).otherwise("")
    return dated(F.concat(F.lit("député·e"), term), start, last)


def vote_label(position: Column, cause: Column) -> Column:
    away = "n'a pas pris part au vote"
    why = F.when(cause == "PSE", "présidait la séance").when(cause == "PAN", "présidait l'Assemblée nationale").when(cause == "MG", "membre du Gouvernement")
    absent = F.when(why.isNotNull(), F.concat(F.lit(f"{away} : "), why)).otherwise(away)
    return F.when(position == "pour", "a voté pour").when(position == "contre", "a voté contre").when(position == "abstention", "s'est abstenu·e").when(position == "non_votant", absent).otherwise(position)


def correction_label(position: Column) -> Column:
    said = "a déclaré après le scrutin avoir voulu "
    return F.when(position.isin("pour", "contre"), F.concat(F.lit(f"{said}voter "), position)).when(position == "abstention", f"{said}s'abstenir").otherwise(f"{said}ne pas prendre part au vote")


def orientation_label(score: Column, negative: Column, positive: Column) -> Column:
    number = F.concat(F.when(score < 0, "-").otherwise("+"), F.abs(score).cast("decimal(4,2)").cast("string"))
    return F.concat(F.lit("plutôt "), F.when(score >= 0, positive).otherwise(negative), F.lit(" ("), number, F.lit(")"))


def label_position(position: Column, theme: Column, negative: Column, positive: Column) -> Column:
    number = F.concat(F.when(position < 0, "-").otherwise("+"), F.abs(position).cast("decimal(3,1)").cast("string"))
    return F.concat(F.lit("plutôt : "), F.when(position >= 0, positive).otherwise(negative), F.lit(" (position "), number, F.lit(" sur l'axe "), theme, F.lit(")"))


def evidence_label(contributions: Column, reviewed: Column) -> Column:
    n = plural(contributions, "scrutin")
    none = F.concat(n, F.lit(" — aucune de ces catégorisations n'a encore été relue par un humain"))
    return F.when(reviewed == 0, none).otherwise(F.concat(n, F.lit(", dont "), plural(reviewed, "relu"), F.lit(" par un humain")))


def set_aside_label(count: Column) -> Column:
    s = F.when(count != 1, "s").otherwise("")
    return F.when(F.coalesce(count, F.lit(0)) != 0, F.concat(plural(count, "scrutin"), F.lit(" écarté"), s, F.lit(" : notre mesure automatique contredit la catégorisation")))


def insufficient_label(contributions: Column) -> Column:
    s = F.when(contributions != 1, "s").otherwise("")
    return F.when(contributions == 0, "données insuffisantes : aucun vote exploitable sur ce thème pour l'instant").otherwise(F.concat(F.lit("données insuffisantes : seulement "), plural(contributions, "scrutin"), F.lit(" exploitable"), s))


def cohesion_label(cohesion: Column) -> Column:
    return F.concat(F.lit("cohésion : "), F.bround(cohesion * 100).cast("int").cast("string"), F.lit("% des voix du groupe alignées sur sa position majoritaire (l'échelle va de 50 %, un groupe coupé en deux, à 100 %, un vote unanime)"))


def hidden_themes_label(count: Column) -> Column:
    one = "1 thème est calculé mais non publié : notre mesure de contrôle ne sait pas le valider."
    many = F.concat(count.cast("string"), F.lit(" thèmes sont calculés mais non publiés : notre mesure de contrôle ne sait pas les valider."))
    return F.when(count == 1, one).when(count > 1, many)


def method_label(method: Column, author: Column, created: Column, file: Column, reviewer: Column, reviewed: Column) -> Column:
    manual = F.concat(F.lit("catégorisé par "), author, F.lit(", le "), french_date(created))
    base = F.concat(F.lit("importé du fichier "), file, F.lit(", le "), french_date(created))
    read = F.when(reviewer.isNull() | reviewed.isNull(), F.concat(base, F.lit(" — non relu depuis"))).otherwise(F.concat(base, F.lit(", relu par "), reviewer, F.lit(" le "), french_date(reviewed)))
    return F.when(method == "manual", manual).otherwise(read)


def freshness(last_seen: Column, now: Column, threshold_s: int = 60) -> Column:
    """ok, stale or unknown by the age of the last sign of life."""
    return F.when(last_seen.isNull(), "unknown").when(F.unix_timestamp(now) - F.unix_timestamp(last_seen) <= threshold_s, "ok").otherwise("stale")
