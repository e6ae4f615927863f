"""Hand-written TOML seeds: candidates, themes, axis anchors. Small files, checked strictly, given as frames."""

from __future__ import annotations

import hashlib
import tomllib
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

CANDIDATE = {"an_uid", "wikidata_qid", "prenom", "nom", "statut", "source_url", "source_date", "note"}
THEME = {"slug", "axe_gauche_droite", "libelle", "description", "pole_negatif", "pole_positif", "rang"}
GROUP = {"an_uid", "libelle", "nuance", "bloc", "note"}


class BadSeed(ValueError):
    """A seed file that breaks a rule."""


def _rows(path: str, table: str, allowed: set[str], needed: set[str]) -> list[dict]:
    rows = tomllib.loads(Path(path).read_text(encoding="utf-8")).get(table, [])
    for i, row in enumerate(rows):
        if extra := set(row) - allowed:
            raise BadSeed(f"{table}[{i}]: unknown keys {sorted(extra)}")
        if lacking := {k for k in needed if row.get(k) in (None, "")}:
            raise BadSeed(f"{table}[{i}]: missing {sorted(lacking)}")
    return rows


def candidates(spark: SparkSession, path: str, allow_empty: bool = False) -> DataFrame:
    """Candidates named by an_uid, or by wikidata_qid with first and last name; sources are mandatory, no one twice."""
    rows = _rows(path, "candidat", CANDIDATE, {"statut", "source_url", "source_date"})
    if not rows and not allow_empty:
        raise BadSeed("no candidates; an empty file must be asked for")
    seen = set()
    for row in rows:
        if bool(row.get("an_uid")) == bool(row.get("wikidata_qid")):
            raise BadSeed("a candidate has either an_uid or wikidata_qid")
        if row.get("wikidata_qid") and not (row.get("prenom") and row.get("nom")):
            raise BadSeed("a candidate by wikidata_qid needs prenom and nom")
        key = row.get("an_uid") or row["wikidata_qid"]
        if key in seen:
            raise BadSeed(f"{key} appears twice")
        seen.add(key)
    cells = [tuple(str(row[k]) if row.get(k) is not None else None for k in sorted(CANDIDATE)) for row in rows]
    return spark.createDataFrame(cells, ", ".join(f"{k} string" for k in sorted(CANDIDATE)))


def themes(spark: SparkSession, path: str) -> DataFrame:
    """Themes with both poles or none, slugs and ranks unique; an axis needs poles."""
    rows = _rows(path, "theme", THEME, {"slug", "libelle", "description", "rang"})
    for what in ("slug", "rang"):
        values = [row[what] for row in rows]
        if len(set(values)) < len(values):
            raise BadSeed(f"{what} appears twice")
    for row in rows:
        if bool(row.get("pole_negatif")) != bool(row.get("pole_positif")):
            raise BadSeed(f"{row['slug']}: one pole only")
        if row.get("axe_gauche_droite") and not row.get("pole_positif"):
            raise BadSeed(f"{row['slug']}: an axis without poles")
    cells = [(r["slug"], r["libelle"], r["description"], r.get("pole_negatif"), r.get("pole_positif"), int(r["rang"]), bool(r.get("axe_gauche_droite", False))) for r in rows]
    return spark.createDataFrame(cells, "slug string, libelle string, description string, libelle_pole_negatif string, libelle_pole_positif string, rang int, axe_gauche_droite boolean")


def axis(spark: SparkSession, path: str) -> tuple[dict, DataFrame]:
    """Header of an axis version with its content hash, and (an_uid, coordonnee) of its groups."""
    raw = Path(path).read_bytes()
    data = tomllib.loads(raw.decode())
    blocs = data.get("bloc", {})
    if any(not -1 <= float(x) <= 1 for x in blocs.values()):
        raise BadSeed("a coordinate outside [-1, 1]")
    groups = _rows(path, "groupe", GROUP, {"an_uid", "bloc"})
    if unknown := {g["bloc"] for g in groups} - set(blocs):
        raise BadSeed(f"unknown blocs {sorted(unknown)}")
    if len({g["an_uid"] for g in groups}) < len(groups):
        raise BadSeed("a group appears twice")
    header = {k: str(data[k]) for k in ("version", "description", "source_url") if k in data} | {"content_hash": hashlib.sha256(raw).hexdigest()}
    return header, spark.createDataFrame([(g["an_uid"], float(blocs[g["bloc"]])) for g in groups], "an_uid string, coordonnee double")


def check_version(stored: dict[str, str], header: dict) -> None:
    """An axis version never changes: the same version with another hash is refused."""
    known = stored.get(header["version"])
    if known is not None and known != header["content_hash"]:
        raise BadSeed(f"version {header['version']} was loaded with other content")
