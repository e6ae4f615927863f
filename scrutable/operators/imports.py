"""Label imports: validation, planning and application, as frames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.text import exact_three_decimals

MAX_PROBLEMS, JUSTIFICATION_MIN = 50, 10


def number_problem(name: str, text: Column, low: float, high: float, open_low: bool = False) -> Column:
    wide, exact = text.try_cast("decimal(38,30)"), exact_three_decimals(text)
    inside = (exact > low if open_low else exact >= low) & (exact <= high)
    return F.when(wide.isNull(), f"{name}_invalide").when(exact.isNull(), f"{name}_decimales").when(~inside, f"{name}_hors_bornes")


def row_problems(rows: DataFrame, themes: DataFrame, rollcalls: DataFrame) -> DataFrame:
    """(source, scrutin_uid, theme, problem) of every problem of every row.

    Rows have (source, scrutin_uid, theme, poids, position_pour, confiance, justification) as text. Numbers and
    justification are only checked for known themes.
    """
    order = Window.partitionBy("scrutin_uid", "theme").orderBy("source")
    known = themes.select(F.col("slug").alias("theme"), F.col("libelle_pole_positif").isNotNull().alias("axis"), F.col("actif"))
    uids = rollcalls.select("scrutin_uid", F.lit(True).alias("found")).distinct()
    seen = rows.withColumn("_n", F.row_number().over(order)).join(known, "theme", "left").join(uids, "scrutin_uid", "left")
    is_known = F.col("axis").isNotNull()
    position = F.when(~F.col("axis") & F.col("position_pour").isNotNull(), "position_sans_axe").when(F.col("axis") & F.col("position_pour").isNull(), "position_absente").when(F.col("axis"), number_problem("position", F.col("position_pour"), -1, 1))
    problems = F.array(
        F.when(F.col("_n") > 1, "doublon"),
        F.when(~is_known, "theme_inconnu").when(~F.col("actif"), "theme_inactif"),
        F.when(is_known, number_problem("poids", F.col("poids"), 0, 1, open_low=True)),
        F.when(is_known, number_problem("confiance", F.col("confiance"), 0, 1)),
        F.when(is_known, position),
        F.when(is_known & (F.length(F.trim("justification")) < JUSTIFICATION_MIN), "justification_courte"),
        F.when(F.col("found").isNull(), "scrutin_inconnu"),
    )
    return seen.select("source", "scrutin_uid", "theme", F.explode(F.filter(problems, lambda p: p.isNotNull())).alias("problem"))


def weight_problems(rows: DataFrame) -> DataFrame:
    """Roll-calls whose weights do not sum to exactly 1; asked only of rows that are valid one by one."""
    total = F.sum(F.col("poids").try_cast("decimal(38,3)"))
    return rows.groupBy("scrutin_uid").agg(total.alias("somme")).where(~F.col("somme").eqNullSafe(F.lit(1).cast("decimal(38,3)")))


def snapshot(*columns: str) -> Column:
    """A roll-call's labels in order of theme, compared as text."""
    return F.array_sort(F.collect_list(F.struct(*columns)))


FIELDS = ("theme", "poids", "position_pour", "confiance", "justification")


def plan(rows: DataFrame, existing: DataFrame) -> DataFrame:
    """(scrutin_uid, classement, avant, apres): conflict, creation, modification or inchange, in that order of display.

    `existing` has the same fields as text plus `method` and `reviewed`. Roll-calls absent from the file are
    not in the plan and stay as they are.
    """
    after = rows.groupBy("scrutin_uid").agg(snapshot(*FIELDS).alias("apres"))
    before = existing.groupBy("scrutin_uid").agg(snapshot(*FIELDS).alias("avant"), F.max((F.col("method") == "manual") | F.col("reviewed")).alias("guarded"))
    both = after.join(before, "scrutin_uid", "left")
    kind = F.when(F.col("avant").eqNullSafe(F.col("apres")), "inchange").when(F.col("avant").isNull(), "creation").when(F.col("guarded"), "conflit").otherwise("modification")
    empty = F.array().cast(after.schema["apres"].dataType)
    return both.select("scrutin_uid", kind.alias("classement"), F.coalesce("avant", empty).alias("avant"), "apres")


def display_order(planned: DataFrame) -> DataFrame:
    rank = F.when(F.col("classement") == "conflit", 0).when(F.col("classement") == "creation", 1).when(F.col("classement") == "modification", 2).otherwise(3)
    return planned.orderBy(rank, "scrutin_uid")


def build_plan(rows: DataFrame, themes: DataFrame, rollcalls: DataFrame, existing: DataFrame) -> tuple[DataFrame, int, DataFrame | None]:
    """Problems shown (at most 50), their number, and the plan if there is none: all or nothing."""
    problems = row_problems(rows, themes, rollcalls)
    total = problems.count()
    if not total:
        problems = weight_problems(rows).select(F.lit(None).cast("string").alias("source"), "scrutin_uid", F.lit(None).cast("string").alias("theme"), F.lit("somme_des_poids").alias("problem"))
        total = problems.count()
    shown = problems.orderBy("source", "scrutin_uid", "problem").limit(MAX_PROBLEMS)
    return shown, total, None if total else plan(rows, existing)


def stale(preview: DataFrame, fresh: DataFrame) -> bool:
    """Whether a plan differs from the one that was shown."""
    return not (preview.exceptAll(fresh).isEmpty() and fresh.exceptAll(preview).isEmpty())


def apply_plan(existing: DataFrame, rows: DataFrame, planned: DataFrame) -> DataFrame:
    """Labels after the import: every planned roll-call fully replaced, the others untouched."""
    touched = planned.where("classement <> 'inchange'").select("scrutin_uid")
    new = rows.join(touched, "scrutin_uid", "left_semi").select("scrutin_uid", *FIELDS, F.lit("import").alias("method"), F.lit(False).alias("reviewed"))
    return existing.join(touched, "scrutin_uid", "left_anti").select(*new.columns).unionByName(new)


def revisions(planned: DataFrame) -> DataFrame:
    """One row a roll-call that changes: its labels before and after as JSON."""
    return planned.where("classement <> 'inchange'").select("scrutin_uid", F.to_json("avant").alias("avant"), F.to_json("apres").alias("apres"))


def replace_one(existing: DataFrame, rows: DataFrame, scrutin_uid: str, author: str) -> tuple[DataFrame, DataFrame]:
    """Labels after one roll-call's were replaced by hand, and its revision: none if before equals after."""
    given = rows.where(F.col("scrutin_uid") == scrutin_uid)
    changed = plan(given, existing).where("classement <> 'inchange'")
    after = apply_plan(existing, given, changed)
    mine = (F.col("scrutin_uid") == scrutin_uid) & (F.col("method") == "import")
    by_hand = after.withColumn("method", F.when(mine, "manual").otherwise(F.col("method")))
    return by_hand, revisions(changed).withColumn("author", F.lit(author))


#: Columns of an answer line, in order.
ANSWER = ("scrutin_uid", "theme", "poids", "position_pour", "confiance", "justification")


def check_answers(answers: DataFrame, themes: DataFrame, rollcalls: DataFrame) -> DataFrame:
    """Answer lines (source, columns) with their fields and `problem`, the first rule that a line breaks, or null.

    The rules are those of an import, in this order: six columns, known roll-call, known theme, first of its
    pair, numbers, bounds, position if and only if the theme has an axis, justification.
    """
    fields = [F.get("columns", F.lit(i)).alias(c) for i, c in enumerate(ANSWER)]
    known = themes.select(F.col("slug").alias("theme"), F.col("libelle_pole_negatif").isNotNull().alias("axis"))
    rows = answers.select("source", "columns", *fields).join(known, "theme", "left").join(rollcalls.select("scrutin_uid", F.lit(True).alias("found")).distinct(), "scrutin_uid", "left")
    whole = (F.size("columns") == len(ANSWER)) & F.col("found").isNotNull() & F.col("axis").isNotNull()
    rows = rows.withColumn("_n", F.row_number().over(Window.partitionBy("scrutin_uid", "theme", whole).orderBy("source")))
    number = lambda c, low, high, **k: number_problem(c.split("_")[0], F.col(c), low, high, **k)
    given = F.coalesce(F.trim("position_pour"), F.lit("")) != ""
    problem = (
        F.when(F.size("columns") != len(ANSWER), "colonnes")
        .when(F.col("found").isNull(), "scrutin_inconnu")
        .when(F.col("axis").isNull(), "theme_inconnu")
        .when(F.col("_n") > 1, "doublon")
    )
    rest = F.coalesce(number("poids", 0, 1, open_low=True), number("confiance", 0, 1), F.when(given & ~F.col("axis"), "position_sans_axe").when(~given & F.col("axis"), "position_absente").when(given, number("position_pour", -1, 1)), F.when(F.length(F.trim("justification")) < JUSTIFICATION_MIN, "justification_courte"))
    return rows.select("source", *ANSWER, F.coalesce(problem, rest).alias("problem"))


def assemble(checked: DataFrame, rollcalls: DataFrame, version: int = 1) -> DataFrame:
    """(scrutin_uid, json) of answers that passed: one exchange document entry a roll-call with its context, numbers with three decimals."""
    three = lambda c: F.col(c).try_cast("decimal(11,3)").cast("string").alias(c)
    entry = F.struct("theme", three("poids"), three("position_pour"), three("confiance"), F.trim("justification").alias("justification"))
    by_uid = checked.where("problem IS NULL").groupBy("scrutin_uid").agg(F.array_sort(F.collect_list(entry)).alias("categorisation"))
    head = rollcalls.select("scrutin_uid", "legislature", "numero", "titre")
    return by_uid.join(head, "scrutin_uid").select("scrutin_uid", F.to_json(F.struct(F.lit(version).alias("schema_version"), "scrutin_uid", "legislature", "numero", "titre", "categorisation")).alias("json"))


def delete_labels(existing: DataFrame, scrutins: DataFrame, author: str) -> tuple[DataFrame, DataFrame]:
    """Labels without those of the roll-calls in `scrutins`, and a revision for each that had some: nothing after."""
    keys = scrutins.select("scrutin_uid").distinct()
    before = existing.join(keys, "scrutin_uid", "left_semi").groupBy("scrutin_uid").agg(F.to_json(snapshot(*FIELDS)).alias("avant"))
    return existing.join(keys, "scrutin_uid", "left_anti"), before.select("scrutin_uid", "avant", F.lit("[]").alias("apres"), F.lit(author).alias("author"))


def life_cycle(requests: DataFrame) -> DataFrame:
    """`requests` with their outcome: pending, stale, applied, rejected, decided or unknown.

    Takes (import_id, at, action, preview): a file is staged with the preview that was shown, then accepted or
    rejected; accepting brings the preview as it is by then. If that differs from the one shown last, nothing is
    applied, the new one counts as shown, and accepting it again may succeed (`stale`). The first success decides;
    later requests are refused (`decided`), and so are those for an import that was never staged (`unknown`).
    """
    order = Window.partitionBy("import_id").orderBy("at")
    until, earlier = order.rowsBetween(Window.unboundedPreceding, 0), order.rowsBetween(Window.unboundedPreceding, -1)
    staged = requests.withColumn("_known", F.max(F.col("action") == "stage").over(until))
    # what an unknown import was asked shows nothing
    shown = F.last(F.when(F.col("_known"), F.col("preview")), ignorenulls=True).over(earlier)
    same = (F.col("action") == "accept") & F.col("preview").eqNullSafe(F.col("_shown"))
    ends = F.col("_known") & ((F.col("action") == "reject") | same)
    rows = staged.withColumn("_shown", shown).withColumn("_ends", ends)
    rows = rows.withColumn("_over", F.coalesce(F.max("_ends").over(earlier), F.lit(False)))
    outcome = F.when(~F.col("_known"), "unknown").when(F.col("_over"), "decided").when(F.col("action") == "stage", "pending").when(F.col("action") == "reject", "rejected").when(F.col("_ends"), "applied").otherwise("stale")
    return rows.withColumn("outcome", outcome).drop("_known", "_shown", "_ends", "_over")
