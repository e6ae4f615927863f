"""Dated memberships: half-open periods (start, exclusive end or null for open), their joins and clean-up."""

from __future__ import annotations

import datetime
import heapq

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .ordered import running


def far() -> Column:
    """A day after every other, for periods that are open."""
    return F.lit("9999-12-31").cast("date")


def half_open(last_day: Column) -> Column:
    """Exclusive end of a period whose source gives its last day."""
    return F.date_add(last_day, 1)


def last_day(end_exclusive: Column) -> Column:
    return F.date_sub(end_exclusive, 1)


def covers(start: Column, end_exclusive: Column, day: Column) -> Column:
    return (start <= day) & (end_exclusive.isNull() | (day < end_exclusive))


def as_of(points: DataFrame, periods: DataFrame, key: str, day: str, start: str, end: str, value: str, tie: str) -> DataFrame:
    """`points` with the `value` of the latest-starting period of the same key that covers the day, or null.

    Equal starts go to the smallest `tie`. A left join on the key with the period as residual, then one
    aggregate by point; repeated points are one row.
    """
    p, q = points.select(key, day).distinct().alias("p"), periods.alias("q")
    hit = (F.col(f"p.{key}") == F.col(f"q.{key}")) & covers(F.col(f"q.{start}"), F.col(f"q.{end}"), F.col(f"p.{day}"))
    order = F.struct(F.datediff(F.col(f"q.{start}"), F.lit("1900-01-01")).alias("late"), (-F.col(f"q.{tie}")).alias("tie"))
    return p.join(q, hit, "left").groupBy(f"p.{key}", f"p.{day}").agg(F.max_by(F.col(f"q.{value}"), order).alias(value))


def changes(periods: DataFrame, key: str, start: str, end: str, value: str, tie: str) -> DataFrame:
    """(key, day, now): from which day on which value holds, that of the latest-starting period that covers the day.

    `now` is a struct of the value, null inside where no period covers. Starts and ends of a key stream through a
    task in order of days; the state is a heap of the periods that have begun and are not known to be over.
    """
    day = lambda c: F.datediff(c, F.lit("1970-01-01")).alias("day")
    rows = periods.dropna(subset=[key, start]).select(F.col(key).alias("key"), F.col(start).alias("s"), F.col(end).alias("e"), F.col(value).alias("value"), F.col(tie).alias("tie"))
    begin = rows.select("key", day(F.col("s")), F.lit(True).alias("begins"), F.datediff("e", F.lit("1970-01-01")).alias("until"), "tie", "value")
    stop = rows.where("e IS NOT NULL").select("key", day(F.col("e")), F.lit(False).alias("begins"))
    both = begin.unionByName(stop, allowMissingColumns=True).repartition("key").sortWithinPartitions("key", "day", "begins", "tie")
    schema = both.select("key", "day", "value").schema

    def sweep(batches):
        arrow, now, at, held, top, n = None, None, None, [], None, 0

        def settle(out):
            nonlocal top
            while held and held[0][3] is not None and held[0][3] <= at:
                heapq.heappop(held)
            best = held[0] if held else None
            if best != top:
                out.append((now, at, best and best[4]))
                top = best

        def batch_of(out):
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), arrow, strict=True)], schema=arrow)

        for batch in batches:
            arrow = arrow or pa.schema([batch.schema.field(c) for c in ("key", "day", "value")])
            out = []
            for key_, day_, begins, until, tie_, value_ in zip(*(batch.column(c).to_pylist() for c in ("key", "day", "begins", "until", "tie", "value")), strict=True):
                if (key_, day_) != (now, at) and now is not None:
                    settle(out)
                if key_ != now:
                    held, top = [], None
                now, at = key_, day_
                if begins and (until is None or until > day_):
                    n += 1
                    heapq.heappush(held, (-day_, tie_, n, until, value_))
            if out:
                yield batch_of(out)
        if now is not None:
            out = []
            settle(out)
            if out:
                yield batch_of(out)

    swept = both.mapInArrow(sweep, schema)
    return swept.select(F.col("key").alias(key), F.date_add(F.lit("1970-01-01").cast("date"), F.col("day")).alias("day"), F.struct(F.col("value").alias("value")).alias("now"))


def as_of_sorted(points: DataFrame, periods: DataFrame, key: str, day: str, start: str, end: str, value: str, tie: str) -> DataFrame:
    """What `as_of` gives, without a join of points and periods: both in one sorted stream, the last value carried along.

    Work follows the number of points and periods, also for a key with very many of both, which is spread over
    partitions. Points without key or day have no value.
    """
    p = points.select(F.col(key).alias("_key"), F.col(day).alias("_day")).distinct().withColumn("_kind", F.lit(1))
    c = changes(periods, key, start, end, value, tie).select(F.col(key).alias("_key"), F.col("day").alias("_day"), F.lit(0).alias("_kind"), "now")
    carried = running(p.unionByName(c, allowMissingColumns=True), ["_key"], ["_day", "_kind"], _now=("last", F.col("now"))).where("_kind = 1")
    held = F.when(F.col("_key").isNotNull() & F.col("_day").isNotNull(), F.col("_now.value"))
    return carried.select(F.col("_key").alias(key), F.col("_day").alias(day), held.alias(value))


def groups_from_memberships(votes: DataFrame, memberships: DataFrame) -> DataFrame:
    """`votes` with the group of those whose file names none filled by the membership of the day.

    Votes have (person_id, date_scrutin, organe_id, fantome), memberships (person_id, mandat_id, organe_id, debut,
    fin_exclusive). The file's group stays wherever it is no phantom. `groupe_from_mandat` is true only where a
    membership was found.
    """
    asked = votes.where("fantome")
    found = as_of_sorted(asked, memberships.withColumnRenamed("organe_id", "_groupe"), "person_id", "date_scrutin", "debut", "fin_exclusive", "_groupe", "mandat_id").where("_groupe IS NOT NULL")
    filled = votes.join(found, ["person_id", "date_scrutin"], "left")
    ghost = F.coalesce("fantome", F.lit(False))
    return filled.withColumns({"organe_id": F.when(ghost, F.col("_groupe")).otherwise(F.col("organe_id")), "groupe_from_mandat": ghost & F.col("_groupe").isNotNull()}).drop("_groupe", "fantome")


def overlapping_pairs(periods: DataFrame, keys: list[str], uid: str, start: str = "debut", end: str = "fin_exclusive") -> DataFrame:
    """Pairs of half-open periods of a key that overlap, as (keys, a, b), structs of all columns; a is the first by start and `uid`.

    A sweep over the sorted starts and ends: a running count numbers the starts and tells each end how many starts
    lie before it, so the periods that begin within one are those of consecutive numbers. Each period meets just
    these by number. The work follows the number of pairs, no key is gathered, and the join has no hot key.
    `uid` tells the periods of a key apart; those without a key or a start meet nothing.
    """
    rows = periods.dropna(subset=[*keys, start])
    begin = rows.select(*keys, F.col(uid).alias("_uid"), F.col(start).alias("_day"), F.lit(1).alias("_kind"), F.struct(*periods.columns).alias("_row"))
    open_end = F.col(end).isNull()
    stop = rows.select(*keys, F.col(uid).alias("_uid"), F.coalesce(end, far()).alias("_day"), F.when(open_end, 2).otherwise(0).alias("_kind"))
    swept = running(begin.unionByName(stop, allowMissingColumns=True), keys, ["_day", "_kind", "_uid"], _n=("sum", (F.col("_kind") == 1).cast("long")))
    starts = swept.where("_kind = 1").select(*keys, "_uid", F.col("_n").alias("_from"), F.col("_row").alias("a"))
    ends = swept.where("_kind <> 1").select(*keys, "_uid", F.col("_n").alias("_to"))
    reach = starts.join(ends, [*keys, "_uid"]).where("_to > _from")
    met = reach.select(*keys, "a", F.explode(F.sequence(F.col("_from") + 1, F.col("_to"))).alias("_from"))
    pairs = met.join(starts.select(*keys, "_from", F.col("a").alias("b")), [*keys, "_from"])
    return pairs.where(f"b.{end} IS NULL OR a.{start} < b.{end}").select(*keys, "a", "b")


def cross_overlaps(periods: DataFrame) -> DataFrame:
    """Pairs of memberships of one person in different groups that overlap, non-attached ones aside; the shorter is named.

    Takes (person_id, mandat_uid, organe_id, debut, fin_exclusive, is_non_inscrit).
    """
    days = lambda t: F.datediff(F.coalesce(F.col(f"{t}.fin_exclusive"), far()), F.col(f"{t}.debut"))
    pairs = overlapping_pairs(periods.where(~F.col("is_non_inscrit")), ["person_id"], "mandat_uid").where("a.organe_id <> b.organe_id")
    shorter = F.when(days("b") < days("a"), F.col("b.mandat_uid")).otherwise(F.col("a.mandat_uid"))
    return pairs.select("person_id", F.col("a.mandat_uid").alias("mandat_a"), F.col("b.mandat_uid").alias("mandat_b"), shorter.alias("plus_court"))


def cleaned(memberships: DataFrame) -> DataFrame:
    """The rules of `normalise` as rows, for keys of any size: (person_id, organe_id, kind, mandat_uid, debut, fin_exclusive).

    A kept membership has the kind `retenu` and its period; an event has its kind and the membership that it names.
    Memberships stream through their task in order; the state is the one period that is carried.
    """
    end = far()
    rows = memberships.select("person_id", "organe_id", "mandat_uid", "debut", F.coalesce("fin", end).alias("fin"))
    sorted_ = rows.repartition("person_id", "organe_id").sortWithinPartitions("person_id", "organe_id", "debut", "fin", "mandat_uid")
    schema = "person_id long, organe_id long, kind string, mandat_uid string, debut date, fin_exclusive date"

    def fold(batches):
        last, key, day, out = datetime.date(9999, 12, 31), None, datetime.timedelta(days=1), []
        arrow = pa.schema([("person_id", pa.int64()), ("organe_id", pa.int64()), ("kind", pa.string()), ("mandat_uid", pa.string()), ("debut", pa.date32()), ("fin_exclusive", pa.date32())])

        def keep(x):
            out.append((*key, "retenu", x[0], x[1], None if x[2] >= last else x[2] + day))

        def tell(kind, x):
            out.append((*key, kind, x[0], None, None))

        now = None
        for batch in batches:
            for person, organe, *x in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (person, organe) != key:
                    if now:
                        keep(now)
                    key, now = (person, organe), x
                elif x[1] > now[2]:
                    keep(now)
                    now = x
                elif x[2] <= now[2]:
                    tell("inclusion", x)
                elif x[1] == now[1]:
                    tell("inclusion", now)
                    now = x
                elif x[1] == now[2]:
                    tell("charniere", now)
                    keep([now[0], now[1], now[2] - day])
                    now = x
                elif x[2] - x[1] < now[2] - now[1]:
                    tell("chevauchement", x)
                else:
                    tell("chevauchement", now)
                    now = x
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), arrow, strict=True)], schema=arrow)
                out.clear()
        if now:
            keep(now)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), arrow, strict=True)], schema=arrow)

    return sorted_.mapInArrow(fold, schema)


def normalise(memberships: DataFrame) -> DataFrame:
    """Memberships of each (person, group) made disjoint: (person_id, organe_id, retained, events).

    Takes (person_id, organe_id, mandat_uid, debut, fin) with the last day in `fin`, null for open. In order
    of start, then of last day, each period meets the one carried so far. Disjoint ones are both kept; one
    inside the carried one is dropped (`inclusion`), and so is the carried one if a longer one starts with
    it; one that starts on the carried one's last day shortens that by a day (`charniere`); of two that
    overlap otherwise the shorter goes, the earlier one if they are equal (`chevauchement`). The carried
    period changes while the fold runs, so it is an ordered fold over the few memberships of one person in
    one group, inside the row; nothing leaves the JVM.
    """
    end = far()
    member = F.struct(F.col("debut").alias("debut"), F.coalesce("fin", end).alias("fin"), F.col("mandat_uid").alias("uid"))
    kept_type = "array<struct<uid:string,debut:date,fin:date>>"
    event_type = "array<struct<kind:string,uid:string>>"
    start = F.struct(F.array().cast(kept_type).alias("kept"), F.array().cast(event_type).alias("events"))

    def entry(x, fin=None):
        return F.struct(x["uid"].alias("uid"), x["debut"].alias("debut"), (x["fin"] if fin is None else fin).alias("fin"))

    def fold(acc, x):
        kept, events = acc["kept"], acc["events"]
        n = F.size(kept)
        last = F.get(kept, n - 1)
        front = F.slice(kept, 1, F.greatest(n - 1, F.lit(0)))
        told = lambda kind, uid: F.array_append(events, F.struct(F.lit(kind).alias("kind"), uid.alias("uid")))
        state = lambda k, e: F.struct(k.cast(kept_type).alias("kept"), e.cast(event_type).alias("events"))
        length = lambda y: F.datediff(y["fin"], y["debut"])
        hinge = state(F.concat(front, F.array(entry(last, F.date_sub(last["fin"], 1)), entry(x))), told("charniere", last["uid"]))
        swap = lambda kind: state(F.array_append(front, entry(x)), told(kind, last["uid"]))
        return (
            F.when((n == 0) | (x["debut"] > last["fin"]), state(F.array_append(kept, entry(x)), events))
            .when(x["fin"] <= last["fin"], state(kept, told("inclusion", x["uid"])))
            .when(x["debut"] == last["debut"], swap("inclusion"))
            .when(x["debut"] == last["fin"], hinge)
            .when(length(x) < length(last), state(kept, told("chevauchement", x["uid"])))
            .otherwise(swap("chevauchement"))
        )

    grouped = memberships.groupBy("person_id", "organe_id").agg(F.array_sort(F.collect_list(member)).alias("m"))
    folded = grouped.withColumn("f", F.aggregate("m", start, fold))
    open_end = lambda y: F.when(y["fin"] < end, y["fin"])
    retained = F.transform("f.kept", lambda y: F.struct(y["uid"].alias("mandat_uid"), y["debut"].alias("debut"), F.date_add(open_end(y), 1).alias("fin_exclusive")))
    return folded.select("person_id", "organe_id", retained.alias("retained"), F.col("f.events").alias("events"))
