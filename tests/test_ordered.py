"""Running values, slugs, overlaps and folds against plain loops, with keys that fill many partitions."""

import datetime
import random
import re

import pytest
from pyspark.sql import functions as F

from scrutable.operators import intervals, naming, ordered, tables

DAY = datetime.date(2000, 1, 1)


@pytest.fixture
def many_parts(spark):
    """Small partitions that adaptive execution leaves as they are."""
    spark.conf.set("spark.sql.shuffle.partitions", "23")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_running_values(spark, many_parts):
    rng = random.Random(1)
    rows = [(None if k == 3 else k, i, rng.choice([None, rng.randint(-9, 9)])) for k in range(6) for i in range(900 if k == 2 else 40)]
    df = spark.createDataFrame(rows, "k int, i int, v int").repartition(7)
    got = ordered.running(df, ["k"], ["i"], s=("sum", F.coalesce("v", F.lit(0)).cast("long")), m=("max", F.col("v")), last=("last", F.col("v"))).collect()
    want = {}
    for k in {r[0] for r in rows}:
        s, m, last = 0, None, None
        for _, i, v in sorted((r for r in rows if r[0] == k), key=lambda r: r[1]):
            s += v or 0
            m = v if m is None else m if v is None else max(m, v)
            last = last if v is None else v
            want[k, i] = (s, m, last)
    assert len(got) == len(rows) and {(r.k, r.i): (r.s, r.m, r["last"]) for r in got} == want
    assert ordered.running(df.limit(0), ["k"], ["i"], s=("sum", F.col("v"))).count() == 0


def brute_slugs(people, taken):
    used, out, tried = set(taken), {}, {}
    for i, base in sorted(people):
        slug, n = base, tried.get(base, 2)
        while slug in used:
            slug, n = f"{base}-{n}", n + 1
        used.add(slug)
        tried[base] = n  # what was taken before stays taken
        out[i] = slug
    return out


def assigned(spark, people, taken):
    persons = spark.createDataFrame([(i, f"PA{i}", None, None, b) for i, b in people], "person_id long, an_uid string, wikidata_qid string, prenom string, nom string")
    slugs = spark.createDataFrame([(-1 - n, s, False) for n, s in enumerate(taken)], "person_id long, slug string, is_current boolean")
    return naming.assign_slugs(persons, slugs)


@pytest.mark.parametrize("seed", range(4))
def test_slugs_equal_giving_them_one_by_one(spark, seed):
    rng = random.Random(seed)
    names = ["a", "a-2", "a-3", "a-2-2", "a-2-3", "a-02", "a-1", "b", "b-4", "b-4-2", "c", "d-7", "2", "2-2"]
    people = [(i, rng.choice(names[: 3 + 3 * seed])) for i in rng.sample(range(10_000), 160)]
    taken = rng.sample(["a", "a-4", "a-2-2", "a-9", "b-2", "b-4-3", "c", "c-2", "c-4", "x-5", "2-3", "a-99999999999999999999"], 5)
    got = {r.person_id: r.slug for r in assigned(spark, people, taken).collect()}
    assert got == brute_slugs(people, taken)


def test_many_equal_names_are_spread(spark, many_parts, monkeypatch):
    sorted_rows, real = [], ordered.settled
    monkeypatch.setattr(ordered, "settled", lambda df: sorted_rows.append(real(df)) or sorted_rows[-1])
    people = [(i, "jean dupont") for i in range(30_000)] + [(40_000, "jean dupont-7"), (-5, "jean dupont-9")]
    given = assigned(spark, people, ["jean-dupont-4", "jean-dupont-20000"])
    got = {r.person_id: r.slug for r in given.collect()}
    assert got == brute_slugs([(i, b.replace(" ", "-")) for i, b in people], ["jean-dupont-4", "jean-dupont-20000"])
    largest = [max([r["count"] for r in rows.groupBy("_part").count().collect()], default=0) for rows in sorted_rows]
    assert len(largest) == 5 and max(largest) < 3000  # of 30 000 rows of one name, in 23 partitions


def brute_pairs(rows):
    out = set()
    for a in rows:
        for b in rows:
            if (a[2], a[1]) < (b[2], b[1]) and a[0] == b[0] and (a[3] is None or b[2] < a[3]) and (b[3] is None or a[2] < b[3]):
                out.add((a[0], a[1], b[1]))
    return out


def test_overlaps_equal_all_pairs(spark):
    rng = random.Random(2)
    days = lambda n: DAY + datetime.timedelta(days=n)
    rows = []
    for i in range(300):
        s = rng.randint(0, 60)
        rows.append((rng.randint(1, 5), f"m{i:03d}", days(s), None if rng.random() < 0.1 else days(s + rng.randint(-2, 9))))
    df = spark.createDataFrame([*rows, (None, "x", DAY, None), (1, "y", None, None)], "person_id long, uid string, debut date, fin_exclusive date")
    got = [(r.person_id, r.a.uid, r.b.uid) for r in intervals.overlapping_pairs(df, ["person_id"], "uid").collect()]
    assert len(got) == len(set(got)) and set(got) == brute_pairs(rows)


def test_overlaps_of_one_long_career(spark, many_parts):
    n = 100_000
    rows = spark.range(n).select(F.lit(1).cast("long").alias("person_id"), F.format_string("m%06d", "id").alias("uid"), F.date_add(F.lit(DAY), (F.col("id") * 3).cast("int")).alias("debut"))
    rows = rows.withColumn("fin_exclusive", F.date_add("debut", F.when(F.substring("uid", -3, 3) == "000", 4).otherwise(3)))
    pairs = intervals.overlapping_pairs(rows, ["person_id"], "uid")
    got = pairs.select("a.uid", F.col("b.uid").alias("v")).collect()
    assert sorted(r.uid for r in got) == [f"m{i:06d}" for i in range(0, n, 1000)] and all(int(r.v[1:]) == int(r.uid[1:]) + 1 for r in got)


def test_streamed_clean_up_equals_the_array_one(spark):
    rng = random.Random(3)
    rows = []
    for i in range(400):
        s = rng.randint(0, 80)
        rows.append((rng.randint(1, 4), rng.randint(1, 3), f"m{i:03d}", DAY + datetime.timedelta(days=s), None if rng.random() < 0.05 else DAY + datetime.timedelta(days=s + rng.randint(0, 12))))
    df = spark.createDataFrame(rows, "person_id long, organe_id long, mandat_uid string, debut date, fin date")
    got = intervals.cleaned(df).collect()
    kept, told = set(), []
    for r in intervals.normalise(df).collect():
        kept |= {(r.person_id, r.organe_id, m.mandat_uid, m.debut, m.fin_exclusive) for m in r.retained}
        told += [(r.person_id, r.organe_id, e.kind, e.uid) for e in r.events]
    assert {(r.person_id, r.organe_id, r.mandat_uid, r.debut, r.fin_exclusive) for r in got if r.kind == "retenu"} == kept
    assert sorted((r.person_id, r.organe_id, r.kind, r.mandat_uid) for r in got if r.kind != "retenu") == sorted(told)
    assert intervals.cleaned(df.limit(0)).count() == 0


def test_rows_of_a_long_track_take_the_first_free_one(spark):
    rng = random.Random(5)
    segments = [(1, "GP", f"k{i:05d}", DAY + datetime.timedelta(days=rng.randint(0, 3000)), None if i % 50 == 0 else 1) for i in range(3000)]
    segments = [(*s[:4], s[4] and s[3] + datetime.timedelta(days=rng.randint(0, 900))) for s in segments]
    df = spark.createDataFrame(segments, "person_id long, piste string, key string, debut date, fin date").repartition(5)
    placed = {r.key: r for r in naming.place(df, datetime.date(2012, 1, 1)).collect()}
    ends = []
    for s in sorted(segments, key=lambda s: (s[3], s[4] or datetime.date.max, s[2])):
        r = placed[s[2]]
        spot = next((i for i, e in enumerate(ends) if e <= r.column_start), len(ends))
        ends[spot : spot + 1] = [r.column_end]
        assert r.row == spot
    assert re.match("k", s[2])


def test_as_of_by_sorting_equals_the_join(spark, many_parts):
    rng = random.Random(7)
    day = lambda n: DAY + datetime.timedelta(days=n)
    periods, points = [], []
    for i in range(500):
        s = rng.randint(0, 200)
        periods.append((rng.choice([1, 1, 1, 2, 3]), i, rng.choice([10, 20, None]), day(s), None if rng.random() < 0.05 else day(s + rng.randint(-1, 25))))
    points = [(rng.choice([1, 1, 2, 3, 4]), day(rng.randint(-5, 240))) for _ in range(900)]
    q = spark.createDataFrame(periods, "person_id long, mandat_id long, organe_id long, debut date, fin_exclusive date").repartition(5)
    p = spark.createDataFrame(points, "person_id long, d date")
    args = ("person_id", "d", "debut", "fin_exclusive", "organe_id", "mandat_id")
    got = [tuple(r) for r in intervals.as_of_sorted(p, q, *args).collect()]
    want = {}
    for person, d in set(points):
        covering = [(s, -i, o) for k, i, o, s, e in periods if k == person and s <= d and (e is None or d < e)]
        want[person, d] = max(covering, key=lambda x: x[:2])[2] if covering else None
    assert len(got) == len(want) and {g[:2]: g[2] for g in got} == want
    odd = spark.createDataFrame([(None, DAY), (1, None)], "person_id long, d date")
    assert sorted(map(str, (tuple(r) for r in intervals.as_of_sorted(odd, q, *args).collect()))) == sorted(map(str, [(None, DAY, None), (1, None, None)]))


def test_phantom_groups_are_filled_only_where_a_membership_is_found(spark):
    votes = spark.createDataFrame([(1, DAY, 5, False), (1, DAY, None, True), (2, DAY, 7, True), (None, DAY, 3, True), (1, DAY, 9, None)], "person_id long, date_scrutin date, organe_id long, fantome boolean")
    seats = spark.createDataFrame([(1, 1, 44, DAY, None)], "person_id long, mandat_id long, organe_id long, debut date, fin_exclusive date")
    got = intervals.groups_from_memberships(votes, seats).collect()
    assert sorted(((r.person_id, r.organe_id, r.groupe_from_mandat) for r in got), key=str) == sorted([(1, 5, False), (1, 44, True), (2, None, False), (None, None, False), (1, 9, False)], key=str)


def test_totals_follow_what_came_and_went(spark):
    rng = random.Random(9)
    votes = [(rng.randint(1, 30), DAY + datetime.timedelta(days=rng.randint(0, 40)), rng.choice(["old", "old", "new", "gone"])) for _ in range(400)]
    df = spark.createDataFrame(votes, "person_id long, date_scrutin date, what string")
    asked = []

    def now(persons):
        asked.append(persons.count())
        return df.where("what <> 'gone'").join(persons, "person_id", "left_semi")

    got = tables.totals_after(tables.totals(df.where("what <> 'new'")), df.where("what = 'new'"), df.where("what = 'gone'"), now)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, tables.totals(df.where("what <> 'gone'")).collect())) and 0 < asked[0] < 30
