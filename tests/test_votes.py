"""Votes derived from ballots: ties, a person with all of them, and pages without a score run."""

import os
import re

import duckdb
import pytest
from pyspark.sql import functions as F

from scrutable.functions.packed import Field, Packing, counted, dated, priced
from scrutable.plans import catalog, run_queries  # noqa: F401
from scrutable.plans.adapter import SQL, Tables
from tests.test_catalog import FOLDER, rows


def tables(spark, folder, lines, orders):
    """The ballots' tables from (orderkey, linenumber, price, day, part, flag) and (orderkey, custkey)."""
    named = spark.createDataFrame(lines, "l_orderkey long, l_linenumber int, l_extendedprice double, day string, l_partkey long, l_returnflag string")
    named.select("l_orderkey", "l_linenumber", "l_extendedprice", F.col("day").cast("timestamp_ntz").alias("l_shipdate"), "l_partkey", "l_returnflag", F.lit("O").alias("l_linestatus")).write.parquet(f"{folder}/lineitem.parquet")
    spark.createDataFrame(orders, "o_orderkey long, o_custkey long").write.parquet(f"{folder}/orders.parquet")
    return Tables(spark, str(folder))


def by_sql(folder, sql):
    con = duckdb.connect()
    for t in ("lineitem", "orders"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet/*.parquet'")
    return con.sql(sql).df()


def test_the_first_ballot_by_day_order_line_and_price(spark, tmp_path):
    lines = [(1, 2, 5.0, "2020-01-02", 2, "R"), (1, 2, 4.0, "2020-01-02", 2, "A"), (1, 3, 1.0, "2020-01-02", 2, "N"), (2, 1, 9.0, "2020-01-02", 2, "R"), (3, 9, 9.0, "2020-01-01 12:00:00", 4, "N"), (3, 1, 9.0, "2020-01-01 13:00:00", 4, "A"), (4, 1, 1.0, "2020-01-01", 1, "R"), (9, 1, 1.0, "2020-01-01", 1, "R")]
    t = tables(spark, tmp_path, lines, [(1, 7), (2, 7), (3, 8), (4, 7)])
    got = t.vote().toPandas()
    assert rows(got) == rows(by_sql(tmp_path, SQL["vote"]))
    assert {(r.person_id, r.scrutin_id): r.position for r in got.itertuples()} == {(7, 404002): "contre", (8, 404002): "non_votant", (7, 404003): "pour"}


def test_a_person_with_all_ballots_lies_in_several_files(spark, tmp_path):
    lines = [(o, n, float(n), f"{2000 + o % 20}-{1 + n % 12:02d}-01", o + n, "RAN"[(o + n) % 3]) for o in range(300) for n in range(12)]
    t = tables(spark, tmp_path, lines, [(o, 1 if o % 30 else o) for o in range(300)])
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        votes = t.vote()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert rows(votes.toPandas()) == rows(by_sql(tmp_path, SQL["vote"]))
    files = votes.where("person_id = 1").groupBy(F.input_file_name().alias("f")).agg(F.min("scrutin_id").alias("a"), F.max("scrutin_id").alias("b")).orderBy("a").collect()
    assert len(files) > 1 and all(x.b < y.a for x, y in zip(files, files[1:]))


PAGES = ("agreement_by_axis", "agreement_by_theme", "review_queue", "person_orientations", "hidden_themes", "theme_contributions", "mandate_orientations", "group_orientations", "anomaly_ledger")


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables here")
def test_pages_without_a_run_make_none_and_show_the_same(spark):
    folder = f"{FOLDER}/./."
    t = Tables(spark, folder)
    before = {name: rows(catalog.QUERIES[name](spark, folder).toPandas()) for name in PAGES}
    assert t.runs.current_id() is None and all(before.values())
    catalog.recompute(t)
    assert t.runs.current_id() == 1
    for name in PAGES:
        assert rows(catalog.QUERIES[name](spark, folder).toPandas()) == before[name], name


def seated(spark, folder):
    """Tables with persons of one seat, two, an unknown one and none, and lines that lack a number, a part or a day."""
    lines = [(o, None if o % 5 == 0 else n % 2, float(n % 3), None if o % 11 == 0 and n == 3 else f"2020-0{1 + n % 2}-0{1 + o % 3}", None if (o + n) % 7 == 0 else o + n, "RAN"[(o * n) % 3]) for o in range(60) for n in range(5)]
    t = tables(spark, folder, lines, [(o, o % 9) for o in range(60)] + [(1, 4)])
    customers = [(p, p - 3) for p in range(6)] + [(5, 8), (5, 9), (6, None)]
    spark.createDataFrame(customers, "c_custkey long, c_nationkey int").write.parquet(f"{folder}/customer.parquet")
    return t


def test_votes_carry_their_seat_and_are_counted_once_for_each(spark, tmp_path):
    t = seated(spark, tmp_path)
    con = duckdb.connect()
    for name in ("lineitem", "orders", "customer"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{tmp_path}/{name}.parquet/*.parquet'")
    nulls_first = SQL["vote"].replace("l_shipdate, l_orderkey, l_linenumber, l_extendedprice)", "l_shipdate NULLS FIRST, l_orderkey, l_linenumber NULLS FIRST, l_extendedprice NULLS FIRST, position_of)")
    rank = "CASE WHEN l_returnflag = 'R' THEN 0 WHEN l_returnflag = 'A' THEN 1 WHEN l_linestatus = 'F' THEN 2 ELSE 3 END"
    votes = con.sql(nulls_first.replace("position_of", rank)).df()
    con.register("vote", votes)
    got = t.vote().toPandas()
    assert rows(got) == rows(votes) and list(got.columns) == ["scrutin_id", "person_id", "position"]
    assert rows(t.scrutin_groupe().toPandas()) == rows(con.sql(SQL["scrutin_groupe"]).df())


def test_votes_with_a_seat_are_counted_by_group_without_being_dealt(spark, tmp_path):
    t = seated(spark, tmp_path)
    t.vote()
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = t.seated_vote()._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    known = plan[: plan.index("SortMergeJoin")]
    assert "isnotnull(organe_id" in known and "Exchange" not in known


def packing(rows):
    kind = {f.name: f.dataType for f in rows.schema}
    return Packing(dated("day", 16, kind["day"]), counted("n", 4, kind["n"]), priced("price", 26, kind["price"]), Field("mark", 4))


@pytest.mark.parametrize("day", ["date", "timestamp", "timestamp_ntz"])
def test_packed_columns_come_back_as_they_were(spark, day):
    days = ["1998-05-07", "1970-01-01", "2149-06-06", "2149-06-07", "1969-12-31", "0001-01-01", "9999-12-31", "2020-01-01 12:00:00.000001", None]
    prices = [0.0, 0.07, 12345.67, 671088.63, 671088.64, 0.1 + 0.2, 1e300, -1.0, float("nan"), float("inf"), None]
    numbers = [0, 1, 14, 15, -1, 2**31 - 1, -(2**31), None]
    cases = [(d, n, p, m) for d in days for n in numbers for p in prices for m in (0, 15)]
    given = spark.createDataFrame(cases, "day string, n int, price double, mark long").withColumn("day", F.col("day").cast(day))
    p = packing(given)
    sent = given.select("*", F.struct(*given.columns).alias("was"), *p.columns()).select("was", "packed", "odd")
    back = sent.select("was", "packed", "odd", F.struct(*p.values()).alias("now"))
    assert back.schema["now"].dataType.simpleString() == back.schema["was"].dataType.simpleString()
    assert back.where("NOT (was <=> now)").count() == 0
    assert back.where("(packed IS NULL) = (odd IS NULL)").count() == 0
    plain = F.col("was.day").isin("1998-05-07", "1970-01-01", "2149-06-06", "2020-01-01") & (F.col("was.n").isNull() | F.col("was.n").between(0, 14)) & F.col("was.price").isin(0.0, 0.07, 12345.67, 671088.63)
    assert back.where(F.coalesce(plain, F.lit(False)) != F.col("packed").isNotNull()).count() == 0


def test_lines_and_ballots_travel_as_one_long_and_their_order(spark, tmp_path):
    t = seated(spark, tmp_path)
    sent = []

    class Seen:
        def table(self, name, derive, **_):
            plan = derive()._jdf.queryExecution().optimizedPlan().toString().split("\n")
            sent.extend(plan[i + 1] for i, node in enumerate(plan) if "RepartitionByExpression" in node)
            return spark.range(0)

    t.store = Seen()
    t.marked_vote()
    assert len(sent) == 2 and all(re.search(r" AS packed#\d+L?, .* AS odd#\d+, l_orderkey#\d+L\]$", node) for node in sent)


def test_values_that_do_not_fit_are_resolved_like_the_others(spark, tmp_path):
    days = ("2020-01-01", "2020-01-01 00:00:01", "1960-01-31", "2160-01-01", "2020-01-31 23:59:59.999999")
    lines = [(o - 30, (-3, 1, 14, 15, 99)[(o + n) % 5], (0.1 + 0.2, 0.3, -5.0, 1e9, 671088.64)[(o * n) % 5] + n / 64, days[(o * 7 + n) % 5], n, "RAN"[(o + 2 * n) % 3]) for o in range(60) for n in range(8)]
    t = tables(spark, tmp_path, lines, [(o - 30, (-1, 5, 2**32 - 1, 2**32, 2**40)[o % 5]) for o in range(60)])
    spark.createDataFrame([(-1, 3), (5, 254), (2**32 - 1, 255), (2**32, -7), (2**40, 2**31 - 2)], "c_custkey long, c_nationkey int").write.parquet(f"{tmp_path}/customer.parquet")
    con = duckdb.connect()
    for name in ("lineitem", "orders", "customer"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{tmp_path}/{name}.parquet/*.parquet'")
    con.execute(f"CREATE TABLE vote AS {SQL['vote']}")
    assert rows(t.vote().toPandas()) == rows(con.sql("FROM vote").df())
    assert rows(t.scrutin_groupe().toPandas()) == rows(con.sql(SQL["scrutin_groupe"]).df())
