"""Tables in buckets of the client: no exchange of their rows, hot clients apart."""

import re

import pytest
from conftest import SF0001
from pyspark.sql import functions as F

from salescope.operators import clients as CL
from salescope.operators import collated as CO
from salescope.sources import bucketed as BK
from salescope.sources import tables as TB

SF = SF0001.replace("0.001", "0.01")


@pytest.fixture(scope="module")
def tables(spark):
    s = TB.sales(spark, SF)
    h = F.pmod(F.xxhash64("id"), F.lit(60))
    hot = F.when(h < 20, F.lit("7")).when(h == 20, F.lit(None)).otherwise(F.col("client_id"))
    name = F.when(h < 20, F.lit("Customer 7")).otherwise(F.col("client_name"))
    return {"sales": (s.withColumn("client_name", name).withColumn("client_id", hot), "client_id"),
            "clients": (TB.clients(spark, SF), "id"), "leads": (TB.leads(spark, SF), "client_id"),
            "events": (TB.funnel_events(spark, SF), "client_id")}


@pytest.fixture(scope="module")
def store(spark, tables):
    out = BK.write_buckets(spark, tables, 8)
    yield out
    out.drop()


def _plan(spark, df):
    """Operators of the plan as (depth, text), root first."""
    text = df._jdf.queryExecution().executedPlan().toString()
    return [(len(m[1]), m[2]) for line in text.splitlines() if (m := re.match(r"([ :+\-|*]*(?:\(\d+\) )?)(\w.*)", line))]


def _first_above_scan(rows, table):
    """The first exchange, aggregate, window or join over the scan of a table."""
    found = []
    for at, (depth, text) in enumerate(rows):
        if re.match(r"(FileScan|Scan)", text) and table in text:
            for above, what in reversed(rows[:at]):
                if above < depth:
                    depth = above
                    if re.match(r"(Exchange|HashAggregate|Window\b|WindowGroupLimit|SortMergeJoin)", what):
                        found.append(what)
                        break
    return found


def test_results_equal_those_over_the_plain_tables(tables, store):
    assert store.hot_ids == ["7"]
    for op, names in ((CL.all_clients_stats, ("sales", "clients")), (CL.last_sales_per_client, ("sales",)),
                      (CL.customer_360, ("sales", "clients", "leads", "events"))):
        got, want = store.run(op, *names), op(*[tables[n][0] for n in names])
        assert got.columns == want.columns
        assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))


def test_no_rows_of_sales_are_exchanged(spark, store):
    kept = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        u = store.usual
        for df in (CL.all_clients_stats(u["sales"], u["clients"]), CL.last_sales_per_client(u["sales"]),
                   CL.client_profile_stats(u["sales"]), CL.last_events_per_client(u["events"])):
            assert "Exchange" not in df._jdf.queryExecution().executedPlan().toString()
        rows = _plan(spark, CL.customer_360(u["sales"], u["clients"], u["leads"], u["events"]))
        first = _first_above_scan(rows, "price")
        assert first and not any(x.startswith("Exchange") for x in first)
        plain = CL.all_clients_stats(store.hot["sales"], store.hot["clients"])
        assert "Exchange" in plain._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", kept)


def test_a_hot_client_fills_no_bucket(spark, tables, store):
    per_bucket = [r["count"] for r in store.usual["sales"].groupBy(F.input_file_name()).count().collect()]
    total = tables["sales"][0].count()
    assert sum(per_bucket) + store.hot["sales"].count() == total
    assert len(per_bucket) == 8 and max(per_bucket) < total / 8 * 1.5
    assert store.usual["sales"].filter("client_id is null or client_id = '7'").isEmpty()


def test_empty_tables_and_dropping(spark, tables):
    empty = {n: (df.limit(0), key) for n, (df, key) in tables.items()}
    store = BK.write_buckets(spark, empty, 4)
    assert store.hot_ids == [] and store.run(CL.all_clients_stats, "sales", "clients").count() == 0
    names = [t for t, _, _ in store._names.values()]
    store.drop()
    assert not any(spark.catalog.tableExists(t) for t in names)


def test_spellings_fall_together_by_collation(spark):
    rows = [("1", "Café Zürich"), ("2", "CAFÉ ZÜRICH"), ("3", "Ｃafé zürich"), ("4", " café zürich "),
            ("5", "Cafe Zurich"), ("6", None), ("7", ""), ("8", "  "), ("9", "абв"), ("10", "АБВ")]
    c = spark.createDataFrame(rows, "id string, name string")
    flags = {r.id: r.same_name_as for r in CO.name_flags(c).collect()}
    assert flags == {"1": "1", "2": "1", "3": "1", "4": "1", "5": "5", "6": "6", "7": "7", "8": "8", "9": "10", "10": "10"}
    got = {(r.first_id, r.n_clients, r.n_spellings) for r in CO.same_names(c).collect()}
    assert got == {("1", 4, 4), ("10", 2, 2)}
    by_case = {r.id: r.same_name_as for r in CO.name_flags(c, "UTF8_LCASE").collect()}
    assert by_case["4"] == "1" and by_case["3"] == "3" and by_case["9"] == "10"
    sales = spark.createDataFrame([(1, "CAFÉ ZÜRICH"), (2, "cafe zurich"), (3, "nobody"), (4, None)], "id long, client_name string")
    assert {r.id: r.resolved_id for r in CO.resolve_names(sales, c).collect()} == {1: "1", 2: "5", 3: None, 4: None}
    order = [r.id for r in c.filter("id in ('1', '5', '9')").unionByName(spark.createDataFrame([("11", "cab")], "id string, name string"))
             .orderBy(*CO.in_directory_order(c)).collect()]
    assert order == ["11", "5", "1", "9"]
    assert CO.same_names(c.limit(0)).count() == 0
