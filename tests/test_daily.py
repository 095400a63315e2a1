"""The daily store with client bitmaps against plain grouping."""

import datetime as dt
import random
from decimal import Decimal

import pytest
from conftest import SALES_SCHEMA
from pyspark.sql import functions as F

from salescope.operators import daily as DY
from salescope.operators import evolution as EV
from salescope.operators.filters import Filters
from salescope.operators.numbering import dense_numbers, ranked
from salescope.plans import periods as P


@pytest.fixture(scope="module")
def sales(spark):
    """One client with a third of the sales, sales without id, name or date, two bitmap ranges."""
    rng = random.Random(2)
    rows = []
    for i in range(40_000):
        client = "hot" if i % 3 == 0 else f"C{i}"
        day = dt.date(2023, 11, 20) + dt.timedelta(days=rng.randrange(60))
        rows.append((str(i), client, None if i % 50 == 1 else client, f"P{i % 4}", Decimal(i % 100), day))
    rows += [("x", None, None, "P1", Decimal(5), dt.date(2023, 12, 1)), ("y", "C1", "C1", "P1", Decimal(5), None)]
    return spark.createDataFrame(rows, SALES_SCHEMA)


def _plain(sales, unit):
    key = F.coalesce("client_id", "client_name")
    return sorted((str(r.s), r.t, r.n, r.u) for r in sales.groupBy(F.date_trunc(unit, "date").cast("date").alias("s")).agg(
        F.sum("price").cast("double").alias("t"), F.count(F.lit(1)).alias("n"), F.count_distinct(key).alias("u")).collect())


@pytest.fixture(scope="module")
def store(sales, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("daily"))
    DY.build_daily(sales, path)
    return DY.read_daily(sales.sparkSession, path)


def test_buckets_equal_plain_grouping(sales, store):
    assert store.bits.select("range").distinct().count() == 1
    for unit in ("month", "quarter", "year"):
        got = sorted((r.total, r.transactions, r.unique_clients) for r in DY.daily_evolution(store, unit).collect())
        assert got == sorted(x[1:] for x in _plain(sales, unit))


def test_numbers_have_no_gap(spark):
    keys = spark.range(40_000).select(F.concat(F.lit("k"), (F.col("id") % 33_000).cast("string")).alias("k"))
    keys = keys.unionByName(spark.createDataFrame([(None,)], "k string"))
    got = sorted(r.number for r in dense_numbers(keys, "k", after=7, part_rows=1000).collect())
    assert got == list(range(8, 33_008))
    assert dense_numbers(keys.limit(0), "k").count() == 0


def test_ranked_rows_follow_the_order(spark):
    rows = spark.range(5000).select((F.col("id") * 7919 % 97).alias("a"), F.col("id").alias("b"), F.when(F.col("id") % 2 == 0, 1).alias("c"))
    got = [(r.a, r.b) for r in sorted(ranked(rows, ["a", "b"], "n").collect(), key=lambda r: r.n)]
    assert got == sorted(got) and len(set(got)) == 5000
    assert sorted(r.n for r in ranked(rows, ["c"], "n").collect()) == list(range(1, 5001))


def test_several_ranges_of_clients(spark):
    s = spark.range(70_000).select(
        F.col("id").cast("string").alias("id"), F.lit("n").alias("client_name"), F.col("id").cast("string").alias("client_id"),
        F.lit("p").alias("product_type"), F.lit(1).cast("decimal(18,2)").alias("price"),
        F.date_add(F.lit("2024-01-01").cast("date"), (F.col("id") % 5).cast("int")).alias("date"))
    store = DY.build_daily(s)
    assert store.bits.select("range").distinct().count() == 3
    assert DY.daily_unique_clients(store).first()[0] == 70_000
    assert DY.daily_unique_clients(store, Filters("2024-01-02", "2024-01-03")).first()[0] == 28_000


def test_periods_and_regrouping(spark, sales, store):
    got = DY.daily_period_metrics(store, P.named_periods(spark, "2024-01-10"), "period").collect()
    want = P.sales_by_period(spark, sales, "2024-01-10").collect()
    assert sorted(map(str, got)) == sorted(map(str, want))
    a, b = Filters("2023-12-01", "2023-12-20", product_type="P1"), Filters("2023-12-10", "2024-01-05")
    want = EV.evolution_points(sales, a, b, "week").collect()
    assert EV.regroup_comparison(DY.stored_daily_ab(store, a, b), "day", "week", a, b).collect() == want


def test_appended_days_keep_numbers(spark, sales, tmp_path):
    half = F.col("date") < F.lit("2023-12-10").cast("date")
    DY.build_daily(sales.filter(half), str(tmp_path))
    before = {r.client_key: r.number for r in DY.read_daily(spark, str(tmp_path)).clients.collect()}
    store = DY.append_daily(DY.read_daily(spark, str(tmp_path)), sales.filter(~F.coalesce(half, F.lit(False))), str(tmp_path))
    after = {r.client_key: r.number for r in store.clients.collect()}
    assert before.items() <= after.items() and sorted(after.values()) == list(range(1, len(after) + 1))
    got = sorted((r.total, r.transactions, r.unique_clients) for r in DY.daily_evolution(store, "month").collect())
    assert got == sorted(x[1:] for x in _plain(sales, "month"))


def test_dates_reach_the_scan_and_facts_are_not_read(store):
    plan = DY.daily_unique_clients(store, Filters("2023-12-01", "2023-12-02"))._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(date,2023-12-01)" in plan and "bits" in plan and "days" not in plan


def test_empty_sales(spark):
    store = DY.build_daily(spark.createDataFrame([], SALES_SCHEMA))
    assert DY.daily_evolution(store, "week").count() == 0
    assert DY.daily_unique_clients(store).first()[0] == 0
    with pytest.raises(ValueError):
        DY.daily_unique_clients(store, Filters(None, None, "A"))
