import datetime as dt
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from conftest import SALES_SCHEMA, rows
from salescope.functions.buckets import GROUPINGS
from salescope.operators import compare as C
from salescope.operators import evolution as EV
from salescope.operators import sales as S
from salescope.operators.filters import Filters
from salescope.plans import periods as P
from salescope.plans import snapshot as SN


def test_sales_summary_seed(seed):
    r = rows(S.sales_summary(seed["sales"]))
    assert [x["product_type"] for x in r] == ["Producto", "Servicio"]
    assert r[0]["total_sales"] == 5000.0 and r[0]["quantity"] == 2 and r[0]["avg_price"] == 2500.0
    assert r[1]["min_price"] == 500.0 and r[1]["max_price"] == 1500.0


def test_unique_clients_and_period_metrics(seed):
    assert S.unique_clients(seed["sales"]).first().unique_clients == 3
    m = S.period_metrics(seed["sales"], Filters("2024-05-01", "2024-05-31")).first()
    assert (m.total_sales, m.transactions, m.unique_clients, m.total_quantity) == (7500.0, 4, 3, 4)
    assert m.avg_ticket == 7500.0 / 4


def test_empty_period_metrics_are_zero(seed):
    m = S.period_metrics(seed["sales"], Filters("2030-01-01", "2030-01-31")).first()
    assert (m.total_sales, m.transactions, m.avg_ticket, m.unique_clients) == (0.0, 0, 0.0, 0)


def test_invariants_totals(seed):
    s = seed["sales"]
    total = S.period_metrics(s).first().total_sales
    assert sum(x["total_sales"] for x in rows(S.sales_summary(s))) == total
    for g in GROUPINGS:
        assert sum(x["total"] for x in rows(EV.sales_evolution(s, None, g))) == total
    pd_ = rows(S.product_distribution(s))
    assert abs(sum(x["percentage"] for x in pd_) - 100.0) < 1e-9
    assert [x["color_index"] for x in pd_] == [0, 1]


def test_summary_with_total_row_last(seed):
    r = rows(S.summary_with_total(seed["sales"], sort_by="product_type", ascending=True))
    assert [x["product_type"] for x in r] == ["Producto", "Servicio", "TOTAL"]
    assert r[-1]["total_sales"] == 8000.0


def test_top_clients_ranks_and_ties(spark):
    s = spark.createDataFrame([
        ("1", "A", "C1", "P", Decimal("100"), dt.date(2024, 1, 1)),
        ("2", "B", "C2", "P", Decimal("100"), dt.date(2024, 1, 5)),
        ("3", "C", "C3", "P", Decimal("300"), dt.date(2024, 1, 2)),
    ], SALES_SCHEMA)
    r = rows(S.top_clients(s, n=5))
    assert [x["client_id"] for x in r] == ["C3", "C2", "C1"]
    assert [x["rank"] for x in r] == [1, 2, 3]
    assert r[0]["percentage_of_total"] == 60.0


def test_compare_evolution_pinned_months(spark):
    """A Jan 100, Feb 200; B Feb 50, Mar 75 -> Jan 100/0, Feb 200/50, Mar 0/75."""
    s = spark.createDataFrame([
        ("1", "X", "C1", "P", Decimal("100"), dt.date(2024, 1, 10)), ("2", "X", "C1", "P", Decimal("200"), dt.date(2024, 2, 10)),
        ("3", "X", "C1", "Q", Decimal("50"), dt.date(2024, 2, 10)), ("4", "X", "C1", "Q", Decimal("75"), dt.date(2024, 3, 10)),
    ], SALES_SCHEMA)
    year = ("2024-01-01", "2024-12-31")
    r = rows(EV.compare_evolution(s, Filters(*year, product_type="P"), Filters(*year, product_type="Q"), "month"))
    assert [(x["label"], x["value_a"], x["value_b"]) for x in r] == [
        ("Jan 24", 100.0, 0.0), ("Feb 24", 200.0, 50.0), ("Mar 24", 0.0, 75.0)]


def test_compare_evolution_months(spark):
    """Sides in different years keep their own months."""
    s = spark.createDataFrame([
        ("1", "X", "C1", "P", Decimal("100"), dt.date(2024, 1, 10)),
        ("2", "X", "C1", "P", Decimal("200"), dt.date(2024, 2, 10)),
        ("3", "X", "C1", "P", Decimal("50"), dt.date(2025, 2, 10)),
        ("4", "X", "C1", "P", Decimal("75"), dt.date(2025, 3, 10)),
    ], SALES_SCHEMA)
    # B shifted one year so both sides use their own rows; compare on month-of-year keys
    fa, fb = Filters("2024-01-01", "2024-03-31"), Filters("2025-01-01", "2025-03-31")
    r = rows(EV.compare_evolution(s, fa, fb, "month"))
    assert [(x["key"], x["label"], x["value_a"], x["value_b"]) for x in r] == [
        ("2024-01", "Jan 24", 100.0, 0.0), ("2024-02", "Feb 24", 200.0, 0.0),
        ("2025-02", "Feb 25", 0.0, 50.0), ("2025-03", "Mar 25", 0.0, 75.0)]


def test_evolution_points_and_regroup(seed):
    fa, fb = Filters("2024-04-01", "2024-04-30"), Filters("2024-05-01", "2024-05-31")
    pts = EV.evolution_points(seed["sales"], fa, fb, "month")
    r = rows(pts)
    assert [(x["key"], x["value_a"], x["value_b"], x["difference"]) for x in r] == [
        ("2024-04", 500.0, 0.0, -500.0), ("2024-05", 0.0, 7500.0, 7500.0)]
    # May ends after midnight of 2024-05-31 -> partial (literal reference rule)
    assert r[1]["is_partial"] is True
    assert SN.validate_points(pts, "month").count() == 0
    daily = EV.daily_ab(seed["sales"], fa, fb)
    y = rows(EV.regroup_comparison(daily, "day", "year", fa, fb))
    assert [(x["key"], x["value_a"], x["value_b"]) for x in y] == [("2024", 500.0, 7500.0)]
    with pytest.raises(ValueError):
        EV.regroup_comparison(daily, "month", "week", fa, fb)


def test_validate_points_flags_broken_rows(spark, seed):
    fa, fb = Filters("2024-04-01", "2024-04-30"), Filters("2024-05-01", "2024-05-31")
    pts = EV.evolution_points(seed["sales"], fa, fb, "month")
    bad = pts.withColumn("difference", F.lit(1.0)).withColumn("key", F.lit("2024-13"))
    v = {x["violation"] for x in rows(SN.validate_points(bad, "month"))}
    assert {"difference_mismatch", "bad_key_format", "keys_not_increasing"} <= v


def test_compare_metrics_and_products(seed):
    fa, fb = Filters("2024-04-01", "2024-04-30"), Filters("2024-05-01", "2024-05-31")
    m = {x["metric"]: x for x in rows(C.compare_metrics(seed["sales"], fa, fb))}
    assert m["total_sales"]["value_a"] == 500.0 and m["total_sales"]["value_b"] == 7500.0
    assert m["total_sales"]["pct_change"] == (7500.0 - 500.0) / 500.0 * 100.0
    assert m["unique_clients"]["value_a"] == 1.0 and m["unique_clients"]["value_b"] == 3.0
    p = {x["product_type"]: x for x in rows(C.compare_products(seed["sales"], fa, fb))}
    assert p["Producto"]["value_a"] == 0.0 and p["Producto"]["pct_change"] == 100.0


def test_snapshots(seed):
    f = Filters("2024-05-01", "2024-05-31")
    snap = SN.normal_snapshot(seed["sales"], f, "week").first()
    assert snap.mode == "normal" and snap.period_a.metrics.transactions == 4
    assert [t.product_type for t in snap.period_a.table] == ["Producto", "Servicio"]
    c = SN.compare_snapshot(seed["sales"], Filters("2024-04-01", "2024-04-30"), f, "month")
    row = c.first()
    assert row.mode == "compare" and len(row.comparison.evolution.points) == 2
    assert SN.compare_snapshot(seed["sales"], Filters("2030-01-01", "2030-01-31"), f).count() == 0


def _bounds(spark, as_of):
    return {r.period: (r.start.isoformat(), r.end.isoformat()) for r in P.named_periods(spark, as_of).collect()}


def test_period_bounds(spark):
    assert _bounds(spark, "2024-02-10")["current_month_full"] == ("2024-02-01", "2024-02-29")
    assert _bounds(spark, "2023-02-10")["current_month_full"] == ("2023-02-01", "2023-02-28")
    assert _bounds(spark, "2024-01-10")["previous_month_full"] == ("2023-12-01", "2023-12-31")
    b = _bounds(spark, "2024-05-15")
    assert b["previous_month_full"] == ("2024-04-01", "2024-04-30")
    assert b["last_7_days"] == ("2024-05-09", "2024-05-15")
    assert b["last_3_months"] == ("2024-02-15", "2024-05-15")
    assert b["current_week_full"] == ("2024-05-13", "2024-05-19")
    assert b["same_quarter_previous_year"] == ("2023-04-01", "2023-06-30")
    assert b["previous_semester_full"] == ("2023-07-01", "2023-12-31")
    assert _bounds(spark, "2024-02-10")["previous_quarter_full"] == ("2023-10-01", "2023-12-31")
    assert _bounds(spark, "2024-12-31")["current_semester_full"] == ("2024-07-01", "2024-12-31")
    assert _bounds(spark, "2026-05-10")["previous_year_full"] == ("2025-01-01", "2025-12-31")
    assert P.shift_year_iso(spark, "2024-02-29", -1) == "2023-02-28"


def test_presets_skip_without_a(spark):
    def sides(*args):
        return {(r.preset, r.side): (r.start.isoformat(), r.end.isoformat()) for r in P.preset_ranges(spark, "2024-05-15", *args).collect()}
    got = sides()
    assert ("same_period_as_a", "a") not in got and ("current_month_vs_previous", "a") in got
    got = sides(Filters("2024-05-01", "2024-05-10"))
    assert got["current_vs_previous", "b"] == ("2024-04-21", "2024-04-30")
    assert got["period_vs_previous_year", "b"] == ("2023-05-01", "2023-05-10")


def test_preset_comparison_with_own_filter_of_b(spark, seed):
    x = rows(P.preset_comparison(spark, seed["sales"], "2024-05-15", Filters(product_type="Servicio"), Filters(product_type="Producto")))
    m = {(e["preset"], e["metric"]): (e["value_a"], e["value_b"]) for e in x}
    assert m["current_month_vs_previous", "total_sales"] == (2500.0, 0.0)


def test_sales_by_period_and_presets(spark, seed):
    r = {x["period"]: x for x in rows(P.sales_by_period(spark, seed["sales"], "2024-05-15"))}
    assert r["current_month_to_date"]["total_sales"] == 7500.0
    assert r["previous_month_full"]["transactions"] == 1
    assert r["last_7_days"]["transactions"] == 2   # 2024-05-10 and 2024-05-12
    x = rows(P.preset_comparison(spark, seed["sales"], "2024-05-15"))
    cm = {(e["preset"], e["metric"]): e for e in x}
    assert cm[("current_month_vs_previous", "total_sales")]["value_a"] == 7500.0
    assert cm[("current_month_vs_previous", "total_sales")]["value_b"] == 500.0


def test_validate_snapshot_rows(seed):
    f = Filters("2024-05-01", "2024-05-31")
    c = SN.compare_snapshot(seed["sales"], Filters("2024-04-01", "2024-04-30"), f, "month")
    assert SN.validate_snapshot(c, "month").count() == 0
    n = SN.normal_snapshot(seed["sales"], f, "day")
    assert SN.validate_snapshot(n).count() == 0


def _sorted_rows(df, key):
    return sorted(rows(df), key=lambda r: str(r[key]))


def test_period_base_rollups_equal_direct_operators(spark):
    s = spark.createDataFrame([
        ("1", "A", "C1", "P", Decimal("10.50"), dt.date(2024, 5, 1)),
        ("2", "A2", "C1", "Q", Decimal("3.25"), dt.date(2024, 5, 1)),   # same client/day, other name
        ("3", "B", "C2", "P", Decimal("7.00"), dt.date(2024, 5, 2)),
        ("4", "B", "C2", "P", Decimal("1.00"), dt.date(2024, 5, 2)),
        ("5", "N", None, "Q", Decimal("2.00"), dt.date(2024, 5, 3)),
        ("6", "A", "C1", "P", Decimal("9.99"), dt.date(2024, 4, 30)),
    ], SALES_SCHEMA)
    f = Filters("2024-05-01", "2024-05-31")
    for mat in (False, True):
        p = SN.period_data(s, f, "week", materialize=mat)
        assert _sorted_rows(p.table, "product_type") == _sorted_rows(S.sales_summary(s, f), "product_type")
        assert rows(p.metrics) == rows(S.period_metrics(s, f))
        assert _sorted_rows(p.evolution, "key") == _sorted_rows(EV.sales_evolution(s, f, "week"), "key")
        assert _sorted_rows(p.products, "label") == _sorted_rows(S.product_distribution(s, f), "label")
        assert rows(p.top_clients.orderBy("rank")) == rows(S.top_clients(s, f, n=5).orderBy("rank"))


def test_many_snapshots_are_validated_in_one_projection(spark, seed):
    point = "struct<key:string,start:timestamp,`end`:timestamp,value_a:double,value_b:double,difference:double>"
    schema = ("name string, mode string, period_a struct<grouping:string>, period_b struct<grouping:string>, "
              f"comparison struct<evolution:struct<points:array<{point}>>>")
    ts = lambda m, d=1: dt.datetime(2024, m, d)
    good = [("2024-01", ts(1), ts(2), 1.0, 3.0, 2.0), ("2024-02", ts(2), ts(3), 1.0, 1.0, 0.0)]
    month = ("month",)
    snaps = spark.createDataFrame([
        ("good", "compare", month, month, ((good,),)),
        ("swapped", "compare", month, month, ((good[::-1],),)),
        ("one", "compare", month, month, (([("2024-13", ts(2), ts(1), 1.0, 1.0, 1.0)],),)),
        ("empty", "compare", month, ("week",), (([],),)),
        ("none", "compare", None, month, None),
        ("normal", "normal", month, None, None),
    ], schema)
    v = {}
    for r in SN.validate_snapshot(snaps, by=["name"]).collect():
        v.setdefault(r.name, set()).add((r.key, r.violation))
    assert v == {
        "swapped": {("2024-01", "keys_not_increasing"), ("2024-01", "overlapping_intervals")},
        "one": {("2024-13", "bad_key_format"), ("2024-13", "start_not_before_end"), ("2024-13", "difference_mismatch")},
        "empty": {(None, "no_points"), (None, "grouping_mismatch")},
        "none": {(None, "missing_period_a"), (None, "missing_comparison")},
    }
    plan = SN.validate_snapshot(snaps, by=["name"])._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "Exchange" not in plan


def test_product_snapshots_are_valid(spark, seed):
    a, b = Filters("2024-04-01", "2024-04-30"), Filters("2024-05-01", "2024-05-31")
    snaps = SN.product_snapshots(seed["sales"], a, b)
    assert snaps.count() == 10 and SN.validate_snapshot(snaps, by=["product_type", "grouping"]).count() == 0
    month = snaps.filter("product_type = 'Servicio' and grouping = 'month'").first()
    assert [(p.key, p.value_a, p.value_b) for p in month.comparison.evolution.points] == [("2024-04", 500.0, 0.0), ("2024-05", 0.0, 2500.0)]
