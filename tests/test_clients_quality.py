import datetime as dt
from decimal import Decimal

from conftest import CLIENT_SCHEMA, LEAD_SCHEMA, SALES_SCHEMA, rows
from pyspark.sql import functions as F

from salescope.operators import clients as CL
from salescope.operators import maintain as MT
from salescope.operators import quality as QL

D = dt.date.fromisoformat


def test_sales_enriched_placeholders(spark, seed):
    extra = spark.createDataFrame([("9", "Ghost", "C999", "P", Decimal("1"), D("2024-06-01"))], SALES_SCHEMA)
    # the enrichment has no order of its own; a listing sorts it
    r = rows(CL.sales_enriched(seed["sales"].unionByName(extra), seed["clients"]).orderBy(F.desc("date"), F.desc("id")))
    assert r[0]["client_id"] == "C999" and r[0]["client_cif"] == "-" and r[0]["client_address"] == "-"
    assert {x["client_phone"] for x in r if x["client_id"] == "C001"} == {"Juan"}


def test_client_stats(spark, seed):
    st = {x["client_id"]: x for x in rows(CL.client_sales_stats(seed["sales"]))}
    assert st["C001"]["products"] == ["Producto", "Servicio"] and st["C001"]["total_amount"] == 3000.0
    extra_client = spark.createDataFrame([("C004", "NoSales", "-", None, None, None)], CLIENT_SCHEMA)
    a = {x["client_id"]: x for x in rows(CL.all_clients_stats(seed["sales"], seed["clients"].unionByName(extra_client)))}
    assert a["C004"]["total_sales"] == 0 and a["C004"]["min_amount"] == 0.0 and a["C004"]["address"] is None
    assert a["C002"]["min_amount"] == 500.0 and a["C002"]["max_amount"] == 1500.0


def test_last_sales_per_client_limit(spark):
    s = spark.createDataFrame([(str(i), "A", "C1", "P", Decimal(i), D("2024-01-01") + dt.timedelta(days=i))
                               for i in range(1, 15)], SALES_SCHEMA)
    r = rows(CL.last_sales_per_client(s, 10))
    assert len(r) == 10 and max(x["rank"] for x in r) == 10
    assert min(x["date"] for x in r) == D("2024-01-06")


def test_customer_360(spark, seed):
    ev = spark.createDataFrame([(str(i), "C001", "L004", "click", D("2024-05-01") + dt.timedelta(days=i), "{}")
                                for i in range(7)],
                               "id string, client_id string, lead_id string, event_type string, event_date date, metadata string")
    c = {x["client_id"]: x for x in rows(CL.customer_360(seed["sales"], seed["clients"], seed["leads"], ev))}
    assert len(c["C001"]["last_events"]) == 5 and c["C001"]["last_events"][0] == "click 2024-05-07"
    assert c["C001"]["lead_source"] == "linkedin_ads" and c["C002"]["last_events"] == []


def test_duplicate_detection_and_merge(spark):
    sales = spark.createDataFrame([
        ("1", "Acme", "B2", "P", Decimal("10"), D("2024-01-01")),
        ("2", "ACME", "A1", "P", Decimal("20"), D("2024-01-02")),
        ("3", "acme", "C3", "P", Decimal("30"), D("2024-01-03")),
        ("4", "Other", "Z9", "P", Decimal("5"), D("2024-01-03")),
    ], SALES_SCHEMA)
    clients = spark.createDataFrame([
        ("B2", "Acme", "-", None, "Bob", None),
        ("C3", "acme", "C1234567", "Street 3", None, "c@x.com"),
        ("Z9", "Other", "-", None, None, None),
    ], CLIENT_SCHEMA)
    g = rows(QL.duplicate_client_names(sales))
    assert len(g) == 1 and g[0]["id_count"] == 3 and g[0]["name"] == "ACME"
    s = QL.duplicate_summary(QL.duplicate_client_names(sales)).first()
    assert (s.total_duplicates, s.groups, s.first_names, s.remaining) == (2, 1, "ACME", 0)
    m = MT.merge_duplicate_clients(sales, clients)
    mp = {x["old_id"]: (x["primary_id"], x["rows_moved"]) for x in rows(m.mapping)}
    assert mp == {"A1": ("B2", 1), "C3": ("B2", 1)}        # lowest stored id is primary
    cl = {x["id"]: x for x in rows(m.clients)}
    assert set(cl) == {"B2", "Z9"}
    assert cl["B2"]["cif"] == "C1234567" and cl["B2"]["address"] == "Street 3"
    assert cl["B2"]["contact_person"] == "Bob" and cl["B2"]["email"] == "c@x.com"
    assert {x["client_id"] for x in rows(m.sales)} == {"B2", "Z9"}


def test_quality_checks(spark, seed):
    leads = spark.createDataFrame([
        ("a", "E1", D("2024-05-01"), "meta_ads", "meeting", None, None),
        ("b", "E1", D("2024-05-01"), "meta_ads", "converted", None, None),
        ("c", None, D("2024-05-01"), "meta_ads", "new", D("2024-05-03"), "C001"),
        ("d", None, D("2024-05-01"), "meta_ads", "weird", None, None),
        ("e", None, D("2024-05-01"), "meta_ads", "", None, None),
    ], LEAD_SCHEMA)
    q = {(x["lead_id"], x["rule"]) for x in rows(QL.lead_consistency(leads))}
    assert q == {("a", "meeting_without_meeting_date"), ("b", "converted_without_client"),
                 ("c", "new_with_meeting_date"), ("c", "new_with_client"), ("d", "unknown_status")}
    u = {x["check"]: x["duplicate_keys"] for x in rows(QL.uniqueness_checks(seed["sales"], seed["clients"], leads))}
    assert u["leads.external_id_source"] == 1 and u["clients.id"] == 0
    o = {x["check"]: x["orphans"] for x in rows(QL.orphan_checks(seed["sales"], seed["clients"], leads,
                                                                 leads.selectExpr("id", "'C777' as client_id",
                                                                                  "'zz' as lead_id")))}
    assert o == {"sales.client_id": 0, "leads.client_id": 0, "funnel_events.client_id": 5,
                 "funnel_events.lead_id": 5}
    cq = spark.createDataFrame([("1", "A", None, None, None, None), ("2", "Good", "-", None, None, None),
                                ("3", "Good", "AB", None, None, None), ("4", "Good", "", None, None, "x@y.com")],
                               CLIENT_SCHEMA)
    issues = {x["id"]: x["issue"] for x in rows(QL.client_quality(cq))}
    assert issues["2"] == "placeholder" and "4" not in issues and issues["1"].startswith("name")
    assert issues["3"].startswith("CIF")


def test_upsert_delete_update(spark, seed):
    ch = spark.createDataFrame([
        ("C001", "TechNova", " a-1234567 ", "Calle 9", "Juan", "juan@tech.com"),
        ("C004", "NewCo", "B87654321", None, None, None),       # CIF of C002 -> rejected
        ("C005", "X", None, None, None, None),                 # name too short
        ("C006", "Fresh", "", None, None, None),
    ], CLIENT_SCHEMA)
    up = MT.upsert_clients(seed["clients"], ch)
    t = {x["id"]: x for x in rows(up.table)}
    assert t["C001"]["cif"] == "A-1234567" and t["C001"]["address"] == "Calle 9" and "C006" in t
    rej = {x["id"]: x["error"] for x in rows(up.rejected)}
    assert set(rej) == {"C004", "C005"} and "CIF" in rej["C004"]
    gone = spark.createDataFrame([("C001",)], "id string")
    d = MT.delete_clients(gone, seed["clients"], seed["sales"], seed["leads"], seed["leads"])
    assert d.clients.count() == 2 and d.sales.filter("client_id = 'C001'").count() == 0
    assert d.leads.filter("client_id is not null").count() == 0
    upd = spark.createDataFrame([("L001", " Meeting ", "2024-05-20"), ("L999", "new", ""), ("L002", "bogus", "")],
                                "id string, status string, meeting_date string")
    u = MT.update_leads(seed["leads"], upd)
    l1 = u.table.filter("id = 'L001'").first()
    assert l1.status == "meeting" and l1.meeting_date == D("2024-05-20")
    assert {x["id"]: x["error"] for x in rows(u.rejected)} == {"L999": "unknown lead id", "L002": "invalid status"}


def test_spend_upsert(spark):
    base = spark.createDataFrame([(1, "meta_ads", Decimal("10.00"), D("2024-01-01"))],
                                 "id long, source string, amount decimal(18,2), date date")
    ch = spark.createDataFrame([(1, "Facebook Lead Ads", "12.345", "05/01/2024"), (None, "google", "3", ""),
                                (None, "x", "-1", "")], "id long, source string, amount string, date string")
    u = MT.upsert_spend(base, ch, "2024-05-15")
    t = sorted(rows(MT.list_spend(u.table)), key=lambda r: (r["id"] is None, r["id"]))
    assert t[0]["amount"] == Decimal("12.35") and t[0]["date"] == D("2024-01-05") and t[0]["source"] == "meta_ads"
    assert t[1]["source"] == "google_ads" and t[1]["date"] == D("2024-05-15")
    assert u.rejected.count() == 1


def test_merge_materialized_and_store(spark, seed, tmp_path):
    from salescope.sources import sinks as SK
    m = MT.merge_duplicate_clients(seed["sales"], seed["clients"])
    assert m.mapping.count() == 0 and m.sales.count() == 5
    p = SK.write_store(seed["sales"], str(tmp_path / "sales"), files=2)
    back = spark.read.parquet(p)
    assert back.count() == 5
    plan = back.filter("date >= '2024-05-10'")._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(date), GreaterThanOrEqual(date" in plan


def test_report_and_snapshot_sinks(spark, seed, tmp_path):
    from salescope.operators import leads as L
    from salescope.operators.filters import Filters
    from salescope.plans import snapshot as SN
    from salescope.sources import sinks as SK
    e = L.leads_enriched(seed["leads"], seed["clients"])
    lr = SK.leads_report_tables(e, seed["spend"], seed["sales"])
    paths = SK.write_report(lr, str(tmp_path / "leads_report"))
    assert spark.read.parquet(paths["leads"]).count() == 5
    assert spark.read.parquet(paths["funnel"]).first().total == 5
    ev = spark.createDataFrame([], "id string, client_id string, lead_id string, event_type string, "
                                   "event_date date, metadata string")
    cr = SK.client_report_tables(seed["sales"], seed["clients"], seed["leads"], ev)
    paths = SK.write_report(cr, str(tmp_path / "client_report"))
    assert spark.read.parquet(paths["profile"]).count() == 3
    assert spark.read.parquet(paths["last_sales"]).count() == 5
    snap = SN.normal_snapshot(seed["sales"], Filters("2024-05-01", "2024-05-31"), "week")
    p = SK.write_snapshot(snap, str(tmp_path / "snap"))
    back = spark.read.json(p).first()
    assert back.mode == "normal" and back.period_a.metrics.transactions == 4


def test_column_and_key_profile(spark, seed):
    from salescope.operators import quality as QL
    from salescope.session import drop_cut
    counts = QL.value_counts({"sales": seed["sales"], "clients": seed["clients"].filter("id <> 'C003'"), "none": seed["leads"].limit(0)})
    profile = {(r.table, r.column): tuple(r)[2:] for r in QL.column_profile(counts).collect()}
    assert profile["sales", "price"] == (5, 0, 5, "500.00", "3000.00")      # numbers by size, not by spelling
    assert profile["sales", "product_type"] == (5, 0, 2, "Producto", "Servicio")
    assert not [k for k in profile if k[0] == "none"]
    keys = QL.foreign_key_profile(counts, [("sales", "client_id", "clients", "id"), ("sales", "client_name", "clients", "name")])
    assert sorted(tuple(r) for r in keys.collect()) == [("sales", "client_id", "clients", "id", 5, 0, 1, 1),
                                                        ("sales", "client_name", "clients", "name", 5, 0, 1, 1)]
    last = QL.latest_rows({"sales": (seed["sales"], ["date", "id"])}, 2)["sales"]
    assert [r.id for r in last.collect()] == ["5", "3"]
    drop_cut(counts)
