import datetime as dt
from decimal import Decimal

from conftest import LEAD_SCHEMA, SALES_SCHEMA, rows
from salescope.operators import dashboard as DB
from salescope.operators import leads as L
from salescope.operators import marketing as M

D = dt.date.fromisoformat


def sample_leads(spark):
    return spark.createDataFrame([
        ("L1", None, D("2024-05-01"), "meta_ads", "new", None, None),
        ("L2", None, D("2024-05-02"), "google_ads", "contacted", None, None),
        ("L3", None, D("2024-05-03"), "meta_ads", "meeting", D("2024-05-10"), None),
        ("L4", None, D("2024-04-20"), "linkedin_ads", "converted", D("2024-04-25"), "C001"),
        ("L5", None, D("2024-05-05"), "google_ads", "lost", None, None),
    ], LEAD_SCHEMA)


def test_funnel_stats(spark):
    f = L.funnel_stats(sample_leads(spark)).first()
    assert (f.total, f.meetings, f.converted, f.lost) == (5, 2, 1, 1)
    assert f.lead_to_meeting_pct == 2 / 5 * 100 and f.meeting_to_client_pct == 50.0
    assert f.avg_time_to_meeting == 6.0 and (f.lead_dropoff, f.meeting_dropoff) == (3, 1)
    assert f.direct_clients == 0


def test_funnel_empty(spark):
    f = L.funnel_stats(sample_leads(spark).limit(0)).first()
    assert (f.total, f.meeting_to_client_pct, f.avg_time_to_meeting) == (0, 0.0, 0.0)


def test_leads_by_source_unknown_bucket(spark):
    l = spark.createDataFrame([
        ("a", None, D("2024-05-01"), "meta_ads", "new", None, None),
        ("b", None, D("2024-05-02"), "meta_ads", "meeting", D("2024-05-09"), None),
        ("c", None, D("2024-04-20"), "google_ads", "converted", D("2024-04-25"), "C001"),
        ("d", None, D("2024-05-05"), None, "lost", None, None),
    ], LEAD_SCHEMA)
    r = {x["source"]: x for x in rows(L.leads_by_source_stats(l))}
    assert r["unknown"]["total"] == 1 and r["meta_ads"]["total"] == 2
    assert r["google_ads"]["meeting_to_client_pct"] == 100.0
    assert r["meta_ads"]["avg_time_to_meeting"] == 7.0
    cr = rows(L.conversion_ranking(L.leads_by_source_stats(l)))
    assert cr[0]["source"] == "meta_ads" and abs(sum(x["share"] for x in cr) - 1.0) < 1e-12


def test_filtered_marketing_metrics(spark):
    leads = spark.createDataFrame([
        ("a", None, D("2024-05-01"), "meta_ads", "new", None, None),
        ("b", None, D("2024-05-02"), "meta_ads", "converted", None, "C001"),
        ("c", None, D("2024-05-03"), "google_ads", "new", None, None),
    ], LEAD_SCHEMA)
    spend = spark.createDataFrame([("meta_ads", D("2024-05-01"), Decimal("500")),
                                   ("google_ads", D("2024-05-01"), Decimal("300"))],
                                  "source string, date date, amount decimal(18,2)")
    sales = spark.createDataFrame([("1", "T", "C001", "P", Decimal("5000"), D("2024-05-01"))], SALES_SCHEMA)
    r = {x["source"]: x for x in rows(M.marketing_metrics_filtered(leads, spend, sales))}
    meta = r["meta_ads"]
    assert (meta["leads"], meta["customers"], meta["revenue"], meta["spend"]) == (2, 1, 5000.0, 500.0)
    assert (meta["cpl"], meta["cac"], meta["roi"]) == (250.0, 500.0, 9.0)
    only_spend = rows(M.marketing_metrics_filtered(leads.limit(0), spend.limit(1), sales.limit(0)))
    assert len(only_spend) == 1 and only_spend[0]["leads"] == 0


def test_marketing_summary_two_sources(spark):
    m = spark.createDataFrame([("meta_ads", 10, 2, 5000.0, 500.0), ("google_ads", 5, 1, 2000.0, 300.0)],
                              "source string, leads long, customers long, revenue double, spend double")
    s = M.marketing_summary(m).first()
    assert (s.total_leads, s.total_customers, s.total_revenue, s.total_spend) == (15, 3, 7000.0, 800.0)
    assert s.conversion_rate == 0.2 and s.avg_cpl == 800 / 15 and s.avg_cac == 800 / 3


def test_first_touch_attribution(spark, seed):
    leads = spark.createDataFrame([
        ("x2", None, D("2024-01-01"), "google_ads", "new", None, "C001"),
        ("x1", None, D("2024-01-01"), "meta_ads", "new", None, "C001"),
        ("x3", None, D("2024-02-01"), "tiktok_ads", "new", None, "C002"),
    ], LEAD_SCHEMA)
    ft = {x["client_id"]: x["source"] for x in rows(M.first_touch(leads))}
    assert ft == {"C001": "meta_ads", "C002": "tiktok_ads"}   # tie on date -> lowest id
    m = {x["source"]: x for x in rows(M.marketing_metrics(leads, seed["sales"], seed["spend"]))}
    assert m["meta_ads"]["revenue"] == 3000.0 and m["meta_ads"]["customers"] == 1
    assert m["tiktok_ads"]["revenue"] == 2000.0
    assert m["linkedin_ads"]["roi"] == -1.0 and m["linkedin_ads"]["leads"] == 0
    assert M.best_channel(M.marketing_metrics(leads, seed["sales"], seed["spend"])).first().source == "meta_ads"  # tiktok has no spend -> roi 0
    rpc = {x["client_id"]: float(x["revenue"]) for x in rows(M.revenue_per_client(seed["sales"]))}
    assert rpc["C001"] == 3000.0


def test_latest_lead_and_upcoming(spark, seed):
    ll = {x["client_id"]: x["lead_id"] for x in rows(L.latest_lead_per_client(seed["leads"]))}
    assert ll == {"C001": "L004"}
    e = L.leads_enriched(seed["leads"], seed["clients"])
    names = {x["id"]: x["client_name"] for x in rows(e)}
    assert names["L004"] == "TechNova" and names["L001"] == "—"
    up = rows(L.upcoming_meetings(e, "2024-05-01"))
    assert [x["id"] for x in up] == ["L003"]
    j = {x["id"]: x["lead_source"] for x in rows(L.clients_with_latest_lead(seed["clients"], seed["leads"]))}
    assert j == {"C001": "linkedin_ads", "C002": "—", "C003": "—"}


def test_dashboard_kpis_seed(seed):
    k = DB.dashboard_kpis(seed["sales"], seed["clients"], seed["leads"], "2024-05-15").first()
    assert (k.has_data, k.sales_rows, k.clients_rows, k.total_leads, k.leads_with_meeting) == (True, 5, 3, 5, 2)
    assert k.leads_conversion_rate == 20.0 and k.leads_this_month == 4 and k.last_import is None


def test_lead_multi_filter_stage_and_search(spark, seed):
    from salescope.operators.filters import lead_multi_filter
    e = L.leads_enriched(seed["leads"], seed["clients"])
    assert [r["id"] for r in rows(lead_multi_filter(e, "2024-05-15", stage="Cliente"))] == ["L004"]
    assert lead_multi_filter(e, "2024-05-15", stage="Unknown stage").count() == 5
    assert lead_multi_filter(e, "2024-05-15", source="Todas", stage="Todos").count() == 5
    # preset 7 days: cutoff 2024-05-08 inclusive
    assert {r["id"] for r in rows(lead_multi_filter(e, "2024-05-15", preset_days=7))} == {"L005"}
    # explicit range wins over the preset
    assert lead_multi_filter(e, "2024-05-15", date_start="2024-04-01", date_end="2024-04-30",
                             preset_days=7).count() == 1
    # search matches the source label and the client name, case-insensitively
    assert {r["id"] for r in rows(lead_multi_filter(e, "2024-05-15", term="linkedin ads"))} == {"L004"}
    assert {r["id"] for r in rows(lead_multi_filter(e, "2024-05-15", term="TECHNOVA"))} == {"L004"}
