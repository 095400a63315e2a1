"""Edge rows: empty inputs, zero denominators, NULL keys."""

import datetime as dt
import os
import tempfile
from decimal import Decimal

from conftest import LEAD_SCHEMA, SALES_SCHEMA, rows
from salescope.operators import compare as C
from salescope.operators import evolution as EV
from salescope.operators import leads as L
from salescope.operators import marketing as M
from salescope.operators import sales as S
from salescope.operators.filters import Filters
from salescope.sources import delimited as DL

D = dt.date.fromisoformat


def test_empty_sales_everywhere(spark):
    e = spark.createDataFrame([], SALES_SCHEMA)
    assert S.sales_summary(e).count() == 0
    assert S.summary_with_total(e).count() == 0
    assert S.product_distribution(e).count() == 0
    assert S.top_clients(e).count() == 0
    assert EV.sales_evolution(e, None, "week").count() == 0
    m = {x["metric"]: x for x in rows(C.compare_metrics(e, Filters("2024-01-01", "2024-01-31"),
                                                         Filters("2024-02-01", "2024-02-29")))}
    assert m["total_sales"]["value_a"] == 0.0 and m["avg_ticket"]["pct_change"] == 0.0


def test_zero_denominators_and_null_source(spark):
    leads = spark.createDataFrame([("a", None, D("2024-05-01"), None, "new", None, None),
                                   ("b", None, D("2024-05-01"), "", "lost", None, None)], LEAD_SCHEMA)
    spend = spark.createDataFrame([], "source string, date date, amount decimal(18,2)")
    sales = spark.createDataFrame([], SALES_SCHEMA)
    r = rows(M.marketing_metrics_filtered(leads, spend, sales))
    assert len(r) == 1 and r[0]["source"] == "unknown" and r[0]["leads"] == 2
    assert (r[0]["cpl"], r[0]["cac"], r[0]["roi"]) == (0.0, 0.0, 0.0)
    s = M.marketing_summary(M.marketing_metrics_filtered(leads.limit(0), spend, sales)).first()
    assert (s.total_leads, s.avg_cpl, s.conversion_rate, s.overall_roi) == (0, 0.0, 0.0, 0.0)
    f = L.funnel_stats(leads).first()
    assert (f.meetings, f.lead_to_meeting_pct, f.meeting_to_client_pct) == (0, 0.0, 0.0)
    # NULL source is its own group in the raw per-source count (A10)
    assert {x["source"] for x in rows(M.leads_by_source(leads))} == {None, ""}


def test_negative_days_to_meeting_allowed(spark):
    leads = spark.createDataFrame([("a", None, D("2024-05-10"), "x", "meeting", D("2024-05-08"), None)],
                                  LEAD_SCHEMA)
    assert L.funnel_stats(leads).first().avg_time_to_meeting == -2.0


def test_single_sale_bucket_keys_on_iso_year_edge(spark):
    s = spark.createDataFrame([("1", "A", "C1", "P", Decimal("1"), D("2021-01-03")),
                               ("2", "A", "C1", "P", Decimal("2"), D("2021-01-04"))], SALES_SCHEMA)
    assert [x["key"] for x in rows(EV.sales_evolution(s, None, "week"))] == ["2020-W53", "2021-W01"]
    assert [x["key"] for x in rows(EV.sales_evolution(s, None, "bogus"))] == ["2021-01-03", "2021-01-04"]


def test_row_numbers_several_files(spark):
    d = tempfile.mkdtemp(prefix="multi-")
    for name, n in (("a.csv", 3), ("b.csv", 5)):
        with open(os.path.join(d, name), "w") as fh:
            fh.write("client_name,client_id,product_type,price,date\n")
            fh.writelines(f"{name}{i},C,P,1,2024-01-01\n" for i in range(n))
    raw = DL.read_delimited(spark, d + "/*.csv", sep=",")
    got = {(os.path.basename(r["_file"]), r["row_no"]) for r in raw.select("_file", "row_no").collect()}
    assert got == {("a.csv", i) for i in range(2, 5)} | {("b.csv", i) for i in range(2, 7)}
