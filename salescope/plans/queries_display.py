"""Registered queries for the display-level rules (S19, S23-S28, F5, F8, T2,
I17) applied to whole tables, with their DuckDB oracles."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import dates as DT
from ..functions import metrics as MX
from ..functions import text as TX
from ..operators import clients as CL
from ..operators import compare as C
from ..operators import evolution as EV
from ..operators import leads as L
from ..operators.filters import distinct_values, search_clients
from ..sources import tables as TB
from .oracle_views import with_views as W
from .queries_compare import A, B, _cp_sql
from .queries_leads import _ENRICHED, _FUNNEL_SELECT, LEADS_AS_OF
from .registry import register

_LABEL_SQL = ("case when source is null or source = '' then '—' else coalesce(case lower(source) "
              "when 'meta_ads' then 'Meta Ads' when 'google_ads' then 'Google Ads' when 'linkedin_ads' then 'LinkedIn Ads' "
              "when 'tiktok_ads' then 'TikTok Ads' when 'manual_import' then 'Manual' end, source) end")


@register("lead_table_view", W(f"""
select id, {_LABEL_SQL} as source_label, client_name, status,
       date '{LEADS_AS_OF}' - cast(created_at as date) as age_days,
       case when date '{LEADS_AS_OF}' - cast(created_at as date) > 30 then 'old'
            when date '{LEADS_AS_OF}' - cast(created_at as date) >= 7 then 'aging' else 'recent' end as urgency,
       case when cast(meeting_date as date) = date '{LEADS_AS_OF}' then 'HOY'
            when cast(meeting_date as date) = date '{LEADS_AS_OF}' + 1 then 'MAÑANA'
            else meeting_date end as meeting_badge
from ({_ENRICHED}) e""", "leads", "clients"))
def q_lead_table_view(spark, d):
    e = L.leads_enriched(TB.leads(spark, d), TB.clients(spark, d))
    age = DT.lead_age_days("created_at", LEADS_AS_OF)
    return e.select("id", TX.source_label("source").alias("source_label"), "client_name", "status",
                    age.cast("long").alias("age_days"), DT.urgency_band(age).alias("urgency"),
                    DT.meeting_badge("meeting_date", LEADS_AS_OF).alias("meeting_badge"))


@register("compare_product_states", W(f"""
select product_type, value_a, value_b,
       case when value_a = 0 and value_b > 0 then 'new' when value_a > 0 and value_b = 0 then 'inactive'
            when value_a = 0 and value_b = 0 then 'none' else 'normal' end as state,
       case when value_b > value_a then '↑' when value_b < value_a then '↓' else '—' end as arrow
from ({_cp_sql(A, B)}) t""", "sales").replace("WITH sales AS", "WITH sales AS", 1))
def q_compare_product_states(spark, d):
    p = C.compare_products(TB.sales(spark, d), A, B)
    return p.select("product_type", "value_a", "value_b",
                    MX.compare_card_state("value_a", "value_b").alias("state"),
                    MX.delta_arrow("value_a", "value_b").alias("arrow"))


@register("funnel_insight", W(f"""
select meetings, converted, converted_from_meeting,
       case when meetings = 0 then 'no_meetings' when converted = 0 then 'meetings_no_conversion' else 'normal' end
         as insight,
       case when meetings = 0 then '' else
         printf('%d of %d meetings converted · total clients: %d',
                case when converted = 0 then 0 else converted_from_meeting end, meetings, converted) end as insight_text
from ({_FUNNEL_SELECT.format(src='leads')}) f""", "leads"))
def q_funnel_insight(spark, d):
    f = L.funnel_stats(TB.leads(spark, d))
    return f.select("meetings", "converted", "converted_from_meeting",
                    MX.funnel_insight("meetings", "converted").alias("insight"),
                    MX.funnel_insight_text("meetings", "converted", "converted_from_meeting").alias("insight_text"))


@register("client_search", W("""
select * from (select id, name from clients) c where lower(name) like '%#00000001%'""", "clients"))
def q_client_search(spark, d):
    return search_clients(TB.clients(spark, d).select("id", "name"), " #00000001 ")


@register("distinct_client_names", W("select distinct client_name from sales", "sales"))
def q_distinct_client_names(spark, d):
    return distinct_values(TB.sales(spark, d), "client_name")


@register("distinct_lead_sources", W("select distinct source from leads", "leads"))
def q_distinct_lead_sources(spark, d):
    return distinct_values(TB.leads(spark, d), "source")


@register("distinct_lead_statuses", W("select distinct status from leads", "leads"))
def q_distinct_lead_statuses(spark, d):
    return distinct_values(TB.leads(spark, d), "status")


@register("group_time_series_month", W("""
, daily as (select strftime(date, '%Y-%m-%d') as d, sum(price) as v from sales group by 1)
select strftime(cast(d as date), '%Y-%m') as key, strftime(min(cast(d as date)), '%b %y') as label,
       cast(sum(v) as double) as total from daily group by 1""", "sales"))
def q_group_time_series_month(spark, d):
    daily = (TB.sales(spark, d).groupBy(F.date_format("date", "yyyy-MM-dd").alias("date"))
             .agg(F.sum("price").alias("value")))
    return EV.group_time_series(daily, "month")


@register("leads_report_first50", W(f"""
select * from ({_ENRICHED}) e order by created_at desc, id desc limit 50""", "leads", "clients"))
def q_leads_report_first50(spark, d):
    from ..sources.sinks import leads_report_tables
    e = L.leads_enriched(TB.leads(spark, d), TB.clients(spark, d))
    return leads_report_tables(e, TB.marketing_spend(spark, d), TB.sales(spark, d))["leads"]


@register("client_products_text", W("""
select client_id, case when n = 0 then '-' when n > 2 then p2 || ', +' || cast(n - 2 as varchar) else p2 end
         as products_text
from (select client_id, count(distinct product_type) as n,
             array_to_string(list_slice(list_sort(list(distinct product_type)), 1, 2), ', ') as p2
      from sales where client_id is not null group by client_id) t""", "sales"))
def q_client_products_text(spark, d):
    st = CL.client_sales_stats(TB.sales(spark, d))
    return st.select("client_id", TX.products_text("products").alias("products_text"))


@register("clients_masked", W("""
select id, name,
  case when cif is null or trim(cif) in ('', '-', '—') then cif else '••••••••' end as cif,
  case when email is null or trim(email) in ('', '-', '—') then email else '••••••••' end as email,
  case when contact_person is null or trim(contact_person) in ('', '-', '—') then contact_person else '••••••••' end
    as contact_person
from clients""", "clients"))
def q_clients_masked(spark, d):
    c = TB.clients(spark, d)
    return c.select("id", "name", TX.mask_sensitive("cif").alias("cif"), TX.mask_sensitive("email").alias("email"),
                    TX.mask_sensitive("contact_person").alias("contact_person"))
