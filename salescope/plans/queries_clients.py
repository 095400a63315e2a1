"""Registered client queries with their DuckDB oracles."""

from __future__ import annotations

from ..operators import clients as CL
from ..sources import tables as TB
from .oracle_views import with_views as W
from .registry import register


def _ds(c):
    return f"strftime({c}, '%Y-%m-%d')"


@register("sales_enriched", W(f"""
select s.id, {_ds('s.date')} as date, s.client_id, s.client_name, s.product_type, cast(s.price as double) as price,
       case when c.id is not null then c.cif else '-' end as client_cif,
       case when c.id is not null then c.email else '-' end as client_email,
       case when c.id is not null then c.contact_person else '-' end as client_phone,
       case when c.id is not null then c.address else '-' end as client_address
from sales s left join clients c on s.client_id = c.id""", "sales", "clients"))
def q_sales_enriched(spark, d):
    return CL.sales_enriched(TB.sales(spark, d), TB.clients(spark, d))


@register("client_sales_stats", W("""
with nm as (select client_id, client_name as name from (
    select client_id, client_name, row_number() over (partition by client_id order by date desc, client_name desc) as rn
    from sales where client_id is not null) x where rn = 1),
agg as (select client_id, count(*) as total_sales, sum(price) as amt,
               string_agg(distinct product_type, ', ' order by product_type) as products
        from sales where client_id is not null group by client_id)
select agg.client_id, coalesce(nm.name, '-') as name, total_sales, cast(amt as double) as total_amount,
       cast(amt as double) / total_sales as avg_amount, products
from agg join nm using (client_id)""", "sales"))
def q_client_sales_stats(spark, d):
    return CL.client_sales_stats(TB.sales(spark, d))


_ALL = """
per as (select client_id, max(client_name) as sname, count(*) as n, sum(price) as amt,
               min(price) as mn, max(price) as mx from sales group by client_id),
allc as (
select case when c.id is not null then c.id else per.client_id end as client_id,
       case when c.id is not null then c.name else per.sname end as name,
       case when c.id is not null then c.cif else '-' end as cif,
       case when c.id is not null then c.address else '-' end as address,
       case when c.id is not null then c.contact_person else '-' end as contact_person,
       case when c.id is not null then c.email else '-' end as email,
       coalesce(per.n, 0) as total_sales, coalesce(cast(per.amt as double), 0.0) as total_amount,
       case when coalesce(per.n, 0) > 0 then cast(per.amt as double) / per.n else 0.0 end as avg_amount,
       coalesce(cast(per.mn as double), 0.0) as min_amount, coalesce(cast(per.mx as double), 0.0) as max_amount
from per full outer join clients c on per.client_id = c.id)"""


@register("all_clients_stats", W(f", {_ALL}\nselect * from allc", "sales", "clients"))
def q_all_clients_stats(spark, d):
    return CL.all_clients_stats(TB.sales(spark, d), TB.clients(spark, d))


@register("last_sales_per_client", W(f"""
select id, client_name, client_id, product_type, cast(price as double) as price, {_ds('date')} as date, rank from (
  select *, row_number() over (partition by client_id order by date desc, id desc) as rank
  from sales where client_id is not null) x where rank <= 10""", "sales"))
def q_last_sales_per_client(spark, d):
    return CL.last_sales_per_client(TB.sales(spark, d), 10)


_LAST_EV = """
select *, row_number() over (partition by client_id order by event_date desc, id desc) as rank
from funnel_events where client_id is not null"""


@register("last_events_per_client", W(f"""
select id, client_id, lead_id, event_type, {_ds('event_date')} as event_date, metadata, rank
from ({_LAST_EV}) x where rank <= 5""", "funnel_events"))
def q_last_events_per_client(spark, d):
    return CL.last_events_per_client(TB.funnel_events(spark, d), 5)


@register("client_profile_stats", W("""
select client_id, count(*) as total_sales, cast(sum(price) as double) as total_amount,
       cast(sum(price) as double) / count(*) as avg_amount
from sales where client_id is not null group by client_id""", "sales"))
def q_client_profile_stats(spark, d):
    return CL.client_profile_stats(TB.sales(spark, d))


@register("client_360", W(f""", {_ALL},
ll as (select client_id, source, status, created_at from (
  select *, row_number() over (partition by client_id order by created_at desc, id desc) as rn
  from leads where client_id is not null) x where rn = 1),
ev as (select client_id, string_agg(event_type || ' ' || {_ds('event_date')}, ', ' order by rank) as last_events
       from ({_LAST_EV}) y where rank <= 5 group by client_id)
select a.client_id, a.name, a.cif, a.address, a.contact_person, a.email, a.total_sales, a.total_amount, a.avg_amount,
       ll.source as lead_source, ll.status as lead_status, {_ds('ll.created_at')} as lead_created_at,
       coalesce(ev.last_events, '') as last_events
from allc a left join ll on a.client_id = ll.client_id left join ev on a.client_id = ev.client_id""",
    "sales", "clients", "leads", "funnel_events"))
def q_client_360(spark, d):
    return CL.customer_360(TB.sales(spark, d), TB.clients(spark, d), TB.leads(spark, d),
                           TB.funnel_events(spark, d))


@register("duplicate_flags", W("""
select c.id, c.name, c.cif,
       (c.cif is not null and trim(c.cif) not in ('', '-')
        and exists (select 1 from clients o where o.cif = upper(trim(c.cif)) and o.id <> c.id)) as duplicate_cif,
       exists (select 1 from clients o where lower(o.name) = lower(trim(c.name)) and o.id <> c.id) as duplicate_name
from clients c""", "clients"))
def q_duplicate_flags(spark, d):
    return CL.duplicate_flags(TB.clients(spark, d))
