"""Registered ingestion, source-normalisation and dashboard queries with
their DuckDB oracles.  Raw inputs are the all-text views ``raw_sales``,
``raw_leads``, ``raw_spend`` and ``raw_sources`` derived from ``events``."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.text import SOURCE_NORMALIZATION, SOURCE_SUFFIXES
from ..operators import dashboard as D
from ..operators import ingest as I
from ..operators import quality as QL
from ..sources import tables as TB
from .oracle_views import with_views as W
from .registry import register

AS_OF = "2024-01-31"
NUM = r"^[+-]?([0-9]+[.]?[0-9]*|[.][0-9]+)([eE][+-]?[0-9]+)?$"


def _date_parse(x):
    fmts = ["%Y-%m-%d", "%d/%m/%Y", "%Y/%m/%d", "%d-%m-%Y", "%d/%m/%y", "%Y-%m-%d %H:%M:%S", "%d/%m/%Y %H:%M:%S"]
    return "coalesce(" + ", ".join(f"cast(try_strptime(trim({x}), '{f}') as date)" for f in fmts) + ")"


def _req(x, name):
    return (f"case when {x} is null then 'El campo obligatorio ''{name}'' es None' "
            f"when trim({x}) = '' then 'El campo obligatorio ''{name}'' está vacío' end")


def _num(x, name):
    t = f"trim({x})"
    return (f"case when {x} is null then 'El campo ''{name}'' es obligatorio y no puede ser None' "
            f"when {t} = '' then 'El campo ''{name}'' está vacío' "
            f"when not regexp_matches({t}, '{NUM}') or try_cast({t} as double) is null "
            f"  or isnan(try_cast({t} as double)) or isinf(try_cast({t} as double)) "
            f"  then 'El campo ''{name}'' debe ser numérico, recibido: ''' || {t} || '''' "
            f"when try_cast({t} as double) <= 0 then 'El campo ''{name}'' debe ser mayor que 0, recibido: ' "
            f"  || cast(try_cast({t} as double) as varchar) end")


def _date_err(x):
    return (f"case when not ({x} is null or trim({x}) = '') and {_date_parse(x)} is null "
            f"then 'Fecha con formato desconocido: ' || {x} end")


def _date_val(x):
    return f"case when {x} is null or trim({x}) = '' then date '{AS_OF}' else {_date_parse(x)} end"


_SALES_CHECKED = f"""
chk as (select *, coalesce({_req('client_name', 'client_name')}, {_req('client_id', 'client_id')},
                          {_req('product_type', 'product_type')}, {_num('price', 'price')},
                          {_date_err('date')}) as error from raw_sales)"""


@register("ingest_sales_valid", W(f""", {_SALES_CHECKED}
select row_no, trim(client_name) as client_name, trim(client_id) as client_id, trim(product_type) as product_type,
       cast(trim(price) as double) as price, strftime({_date_val('date')}, '%Y-%m-%d') as date,
       false as used_default_date, (date is null or trim(date) = '') as date_defaulted
from chk where error is null""", "raw_sales"))
def q_ingest_sales_valid(spark, d):
    return I.validate_sales(TB.raw_sales(spark, d), AS_OF)[0]


@register("ingest_sales_rejected", W(f""", {_SALES_CHECKED}
select row_no, error, client_name, client_id, product_type, price, date from chk where error is not null""",
    "raw_sales"))
def q_ingest_sales_rejected(spark, d):
    return I.validate_sales(TB.raw_sales(spark, d), AS_OF)[1]


@register("ingest_new_clients", W(f""", {_SALES_CHECKED},
v as (select row_no, trim(client_name) as client_name, trim(client_id) as client_id from chk where error is null),
f as (select client_id, arg_min(client_name, row_no) as name from v group by client_id)
select client_id as id, name, '-' as cif, null::varchar as address, null::varchar as contact_person,
       null::varchar as email
from f where client_id not in (select id from clients)""", "raw_sales", "clients"))
def q_ingest_new_clients(spark, d):
    return I.import_sales(TB.raw_sales(spark, d), TB.clients(spark, d), AS_OF).extra["new_clients"]


def _strip_chain(x):
    k = f"trim(lower({x}))"
    for suf in SOURCE_SUFFIXES:
        k = f"(case when suffix({k}, '{suf}') then trim(left({k}, length({k}) - {len(suf)})) else {k} end)"
    return k


def _norm_source(x):
    k = _strip_chain(x)
    whens = " ".join(f"when '{a}' then '{b}'" for a, b in SOURCE_NORMALIZATION.items())
    return f"(case when {x} is null or {x} = '' then {x} else (case {k} {whens} else {k} end) end)"


@register("normalize_source", W(f"""
select row_no, source, {_norm_source('source')} as normalized from raw_sources""", "raw_sources"))
def q_normalize_source(spark, d):
    return QL.normalized_sources(TB.raw_sources(spark, d))


@register("unknown_sources", W(f"""
select {_strip_chain('source')} as source_key, count(*) as rows from raw_sources
where source is not null and source <> '' and {_strip_chain('source')} not in ({', '.join(f"'{a}'" for a in SOURCE_NORMALIZATION)})
group by 1""", "raw_sources"))
def q_unknown_sources(spark, d):
    return QL.unknown_sources(TB.raw_sources(spark, d))


_LEADS_CHECKED = f"""
chk as (select *, coalesce({_date_err('created_at')}, {_req('source', 'source')}) as error from raw_leads),
v as (select row_no,
             {_date_val('created_at')} as created_at,
             {_norm_source('trim(source)')} as source,
             nullif(trim(external_id), '') as external_id, nullif(trim(status), '') as status,
             case when meeting_date is null or trim(meeting_date) = '' then null else {_date_parse('meeting_date')} end as meeting_date,
             nullif(trim(client_id), '') as client_id
      from chk where error is null),
v2 as (select coalesce(external_id, sha1(concat_ws('_', coalesce(client_id, ''), strftime(created_at, '%Y-%m-%d'), source))) as id, *
       from v),
cand as (select * from v2 where status is not null),
fresh as (select * from cand c
          where not exists (select 1 from leads l where l.id = c.id)
            and not exists (select 1 from leads l where l.external_id is not null and l.external_id = c.external_id
                            and l.source = c.source)),
firsts as (select * from (select *, row_number() over (partition by id order by row_no) as rn from fresh) x where rn = 1),
ins as (select f.row_no, f.id, f.external_id, f.created_at, f.source, f.status, f.meeting_date,
               case when f.client_id in (select id from clients) then f.client_id end as client_id from firsts f)"""


@register("ingest_leads_inserted", W(f""", {_LEADS_CHECKED}
select row_no, id, external_id, strftime(created_at, '%Y-%m-%d') as created_at, source, status,
       strftime(meeting_date, '%Y-%m-%d') as meeting_date, client_id from ins""", "raw_leads", "leads", "clients"))
def q_ingest_leads_inserted(spark, d):
    return I.import_leads(TB.raw_leads(spark, d), TB.leads(spark, d), TB.clients(spark, d), AS_OF,
                          on_unknown_client="null").valid


@register("ingest_leads_counts", W(f""", {_LEADS_CHECKED}
select (select count(*) from raw_leads) as total_rows, (select count(*) from chk where error is not null) as rejected,
       (select count(*) from v2 where status is null) as missing_status,
       (select count(*) from cand) - (select count(*) from ins) as duplicates,
       (select count(*) from ins) as inserted""", "raw_leads", "leads", "clients"))
def q_ingest_leads_counts(spark, d):
    r = I.import_leads(TB.raw_leads(spark, d), TB.leads(spark, d), TB.clients(spark, d), AS_OF,
                       on_unknown_client="null")
    one = lambda df, n: df.agg(F.count(F.lit(1)).alias(n))
    return (one(TB.raw_leads(spark, d), "total_rows").crossJoin(one(r.rejected, "rejected"))
            .crossJoin(one(r.extra["missing_status"], "missing_status"))
            .crossJoin(one(r.extra["duplicates"], "duplicates")).crossJoin(one(r.valid, "inserted")))


_SPEND_CHECKED = f"""
chk as (select *, coalesce({_req('source', 'source')}, {_num('amount', 'amount')}, {_date_err('date')}) as error
        from raw_spend)"""


@register("ingest_spend_valid", W(f""", {_SPEND_CHECKED}
select row_no, {_norm_source('trim(source)')} as source, round(cast(trim(amount) as double), 2) as amount,
       strftime({_date_val('date')}, '%Y-%m-%d') as date from chk where error is null""", "raw_spend"))
def q_ingest_spend_valid(spark, d):
    return I.validate_spend(TB.raw_spend(spark, d), AS_OF)[0]


@register("ingest_spend_rejected", W(f""", {_SPEND_CHECKED}
select row_no, error, source, amount, date from chk where error is not null""", "raw_spend"))
def q_ingest_spend_rejected(spark, d):
    return I.validate_spend(TB.raw_spend(spark, d), AS_OF)[1]


@register("dashboard_kpis", W(f"""
select (select count(*) from sales) > 0 as has_data, (select count(*) from sales) as sales_rows,
       (select count(*) from clients) as clients_rows, null::varchar as last_import,
       count(*) as total_leads, count(case when status in ('meeting','converted') then 1 end) as leads_with_meeting,
       case when count(*) > 0 then count(client_id) / count(*) * 100.0 else 0.0 end as leads_conversion_rate,
       count(case when date_trunc('month', created_at) = date_trunc('month', date '{AS_OF}') then 1 end) as leads_this_month
from leads""", "sales", "clients", "leads"))
def q_dashboard_kpis(spark, d):
    return D.dashboard_kpis(TB.sales(spark, d), TB.clients(spark, d), TB.leads(spark, d), AS_OF)
