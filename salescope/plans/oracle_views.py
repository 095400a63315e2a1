"""DuckDB spellings of the business views over the driver's tables, used to
build the independent SQL oracle for every registered query.  The Spark side
builds the same views with the DataFrame API (``sources/tables.py``)."""

from __future__ import annotations

VIEWS = {
    "sales": """
select concat(cast(l_orderkey as varchar),'-',cast(l_linenumber as varchar),'-',cast(l_partkey as varchar),'-',cast(l_suppkey as varchar)) as id,
       c_name as client_name, cast(o_custkey as varchar) as client_id, p_type as product_type,
       cast(l_extendedprice as decimal(18,2)) as price, cast(o_orderdate as date) as date
from lineitem join orders on l_orderkey=o_orderkey join customer on o_custkey=c_custkey join part on l_partkey=p_partkey""",
    "clients": """
select cast(c_custkey as varchar) as id, c_name as name,
       case when c_custkey%3=0 then '-' else concat('A', lpad(cast(c_custkey as varchar),8,'0')) end as cif,
       case when c_custkey%4=0 then null else concat('Street ', cast(c_nationkey as varchar)) end as address,
       case when c_custkey%5=0 then null else concat('Contact ', cast(c_custkey as varchar)) end as contact_person,
       case when c_custkey%7=0 then 'bad-mail' else concat('c', cast(c_custkey as varchar), '@example.com') end as email
from customer where c_custkey%10<>0
union all
select concat('S', cast(s_suppkey as varchar)), s_name, '-', null, null, null from supplier""",
    "leads": """
select concat('L',cast(event_id as varchar)) as id, cast(event_id as varchar) as external_id, cast(ts as date) as created_at,
       case k%5 when 0 then 'meta_ads' when 1 then 'google_ads' when 2 then 'linkedin_ads' when 3 then 'tiktok_ads' else 'referral' end as source,
       case event_type when 'view' then 'new' when 'click' then 'contacted' when 'signup' then 'meeting' when 'purchase' then 'converted' else 'lost' end as status,
       case when event_type in ('signup','purchase') and k%3<>0 then cast(ts as date) + cast(k%14 as int) end as meeting_date,
       case when event_type in ('purchase','signup') then cast(user_id as varchar) end as client_id
from (select *, cast(regexp_extract(props,'([0-9]+)',1) as int) as k from events) t""",
    "marketing_spend": """
select s.source, s.date, cast(sum(s.amount) as decimal(18,2)) as amount
from (select case event_id%4 when 0 then 'meta_ads' when 1 then 'google_ads' when 2 then 'linkedin_ads' else 'newsletter' end as source,
             cast(ts as date) as date, cast(value as decimal(18,2)) as amount
      from events where event_type='click') s
group by s.source, s.date""",
    "funnel_events": """
select cast(event_id as varchar) as id, cast(user_id as varchar) as client_id, concat('L',cast(event_id as varchar)) as lead_id,
       event_type, cast(ts as date) as event_date, props as metadata from events""",
    "sales_dup": """
select id, case when cast(client_id as int)%2=0 then upper(nm) else nm end as client_name, client_id, product_type, price, date
from (select *, concat('Company ', cast((cast(client_id as int)
               + case when cast(client_id as int)%11=0 and month(date)=5 then 1 else 0 end)%700 as varchar)) as nm from sales) t""",
    "raw_sales": """
select event_id+2 as row_no,
       case when event_id%29=0 then '  ' else concat(' User ', cast(user_id as varchar), ' ') end as client_name,
       cast(user_id as varchar) as client_id, event_type as product_type,
       case when event_id%17=0 then '' when event_id%19=0 then 'abc' when event_id%23=0 then '-5'
            else cast(cast(value as decimal(18,2)) as varchar) end as price,
       case when event_id%13=0 then 'not a date' when event_id%11=0 then null when event_id%4=0 then strftime(ts,'%d/%m/%Y')
            when event_id%4=1 then strftime(ts,'%Y/%m/%d') when event_id%4=2 then strftime(ts,'%d-%m-%Y') else strftime(ts,'%Y-%m-%d') end as date
from events""",
    "raw_sources": """
select event_id as row_no, case event_id%10 when 0 then 'Facebook Lead Ads' when 1 then ' IG ' when 2 then 'google_ads'
       when 3 then 'Google Search Ads' when 4 then 'LinkedIn' when 5 then 'tiktok-ads' when 6 then 'CSV'
       when 7 then 'meta ads' when 8 then 'referral' else 'newsletter_ads' end as source from events""",
    "raw_leads": """
select event_id+2 as row_no,
       case when event_id%5=0 then cast(event_id-1 as varchar) when event_id%7=0 then '' else cast(event_id as varchar) end as external_id,
       case when event_id%37=0 then 'garbage' when event_id%3=0 then strftime(ts,'%d/%m/%Y') else strftime(ts,'%Y-%m-%d') end as created_at,
       case k%4 when 0 then 'Facebook Lead Ads' when 1 then ' google ' when 2 then 'LinkedIn' else 'referral' end as source,
       case when event_id%31=0 then ' ' else event_type end as status,
       case when event_type='signup' then strftime(cast(ts as date) + 3,'%Y-%m-%d') end as meeting_date,
       case when event_type in ('signup','purchase') then cast(user_id as varchar) end as client_id
from (select *, cast(regexp_extract(props,'([0-9]+)',1) as int) as k from events) t""",
    "raw_spend": """
select event_id+2 as row_no,
       case event_id%10 when 0 then 'Facebook Lead Ads' when 1 then ' IG ' when 2 then 'google_ads'
            when 3 then 'Google Search Ads' when 4 then 'LinkedIn' when 5 then 'tiktok-ads' when 6 then 'CSV'
            when 7 then 'meta ads' when 8 then '' else 'newsletter_ads' end as source,
       case when event_id%17=0 then '' when event_id%19=0 then 'n/a' when event_id%23=0 then '0'
            else printf('%.3f', value) end as amount,
       case when event_id%13=0 then '13/13/2024' when event_id%11=0 then ''
            when event_id%3=0 then strftime(ts,'%d-%m-%Y') else strftime(ts,'%Y-%m-%d') end as date
from events where event_type='click'""",
    "raw_mixed": """
select r.*, case when e.event_id%3=0 then '' else 'M' || cast(e.event_id as varchar) end as external_id,
       case when e.event_id%7=0 then '' when e.k%2=0 then 'meta' else 'Google Ads' end as source,
       case when e.event_id%5=0 then null else 'new' end as status,
       case when e.event_id%9=0 then '99/99/9999' else strftime(e.ts, '%Y-%m-%d') end as created_at
from raw_sales r join (select *, cast(regexp_extract(props,'([0-9]+)',1) as int) as k from events) e
  on r.row_no = e.event_id + 2""",
}

# Views built on other views.
DEPENDS = {"sales_dup": ["sales"], "raw_mixed": ["raw_sales"]}


def with_views(body: str, *names: str) -> str:
    """``WITH RECURSIVE <views> <body>``; dependencies are emitted first."""
    order: list[str] = []

    def add(n):
        for d in DEPENDS.get(n, []):
            add(d)
        if n not in order:
            order.append(n)

    for n in names:
        add(n)
    ctes = ",\n".join(f"{n} AS ({VIEWS[n]})" for n in order)
    b = body.lstrip()
    if b[:5].lower() == "with ":
        # the body's own CTEs continue the list
        return f"WITH RECURSIVE {ctes},\n{b[5:]}"
    if b.startswith(","):
        return f"WITH RECURSIVE {ctes}{b}"
    return f"WITH RECURSIVE {ctes}\n{b}"
