"""Registered data-quality and maintenance queries with their DuckDB oracles."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import maintain as MT
from ..operators import quality as QL
from ..sources import tables as TB
from .oracle_views import with_views as W
from .registry import register


@register("lead_quality", W("""
, s as (select id, lower(trim(coalesce(status, ''))) as st, meeting_date is not null as md,
              client_id is not null and client_id <> '' as hc from leads),
r as (
  select id as lead_id, 'unknown_status' as rule from s where st <> '' and st not in ('new','contacted','meeting','converted','lost')
  union all select id, 'meeting_without_meeting_date' from s where st = 'meeting' and not md
  union all select id, 'converted_without_client' from s where st = 'converted' and not hc
  union all select id, 'new_with_meeting_date' from s where st = 'new' and md
  union all select id, 'new_with_client' from s where st = 'new' and hc
  union all select id, 'contacted_with_client' from s where st = 'contacted' and hc)
select * from r""", "leads"))
def q_lead_quality(spark, d):
    return QL.lead_consistency(TB.leads(spark, d))


_CLIENT_ERR = r"""
case when name is null or length(trim(name)) < 2 then 'name must have at least 2 characters'
     when trim(cif) = '-' then 'placeholder'
     when not (cif is null or trim(cif) = '' or regexp_matches(regexp_replace(trim(cif), '[-.\s]', '', 'g'), '^[A-Za-z0-9]{7,12}$'))
          then 'CIF/NIF must have 7 to 12 alphanumeric characters'
     when not (email is null or trim(email) = '' or regexp_matches(trim(email), '^[\w.-]+@[\w.-]+\.\w+$'))
          then 'email must have a valid format'
     when not (contact_person is null or trim(contact_person) = '' or length(trim(contact_person)) >= 2)
          then 'contact must have at least 2 characters'
end"""


@register("client_quality", W(f"""
select id, issue from (select id, {_CLIENT_ERR} as issue from clients) t where issue is not null""", "clients"))
def q_client_quality(spark, d):
    return QL.client_quality(TB.clients(spark, d))


@register("orphans", W("""
select 'sales.client_id' as "check", count(*) as orphans from sales s
  where s.client_id is not null and not exists (select 1 from clients c where c.id = s.client_id)
union all select 'leads.client_id', count(*) from leads l
  where l.client_id is not null and not exists (select 1 from clients c where c.id = l.client_id)
union all select 'funnel_events.client_id', count(*) from funnel_events e
  where e.client_id is not null and not exists (select 1 from clients c where c.id = e.client_id)
union all select 'funnel_events.lead_id', count(*) from funnel_events e
  where e.lead_id is not null and not exists (select 1 from leads l where l.id = e.lead_id)""",
    "sales", "clients", "leads", "funnel_events"))
def q_orphans(spark, d):
    return QL.orphan_checks(TB.sales(spark, d), TB.clients(spark, d), TB.leads(spark, d),
                            TB.funnel_events(spark, d))


def _dup_sql(table, keys, name):
    k = ", ".join(keys)
    nn = " and ".join(f"{x} is not null" for x in keys)
    return (f"select '{name}' as \"check\", count(*) as duplicate_keys, cast(coalesce(sum(n), 0) as bigint) as rows from "
            f"(select {k}, count(*) as n from {table} where {nn} group by {k} having count(*) > 1) t")


@register("uniqueness", W(" union all ".join([
    _dup_sql("clients", ["id"], "clients.id"), _dup_sql("sales", ["id"], "sales.id"),
    _dup_sql("leads", ["id"], "leads.id"),
    _dup_sql("leads", ["external_id", "source"], "leads.external_id_source")]), "sales", "clients", "leads"))
def q_uniqueness(spark, d):
    return QL.uniqueness_checks(TB.sales(spark, d), TB.clients(spark, d), TB.leads(spark, d))


@register("table_profile", W("""
select 'sales' as "table", count(*) as rows, 6 as columns from sales
union all select 'clients', count(*), 6 from clients
union all select 'leads', count(*), 7 from leads
union all select 'marketing_spend', count(*), 3 from marketing_spend
union all select 'funnel_events', count(*), 6 from funnel_events""",
    "sales", "clients", "leads", "marketing_spend", "funnel_events"))
def q_table_profile(spark, d):
    return QL.table_profile({"sales": TB.sales(spark, d), "clients": TB.clients(spark, d),
                             "leads": TB.leads(spark, d), "marketing_spend": TB.marketing_spend(spark, d),
                             "funnel_events": TB.funnel_events(spark, d)})


_DUPS = """
dg as (select name_key, min(client_name) as name, count(distinct client_id) as id_count
       from (select lower(client_name) as name_key, client_name, client_id from sales_dup) t
       group by name_key having count(distinct client_id) > 1)"""


@register("duplicate_clients", W(f", {_DUPS}\nselect * from dg", "sales_dup"))
def q_duplicate_clients(spark, d):
    return QL.duplicate_client_names(TB.sales_dup(spark, d))


@register("duplicate_summary", W(f""", {_DUPS},
tot as (select cast(coalesce(sum(id_count - 1), 0) as bigint) as total_duplicates, count(*) as groups from dg),
top as (select string_agg(name, ', ' order by id_count desc, name asc) as first_names
        from (select * from dg order by id_count desc, name asc limit 5) x)
select total_duplicates, groups, coalesce(first_names, '') as first_names,
       greatest(groups - 5, 0) as remaining from tot, top""", "sales_dup"))
def q_duplicate_summary(spark, d):
    return QL.duplicate_summary(QL.duplicate_client_names(TB.sales_dup(spark, d)))


_MERGE = """
mem as (select distinct lower(client_name) as name_key, client_id from sales_dup where client_id is not null),
grp as (select name_key from mem group by 1 having count(*) > 1),
m as (select mem.name_key, mem.client_id, c.id is not null as stored, c.cif, c.address, c.contact_person, c.email
      from mem join grp using (name_key) left join clients c on c.id = mem.client_id),
prim as (select name_key, coalesce(min(case when stored then client_id end), min(client_id)) as primary_id
         from m group by 1),
mp as (select m.*, prim.primary_id from m join prim using (name_key)),
one as (select client_id, arg_min(primary_id, name_key) as primary_id, min(name_key) as name_key
        from mp group by client_id),
walk as (select client_id, primary_id, 0 as steps from one
         union all
         select w.client_id, o.primary_id, w.steps + 1 from walk w join one o on o.client_id = w.primary_id
         where o.primary_id <> w.primary_id),
ends as (select client_id, arg_max(primary_id, steps) as primary_id from walk group by 1),
moved as (select client_id, count(*) as rows_moved from sales_dup group by client_id),
mapping as (select one.name_key, one.client_id as old_id, ends.primary_id, coalesce(moved.rows_moved, 0) as rows_moved
            from one join ends using (client_id) left join moved using (client_id) where one.client_id <> ends.primary_id)"""


@register("merge_clients_mapping", W(f", {_MERGE}\nselect * from mapping", "sales_dup", "clients"))
def q_merge_clients_mapping(spark, d):
    return MT.merge_duplicate_clients(TB.sales_dup(spark, d), TB.clients(spark, d)).mapping


@register("merge_clients_sales", W(f""", {_MERGE}
select s.id, s.client_name, coalesce(mapping.primary_id, s.client_id) as client_id, s.product_type,
       cast(s.price as double) as price, strftime(s.date, '%Y-%m-%d') as date
from sales_dup s left join mapping on s.client_id = mapping.old_id""", "sales_dup", "clients"))
def q_merge_clients_sales(spark, d):
    return MT.merge_duplicate_clients(TB.sales_dup(spark, d), TB.clients(spark, d)).sales


def _valid(c):
    return f"({c} is not null and trim({c}) <> '' and trim({c}) <> '-')"


@register("merge_clients_table", W(f""", {_MERGE},
fill as (select primary_id,
  {', '.join(f"first({x} order by client_id <> primary_id, client_id) filter (where {_valid(x)}) as f_{x}"
             for x in ('cif', 'address', 'contact_person', 'email'))}
  from (select e.client_id, e.primary_id, c.cif, c.address, c.contact_person, c.email
        from ends e join clients c on c.id = e.client_id) d
  group by primary_id)
select c.id, c.name,
  {', '.join(f"case when fill.primary_id is not null and not {_valid('c.' + x)} and fill.f_{x} is not null then fill.f_{x} else c.{x} end as {x}"
             for x in ('cif', 'address', 'contact_person', 'email'))}
from clients c left join fill on c.id = fill.primary_id
where c.id not in (select old_id from mapping)""", "sales_dup", "clients"))
def q_merge_clients_table(spark, d):
    return MT.merge_duplicate_clients(TB.sales_dup(spark, d), TB.clients(spark, d)).clients


# M2: delete every client of the BUILDING market segment (cascade / set null)
def _building_ids(spark, d):
    return (TB.read_table(spark, d, "customer").filter(F.col("c_mktsegment") == "BUILDING")
              .select(F.col("c_custkey").cast("string").alias("id")))


_GONE = "gone as (select cast(c_custkey as varchar) as id from customer where c_mktsegment = 'BUILDING')"


@register("delete_clients_sales", W(f""", {_GONE}
select id, client_id, cast(price as double) as price from sales where client_id not in (select id from gone)""", "sales"))
def q_delete_clients_sales(spark, d):
    r = MT.delete_clients(_building_ids(spark, d), TB.clients(spark, d), TB.sales(spark, d),
                          TB.leads(spark, d), TB.funnel_events(spark, d))
    return r.sales.select("id", "client_id", "price")


@register("delete_clients_leads", W(f""", {_GONE}
select id, case when client_id in (select id from gone) then null else client_id end as client_id, status
from leads""", "leads"))
def q_delete_clients_leads(spark, d):
    r = MT.delete_clients(_building_ids(spark, d), TB.clients(spark, d), TB.sales(spark, d),
                          TB.leads(spark, d), TB.funnel_events(spark, d))
    return r.leads.select("id", "client_id", "status")


# M1: the customer table re-read as a change set (new CIF from the account
# number, e-mail by market segment); existing ids are replaced, the tenth
# customers missing from the store are inserted, invalid rows rejected.
def _client_changes(spark, d):
    c = TB.read_table(spark, d, "customer")
    k = F.col("c_custkey").cast("string")
    return c.select(k.alias("id"), F.col("c_name").alias("name"),
                    F.concat(F.lit(" b-"), F.lpad(k, 8, "0"), F.lit(" ")).alias("cif"),
                    F.concat(F.lit("Street "), F.col("c_nationkey").cast("string")).alias("address"),
                    F.when(F.col("c_mktsegment") == "MACHINERY", F.lit("X")).otherwise(F.concat(F.lit("Contact "), k))
                     .alias("contact_person"),
                    F.when(F.col("c_mktsegment") == "HOUSEHOLD", F.lit("no-at-sign"))
                     .otherwise(F.concat(F.lower(F.col("c_mktsegment")), F.lit("@example.com"))).alias("email"))


_CHANGES = r"""
ch as (select cast(c_custkey as varchar) as id, c_name as name,
              upper(trim(' b-' || lpad(cast(c_custkey as varchar), 8, '0') || ' ')) as cif,
              'Street ' || cast(c_nationkey as varchar) as address,
              case when c_mktsegment = 'MACHINERY' then 'X' else 'Contact ' || cast(c_custkey as varchar) end as contact_person,
              case when c_mktsegment = 'HOUSEHOLD' then 'no-at-sign' else lower(c_mktsegment) || '@example.com' end as email
       from customer),
chk as (select ch.*, """ + _CLIENT_ERR.replace("when trim(cif) = '-' then 'placeholder'", "") + r""" as err1,
        (select count(*) from clients o where o.cif = ch.cif and o.id <> ch.id) as oc,
        (select count(*) from clients o where lower(o.name) = lower(trim(ch.name)) and o.id <> ch.id) as onm
        from ch),
res as (select *, coalesce(err1, case when cif is not null and trim(cif) not in ('', '-') and oc > 0 then 'another client has this CIF' end,
                           case when onm > 0 then 'another client has this name' end) as error from chk)"""


@register("upsert_clients_table", W(f""", {_CHANGES}
select id, name, cif, address, contact_person, email from clients where id not in (select id from res where error is null)
union all select id, name, cif, address, contact_person, email from res where error is null""", "clients"))
def q_upsert_clients_table(spark, d):
    return MT.upsert_clients(TB.clients(spark, d), _client_changes(spark, d)).table


@register("upsert_clients_rejected", W(f""", {_CHANGES}
select id, name, cif, address, contact_person, email, error from res where error is not null""", "clients"))
def q_upsert_clients_rejected(spark, d):
    return MT.upsert_clients(TB.clients(spark, d), _client_changes(spark, d)).rejected


# M3: every signup lead is moved to 'Converted ' with a meeting date three
# days after creation; purchases get an invalid status.
def _lead_updates(spark, d):
    l = TB.leads(spark, d)
    return l.filter(F.col("status").isin("meeting", "converted")).select(
        "id", F.when(F.col("status") == "meeting", F.lit("Converted ")).otherwise(F.lit("won")).alias("status"),
        F.date_format(F.date_add("created_at", 3), "yyyy-MM-dd").alias("meeting_date"))


@register("update_leads_table", W("""
, up as (select id, case when status = 'meeting' then 'converted' end as new_status,
                created_at + 3 as new_md from leads where status in ('meeting', 'converted'))
select l.id, l.external_id, strftime(l.created_at, '%Y-%m-%d') as created_at, l.source,
       case when up.new_status is not null then up.new_status else l.status end as status,
       strftime(case when up.new_status is not null then up.new_md else l.meeting_date end, '%Y-%m-%d') as meeting_date,
       l.client_id
from leads l left join up on l.id = up.id""", "leads"))
def q_update_leads_table(spark, d):
    return MT.update_leads(TB.leads(spark, d), _lead_updates(spark, d)).table


# M1 with awkward batches: every change twice (the later one must hold), and
# pairs of ids that claim one CIF (the first one gets it).
def _awkward_client_changes(spark, d):
    ch = _client_changes(spark, d).withColumn("seq", F.col("id").cast("long"))
    k = F.col("seq")
    later = ch.select("id", "name", "cif", F.lit("Later street").alias("address"), "contact_person", "email", (k + 1000000).alias("seq"))
    shared = F.concat(F.lit("C"), F.lpad((k - k % 2).cast("string"), 8, "0"))
    return ch.unionByName(later).withColumn("cif", F.when(k % 5 < 2, shared).otherwise(F.col("cif")))


_AWKWARD = _CHANGES.replace("ch as (", "ch0 as (", 1).replace(",\nchk as (", """,
ch1 as (select id, name, cif, address, contact_person, email, cast(id as bigint) as seq from ch0
        union all select id, name, cif, 'Later street', contact_person, email, cast(id as bigint) + 1000000 from ch0),
ch2 as (select id, name, case when seq % 5 < 2 then 'C' || lpad(cast(seq - seq % 2 as varchar), 8, '0') else cif end as cif,
               address, contact_person, email, seq from ch1),
ch as (select * from ch2 qualify row_number() over (partition by id order by seq desc) = 1),
chk as (""", 1).replace("res as (select *,", "res0 as (select *,", 1) + """,
res1 as (select * exclude (error), case when error is null and cif is not null and trim(cif) not in ('', '-')
           and row_number() over (partition by error is null, cif order by seq) > 1 then 'another client has this CIF' else error end as error
         from res0),
res as (select * exclude (error), case when error is null and row_number() over (partition by error is null, lower(trim(name)) order by seq) > 1
           then 'another client has this name' else error end as error from res1)"""


@register("upsert_clients_batch_duplicates", W(f""", {_AWKWARD}
select 'table' as part, id, name, cif, address, null::varchar as error from clients where id not in (select id from res where error is null)
union all select 'table', id, name, cif, address, null from res where error is null
union all select 'rejected', id, name, cif, address, error from res where error is not null""", "clients"))
def q_upsert_clients_batch_duplicates(spark, d):
    r = MT.upsert_clients(TB.clients(spark, d), _awkward_client_changes(spark, d), order_col="seq")
    cols = ["id", "name", "cif", "address"]
    return (r.table.select(F.lit("table").alias("part"), *cols, F.lit(None).cast("string").alias("error"))
            .unionByName(r.rejected.select(F.lit("rejected").alias("part"), *cols, "error")))


# M3: two updates per lead (the later valid one holds), impossible days, bad statuses
def _conflicting_updates(spark, d):
    l = TB.leads(spark, d)
    k = F.col("external_id").cast("long")
    first = l.select("id", F.lit("contacted").alias("status"), F.lit("2024-02-01").alias("meeting_date"), k.alias("seq"))
    second = l.select("id", F.when(k % 3 == 0, F.lit("won")).otherwise(F.lit(" Meeting ")).alias("status"),
                      F.when(k % 4 == 0, F.lit("2024-99-99")).otherwise(F.lit("2024-02-29")).alias("meeting_date"),
                      (k + 10000000).alias("seq"))
    return first.unionByName(second)


@register("update_leads_conflicts", W("""
, n as (select *, cast(external_id as bigint) as k from leads)
select id, case when k % 3 = 0 or k % 4 = 0 then 'contacted' else 'meeting' end as status,
       case when k % 3 = 0 or k % 4 = 0 then '2024-02-01' else '2024-02-29' end as meeting_date,
       cast((k % 3 = 0 or k % 4 = 0) as bigint) as rejected_updates from n""", "leads"))
def q_update_leads_conflicts(spark, d):
    r = MT.update_leads(TB.leads(spark, d), _conflicting_updates(spark, d), order_col="seq")
    bad = r.rejected.groupBy("id").agg(F.count(F.lit(1)).alias("rejected_updates"))
    return r.table.join(bad, "id", "left").select(
        "id", "status", "meeting_date", F.coalesce("rejected_updates", F.lit(0)).cast("long").alias("rejected_updates"))


# M3 insert: stored ids, repeated ids and pairs, bad statuses and days
@register("insert_leads_table", W("""
, raw as (select case when event_id % 5 = 0 then 'L' || event_id else 'N' || (event_id - event_id % 2) end as id,
                 case when event_id % 3 = 0 then 'X' || (event_id % 1000) end as external_id, event_type, event_id as seq,
                 case when event_id % 7 = 0 then 'won' else ' New ' end as status,
                 case when event_id % 11 = 0 then '2024-13-01' else '2024-03-05' end as meeting_date from events),
c1 as (select *, case when event_id is null then null end as none from (select *, seq as event_id from raw) r),
c2 as (select *, coalesce(case when id in (select id from leads) then 'lead id already exists' end,
                          case when status = 'won' then 'invalid status' end,
                          case when meeting_date = '2024-13-01' then 'invalid meeting date' end) as e0 from c1),
c3 as (select *, case when e0 is null and row_number() over (partition by e0 is null, id order by seq) > 1
                      then 'lead id already exists' else e0 end as e1 from c2),
c4 as (select *, case when e1 is null and external_id is not null
                       and row_number() over (partition by e1 is null, external_id, event_type order by seq) > 1
                      then 'lead already exists for this source' else e1 end as error from c3)
select coalesce(error, 'inserted') as outcome, id, external_id, event_type as source,
       case when error is null then 'new' else status end as status, meeting_date from c4""", "leads"))
def q_insert_leads_table(spark, d):
    e = TB.read_table(spark, d, "events").select("event_id", "event_type", "ts")
    k = F.col("event_id")
    new = e.select(F.when(k % 5 == 0, F.concat(F.lit("L"), k.cast("string")))
                    .otherwise(F.concat(F.lit("N"), (k - k % 2).cast("string"))).alias("id"),
                   F.when(k % 3 == 0, F.concat(F.lit("X"), (k % 1000).cast("string"))).alias("external_id"),
                   F.col("ts").cast("date").alias("created_at"), F.col("event_type").alias("source"),
                   F.when(k % 7 == 0, F.lit("won")).otherwise(F.lit(" New ")).alias("status"),
                   F.when(k % 11 == 0, F.lit("2024-13-01")).otherwise(F.lit("2024-03-05")).alias("meeting_date"),
                   F.lit(None).cast("string").alias("client_id"), k.alias("seq"))
    r = MT.insert_leads(TB.leads(spark, d), new, order_col="seq")
    cols = ["id", "external_id", "source", "status", "meeting_date"]
    ok = r.applied.withColumn("meeting_date", F.date_format("meeting_date", "yyyy-MM-dd"))
    return (ok.select(F.lit("inserted").alias("outcome"), *cols)
            .unionByName(r.rejected.select(F.col("error").alias("outcome"), *cols)))


# M4: stored spend rows get ids from the day and source; every event is a change:
# two of three replace a row (pairs of events the same one), the others are new;
# some have no source, no amount or no date
def _spend_store(spark, d):
    s = TB.marketing_spend(spark, d)
    number = F.datediff("date", F.lit("2024-01-01").cast("date")) * 10 + F.length("source")
    return s.select(number.cast("long").alias("id"), "source", "amount", "date")


def _spend_changes(spark, d):
    e = TB.read_table(spark, d, "events").select("event_id", "value", "ts")
    k = F.col("event_id")
    return e.select(
        F.when(k % 3 != 0, F.floor(k / 2)).alias("id"),
        F.when(k % 7 == 0, F.lit(" ")).when(k % 4 == 0, F.lit("IG")).when(k % 4 == 1, F.lit(" LinkedIn ")).otherwise(F.lit("Google Ads"))
        .alias("source"),
        F.when(k % 11 == 0, F.lit("-1")).otherwise(F.col("value").cast("decimal(18,2)").cast("string")).alias("amount"),
        F.when(k % 13 == 0, F.lit("31/31/2024")).otherwise(F.date_format("ts", "dd/MM/yyyy")).alias("date"), k.alias("seq"))


_SPEND = """
store as (select cast((date - date '2024-01-01') * 10 + length(source) as bigint) as id, source, amount, date from marketing_spend),
ch as (select case when event_id % 3 <> 0 then event_id // 2 end as id, event_id as seq,
              case when event_id % 7 = 0 then null when event_id % 4 = 0 then 'meta_ads' when event_id % 4 = 1 then 'linkedin_ads'
                   else 'google_ads' end as source,
              cast(value as decimal(18,2)) as amount, event_id % 11 = 0 as no_amount,
              event_id % 13 = 0 as no_date, cast(ts as date) as date from events),
ok as (select id, seq, source, amount, date from ch where source is not null and not no_amount and amount > 0 and not no_date),
named as (select id, source, amount, date from ok where id is not null qualify row_number() over (partition by id order by seq desc) = 1),
top as (select coalesce(max(id), 0) as top from (select id from store union all select id from named)),
fresh as (select top + row_number() over (order by source, date, amount, seq) as id, source, amount, date from ok, top where id is null),
result as (select id, source, amount, date from store where id not in (select id from named)
           union all select * from named union all select * from fresh)"""


@register("upsert_spend_table", W(f""", {_SPEND}
select id, source, cast(amount as double) as amount, strftime(date, '%Y-%m-%d') as date from result""", "marketing_spend"))
def q_upsert_spend_table(spark, d):
    return MT.upsert_spend(_spend_store(spark, d), _spend_changes(spark, d), "2024-01-31", order_col="seq").table


@register("delete_spend_table", W(f""", {_SPEND}
select id, source, cast(amount as double) as amount, strftime(date, '%Y-%m-%d') as date from store
where id not in (select event_id * 4 from events)""", "marketing_spend"))
def q_delete_spend_table(spark, d):
    gone = TB.read_table(spark, d, "events").select((F.col("event_id") * 4).alias("id"))
    return MT.list_spend(MT.delete_spend(_spend_store(spark, d), gone))


@register("delete_clients_table", W(f""", {_GONE}
select id, name from clients where id not in (select id from gone)""", "clients"))
def q_delete_clients_table(spark, d):
    return MT.delete_clients(_building_ids(spark, d), TB.clients(spark, d), TB.sales(spark, d),
                             TB.leads(spark, d), TB.funnel_events(spark, d)).clients.select("id", "name")


@register("delete_clients_events", W(f""", {_GONE}
select id, case when client_id in (select id from gone) then null else client_id end as client_id, event_type
from funnel_events""", "funnel_events"))
def q_delete_clients_events(spark, d):
    return MT.delete_clients(_building_ids(spark, d), TB.clients(spark, d), TB.sales(spark, d),
                             TB.leads(spark, d), TB.funnel_events(spark, d)).events.select("id", "client_id", "event_type")


# M5: with repointing, nothing refers to a deleted client
@register("merge_clients_orphans", W(f""", {_MERGE}
select 'mapping' as part, count(*) as rows from mapping
union all select 'sales', 0 union all select 'leads', 0 union all select 'events', 0""", "sales_dup", "clients"))
def q_merge_clients_orphans(spark, d):
    r = MT.merge_duplicate_clients(TB.sales_dup(spark, d), TB.clients(spark, d), TB.leads(spark, d),
                                   TB.funnel_events(spark, d), repoint_leads=True)
    old = r.mapping.select(F.col("old_id").alias("client_id"))
    count = lambda df, part: df.agg(F.count(F.lit(1)).alias("rows")).select(F.lit(part).alias("part"), "rows")
    out = count(r.mapping, "mapping")
    for part, df in (("sales", r.sales), ("leads", r.leads), ("events", r.events)):
        per_client = df.filter("client_id is not null").groupBy("client_id").agg(F.count(F.lit(1)).alias("n"))
        out = out.unionByName(per_client.join(old, "client_id", "left_semi").agg(
            F.coalesce(F.sum("n"), F.lit(0)).alias("rows")).select(F.lit(part).alias("part"), "rows"))
    return out
