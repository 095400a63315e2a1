"""Registered queries over written forms of the data: records of files with
quoted line breaks, the daily store and staged imports, with their oracles."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import functions as F

from ..operators import clients as CL
from ..operators import collated as CO
from ..operators import daily as DY
from ..operators import evolution as EV
from ..operators import ingest as I
from ..operators import quality as QL
from ..operators import leads as L
from ..operators import sales as S
from ..operators.filters import lead_multi_filter, lead_search_text
from ..session import checkpoint_dir
from ..sources import bucketed as BK
from ..sources import clustered as CS
from ..sources import delimited as DL
from ..sources import quoted as QD
from ..sources import sinks as SK
from ..sources import tables as TB
from ..sources import trigrams as TG
from . import periods as P
from . import snapshot as SN
from .oracle_views import with_views as W
from .queries_compare import _NEXT_SQL, _START_SQL, A2, B2, SALES_AS_OF, _inab, _points_sql
from .queries_core import _KEY_SQL, _LABEL_SQL
from .queries_leads import _ENRICHED
from .queries_ingest import _SALES_CHECKED, AS_OF, _date_err, _req
from .registry import ORACLE, register


# Files with quoted line breaks, split inside records
@register("quoted_records", """
select 'export-' || event_id % 3 || '.csv' as file,
       row_number() over (partition by event_id % 3 order by event_id) + 1 as row_no,
       cast(event_id as varchar) as id, 'User "' || user_id || '";' || event_type as client,
       case event_id % 4 when 0 then event_type when 1 then 'first' || chr(10) || 'second;' || chr(10) || chr(10) || '"fourth" line'
            when 3 then 'props:' || chr(10) || props end as note,
       case when event_id % 6 = 0 then '5" pipe' else cast(user_id as varchar) end as size
from events""")
def q_quoted_records(spark, d):
    records, _ = QD.assemble_records(TB.quoted_lines(spark, d), ";")
    return QD.parse_records(records, ["id", "client", "note", "size"], ";").withColumnRenamed("_file", "file")


# Daily series with exact client bitmaps, stored once and rolled up
def _clients_sql(g: str) -> str:
    return W(f"""
select {_KEY_SQL[g]} as key, min({_LABEL_SQL[g]}) as label, cast(sum(price) as double) as total, count(*) as transactions,
       count(distinct coalesce(client_id, client_name)) as unique_clients
from sales group by 1""", "sales")


@register("daily_clients_week", _clients_sql("week"))
def q_daily_clients_week(spark, d):
    return DY.daily_evolution(DY.build_daily(TB.sales(spark, d)), "week")


@register("daily_clients_quarter_appended", _clients_sql("quarter"))
def q_daily_clients_quarter_appended(spark, d):
    """The store of the sales before 1996, the rest appended."""
    sales, early = TB.sales(spark, d), F.col("date") < F.lit("1996-01-01").cast("date")
    path = f"{checkpoint_dir(spark).rstrip('/')}/salescope-daily-{uuid.uuid4().hex}"
    DY.build_daily(sales.filter(early), path)
    store = DY.append_daily(DY.read_daily(spark, path), sales.filter(~early), path)
    return DY.daily_evolution(store, "quarter")


@register("daily_clients_by_period", ORACLE["sales_by_period"])
def q_daily_clients_by_period(spark, d):
    return DY.daily_period_metrics(DY.build_daily(TB.sales(spark, d)), P.named_periods(spark, SALES_AS_OF), "period")


@register("daily_unique_clients", W("""
select count(distinct coalesce(client_id, client_name)) as unique_clients from sales
where date between date '1996-01-01' and date '1996-12-31'""", "sales"))
def q_daily_unique_clients(spark, d):
    return DY.daily_unique_clients(DY.build_daily(TB.sales(spark, d)), A2)


@register("daily_regroup_quarter", _points_sql(A2, B2, "quarter"))
def q_daily_regroup_quarter(spark, d):
    store = DY.build_daily(TB.sales(spark, d))
    return EV.regroup_comparison(DY.stored_daily_ab(store, A2, B2), "day", "quarter", A2, B2)


@register("daily_product_summary", W("""
select product_type, count(*) as quantity, cast(sum(price) as double) as total_sales,
       cast(sum(price) as double) / count(*) as avg_price, cast(min(price) as double) as min_price,
       cast(max(price) as double) as max_price
from sales where date between date '1996-01-01' and date '1996-12-31' group by 1""", "sales"))
def q_daily_product_summary(spark, d):
    return DY.daily_summary(DY.build_daily(TB.sales(spark, d)), A2)


# The daily series of one period, from the period's own pre-aggregate
@register("period_daily_series", W("""
select strftime(date, '%Y-%m-%d') as key, cast(sum(price) as double) as total, count(*) as transactions
from sales where date between date '1996-01-01' and date '1996-12-31' group by 1""", "sales"))
def q_period_daily_series(spark, d):
    return SN.period_data(TB.sales(spark, d), A2, "month").daily.select(
        F.date_format("date", "yyyy-MM-dd").alias("key"), F.col("amt").cast("double").alias("total"), F.col("n").alias("transactions"))


# I7, I8, I13, I14 as one unit: the raw rows in two imports, the second one run twice
@register("import_unit_log", W(f""", {_SALES_CHECKED}
select case when row_no % 3 = 0 then 'first' else 'second' end as import_id,
       case when row_no % 3 = 0 then 'a.csv' else 'b.csv' end as file_name, count(*) as total_rows,
       count(*) - count(error) as valid_rows, count(error) as rejected_rows
from chk group by 1, 2""", "raw_sales"))
def q_import_unit_log(spark, d):
    return SK.committed(spark, _two_imports(spark, d), "log", SK.LOG_STORE).select(
        "import_id", "file_name", "total_rows", "valid_rows", "rejected_rows")


@register("import_unit_clients", W(f""", {_SALES_CHECKED},
v as (select row_no, row_no % 3 <> 0 as second, trim(client_name) as client_name, trim(client_id) as client_id
      from chk where error is null),
f as (select client_id, second, arg_min(client_name, row_no) as name from v group by 1, 2)
select case when second then 'second' else 'first' end as import_id, client_id as id, name from f
where client_id not in (select id from clients)
  and (not second or client_id not in (select client_id from f where not second))""", "raw_sales", "clients"))
def q_import_unit_clients(spark, d):
    """Each import's new clients: those of the first are known to the second."""
    root = _two_imports(spark, d)
    return SK.committed(spark, root, "clients", SK.CLIENTS_STORE).select("import_id", "id", "name")


@register("import_unit_rejects", W(f""", {_SALES_CHECKED}
select case when row_no % 3 = 0 then 'first' else 'second' end as import_id, row_no, error, client_id, price, date
from chk where error is not null""", "raw_sales"))
def q_import_unit_rejects(spark, d):
    """The reject report of every import, with the rows as they came."""
    schema = "row_no long, error string, client_name string, client_id string, product_type string, price string, date string"
    return SK.committed(spark, _two_imports(spark, d), "rejects", schema).select(
        "import_id", "row_no", "error", "client_id", "price", "date")


def _two_imports(spark, d) -> str:
    raw, known = TB.raw_sales(spark, d), TB.clients(spark, d)
    root = f"{checkpoint_dir(spark).rstrip('/')}/salescope-imports-{uuid.uuid4().hex}"
    first = F.col("row_no") % 3 == 0
    SK.run_sales_import(raw.filter(first), root, "first", AS_OF, "a.csv", known)
    for _ in range(2):
        SK.run_sales_import(raw.filter(~first), root, "second", AS_OF, "b.csv", known)
    return root


_MIXED_CHECKED = (_SALES_CHECKED.replace("raw_sales", "raw_mixed") + f""",
lchk as (select *, coalesce({_date_err('created_at')}, {_req('source', 'source')}) as error from raw_mixed)""")


# Rows of a mixed file by the rule sets that they pass, and what is reported
@register("ingest_mixed_classes", W(f""", {_MIXED_CHECKED}
select case when s.error is null and l.error is null then 'both' when s.error is null then 'sales'
            when l.error is null then 'leads' else 'neither' end as row_class, count(*) as rows,
       count(s.error) as sales_errors, count(l.error) as leads_errors
from chk s join lchk l using (row_no) group by 1""", "raw_mixed"))
def q_ingest_mixed_classes(spark, d):
    r = I.import_mixed(TB.raw_mixed(spark, d), TB.leads(spark, d), TB.clients(spark, d), AS_OF)
    g = r["staged"].groupBy("row_class").agg(F.count(F.lit(1)).alias("rows"), F.count("sales_error").alias("sales_errors"),
                                             F.count("leads_error").alias("leads_errors"))
    return g


@register("ingest_mixed_report", W(f""", {_MIXED_CHECKED}
select 'sales' as kind, row_no, error from chk where error is not null
union all select 'leads', row_no, error from lchk where error is not null""", "raw_mixed"))
def q_ingest_mixed_report(spark, d):
    """There are errors, so only errors are reported."""
    return I.import_mixed(TB.raw_mixed(spark, d), TB.leads(spark, d), TB.clients(spark, d), AS_OF)["report"]


# One snapshot per product and grouping, all valid ones and ones broken by rule
def _next_sql(g: str) -> str:
    return _NEXT_SQL[g].replace("s +", f"cast({_START_SQL[g]} as date) +", 1)


_IN_A, _IN_B = _inab(A2, B2)
_GROUPED = " union all ".join(f"""
  select product_type, '{g}' as grouping, cast({_START_SQL[g]} as date) as s, {_KEY_SQL[g]} as key,
         cast({_next_sql(g)} as timestamp) as n,
         sum(case when {_IN_A} then price end) as a, sum(case when {_IN_B} then price end) as b
  from sales where {_IN_A} or {_IN_B} group by all""" for g in ("day", "week", "month", "quarter", "year"))


@register("snapshot_violations", W(f"""
, b as ({_GROUPED}),
r as (select *, length(product_type) as len, row_number() over (partition by product_type, grouping order by s) - 1 as pos from b),
p as (select product_type, grouping, len, pos, cast(s as timestamp) as start,
             case when (pos + len) % 13 = 0 then key || 'x' when (pos + len) % 17 = 0 and pos > 0 then lag(key) over w else key end as key,
             case when (pos + len) % 7 = 0 then cast(s as timestamp) when (pos + len) % 11 = 0 then n + interval 40 day
                  else n - interval 1 microsecond end as "end",
             (pos + len) % 5 = 0 as wrong
      from r window w as (partition by product_type, grouping order by s)),
l as (select *, lag(key) over w as pk, lag("end") over w as pe from p window w as (partition by product_type, grouping order by pos)),
snap as (select distinct product_type, grouping, length(product_type) as len from b),
v as (select product_type, grouping, key, 'bad_key_format' as violation from l where (pos + len) % 13 = 0
      union all select product_type, grouping, key, 'start_not_before_end' from l where not start < "end"
      union all select product_type, grouping, key, 'difference_mismatch' from l where wrong
      union all select product_type, grouping, key, 'keys_not_increasing' from l where pk is not null and key <= pk
      union all select product_type, grouping, key, 'overlapping_intervals' from l where pe is not null and start < pe
      union all select product_type, grouping, null, 'missing_period_b' from snap where len % 10 = 1
      union all select product_type, grouping, null, 'grouping_mismatch' from snap where len % 10 = 2 and grouping <> 'year'
      union all select product_type, grouping, null, x from snap, (values ('period_b_in_normal_mode'), ('comparison_in_normal_mode')) t(x)
                where len % 10 = 3
      union all select product_type, grouping, null, 'unknown_mode' from snap where len % 10 = 4)
select * from v""", "sales"))
def q_snapshot_violations(spark, d):
    snaps = SN.product_snapshots(TB.sales(spark, d), A2, B2)
    n = F.length("product_type")

    def broken(p, i):
        points, k = F.col("comparison.evolution.points"), i + n
        key = (F.when(k % 13 == 0, F.concat(p.key, F.lit("x"))).when((k % 17 == 0) & (i > 0), F.get(points, i - 1).key)
               .otherwise(p.key))
        end = F.when(k % 7 == 0, p.start).when(k % 11 == 0, p.end + F.expr("INTERVAL 40 DAYS 1 MICROSECOND")).otherwise(p.end)
        wrong = F.when(k % 5 == 0, p.difference + 1).otherwise(p.difference)
        return F.struct(key.alias("key"), p.start.alias("start"), end.alias("end"), p.value_a.alias("value_a"),
                        p.value_b.alias("value_b"), wrong.alias("difference"))

    points = F.transform("comparison.evolution.points", broken)
    period_b = (F.when(n % 10 == 1, F.lit(None)).when(n % 10 == 2, F.col("period_b").withField("grouping", F.lit("year")))
                .otherwise(F.col("period_b")))
    snaps = snaps.select("product_type", "grouping", F.when(n % 10 == 3, "normal").when(n % 10 == 4, "old").otherwise(F.col("mode")).alias("mode"),
                         "period_a", period_b.alias("period_b"), F.struct(F.struct(points.alias("points")).alias("evolution")).alias("comparison"))
    return SN.validate_snapshot(snaps, by=["product_type", "grouping"])


@register("product_snapshots_valid", W(f"""
, b as ({_GROUPED})
select product_type, grouping, count(*) as points, cast(sum(a) as double) as total_a, cast(sum(b) as double) as total_b, 0 as violations
from b group by 1, 2""", "sales"))
def q_product_snapshots_valid(spark, d):
    snaps = SN.product_snapshots(TB.sales(spark, d), A2, B2)
    points = F.col("comparison.evolution.points")
    return snaps.select("product_type", "grouping", F.size(points).alias("points"),
                        F.when(F.col("period_a.transactions") > 0, F.col("period_a.total_sales")).alias("total_a"),
                        F.when(F.col("period_b.transactions") > 0, F.col("period_b.total_sales")).alias("total_b"),
                        F.size(SN.point_violations(points, F.col("grouping"))).cast("long").alias("violations"))


# Filters by product, client or date over the Z-ordered store
def _clustered(spark, d):
    path = f"{checkpoint_dir(spark).rstrip('/')}/salescope-clustered-{uuid.uuid4().hex}"
    return CS.read_clustered(spark, CS.write_clustered(TB.sales(spark, d), path))


@register("clustered_product_year", W("""
select product_type, cast(sum(price) as double) as total_sales, count(*) as quantity
from sales where date between date '1996-01-01' and date '1996-12-31' group by 1""", "sales"))
def q_clustered_product_year(spark, d):
    return S.product_year_report(_clustered(spark, d), 1996)


@register("clustered_last_sales", W("""
select * from (select client_id, id, product_type, cast(price as double) as price, strftime(date, '%Y-%m-%d') as date,
                      row_number() over (partition by client_id order by date desc, id desc) as rank
               from sales where client_id in ('1', '10', '100')) where rank <= 10""", "sales"))
def q_clustered_last_sales(spark, d):
    one = _clustered(spark, d).filter(F.col("client_id").isin("1", "10", "100"))
    return CL.last_sales_per_client(one, 10).select("client_id", "id", "product_type", "price", "date", "rank")


# Columns and FK edges of the business tables, each table read once
_PROFILED = {"sales": ["id", "client_name", "client_id", "product_type", "price", "date"],
             "clients": ["id", "name", "cif", "address", "contact_person", "email"],
             "leads": ["id", "external_id", "created_at", "source", "status", "meeting_date", "client_id"],
             "marketing_spend": ["source", "date", "amount"],
             "funnel_events": ["id", "client_id", "lead_id", "event_type", "event_date", "metadata"]}


@register("column_profile", W(" union all ".join(
    f"""select '{t}' as "table", '{c}' as "column", count(*) as rows, count(*) - count({c}) as nulls,
        count(distinct {c}) as distinct_values, cast(min({c}) as varchar) as min_value, cast(max({c}) as varchar) as max_value from {t}"""
    for t, columns in _PROFILED.items() for c in columns), *_PROFILED))
def q_column_profile(spark, d):
    return QL.column_profile(QL.value_counts({t: TB.TABLES[t](spark, d) for t in _PROFILED}))


@register("foreign_key_profile", W(" union all ".join(
    f"""select '{t}' as "table", '{c}' as "column", '{p}' as parent, '{pc}' as parent_column, count(*) as rows,
        count(*) - count({c}) as without, count(distinct case when {c} not in (select {pc} from {p}) then {c} end) as orphan_values,
        count(case when {c} not in (select {pc} from {p}) then 1 end) as orphan_rows from {t}"""
    for t, c, p, pc in QL.FOREIGN_KEYS), "sales", "clients", "leads", "funnel_events"))
def q_foreign_key_profile(spark, d):
    tables = {t: TB.TABLES[t](spark, d) for t in ("sales", "clients", "leads", "funnel_events")}
    return QL.foreign_key_profile(QL.value_counts(tables), QL.FOREIGN_KEYS)


@register("latest_sales", W("""
select id, client_id, cast(price as double) as price, strftime(date, '%Y-%m-%d') as date from sales order by sales.date desc, id desc limit 3""", "sales"))
def q_latest_sales(spark, d):
    return QL.latest_rows({"sales": (TB.sales(spark, d), ["date", "id"])})["sales"].select("id", "client_id", "price", "date")


# Header lines of files by rule (delimiter, quoting, spelling, byte-order mark), one per event
@register("classify_headers", """
select 'file-' || event_id as file,
       case event_id % 4 when 0 then ',' when 1 then ';' when 2 then chr(9) else '|' end as delimiter,
       case event_id % 6 when 0 then 'sales' when 1 then 'leads' when 2 then 'marketing_spend' when 3 then 'mixed'
            when 4 then 'invalid' else 'invalid' end as detected_type,
       case event_id % 6 when 0 then '' when 1 then 'client_name, price, product_type' when 2 then 'client_id, client_name, price, product_type'
            when 3 then '' when 4 then 'client_id, product_type' else 'client_id, client_name, price, product_type' end as missing_sales,
       case event_id % 6 when 0 then 4 when 1 then 3 when 2 then 3 when 3 then 6 when 4 then 2 else 2 end as cells
from events""")
def q_classify_headers(spark, d):
    c = DL.classify_lines(TB.header_lines(spark, d))
    return c.select("file", "delimiter", "detected_type", "missing_sales", F.size("headers").alias("cells"))


# True valid and invalid rows of each file
@register("file_valid_counts", W(f""", {_SALES_CHECKED}
select 'file-' || row_no % 7 as file, count(*) as row_count, count(*) - count(error) as valid_rows, count(error) as invalid_rows
from chk group by 1""", "raw_sales"))
def q_file_valid_counts(spark, d):
    raw = TB.raw_sales(spark, d).withColumn("_file", F.concat(F.lit("file-"), (F.col("row_no") % 7).cast("string")))
    return I.file_counts(I.check_sales(raw, AS_OF)).withColumnRenamed("_file", "file")


# substring search over trigram postings; short and absent terms included
_TERMS = ["customer#00000001", "0012", "SUPPLIER", "r#0000000", "9", "77", "no such name", "r%0"]


def _trigram_path(spark) -> str:
    return f"{checkpoint_dir(spark).rstrip('/')}/salescope-trigrams-{uuid.uuid4().hex}"


@register("client_search_indexed", W(f"""
select term, id, name, cif from clients, (values {", ".join(f"('{t}')" for t in _TERMS)}) t(term)
where contains(lower(name), lower(term))""", "clients"))
def q_client_search_indexed(spark, d):
    store = TG.build_trigrams(TB.clients(spark, d), F.col("name"), _trigram_path(spark))
    found = [store.search(t).select(F.lit(t).alias("term"), "id", "name", "cif") for t in _TERMS]
    return reduce(lambda a, b: a.unionByName(b), found)


@register("lead_filter_indexed", W(f"""
select * from ({_ENRICHED}) e
where status <> 'lost' and contains(lower(concat_ws(' ', id, case source when 'meta_ads' then 'Meta Ads' when 'google_ads' then 'Google Ads'
      when 'linkedin_ads' then 'LinkedIn Ads' when 'tiktok_ads' then 'TikTok Ads' when 'manual_import' then 'Manual'
      else coalesce(source, '') end, client_name, coalesce(source, ''))), 'ads customer#0000000')""", "leads", "clients"))
def q_lead_filter_indexed(spark, d):
    e = L.leads_enriched(TB.leads(spark, d), TB.clients(spark, d))
    store = TG.build_trigrams(e, lead_search_text(), _trigram_path(spark))
    return lead_multi_filter(store.search(" Ads Customer#0000000"), AS_OF).filter("status <> 'lost'")


# Tables in buckets of the client id
def _client_store(spark, d):
    return BK.write_buckets(spark, {
        "sales": (TB.sales(spark, d), "client_id"), "clients": (TB.clients(spark, d), "id"),
        "leads": (TB.leads(spark, d), "client_id"), "events": (TB.funnel_events(spark, d), "client_id")})


@register("all_clients_stats_bucketed", ORACLE["all_clients_stats"])
def q_all_clients_stats_bucketed(spark, d):
    return _client_store(spark, d).run(CL.all_clients_stats, "sales", "clients")


@register("client_360_bucketed", ORACLE["client_360"])
def q_client_360_bucketed(spark, d):
    return _client_store(spark, d).run(CL.customer_360, "sales", "clients", "leads", "events")


@register("last_sales_per_client_bucketed", ORACLE["last_sales_per_client"])
def q_last_sales_per_client_bucketed(spark, d):
    return _client_store(spark, d).run(CL.last_sales_per_client, "sales")


# Names of several spellings, compared by collation
_SPELT = """spelt as (
select cast(c_custkey as varchar) as id, case c_custkey % 5 when 0 then 'Société ' when 1 then 'SOCIÉTÉ '
       when 2 then 'Socie' || chr(769) || 'te' || chr(769) || ' ' when 3 then chr(65331) || 'ociété ' else 'Societe ' end
       || (c_custkey * 7 // 2) % 700 as name from customer),
folded as (select *, lower(replace(nfc_normalize(name), chr(65331), 'S')) as k from spelt)"""


@register("same_names_collated", f"""
with {_SPELT}
select min(name) as name, count(*) as n_clients, count(distinct name) as n_spellings, min(id) as first_id
from folded group by k having count(*) > 1""")
def q_same_names_collated(spark, d):
    return CO.same_names(TB.spelt_clients(spark, d))


@register("name_flags_collated", f"""
with {_SPELT}
select id, name, min(id) over (partition by k) as same_name_as from folded""")
def q_name_flags_collated(spark, d):
    return CO.name_flags(TB.spelt_clients(spark, d))
