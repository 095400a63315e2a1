"""More registered queries: mixed import counts (I12), calendar ranges and
key checks (S10, S13), ISO normalisation (S2), F7 source filters, first
touch (W1) and snapshot extracts (C4, C5)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.buckets import bucket_key, bucket_range, valid_bucket_key
from ..functions.dates import normalize_iso
from ..operators import ingest as I
from ..operators import marketing as M
from ..plans import snapshot as SN
from ..sources import tables as TB
from .oracle_views import with_views as W
from .queries_compare import A, A2, B, B2, _inab, _points_sql
from .queries_ingest import AS_OF, _LEADS_CHECKED, _SALES_CHECKED
from .queries_leads import _MM, _TOUCH
from .registry import register


def _mixed_sql():
    leads_part = (_LEADS_CHECKED.replace("from raw_leads",
                                         "from (select *, null::varchar as meeting_date from raw_mixed) rm")
                  .replace("chk as (", "lchk as (").replace("from chk where", "from lchk where"))
    sales_part = _SALES_CHECKED.replace("from raw_sales", "from raw_mixed")
    return W(f""", {sales_part}, {leads_part}
select (select count(*) from raw_mixed) as total, (select count(*) from ins) as leads,
       (select count(*) from chk where error is null) as sales,
       greatest((select count(*) from raw_mixed) - (select count(*) from ins)
                - (select count(*) from chk where error is null), 0) as invalid""",
             "raw_mixed", "leads", "clients")


@register("ingest_mixed_counts", _mixed_sql())
def q_ingest_mixed_counts(spark, d):
    r = I.import_mixed(TB.raw_mixed(spark, d), TB.leads(spark, d), TB.clients(spark, d), AS_OF,
                       on_unknown_client="null")
    return r["counts"]


@register("sales_week_ranges", W("""
select strftime(date, '%G-W%V') as key, cast(date_trunc('week', date) as date) as first_day,
       cast(date_trunc('week', date) as date) + 6 as last_day, true as valid_key, count(*) as sales
from sales group by 1, 2, 3""".replace("cast(date_trunc('week', date) as date) as first_day",
                                      "strftime(cast(date_trunc('week', date) as date), '%Y-%m-%d') as first_day")
       .replace("cast(date_trunc('week', date) as date) + 6 as last_day",
                "strftime(cast(date_trunc('week', date) as date) + 6, '%Y-%m-%d') as last_day"), "sales"))
def q_sales_week_ranges(spark, d):
    s = TB.sales(spark, d)
    first, last = bucket_range("date", "week")
    g = s.groupBy(first.alias("first_day"), last.alias("last_day")).agg(F.count(F.lit(1)).alias("sales"))
    k = bucket_key("first_day", "week")
    return g.select(k.alias("key"), "first_day", "last_day", valid_bucket_key(k, "week").alias("valid_key"), "sales")


_ISO_SQL = r"""
case when date is null or trim(date) = '' then null
     when regexp_matches(trim(date), '^\d{4}-\d{2}-\d{2}$') then trim(date)
     else strftime(coalesce(cast(try_strptime(trim(date), '%d/%m/%Y') as date),
                            cast(try_strptime(trim(date), '%d-%m-%Y') as date),
                            cast(try_strptime(trim(date), '%Y/%m/%d') as date),
                            cast(try_strptime(trim(date), '%Y.%m.%d') as date)), '%Y-%m-%d') end"""


@register("raw_dates_iso", W(f"select row_no, date, {_ISO_SQL} as iso from raw_sales", "raw_sales"))
def q_raw_dates_iso(spark, d):
    r = TB.raw_sales(spark, d)
    return r.select("row_no", "date", normalize_iso("date").alias("iso"))


def _metrics(spark, d):
    return M.marketing_metrics(TB.leads(spark, d), TB.sales(spark, d), TB.marketing_spend(spark, d))


@register("marketing_table_sources", W(_MM + "\nselect * from mx where leads > 0", "leads", "sales", "marketing_spend"))
def q_marketing_table_sources(spark, d):
    return M.sources_with_leads(_metrics(spark, d))


@register("marketing_chart_sources", W(_MM + "\nselect * from mx where revenue > 0 or spend > 0",
                                       "leads", "sales", "marketing_spend"))
def q_marketing_chart_sources(spark, d):
    return M.sources_for_chart(_metrics(spark, d))


@register("first_touch", W(_TOUCH, "leads"))
def q_first_touch(spark, d):
    return M.first_touch(TB.leads(spark, d))


@register("compare_snapshot_points", _points_sql(A2, B2, "quarter"))
def q_compare_snapshot_points(spark, d):
    snap = SN.compare_snapshot(TB.sales(spark, d), A2, B2, "quarter")
    return snap.select(F.explode("comparison.evolution.points").alias("p")).select("p.*")


@register("normal_snapshot_table", W("""
select product_type, count(*) as quantity, cast(sum(price) as double) as total_sales,
       cast(sum(price) as double) / count(*) as avg_price,
       cast(min(price) as double) as min_price, cast(max(price) as double) as max_price
from sales where date between date '1996-01-01' and date '1996-12-31' group by product_type""", "sales"))
def q_normal_snapshot_table(spark, d):
    snap = SN.normal_snapshot(TB.sales(spark, d), A2, "month")
    return snap.select(F.explode("period_a.table").alias("t")).select("t.*")


@register("sales_summary_display", W("""
select product_type,
       '€ ' || replace(replace(replace(format('{:,.2f}', t), ',', '|'), '.', ','), '|', '.') as total_eur,
       replace(replace(replace(format('{:,.2f}', t), ',', '|'), '.', ','), '|', '.') as total_plain,
       '+' || replace(replace(replace(format('{:,.2f}', t), ',', '|'), '.', ','), '|', '.') as total_signed
from (select product_type, cast(sum(price) as double) as t from sales group by 1) x""", "sales"))
def q_sales_summary_display(spark, d):
    """S18 on exact 2-dp totals (no rounding edge between engines)."""
    from ..functions.text import format_eur, format_eur_no_symbol, format_eur_signed
    from ..operators.sales import sales_summary
    s = sales_summary(TB.sales(spark, d))
    return s.select("product_type", format_eur("total_sales").alias("total_eur"),
                    format_eur_no_symbol("total_sales").alias("total_plain"),
                    format_eur_signed("total_sales").alias("total_signed"))


@register("clients_normalized_text", W("""
select id, trim(coalesce(address, '')) as address, trim(coalesce(contact_person, '')) as contact_person,
       trim(coalesce(email, '')) as email from clients""", "clients"))
def q_clients_normalized_text(spark, d):
    """S20 over the client table."""
    from ..functions.text import normalize_text
    c = TB.clients(spark, d)
    return c.select("id", normalize_text("address").alias("address"),
                    normalize_text("contact_person").alias("contact_person"),
                    normalize_text("email").alias("email"))


def _violations_sql():
    pts = _points_sql(A2, B2, "quarter")
    return f"""
with p as ({pts}),
q as (select *, lag(key) over (order by key) as pk, lag("end") over (order by key) as pe from p),
r as (
  select key, 'bad_key_format' as violation from q where not regexp_matches(key, '^\\d{{4}}-Q[1-4]$')
  union all select key, 'start_not_before_end' from q where not (start < "end")
  union all select key, 'difference_mismatch' from q where abs(difference - (value_b - value_a)) > 1e-9
  union all select key, 'keys_not_increasing' from q where pk is not null and key <= pk
  union all select key, 'overlapping_intervals' from q where pe is not null and start <= pe)
select * from r"""


@register("evolution_points_violations", _violations_sql())
def q_evolution_points_violations(spark, d):
    """C6 on the quarter points of the overlapping A/B pair (valid -> no rows)."""
    from ..operators.evolution import evolution_points
    return SN.validate_points(evolution_points(TB.sales(spark, d), A2, B2, "quarter"), "quarter")


# Metric changes and product rows of a whole compare snapshot
@register("compare_snapshot_products", W(f"""
, ab as (select product_type, sum(case when {_inab(A, B)[0]} then price end) as a, sum(case when {_inab(A, B)[1]} then price end) as b
         from sales where {_inab(A, B)[0]} or {_inab(A, B)[1]} group by 1)
select product_type, coalesce(cast(a as double), 0.0) as value_a, coalesce(cast(b as double), 0.0) as value_b from ab""", "sales"))
def q_compare_snapshot_products(spark, d):
    snap = SN.compare_snapshot(TB.sales(spark, d), A, B, "quarter")
    p = snap.select(F.explode("comparison.products").alias("p")).select("p.*")
    a, b = [c for c in p.columns if c.endswith("_a") and "sales" in c or c == "value_a"][0], \
           [c for c in p.columns if c.endswith("_b") and "sales" in c or c == "value_b"][0]
    return p.select("product_type", F.col(a).alias("value_a"), F.col(b).alias("value_b"))


@register("compare_snapshot_top_clients", W(f"""
, s as (select * from sales where {_inab(A, B)[0]}),
pc as (select client_id, sum(price) as amt, count(*) as transactions, max(date) as last_date from s group by 1),
r as (select client_id, cast(amt as double) as total_amount, transactions,
             cast(amt as double) / cast((select sum(price) from s) as double) * 100.0 as percentage_of_total,
             row_number() over (order by amt desc, transactions desc, last_date desc, client_id) as rank from pc)
select * from r where rank <= 5""", "sales"))
def q_compare_snapshot_top_clients(spark, d):
    snap = SN.compare_snapshot(TB.sales(spark, d), A, B, "quarter")
    return snap.select(F.explode("period_a.top_clients").alias("c")).select(
        "c.client_id", "c.total_amount", "c.transactions", "c.percentage_of_total", "c.rank")


# I10 over two files with the same rows: the second file's are all duplicates
@register("ingest_leads_two_files", W("""
select count(*) as total_rows from raw_leads""", "raw_leads").replace("select count(*) as total_rows from raw_leads", """
, n as (select count(*) as n, count(nullif(trim(status), '')) as with_status from raw_leads)
select 2 * n as total_rows, 0 as differing_duplicates from n"""))
def q_ingest_leads_two_files(spark, d):
    from ..operators import ingest as I
    raw = TB.raw_leads(spark, d)
    one = lambda r, f: r.withColumn("_file", F.lit(f))
    none, clients = TB.leads(spark, d), TB.clients(spark, d)
    both = I.import_leads(one(raw, "a").unionByName(one(raw, "b")), none, clients, AS_OF, on_unknown_client="null")
    alone = I.import_leads(raw, none, clients, AS_OF, on_unknown_client="null")
    kind = lambda df, k: df.select(F.lit(k).alias("k"))
    # every candidate of the second file is a duplicate: 2 D + inserted of one file
    parts = (kind(both.extra["duplicates"], "both").union(kind(alone.extra["duplicates"], "alone"))
             .union(kind(alone.valid, "inserted")).union(kind(both.valid, "kept")).union(kind(raw, "rows")))
    g = parts.agg(*[F.count_if(F.col("k") == k).alias(k) for k in ("both", "alone", "inserted", "kept", "rows")])
    wrong = F.abs(F.col("both") - 2 * F.col("alone") - F.col("inserted")) + F.abs(F.col("kept") - F.col("inserted"))
    return g.select((2 * F.col("rows")).alias("total_rows"), wrong.alias("differing_duplicates"))


# I8: the rows that an import appends, after a third of them was imported before
@register("import_sales_store", W("""
, ok as (select row_no, client_id, product_type, cast(price as double) as price from raw_sales
         where nullif(trim(client_name), '') is not null and try_cast(trim(price) as double) > 0
           and (date is null or date <> 'not a date'))
select 'import#' || row_no as id, client_id, product_type, price from ok where row_no % 3 <> 0""", "raw_sales"))
def q_import_sales_store(spark, d):
    from ..operators import ingest as I
    raw = TB.raw_sales(spark, d)
    before = raw.filter("row_no % 3 = 0").select(F.concat(F.lit("import#"), F.col("row_no").cast("string")).alias("id"))
    r = I.import_sales(raw, TB.clients(spark, d), AS_OF, existing=before)
    return r.extra["append"].select("id", "client_id", "product_type", F.col("price").cast("double").alias("price"))


# Counts of the same import, measured
@register("import_log_counts", W("""
, ok as (select count(*) as v from raw_sales
         where nullif(trim(client_name), '') is not null and try_cast(trim(price) as double) > 0
           and (date is null or date <> 'not a date'))
select (select count(*) from raw_sales) as total_rows, v as valid_rows, (select count(*) from raw_sales) - v as rejected_rows from ok""",
          "raw_sales"))
def q_import_log_counts(spark, d):
    from ..operators import ingest as I
    return I.import_sales(TB.raw_sales(spark, d), TB.clients(spark, d), AS_OF).extra["counts"]


# A21 / K5 with an import log (one entry per day of events)
@register("dashboard_last_import", W("""
select strftime(max(ts), '%Y-%m-%d %H:%M:%S.%f') as last_import, (select count(*) from sales) as sales_rows from events""", "sales"))
def q_dashboard_last_import(spark, d):
    from ..operators import dashboard as DB
    log = TB.read_table(spark, d, "events").select(F.col("ts").cast("timestamp").alias("imported_at"))
    return DB.dashboard_kpis(TB.sales(spark, d), TB.clients(spark, d), TB.leads(spark, d), AS_OF, log).select("last_import", "sales_rows")
