"""Registered queries (see ``registry``).  Each oracle SQL restates the
operator's semantics in DuckDB over the same business views."""

from __future__ import annotations


from ..operators import sales as S
from ..operators.filters import Filters
from ..sources import tables as TB
from .oracle_views import with_views as W
from .registry import register

# Fixed periods used by the registered queries (the sales data spans
# 1995-01-01 .. 2001-08-01): A = first half of 1996, B = first half of 1997.
A = Filters("1996-01-01", "1996-06-30")
B = Filters("1997-01-01", "1997-06-30")


@register("sales_summary", W("""
select product_type, count(*) as quantity, cast(sum(price) as double) as total_sales,
       cast(sum(price) as double) / count(*) as avg_price,
       cast(min(price) as double) as min_price, cast(max(price) as double) as max_price
from sales group by product_type""", "sales"))
def q_sales_summary(spark, d):
    return S.sales_summary(TB.sales(spark, d))


@register("sales_summary_filtered", W("""
select product_type, count(*) as quantity, cast(sum(price) as double) as total_sales,
       cast(sum(price) as double) / count(*) as avg_price,
       cast(min(price) as double) as min_price, cast(max(price) as double) as max_price
from sales where date >= date '1996-01-01' and date <= date '1996-06-30'
group by product_type""", "sales"))
def q_sales_summary_filtered(spark, d):
    return S.sales_summary(TB.sales(spark, d), A)


_PERIOD_METRICS_SQL = """
select coalesce(cast(sum(amt) as double), 0.0) as total_sales, cast(coalesce(sum(n), 0) as bigint) as transactions,
       case when coalesce(sum(n), 0) > 0 then cast(sum(amt) as double) / sum(n) else 0.0 end as avg_ticket,
       cast(coalesce(sum(n), 0) as bigint) as total_quantity, count(*) as unique_clients
from (select coalesce(client_id, client_name) as ck, sum(price) as amt, count(*) as n
      from sales where date between date '1996-01-01' and date '1996-06-30' group by 1) t"""


@register("period_metrics", W(_PERIOD_METRICS_SQL, "sales"))
def q_period_metrics(spark, d):
    return S.period_metrics(TB.sales(spark, d), A)


@register("unique_clients", W("""
select count(distinct coalesce(client_id, client_name)) as unique_clients from sales""", "sales"))
def q_unique_clients(spark, d):
    return S.unique_clients(TB.sales(spark, d))


@register("product_distribution", W("""
with per as (select product_type as label, sum(price) as v from sales group by 1),
     tot as (select sum(v) as t from per)
select label, cast(v as double) as value,
       case when t > 0 then cast(v as double) / cast(t as double) * 100.0 else 0.0 end as percentage,
       row_number() over (order by cast(v as double) desc, label asc) - 1 as color_index
from per, tot""", "sales"))
def q_product_distribution(spark, d):
    return S.product_distribution(TB.sales(spark, d))


_KEY_SQL = {
    "day": "strftime(date, '%Y-%m-%d')",
    "week": "strftime(date, '%G-W%V')",
    "month": "strftime(date, '%Y-%m')",
    "quarter": "cast(year(date) as varchar) || '-Q' || cast(quarter(date) as varchar)",
    "year": "strftime(date, '%Y')",
}
_LABEL_SQL = {
    "day": "strftime(date, '%d/%m')",
    "week": "'Sem ' || cast(weekofyear(date) as varchar)",
    "month": "strftime(date, '%b %y')",
    "quarter": "'Q' || cast(quarter(date) as varchar) || ' ' || right(cast(year(date) as varchar), 2)",
    "year": "strftime(date, '%Y')",
}


def _evo(g):
    @register(f"sales_evolution_{g}", W(f"""
select {_KEY_SQL[g]} as key, min({_LABEL_SQL[g]}) as label, cast(sum(price) as double) as total
from sales group by 1""", "sales"))
    def q(spark, d):
        from ..operators.evolution import sales_evolution
        return sales_evolution(TB.sales(spark, d), None, g)
    return q


for _g in ("day", "week", "month", "quarter", "year"):
    _evo(_g)


@register("sales_date_range", W("""
select strftime(min(date), '%Y-%m-%d') as min_date, strftime(max(date), '%Y-%m-%d') as max_date
from sales""", "sales"))
def q_sales_date_range(spark, d):
    return S.sales_date_range(TB.sales(spark, d))


@register("distinct_products", W("select distinct product_type from sales", "sales"))
def q_distinct_products(spark, d):
    from ..operators.filters import distinct_values
    return distinct_values(TB.sales(spark, d), "product_type")


def _top_sql(order: str) -> str:
    return W(f"""
with pc as (
  select client_id, sum(price) as amt, count(*) as transactions, max(date) as last_date
  from sales where client_id is not null group by client_id),
nm as (
  select client_id, client_name as name from (
    select client_id, client_name, row_number() over (partition by client_id order by date desc, client_name desc) as rn
    from sales where client_id is not null) x where rn = 1),
tot as (select sum(price) as t from sales),
r as (
  select pc.client_id, nm.name, cast(amt as double) as total_amount, transactions,
         case when t > 0 then cast(amt as double) / cast(t as double) * 100.0 else 0.0 end as percentage_of_total,
         last_date
  from pc join nm using (client_id), tot)
select client_id, name, total_amount, transactions, percentage_of_total,
       row_number() over (order by {order}, last_date desc, client_id asc) as rank
from r order by {order}, last_date desc, client_id asc limit 10""", "sales")


@register("top_clients_amount", _top_sql("total_amount desc, transactions desc"))
def q_top_clients_amount(spark, d):
    return S.top_clients(TB.sales(spark, d), None, n=10, by="amount")


@register("top_clients_count", _top_sql("transactions desc, total_amount desc"))
def q_top_clients_count(spark, d):
    return S.top_clients(TB.sales(spark, d), None, n=10, by="count")


@register("summary_with_total", W("""
select coalesce(product_type, 'TOTAL') as product_type, count(*) as quantity,
       cast(sum(price) as double) as total_sales, cast(sum(price) as double) / count(*) as avg_price,
       cast(min(price) as double) as min_price, cast(max(price) as double) as max_price
from sales group by rollup (product_type)""", "sales"))
def q_summary_with_total(spark, d):
    return S.summary_with_total(TB.sales(spark, d))


@register("product_year_report", W("""
select product_type, cast(sum(price) as double) as total_sales, count(*) as quantity
from sales where date between date '1998-01-01' and date '1998-12-31' group by 1""", "sales"))
def q_product_year_report(spark, d):
    return S.product_year_report(TB.sales(spark, d), 1998)
