"""Registered comparison / period queries with their DuckDB oracles."""

from __future__ import annotations

from ..operators import compare as C
from ..operators import evolution as EV
from ..operators.filters import Filters
from ..sources import tables as TB
from . import periods as P
from .oracle_views import with_views as W
from .queries_core import _KEY_SQL, _LABEL_SQL
from .registry import register

SALES_AS_OF = "2001-06-20"
A = Filters("1996-01-01", "1996-06-30")
B = Filters("1997-01-01", "1997-06-30")
# Overlapping pair: all of 1996 against mid-1996..mid-1997.
A2 = Filters("1996-01-01", "1996-12-31")
B2 = Filters("1996-07-01", "1997-06-30")
PRESET_A = Filters("2000-01-01", "2000-03-31")


# The periods in DuckDB's own date functions, for a day named d.
_PERIOD_SQL = {
    "last_7_days": ("d - 6", "d"), "last_30_days": ("d - 29", "d"), "last_90_days": ("d - 89", "d"),
    "last_3_months": ("d - interval 3 month", "d"), "last_6_months": ("d - interval 6 month", "d"),
    "last_12_months": ("d - interval 12 month", "d"),
    "current_week_full": ("date_trunc('week', d)", "date_trunc('week', d) + interval 6 day"),
    "current_week_to_date": ("date_trunc('week', d)", "d"),
    "current_month_full": ("date_trunc('month', d)", "last_day(d)"),
    "current_month_to_date": ("date_trunc('month', d)", "d"),
    "previous_month_full": ("date_trunc('month', d) - interval 1 month", "date_trunc('month', d) - interval 1 day"),
    "current_quarter_full": ("date_trunc('quarter', d)", "date_trunc('quarter', d) + interval 3 month - interval 1 day"),
    "current_quarter_to_date": ("date_trunc('quarter', d)", "d"),
    "previous_quarter_full": ("date_trunc('quarter', d) - interval 3 month", "date_trunc('quarter', d) - interval 1 day"),
    "same_quarter_previous_year": ("date_trunc('quarter', d) - interval 12 month",
                                   "date_trunc('quarter', d) - interval 9 month - interval 1 day"),
    "current_semester_full": ("h", "h + interval 6 month - interval 1 day"), "current_semester_to_date": ("h", "d"),
    "previous_semester_full": ("h - interval 6 month", "h - interval 1 day"),
    "current_year_full": ("date_trunc('year', d)", "date_trunc('year', d) + interval 1 year - interval 1 day"),
    "current_year_to_date": ("date_trunc('year', d)", "d"),
    "previous_year_full": ("date_trunc('year', d) - interval 1 year", "date_trunc('year', d) - interval 1 day"),
}
_DAY = f"""
today as (select date '{SALES_AS_OF}' as d,
                 date_trunc('year', date '{SALES_AS_OF}') + case when month(date '{SALES_AS_OF}') > 6 then interval 6 month else interval 0 month end as h),
named(period, pstart, pend) as ({' union all '.join(
    f"select '{k}', cast({lo} as date), cast({hi} as date) from today" for k, (lo, hi) in _PERIOD_SQL.items())})"""


def _metrics_by_period_sql(periods: str) -> str:
    return f"""{_DAY},
p as ({periods}),
pc as (select p.period, coalesce(client_id, client_name) as ck, sum(price) as amt, count(*) as n
       from sales s join p on s.date between p.pstart and p.pend
       group by 1, 2),
m as (select period, cast(sum(amt) as double) as total_sales, cast(sum(n) as bigint) as transactions,
             count(ck) as unique_clients from pc group by 1)"""


@register("sales_by_period", W(f"""
, {_metrics_by_period_sql("select * from named")[1:]}
select p.period, strftime(p.pstart, '%Y-%m-%d') as start, strftime(p.pend, '%Y-%m-%d') as "end",
       coalesce(total_sales, 0.0) as total_sales, coalesce(transactions, 0) as transactions,
       case when coalesce(transactions, 0) > 0 then total_sales / transactions else 0.0 end as avg_ticket,
       coalesce(transactions, 0) as total_quantity, coalesce(unique_clients, 0) as unique_clients
from p left join m using (period)""", "sales"))
def q_sales_by_period(spark, d):
    return P.sales_by_period(spark, TB.sales(spark, d), SALES_AS_OF)


_X2_PAIRS = {"current_month_vs_previous": ("current_month_to_date", "previous_month_full"),
             "quarter_vs_previous_year": ("current_quarter_to_date", "same_quarter_previous_year"),
             "current_year_vs_previous": ("current_year_to_date", "previous_year_full"),
             "current_semester_vs_previous": ("current_semester_to_date", "previous_semester_full")}


def _x2_periods(a_start: str, a_end: str) -> str:
    s, e = f"date '{a_start}'", f"date '{a_end}'"
    own = {"same_period_as_a": (s, e), "period_vs_previous_year": (f"{s} - interval 1 year", f"{e} - interval 1 year"),
           "current_vs_previous": (f"{s} - cast({e} - {s} + 1 as int)", f"{s} - 1")}
    rows = [f"select '{p}|{side}' as period, cast({lo} as date) as pstart, cast({hi} as date) as pend"
            for p, b in own.items() for side, (lo, hi) in (("a", (s, e)), ("b", b))]
    rows += [f"select '{p}|{side}', pstart, pend from named where period = '{name}'"
             for p, names in _X2_PAIRS.items() for side, name in zip("ab", names)]
    return " union all ".join(rows)


_MET = ["total_sales", "transactions", "avg_ticket", "total_quantity", "unique_clients"]


def _x2_sql() -> str:
    unions = " union all ".join(
        f"select preset, side, '{k}' as metric, {k} as value from full_" for k in _MET)
    body = f""",
{_metrics_by_period_sql(_x2_periods(PRESET_A.date_start, PRESET_A.date_end))[1:]},
full_ as (select split_part(p.period, '|', 1) as preset, split_part(p.period, '|', 2) as side,
                 coalesce(total_sales, 0.0) as total_sales,
                 cast(coalesce(transactions, 0) as double) as transactions,
                 case when coalesce(transactions, 0) > 0 then total_sales / transactions else 0.0 end as avg_ticket,
                 cast(coalesce(transactions, 0) as double) as total_quantity,
                 cast(coalesce(unique_clients, 0) as double) as unique_clients
          from p left join m using (period)),
lng as ({unions}),
wide as (select preset, metric, max(case when side = 'a' then value end) as value_a,
                max(case when side = 'b' then value end) as value_b from lng group by 1, 2)
select preset, metric, value_a, value_b, value_b - value_a as abs_change,
       case when value_a <> 0 then (value_b - value_a) / value_a * 100.0
            when value_b - value_a <> 0 then 100.0 else 0.0 end as pct_change
from wide"""
    return W(body, "sales")


@register("preset_comparison", _x2_sql())
def q_preset_comparison(spark, d):
    return P.preset_comparison(spark, TB.sales(spark, d), SALES_AS_OF, PRESET_A)


def _inab(fa: Filters, fb: Filters) -> tuple[str, str]:
    return (f"(date between date '{fa.date_start}' and date '{fa.date_end}')",
            f"(date between date '{fb.date_start}' and date '{fb.date_end}')")


def _cm_sql(fa, fb):
    ia, ib = _inab(fa, fb)
    parts = []
    for k in _MET:
        parts.append(f"select '{k}' as metric, cast({k}_a as double) as value_a, cast({k}_b as double) as value_b from m")
    return W(f"""
, pc as (select coalesce(client_id, client_name) as ck,
               sum(case when {ia} then price end) as amt_a, sum(case when {ib} then price end) as amt_b,
               count(case when {ia} then 1 end) as n_a, count(case when {ib} then 1 end) as n_b
        from sales where {ia} or {ib} group by 1),
g as (select sum(amt_a) as t_a, sum(amt_b) as t_b, sum(n_a) as n_a, sum(n_b) as n_b,
             count(case when n_a > 0 then 1 end) as u_a, count(case when n_b > 0 then 1 end) as u_b from pc),
m as (select coalesce(cast(t_a as double), 0.0) as total_sales_a, coalesce(n_a, 0) as transactions_a,
             case when coalesce(n_a, 0) > 0 then cast(t_a as double) / n_a else 0.0 end as avg_ticket_a,
             coalesce(n_a, 0) as total_quantity_a, u_a as unique_clients_a,
             coalesce(cast(t_b as double), 0.0) as total_sales_b, coalesce(n_b, 0) as transactions_b,
             case when coalesce(n_b, 0) > 0 then cast(t_b as double) / n_b else 0.0 end as avg_ticket_b,
             coalesce(n_b, 0) as total_quantity_b, u_b as unique_clients_b from g),
l as ({' union all '.join(parts)})
select metric, value_a, value_b, value_b - value_a as abs_change,
       case when value_a <> 0 then (value_b - value_a) / value_a * 100.0
            when value_b - value_a <> 0 then 100.0 else 0.0 end as pct_change
from l""", "sales")


@register("compare_metrics", _cm_sql(A, B))
def q_compare_metrics(spark, d):
    return C.compare_metrics(TB.sales(spark, d), A, B)


@register("compare_metrics_overlap", _cm_sql(A2, B2))
def q_compare_metrics_overlap(spark, d):
    return C.compare_metrics(TB.sales(spark, d), A2, B2)


def _cp_sql(fa, fb):
    ia, ib = _inab(fa, fb)
    return W(f"""
select product_type, coalesce(cast(sum(case when {ia} then price end) as double), 0.0) as value_a,
       coalesce(cast(sum(case when {ib} then price end) as double), 0.0) as value_b,
       value_b - value_a as difference,
       case when value_a <> 0 then (value_b - value_a) / value_a * 100.0
            when value_b - value_a <> 0 then 100.0 else 0.0 end as pct_change
from sales where {ia} or {ib} group by product_type""", "sales")


@register("compare_products", _cp_sql(A, B))
def q_compare_products(spark, d):
    return C.compare_products(TB.sales(spark, d), A, B)


_NEXT_SQL = {
    "day": "s + interval 1 day", "week": "s + interval 7 day", "month": "s + interval 1 month",
    "quarter": "s + interval 3 month", "year": "s + interval 1 year",
}
_START_SQL = {
    "day": "date", "week": "date_trunc('week', date)", "month": "date_trunc('month', date)",
    "quarter": "date_trunc('quarter', date)", "year": "date_trunc('year', date)",
}


def _points_sql(fa, fb, g, full=True):
    ia, ib = _inab(fa, fb)
    key = _KEY_SQL[g].replace("date", "s").replace("s_trunc", "date_trunc")
    label = _LABEL_SQL[g].replace("(date", "(s")
    partial = (f"(cast(s as timestamp) < timestamp '{fa.date_start} 00:00:00' or e > timestamp '{fa.date_end} 00:00:00' "
               f"or cast(s as timestamp) < timestamp '{fb.date_start} 00:00:00' or e > timestamp '{fb.date_end} 00:00:00')")
    cols = ("key, label, strftime(cast(s as timestamp), '%Y-%m-%d %H:%M:%S.%f') as start, "
            "strftime(e, '%Y-%m-%d %H:%M:%S.%f') as \"end\", value_a, value_b, "
            f"value_b - value_a as difference, {partial} as is_partial") if full else "key, label, value_a, value_b"
    return W(f"""
, b as (select cast({_START_SQL[g]} as date) as s,
              sum(case when {ia} then price end) as va, sum(case when {ib} then price end) as vb
       from sales where {ia} or {ib} group by 1),
c as (select s, {key} as key, {label} as label,
             cast({_NEXT_SQL[g]} as timestamp) - interval 1 microsecond as e,
             coalesce(cast(va as double), 0.0) as value_a, coalesce(cast(vb as double), 0.0) as value_b from b)
select {cols} from c""", "sales")


@register("compare_evolution_month", _points_sql(A, B, "month", full=False))
def q_compare_evolution_month(spark, d):
    return EV.compare_evolution(TB.sales(spark, d), A, B, "month")


@register("evolution_points_quarter", _points_sql(A2, B2, "quarter"))
def q_evolution_points_quarter(spark, d):
    return EV.evolution_points(TB.sales(spark, d), A2, B2, "quarter")


@register("evolution_points_week", _points_sql(A, B, "week"))
def q_evolution_points_week(spark, d):
    return EV.evolution_points(TB.sales(spark, d), A, B, "week")


@register("regroup_day_to_year", _points_sql(A2, B2, "year"))
def q_regroup_day_to_year(spark, d):
    daily = EV.daily_ab(TB.sales(spark, d), A2, B2)
    return EV.regroup_comparison(daily, "day", "year", A2, B2)
