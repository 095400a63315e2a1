"""Calendar periods (P1-P14) and their evaluation over the fact table.

A period is a row of a table: unit, offset in units from the one that holds
``as_of``, and where it ends.  Spark date functions turn the table and an
explicit ``as_of`` date (never the wall clock) into bounds.  X1/X2 expand them
into a bounded "period-day" table (one row per day of each period, a few
thousand rows at most, independent of data volume); the fact table is reduced
to one row per client and day first, scanned once for all periods, and the scan
only reads dates inside the earliest..latest bound (pushed down).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.metrics import safe_pct_change, safe_ratio
from ..operators.filters import Filters

#: name, unit, offset, end.  End ``full``: the last day of the unit; ``to_date``:
#: as_of; ``trailing``: as_of, starting the offset before it (days count as_of).
PERIODS = [
    ("last_7_days", "day", -6, "trailing"),
    ("last_30_days", "day", -29, "trailing"),
    ("last_90_days", "day", -89, "trailing"),
    ("last_3_months", "month", -3, "trailing"),
    ("last_6_months", "month", -6, "trailing"),
    ("last_12_months", "month", -12, "trailing"),
    ("current_week_full", "week", 0, "full"),
    ("current_week_to_date", "week", 0, "to_date"),
    ("current_month_full", "month", 0, "full"),
    ("current_month_to_date", "month", 0, "to_date"),
    ("previous_month_full", "month", -1, "full"),
    ("current_quarter_full", "quarter", 0, "full"),
    ("current_quarter_to_date", "quarter", 0, "to_date"),
    ("previous_quarter_full", "quarter", -1, "full"),
    ("same_quarter_previous_year", "quarter", -4, "full"),
    ("current_semester_full", "semester", 0, "full"),
    ("current_semester_to_date", "semester", 0, "to_date"),
    ("previous_semester_full", "semester", -1, "full"),
    ("current_year_full", "year", 0, "full"),
    ("current_year_to_date", "year", 0, "to_date"),
    ("previous_year_full", "year", -1, "full"),
]
#: months of the calendar units; days of the others
_MONTHS = {"month": 1, "quarter": 3, "semester": 6, "year": 12}
_DAYS = {"day": 1, "week": 7}

#: preset, period of side A and of side B
PRESETS = [
    ("current_month_vs_previous", "current_month_to_date", "previous_month_full"),
    ("quarter_vs_previous_year", "current_quarter_to_date", "same_quarter_previous_year"),
    ("current_year_vs_previous", "current_year_to_date", "previous_year_full"),
    ("current_semester_vs_previous", "current_semester_to_date", "previous_semester_full"),
]


def _lookup(unit: Column, table: dict[str, int]) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for pair in table.items() for x in pair]), unit)


def named_periods(spark: SparkSession, as_of, periods=PERIODS) -> DataFrame:
    """``period, start, end`` (dates) of the period table."""
    t = spark.createDataFrame(periods, "period string, unit string, offset int, until string")
    day = F.lit(str(as_of)[:10]).cast("date")
    months, days = _lookup(F.col("unit"), _MONTHS), _lookup(F.col("unit"), _DAYS)
    # the first day of the unit that holds as_of, then the offset in units
    of_year = F.trunc(day, "year")
    calendar = F.add_months(of_year, (F.floor((F.month(day) - 1) / months) * months).cast("int"))
    first = F.when(months.isNotNull(), F.add_months(calendar, (months * F.col("offset")).cast("int"))).otherwise(
        F.date_add(F.trunc(day, "week"), days * F.col("offset")))
    last = F.when(months.isNotNull(), F.date_sub(F.add_months(first, months), 1)).otherwise(F.date_add(first, days - 1))
    trailing = F.when(months.isNotNull(), F.add_months(day, (months * F.col("offset")).cast("int"))).otherwise(
        F.date_add(day, days * F.col("offset")))
    until = F.col("until")
    return t.select("period", F.when(until == "trailing", trailing).otherwise(first).alias("start"),
                    F.when(until == "full", last).otherwise(day).alias("end"))


def shift_year_iso(spark: SparkSession, s, n: int) -> str:
    """S15 on a plan-time value."""
    one = spark.range(1).select(F.add_months(F.lit(str(s)[:10]).cast("date"), 12 * n).alias("d"))
    return one.first().d.isoformat()


def preset_ranges(spark: SparkSession, as_of, a: Filters | None = None) -> DataFrame:
    """``preset, side, start, end``.  Presets that need a valid period A
    are left out when A has no complete range."""
    named = named_periods(spark, as_of)
    pairs = spark.createDataFrame([(p, side, name) for p, *names in PRESETS for side, name in zip("ab", names)],
                                  "preset string, side string, period string")
    out = pairs.join(F.broadcast(named), "period").select("preset", "side", "start", "end")
    if a is None or not a.date_start or not a.date_end:
        return out
    s, e = (F.lit(str(x)[:10]).cast("date") for x in (a.date_start, a.date_end))
    length = F.datediff(e, s) + 1
    rules = {"same_period_as_a": (s, e),
             "period_vs_previous_year": (F.add_months(s, -12), F.add_months(e, -12)),
             "current_vs_previous": (F.date_sub(s, length), F.date_sub(s, 1))}
    own = spark.range(1).select(F.explode(F.array(*[
        F.struct(F.lit(p).alias("preset"), F.lit(side).alias("side"), lo.alias("start"), hi.alias("end"))
        for p, b in rules.items() for side, (lo, hi) in (("a", (s, e)), ("b", b))])).alias("r")).select("r.*")
    return own.unionByName(out)


def _bounded(sales: DataFrame, ranges: DataFrame) -> DataFrame:
    """Sales inside the earliest..latest bound, as literals that reach the scan
    (``ranges`` has a few rows that the optimizer computes without a job)."""
    rows = ranges.select("start", "end").collect()
    lo, hi = min(r.start for r in rows), max(r.end for r in rows)
    return sales.filter(F.col("date").between(F.lit(lo), F.lit(hi)))


def _period_days(ranges: DataFrame, *keys: str) -> DataFrame:
    """One row per (period, day): bounded by the summed period lengths."""
    return ranges.select(*keys, F.explode(F.sequence("start", "end")).alias("date"))


def _segment(sales: DataFrame, f: Filters | None) -> DataFrame:
    if f is None:
        return sales
    return sales.filter(Filters(None, None, f.client_name, f.product_type).predicate())


def _period_metrics(sales: DataFrame, ranges: DataFrame, *keys: str) -> DataFrame:
    """A2 metrics per period.  Sales are reduced to a row per client and day
    before the days fan out into the periods that hold them."""
    daily = (_bounded(sales, ranges).groupBy(F.coalesce("client_id", "client_name").alias("_ck"), "date")
             .agg(F.sum("price").alias("_amt"), F.count(F.lit(1)).alias("_n")))
    pc = (daily.join(F.broadcast(_period_days(ranges, *keys)), "date").groupBy(*keys, "_ck")
          .agg(F.sum("_amt").alias("_amt"), F.sum("_n").alias("_n")))
    g = pc.groupBy(*keys).agg(F.sum("_amt").alias("_t"), F.sum("_n").alias("_n"),
                              F.count("_ck").alias("unique_clients"))
    t = F.col("_t").cast("double")
    n = F.col("_n").cast("long")
    found = g.select(*keys, t.alias("total_sales"), n.alias("transactions"),
                     safe_ratio(t, n).alias("avg_ticket"), n.alias("total_quantity"),
                     F.col("unique_clients").cast("long"))
    zero = {"total_sales": 0.0, "transactions": 0, "avg_ticket": 0.0, "total_quantity": 0, "unique_clients": 0}
    return ranges.join(found, list(keys), "left").na.fill(zero)


def sales_by_period(spark: SparkSession, sales: DataFrame, as_of, f: Filters | None = None) -> DataFrame:
    """A2 metrics for every named period P1-P7 in one scan.  Periods
    without sales report zeros."""
    return _period_metrics(_segment(sales, f), named_periods(spark, as_of), "period")


_METRICS = ["total_sales", "transactions", "avg_ticket", "total_quantity", "unique_clients"]


def preset_comparison(spark: SparkSession, sales: DataFrame, as_of, a: Filters | None = None,
                      b: Filters | None = None) -> DataFrame:
    """For each compare preset (P8-P14) the A and B metrics and the
    changes (C1), long form: preset, metric, value_a, value_b, abs_change,
    pct_change.  Client / product filters of A apply to B unless ``b`` has its
    own (its dates do not matter)."""
    ranges = preset_ranges(spark, as_of, a)
    if b is None:
        full = _period_metrics(_segment(sales, a), ranges, "preset", "side")
    else:
        full = _period_metrics(_segment(sales, a), ranges.filter("side = 'a'"), "preset", "side").unionByName(
            _period_metrics(_segment(sales, b), ranges.filter("side = 'b'"), "preset", "side"))
    full = full.select("preset", "side", *[F.col(k).cast("double").alias(k) for k in _METRICS])
    stack = ", ".join(f"'{k}', {k}" for k in _METRICS)
    long = full.selectExpr("preset", "side", f"stack({len(_METRICS)}, {stack}) as (metric, value)")
    wide = (long.groupBy("preset", "metric")
                .agg(F.max(F.when(F.col("side") == "a", F.col("value"))).alias("value_a"),
                     F.max(F.when(F.col("side") == "b", F.col("value"))).alias("value_b")))
    return (wide.withColumn("abs_change", F.col("value_b") - F.col("value_a"))
                .withColumn("pct_change", safe_pct_change("value_a", "value_b")))
