"""Time series of sales.

Rows are grouped on the bucket start date; key / label / interval are derived
after the aggregation.  A/B comparisons scan the fact table once with both
period predicates OR-ed (pushed to the scan) and conditional sums per side.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.buckets import (bucket_interval, bucket_key, bucket_label, bucket_start,
                                 check_grouping, is_partial, normalize_grouping)
from ..functions.dates import parse_import_date
from .filters import Filters, filter_sales


def _finish(g: DataFrame, grouping: str) -> DataFrame:
    return g.select(bucket_key("_start", grouping).alias("key"),
                    bucket_label("_start", grouping).alias("label"),
                    *[c for c in g.columns if c != "_start"], "_start")


def sales_evolution(sales: DataFrame, f: Filters | None = None, grouping: str = "day") -> DataFrame:
    """Total per calendar bucket, key ascending; unknown grouping -> day.
    Gaps are not filled (a bucket exists only when it has sales)."""
    g = normalize_grouping(grouping)
    s = filter_sales(sales, f)
    agg = (s.groupBy(bucket_start("date", g).alias("_start"))
            .agg(F.sum("price").cast("double").alias("total")))
    return _finish(agg, g).drop("_start").orderBy("key")


def group_time_series(series: DataFrame, grouping: str, date_col: str = "date",
                      value_col: str = "value") -> DataFrame:
    """Regroup a (date text, value) series; unparsable dates are skipped;
    an unknown grouping is an error."""
    g = check_grouping(grouping)
    d = parse_import_date(F.col(date_col).cast("string"))
    s = series.select(d.alias("_d"), F.col(value_col).alias("_v")).filter(F.col("_d").isNotNull())
    agg = s.groupBy(bucket_start("_d", g).alias("_start")).agg(F.sum("_v").alias("total"))
    return _finish(agg, g).drop("_start").orderBy("key")


def daily_ab(sales: DataFrame, fa: Filters, fb: Filters) -> DataFrame:
    """Daily A/B base: (date, amt_a, amt_b, n_a, n_b) with exact decimal sums.
    Coarser groupings are re-derived from it (T6) without rescanning sales."""
    pa, pb = fa.predicate(), fb.predicate()
    s = sales.filter(pa | pb).select("date", "price", pa.alias("_a"), pb.alias("_b"))
    return s.groupBy("date").agg(
        F.sum(F.when(F.col("_a"), F.col("price"))).alias("amt_a"),
        F.sum(F.when(F.col("_b"), F.col("price"))).alias("amt_b"),
        F.count_if(F.col("_a")).alias("n_a"),
        F.count_if(F.col("_b")).alias("n_b"))


def points_from_daily(daily: DataFrame, grouping: str, fa: Filters, fb: Filters) -> DataFrame:
    """Evolution points from the daily A/B base.

    key, label, start, end (UTC, end = next start - 1 µs), value_a, value_b,
    difference = B - A, is_partial (S12 for A or for B); key ascending.
    Only buckets with rows in A or B appear; the missing side is 0.0.
    """
    g = check_grouping(grouping)
    agg = (daily.groupBy(bucket_start("date", g).alias("_start"))
                .agg(F.sum("amt_a").alias("_a"), F.sum("amt_b").alias("_b"),
                     F.sum("n_a").alias("_na"), F.sum("n_b").alias("_nb"))
                .filter((F.col("_na") > 0) | (F.col("_nb") > 0)))
    start, end = bucket_interval("_start", g)
    va = F.coalesce(F.col("_a").cast("double"), F.lit(0.0))
    vb = F.coalesce(F.col("_b").cast("double"), F.lit(0.0))
    out = agg.select(
        bucket_key("_start", g).alias("key"), bucket_label("_start", g).alias("label"),
        start.alias("start"), end.alias("end"), va.alias("value_a"), vb.alias("value_b"))
    part = (is_partial("start", "end", fa.date_start, fa.date_end)
            | is_partial("start", "end", fb.date_start, fb.date_end))
    return (out.withColumn("difference", F.col("value_b") - F.col("value_a"))
               .withColumn("is_partial", part).orderBy("key"))


def compare_evolution(sales: DataFrame, fa: Filters, fb: Filters, grouping: str) -> DataFrame:
    """T4: rows (key, label, value_a, value_b) on the union of bucket keys."""
    p = points_from_daily(daily_ab(sales, fa, fb), normalize_grouping(grouping), fa, fb)
    return p.select("key", "label", "value_a", "value_b")


def evolution_points(sales: DataFrame, fa: Filters, fb: Filters, grouping: str) -> DataFrame:
    """T5."""
    return points_from_daily(daily_ab(sales, fa, fb), check_grouping(grouping), fa, fb)


# Rank of each grouping, finest first (regroup only to coarser).
GROUPING_RANK = {"day": 0, "week": 1, "month": 2, "quarter": 3, "year": 4}


def regroup_comparison(daily: DataFrame, current: str, new: str, fa: Filters, fb: Filters) -> DataFrame:
    """Rebuild the points at a new grouping from a cached daily base;
    only the same or a coarser grouping is allowed."""
    if GROUPING_RANK[check_grouping(new)] < GROUPING_RANK[check_grouping(current)]:
        raise ValueError(f"cannot regroup {current} -> {new}: only same or coarser")
    return points_from_daily(daily, new, fa, fb)
