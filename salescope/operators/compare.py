"""Period comparison (C1, C2, J6, J7) in one scan of the fact table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.metrics import safe_pct_change, safe_ratio
from .filters import Filters

METRICS = ["total_sales", "transactions", "avg_ticket", "total_quantity", "unique_clients"]


def _flagged(sales: DataFrame, fa: Filters, fb: Filters) -> DataFrame:
    pa, pb = fa.predicate(), fb.predicate()
    return sales.filter(pa | pb).withColumn("_a", pa).withColumn("_b", pb)


def ab_metrics(sales: DataFrame, fa: Filters, fb: Filters) -> DataFrame:
    """A2 for both periods as one row (suffixes _a / _b).  A per-client
    pre-aggregate (map-side combined) gives unique clients per side without a
    double COUNT DISTINCT."""
    s = _flagged(sales, fa, fb)
    pc = s.groupBy(F.coalesce("client_id", "client_name").alias("_ck")).agg(
        F.sum(F.when(F.col("_a"), F.col("price"))).alias("amt_a"),
        F.sum(F.when(F.col("_b"), F.col("price"))).alias("amt_b"),
        F.count_if(F.col("_a")).alias("n_a"), F.count_if(F.col("_b")).alias("n_b"))
    g = pc.agg(F.sum("amt_a").alias("t_a"), F.sum("amt_b").alias("t_b"),
               F.sum("n_a").alias("n_a"), F.sum("n_b").alias("n_b"),
               *[F.count_if((F.col(f"n_{x}") > 0) & F.col("_ck").isNotNull()).alias(f"u_{x}") for x in "ab"])
    cols = []
    for side in ("a", "b"):
        t = F.coalesce(F.col(f"t_{side}").cast("double"), F.lit(0.0))
        n = F.coalesce(F.col(f"n_{side}"), F.lit(0)).cast("long")
        cols += [t.alias(f"total_sales_{side}"), n.alias(f"transactions_{side}"),
                 safe_ratio(t, n).alias(f"avg_ticket_{side}"), n.alias(f"total_quantity_{side}"),
                 F.coalesce(F.col(f"u_{side}"), F.lit(0)).cast("long").alias(f"unique_clients_{side}")]
    return g.select(*cols)


def compare_metrics(sales: DataFrame, fa: Filters, fb: Filters) -> DataFrame:
    """Per metric value_a, value_b, abs_change = B - A, pct_change."""
    m = ab_metrics(sales, fa, fb)
    stack = ", ".join(f"'{k}', cast({k}_a as double), cast({k}_b as double)" for k in METRICS)
    long = m.selectExpr(f"stack({len(METRICS)}, {stack}) as (metric, value_a, value_b)")
    return (long.withColumn("abs_change", F.col("value_b") - F.col("value_a"))
                .withColumn("pct_change", safe_pct_change("value_a", "value_b")))


def compare_products(sales: DataFrame, fa: Filters, fb: Filters) -> DataFrame:
    """Product asc, value A, value B, difference, pct change; a
    product appears when it sold in either period."""
    s = _flagged(sales, fa, fb)
    g = s.groupBy("product_type").agg(
        F.sum(F.when(F.col("_a"), F.col("price"))).alias("_va"),
        F.sum(F.when(F.col("_b"), F.col("price"))).alias("_vb"))
    va = F.coalesce(F.col("_va").cast("double"), F.lit(0.0))
    vb = F.coalesce(F.col("_vb").cast("double"), F.lit(0.0))
    out = g.select("product_type", va.alias("value_a"), vb.alias("value_b"))
    return (out.withColumn("difference", F.col("value_b") - F.col("value_a"))
               .withColumn("pct_change", safe_pct_change("value_a", "value_b"))
               .orderBy("product_type"))
