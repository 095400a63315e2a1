"""Marketing attribution and efficiency.

Two attributions exist and both are kept:
* first touch (A11/A12/A14): a client belongs to the source of its earliest
  lead (created_at, then id);
* filtered (A17): per source, the distinct converted clients of that source,
  so a client converted through two sources counts in both.

Every per-client input is reduced to one row per client before any join, so
joins are 1:1 on client_id and never replicate the sales fact table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.metrics import safe_ratio
from .leads import source_or_unknown


def first_touch(leads: DataFrame) -> DataFrame:
    """(client_id, source) of each client's first lead."""
    l = leads.filter(F.col("client_id").isNotNull())
    return l.groupBy("client_id").agg(
        F.min_by("source", F.struct("created_at", "id")).alias("source"))


def revenue_per_client(sales: DataFrame) -> DataFrame:
    """Revenue (DECIMAL) per non-null client_id."""
    return (sales.filter(F.col("client_id").isNotNull())
                 .groupBy("client_id").agg(F.sum("price").alias("revenue")))


def leads_by_source(leads: DataFrame) -> DataFrame:
    """A10: leads per source, count desc."""
    return (leads.groupBy("source").agg(F.count(F.lit(1)).alias("leads"))
                 .orderBy(F.desc("leads"), F.asc("source")))


def _first_touch_rev(leads: DataFrame, sales: DataFrame) -> DataFrame:
    return first_touch(leads).join(revenue_per_client(sales), "client_id")


def customers_by_source(leads: DataFrame, sales: DataFrame) -> DataFrame:
    """Distinct clients with sales per first-touch source."""
    return (_first_touch_rev(leads, sales).groupBy("source")
            .agg(F.count(F.lit(1)).alias("customers"))
            .orderBy(F.desc("customers"), F.asc("source")))


def revenue_by_source(leads: DataFrame, sales: DataFrame) -> DataFrame:
    """Revenue per first-touch source."""
    return (_first_touch_rev(leads, sales).groupBy("source")
            .agg(F.sum("revenue").cast("double").alias("revenue"))
            .orderBy(F.desc("revenue"), F.asc("source")))


def spend_by_source(spend: DataFrame) -> DataFrame:
    """A13."""
    return (spend.groupBy("source").agg(F.sum("amount").cast("double").alias("spend"))
                 .orderBy(F.desc("spend"), F.asc("source")))


def _metrics(parts: DataFrame) -> DataFrame:
    """Align per-source parts (union + conditional aggregation = the full
    outer join of J5 without three shuffles) and derive CPL / CAC / ROI."""
    g = parts.groupBy("source").agg(
        F.sum("leads").alias("leads"), F.sum("customers").alias("customers"),
        F.sum("revenue").alias("_rev"), F.sum("spend").alias("_sp"))
    rev = F.coalesce(F.col("_rev"), F.lit(0)).cast("double")
    sp = F.coalesce(F.col("_sp"), F.lit(0)).cast("double")
    leads = F.coalesce(F.col("leads"), F.lit(0)).cast("long")
    cust = F.coalesce(F.col("customers"), F.lit(0)).cast("long")
    out = g.select("source", leads.alias("leads"), cust.alias("customers"),
                   rev.alias("revenue"), sp.alias("spend"))
    return (out.select("*", safe_ratio("spend", "leads").alias("cpl"),
                       safe_ratio("spend", "customers").alias("cac"),
                       safe_ratio(F.col("revenue") - F.col("spend"), F.col("spend")).alias("roi"))
               .orderBy(F.desc("revenue"), F.asc("source")))


def _part(df: DataFrame, **cols) -> DataFrame:
    names = ["leads", "customers", "revenue", "spend"]
    types = {"leads": "long", "customers": "long", "revenue": "decimal(38,2)", "spend": "decimal(38,2)"}
    return df.select(F.col("source"), *[
        (cols[n] if n in cols else F.lit(None)).cast(types[n]).alias(n) for n in names])


def marketing_metrics(leads: DataFrame, sales: DataFrame, spend: DataFrame) -> DataFrame:
    """Per source leads, customers, revenue (first touch), spend, CPL,
    CAC, ROI; revenue desc then source asc.  Values unrounded."""
    l = leads.groupBy("source").agg(F.count(F.lit(1)).alias("n"))
    fr = _first_touch_rev(leads, sales).groupBy("source").agg(
        F.count(F.lit(1)).alias("c"), F.sum("revenue").alias("r"))
    s = spend.groupBy("source").agg(F.sum("amount").alias("a"))
    parts = (_part(l, leads=F.col("n"))
             .unionByName(_part(fr, customers=F.col("c"), revenue=F.col("r")))
             .unionByName(_part(s, spend=F.col("a"))))
    return _metrics(parts)


def marketing_summary(metrics: DataFrame) -> DataFrame:
    """Totals over the per-source rows, weighted CPL / CAC,
    overall ROI and conversion rate (customers / leads)."""
    g = metrics.agg(F.sum("leads").alias("total_leads"), F.sum("customers").alias("total_customers"),
                    F.sum(F.col("revenue").cast("decimal(38,2)")).alias("_rev"),
                    F.sum(F.col("spend").cast("decimal(38,2)")).alias("_sp"))
    rev = F.coalesce(F.col("_rev"), F.lit(0)).cast("double")
    sp = F.coalesce(F.col("_sp"), F.lit(0)).cast("double")
    tl = F.coalesce(F.col("total_leads"), F.lit(0)).cast("long")
    tc = F.coalesce(F.col("total_customers"), F.lit(0)).cast("long")
    return g.select(tl.alias("total_leads"), tc.alias("total_customers"),
                    rev.alias("total_revenue"), sp.alias("total_spend"),
                    safe_ratio(sp, tl).alias("avg_cpl"), safe_ratio(sp, tc).alias("avg_cac"),
                    safe_ratio(rev - sp, sp).alias("overall_roi"),
                    safe_ratio(tc, tl).alias("conversion_rate"))


def marketing_metrics_filtered(leads: DataFrame, spend: DataFrame, sales: DataFrame) -> DataFrame:
    """Metrics over an (already filtered) lead set.  Sources = lead
    sources (NULL / blank -> 'unknown') plus spend sources; customers = the
    distinct converted client ids of that source; revenue = their total
    revenue from the whole sales table."""
    src = source_or_unknown()
    l = leads.groupBy(src.alias("source")).agg(F.count(F.lit(1)).alias("n"))
    conv = (leads.filter((F.col("status") == "converted") & F.col("client_id").isNotNull()
                         & (F.col("client_id") != ""))
                 .select(src.alias("source"), "client_id").distinct())
    cr = (conv.join(revenue_per_client(sales), "client_id", "left")
              .groupBy("source").agg(F.count(F.lit(1)).alias("c"),
                                     F.sum(F.coalesce(F.col("revenue"), F.lit(0))).alias("r")))
    s = spend.groupBy("source").agg(F.sum("amount").alias("a"))
    parts = (_part(l, leads=F.col("n"))
             .unionByName(_part(cr, customers=F.col("c"), revenue=F.col("r")))
             .unionByName(_part(s, spend=F.col("a"))))
    return _metrics(parts)


def best_channel(metrics: DataFrame) -> DataFrame:
    """K4: the source with the highest positive ROI (no row when none)."""
    return metrics.filter(F.col("roi") > 0).orderBy(F.desc("roi"), F.asc("source")).limit(1)


def sources_with_leads(metrics: DataFrame) -> DataFrame:
    """F7 (table): only sources that have leads."""
    return metrics.filter(F.col("leads") > 0)


def sources_for_chart(metrics: DataFrame) -> DataFrame:
    """F7 (chart): only sources with revenue or spend."""
    return metrics.filter((F.col("revenue") > 0) | (F.col("spend") > 0))
