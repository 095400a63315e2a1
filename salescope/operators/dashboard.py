"""Dashboard KPIs (A21, K5): a handful of global aggregates, each one row,
combined with cross joins of single-row frames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.metrics import safe_pct
from .filters import reached_meeting


def dashboard_kpis(sales: DataFrame, clients: DataFrame, leads: DataFrame, as_of,
                   import_log: DataFrame | None = None) -> DataFrame:
    """has_data, sales_rows, clients_rows, last_import, total_leads,
    leads_with_meeting, leads_conversion_rate (with client / total * 100,
    unrounded), leads_this_month (``as_of``'s calendar month)."""
    month = F.trunc(F.lit(str(as_of)[:10]).cast("date"), "month")
    s = sales.agg(F.count(F.lit(1)).alias("sales_rows"))
    c = clients.agg(F.count(F.lit(1)).alias("clients_rows"))
    l = leads.agg(F.count(F.lit(1)).alias("total_leads"),
                  F.count_if(reached_meeting()).alias("leads_with_meeting"),
                  F.count_if(F.col("client_id").isNotNull()).alias("_with_client"),
                  F.count_if(F.trunc("created_at", "month") == month).alias("leads_this_month"))
    if import_log is not None:
        li = import_log.agg(F.max("imported_at").alias("last_import"))   # K5
    else:
        li = s.select(F.lit(None).cast("timestamp").alias("last_import"))
    one = F.broadcast                                  # every side is one row
    j = s.crossJoin(one(c)).crossJoin(one(l)).crossJoin(one(li))
    return j.select((F.col("sales_rows") > 0).alias("has_data"), "sales_rows", "clients_rows",
                    "last_import", "total_leads", "leads_with_meeting",
                    safe_pct("_with_client", "total_leads").alias("leads_conversion_rate"),
                    "leads_this_month")
