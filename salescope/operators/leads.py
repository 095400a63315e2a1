"""Lead analytics.

All counts are conditional aggregates in one pass; per-source and per-client
aggregates have map-side partial steps, so a source or client with a third of
all leads does not concentrate raw rows in one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.metrics import safe_pct
from .filters import reached_meeting

UNKNOWN = "unknown"


def leads_enriched(leads: DataFrame, clients: DataFrame) -> DataFrame:
    """Leads with the client's name ('—' when unknown).  A listing orders it
    (created_at desc, id desc).  Most leads have no client: they stay out of the
    join, whose one partition for NULL keys they would fill."""
    c = clients.select(F.col("id").alias("_cid"), F.col("name").alias("_cname"))
    known = leads.filter("client_id is not null").join(c, F.col("client_id") == F.col("_cid"), "left")
    known = known.select(*leads.columns, F.coalesce(F.col("_cname"), F.lit("—")).alias("client_name"))
    return known.unionByName(leads.filter("client_id is null").withColumn("client_name", F.lit("—")))


def _days() -> F.Column:
    both = F.col("meeting_date").isNotNull() & F.col("created_at").isNotNull()
    return F.when(both, F.datediff("meeting_date", "created_at"))


def leads_stats(leads: DataFrame) -> DataFrame:
    """Total, with_meeting (status meeting/converted), with_client."""
    return leads.agg(F.count(F.lit(1)).alias("total_leads"),
                     F.count_if(reached_meeting()).alias("with_meeting"),
                     F.count_if(F.col("client_id").isNotNull()).alias("with_client"))


def leads_count_by_source(leads: DataFrame) -> DataFrame:
    """A7 second part: count per raw source, source asc."""
    return leads.groupBy("source").agg(F.count(F.lit(1)).alias("leads")).orderBy("source")


def funnel_stats(leads: DataFrame) -> DataFrame:
    """Funnel KPIs in one global aggregate (plus A27 direct clients)."""
    st = F.col("status")
    g = leads.agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(reached_meeting()).alias("meetings"),
        F.count_if(st == "converted").alias("converted"),
        F.count_if(st == "lost").alias("lost"),
        F.count_if((st == "converted") & F.col("meeting_date").isNotNull()).alias("converted_from_meeting"),
        F.sum(_days().cast("long")).alias("_days"),
        F.count(_days()).alias("_ndays"))
    return g.select(
        "total", "meetings", "converted", "lost",
        safe_pct("meetings", "total").alias("lead_to_meeting_pct"),
        safe_pct("converted_from_meeting", "meetings").alias("meeting_to_client_pct"),
        (F.col("total") - F.col("meetings")).alias("lead_dropoff"),
        (F.col("meetings") - F.col("converted")).alias("meeting_dropoff"),
        "converted_from_meeting",
        (F.col("converted") - F.col("converted_from_meeting")).alias("direct_clients"),
        F.when(F.col("_ndays") > 0, F.col("_days").cast("double") / F.col("_ndays"))
         .otherwise(F.lit(0.0)).alias("avg_time_to_meeting"))


def source_or_unknown(c="source") -> F.Column:
    s = F.col(c)
    return F.when(s.isNull() | (s == ""), F.lit(UNKNOWN)).otherwise(s)


def leads_by_source_stats(leads: DataFrame) -> DataFrame:
    """Per source (NULL / blank -> 'unknown')."""
    st = F.col("status")
    g = leads.groupBy(source_or_unknown().alias("source")).agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(reached_meeting()).alias("meetings"),
        F.count_if(st == "converted").alias("clients"),
        F.count_if((st == "converted") & F.col("meeting_date").isNotNull()).alias("clients_from_meeting"),
        F.sum(_days().cast("long")).alias("time_to_meeting_days_total"),
        F.count(_days()).alias("time_to_meeting_count"))
    return g.select(
        "source", "total", "meetings", "clients", "clients_from_meeting",
        safe_pct("clients_from_meeting", "meetings").alias("meeting_to_client_pct"),
        F.coalesce(F.col("time_to_meeting_days_total"), F.lit(0)).cast("double").alias("time_to_meeting_days_total"),
        "time_to_meeting_count",
        F.when(F.col("time_to_meeting_count") > 0,
               F.col("time_to_meeting_days_total").cast("double") / F.col("time_to_meeting_count"))
         .otherwise(F.lit(0.0)).alias("avg_time_to_meeting"))


def conversion_ranking(by_source: DataFrame) -> DataFrame:
    """A19 (input: A9 rows): conversion % and share of all leads, total desc.
    The grand total is a window over the per-source rows (one per source), so
    the leads are read once."""
    all_ = F.when(F.col("_all") > 0, F.col("_all")).otherwise(F.lit(1))
    return (by_source.withColumn("_all", F.sum("total").over(Window.partitionBy()))
            .select("source", "total", "clients",
                    safe_pct("clients", "total").alias("conversion_rate"),
                    (F.col("total").cast("double") / all_.cast("double")).alias("share"),
                    "meeting_to_client_pct")
            .orderBy(F.desc("total"), F.asc("source")))


def source_share(by_source: DataFrame) -> DataFrame:
    """Percentage of leads per source with a 'src (n%)' label."""
    pct = safe_pct("total", "_all")
    return (by_source.withColumn("_all", F.sum("total").over(Window.partitionBy()))
            .select("source", "total", pct.alias("pct"),
                    F.format_string("%s (%.0f%%)", F.col("source"), pct).alias("label"))
            .orderBy(F.desc("total"), F.asc("source")))


def latest_lead_per_client(leads: DataFrame) -> DataFrame:
    """The most recent lead of each client (created_at desc, id desc
    breaks ties).  ``max_by`` aggregates partially per task, so even a client
    holding a third of the leads ships one struct per task."""
    l = leads.filter(F.col("client_id").isNotNull())
    best = F.max_by(F.struct("id", "source", "status", "created_at", "meeting_date"),
                    F.struct("created_at", "id"))
    return (l.groupBy("client_id").agg(best.alias("_l"))
             .select("client_id", F.col("_l.id").alias("lead_id"), F.col("_l.source").alias("source"),
                     F.col("_l.status").alias("status"), F.col("_l.created_at").alias("created_at"),
                     F.col("_l.meeting_date").alias("meeting_date")))


def clients_with_latest_lead(clients: DataFrame, leads: DataFrame) -> DataFrame:
    """Every client with its latest lead's source, status and date
    ('—' when the client has no lead)."""
    ll = latest_lead_per_client(leads).select(
        F.col("client_id").alias("_cid"), F.col("source").alias("lead_source"),
        F.col("status").alias("lead_status"), F.col("created_at").alias("lead_created_at"))
    j = clients.join(ll, clients.id == ll._cid, "left")
    dash = F.lit("—")
    return j.select(*[clients[c] for c in clients.columns],
                    F.coalesce("lead_source", dash).alias("lead_source"),
                    F.coalesce("lead_status", dash).alias("lead_status"),
                    F.coalesce(F.date_format("lead_created_at", "yyyy-MM-dd"), dash).alias("lead_created_at"))


def upcoming_meetings(leads_enriched_df: DataFrame, as_of, n: int = 3) -> DataFrame:
    """K3: meetings on or after ``as_of``, earliest first, first ``n``
    (TakeOrderedAndProject: per-task top-n, no full sort)."""
    d = F.lit(str(as_of)[:10]).cast("date")
    return (leads_enriched_df.filter(F.col("meeting_date") >= d)
            .orderBy(F.asc("meeting_date"), F.asc("id")).limit(n))
