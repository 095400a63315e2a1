"""Client analytics.

Per-client results are computed for *all* clients at once: sales are first
reduced to one row per client (map-side partial aggregation), and only those
per-client rows are joined, so the fact table is never replicated by a join.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .filters import Filters, filter_sales

DASH = "-"


def sales_enriched(sales: DataFrame, clients: DataFrame, f: Filters | None = None) -> DataFrame:
    """Sales with the client's cif / email / phone (contact person) /
    address; '-' in all four when the client is not in the store (a stored
    client's NULLs stay NULL).  A listing orders it (date desc, id desc)."""
    c = clients.select(F.col("id").alias("_cid"), F.lit(True).alias("_hit"),
                       F.col("cif").alias("client_cif"), F.col("email").alias("client_email"),
                       F.col("contact_person").alias("client_phone"),
                       F.col("address").alias("client_address"))
    s = filter_sales(sales, f)
    j = s.join(c, s.client_id == c._cid, "left")
    hit = F.col("_hit").isNotNull()
    fill = [F.when(hit, F.col(n)).otherwise(F.lit(DASH)).alias(n)
            for n in ("client_cif", "client_email", "client_phone", "client_address")]
    return (j.select("id", "date", "client_id", "client_name", "product_type", "price", *fill)
            )


def client_sales_stats(sales: DataFrame, f: Filters | None = None) -> DataFrame:
    """A4: per client_id (NULL skipped): name of the latest day,
    transactions, amount, average and the sorted distinct products.  The
    product set per client is bounded by the product catalogue."""
    s = filter_sales(sales, f).filter(F.col("client_id").isNotNull())
    # hash aggregate of the fact rows first; names and sets meet its small result
    daily = s.groupBy("client_id", "client_name", "product_type", "date").agg(
        F.count(F.lit(1)).alias("_n"), F.sum("price").alias("_p"))
    g = daily.groupBy("client_id").agg(
        F.max_by("client_name", F.struct("date", "client_name")).alias("name"),
        F.sum("_n").alias("total_sales"), F.sum("_p").alias("_amt"),
        F.collect_set("product_type").alias("_p"))
    amt = F.col("_amt").cast("double")
    return g.select("client_id", F.coalesce("name", F.lit(DASH)).alias("name"), "total_sales",
                    amt.alias("total_amount"), (amt / F.col("total_sales")).alias("avg_amount"),
                    F.array_sort("_p").alias("products"))


def all_clients_stats(sales: DataFrame, clients: DataFrame) -> DataFrame:
    """Every client id found in the store or in sales.  Store fields
    win (NULLs kept); sales-only clients get their sales name and '-' fields.
    Count / sum / avg / min / max of their sales, 0 when none."""
    # one scan: a hash aggregate per (client, name) pair (string keys,
    # fixed-width buffers), then a small per-client roll-up of the pairs
    pairs = sales.groupBy("client_id", "client_name").agg(
        F.count(F.lit(1)).alias("_n"), F.sum("price").alias("_amt"),
        F.min("price").alias("_min"), F.max("price").alias("_max"))
    per = pairs.groupBy("client_id").agg(
        F.max("client_name").alias("_sname"), F.sum("_n").alias("_n"), F.sum("_amt").alias("_amt"),
        F.min("_min").alias("_min"), F.max("_max").alias("_max"))
    c = clients.select(F.col("id").alias("_cid"), F.lit(True).alias("_hit"),
                       "name", "cif", "address", "contact_person", "email")
    j = per.join(c, per.client_id == c._cid, "full_outer")
    hit = F.col("_hit").isNotNull()
    field = lambda n: F.when(hit, F.col(n)).otherwise(F.lit(DASH)).alias(n)
    n = F.coalesce(F.col("_n"), F.lit(0)).cast("long")
    amt = F.coalesce(F.col("_amt").cast("double"), F.lit(0.0))
    return j.select(
        F.when(hit, F.col("_cid")).otherwise(F.col("client_id")).alias("client_id"),
        F.when(hit, F.col("name")).otherwise(F.col("_sname")).alias("name"),
        field("cif"), field("address"), field("contact_person"), field("email"),
        n.alias("total_sales"), amt.alias("total_amount"),
        F.when(n > 0, amt / n).otherwise(F.lit(0.0)).alias("avg_amount"),
        F.coalesce(F.col("_min").cast("double"), F.lit(0.0)).alias("min_amount"),
        F.coalesce(F.col("_max").cast("double"), F.lit(0.0)).alias("max_amount"))


def last_n_per_key(df: DataFrame, key: str, order_cols: list, n: int) -> DataFrame:
    """The latest ``n`` rows per key.  ``row_number() <= n`` lets the
    optimizer insert a partial WindowGroupLimit before the shuffle, so each
    task forwards at most ``n`` rows per key (a key holding a third of the
    data does not flood one task)."""
    w = Window.partitionBy(key).orderBy(*order_cols)
    return (df.withColumn("rank", F.row_number().over(w))
              .filter(F.col("rank") <= n))


def last_sales_per_client(sales: DataFrame, n: int = 10) -> DataFrame:
    """A client's last ``n`` sales (date desc, id desc)."""
    s = sales.filter(F.col("client_id").isNotNull())
    return last_n_per_key(s, "client_id", [F.desc("date"), F.desc("id")], n)


def last_events_per_client(events: DataFrame, n: int = 5) -> DataFrame:
    """Last ``n`` funnel events per client (event_date desc, id desc)."""
    e = events.filter(F.col("client_id").isNotNull())
    return last_n_per_key(e, "client_id", [F.desc("event_date"), F.desc("id")], n)


def client_profile_stats(sales: DataFrame) -> DataFrame:
    """Per client count, sum, average (the last sales are W4)."""
    s = sales.filter(F.col("client_id").isNotNull())
    g = s.groupBy("client_id").agg(F.count(F.lit(1)).alias("total_sales"), F.sum("price").alias("_amt"))
    amt = F.col("_amt").cast("double")
    return g.select("client_id", "total_sales", amt.alias("total_amount"),
                    (amt / F.col("total_sales")).alias("avg_amount"))


def customer_360(sales: DataFrame, clients: DataFrame, leads: DataFrame,
                 events: DataFrame, n_events: int = 5) -> DataFrame:
    """One row per client (store or sales-derived) with A6 stats, the
    latest lead and the last ``n_events`` funnel events (bounded array)."""
    from .leads import latest_lead_per_client
    base = all_clients_stats(sales, clients).select(
        "client_id", "name", "cif", "address", "contact_person", "email",
        "total_sales", "total_amount", "avg_amount")
    ll = latest_lead_per_client(leads).select(
        F.col("client_id").alias("_lc"), F.col("source").alias("lead_source"),
        F.col("status").alias("lead_status"), F.col("created_at").alias("lead_created_at"))
    ev = (last_events_per_client(events, n_events)
          .groupBy(F.col("client_id").alias("_ec"))
          .agg(F.array_sort(F.collect_list(F.struct(
              F.col("rank"), F.concat_ws(" ", "event_type", F.date_format("event_date", "yyyy-MM-dd")).alias("e"))))
              .alias("_ev")))
    j = (base.join(ll, base.client_id == ll._lc, "left")
             .join(ev, base.client_id == ev._ec, "left"))
    return j.select("client_id", "name", "cif", "address", "contact_person", "email",
                    "total_sales", "total_amount", "avg_amount", "lead_source", "lead_status",
                    "lead_created_at",
                    F.coalesce(F.transform("_ev", lambda x: x["e"]),
                               F.array().cast("array<string>")).alias("last_events"))


def duplicate_flags(clients: DataFrame) -> DataFrame:
    """J11 in batch form: for every client, whether *another* client has the
    same CIF (upper + trim; blank and '-' ignored) or the same lower-case
    name.  Keys are counted once per group and joined back: no pairs."""
    cif_key = F.upper(F.trim("cif"))
    name_key = F.lower(F.trim("name"))
    usable = F.col("cif").isNotNull() & ~F.trim("cif").isin("", DASH)
    by_cif = (clients.filter(F.col("cif").isNotNull())
              .groupBy(F.col("cif").alias("_k")).agg(F.count(F.lit(1)).alias("_nc")))
    by_name = (clients.groupBy(F.lower("name").alias("_nk")).agg(F.count(F.lit(1)).alias("_nn")))
    c = clients.select("id", "name", "cif", cif_key.alias("_ck"), name_key.alias("_nm"),
                       usable.alias("_use"), (F.col("cif") == cif_key).alias("_self_c"),
                       (F.lower("name") == name_key).alias("_self_n"))
    j = (c.join(by_cif, c._ck == by_cif._k, "left")
          .join(by_name, c._nm == by_name._nk, "left"))
    others_c = F.coalesce("_nc", F.lit(0)) - F.when(F.col("_self_c"), 1).otherwise(0)
    others_n = F.coalesce("_nn", F.lit(0)) - F.when(F.col("_self_n"), 1).otherwise(0)
    return j.select("id", "name", "cif",
                    (F.col("_use") & (others_c > 0)).alias("duplicate_cif"),
                    (others_n > 0).alias("duplicate_name"))
