"""Stored daily series with exact client bitmaps.

The facts are read once and reduced to two tables that any calendar bucket or
period is rolled up from without them:

* ``days``: per date and product the sales count, amount, least and greatest price;
* ``bits``: per date and range of 32,768 client numbers one bitmap of the clients
  that bought (``bitmap_construct_agg``).

Sums add up and bitmaps are OR-ed (``bitmap_or_agg``), so distinct clients of a
week, a quarter or a named period are exact counts of set bits, where counts of
the days could not be added.  Clients get dense numbers, so the bitmaps are as
short as the number of clients allows; numbers stay when days are appended.

A client that makes up a third of the sales is one row per day before it meets
its number, and one bit behind it.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.buckets import bucket_key, bucket_label, bucket_start, normalize_grouping
from ..functions.metrics import safe_ratio
from ..session import cut_lineage, drop_cut
from .filters import Filters
from .numbering import dense_numbers

@dataclass
class DailyStore:
    """``days`` (date, product_type, n, amt, mn, mx), ``bits`` (date, range, clients)
    and ``clients`` (client_key, number).  A date may have several rows per key
    (days that were appended); every roll-up adds or ORs them."""

    days: DataFrame
    bits: DataFrame
    clients: DataFrame


def _reduced(sales: DataFrame) -> DataFrame:
    """The facts, read once: a row per client, product and day."""
    return cut_lineage(
        sales.groupBy(F.coalesce("client_id", "client_name").alias("client_key"), "product_type", "date").agg(
            F.count(F.lit(1)).alias("n"), F.sum("price").alias("amt"), F.min("price").alias("mn"),
            F.max("price").alias("mx")), "daily-facts")


def _days(facts: DataFrame) -> DataFrame:
    return facts.groupBy("date", "product_type").agg(
        F.sum("n").alias("n"), F.sum("amt").cast("decimal(38,2)").alias("amt"), F.min("mn").alias("mn"), F.max("mx").alias("mx"))


def _bits(facts: DataFrame, clients: DataFrame) -> DataFrame:
    bought = facts.select("client_key", "date").distinct().join(clients, "client_key")
    return bought.groupBy("date", F.bitmap_bucket_number("number").alias("range")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position("number")).alias("clients"))


def _stored(df: DataFrame, path: str | None, name: str, mode: str = "overwrite") -> DataFrame:
    """Clustered by date, so that a period reads its files only."""
    in_order = df.repartitionByRange(*([F.col("date")] if "date" in df.columns else [F.col("number")]))
    if path is None:
        return cut_lineage(in_order, f"daily-{name}")
    at = f"{path.rstrip('/')}/{name}"
    in_order.write.mode(mode).parquet(at)
    return df.sparkSession.read.parquet(at)


def build_daily(sales: DataFrame, path: str | None = None) -> DailyStore:
    """The daily store of ``sales``, written once under ``path`` (by default under
    the shared checkpoint folder).  Sales without client id and name count in the
    sums and have no bit; sales without a date are one series of their own."""
    facts = _reduced(sales)
    clients = dense_numbers(facts, "client_key")
    store = DailyStore(_stored(_days(facts), path, "days"), _stored(_bits(facts, clients), path, "bits"),
                       _stored(clients, path, "clients"))
    drop_cut(facts, clients)
    return store


def read_daily(spark: SparkSession, path: str) -> DailyStore:
    return DailyStore(*[spark.read.parquet(f"{path.rstrip('/')}/{name}") for name in ("days", "bits", "clients")])


def append_daily(store: DailyStore, sales: DataFrame, path: str) -> DailyStore:
    """Add more sales to a store written at ``path``: known clients keep their
    numbers, new ones follow.  The store's own rows are neither read again (but
    for the client numbers) nor rewritten."""
    facts = _reduced(sales)
    unknown = facts.select("client_key").join(store.clients.select("client_key"), "client_key", "left_anti")
    last = store.clients.agg(F.coalesce(F.max("number"), F.lit(0)).alias("n")).first().n
    fresh = dense_numbers(unknown, "client_key", after=last)
    bits = cut_lineage(_bits(facts, store.clients.unionByName(fresh)), "daily-bits")
    _stored(_days(facts), path, "days", "append")
    _stored(bits, path, "bits", "append")
    _stored(fresh, path, "clients", "append")
    drop_cut(facts, fresh, bits)
    return read_daily(sales.sparkSession, path)


def _in_dates(f: Filters | None) -> Column:
    if f is not None and f.client_name:
        raise ValueError("a daily store holds all clients: build one of the client's sales")
    return F.lit(True) if f is None else Filters(f.date_start, f.date_end).predicate()


def _of_product(f: Filters | None) -> Column:
    return F.lit(True) if f is None or not f.product_type else F.col("product_type") == f.product_type


def _counted(bits: DataFrame, *keys: str) -> DataFrame:
    """Distinct clients per key: ranges OR-ed, then their set bits added."""
    merged = bits.groupBy(*keys, "range").agg(F.bitmap_or_agg("clients").alias("clients"))
    return merged.groupBy(*keys).agg(F.sum(F.bitmap_count("clients")).alias("unique_clients"))


def daily_unique_clients(store: DailyStore, f: Filters | None = None) -> DataFrame:
    """A3 over a date range: one row, from the bitmaps alone."""
    if f is not None and f.product_type:
        raise ValueError("the bitmaps are not kept by product")
    return _counted(store.bits.filter(_in_dates(f)).withColumn("_all", F.lit(0)), "_all").agg(
        F.coalesce(F.sum("unique_clients"), F.lit(0)).alias("unique_clients"))


def daily_evolution(store: DailyStore, grouping: str, f: Filters | None = None) -> DataFrame:
    """T1 with distinct clients, from the store: key, label, total, transactions,
    unique_clients per bucket; an unknown grouping -> day."""
    g = normalize_grouping(grouping)
    start = bucket_start("date", g).alias("_start")
    sums = store.days.filter(_in_dates(f)).groupBy(start).agg(
        F.sum("amt").cast("double").alias("total"), F.sum("n").alias("transactions"))
    if f is not None and f.product_type:
        raise ValueError("the bitmaps are not kept by product")
    clients = _counted(store.bits.filter(_in_dates(f)).withColumn("_start", bucket_start("date", g)), "_start")
    out = sums.join(clients, sums["_start"].eqNullSafe(clients["_start"]), "left").select(
        bucket_key(sums["_start"], g).alias("key"), bucket_label(sums["_start"], g).alias("label"), "total",
        "transactions", F.coalesce("unique_clients", F.lit(0)).alias("unique_clients"))
    return out.orderBy("key")


def daily_period_metrics(store: DailyStore, ranges: DataFrame, *keys: str) -> DataFrame:
    """A2 metrics of the periods ``ranges`` (keys, start, end) from the store; a
    period without sales has zeros.  Only the days of the periods are read."""
    bounds = ranges.agg(F.min("start").alias("lo"), F.max("end").alias("hi")).first()
    within = F.col("date").between(F.lit(bounds.lo), F.lit(bounds.hi))
    # a row per period and day: bounded by the summed length of the periods
    days = F.broadcast(ranges.select(*keys, F.explode(F.sequence("start", "end")).alias("date")))
    sums = store.days.filter(within).groupBy("date").agg(F.sum("amt").alias("amt"), F.sum("n").alias("n"))
    sums = sums.join(days, "date").groupBy(*keys).agg(F.sum("amt").cast("double").alias("t"), F.sum("n").alias("n"))
    clients = _counted(store.bits.filter(within).join(days, "date"), *keys)
    found = sums.join(clients, list(keys), "left").select(
        *keys, F.col("t").alias("total_sales"), F.col("n").alias("transactions"), safe_ratio("t", "n").alias("avg_ticket"),
        F.col("n").alias("total_quantity"), "unique_clients")
    zero = {"total_sales": 0.0, "transactions": 0, "avg_ticket": 0.0, "total_quantity": 0, "unique_clients": 0}
    return ranges.join(found, list(keys), "left").na.fill(zero)


def stored_daily_ab(store: DailyStore, fa: Filters, fb: Filters) -> DataFrame:
    """``evolution.daily_ab`` from the store: what ``regroup_comparison`` (T6) takes."""
    a, b = (_in_dates(f) & _of_product(f) for f in (fa, fb))
    s = store.days.filter(a | b).select("date", "amt", "n", a.alias("_a"), b.alias("_b"))
    return s.groupBy("date").agg(
        *[F.sum(F.when(F.col(side), F.col("amt"))).alias(f"amt{side}") for side in ("_a", "_b")],
        *[F.coalesce(F.sum(F.when(F.col(side), F.col("n"))), F.lit(0)).alias(f"n{side}") for side in ("_a", "_b")])


def daily_summary(store: DailyStore, f: Filters | None = None) -> DataFrame:
    """A1 of a date range from the store."""
    g = store.days.filter(_in_dates(f) & _of_product(f)).groupBy("product_type").agg(
        F.sum("n").alias("quantity"), F.sum("amt").cast("double").alias("total_sales"),
        F.min("mn").cast("double").alias("min_price"), F.max("mx").cast("double").alias("max_price"))
    return g.select("product_type", "quantity", "total_sales", safe_ratio("total_sales", "quantity").alias("avg_price"),
                    "min_price", "max_price").orderBy(F.desc("total_sales"), F.asc("product_type"))
