"""Sales aggregates.

Money is summed as DECIMAL(18,2) (exact, order-independent across
partitions) and cast to DOUBLE once per group; averages are sum / count.
Every aggregate is a hash aggregate with a map-side partial step, so a product
or client holding a third of all rows costs one partial row per task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.metrics import safe_pct, safe_ratio
from .filters import Filters, filter_sales


def money_sum(c="price"):
    return F.sum(F.col(c) if isinstance(c, str) else c).cast("double")


def sales_summary(sales: DataFrame, f: Filters | None = None) -> DataFrame:
    """A1: per product_type quantity, total, avg, min, max; total desc
    (product_type breaks ties)."""
    s = filter_sales(sales, f)
    g = s.groupBy("product_type").agg(
        F.count(F.lit(1)).alias("quantity"),
        F.sum("price").alias("_total"),
        F.min("price").cast("double").alias("min_price"),
        F.max("price").cast("double").alias("max_price"),
    )
    total = F.col("_total").cast("double")
    return (g.select("product_type", "quantity", total.alias("total_sales"),
                     (total / F.col("quantity")).alias("avg_price"),
                     "min_price", "max_price")
             .orderBy(F.desc("total_sales"), F.asc("product_type")))


def overall_average(summary: DataFrame) -> DataFrame:
    """A1 second result: total / transactions over the product rows."""
    return summary.agg(safe_ratio(F.sum("total_sales"), F.sum("quantity")).alias("avg_ticket"))


def _per_client(s: DataFrame) -> DataFrame:
    """Pre-aggregate by client key (COALESCE(client_id, client_name))."""
    return (s.groupBy(F.coalesce("client_id", "client_name").alias("_ck"))
             .agg(F.sum("price").alias("_amt"), F.count(F.lit(1)).alias("_n")))


def period_metrics(sales: DataFrame, f: Filters | None = None) -> DataFrame:
    """A2: total_sales, transactions, avg_ticket, total_quantity (= transactions),
    unique_clients as one row.

    Unique clients come from a per-client pre-aggregate (one shuffle on the
    client key with map-side combine) instead of a COUNT DISTINCT next to the
    sums, which would Expand every row.
    """
    pc = _per_client(filter_sales(sales, f))
    g = pc.agg(F.sum("_amt").alias("_t"), F.sum("_n").alias("_n"),
               F.count("_ck").alias("unique_clients"))     # rows without id and name are no client
    t = F.coalesce(F.col("_t").cast("double"), F.lit(0.0))
    n = F.coalesce(F.col("_n"), F.lit(0)).cast("long")
    return g.select(t.alias("total_sales"), n.alias("transactions"),
                    safe_ratio(t, n).alias("avg_ticket"), n.alias("total_quantity"),
                    F.col("unique_clients").cast("long").alias("unique_clients"))


def unique_clients(sales: DataFrame, f: Filters | None = None) -> DataFrame:
    """A3: COUNT(DISTINCT COALESCE(client_id, client_name)), exact."""
    s = filter_sales(sales, f)
    return s.agg(F.count_distinct(F.coalesce("client_id", "client_name")).alias("unique_clients"))


def sales_date_range(sales: DataFrame) -> DataFrame:
    """First and last sale date."""
    return sales.agg(F.min("date").alias("min_date"), F.max("date").alias("max_date"))


def product_distribution(sales: DataFrame, f: Filters | None = None) -> DataFrame:
    """Label, value, percentage of the total (0 when total <= 0) and a
    colour index by value desc.  The grand total is a one-row aggregate of
    the per-product result joined back (no unpartitioned window over sales);
    the index window runs on the already-aggregated product rows only."""
    per = (filter_sales(sales, f).groupBy(F.col("product_type").alias("label"))
           .agg(F.sum("price").alias("_v")))
    tot = per.agg(F.sum("_v").alias("_tot"))
    v = F.col("_v").cast("double")
    out = per.crossJoin(F.broadcast(tot)).select(
        "label", v.alias("value"),
        safe_pct(F.col("_v"), F.col("_tot")).alias("percentage"))
    from pyspark.sql import Window as W
    idx = F.row_number().over(W.orderBy(F.desc("value"), F.asc("label"))) - 1
    return out.withColumn("color_index", idx.cast("long"))


def product_year_report(sales: DataFrame, year: int) -> DataFrame:
    """Product sum / count within one calendar year (bench query)."""
    f = Filters(f"{year:04d}-01-01", f"{year:04d}-12-31")
    s = filter_sales(sales, f)
    return (s.groupBy("product_type")
             .agg(money_sum().alias("total_sales"), F.count(F.lit(1)).alias("quantity")))


def summary_with_total(sales: DataFrame, f: Filters | None = None, sort_by: str = "total_sales",
                       ascending: bool = False) -> DataFrame:
    """K1: product rows sorted by any column (numbers as numbers, text
    case-insensitive, NULL as ''), with a TOTAL row always last.

    The TOTAL row is aggregated from the per-product rows (sums of sums, min
    of mins...), not by a ROLLUP, which would Expand every sales row twice
    before the partial aggregation."""
    s = filter_sales(sales, f)
    per = (s.groupBy("product_type")
            .agg(F.count(F.lit(1)).alias("quantity"), F.sum("price").alias("_t"),
                 F.min("price").alias("_mn"), F.max("price").alias("_mx")))
    tot = per.agg(F.lit("TOTAL").alias("product_type"), F.sum("quantity").alias("quantity"),
                  F.sum("_t").alias("_t"), F.min("_mn").alias("_mn"), F.max("_mx").alias("_mx"))
    both = (per.withColumn("_gid", F.lit(0))
               .unionByName(tot.withColumn("_gid", F.lit(1)))
               .filter(F.col("quantity") > 0))
    t = F.col("_t").cast("double")
    out = both.select("product_type", F.col("quantity").cast("long").alias("quantity"), t.alias("total_sales"),
                      (t / F.col("quantity")).alias("avg_price"),
                      F.col("_mn").cast("double").alias("min_price"),
                      F.col("_mx").cast("double").alias("max_price"), "_gid")
    key = F.col(sort_by)
    if sort_by == "product_type":
        key = F.lower(F.coalesce(key, F.lit("")))
    key = key.asc() if ascending else key.desc()
    return out.orderBy(F.col("_gid").asc(), key, F.col("product_type").asc()).drop("_gid")


def client_totals(sales: DataFrame, f: Filters | None = None) -> DataFrame:
    """Per client_id: name (of the latest day, the greatest on ties),
    transactions, amount and latest sale date; NULL client_id skipped.  The fact
    rows go through a hash aggregate per (client, name, day); only its small
    result meets the string-valued ``max_by``, which Spark sorts for."""
    s = filter_sales(sales, f).filter(F.col("client_id").isNotNull())
    daily = s.groupBy("client_id", "client_name", "date").agg(
        F.count(F.lit(1)).alias("_n"), F.sum("price").alias("_p"))
    return daily.groupBy("client_id").agg(
        F.max_by("client_name", F.struct("date", "client_name")).alias("name"),
        F.sum("_n").alias("transactions"), F.sum("_p").alias("_amt"), F.max("date").alias("last_date"))


def top_clients(sales: DataFrame, f: Filters | None = None, n: int = 5,
                by: str = "amount") -> DataFrame:
    """Top-N clients by amount (default) or by number of purchases,
    with share of the period total.  Ties: latest sale date desc, client_id.
    ``orderBy().limit()`` plans as TakeOrderedAndProject (per-task top-N,
    then a merge of N rows per task)."""
    per = client_totals(sales, f)
    tot = filter_sales(sales, f).agg(F.sum("price").alias("_tot"))        # sales without a client count, too
    amt = F.col("_amt").cast("double")
    ranked = per.crossJoin(F.broadcast(tot)).select(
        "client_id", "name", amt.alias("total_amount"),
        F.col("transactions").cast("long").alias("transactions"),
        safe_pct(F.col("_amt"), F.col("_tot")).alias("percentage_of_total"), "last_date")
    primary = F.desc("total_amount") if by == "amount" else F.desc("transactions")
    secondary = F.desc("transactions") if by == "amount" else F.desc("total_amount")
    top = ranked.orderBy(primary, secondary, F.desc("last_date"), F.asc("client_id")).limit(n)
    from pyspark.sql import Window as W
    rank = F.row_number().over(W.orderBy(primary, secondary, F.desc("last_date"), F.asc("client_id")))
    return top.withColumn("rank", rank.cast("long")).drop("last_date")
