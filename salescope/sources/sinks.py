"""Sinks (I13, I14, I16-I18): reject files, the ingest log and report tables.

All writes are distributed DataFrame writes into a caller-given folder (on a
cluster a shared one such as ``spark.checkpoint.dir``); nothing is collected
to the driver.  Written tables double as lineage cuts for later jobs.
"""

from __future__ import annotations

import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import clients as CL
from ..operators import ingest as I
from ..operators import leads as L
from ..operators import marketing as M
from ..session import cut_lineage, drop_cut


def write_table(df: DataFrame, path: str, mode: str = "overwrite", partition_by: list[str] | None = None,
                fmt: str = "parquet") -> str:
    w = df.write.mode(mode).format(fmt)
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.save(path)
    return path


def write_store(df: DataFrame, path: str, cluster_by: str = "date", tie: str | None = "id",
                files: int | None = None, mode: str = "overwrite") -> str:
    """Store a fact table clustered by date: a range shuffle on (date, id)
    gives every file a narrow date range (the tie column lets a hot date
    spread over several files), so date filters skip files and row groups
    through Parquet min/max statistics.  This replaces the reference's date
    indexes."""
    keys = [cluster_by] + ([tie] if tie and tie in df.columns else [])
    n = files or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    (df.repartitionByRange(n, *keys).sortWithinPartitions(*keys)
       .write.mode(mode).parquet(path))
    return path


def reread(spark: SparkSession, df: DataFrame, path: str) -> DataFrame:
    """Write and read back: cuts the lineage of a multi-step job so a lost
    executor recomputes from the written table, not from the first scan."""
    write_table(df, path)
    return spark.read.parquet(path)


def write_rejects(rejected: DataFrame, root: str, import_id: str) -> str:
    """Rejected rows (row, error, original columns) as CSV, appended
    under ``import_id=...`` so every import keeps its own report."""
    out = rejected.withColumn("import_id", F.lit(import_id))
    out.write.mode("append").partitionBy("import_id").option("header", True).csv(root)
    return root


def append_import_log(log_row: DataFrame, path: str) -> str:
    """Append-only ingest log."""
    log_row.write.mode("append").parquet(path)
    return path


def append_import(result, sales_path: str, clients_path: str, rejects_path: str, import_id: str) -> None:
    """I8: carry out an import that ``ingest.import_sales`` prepared: sales and
    new clients are appended, rejected rows reported under the import's id.
    The rows to append are written once first, because they were computed
    against the stores that they go to."""
    sales = cut_lineage(result.extra["append"], "import-sales")
    clients = cut_lineage(result.extra["new_clients"], "import-clients")
    clients.write.mode("append").parquet(clients_path)
    sales.write.mode("append").parquet(sales_path)
    write_rejects(result.rejected, rejects_path, import_id)
    drop_cut(sales, clients)


def _import_part(root: str, table: str, import_id: str) -> str:
    return f"{root.rstrip('/')}/{table}/import_id={import_id}"


def committed(spark: SparkSession, root: str, table: str, schema: str, but: str | None = None) -> DataFrame:
    """Rows of ``sales``, ``clients`` or ``rejects`` under ``root`` whose import is in
    the log, with ``import_id``; imports that broke off are not seen.  ``but``
    leaves one import out.  Only the folders of logged imports are read."""
    log = _folders(spark, f"{root.rstrip('/')}/log")
    ids = sorted(i for i in log if i != but and i in _folders(spark, f"{root.rstrip('/')}/{table}"))
    if not ids:
        return spark.createDataFrame([], f"{schema}, import_id string")
    read = spark.read.schema(f"{schema}, import_id string").option("basePath", f"{root.rstrip('/')}/{table}")
    return read.parquet(*[_import_part(root, table, i) for i in ids])


def _folders(spark: SparkSession, path: str) -> list[str]:
    """Ids of the finished partitions ``import_id=...`` in a folder."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(at):
        return []
    found = [f.getPath() for f in fs.listStatus(at) if f.isDirectory()]
    done = [p for p in found if fs.exists(spark._jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS"))]
    return [p.getName().partition("=")[2] for p in done]


SALES_STORE = "id string, client_name string, client_id string, product_type string, price decimal(18,2), date date"
CLIENTS_STORE = "id string, name string, cif string, address string, contact_person string, email string"
LOG_STORE = ("imported_at timestamp, file_name string, total_rows long, valid_rows long, rejected_rows long, "
             "duration_seconds double")


def run_sales_import(raw: DataFrame, root: str, import_id: str, as_of, file_name: str = "import",
                     known_clients: DataFrame | None = None) -> dict:
    """I7, I8, I13 and I14 as one unit: import ``raw`` into the stores under ``root``.

    The raw rows are read once: they are checked and written with their error, and
    that write observes the counts.  Sales, new clients and rejects are derived from
    the written rows, each into its own partition ``import_id=...``.  The log row
    comes last and makes the import visible (``committed``).  An import that broke
    off leaves nothing that is seen, and running it again replaces what it wrote,
    so no row is stored twice; a row that another import stored (same file and row
    number) is left out.  ``known_clients`` (id) are clients of other stores.

    Returns the counts: total, valid, rejected.
    """
    spark, started = raw.sparkSession, time.time()
    rows, seen = I.staged(I.check_sales(raw, as_of), "import-sales")
    key = I.row_key(rows)
    valid = rows.filter("sale is not null").select(*key, "sale.*")
    rejected = rows.filter("sales_error is not null").select(*key, F.col("sales_error").alias("error"), "raw.*")
    file = F.col("_file") if "_file" in key else F.lit(file_name)
    sales = valid.select(F.concat_ws("#", file, F.col("row_no").cast("string")).alias("id"), "client_name", "client_id",
                         "product_type", F.col("price").cast("decimal(18,2)").alias("price"), "date")
    stored = committed(spark, root, "sales", SALES_STORE, but=import_id).select("id")
    clients = committed(spark, root, "clients", CLIENTS_STORE, but=import_id).select("id")
    if known_clients is not None:
        clients = clients.union(known_clients.select("id"))
    write_table(I.new_clients_from_sales(valid, clients), _import_part(root, "clients", import_id))
    write_table(sales.join(stored, "id", "left_anti"), _import_part(root, "sales", import_id))
    write_table(rejected, _import_part(root, "rejects", import_id))
    counts = {"total": seen["total"], "valid": seen["total"] - seen["sales_error"], "rejected": seen["sales_error"]}
    log = I.import_log_row(spark, file_name, counts["valid"], counts["rejected"], started)
    write_table(log.coalesce(1), _import_part(root, "log", import_id))
    drop_cut(rows)
    return counts


def write_snapshot(snapshot: DataFrame, path: str, fmt: str = "json") -> str:
    """I16: a snapshot row (nested) as JSON or Parquet; one small file."""
    snapshot.coalesce(1).write.mode("overwrite").format(fmt).save(path)
    return path


def leads_report_tables(leads_enriched: DataFrame, spend: DataFrame, sales: DataFrame) -> dict[str, DataFrame]:
    """The data behind the leads report: funnel KPIs, per-source table
    (total desc, conversion %), marketing rows and summary, first 50 leads."""
    by_source = L.leads_by_source_stats(leads_enriched)
    mm = M.marketing_metrics_filtered(leads_enriched, spend, sales)
    return {
        "funnel": L.funnel_stats(leads_enriched),
        "by_source": L.conversion_ranking(by_source),
        "marketing": mm,
        "marketing_summary": M.marketing_summary(mm),
        "leads": leads_enriched.orderBy(F.desc("created_at"), F.desc("id")).limit(50),
    }


def client_report_tables(sales: DataFrame, clients: DataFrame, leads: DataFrame,
                         events: DataFrame) -> dict[str, DataFrame]:
    """Client profile + totals for every client and their last ten sales."""
    return {
        "profile": CL.customer_360(sales, clients, leads, events),
        "last_sales": CL.last_sales_per_client(sales, 10),
    }


def write_report(tables: dict[str, DataFrame], root: str) -> dict[str, str]:
    return {name: write_table(df, f"{root.rstrip('/')}/{name}") for name, df in tables.items()}
