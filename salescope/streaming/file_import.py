"""Drop-folder imports (the batch importers of ``operators.ingest`` run per
micro-batch).

* Source: ``readStream.csv`` with an all-string schema of the file layout
  (header names as written; mapped to logical names by the alias rules).
* Each micro-batch is validated with the batch rules and written with
  ``foreachBatch``: valid rows and rejected rows go to Parquet tables
  partitioned by ``batch_id``; a replayed batch overwrites its own partition
  (dynamic partition overwrite), so a restart after a lost executor or driver
  never duplicates rows.  Progress is tracked in the checkpoint folder, which
  must be on shared storage on a cluster.
* A sales batch also writes the clients that the client store lacks.
* Leads are deduplicated against the other batches of the store (anti-joins);
  their rejected, status-less and duplicate rows are written beside it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import ingest as I
from ..session import cut_lineage, drop_cut
from ..sources.delimited import map_headers


def _string_schema(headers: list[str]) -> str:
    return ", ".join(f"`{h}` string" for h in headers)


def _stream(spark: SparkSession, input_dir: str, headers: list[str], kind: str, sep: str) -> DataFrame:
    raw = (spark.readStream.schema(_string_schema(headers)).option("header", True)
                .option("sep", sep).csv(input_dir))
    m = map_headers(spark, headers, kind)
    return raw.select(F.input_file_name().alias("_file"),
                      *[F.col(f"`{real}`").alias(logical) for logical, real in m.items()])


def _numbered(df: DataFrame) -> DataFrame:
    """Row reference inside a micro-batch (scan order; not a line number)."""
    return df.withColumn("row_no", F.monotonically_increasing_id())


def _write(df: DataFrame, path: str, batch_id: int):
    (df.withColumn("batch_id", F.lit(batch_id)).write.mode("overwrite")
       .option("partitionOverwriteMode", "dynamic").partitionBy("batch_id").parquet(path))


def _start(src: DataFrame, batch, checkpoint: str, available_now: bool) -> StreamingQuery:
    w = src.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="30 seconds")
    return w.start()


def _exists(spark: SparkSession, path: str) -> bool:
    """Whether a store was written there; storage faults are raised, not taken for "no"."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def _store(spark: SparkSession, path: str, schema: str, batch_id: int) -> DataFrame:
    """The rows that other batches stored (a replayed batch must not meet its own)."""
    if not _exists(spark, path):
        return spark.createDataFrame([], schema)
    stored = spark.read.schema(f"{schema}, batch_id long").parquet(path)
    return stored.filter(F.col("batch_id") != batch_id).drop("batch_id")


def start_sales_import(spark: SparkSession, input_dir: str, output_dir: str, checkpoint: str,
                       headers: list[str], as_of, sep: str = ",", available_now: bool = True,
                       clients: DataFrame | None = None) -> StreamingQuery:
    """Validated sales -> ``{output_dir}/sales``; rejects -> ``{output_dir}/rejected``;
    with ``clients``, those that neither it nor an earlier batch has ->
    ``{output_dir}/new_clients`` (I8)."""
    src = _stream(spark, input_dir, headers, "sales", sep)

    def batch(df: DataFrame, batch_id: int):
        valid, rejected = I.validate_sales(_numbered(df), as_of)
        _write(valid, f"{output_dir}/sales", batch_id)
        _write(rejected, f"{output_dir}/rejected", batch_id)
        if clients is not None:
            added = _store(spark, f"{output_dir}/new_clients", "id string", batch_id)
            known = clients.select("id").union(added.select("id"))
            _write(I.new_clients_from_sales(valid, known), f"{output_dir}/new_clients", batch_id)

    return _start(src, batch, checkpoint, available_now)


def start_leads_import(spark: SparkSession, input_dir: str, store_path: str, clients: DataFrame,
                       checkpoint: str, headers: list[str], as_of, sep: str = ",",
                       available_now: bool = True, report_path: str | None = None) -> StreamingQuery:
    """Lead files -> insert-or-ignore into the Parquet lead store at
    ``store_path`` (created on the first batch, partitioned by ``batch_id``).
    Rejected, status-less and duplicate rows go to ``rejected``,
    ``missing_status`` and ``duplicates`` under ``report_path`` (default:
    ``{store_path}-report``)."""
    src = _stream(spark, input_dir, headers, "leads", sep)
    report = report_path or f"{store_path.rstrip('/')}-report"

    def batch(df: DataFrame, batch_id: int):
        store = _store(spark, store_path, "id string, external_id string, created_at date, source string, "
                                          "status string, meeting_date date, client_id string", batch_id)
        res = I.import_leads(_numbered(df), store.select(*I.LEAD_COLS), clients, as_of,
                             on_unknown_client="null")
        # materialise before writing: the store is also an input of this
        # batch (written once under the shared checkpoint folder, re-read)
        new = cut_lineage(res.valid.select(*I.LEAD_COLS), f"leads-batch-{batch_id}")
        _write(res.rejected, f"{report}/rejected", batch_id)
        for name in ("missing_status", "duplicates"):
            _write(res.extra[name], f"{report}/{name}", batch_id)
        _write(new, store_path, batch_id)
        drop_cut(new)

    return _start(src, batch, checkpoint, available_now)
