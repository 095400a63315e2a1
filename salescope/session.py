"""Session helpers: a tuned local session for tests / bench and the shared
checkpoint folder used to cut lineage in multi-step jobs."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession

# Settings every operator relies on: UTC dates, ANSI arithmetic (we guard every
# division), AQE for runtime coalescing / skew splitting / join re-planning.
BASE_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    # size shuffle partitions by bytes, not by default parallelism (Spark's
    # advice for busy clusters: no swarm of tiny post-shuffle tasks)
    "spark.sql.adaptive.coalescePartitions.parallelismFirst": "false",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "128m",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.localShuffleReader.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def build_session(master: str | None = None, shuffle_partitions: int = 8,
                  app_name: str = "salescope", extra: dict | None = None) -> SparkSession:
    """Create (or reuse) a session with the settings above.

    On a cluster the launcher supplies ``master``; locally we default to
    ``local[*]``.  ``shuffle_partitions`` is the AQE starting point: AQE
    coalesces small partitions at runtime, so on a cluster set it to
    roughly total-shuffle-bytes / 128 MB.
    """
    b = SparkSession.builder.appName(app_name)
    if master:
        b = b.master(master)
    elif not os.environ.get("SPARK_MASTER"):
        b = b.master("local[*]")
    conf = dict(BASE_CONF)
    conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.setdefault("spark.driver.memory", os.environ.get("SALESCOPE_DRIVER_MEMORY", "8g"))
    if extra:
        conf.update(extra)
    for k, v in conf.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """Shared folder for lineage cuts (checkpoint() / written tables).

    On a cluster ``spark.checkpoint.dir`` names a shared folder and is used as
    is (a cluster session without it is an error).  Only a local session
    without it (tests) gets a private scratch folder.
    """
    d = spark.conf.get("spark.checkpoint.dir", None)
    if not d:
        d = spark.sparkContext.getCheckpointDir()
    if not d:
        if not spark.sparkContext.master.startswith("local"):
            # executors would each write to their own disk: refuse
            raise RuntimeError("set spark.checkpoint.dir to a folder shared by the cluster")
        d = tempfile.mkdtemp(prefix="salescope-ckpt-")
        spark.conf.set("spark.checkpoint.dir", d)
    try:
        current = spark.sparkContext.getCheckpointDir()
    except Exception:  # pragma: no cover - older pyspark
        current = None
    if not current:
        spark.sparkContext.setCheckpointDir(d)
    return d


def cut_lineage(df, name: str = "step"):
    """Materialise ``df`` as a Parquet table under the shared checkpoint
    folder (``spark.checkpoint.dir``) and return the re-read table: the plan
    runs once, later steps read the written files, and a lost executor
    recomputes from there instead of from the first scan.  (An eager
    ``Dataset.checkpoint`` would compute an unpersisted plan twice.)"""
    import uuid
    base = checkpoint_dir(df.sparkSession).rstrip("/")
    path = f"{base}/salescope-{name}-{uuid.uuid4().hex}"
    df.write.mode("overwrite").parquet(path)
    out = df.sparkSession.read.parquet(path)
    out._cut_path = path
    return out


def drop_cut(*tables) -> None:
    """Delete tables that ``cut_lineage`` wrote, once nothing reads them any more."""
    for df in tables:
        path = getattr(df, "_cut_path", None)
        if path:
            jvm = df.sparkSession._jvm
            at = jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(at, True)
