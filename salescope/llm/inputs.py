"""Input conventions shared by the operators of this subpackage."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def pick(df: DataFrame, **columns: str) -> DataFrame:
    """Project ``df`` to the named roles (role=column).  Every operator starts
    with this, so extra columns of its input, whatever their names, can never
    clash with the operator's own working columns."""
    return df.select(*[df[c].alias(role) for role, c in columns.items()])


def id_split(doc_id: str, buckets: int) -> Column:
    """crc32 of the id's decimal text, modulo ``buckets`` (null id: the empty text)."""
    text = F.coalesce(F.col(doc_id).cast("string"), F.lit(""))
    return F.pmod(F.crc32(text.cast("binary")), F.lit(buckets))


def share(spark: SparkSession, value) -> Callable:
    """Broadcast an object of this package (of bounded size); the function
    returned gives it back inside a task."""
    packed = spark.sparkContext.broadcast(cloudpickle.dumps(value))
    return lambda: cloudpickle.loads(packed.value)


#: settings of ``small_batches``: Arrow bytes passed to Python at a time (Spark: 64 MB, which
#: holds the texts of a whole task) and rows that a Parquet scan decodes at a time (Spark: 4096)
_SMALL_BATCHES = {"spark.sql.execution.arrow.maxBytesPerBatch": "4m", "spark.sql.parquet.columnarReaderBatchSize": "512"}


@contextmanager
def small_batches(spark: SparkSession):
    """Jobs that run inside take long rows (texts, sets) a few megabytes at a time.  Larger
    batches are held several times: decoded on the heap, in the executor's native memory while
    they grow there, and in its Python worker.  The settings go back afterwards, so plans that
    need them must run inside."""
    before = {key: spark.conf.get(key) for key in _SMALL_BATCHES}
    try:
        for key, value in _SMALL_BATCHES.items():
            spark.conf.set(key, value)
        yield
    finally:
        for key, value in before.items():
            spark.conf.set(key, value)


def pieces(batch: pa.RecordBatch, rows: int = 256) -> Iterator[pa.RecordBatch]:
    """A batch a few rows at a time, for steps that make Python objects of its values."""
    for a in range(0, batch.num_rows, rows):
        yield batch.slice(a, rows)
