"""Tables bucketed by client, for repeated client queries.

Sales, clients, leads and funnel events are written once into the same number of
buckets of the client id, each bucket sorted by it.  Spark then groups them by
client, ranks them inside a client and joins them with each other without an
exchange of their rows, however often that is done.

A bucket is read by one task, so a client that holds a large share of the rows
would make one task as large.  Clients with more rows than ``HOT`` average buckets
(fewer than ``buckets`` of them), and rows without a client, are kept in plain
files next to the buckets, of all tables alike.  ``ClientStore.run`` applies an
operator to both halves: no client is in both, so the results just follow each
other.  The plain half is small in clients and may be large in rows; there the
operators' partial aggregation and group limits reduce the rows before they meet.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import checkpoint_dir, cut_lineage, drop_cut

#: average buckets that a client may fill before it is kept apart
HOT = 0.5


class ClientStore:
    """Two halves of every table: ``usual`` in buckets, ``hot`` in plain files."""

    def __init__(self, spark: SparkSession, names: dict[str, tuple[str, DataFrame, DataFrame]], hot_ids: list):
        self.spark, self._names, self.hot_ids = spark, names, hot_ids
        self.usual = {name: spark.table(table) for name, (table, _, _) in names.items()}
        self.hot = {name: hot for name, (_, _, hot) in names.items()}

    def run(self, operator: Callable[..., DataFrame], *names: str) -> DataFrame:
        """The operator's rows over the named tables.  It must work client by client."""
        return operator(*[self.usual[n] for n in names]).unionByName(operator(*[self.hot[n] for n in names]))

    def table(self, name: str) -> DataFrame:
        """All rows of a table."""
        return self.usual[name].unionByName(self.hot[name])

    def drop(self) -> None:
        """Delete the tables, once nothing reads them any more."""
        for table, files, hot in self._names.values():
            self.spark.sql(f"drop table if exists {table}")
            drop_cut(files, hot)


def hot_clients(tables: dict[str, tuple[DataFrame, str]], buckets: int, hot: float = HOT) -> list:
    """Clients with more than ``hot`` average buckets of rows of any table: at most
    ``buckets / hot`` a table."""
    found = set()
    for df, key in tables.values():
        counts = df.filter(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("n"))
        limit = max(1.0, df.count() / buckets * hot)
        found |= {r[key] for r in counts.filter(F.col("n") > limit).select(key).collect()}
    return sorted(found)


def _is_hot(key: str, ids: list) -> Column:
    return F.col(key).isNull() | (F.col(key).isin(ids) if ids else F.lit(False))


def write_buckets(spark: SparkSession, tables: dict[str, tuple[DataFrame, str]], buckets: int | None = None,
                  hot: float = HOT) -> ClientStore:
    """Store tables given as name: (rows, client column).  ``buckets`` defaults to the
    session's shuffle partitions; size it so that a bucket of the largest table fits
    a task.  A table of unique ids has no hot clients of its own as long as it has
    more rows than ``buckets / hot``; below that some are kept apart, to no harm."""
    n = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    run = uuid.uuid4().hex[:12]
    staged = {name: (cut_lineage(df, f"staged-{name}"), key) for name, (df, key) in tables.items()}
    ids = hot_clients(staged, n, hot)
    names = {}
    for name, (df, key) in staged.items():
        table, path = f"salescope_{name}_{run}", f"{checkpoint_dir(spark).rstrip('/')}/salescope-bucketed-{name}-{run}"
        (df.filter(~_is_hot(key, ids)).repartition(n, key).write.bucketBy(n, key).sortBy(key)
           .option("path", path).format("parquet").saveAsTable(table))
        files = spark.table(table)
        files._cut_path = path
        names[name] = (table, files, cut_lineage(df.filter(_is_hot(key, ids)), f"hot-{name}"))
    drop_cut(*[df for df, _ in staged.values()])
    return ClientStore(spark, names, ids)
