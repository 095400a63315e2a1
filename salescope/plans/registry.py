"""Named queries over the driver's tables, each paired with an independent
DuckDB SQL oracle.  Query callables take (spark, sf_dir) and return a
DataFrame in *canonical output form*: dates as ISO text, timestamps as ISO
text with microseconds, arrays joined with ', ', integers as BIGINT.  The
library operators themselves return typed columns; only this registry
flattens them so two engines can be compared value by value."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def canonical(df: DataFrame) -> DataFrame:
    cols = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        t = f.dataType
        if isinstance(t, T.DateType):
            c = F.date_format(c, "yyyy-MM-dd")
        elif isinstance(t, (T.TimestampType, T.TimestampNTZType)):
            c = F.date_format(c, "yyyy-MM-dd HH:mm:ss.SSSSSS")
        elif isinstance(t, T.ArrayType):
            c = F.array_join(c.cast("array<string>"), ", ")
        elif isinstance(t, (T.IntegerType, T.ShortType, T.ByteType)):
            c = c.cast("long")
        elif isinstance(t, (T.DecimalType, T.FloatType)):
            c = c.cast("double")
        cols.append(c.alias(f.name))
    return df.select(*cols)


def register(name: str, sql: str | None = None):
    def deco(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            # calendar semantics are defined in UTC (dates from timestamps,
            # bucket intervals); pin it for whatever session calls us
            if spark.conf.get("spark.sql.session.timeZone", "UTC") != "UTC":
                spark.conf.set("spark.sql.session.timeZone", "UTC")
            return canonical(fn(spark, sf_dir))
        run.__name__ = fn.__name__
        run.__doc__ = fn.__doc__
        QUERIES[name] = run
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return deco


def load_all():
    """Import the modules that register queries."""
    from . import (queries_core, queries_compare, queries_leads, queries_clients,  # noqa: F401
                   queries_quality, queries_ingest, queries_display, queries_more, queries_store)
    return QUERIES, ORACLE
