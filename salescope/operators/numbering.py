"""Gapless numbers without gathering the rows in one task."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage, drop_cut

#: keys that one task numbers
NUMBERED_ROWS = 500_000


def _offsets(rows: DataFrame) -> DataFrame:
    """Rows in the parts before each part: a window over one row per part."""
    counts = rows.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    earlier = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    return counts.select("_part", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_offset"))


def dense_numbers(keys: DataFrame, column: str, after: int = 0, part_rows: int = NUMBERED_ROWS) -> DataFrame:
    """``column, number``: numbers ``after`` + 1, ... without gaps for the distinct
    non-null keys.  Keys are numbered inside parts of about ``part_rows``; a table
    with one row per part has the offsets."""
    distinct = cut_lineage(keys.select(column).filter(F.col(column).isNotNull()).distinct(), "numbered-keys")
    parts = max(1, math.ceil(distinct.count() / part_rows))
    dealt = distinct.withColumn("_part", F.pmod(F.xxhash64(column), F.lit(parts)))
    inside = F.row_number().over(Window.partitionBy("_part").orderBy(column))
    out = dealt.withColumn("_at", inside).join(_offsets(dealt), "_part")
    numbered = cut_lineage(out.select(column, (F.col("_at") + F.col("_offset") + F.lit(after)).cast("long").alias("number")),
                           "numbers")
    drop_cut(distinct)
    return numbered


def ranked(rows: DataFrame, order: list[str], column: str) -> DataFrame:
    """``rows`` with their place 1, 2, ... in the given order.  A range shuffle deals
    the rows out in order; they are numbered inside their range and shifted by the
    rows of the ranges before it.  The dealt rows are written once, so that a lost
    executor does not draw other ranges."""
    dealt = rows.repartitionByRange(*order).withColumn("_part", F.spark_partition_id())
    dealt = cut_lineage(dealt, "ranked")
    inside = F.row_number().over(Window.partitionBy("_part").orderBy(*order))
    out = dealt.withColumn("_at", inside).join(_offsets(dealt), "_part")
    return out.withColumn(column, (F.col("_at") + F.col("_offset")).cast("long")).drop("_part", "_at", "_offset")
