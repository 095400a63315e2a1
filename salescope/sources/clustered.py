"""A fact store that skips files for filters on date, client or product.

Clustering by one column narrows the range of that column in every file and
leaves all others spread over all files.  Here rows follow the Z-order curve of
three ranks: the bits of a row's date rank, client rank and product rank are
interleaved into one key (Morton code), and rows are range-partitioned by it.
Rows that are near in all three are near in the file layout, so the minimum and
maximum that Parquet keeps per file narrow every column, and Spark's own reader
skips row groups by pushed filters on any of them.

Ranks are places among range boundaries of the column (``approx_percentile`` of
its values, at most 2^bits - 1 of them), so they are even whatever the
distribution, and a hot client takes the place of several ranks.  Client ids are
ranked by their own order, as files compare them.  The least bits of a key come
from a hash of the row id, so a client that holds a third of all rows on one
day is still dealt over several files.

Beside min / max, the client column gets Parquet bloom filters, which rule out
row groups for one client even where its id lies inside the range (A6, C8, W4).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.numbering import ranked
from ..session import cut_lineage, drop_cut

#: bits of a rank: 2^BITS ranges of a column
BITS = 6


def boundaries(df: DataFrame, columns: list[str], bits: int = BITS) -> dict[str, list]:
    """Per column the upper ends of its 2^bits ranges, by one pass over the rows
    (texts: over their distinct values weighted by rows).  2^bits values each."""
    n = 1 << bits
    out = {}
    shares = [i / n for i in range(1, n)]
    numbers = [c for c in columns if dict(df.dtypes)[c] not in ("string",)]
    if numbers:
        row = df.agg(*[F.percentile_approx(_number(c, dict(df.dtypes)[c]), shares, 10_000).alias(c) for c in numbers]).first()
        out |= {c: sorted(set(row[c] or [])) for c in numbers}
    for c in [c for c in columns if c not in numbers]:
        out[c] = _text_boundaries(df, c, n)
    return out


def _number(column: str, kind: str) -> Column:
    return F.unix_date(column) if kind == "date" else F.col(column)


def _text_boundaries(df: DataFrame, column: str, n: int) -> list[str]:
    """Values that cut the sorted texts into ranges of about equal row counts: a
    running sum of row counts over sorted ranges of the distinct values, which are
    counted once."""
    counts = cut_lineage(df.filter(F.col(column).isNotNull()).groupBy(column).agg(F.count(F.lit(1)).alias("n")), "counts")
    total = counts.agg(F.sum("n")).first()[0] or 0
    if not total:
        drop_cut(counts)
        return []
    placed = ranked(counts, [column], "place")
    # rows up to a value: within blocks of values, then over the blocks
    block = F.floor(F.col("place") / 100_000)
    inside = Window.partitionBy("block").orderBy("place")
    rows = placed.withColumn("block", block).withColumn("upto", F.sum("n").over(inside))
    sums = rows.groupBy("block").agg(F.max("upto").alias("m"))
    before = Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)         # a row per 100,000 values
    offsets = sums.select("block", F.coalesce(F.sum("m").over(before), F.lit(0)).alias("offset"))
    share = F.floor((F.col("upto") + F.col("offset")) * n / F.lit(total))
    cut = rows.join(offsets, "block").groupBy(share.alias("share")).agg(F.min(column).alias("value"))
    found = sorted(r.value for r in cut.filter(F.col("share").between(1, n - 1)).collect())     # below n rows
    drop_cut(placed, counts)
    return found


def _with_ranks(df: DataFrame, columns: list[str], ends: dict[str, list], bits: int) -> DataFrame:
    """``df`` with ``_rank0``, ...: how many boundaries each column's value reaches (null:
    none), spread over all ``bits``, so that a column of few values counts as much as
    the others.  The sorted boundaries are halved ``bits`` times, a projection each,
    so a value is compared ``bits`` times, not with all of them."""
    kinds = dict(df.dtypes)
    ranks = [f"_rank{i}" for i in range(len(columns))]
    df = df.withColumns({r: F.lit(0) for r in ranks})
    for step in [1 << b for b in reversed(range(bits))]:
        halved = {}
        for c, r in zip(columns, ranks):
            if ends[c]:
                end = F.get(F.array(*[F.lit(e) for e in ends[c]]), F.col(r) + (step - 1))
                halved[r] = F.col(r) + F.when(end <= _number(c, kinds[c]), step).otherwise(0)
        df = df.withColumns(halved)
    return df.withColumns({r: F.get(F.array(*[F.lit((k << bits) // (len(ends[c]) + 1)) for k in range(len(ends[c]) + 1)]), F.col(r))
                           for c, r in zip(columns, ranks)})


def morton(ranks: list[Column], bits: int = BITS) -> Column:
    """Interleaved bits of the ranks, the first rank's bit the most significant of each
    round.  The spread bits of a rank are looked up."""
    key, k = F.lit(0).cast("long"), len(ranks)
    for i, r in enumerate(ranks):
        spread = [sum((v >> bit & 1) << (bit * k + (k - 1 - i)) for bit in range(bits)) for v in range(1 << bits)]
        mask = F.lit((1 << bits) - 1)
        key = key.bitwiseOR(F.get(F.array(*[F.lit(v).cast("long") for v in spread]), r.bitwiseAND(mask).cast("int")))
    return key


def with_z_key(df: DataFrame, columns: list[str], ends: dict[str, list], bits: int = BITS) -> DataFrame:
    """``df`` with ``_z``, its key on the curve."""
    ranks = [f"_rank{i}" for i in range(len(columns))]
    return (_with_ranks(df, columns, ends, bits)
            .withColumn("_z", morton([F.col(r) for r in ranks], bits)).drop(*ranks))


def write_clustered(df: DataFrame, path: str, columns: list[str] = ("date", "client_id", "product_type"),
                    files: int | None = None, tie: str = "id", bloom: str | None = "client_id",
                    distinct: int = 1_000_000, mode: str = "overwrite", options: dict | None = None) -> str:
    """Store ``df`` in Z-order of ``columns``.  ``bloom`` names the column with Parquet
    bloom filters, ``distinct`` its expected distinct values per row group (a
    column whose values fit a dictionary is skipped by that, without one).
    ``files`` of about 2^(3 x b) give every column 2^b ranges.  ``df`` is computed once:
    boundaries, the sample of the range shuffle and the shuffle read its rows as written."""
    n = files or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    df = cut_lineage(df, "unordered")
    ends = boundaries(df, list(columns))
    keyed = with_z_key(df, list(columns), ends).withColumn("_tie", F.xxhash64(tie) if tie in df.columns else F.lit(0))
    rows = keyed.repartitionByRange(n, "_z", "_tie").sortWithinPartitions("_z", *columns).drop("_z", "_tie")
    out = rows.write.mode(mode)
    if bloom and bloom in df.columns:
        out = (out.option(f"parquet.bloom.filter.enabled#{bloom}", "true")
               .option(f"parquet.bloom.filter.expected.ndv#{bloom}", str(distinct)))
    out.options(**(options or {})).parquet(path)
    drop_cut(df)
    return path


def read_clustered(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def file_ranges(stored: DataFrame, columns: list[str]) -> DataFrame:
    """``file, rows`` and the least and greatest value of each column per file: what a
    reader can skip by."""
    return stored.groupBy(F.input_file_name().alias("file")).agg(
        F.count(F.lit(1)).alias("rows"),
        *[f(c).alias(f"{n}_{c}") for c in columns for n, f in (("min", F.min), ("max", F.max))])
