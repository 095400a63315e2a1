"""Substring search over a written table with a trigram posting index.

``build_trigrams`` writes the rows, range-clustered by the searched text, one file
per part, and for every run of three characters of the lower-cased text the rows
that have it: a bitmap per trigram and bucket of 32,768 row numbers, so a trigram
that all rows share costs a bit a row and no list is ever gathered.

``search`` intersects the bitmaps of a term's trigrams, reads only the parts in
which a row is left (dynamic partition pruning) and verifies these rows with the
plain substring test, so it returns what a scan returns.  Terms of fewer than three
characters have no trigram; they take the scan.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

WIDTH = 3
_ROW, _PART, _TEXT = "_row_no", "_part", "_searched"


def _grams(text: Column) -> Column:
    """Distinct runs of WIDTH characters (none for null or shorter texts)."""
    return F.when(F.length(text) >= WIDTH, F.array_distinct(F.transform(
        F.sequence(F.lit(1), F.length(text) - (WIDTH - 1)), lambda k: F.substring(text, k, F.lit(WIDTH)))))


def build_trigrams(rows: DataFrame, text: Column, path: str, parts: int | None = None) -> "TrigramStore":
    """Write ``rows`` and the index of ``text`` under ``path`` (replacing what is
    there).  ``parts``: files of the row table, by default the shuffle partitions;
    rows of one common text are spread over several by a digest of the row."""
    spark = rows.sparkSession
    named = rows.withColumn(_TEXT, F.lower(text))
    order = [F.col(_TEXT), F.xxhash64(*[F.col(f"`{c}`").cast("string") for c in rows.columns])]
    dealt = named.repartitionByRange(parts, *order) if parts else named.repartitionByRange(*order)
    # a part is a task's rows: its row numbers, hence its buckets, are its own
    numbered = dealt.withColumn(_ROW, F.monotonically_increasing_id() + 1).withColumn(
        _PART, F.shiftright(F.col(_ROW) - 1, 33).cast("int"))
    numbered.write.mode("overwrite").partitionBy(_PART).parquet(f"{path}/rows")
    numbered.limit(0).write.mode("overwrite").parquet(f"{path}/schema")       # an empty table has no part to read it from
    store = TrigramStore(spark, path)
    store._rows().select(_PART, _ROW, F.explode(_grams(F.col(_TEXT))).alias("gram")).groupBy(
        "gram", _PART, F.bitmap_bucket_number(_ROW).alias("bucket")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position(_ROW)).alias("bits")).repartitionByRange(
        "gram", _PART, "bucket").sortWithinPartitions("gram", _PART, "bucket").write.mode("overwrite").parquet(f"{path}/grams")
    return store


@dataclass(frozen=True)
class TrigramStore:
    """A written table and its posting index."""

    spark: SparkSession
    path: str

    def _rows(self) -> DataFrame:
        schema = self.spark.read.parquet(f"{self.path}/schema").schema
        return self.spark.read.schema(schema).parquet(f"{self.path}/rows")

    def rows(self) -> DataFrame:
        """All rows as they were given."""
        return self._rows().drop(_ROW, _PART, _TEXT)

    def candidates(self, term: str) -> DataFrame:
        """``part, bucket, bits``: the rows that have all trigrams of a term of at
        least WIDTH characters."""
        grams = sorted({term[k:k + WIDTH] for k in range(len(term) - WIDTH + 1)})
        found = self.spark.read.parquet(f"{self.path}/grams").filter(F.col("gram").isin(grams))
        return found.groupBy(F.col(_PART).alias("part"), "bucket").agg(
            F.count(F.lit(1)).alias("n"), F.bitmap_and_agg("bits").alias("bits")).filter(
            (F.col("n") == len(grams)) & (F.bitmap_count("bits") > 0)).select("part", "bucket", "bits")

    def search(self, term: str | None) -> DataFrame:
        """The rows whose text contains ``term`` in any case; blank: all rows.  Rows
        without a text are found by a blank term only."""
        t = (term or "").strip().lower()
        if not t:
            return self.rows()
        holds = F.col(_TEXT).contains(F.lit(t))
        if len(t) < WIDTH:
            return self._rows().filter(holds).drop(_ROW, _PART, _TEXT)
        found, rows = self.candidates(t), self._rows()
        at = F.bitmap_bit_position(_ROW)
        byte = F.conv(F.hex(F.substring("bits", (F.floor(at / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
        hit = F.getbit(byte, F.pmod(at, F.lit(8)).cast("int")) == 1
        both = rows.join(found, (rows[_PART] == found["part"]) & (F.bitmap_bucket_number(_ROW) == found["bucket"]))
        return both.filter(hit & holds).drop(_ROW, _PART, _TEXT, "part", "bucket", "bits")
