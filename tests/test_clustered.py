"""The Z-ordered store: what files can be skipped, and the same rows as before."""

import glob

import pyarrow.parquet as pq
import pytest
from conftest import SF0001
from pyspark.sql import functions as F

from salescope.operators import clients as CL
from salescope.sources import clustered as Z
from salescope.sources import sinks as SK
from salescope.sources import tables as TB

SF = SF0001.replace("0.001", "0.01")
FILES = 512       # three bits of each of three columns


@pytest.fixture(scope="module")
def sales(spark):
    return TB.sales(spark, SF)


@pytest.fixture(scope="module")
def store(spark, sales, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("z") / "store")
    Z.write_clustered(sales, path, files=FILES)
    return path


def _touched(path, column, value):
    """Files whose footer statistics do not rule the value out."""
    files = glob.glob(f"{path}/*.parquet")
    found = 0
    for f in files:
        meta = pq.ParquetFile(f).metadata
        at = meta.schema.to_arrow_schema().get_field_index(column)
        stats = [meta.row_group(g).column(at).statistics for g in range(meta.num_row_groups)]
        found += any(s is None or s.min is None or s.min <= value <= s.max for s in stats)
    return found, len(files)


def test_rows_are_the_same(spark, sales, store):
    stored = Z.read_clustered(spark, store)
    assert stored.columns == sales.columns
    assert stored.exceptAll(sales).count() == 0 and stored.count() == sales.count()


def test_files_are_skipped_for_every_column(spark, sales, store, tmp_path):
    by_date = str(tmp_path / "by_date")
    SK.write_store(sales, by_date, files=FILES)
    row = sales.filter("client_id = '700'").first()
    for column in ("date", "client_id", "product_type"):
        touched, files = _touched(store, column, row[column])
        assert files >= FILES * 0.9 and touched <= files * 0.4, (column, touched, files)
    touched, files = _touched(by_date, "client_id", row.client_id)
    assert touched > files * 0.8


def test_a_hot_client_is_dealt_over_files(spark, tmp_path):
    s = spark.range(30_000).select(
        F.col("id").cast("string").alias("id"), F.lit("n").alias("client_name"),
        F.when(F.col("id") % 3 > 0, "hot").otherwise(F.concat(F.lit("c"), F.col("id").cast("string"))).alias("client_id"),
        F.lit("p").alias("product_type"), F.lit(1).cast("decimal(18,2)").alias("price"), F.lit("2024-01-01").cast("date").alias("date"))
    Z.write_clustered(s, str(tmp_path), files=16)
    rows = [r.n for r in Z.read_clustered(spark, str(tmp_path)).groupBy(F.input_file_name()).agg(F.count(F.lit(1)).alias("n")).collect()]
    assert sum(rows) == 30_000 and max(rows) < 30_000 / 16 * 2


def _scanned(df):
    df.collect()
    leaf = df._jdf.queryExecution().executedPlan().collectLeaves().head()
    return leaf.metrics().apply("numOutputRows").value()


def test_bloom_filters_rule_out_row_groups(spark, sales, tmp_path):
    # more distinct ids than a dictionary takes
    small = {"parquet.dictionary.page.size": "256"}
    plain, store = str(tmp_path / "plain"), str(tmp_path / "bloom")
    Z.write_clustered(sales, plain, files=4, bloom=None, options=small)
    Z.write_clustered(sales, store, files=4, distinct=2000, options=small)
    absent = "700x"                     # between other ids, so no range rules it out
    pick = lambda path, c: Z.read_clustered(spark, path).filter(F.col("client_id") == c)
    assert _scanned(pick(plain, absent)) > 0 and _scanned(pick(store, absent)) == 0
    some = sales.first().client_id
    assert _scanned(pick(store, some)) <= _scanned(pick(plain, some))
    assert sorted(pick(store, some).collect()) == sorted(sales.filter(F.col("client_id") == some).collect())
    last = CL.last_sales_per_client(pick(store, some), 10)
    assert sorted(map(str, last.collect())) == sorted(map(str, CL.last_sales_per_client(sales.filter(F.col("client_id") == some), 10).collect()))


def test_morton_bits(spark):
    one = spark.createDataFrame([(5, 3, 0)], "a long, b long, c long")
    # 101, 011, 000 -> (a b c) from the top: 100 010 110
    assert one.select(Z.morton([F.col(c) for c in "abc"], 3).alias("z")).first().z == 0b100010110


def test_empty_and_null_values(spark, sales, tmp_path):
    Z.write_clustered(sales.limit(0), str(tmp_path / "a"), files=2)
    assert Z.read_clustered(spark, str(tmp_path / "a")).count() == 0
    odd = sales.limit(50).withColumns({"client_id": F.lit(None).cast("string"), "date": F.lit(None).cast("date")})
    Z.write_clustered(odd, str(tmp_path / "b"), files=2)
    assert Z.read_clustered(spark, str(tmp_path / "b")).exceptAll(odd).count() == 0


def test_rows_are_computed_once(spark, tmp_path):
    made = spark.sparkContext.accumulator(0)

    def rows(batches):
        for batch in batches:
            made.add(batch.num_rows)
            yield batch

    s = spark.range(500).select(
        F.col("id").cast("string").alias("id"), (F.col("id") % 7).cast("string").alias("client_id"),
        (F.col("id") % 3).cast("string").alias("product_type"), F.lit("2024-01-01").cast("date").alias("date"))
    Z.write_clustered(s.mapInArrow(rows, s.schema), str(tmp_path), files=4)
    assert Z.read_clustered(spark, str(tmp_path)).count() == 500 and made.value == 500


def test_ranks_count_the_boundaries_reached(spark):
    ends = {"a": ["b", "d", "f"], "n": [10, 20], "e": []}
    df = spark.createDataFrame([("a", 9, 1), ("b", 10, 1), ("e", 19, 1), ("z", 20, 1), (None, None, None)], "a string, n int, e int")
    rows = Z._with_ranks(df, ["a", "n", "e"], ends, 2).select("_rank0", "_rank1", "_rank2").collect()
    assert [tuple(r) for r in rows] == [(0, 0, 0), (1, 1, 0), (2, 1, 0), (3, 2, 0), (0, 0, 0)]
