"""Imports as one unit: one read of the raw rows, observed counts, commit by the log row."""

import pytest
from pyspark.sql import functions as F

from salescope.operators import ingest as I
from salescope.session import cut_lineage, drop_cut
from salescope.sources import sinks as SK

RAW = "row_no long, client_name string, client_id string, product_type string, price string, date string"
AS_OF = "2024-05-15"


@pytest.fixture(scope="module")
def raw(spark):
    return spark.createDataFrame([
        (2, " Ana ", "C1", "P", "10.5", "01/02/2024"), (3, "Ana", "C1", "P", "x", None), (4, "Bo", "C2", "P", "3", ""),
        (5, "Bo B", "C2", "Q", "4", "2024-02-30"), (6, None, "C3", "Q", "4", None), (7, "Cy", "C3", "Q", "0.0", None),
        (8, "Di", "C4", "Q", "1", None)], RAW)


def _stores(spark, root):
    read = lambda t, s: sorted(map(tuple, SK.committed(spark, root, t, s).collect()), key=str)
    return (read("sales", SK.SALES_STORE), read("clients", SK.CLIENTS_STORE),
            sorted(tuple(r)[1:5] for r in SK.committed(spark, root, "log", SK.LOG_STORE).collect()))


def test_import_and_rerun(spark, raw, tmp_path):
    root = str(tmp_path)
    known = spark.createDataFrame([("C4",)], "id string")
    assert SK.run_sales_import(raw, root, "one", AS_OF, "a.csv", known) == {"total": 7, "valid": 3, "rejected": 4}
    first = _stores(spark, root)
    assert [(r[0], r[-1]) for r in first[0]] == [("a.csv#2", "one"), ("a.csv#4", "one"), ("a.csv#8", "one")]
    assert [r[:3] for r in first[1]] == [("C1", "Ana", "-"), ("C2", "Bo", "-")]
    assert first[2] == [("a.csv", 7, 3, 4)]
    SK.run_sales_import(raw, root, "one", AS_OF, "a.csv", known)
    assert _stores(spark, root) == first
    # the same file under another id: its rows are stored already, it adds nothing
    SK.run_sales_import(raw, root, "two", AS_OF, "a.csv", known)
    sales, clients, log = _stores(spark, root)
    assert (sales, clients) == first[:2] and log == [("a.csv", 7, 3, 4)] * 2
    rejects = SK.committed(spark, root, "rejects", "row_no long, error string, price string").filter("import_id = 'one'")
    assert sorted((r.row_no, r.price) for r in rejects.collect()) == [(3, "x"), (5, "4"), (6, "4"), (7, "0.0")]


def test_broken_import_is_not_seen_and_can_be_repeated(spark, raw, tmp_path, monkeypatch):
    root = str(tmp_path)
    write = SK.write_table

    def fails_at(table):
        def broken(df, path, **kw):
            if f"/{table}/" in path:
                raise OSError("lost")
            return write(df, path, **kw)
        return broken

    for table in ("sales", "rejects", "log"):
        monkeypatch.setattr(SK, "write_table", fails_at(table))
        with pytest.raises(OSError):
            SK.run_sales_import(raw, root, "one", AS_OF, "a.csv")
        assert _stores(spark, root) == ([], [], [])
    monkeypatch.setattr(SK, "write_table", write)
    SK.run_sales_import(raw, root, "one", AS_OF, "a.csv")
    sales, clients, log = _stores(spark, root)
    assert len(sales) == 3 and len(clients) == 3 and log == [("a.csv", 7, 3, 4)]


def test_raw_rows_are_read_once(spark, raw, tmp_path):
    reads = spark.sparkContext.accumulator(0)

    def counted(batches):
        for b in batches:
            reads.add(b.num_rows)
            yield b
    SK.run_sales_import(raw.coalesce(1).mapInArrow(counted, raw.schema), str(tmp_path), "one", AS_OF)
    assert reads.value == 7
    reads.value = 0
    mixed = raw.withColumns({"source": F.lit("meta"), "created_at": F.lit("2024-01-01"), "status": F.lit("new")}).coalesce(1)
    none = spark.createDataFrame([], "id string, external_id string, source string")
    r = I.import_mixed(mixed.mapInArrow(counted, mixed.schema), none, spark.createDataFrame([], "id string"), AS_OF, "null")
    assert r["counts"].first() and r["errors"].count() == 4 and r["leads"].valid.count() > 0
    assert reads.value == 7
    assert r["observed"] == {"total": 7, "sales_error": 4, "leads_error": 0, "both": 3, "sales": 0, "leads": 4, "neither": 0}
    drop_cut(r["staged"])


def test_report_has_counts_only_without_errors(spark, raw):
    good = raw.filter("row_no in (2, 8)").withColumns({"source": F.lit("meta"), "status": F.lit("new")})
    none = spark.createDataFrame([], "id string, external_id string, source string")
    clients = spark.createDataFrame([], "id string")
    assert I.import_mixed(good, none, clients, AS_OF, "null")["report"].columns == ["total", "leads", "sales", "invalid"]
    bad = good.withColumn("price", F.when(F.col("row_no") == 2, "-1").otherwise(F.col("price")))
    assert [tuple(r)[:2] for r in I.import_mixed(bad, none, clients, AS_OF, "null")["report"].collect()] == [("sales", 2)]


def test_empty_import(spark, raw, tmp_path):
    assert SK.run_sales_import(raw.limit(0), str(tmp_path), "none", AS_OF) == {"total": 0, "valid": 0, "rejected": 0}
    assert _stores(spark, str(tmp_path))[2] == [("import", 0, 0, 0)]


def test_checks_agree_with_split_rules(spark, raw):
    rows = cut_lineage(I.check_sales(raw, AS_OF), "checked")
    valid, rejected = I.validate_sales(raw, AS_OF)
    assert sorted(rows.filter("sale is not null").select("row_no", "sale.*").collect()) == sorted(valid.collect())
    got = rows.filter("sales_error is not null").select("row_no", F.col("sales_error").alias("error"), "raw.*").collect()
    assert sorted(map(str, got)) == sorted(map(str, rejected.collect()))
    drop_cut(rows)
