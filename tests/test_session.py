import os

from salescope.session import checkpoint_dir, cut_lineage


def test_checkpoint_dir_reads_the_session_setting(spark):
    d = checkpoint_dir(spark)
    assert d and spark.conf.get("spark.checkpoint.dir") == d
    assert checkpoint_dir(spark) == d            # stable, never re-created


def test_cut_lineage_writes_under_checkpoint_dir(spark):
    df = spark.range(1000).selectExpr("id", "id % 7 as k")
    out = cut_lineage(df.groupBy("k").count(), "t")
    files = out.inputFiles()
    base = checkpoint_dir(spark).replace("file:", "")
    assert files and all(base in f for f in files)
    assert sorted(r["count"] for r in out.collect()) == sorted([143] * 6 + [142])
    assert "FileScan parquet" in out._jdf.queryExecution().executedPlan().toString()
    assert os.path.isdir(files[0].replace("file:", "").rsplit("/", 1)[0])
