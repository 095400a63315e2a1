import os
import sys

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
import __spark_entry__ as E  # noqa: E402

# Queries whose semantics have no SQL oracle (none at the moment).
NO_ORACLE: set[str] = set()


def library_queries():
    """The library's own queries; those of the optional subpackage have their own tests."""
    from salescope.plans.registry import load_all
    names = set(load_all()[0])
    return {k: v for k, v in E.queries().items() if k in names}


def test_entry_smoke(spark):
    df = E.entry(spark)
    assert df.count() > 0
    assert df.columns == ["product_type", "quantity", "total_sales", "avg_price", "min_price", "max_price"]


def test_every_query_has_oracle():
    q, o = library_queries(), E.oracle_sql()
    assert len(q) >= 75
    assert set(q) - set(o) == NO_ORACLE


def _duck(sf_dir):
    con = duckdb.connect()
    for t in ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events"]:
        con.execute(f"create view {t} as select * from read_parquet('{sf_dir}/{t}.parquet')")
    return con


def test_all_queries_match_oracle_sf0001(spark):
    sf = "/root/testdata/sf0.001"
    con = _duck(sf)
    q, o = library_queries(), E.oracle_sql()
    for name in sorted(q):                      # every registered query
        df = q[name](spark, sf)
        s = sorted(tuple(str(v) for v in r) for r in df.collect())
        rel = con.sql(o[name])
        idx = [rel.columns.index(c) for c in df.columns]
        dk = sorted(tuple(str(r[i]) for i in idx) for r in rel.fetchall())
        assert s == dk, name
