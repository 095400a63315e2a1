"""Property tests: calendar keys, labels and intervals against Python's own
calendar arithmetic (ISO weeks via ``isocalendar``) over many random dates,
evaluated in one Spark job."""

import datetime as dt

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from salescope.functions import buckets as B

MONTHS = ["Jan", "Feb", "Mar", "Apr", "May", "Jun", "Jul", "Aug", "Sep", "Oct", "Nov", "Dec"]


def py_key_label(d: dt.date, g: str):
    if g == "day":
        return d.strftime("%Y-%m-%d"), d.strftime("%d/%m")
    if g == "week":
        y, w, _ = d.isocalendar()
        return f"{y}-W{w:02d}", f"Sem {w}"
    if g == "month":
        return d.strftime("%Y-%m"), f"{MONTHS[d.month - 1]} {d.strftime('%y')}"
    if g == "quarter":
        q = (d.month - 1) // 3 + 1
        return f"{d.year}-Q{q}", f"Q{q} {str(d.year)[-2:]}"
    return d.strftime("%Y"), d.strftime("%Y")


def py_start(d: dt.date, g: str) -> dt.date:
    if g == "day":
        return d
    if g == "week":
        return d - dt.timedelta(days=d.weekday())
    if g == "month":
        return d.replace(day=1)
    if g == "quarter":
        return d.replace(month=(d.month - 1) // 3 * 3 + 1, day=1)
    return d.replace(month=1, day=1)


@settings(max_examples=5, deadline=None)
@given(st.lists(st.dates(min_value=dt.date(1990, 1, 1), max_value=dt.date(2040, 12, 31)),
                min_size=50, max_size=300))
def test_bucket_functions_match_python_calendar(spark, dates):
    df = spark.createDataFrame([(d,) for d in dates], "d date")
    cols = []
    for g in B.GROUPINGS:
        cols += [B.bucket_key("d", g).alias(f"k_{g}"), B.bucket_label("d", g).alias(f"l_{g}"),
                 B.bucket_start("d", g).alias(f"s_{g}"),
                 B.valid_bucket_key(B.bucket_key("d", g), g).alias(f"v_{g}")]
    for r in df.select("d", *cols).collect():
        for g in B.GROUPINGS:
            k, lab = py_key_label(r.d, g)
            assert (r[f"k_{g}"], r[f"l_{g}"]) == (k, lab), (r.d, g)
            assert r[f"s_{g}"] == py_start(r.d, g), (r.d, g)
            assert r[f"v_{g}"] is True


@settings(max_examples=5, deadline=None)
@given(st.lists(st.tuples(st.dates(min_value=dt.date(2000, 1, 1), max_value=dt.date(2030, 12, 31)),
                          st.integers(min_value=1, max_value=10_000)), min_size=20, max_size=200),
       st.sampled_from(list(B.GROUPINGS)))
def test_bucket_totals_partition_the_total(spark, rows, g):
    """Σ bucket totals = grand total, and every date falls inside its bucket."""
    from decimal import Decimal
    from salescope.operators.evolution import sales_evolution
    df = spark.createDataFrame([(str(i), "n", "c", "p", Decimal(v), d) for i, (d, v) in enumerate(rows)],
                               "id string, client_name string, client_id string, product_type string, "
                               "price decimal(18,2), date date")
    ev = sales_evolution(df, None, g).collect()
    assert sum(r.total for r in ev) == float(sum(v for _, v in rows))
    assert [r.key for r in ev] == sorted({py_key_label(d, g)[0] for d, _ in rows})
    lo, hi = B.bucket_range(F.col("date"), g)
    bad = df.filter((F.col("date") < lo) | (F.col("date") > hi)).count()
    assert bad == 0
