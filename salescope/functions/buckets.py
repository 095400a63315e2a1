"""Calendar buckets.

Aggregations group on the bucket *start date* (one cheap date per row); the
text key, label and interval end are derived from that start after the
aggregation, on the small result.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

GROUPINGS = ("day", "week", "month", "quarter", "year")


def normalize_grouping(g: str | None, fallback: str = "day") -> str:
    """Plan-time: lower-case; an unknown grouping falls back to ``fallback``."""
    g = (g or "").strip().lower()
    return g if g in GROUPINGS else fallback


def check_grouping(g: str) -> str:
    if g not in GROUPINGS:
        raise ValueError(f"unsupported grouping: {g!r}")
    return g


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def bucket_start(d, grouping: str) -> Column:
    """First day of the bucket containing date ``d`` (ISO weeks start Monday)."""
    d = _col(d)
    g = check_grouping(grouping)
    if g == "day":
        return d
    if g == "week":
        return F.date_trunc("week", d).cast("date")
    if g == "month":
        return F.trunc(d, "month")
    if g == "quarter":
        return F.trunc(d, "quarter")
    return F.trunc(d, "year")


def bucket_next_start(start, grouping: str) -> Column:
    s = _col(start)
    g = check_grouping(grouping)
    if g == "day":
        return F.date_add(s, 1)
    if g == "week":
        return F.date_add(s, 7)
    return F.add_months(s, {"month": 1, "quarter": 3, "year": 12}[g])


def bucket_key(d, grouping: str) -> Column:
    """Day yyyy-MM-dd, ISO week YYYY-Www (ISO year), yyyy-MM, yyyy-Qn, yyyy."""
    d = _col(d)
    g = check_grouping(grouping)
    if g == "day":
        return F.date_format(d, "yyyy-MM-dd")
    if g == "week":
        return F.format_string("%04d-W%02d", F.extract(F.lit("YEAROFWEEK"), d), F.weekofyear(d))
    if g == "month":
        return F.date_format(d, "yyyy-MM")
    if g == "quarter":
        return F.concat(F.year(d).cast("string"), F.lit("-Q"), F.quarter(d).cast("string"))
    return F.date_format(d, "yyyy")


def bucket_label(d, grouping: str) -> Column:
    """Day dd/MM, week 'Sem n', month 'Mon yy', quarter 'Qn yy', year yyyy."""
    d = _col(d)
    g = check_grouping(grouping)
    if g == "day":
        return F.date_format(d, "dd/MM")
    if g == "week":
        return F.concat(F.lit("Sem "), F.weekofyear(d).cast("string"))
    if g == "month":
        return F.date_format(d, "MMM yy")
    if g == "quarter":
        return F.concat(F.lit("Q"), F.quarter(d).cast("string"), F.lit(" "),
                        F.substring(F.year(d).cast("string"), -2, 2))
    return F.date_format(d, "yyyy")


def bucket_interval(start, grouping: str) -> tuple[Column, Column]:
    """(start timestamp, end timestamp) with end = next start - 1 µs."""
    s = _col(start)
    start_ts = s.cast("timestamp")
    end_ts = (bucket_next_start(s, grouping).cast("timestamp")
              - F.expr("INTERVAL 1 MICROSECOND"))
    return start_ts, end_ts


def bucket_range(d, grouping: str) -> tuple[Column, Column]:
    """First and last calendar date of the bucket containing ``d``."""
    s = bucket_start(d, grouping)
    return s, F.date_sub(bucket_next_start(s, grouping), 1)


def is_partial(start_ts, end_ts, f_start=None, f_end=None) -> Column:
    """Bucket cut by the filter bounds.  ``f_end`` is midnight of the end
    date, so a bucket reaching past that midnight counts as partial."""
    if f_start is None and f_end is None:
        return F.lit(False)
    cond = F.lit(False)
    if f_start is not None:
        cond = cond | (_col(start_ts) < F.lit(str(f_start)).cast("timestamp"))
    if f_end is not None:
        cond = cond | (_col(end_ts) > F.lit(str(f_end)).cast("timestamp"))
    return cond


# Bucket key shapes.
KEY_PATTERNS = {
    "day": r"^\d{4}-\d{2}-\d{2}$",
    "week": r"^\d{4}-W\d{2}$",
    "month": r"^\d{4}-\d{2}$",
    "quarter": r"^\d{4}-Q[1-4]$",
    "year": r"^\d{4}$",
}


def valid_bucket_key(key, grouping: str) -> Column:
    """Key shape plus calendar checks (real date, month 1-12, ISO week
    1..53 and present in that ISO year, quarter 1-4)."""
    k = _col(key)
    g = check_grouping(grouping)
    shape = k.rlike(KEY_PATTERNS[g])
    if g == "day":
        ok = F.try_to_date(k, "yyyy-MM-dd").isNotNull()
    elif g == "month":
        ok = F.try_to_date(F.concat(k, F.lit("-01")), "yyyy-MM-dd").isNotNull()
    elif g == "week":
        y = F.substring(k, 1, 4).try_cast("int")
        w = F.substring(k, 7, 2).try_cast("int")
        # Dec 28 always lies in the last ISO week of its year.
        last_week = F.weekofyear(F.make_date(y, F.lit(12), F.lit(28)))
        ok = (w >= 1) & (w <= last_week)
    else:
        ok = F.lit(True)
    return F.when(shape, ok).otherwise(F.lit(False))
