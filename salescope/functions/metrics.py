"""Guarded ratios and state columns (S16, S17, S26, S28).  ANSI mode is on,
so no division is ever evaluated with a zero denominator."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def safe_ratio(n, d) -> Column:
    """N / d, 0.0 when d <= 0 (or NULL)."""
    n, d = _col(n), _col(d)
    return F.when(d > 0, n.cast("double") / d.cast("double")).otherwise(F.lit(0.0))


def safe_pct(n, d) -> Column:
    """n / d * 100, 0.0 when d <= 0."""
    n, d = _col(n), _col(d)
    return F.when(d > 0, n.cast("double") / d.cast("double") * 100.0).otherwise(F.lit(0.0))


def safe_pct_change(a, b) -> Column:
    """(b - a) / a * 100; a == 0 -> 100 when b != 0 else 0."""
    a, b = _col(a).cast("double"), _col(b).cast("double")
    diff = b - a
    return (F.when(a != 0, diff / a * 100.0)
             .when(diff != 0, F.lit(100.0)).otherwise(F.lit(0.0)))


def compare_card_state(a, b, partial=None) -> Column:
    """Partial flag wins, then new / inactive / none / normal."""
    a, b = _col(a), _col(b)
    st = (F.when((a == 0) & (b > 0), "new").when((a > 0) & (b == 0), "inactive")
           .when((a == 0) & (b == 0), "none").otherwise("normal"))
    if partial is not None:
        st = F.when(_col(partial), F.lit("partial")).otherwise(st)
    return st


def delta_arrow(a, b) -> Column:
    a, b = _col(a), _col(b)
    return F.when(b > a, "↑").when(b < a, "↓").otherwise("—")


def funnel_insight(meetings, converted) -> Column:
    """Funnel state: no meetings / meetings but no client yet / normal."""
    m, c = _col(meetings), _col(converted)
    return (F.when(m == 0, "no_meetings").when(c == 0, "meetings_no_conversion")
             .otherwise("normal"))


def funnel_insight_text(meetings, converted, converted_from_meeting) -> Column:
    """S28 sub-line: 'x of n meetings converted · total clients: c'."""
    m, c, cfm = _col(meetings), _col(converted), _col(converted_from_meeting)
    return (F.when(m == 0, F.lit(""))
             .otherwise(F.format_string("%d of %d meetings converted · total clients: %d",
                                        F.when(c == 0, F.lit(0)).otherwise(cfm), m, c)))
