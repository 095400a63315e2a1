"""Date parsing and calendar arithmetic as Spark column expressions."""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import Column
from pyspark.sql import functions as F

from .strip import strip

# Accepted input layouts for imported dates, tried in this order
# (strptime spelling: %Y-%m-%d, %d/%m/%Y, %Y/%m/%d, %d-%m-%Y, %d/%m/%y,
# %Y-%m-%d %H:%M:%S, %d/%m/%Y %H:%M:%S).  Single-letter day/month/hour fields
# accept one or two digits like strptime does.
IMPORT_DATE_FORMATS = [
    "yyyy-M-d",
    "d/M/yyyy",
    "yyyy/M/d",
    "d-M-yyyy",
    "d/M/yy",
    "yyyy-M-d H:m:s",
    "d/M/yyyy H:m:s",
]
# Excel serial day numbers count from this date.
EXCEL_EPOCH = "1899-12-30"
# Fixed value: rejection message prefix for an unparsable date (then the raw value).
MSG_UNKNOWN_DATE = "Fecha con formato desconocido: "


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _lit_date(d) -> Column:
    if isinstance(d, Column):
        return d
    if isinstance(d, (_dt.date, _dt.datetime)):
        d = d.isoformat()[:10]
    return F.lit(d).cast("date")


# Shape of each layout (digit counts as strptime accepts them).  A cheap regex
# guard means the date parser only runs on text that can match, instead of
# failing (and throwing internally) once per layout per row.
_SHAPES = {
    "yyyy-M-d": r"^\d{4}-\d{1,2}-\d{1,2}$",
    "d/M/yyyy": r"^\d{1,2}/\d{1,2}/\d{4}$",
    "yyyy/M/d": r"^\d{4}/\d{1,2}/\d{1,2}$",
    "d-M-yyyy": r"^\d{1,2}-\d{1,2}-\d{4}$",
    "d/M/yy": r"^\d{1,2}/\d{1,2}/\d{2}$",
    "yyyy-M-d H:m:s": r"^\d{4}-\d{1,2}-\d{1,2} \d{1,2}:\d{1,2}:\d{1,2}$",
    "d/M/yyyy H:m:s": r"^\d{1,2}/\d{1,2}/\d{4} \d{1,2}:\d{1,2}:\d{1,2}$",
}


def _try_date(s: Column, fmt: str) -> Column:
    d = F.when(s.rlike(_SHAPES[fmt]), F.try_to_date(s, fmt))
    if fmt.endswith("/yy"):
        # strptime's %y pivots at 69 (69..99 -> 19xx); Spark's yy maps to 2000..2099.
        d = F.when(F.year(d) >= 2069, F.add_months(d, -1200)).otherwise(d)
    return d


def parse_import_date(c, numeric: bool = False) -> Column:
    """S1 without the default: a DATE, or NULL when no layout matches.

    ``numeric=True`` marks a numeric-typed source column (spreadsheet input):
    values are then Excel serial day numbers.
    """
    c = _col(c)
    if numeric:
        # day 0 .. the last day of year 9999; anything else is no date
        number = c.try_cast("double")
        days = F.when(~F.isnan(number), F.floor(number)).try_cast("int")
        return F.when(days.between(-693_593, 2_958_465), F.date_add(F.lit(EXCEL_EPOCH).cast("date"), days))
    return parse_trimmed_date(strip(c.cast("string")))


def parse_trimmed_date(s) -> Column:
    """``parse_import_date`` of a text without white space at its ends."""
    s = _col(s)
    return F.coalesce(*[_try_date(s, f) for f in IMPORT_DATE_FORMATS])


def is_blank(c, trimmed=None) -> Column:
    c = _col(c)
    return c.isNull() | ((strip(c.cast("string")) if trimmed is None else _col(trimmed)) == "")


def parse_date_or_default(c, default, numeric: bool = False, parsed=None, trimmed=None) -> tuple[Column, Column]:
    """(date, error) — blank -> ``default``; unparsable -> NULL date and an
    error message.  ``parsed`` may name a column that already holds
    ``parse_import_date(c)`` so the layouts are tried once per row, ``trimmed``
    one with its trimmed text."""
    c = _col(c)
    parsed = parse_import_date(c, numeric) if parsed is None else _col(parsed)
    blank = is_blank(c, trimmed)
    value = F.when(blank, _lit_date(default)).otherwise(parsed)
    err = F.when(~blank & parsed.isNull(),
                 F.concat(F.lit(MSG_UNKNOWN_DATE), c.cast("string")))
    return value, err


# Layouts accepted when normalising a filter date (after the
# 10-character yyyy-mm-dd shape, which passes through unchecked).
ISO_FALLBACK_FORMATS = ["d/M/yyyy", "d-M-yyyy", "yyyy/M/d", "yyyy.M.d"]


def normalize_iso(c) -> Column:
    """ISO text for a user-typed date, or NULL.  A 10-character
    ``dddd-dd-dd`` value passes through unvalidated, as in the reference."""
    c = _col(c)
    s = strip(c.cast("string"))
    shape = s.rlike(r"^\d{4}-\d{2}-\d{2}$")
    parsed = F.coalesce(*[F.try_to_date(s, f) for f in ISO_FALLBACK_FORMATS])
    return (F.when(is_blank(c), F.lit(None).cast("string"))
             .when(shape, s)
             .otherwise(F.date_format(parsed, "yyyy-MM-dd")))


def shift_years(d, n: int) -> Column:
    """Calendar-aware year shift (Feb 29 -> Feb 28)."""
    return F.add_months(_col(d), 12 * n)


def lead_age_days(created_at, as_of) -> Column:
    """Days between creation and ``as_of``."""
    return F.datediff(_lit_date(as_of), _col(created_at))


def urgency_band(age_days) -> Column:
    """>30 days old, 7..30 days, recent."""
    a = _col(age_days)
    return F.when(a > 30, "old").when(a >= 7, "aging").otherwise("recent")


# Meeting badge texts for today / tomorrow.
BADGE_TODAY = "HOY"
BADGE_TOMORROW = "MAÑANA"


def meeting_badge(meeting_date, as_of) -> Column:
    """Today / tomorrow badge, else the ISO date."""
    m = _col(meeting_date)
    t = _lit_date(as_of)
    return (F.when(m == t, F.lit(BADGE_TODAY)).when(m == F.date_add(t, 1), F.lit(BADGE_TOMORROW))
             .otherwise(F.date_format(m, "yyyy-MM-dd")))


def to_day_iso(c) -> Column:
    return F.date_format(_col(c), "yyyy-MM-dd")
