"""Filters (F1, F3-F8).  Plan-time filter values become Column predicates;
Catalyst pushes them into the Parquet scan (PushedFilters) and, when tables are
stored partitioned by date, prunes partitions."""

from __future__ import annotations

import datetime as _dt
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import SOURCE_LABELS_TABLE



def _labels_map():
    return F.create_map(*[F.lit(x) for kv in SOURCE_LABELS_TABLE.items() for x in kv])

# UI sentinels meaning "no filter".
ALL_SENTINELS = ("TODOS", "Todos", "Todas", "todos", "todas")


def _clean(v):
    if v is None:
        return None
    if isinstance(v, str):
        v = v.strip()
        if v == "" or v in ALL_SENTINELS:
            return None
    return v


def _iso(v):
    v = _clean(v)
    if v is None:
        return None
    if isinstance(v, (_dt.date, _dt.datetime)):
        return v.isoformat()[:10]
    return str(v)[:10]


@dataclass(frozen=True)
class Filters:
    """Sales filter (F1): inclusive date bounds, exact client name, exact product."""

    date_start: str | None = None
    date_end: str | None = None
    client_name: str | None = None
    product_type: str | None = None

    def __post_init__(self):
        object.__setattr__(self, "date_start", _iso(self.date_start))
        object.__setattr__(self, "date_end", _iso(self.date_end))
        object.__setattr__(self, "client_name", _clean(self.client_name))
        object.__setattr__(self, "product_type", _clean(self.product_type))
        if self.date_start and self.date_end and self.date_start > self.date_end:
            raise ValueError("date_start is after date_end")

    def predicate(self, date_col: str = "date") -> Column:
        preds = []
        if self.date_start:
            preds.append(F.col(date_col) >= F.lit(self.date_start).cast("date"))
        if self.date_end:
            preds.append(F.col(date_col) <= F.lit(self.date_end).cast("date"))
        if self.client_name:
            preds.append(F.col("client_name") == F.lit(self.client_name))
        if self.product_type:
            preds.append(F.col("product_type") == F.lit(self.product_type))
        return reduce(lambda a, b: a & b, preds, F.lit(True))

    def with_dates(self, start, end) -> "Filters":
        return Filters(start, end, self.client_name, self.product_type)


def filter_sales(sales: DataFrame, f: Filters | None) -> DataFrame:
    """F1."""
    return sales if f is None else sales.filter(f.predicate())


@dataclass(frozen=True)
class LeadFilters:
    """created_at range, exact source / status / client_id."""

    date_start: str | None = None
    date_end: str | None = None
    source: str | None = None
    status: str | None = None
    client_id: str | None = None

    def predicate(self) -> Column:
        preds = []
        s, e = _iso(self.date_start), _iso(self.date_end)
        if s:
            preds.append(F.col("created_at") >= F.lit(s).cast("date"))
        if e:
            preds.append(F.col("created_at") <= F.lit(e).cast("date"))
        for c in ("source", "status", "client_id"):
            v = _clean(getattr(self, c))
            if v is not None:
                preds.append(F.col(c) == F.lit(v))
        return reduce(lambda a, b: a & b, preds, F.lit(True))


def filter_leads(leads: DataFrame, f: LeadFilters | None) -> DataFrame:
    return leads if f is None else leads.filter(f.predicate())


# Funnel stage labels shown in the lead filter, mapped to status.
STAGE_TO_STATUS = {
    "Lead": "new",
    "Contactado": "contacted",
    "Reunión": "meeting",
    "Cliente": "converted",
    "Perdido": "lost",
}


def lead_search_text() -> Column:
    """The text of an enriched lead that a term is looked up in."""
    # the label lookup here is exact (not case-insensitive as in the table)
    label = F.coalesce(F.element_at(_labels_map(), F.col("source")), F.col("source"), F.lit(""))
    return F.concat_ws(" ", F.coalesce(F.col("id"), F.lit("")), label, F.coalesce(F.col("client_name"), F.lit("")),
                       F.coalesce(F.col("source"), F.lit("")))


def lead_multi_filter(leads_enriched: DataFrame, as_of, source=None, stage=None,
                      date_start=None, date_end=None, preset_days: int | None = None,
                      term: str | None = None) -> DataFrame:
    """source, stage, explicit range (wins over the preset) or a preset of
    7/30/90 days (cutoff ``as_of - n`` inclusive), and a case-insensitive
    substring search over id, source label, client name and source."""
    preds = []
    src = _clean(source)
    if src is not None:
        preds.append(F.col("source") == F.lit(src))
    st = _clean(stage)
    if st is not None and st in STAGE_TO_STATUS:      # unknown stage: no filter
        preds.append(F.col("status") == F.lit(STAGE_TO_STATUS[st]))
    s, e = _iso(date_start), _iso(date_end)
    if s or e:
        if s:
            preds.append(F.col("created_at") >= F.lit(s).cast("date"))
        if e:
            preds.append(F.col("created_at") <= F.lit(e).cast("date"))
    elif preset_days:
        cutoff = F.date_sub(F.lit(_iso(as_of)).cast("date"), int(preset_days))
        preds.append(F.col("created_at") >= cutoff)
    t = (term or "").strip().lower()
    if t:
        preds.append(F.lower(lead_search_text()).contains(F.lit(t)))
    return leads_enriched.filter(reduce(lambda a, b: a & b, preds, F.lit(True)))


def search_clients(clients: DataFrame, term: str | None) -> DataFrame:
    """blank -> all; else case-insensitive substring on the name."""
    t = (term or "").strip().lower()
    if not t:
        return clients
    return clients.filter(F.lower(F.col("name")).contains(F.lit(t)))


REACHED_MEETING = ("meeting", "converted")


def reached_meeting(c="status") -> Column:
    """F6."""
    return F.col(c).isin(*REACHED_MEETING)


def no_action(c="status") -> Column:
    return F.col(c) == "new"


def distinct_values(df: DataFrame, col: str) -> DataFrame:
    """F8: sorted distinct values (a small result; hash-aggregate first)."""
    return df.select(col).distinct().orderBy(col)
