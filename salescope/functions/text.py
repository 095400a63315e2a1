"""Text rules for ingestion and validation (S3-S7, S18-S22, S24, S27) as
built-in Spark expressions.  Each validator returns an error message column
that is NULL when the value passes, so several rules combine with
``F.coalesce`` into "first failing rule"."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from .strip import strip


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


# Marketing source spellings mapped to canonical channels.
SOURCE_NORMALIZATION = {
    "facebook": "meta_ads",
    "fb": "meta_ads",
    "meta": "meta_ads",
    "instagram": "meta_ads",
    "ig": "meta_ads",
    "messenger": "meta_ads",
    "audience_network": "meta_ads",
    "google": "google_ads",
    "google_ads": "google_ads",
    "adwords": "google_ads",
    "gads": "google_ads",
    "linkedin": "linkedin_ads",
    "linkedin_ads": "linkedin_ads",
    "tiktok": "tiktok_ads",
    "tiktok_ads": "tiktok_ads",
    "csv": "manual_import",
    "manual": "manual_import",
}
# Suffixes removed from a lower-cased source, checked in this
# order, each one on the result of the previous step.
SOURCE_SUFFIXES = [" lead ads", " lead form", " ads", "_ads", "-ads"]


def _map_literal(d: dict) -> Column:
    return F.create_map(*[F.lit(x) for kv in d.items() for x in kv])


def source_key(c) -> Column:
    """Lower-case, trim and strip the platform suffixes (before the lookup)."""
    k = strip(F.lower(_col(c)))
    for suf in SOURCE_SUFFIXES:
        # "ends with suffix -> drop it and trim" as one linear expression per
        # step (a nested when() would repeat k three times per step)
        k = F.regexp_replace(k, " *" + re.escape(suf) + "$", "")
    return k


def normalize_source(c) -> Column:
    """S3: canonical source; unknown spellings keep their stripped key;
    NULL and '' pass through unchanged."""
    c = _col(c)
    k = source_key(c)
    mapped = F.coalesce(F.element_at(_map_literal(SOURCE_NORMALIZATION), k), k)
    return F.when(c.isNull() | (c == ""), c).otherwise(mapped)


def is_known_source(c) -> Column:
    """True when the stripped key is one of the mapped spellings (Q3)."""
    return source_key(c).isin(list(SOURCE_NORMALIZATION))


# Rejection messages of the import rules ({field} is the
# logical column, {value} the offending text).
MSG_REQUIRED_NONE = "El campo obligatorio '{field}' es None"
MSG_REQUIRED_EMPTY = "El campo obligatorio '{field}' está vacío"
MSG_NUMBER_NONE = "El campo '{field}' es obligatorio y no puede ser None"
MSG_NUMBER_EMPTY = "El campo '{field}' está vacío"
MSG_NUMBER_NOT_NUMERIC = "El campo '{field}' debe ser numérico, recibido: '{value}'"
MSG_NUMBER_NOT_POSITIVE = "El campo '{field}' debe ser mayor que 0, recibido: {value}"


def _msg(template: str, field: str, value: Column | None = None) -> Column:
    head, _, tail = template.replace("{field}", field).partition("{value}")
    if value is None:
        return F.lit(head)
    return F.concat(F.lit(head), value, F.lit(tail))


def required_string(c, field: str, trimmed=None) -> tuple[Column, Column]:
    """(trimmed value, error).  ``trimmed`` may name a column that already
    holds the trimmed text, so that it is trimmed once per row (S5, S6 too)."""
    c = _col(c)
    t = strip(c) if trimmed is None else _col(trimmed)
    err = (F.when(c.isNull(), _msg(MSG_REQUIRED_NONE, field))
             .when(t == "", _msg(MSG_REQUIRED_EMPTY, field)))
    return t, err


# Fixed value: accepted numeric text.
NUMBER_PATTERN = r"^[+-]?([0-9]+[.]?[0-9]*|[.][0-9]+)([eE][+-]?[0-9]+)?$"


def positive_number(c, field: str, trimmed=None) -> tuple[Column, Column]:
    """(double value, error).  Text must parse as a finite number > 0.
    NaN / infinity / '1_000' are rejected (tightening documented in README)."""
    c = _col(c)
    t = strip(c.cast("string")) if trimmed is None else _col(trimmed)
    v = t.try_cast("double")
    # plain decimal / exponent syntax only (Spark's cast would also take "1d")
    bad = ~t.rlike(NUMBER_PATTERN) | v.isNull() | F.isnan(v) | (F.abs(v) == float("inf"))
    err = (F.when(c.isNull(), _msg(MSG_NUMBER_NONE, field))
             .when(t == "", _msg(MSG_NUMBER_EMPTY, field))
             .when(bad, _msg(MSG_NUMBER_NOT_NUMERIC, field, t))
             .when(v <= 0, _msg(MSG_NUMBER_NOT_POSITIVE, field, v.cast("string"))))
    return v, err


def optional_string(c, trimmed=None) -> Column:
    """NULL / blank -> NULL, else trimmed text."""
    t = strip(_col(c).cast("string")) if trimmed is None else _col(trimmed)
    return F.when(t == "", F.lit(None).cast("string")).otherwise(t)


def lead_id(external_id, client_id, created_at, source) -> Column:
    """External id when present, else sha1 hex of
    '{client_id or ""}_{created_at}_{source}'."""
    key = F.concat_ws("_", F.coalesce(_col(client_id), F.lit("")),
                      F.date_format(_col(created_at), "yyyy-MM-dd"), _col(source))
    return F.coalesce(_col(external_id), F.sha1(key))


def normalize_text(c) -> Column:
    """NULL -> '', trimmed."""
    return strip(F.coalesce(_col(c), F.lit("")))


def mask_sensitive(c) -> Column:
    """Blank and the placeholders '-' / '—' pass through, else bullets."""
    c = _col(c)
    t = strip(c)
    return F.when(c.isNull() | t.isin("", "-", "—"), c).otherwise(F.lit("••••••••"))


def _eur_body(x: Column, decimals: int) -> Column:
    # format_number gives 1,234.56 (HALF_EVEN on the decimal value); swap the
    # separators to the European 1.234,56.
    return F.translate(F.format_number(x.cast("double"), decimals), ",.", ".,")


def format_eur(c, decimals: int = 2) -> Column:
    """S18: '€ 1.234,56'; NULL -> '€ 0,00'."""
    x = _col(c)
    return F.when(x.isNull(), F.lit("€ 0,00")).otherwise(F.concat(F.lit("€ "), _eur_body(x, decimals)))


def format_eur_no_symbol(c, decimals: int = 2) -> Column:
    x = _col(c)
    return F.when(x.isNull(), F.lit("0,00")).otherwise(_eur_body(x, decimals))


def format_eur_signed(c, decimals: int = 2) -> Column:
    x = _col(c)
    return (F.when(x.isNull(), F.lit("+0,00"))
             .when(x >= 0, F.concat(F.lit("+"), _eur_body(x, decimals)))
             .otherwise(_eur_body(x, decimals)))


# Client field rules.
CIF_SEPARATORS = r"[-.\s]"
CIF_PATTERN = r"^[A-Za-z0-9]{7,12}$"
EMAIL_PATTERN = r"^[\w.-]+@[\w.-]+\.\w+$"
CLIENT_ERRORS = {
    "name": "name must have at least 2 characters",
    "cif": "CIF/NIF must have 7 to 12 alphanumeric characters",
    "email": "email must have a valid format",
    "contact": "contact must have at least 2 characters",
}


def client_field_error(name, cif, email, contact) -> Column:
    """First failing client rule's message, NULL when valid."""
    name, cif, email, contact = map(_col, (name, cif, email, contact))
    blank = lambda c: c.isNull() | (strip(c) == "")
    name_ok = ~blank(name) & (F.length(strip(name)) >= 2)
    cleaned = F.regexp_replace(strip(cif), CIF_SEPARATORS, "")
    cif_ok = blank(cif) | cleaned.rlike(CIF_PATTERN)
    email_ok = blank(email) | strip(email).rlike(EMAIL_PATTERN)
    contact_ok = blank(contact) | (F.length(strip(contact)) >= 2)
    return (F.when(~name_ok, F.lit(CLIENT_ERRORS["name"]))
             .when(~cif_ok, F.lit(CLIENT_ERRORS["cif"]))
             .when(~email_ok, F.lit(CLIENT_ERRORS["email"]))
             .when(~contact_ok, F.lit(CLIENT_ERRORS["contact"])))


# Lead status vocabulary.
LEAD_STATUSES = ["new", "contacted", "meeting", "converted", "lost"]


def valid_lead_status(c) -> Column:
    """Known status, case / space insensitive."""
    c = _col(c)
    return c.isNotNull() & F.lower(strip(c)).isin(LEAD_STATUSES)


def valid_meeting_date_text(c) -> Column:
    """Blank or ``dddd-dd-dd``."""
    c = _col(c)
    return c.isNull() | (strip(c) == "") | strip(c).rlike(r"^\d{4}-\d{2}-\d{2}$")


# Source display labels (lead table, case-insensitive lookup;
# marketing section, exact lookup).
SOURCE_LABELS_TABLE = {
    "meta_ads": "Meta Ads",
    "google_ads": "Google Ads",
    "linkedin_ads": "LinkedIn Ads",
    "tiktok_ads": "TikTok Ads",
    "manual_import": "Manual",
}
SOURCE_LABELS_MARKETING = {
    "meta_ads": "Meta",
    "google_ads": "Google",
    "linkedin_ads": "LinkedIn",
    "tiktok_ads": "TikTok",
    "referral": "Referral",
    "organic": "Organic",
    "manual_import": "Manual",
}


def source_label(c, table: str = "leads") -> Column:
    """Display label; blank -> '—'; unknown -> as is."""
    c = _col(c)
    if table == "leads":
        lab = F.element_at(_map_literal(SOURCE_LABELS_TABLE), F.lower(c))
        return F.when(c.isNull() | (c == ""), F.lit("—")).otherwise(F.coalesce(lab, c))
    lab = F.element_at(_map_literal(SOURCE_LABELS_MARKETING), c)
    return F.coalesce(lab, c)


def products_text(arr) -> Column:
    """First two labels, then ', +n' for the rest; '-' when empty."""
    a = _col(arr)
    n = F.size(a)
    head = F.array_join(F.slice(a, 1, 2), ", ")
    return (F.when(a.isNull() | (n <= 0), F.lit("-"))
             .when(n > 2, F.concat(head, F.lit(", +"), (n - 2).cast("string")))
             .otherwise(head))
