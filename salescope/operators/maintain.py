"""Batch maintenance jobs (M1-M5): the reference edits one row at a time;
here each job takes a whole change set and returns the new tables plus a
report, with MERGE-shaped set operations (anti-join + union, left join +
``when``).  Callers persist the outputs (``sources.sinks.write_table``),
which also cuts the lineage before the next job reads them."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.dates import is_blank, normalize_iso
from ..functions.strip import strip
from ..functions.text import client_field_error, normalize_source, valid_lead_status, valid_meeting_date_text
from ..session import cut_lineage, drop_cut
from .numbering import ranked

DASH = "-"
CLIENT_COLS = ["id", "name", "cif", "address", "contact_person", "email"]


@dataclass
class Upsert:
    table: DataFrame      # the new table
    applied: DataFrame    # accepted change rows
    rejected: DataFrame   # change rows with an ``error`` column


def _order(order_col: str | None, cols: list[str]) -> Column:
    """Batch order of a change row: the given column, then all values (so that
    ties and batches without an order have one result)."""
    return F.struct(*[F.col(c) for c in ([order_col] if order_col else []) + cols])


def _last_per_id(changes: DataFrame, order_col: str | None, id_col: str = "id") -> DataFrame:
    """One row per id: the last one, as if the changes were made one by one."""
    rest = [c for c in changes.columns if c != id_col]
    cols = [c for c in rest if c != order_col]
    return (changes.groupBy(id_col).agg(F.max_by(F.struct(*rest), _order(order_col, cols)).alias("_r"))
            .select(id_col, "_r.*"))


def _not_first(df: DataFrame, key: Column, usable: Column, order: Column, message: str) -> DataFrame:
    """Rows without an error whose key an earlier such row has get ``message``."""
    keyed = df.withColumn("_key", F.when(F.col("error").isNull() & usable, key)).withColumn("_o", order)
    first = keyed.filter("_key is not null").groupBy("_key").agg(F.min("_o").alias("_first"))
    with_key = keyed.filter("_key is not null").join(first, "_key").withColumn(
        "error", F.when(F.col("_o") != F.col("_first"), F.lit(message)))
    return (with_key.select(*df.columns)
            .unionByName(keyed.filter("_key is null").select(*df.columns)))


def upsert_clients(base: DataFrame, changes: DataFrame, order_col: str | None = None) -> Upsert:
    """M1: validate (S21, then duplicate CIF / name against *other* stored
    clients, J11), normalise the CIF (trim + upper), replace by id or insert.

    A batch counts as its changes made one by one in ``order_col`` order (the
    values break ties): of several changes of an id the last one holds, and of
    several ids that claim one CIF or name the first one gets it."""
    keep = [order_col] if order_col else []
    ch = changes.select(*CLIENT_COLS, *keep).withColumn("cif", F.upper(strip("cif")))
    no_id = ch.filter(is_blank("id")).select(*CLIENT_COLS, F.lit("client id is required").alias("error"))
    ch = _last_per_id(ch.filter(~is_blank("id")), order_col)
    err = client_field_error("name", "cif", "email", "contact_person")
    # duplicate checks: count stored rows per key, subtract the row being replaced
    by_cif = base.filter(F.col("cif").isNotNull()).groupBy(F.col("cif").alias("_k")) \
                 .agg(F.count(F.lit(1)).alias("_nc"))
    by_name = base.groupBy(F.lower("name").alias("_nk")).agg(F.count(F.lit(1)).alias("_nn"))
    own = base.select(F.col("id").alias("_oid"), F.col("cif").alias("_ocif"), F.lower("name").alias("_oname"))
    name_key = F.lower(strip("name"))
    j = (ch.join(own, ch.id == own._oid, "left")
           .join(by_cif, F.col("cif") == F.col("_k"), "left")
           .join(by_name, name_key == F.col("_nk"), "left"))
    other_cif = F.coalesce("_nc", F.lit(0)) - F.when(F.col("_ocif") == F.col("cif"), 1).otherwise(0)
    other_name = F.coalesce("_nn", F.lit(0)) - F.when(F.col("_oname") == name_key, 1).otherwise(0)
    use_cif = ~is_blank("cif") & (F.col("cif") != DASH)
    err = F.coalesce(err,
                     F.when(use_cif & (other_cif > 0), F.lit("another client has this CIF")),
                     F.when(other_name > 0, F.lit("another client has this name")))
    checked = j.select(*CLIENT_COLS, *keep, err.alias("error"))
    order = _order(order_col, CLIENT_COLS)
    checked = _not_first(checked, F.col("cif"), use_cif, order, "another client has this CIF")
    checked = _not_first(checked, name_key, F.lit(True), order, "another client has this name")
    checked = checked.select(*CLIENT_COLS, "error").unionByName(no_id)
    ok = checked.filter(F.col("error").isNull()).drop("error")
    table = base.join(ok.select(F.col("id").alias("_id")), base.id == F.col("_id"), "left_anti") \
                .unionByName(ok.select(*CLIENT_COLS))
    return Upsert(table, ok, checked.filter(F.col("error").isNotNull()))


@dataclass
class Deleted:
    clients: DataFrame
    sales: DataFrame
    leads: DataFrame
    events: DataFrame


def delete_clients(ids: DataFrame, clients: DataFrame, sales: DataFrame,
                   leads: DataFrame, events: DataFrame) -> Deleted:
    """M2: remove clients; cascade their sales; NULL the client_id of their
    leads and funnel events."""
    gone = ids.select(F.col("id").alias("_gid")).distinct()
    keep = lambda df, k: df.join(gone, df[k] == gone._gid, "left_anti")
    # the keys of a fact table are decided once per client, not once per row
    sold = sales.groupBy("client_id").agg(F.count(F.lit(1)).alias("_n")).filter("client_id is not null")
    dropped = sold.join(gone, F.col("client_id") == F.col("_gid")).select(F.col("client_id").alias("_gid"))
    left_sales = sales.join(dropped, sales.client_id == F.col("_gid"), "left_anti")

    def null_out(df):
        j = df.filter("client_id is not null").join(gone, F.col("client_id") == F.col("_gid"), "left")
        j = j.select(*[F.when(F.col("_gid").isNull(), F.col(c)).alias(c) if c == "client_id" else F.col(c)
                       for c in df.columns])
        return j.unionByName(df.filter("client_id is null"))
    return Deleted(keep(clients, "id"), left_sales, null_out(leads), null_out(events))


def _checked_update(updates: DataFrame, known: DataFrame, order_col: str | None) -> DataFrame:
    md = strip(F.col("meeting_date").cast("string"))
    shaped = valid_meeting_date_text(F.col("meeting_date").cast("string"))
    return updates.join(known, F.col("id") == F.col("_kid"), "left").select(
        "id", "status", "meeting_date", *([order_col] if order_col else []),
        F.lower(strip("status")).alias("_st"), F.when(shaped, md).try_cast("date").alias("_md"),
        F.coalesce(F.when(F.col("_kid").isNull(), F.lit("unknown lead id")),
                   F.when(~valid_lead_status("status"), F.lit("invalid status")),
                   F.when(~shaped | (~is_blank("meeting_date") & F.when(shaped, md).try_cast("date").isNull()),
                          F.lit("invalid meeting date"))).alias("error"))


def update_leads(leads: DataFrame, updates: DataFrame, order_col: str | None = None) -> Upsert:
    """M3: status / meeting_date updates by lead id.  Status must be in the
    vocabulary (S22), meeting_date blank or a day as yyyy-mm-dd; unknown ids are
    rejected.  Of several valid updates of a lead the last one holds (in
    ``order_col`` order, the values break ties)."""
    known = leads.select(F.col("id").alias("_kid")).distinct()
    chk = _checked_update(updates, known, order_col)
    ok = chk.filter(F.col("error").isNull()).select(
        F.col("id").alias("_uid"), "_st", "_md", *([order_col] if order_col else []))
    ok = _last_per_id(ok, order_col, "_uid").select("_uid", "_st", "_md")
    j = leads.join(ok, leads.id == ok._uid, "left")
    hit = F.col("_uid").isNotNull()
    table = j.select(*[F.when(hit, F.col("_st")).otherwise(F.col(c)).alias(c) if c == "status"
                       else F.when(hit, F.col("_md")).otherwise(F.col(c)).alias(c) if c == "meeting_date"
                       else F.col(c) for c in leads.columns])
    rejected = chk.filter(F.col("error").isNotNull()).select("id", "status", "meeting_date", "error")
    applied = ok.select(F.col("_uid").alias("id"), F.col("_st").alias("status"), F.col("_md").alias("meeting_date"))
    return Upsert(table, applied, rejected)


def insert_leads(leads: DataFrame, new: DataFrame, order_col: str | None = None) -> Upsert:
    """M3 insert: rows (id, external_id, created_at, source, status,
    meeting_date, client_id); status must be valid (S22, stored lower-case),
    meeting_date blank or a day.  Ids and (external_id, source) pairs are unique
    in the store and in the batch: the first valid row of a batch (``order_col``
    order, the values break ties) gets them."""
    md = strip(F.col("meeting_date").cast("string"))
    shaped = valid_meeting_date_text(F.col("meeting_date").cast("string"))
    day = F.when(shaped, md).try_cast("date")
    known = leads.select(F.col("id").alias("_kid")).distinct()
    pairs = leads.filter("external_id is not null").select(
        F.col("external_id").alias("_ke"), F.col("source").alias("_ks")).distinct()
    n = (new.join(known, new.id == known._kid, "left")
         .join(pairs, (new.external_id == pairs._ke) & (new.source == pairs._ks), "left"))
    chk = n.select(*new.columns, day.alias("_day"), F.coalesce(
        F.when(is_blank("id"), F.lit("lead id is required")),
        F.when(F.col("_kid").isNotNull(), F.lit("lead id already exists")),
        F.when(F.col("_ke").isNotNull(), F.lit("lead already exists for this source")),
        F.when(~valid_lead_status("status"), F.lit("invalid status")),
        F.when(~shaped | (~is_blank("meeting_date") & day.isNull()), F.lit("invalid meeting date"))).alias("error"))
    order = _order(order_col, [c for c in new.columns if c != order_col])
    chk = _not_first(chk, F.col("id"), F.lit(True), order, "lead id already exists")
    chk = _not_first(chk, F.struct("external_id", "source"), F.col("external_id").isNotNull() & F.col("source").isNotNull(),
                     order, "lead already exists for this source")
    # exact repetitions of the first row share its order
    ok = (chk.filter(F.col("error").isNull()).dropDuplicates(["id"])
          .withColumn("status", F.lower(strip("status"))).withColumn("meeting_date", F.col("_day")))
    table = leads.unionByName(ok.select(*leads.columns))
    return Upsert(table, ok.select(*new.columns), chk.filter(F.col("error").isNotNull()).drop("_day"))


def upsert_spend(base: DataFrame, changes: DataFrame, as_of, order_col: str | None = None) -> Upsert:
    """M4: rows (id, source, amount, date): source normalised (S3) and
    required, amount > 0 rounded to 2 dp, date ISO (S2) or ``as_of`` when
    blank; replace by id (the last valid change of an id holds), insert rows
    without one under the next free ids, by source, date and amount."""
    src = normalize_source(strip("source"))
    amt = strip(F.col("amount").cast("string")).try_cast("double")
    iso = normalize_iso("date")
    d = F.when(is_blank("date"), F.lit(str(as_of)[:10]).cast("date")).otherwise(iso.try_cast("date"))
    chk = changes.select(
        F.col("id").cast("long").alias("id"), src.alias("source"), F.round(amt, 2).cast("decimal(18,2)").alias("amount"),
        d.alias("date"), *([order_col] if order_col else []),
        F.coalesce(F.when(is_blank("source"), F.lit("source is required")),
                   F.when(amt.isNull() | F.isnan(amt) | (amt <= 0), F.lit("amount must be greater than 0")),
                   F.when(d.isNull(), F.lit("invalid date"))).alias("error"))
    cols = ["id", "source", "amount", "date"]
    ok = chk.filter(F.col("error").isNull()).drop("error")
    named = _last_per_id(ok.filter("id is not null"), order_col).select(*cols)
    new = ok.filter("id is null")
    top = F.broadcast(base.select("id").unionByName(named.select("id")).agg(F.coalesce(F.max("id"), F.lit(0)).alias("_top")))
    new = (ranked(new, ["source", "date", "amount", *([order_col] if order_col else [])], "_i").crossJoin(top)      # one row
           .select((F.col("_top") + F.col("_i")).cast("long").alias("id"), "source", "amount", "date"))
    table = base.join(named.select(F.col("id").alias("_id")),
                      base.id == F.col("_id"), "left_anti").select(*cols).unionByName(named).unionByName(new)
    return Upsert(table, named.unionByName(new), chk.filter(F.col("error").isNotNull()).select(*cols, "error"))


def delete_spend(base: DataFrame, ids: DataFrame) -> DataFrame:
    return base.join(ids.select(F.col("id").alias("_d")), base.id == F.col("_d"), "left_anti")


def list_spend(base: DataFrame) -> DataFrame:
    """M4 listing order: date desc, id desc."""
    return base.orderBy(F.desc("date"), F.desc("id"))


def _valid_field(c: str) -> Column:
    return F.col(c).isNotNull() & (strip(F.col(c)) != "") & (strip(F.col(c)) != DASH)


@dataclass
class Merge:
    mapping: DataFrame   # name_key, old_id, primary_id, rows_moved
    clients: DataFrame
    sales: DataFrame
    leads: DataFrame | None
    events: DataFrame | None
    drop: Callable[[], None]   # deletes the written mapping, once nothing reads it any more


def _resolved(mapping: DataFrame) -> DataFrame:
    """Follow id -> primary to its end.  Every step goes to a smaller (not
    stored, id), so there are no cycles; each round doubles the distance, so
    the rounds are logarithmic in the longest chain."""
    mapping = cut_lineage(mapping, "merge-mapping")
    while True:
        nxt = mapping.select(F.col("client_id").alias("_via"), F.col("primary_id").alias("_next")).filter("_via != _next")
        joined = mapping.join(nxt, F.col("primary_id") == F.col("_via"), "left")
        if joined.filter("_next is not null").isEmpty():
            return mapping
        old, mapping = mapping, cut_lineage(joined.select(
            "client_id", F.coalesce("_next", "primary_id").alias("primary_id"), "name_key", "rows_moved"), "merge-mapping")
        drop_cut(old)


def merge_duplicate_clients(sales: DataFrame, clients: DataFrame, leads: DataFrame | None = None,
                            events: DataFrame | None = None, repoint_leads: bool = False) -> Merge:
    """M5: merge client ids sharing a (case-insensitive) sales name.

    Primary of a name = lowest id present in the client store, else lowest id.
    An id listed under several names follows the one with the smallest key; if
    its primary moves on to another one, so does the id (the reference runs the
    groups one after another in an arbitrary order; the transitive result does
    not depend on it).  The primary's blank / '-' fields are filled from the
    stored ids that end at it (itself first, then id order).  Sales of the
    others move to the primary and their client rows are deleted.  With
    ``repoint_leads`` the same mapping is applied to leads and funnel events
    (default: left dangling, like the reference; Q4 then shows them as orphans).

    The mapping (one row per merged id) is written under the shared checkpoint
    folder, because resolving it takes a loop; nothing else runs before the
    caller reads a result.  ``Merge.drop`` deletes it afterwards.
    """
    from .quality import duplicate_members_from_pairs, name_id_pairs
    pairs = name_id_pairs(sales)
    members = duplicate_members_from_pairs(pairs).select("name_key", "client_id")
    # all sales of an id move, those under names of its own included
    moved = pairs.groupBy("client_id").agg(F.sum("n_rows").cast("long").alias("rows_moved"))
    stored = clients.select(F.col("id").alias("client_id"), F.lit(True).alias("_stored"))
    m = members.join(stored, "client_id", "left")
    low = F.struct(F.col("_stored").isNull().alias("no"), F.col("client_id").alias("id"))
    prim = m.groupBy("name_key").agg(F.min(low).alias("_p")).select("name_key", F.col("_p.id").alias("primary_id"))
    one = (m.join(prim, "name_key").groupBy("client_id")
           .agg(F.min_by("primary_id", "name_key").alias("primary_id"), F.min("name_key").alias("name_key")).join(moved, "client_id"))
    resolved = _resolved(one)
    mapping = resolved.filter("client_id != primary_id").select(
        "name_key", F.col("client_id").alias("old_id"), "primary_id", "rows_moved")
    # field fill: the first valid value in (own first, id) order per primary
    fields = ("cif", "address", "contact_person", "email")
    donors = resolved.select("client_id", "primary_id").join(
        clients.select(F.col("id").alias("client_id"), *[F.col(c).alias(f"_{c}") for c in fields]), "client_id")
    order = lambda c: F.when(_valid_field(f"_{c}"),
                             F.struct((F.col("client_id") != F.col("primary_id")).alias("_sec"), F.col("client_id")))
    fill = donors.groupBy("primary_id").agg(*[F.min_by(f"_{c}", order(c)).alias(f"_f_{c}") for c in fields])
    sec = mapping.select(F.col("old_id").alias("_sec_id"))
    c2 = clients.join(sec, clients.id == sec._sec_id, "left_anti")
    c3 = c2.join(fill, c2.id == fill.primary_id, "left")
    new_clients = c3.select("id", "name", *[
        F.when(F.col("primary_id").isNotNull() & ~_valid_field(c) & F.col(f"_f_{c}").isNotNull(),
               F.col(f"_f_{c}")).otherwise(F.col(c)).alias(c) for c in fields])

    def repoint(df):
        mm = mapping.select(F.col("old_id").alias("_old"), F.col("primary_id").alias("_new"))
        j = df.filter("client_id is not null").join(mm, F.col("client_id") == F.col("_old"), "left")
        j = j.select(*[F.coalesce(F.col("_new"), F.col(c)).alias(c) if c == "client_id" else F.col(c)
                       for c in df.columns])
        return j.unionByName(df.filter("client_id is null"))
    new_leads = repoint(leads) if (repoint_leads and leads is not None) else leads
    new_events = repoint(events) if (repoint_leads and events is not None) else events
    return Merge(mapping, new_clients, repoint(sales), new_leads, new_events, lambda: drop_cut(resolved))
