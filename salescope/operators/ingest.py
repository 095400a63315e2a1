"""Rule-based imports.

Input: raw rows with logical column names (see ``sources.delimited``) and a
``row_no``.  Every rule is a column expression returning an error message or
NULL; ``coalesce`` of the rules in the reference's order gives the *first*
error of a row, so valid / rejected is one pass with no Python per row.
Deduplication is set-based: anti-joins against the store, then first row per
key by file order via ``min_by`` (partial aggregation, skew-safe).
"""

from __future__ import annotations

import time
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..functions.dates import is_blank, parse_date_or_default, parse_import_date, parse_trimmed_date
from ..functions.strip import strip
from ..functions.text import lead_id, normalize_source, optional_string, positive_number, required_string
from ..session import cut_lineage


def _c(df: DataFrame, name: str) -> Column:
    return F.col(name) if name in df.columns else F.lit(None).cast("string")


def _split(df: DataFrame, err: Column, valid_cols: list[Column], raw_cols: list[str]):
    # The rule expressions read each raw column many times.  When the raw
    # columns are themselves expressions (a view, a derived layout), pushing
    # the error filter below this projection would inline those expressions
    # into every rule.  A non-deterministic column that the filter reads keeps
    # the filter above the projection (Catalyst never pushes a predicate
    # through a non-deterministic projection), so every rule reads the
    # materialised column once per row.
    t = df.select("*", err.alias("error"), F.monotonically_increasing_id().alias("_scan"))
    kept = F.col("_scan") >= 0    # never folded away (unlike IS NOT NULL on a non-null id)
    valid = t.filter(F.col("error").isNull() & kept).select(*valid_cols)
    rejected = t.filter(F.col("error").isNotNull() & kept).select(*row_key(raw_of=df), "error", *raw_cols)
    return valid, rejected


def row_key(raw_of: DataFrame) -> list[str]:
    """What identifies a row: its number, within its file when several files
    are read together (``_file``)."""
    return ["_file", "row_no"] if "_file" in raw_of.columns else ["row_no"]


def _prepared(raw: DataFrame, texts: list[str], dates: list[str]) -> DataFrame:
    """Trim each text column once (``_st_<col>``) and parse each date once
    (``_pd_<col>``); values and error rules read these columns."""
    have = [c for c in texts if c in raw.columns]
    raw = raw.select("*", *[strip(F.col(c).cast("string")).alias(f"_st_{c}") for c in have])
    return raw.select("*", *[parse_trimmed_date(f"_st_{c}").alias(f"_pd_{c}") for c in dates if c in have])


def _trimmed(raw: DataFrame, name: str) -> Column:
    return _c(raw, f"_st_{name}")


SALES_RAW = ["client_name", "client_id", "product_type", "price", "date"]
LEADS_RAW = ["external_id", "created_at", "source", "status", "meeting_date", "client_id"]


LEAD_COLS = ["id", "external_id", "created_at", "source", "status", "meeting_date", "client_id"]
SALE = ["client_name", "client_id", "product_type", "price", "date", "used_default_date", "date_defaulted"]


def _sales_rules(raw: DataFrame, as_of) -> tuple[Column, list[Column]]:
    """(first error, valid columns) of I7 over prepared rows."""
    has_date = "date" in raw.columns
    t = {c: _trimmed(raw, c) for c in SALES_RAW}
    name, e1 = required_string(_c(raw, "client_name"), "client_name", t["client_name"])
    cid, e2 = required_string(_c(raw, "client_id"), "client_id", t["client_id"])
    prod, e3 = required_string(_c(raw, "product_type"), "product_type", t["product_type"])
    price, e4 = positive_number(_c(raw, "price"), "price", t["price"])
    if has_date:
        d, e5 = parse_date_or_default(F.col("date"), as_of, parsed="_pd_date", trimmed=t["date"])
        defaulted = is_blank("date", t["date"])
    else:
        d, e5 = F.lit(str(as_of)[:10]).cast("date"), F.lit(None).cast("string")
        defaulted = F.lit(True)
    # the reference flags the file only when it has no date column at all;
    # ``date_defaulted`` additionally marks rows whose blank date became as_of
    values = [name, cid, prod, price, d, F.lit(not has_date), defaulted]
    return F.coalesce(e1, e2, e3, e4, e5), [v.alias(n) for n, v in zip(SALE, values)]


def validate_sales(raw: DataFrame, as_of) -> tuple[DataFrame, DataFrame]:
    """(valid, rejected).  Valid: row_no, client_name, client_id,
    product_type (trimmed), price DOUBLE, date DATE, used_default_date (the
    file has no date column), date_defaulted (this row's date was blank)."""
    ready = _prepared(raw, SALES_RAW, ["date"])
    err, values = _sales_rules(ready, as_of)
    return _split(ready, err, [*map(F.col, row_key(raw)), *values], [c for c in SALES_RAW if c in raw.columns])


def check_sales(raw: DataFrame, as_of) -> DataFrame:
    """I7 without a split: every row with its key, ``sales_error`` (null: valid),
    ``sale`` (the valid columns, null beside an error) and ``raw`` (the columns as
    they came), so that one write can serve all that an import does next."""
    ready = _prepared(raw, SALES_RAW, ["date"])
    err, values = _sales_rules(ready, as_of)
    checked = ready.select("*", err.alias("sales_error"))
    return checked.select(*row_key(raw), "sales_error",
                          F.when(F.col("sales_error").isNull(), F.struct(*values)).alias("sale"),
                          F.struct(*[c for c in SALES_RAW if c in raw.columns]).alias("raw"))


def new_clients_from_sales(valid: DataFrame, clients: DataFrame) -> DataFrame:
    """Clients of the file missing from the store, named after
    their first row in (file, row) order; cif '-', other fields NULL."""
    first = valid.groupBy("client_id").agg(F.min_by("client_name", F.struct(*row_key(valid))).alias("name"))
    missing = first.join(clients.select(F.col("id").alias("client_id")), "client_id", "left_anti")
    return missing.select(F.col("client_id").alias("id"), "name", F.lit("-").alias("cif"),
                          *[F.lit(None).cast("string").alias(c) for c in ("address", "contact_person", "email")])


@dataclass
class ImportResult:
    valid: DataFrame
    rejected: DataFrame
    extra: dict = field(default_factory=dict)


def import_sales(raw: DataFrame, clients: DataFrame, as_of, existing: DataFrame | None = None) -> ImportResult:
    """I8: validated sales, the client rows to create and, with ``existing``
    (the sales store), the rows to append: ``extra['append']`` has the store's
    columns with an id per row (the file and row number, so that importing the
    same file again meets its own ids and appends nothing twice).

    ``extra['counts']`` holds total, valid and rejected rows, measured in the
    same pass (I14).  Nothing is written here: a dry run reads the result, a
    real one appends it (``sources.sinks.append_import``)."""
    valid, rejected = validate_sales(raw, as_of)
    extra = {"new_clients": new_clients_from_sales(valid, clients)}
    counts = valid.select(F.lit(1).alias("v")).unionByName(rejected.select(F.lit(0).alias("v")))
    extra["counts"] = counts.agg(F.count(F.lit(1)).alias("total_rows"), F.coalesce(F.sum("v"), F.lit(0)).alias("valid_rows")).select(
        "total_rows", "valid_rows", (F.col("total_rows") - F.col("valid_rows")).alias("rejected_rows"))
    if existing is not None:
        file = F.col("_file") if "_file" in valid.columns else F.lit("import")
        rows = valid.select(F.concat_ws("#", file, F.col("row_no").cast("string")).alias("id"), "client_name", "client_id",
                            "product_type", F.col("price").cast("decimal(18,2)").alias("price"), "date")
        extra["append"] = rows.join(existing.select("id"), "id", "left_anti")
    return ImportResult(valid, rejected, extra)



def _lead_rules(raw: DataFrame, as_of) -> tuple[Column, list[Column]]:
    """(first error, valid columns) of I9 over prepared rows."""
    t = {c: _trimmed(raw, c) for c in LEADS_RAW}
    created, e1 = parse_date_or_default(_c(raw, "created_at"), as_of, trimmed=t["created_at"],
                                        parsed="_pd_created_at" if "created_at" in raw.columns else None)
    src, e2 = required_string(_c(raw, "source"), "source", t["source"])
    src = normalize_source(src)
    ext, status, cid = (optional_string(_c(raw, c), t[c]) for c in ("external_id", "status", "client_id"))
    md_raw = _c(raw, "meeting_date")
    md_parsed = F.col("_pd_meeting_date") if "meeting_date" in raw.columns else parse_import_date(md_raw)
    md = F.when(is_blank(md_raw, t["meeting_date"]), F.lit(None).cast("date")).otherwise(md_parsed)
    values = [lead_id(ext, cid, created, src), ext, created, src, status, md, cid]
    return F.coalesce(e1, e2), [v.alias(n) for n, v in zip(LEAD_COLS, values)]


def validate_leads(raw: DataFrame, as_of) -> tuple[DataFrame, DataFrame]:
    """created_at (blank -> as_of, unparsable -> reject), source required
    and normalised (S3); optional external_id / status / client_id (S6);
    meeting_date parsed, unparsable -> NULL; id = S7."""
    ready = _prepared(raw, LEADS_RAW, ["created_at", "meeting_date"])
    err, values = _lead_rules(ready, as_of)
    return _split(ready, err, [*map(F.col, row_key(raw)), *values], [c for c in LEADS_RAW if c in raw.columns])


def check_mixed(raw: DataFrame, as_of) -> DataFrame:
    """Both rule sets over the rows of a mixed file in one projection: the key,
    ``sales_error``, ``sale``, ``leads_error``, ``lead`` and ``row_class``: both, sales,
    leads or neither, by the rule sets that the row passes."""
    ready = _prepared(raw, list(dict.fromkeys([*SALES_RAW, *LEADS_RAW])), ["date", "created_at", "meeting_date"])
    sales_error, sale = _sales_rules(ready, as_of)
    leads_error, lead = _lead_rules(ready, as_of)
    checked = ready.select("*", sales_error.alias("sales_error"), leads_error.alias("leads_error"))
    of_sales, of_leads = F.col("sales_error").isNull(), F.col("leads_error").isNull()
    return checked.select(
        *row_key(raw), "sales_error", F.when(of_sales, F.struct(*sale)).alias("sale"),
        "leads_error", F.when(of_leads, F.struct(*lead)).alias("lead"),
        F.when(of_sales & of_leads, "both").when(of_sales, "sales").when(of_leads, "leads").otherwise("neither").alias("row_class"))


def file_counts(checked: DataFrame, error: str = "sales_error") -> DataFrame:
    """Per file the rows, valid and invalid ones, of rows that rules were applied to."""
    return checked.groupBy("_file").agg(F.count(F.lit(1)).alias("row_count"), F.count_if(F.col(error).isNull()).alias("valid_rows"),
                                        F.count(error).alias("invalid_rows"))


def staged(checked: DataFrame, name: str) -> tuple[DataFrame, dict]:
    """The checked rows written once under the shared checkpoint folder, and their
    counts, observed on the rows as they were written: ``total`` and one per error
    column and row class.  No row is read a second time for a count."""
    seen = Observation(name)
    measures = [F.count(F.lit(1)).alias("total")]
    measures += [F.count(c).alias(c) for c in checked.columns if c.endswith("_error")]
    if "row_class" in checked.columns:
        measures += [F.count_if(F.col("row_class") == c).alias(c) for c in ("both", "sales", "leads", "neither")]
    table = cut_lineage(checked.observe(seen, *measures), name)
    return table, seen.get


def import_leads(raw: DataFrame, existing: DataFrame, clients: DataFrame, as_of,
                 on_unknown_client: str = "fail") -> ImportResult:
    """Insert-or-ignore with first-wins in file order.

    * rows without status cannot be stored (NOT NULL) -> ``missing_status``
      (the reference counted them as duplicates);
    * a row is a duplicate when its id or its (external_id, source) already
      exists in the store, or an earlier row of the file with the same id was
      inserted;
    * ``on_unknown_client``: ``fail`` (reference: FK error aborts the import;
      ``extra['unknown_clients']`` lists the ids and ``valid`` is empty),
      ``null`` (store the lead without client) or ``keep``.
    """
    return insert_leads(*validate_leads(raw, as_of), existing, clients, on_unknown_client)


def insert_leads(valid: DataFrame, rejected: DataFrame, existing: DataFrame, clients: DataFrame,
                 on_unknown_client: str = "fail") -> ImportResult:
    """I10 behind the rules: ``import_leads`` of rows that were validated before."""
    key = row_key(valid)
    missing_status = valid.filter(F.col("status").isNull())
    cand = valid.filter(F.col("status").isNotNull())
    by_id = existing.select(F.col("id"))
    by_pair = existing.filter(F.col("external_id").isNotNull()).select("external_id", "source")
    fresh = cand.join(by_id, "id", "left_anti").join(by_pair, ["external_id", "source"], "left_anti")
    first = (fresh.groupBy("id").agg(F.min_by(F.struct(*[c for c in LEAD_COLS if c != "id"], *key),
                                              F.struct(*key)).alias("_r"))
                  .select("id", "_r.*"))
    known = clients.select(F.col("id").alias("client_id")).distinct()
    # most leads have no client: those rows stay out of the joins on it
    with_client, without = first.filter("client_id is not null"), first.filter("client_id is null")
    unknown = with_client.join(known, "client_id", "left_anti").select("client_id").distinct()
    if on_unknown_client == "null":
        marked = with_client.join(known.withColumn("_k", F.lit(True)), "client_id", "left")
        marked = marked.select(*[F.when(F.col("_k"), F.col("client_id")).alias("client_id")
                                 if c == "client_id" else F.col(c) for c in first.columns])
        first = marked.unionByName(without)
    inserted = first.select(*key, *LEAD_COLS)
    dups = cand.join(inserted.select(*key), key, "left_anti")
    if on_unknown_client == "fail":
        # the whole file is rejected when any stored row would break the FK
        broken = F.broadcast(unknown.agg(F.count(F.lit(1)).alias("_broken")))          # one row
        inserted = inserted.crossJoin(broken).filter("_broken = 0").drop("_broken")
    return ImportResult(inserted, rejected, {"duplicates": dups, "missing_status": missing_status,
                                             "unknown_clients": unknown})


SPEND_RAW = ["source", "amount", "date"]


def validate_spend(raw: DataFrame, as_of) -> tuple[DataFrame, DataFrame]:
    """Source required + S3, amount > 0 rounded to 2 dp, date S1 with
    default ``as_of``."""
    given = raw
    raw = _prepared(raw, SPEND_RAW, ["date"])
    src, e1 = required_string(_c(raw, "source"), "source", _trimmed(raw, "source"))
    amt, e2 = positive_number(_c(raw, "amount"), "amount", _trimmed(raw, "amount"))
    d, e3 = parse_date_or_default(_c(raw, "date"), as_of, parsed="_pd_date" if "date" in raw.columns else None,
                                  trimmed=_trimmed(raw, "date"))
    err = F.coalesce(e1, e2, e3)
    raw_cols = [c for c in SPEND_RAW if c in given.columns]
    return _split(raw, err, [*map(F.col, row_key(raw)), normalize_source(src).alias("source"),
                             F.round(amt, 2).alias("amount"), d.alias("date")], raw_cols)


def import_mixed(raw: DataFrame, existing_leads: DataFrame, clients: DataFrame, as_of,
                 on_unknown_client: str = "null") -> dict:
    """Both rule sets over one input, which is read once: the rows are checked
    and written with their class, and counted in that write.  ``counts`` has total,
    leads inserted, sales valid and invalid = total - leads - sales when > 0;
    ``errors`` the rejected rows of both kinds; ``report`` what is reported: the
    errors if there are any, else the counts; ``observed`` the counts by error
    and row class.  ``session.drop_cut(result["staged"])`` deletes the written
    rows once the parts are stored."""
    rows, seen = staged(check_mixed(raw, as_of), "import-mixed")
    key = row_key(rows)
    part = lambda kind: rows.filter(F.col(kind).isNotNull()).select(*key, f"{kind}.*")
    bad = lambda kind: rows.filter(F.col(f"{kind}_error").isNotNull()).select(*key, F.col(f"{kind}_error").alias("error"))
    leads = insert_leads(part("lead"), bad("leads"), existing_leads, clients, on_unknown_client)
    sales = ImportResult(part("sale"), bad("sales"), {"new_clients": new_clients_from_sales(part("sale"), clients)})
    total, n_sales = (F.lit(n).cast("long") for n in (seen["total"], seen["total"] - seen["sales_error"]))
    inserted = leads.valid.agg(F.count(F.lit(1)).alias("leads"))
    counts = inserted.select(total.alias("total"), "leads", n_sales.alias("sales"),
                             F.greatest(total - F.col("leads") - n_sales, F.lit(0).cast("long")).alias("invalid"))
    errors = (sales.rejected.select(F.lit("sales").alias("kind"), *key, "error")
              .union(leads.rejected.select(F.lit("leads").alias("kind"), *key, "error")))
    failed = seen["sales_error"] + seen["leads_error"] > 0
    return {"leads": leads, "sales": sales, "counts": counts, "errors": errors, "observed": seen,
            "report": errors if failed else counts, "staged": rows}


def import_log_row(spark: SparkSession, file_name: str, valid_rows: int, rejected_rows: int,
                   started: float, kind: str = "sales") -> DataFrame:
    """One ingest-log row; lead / spend imports are prefixed."""
    prefix = {"sales": "", "leads": "leads: ", "marketing_spend": "marketing_spend: "}[kind]
    return spark.createDataFrame(
        [(prefix + file_name, valid_rows + rejected_rows, valid_rows, rejected_rows,
          float(time.time() - started))],
        "file_name string, total_rows long, valid_rows long, rejected_rows long, duration_seconds double",
    ).select(F.current_timestamp().alias("imported_at"), "*")
