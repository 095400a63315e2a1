"""Business tables (sales, clients, leads, marketing_spend, funnel_events and
raw ingestion inputs) derived from the driver's Parquet tables.

Each view reads only the columns it needs so the Parquet scan prunes the rest;
the joins are plain equi-joins and Catalyst / AQE choose the strategy from
runtime sizes (broadcast below ``autoBroadcastJoinThreshold``, sort-merge
above), so nothing here assumes a dimension table stays small.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Parquet table of the driver's data set.  Nothing is kept between calls:
    every read lists the files as they are now."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def _s(c) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("string")


def sales(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per sale: id, client_name, client_id, product_type,
    price DECIMAL(18,2), date DATE."""
    li = read_table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_extendedprice")
    o = read_table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    c = read_table(spark, sf_dir, "customer").select("c_custkey", "c_name")
    p = read_table(spark, sf_dir, "part").select("p_partkey", "p_type")
    # customer joins orders (4x fewer rows than lineitem) before the fact
    # table: when nothing fits a broadcast, the fact rows are shuffled for two
    # joins (order key, part key) instead of three
    oc = o.join(c, o.o_custkey == c.c_custkey)
    j = (li.join(oc, li.l_orderkey == oc.o_orderkey)
           .join(p, li.l_partkey == p.p_partkey))
    return j.select(
        F.concat(_s("l_orderkey"), F.lit("-"), _s("l_linenumber"), F.lit("-"),
                 _s("l_partkey"), F.lit("-"), _s("l_suppkey")).alias("id"),
        F.col("c_name").alias("client_name"),
        _s("o_custkey").alias("client_id"),
        F.col("p_type").alias("product_type"),
        F.col("l_extendedprice").cast("decimal(18,2)").alias("price"),
        F.col("o_orderdate").cast("date").alias("date"),
    )


def sales_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sales whose client names repeat across ids in mixed case (merge input);
    every eleventh client also sold under a neighbour's name in May, which
    chains the name groups."""
    s = sales(spark, sf_dir)
    cid = F.col("client_id").cast("int")
    other = F.when((cid % 11 == 0) & (F.month("date") == 5), 1).otherwise(0)
    base = F.concat(F.lit("Company "), ((cid + other) % 700).cast("string"))
    return s.select(
        "id",
        F.when(cid % 2 == 0, F.upper(base)).otherwise(base).alias("client_name"),
        "client_id", "product_type", "price", "date")


def spelt_clients(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``id, name``: every customer, names shared by several and spelt in five ways
    (as is, upper case, decomposed, with a full-width letter, without accents)."""
    c = read_table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"))
    spelling = F.element_at(F.array(*map(F.lit, [
        "Soci\u00e9t\u00e9 ", "SOCI\u00c9T\u00c9 ", "Socie\u0301te\u0301 ", "\uff33oci\u00e9t\u00e9 ", "Societe "])),
        (F.col("k") % 5 + 1).cast("int"))
    return c.select(_s("k").alias("id"), F.concat(spelling, (F.floor(F.col("k") * 7 / 2) % 700).cast("string")).alias("name"))


def clients(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Client master: 9 of 10 customers plus every supplier (clients without sales)."""
    c = read_table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_nationkey")
    k = F.col("c_custkey")
    cust = c.filter(k % 10 != 0).select(
        _s(k).alias("id"),
        F.col("c_name").alias("name"),
        F.when(k % 3 == 0, F.lit("-"))
         .otherwise(F.concat(F.lit("A"), F.lpad(_s(k), 8, "0"))).alias("cif"),
        F.when(k % 4 == 0, F.lit(None).cast("string"))
         .otherwise(F.concat(F.lit("Street "), _s("c_nationkey"))).alias("address"),
        F.when(k % 5 == 0, F.lit(None).cast("string"))
         .otherwise(F.concat(F.lit("Contact "), _s(k))).alias("contact_person"),
        F.when(k % 7 == 0, F.lit("bad-mail"))
         .otherwise(F.concat(F.lit("c"), _s(k), F.lit("@example.com"))).alias("email"),
    )
    s = read_table(spark, sf_dir, "supplier").select("s_suppkey", "s_name")
    sup = s.select(
        F.concat(F.lit("S"), _s("s_suppkey")).alias("id"),
        F.col("s_name").alias("name"),
        F.lit("-").alias("cif"),
        F.lit(None).cast("string").alias("address"),
        F.lit(None).cast("string").alias("contact_person"),
        F.lit(None).cast("string").alias("email"),
    )
    return cust.unionByName(sup)


def _events_k(spark: SparkSession, sf_dir: str, cols: list[str]) -> DataFrame:
    e = read_table(spark, sf_dir, "events").select(*cols)
    return e.withColumn("k", F.regexp_extract("props", "([0-9]+)", 1).cast("int"))


def leads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leads: id, external_id, created_at DATE, source, status,
    meeting_date DATE, client_id."""
    e = _events_k(spark, sf_dir, ["event_id", "ts", "user_id", "event_type", "props"])
    k = F.col("k")
    et = F.col("event_type")
    d = F.col("ts").cast("date")
    funnel = et.isin("signup", "purchase")
    return e.select(
        F.concat(F.lit("L"), _s("event_id")).alias("id"),
        _s("event_id").alias("external_id"),
        d.alias("created_at"),
        F.when(k % 5 == 0, "meta_ads").when(k % 5 == 1, "google_ads")
         .when(k % 5 == 2, "linkedin_ads").when(k % 5 == 3, "tiktok_ads")
         .otherwise("referral").alias("source"),
        F.when(et == "view", "new").when(et == "click", "contacted")
         .when(et == "signup", "meeting").when(et == "purchase", "converted")
         .otherwise("lost").alias("status"),
        F.when(funnel & (k % 3 != 0), F.date_add(d, k % 14)).alias("meeting_date"),
        F.when(funnel, _s("user_id")).alias("client_id"),
    )


def marketing_spend(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spend per (source, date): source, date DATE, amount DECIMAL(18,2)."""
    e = read_table(spark, sf_dir, "events").select("event_id", "ts", "event_type", "value")
    eid = F.col("event_id")
    s = e.filter(F.col("event_type") == "click").select(
        F.when(eid % 4 == 0, "meta_ads").when(eid % 4 == 1, "google_ads")
         .when(eid % 4 == 2, "linkedin_ads").otherwise("newsletter").alias("source"),
        F.col("ts").cast("date").alias("date"),
        F.col("value").cast("decimal(18,2)").alias("amount"))
    return (s.groupBy("source", "date")
             .agg(F.sum("amount").cast("decimal(18,2)").alias("amount")))


def funnel_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read_table(spark, sf_dir, "events").select(
        "event_id", "user_id", "event_type", "ts", "props")
    return e.select(
        _s("event_id").alias("id"),
        _s("user_id").alias("client_id"),
        F.concat(F.lit("L"), _s("event_id")).alias("lead_id"),
        "event_type",
        F.col("ts").cast("date").alias("event_date"),
        F.col("props").alias("metadata"),
    )


def _raw_sales_cols() -> list[Column]:
    eid = F.col("event_id")
    ts = F.col("ts")
    return [
        (eid + 2).alias("row_no"),
        F.when(eid % 29 == 0, F.lit("  "))
         .otherwise(F.concat(F.lit(" User "), _s("user_id"), F.lit(" "))).alias("client_name"),
        _s("user_id").alias("client_id"),
        F.col("event_type").alias("product_type"),
        F.when(eid % 17 == 0, F.lit("")).when(eid % 19 == 0, F.lit("abc"))
         .when(eid % 23 == 0, F.lit("-5"))
         .otherwise(F.col("value").cast("decimal(18,2)").cast("string")).alias("price"),
        F.when(eid % 13 == 0, F.lit("not a date"))
         .when(eid % 11 == 0, F.lit(None).cast("string"))
         .when(eid % 4 == 0, F.date_format(ts, "dd/MM/yyyy"))
         .when(eid % 4 == 1, F.date_format(ts, "yyyy/MM/dd"))
         .when(eid % 4 == 2, F.date_format(ts, "dd-MM-yyyy"))
         .otherwise(F.date_format(ts, "yyyy-MM-dd")).alias("date"),
    ]


def raw_sales(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dirty all-text sales rows as they arrive from a delimited file."""
    e = read_table(spark, sf_dir, "events").select("event_id", "ts", "user_id", "event_type", "value")
    return e.select(*_raw_sales_cols())


def raw_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read_table(spark, sf_dir, "events").select("event_id")
    eid = F.col("event_id") % 10
    spellings = ["Facebook Lead Ads", " IG ", "google_ads", "Google Search Ads", "LinkedIn",
                 "tiktok-ads", "CSV", "meta ads", "referral", "newsletter_ads"]
    expr = F.lit(spellings[-1])
    for i in range(len(spellings) - 2, -1, -1):
        expr = F.when(eid == i, F.lit(spellings[i])).otherwise(expr)
    return e.select(F.col("event_id").alias("row_no"), expr.alias("source"))


def raw_leads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All-text lead rows for the lead importer: every event becomes one lead
    row; one in five reuses the external id of an earlier event (in-file
    duplicates) and one in 31 has no status."""
    e = _events_k(spark, sf_dir, ["event_id", "ts", "user_id", "event_type", "props"])
    eid = F.col("event_id")
    k = F.col("k")
    ts = F.col("ts")
    ext = F.when(eid % 5 == 0, _s(eid - 1)).when(eid % 7 == 0, F.lit("")).otherwise(_s(eid))
    return e.select(
        (eid + 2).alias("row_no"),
        ext.alias("external_id"),
        F.when(eid % 37 == 0, F.lit("garbage"))
         .when(eid % 3 == 0, F.date_format(ts, "dd/MM/yyyy"))
         .otherwise(F.date_format(ts, "yyyy-MM-dd")).alias("created_at"),
        F.when(k % 4 == 0, F.lit("Facebook Lead Ads")).when(k % 4 == 1, F.lit(" google "))
         .when(k % 4 == 2, F.lit("LinkedIn")).otherwise(F.lit("referral")).alias("source"),
        F.when(eid % 31 == 0, F.lit(" ")).otherwise(F.col("event_type")).alias("status"),
        F.when(F.col("event_type") == "signup", F.date_format(F.date_add(ts.cast("date"), 3), "yyyy-MM-dd"))
         .alias("meeting_date"),
        F.when(F.col("event_type").isin("signup", "purchase"), _s("user_id")).alias("client_id"),
    )


def raw_spend(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All-text marketing spend rows (one per click event) for the spend
    importer: platform spellings, amounts with blanks / text / zero, dates in
    several layouts or blank."""
    e = read_table(spark, sf_dir, "events").select("event_id", "ts", "event_type", "value")
    e = e.filter(F.col("event_type") == "click")
    eid = F.col("event_id")
    ts = F.col("ts")
    spellings = ["Facebook Lead Ads", " IG ", "google_ads", "Google Search Ads", "LinkedIn",
                 "tiktok-ads", "CSV", "meta ads", "", "newsletter_ads"]
    m = eid % 10
    src = F.lit(spellings[-1])
    for i in range(len(spellings) - 2, -1, -1):
        src = F.when(m == i, F.lit(spellings[i])).otherwise(src)
    return e.select(
        (eid + 2).alias("row_no"),
        src.alias("source"),
        F.when(eid % 17 == 0, F.lit("")).when(eid % 19 == 0, F.lit("n/a")).when(eid % 23 == 0, F.lit("0"))
         .otherwise(F.format_string("%.3f", F.col("value"))).alias("amount"),
        F.when(eid % 13 == 0, F.lit("13/13/2024")).when(eid % 11 == 0, F.lit(""))
         .when(eid % 3 == 0, F.date_format(ts, "dd-MM-yyyy")).otherwise(F.date_format(ts, "yyyy-MM-dd")).alias("date"),
    )


def raw_mixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All-text rows of a file carrying both sales and lead columns (mixed
    import): the raw sales columns plus lead columns of the same event, in
    one projection of ``events``."""
    e = _events_k(spark, sf_dir, ["event_id", "ts", "user_id", "event_type", "value", "props"])
    eid = F.col("event_id")
    return e.select(
        *_raw_sales_cols(),
        F.when(eid % 3 == 0, F.lit("")).otherwise(F.concat(F.lit("M"), _s(eid))).alias("external_id"),
        F.when(eid % 7 == 0, F.lit("")).when(F.col("k") % 2 == 0, F.lit("meta")).otherwise(F.lit("Google Ads"))
         .alias("source"),
        F.when(eid % 5 == 0, F.lit(None).cast("string")).otherwise(F.lit("new")).alias("status"),
        F.when(eid % 9 == 0, F.lit("99/99/9999")).otherwise(F.date_format("ts", "yyyy-MM-dd")).alias("created_at"))


def quoted_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Physical lines of three delimited exports of the events with line breaks,
    delimiters and doubled quotes in quoted cells, quotes in unquoted ones and
    blank lines; splits end inside records.  ``_file, _block, _pos, value``."""
    e = read_table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "props")
    eid = F.col("event_id")
    file = F.concat(F.lit("export-"), (eid % 3).cast("string"), F.lit(".csv"))
    client = F.concat(F.lit('"User ""'), _s("user_id"), F.lit('"";'), F.col("event_type"), F.lit('"'))
    note = (F.when(eid % 4 == 0, F.col("event_type"))
            .when(eid % 4 == 1, F.lit('"first\nsecond;\n\n""fourth"" line"'))
            .when(eid % 4 == 2, F.lit('""'))
            .otherwise(F.concat(F.lit('"props:\n'), F.replace("props", F.lit('"'), F.lit('""')), F.lit('"'))))
    size = F.when(eid % 6 == 0, F.lit('5" pipe')).otherwise(_s("user_id"))
    record = F.concat_ws(";", _s(eid), client, note, size, F.when(eid % 10 == 0, F.lit("\n")))
    lines = e.select(file.alias("_file"), "event_id", F.posexplode(F.split(record, "\n")).alias("at", "value"))
    first = e.select(file.alias("_file")).distinct().select("_file", F.lit(-1).cast("long").alias("_pos"),
                                                            F.lit("id;client;note;size").alias("value"))
    rows = lines.select("_file", (F.col("event_id") * 16 + F.col("at")).alias("_pos"), "value").union(first)
    return rows.select("_file", F.floor((F.col("_pos") + 15) / 512).alias("_block"), "_pos", "value")


def header_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Header lines ``file, header`` of one file per event: six layouts in four
    delimiters, plain or quoted, with odd spaces, full-width letters or a
    byte-order mark."""
    eid = F.col("event_id")
    layouts = [["Cliente", " ID\u00a0 cliente", "Tipo de Producto", "PRECIO"], ["Platform", "Created_Time", "client_id"],
               ["Fuente", "Inversio\u0301n", "\uff26echa"],
               ["nombre", "identificador", "producto", "importe", "created_at", "channel"], ["nombre", "importe"], ["a", "b"]]
    sep = F.when(eid % 4 == 0, ",").when(eid % 4 == 1, ";").when(eid % 4 == 2, "\t").otherwise("|")
    cells = F.array()
    for i, layout in enumerate(layouts):
        of = F.array(*[F.lit(c) for c in layout])
        cells = of if i == 0 else F.when(eid % 6 == i, of).otherwise(cells)
    quoted = F.transform(cells, lambda c: F.when(eid % 5 == 0, F.concat(F.lit('"'), c, F.lit('"'))).otherwise(c))
    mark = F.when(eid % 7 == 0, F.lit("\ufeff")).otherwise(F.lit(""))
    return read_table(spark, sf_dir, "events").select(
        F.concat(F.lit("file-"), _s("event_id")).alias("file"),
        F.replace(F.concat(mark, F.array_join(quoted, "\x00")), F.lit("\x00"), sep).alias("header"))


TABLES = {
    "quoted_lines": quoted_lines,
    "raw_mixed": raw_mixed,
    "raw_spend": raw_spend,
    "sales": sales,
    "sales_dup": sales_dup,
    "clients": clients,
    "leads": leads,
    "marketing_spend": marketing_spend,
    "funnel_events": funnel_events,
    "raw_sales": raw_sales,
    "raw_sources": raw_sources,
    "raw_leads": raw_leads,
}


def load(spark: SparkSession, sf_dir: str, *names: str) -> list[DataFrame]:
    return [TABLES[n](spark, sf_dir) for n in names]
