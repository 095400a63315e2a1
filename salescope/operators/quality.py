"""Data quality (Q1-Q5, A24, A25, I20).  Every check is a set-based job:
rule hits are exploded into a violations table, orphans are anti-joins,
uniqueness is a grouped count.  An empty result means "clean"."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from ..functions.text import (LEAD_STATUSES, client_field_error, CLIENT_ERRORS, is_known_source,
                              normalize_source, source_key)
from ..session import cut_lineage


def lead_consistency(leads: DataFrame) -> DataFrame:
    """Q1: (lead_id, rule) for every broken status rule."""
    s = F.lower(F.trim(F.coalesce(F.col("status"), F.lit(""))))
    has_md = F.col("meeting_date").isNotNull()
    has_c = F.col("client_id").isNotNull() & (F.col("client_id") != "")
    rules = [
        ("unknown_status", (s != "") & ~s.isin(LEAD_STATUSES)),
        ("meeting_without_meeting_date", (s == "meeting") & ~has_md),
        ("converted_without_client", (s == "converted") & ~has_c),
        ("new_with_meeting_date", (s == "new") & has_md),
        ("new_with_client", (s == "new") & has_c),
        ("contacted_with_client", (s == "contacted") & has_c),
    ]
    hits = F.filter(F.array(*[F.when(c, F.lit(n)) for n, c in rules]), lambda x: x.isNotNull())
    return leads.select(F.col("id").alias("lead_id"), F.explode(hits).alias("rule"))


def client_quality(clients: DataFrame) -> DataFrame:
    """Q2: (id, issue) with the first failing client rule; a placeholder CIF
    '-' is reported as 'placeholder' rather than as an invalid CIF."""
    placeholder = F.trim(F.col("cif")) == "-"
    err = client_field_error("name", F.when(placeholder, F.lit(None)).otherwise(F.col("cif")),
                             "email", "contact_person")
    name_bad = err == F.lit(CLIENT_ERRORS["name"])
    issue = F.when(name_bad, err).when(placeholder, F.lit("placeholder")).otherwise(err)
    return clients.select("id", issue.alias("issue")).filter(F.col("issue").isNotNull())


def unknown_sources(raw: DataFrame, col: str = "source") -> DataFrame:
    """Q3: spellings whose stripped key is not a known source (kept as is
    by S3), with their row counts."""
    c = F.col(col)
    bad = raw.filter(c.isNotNull() & (c != "") & ~is_known_source(c))
    return (bad.groupBy(source_key(c).alias("source_key"))
               .agg(F.count(F.lit(1)).alias("rows")))


def _orphans(child: DataFrame, fk: str, parent: DataFrame, pk: str, name: str) -> DataFrame:
    # one row per key before the join: a hot key costs a row per task
    c = child.filter(F.col(fk).isNotNull()).groupBy(F.col(fk).alias("_k")).agg(F.count(F.lit(1)).alias("_n"))
    p = parent.select(F.col(pk).alias("_k"))
    return c.join(p, "_k", "left_anti").agg(F.coalesce(F.sum("_n"), F.lit(0)).alias("orphans")) \
            .select(F.lit(name).alias("check"), "orphans")


def orphan_checks(sales: DataFrame, clients: DataFrame, leads: DataFrame, events: DataFrame) -> DataFrame:
    """Q4: orphan counts for every foreign key of the store."""
    parts = [
        _orphans(sales, "client_id", clients, "id", "sales.client_id"),
        _orphans(leads, "client_id", clients, "id", "leads.client_id"),
        _orphans(events, "client_id", clients, "id", "funnel_events.client_id"),
        _orphans(events, "lead_id", leads, "id", "funnel_events.lead_id"),
    ]
    return reduce(DataFrame.unionByName, parts)


def _dups(df: DataFrame, keys: list[str], name: str) -> DataFrame:
    d = df.select(*keys)
    for k in keys:
        d = d.filter(F.col(k).isNotNull())
    g = d.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > 1)
    return g.agg(F.count(F.lit(1)).alias("duplicate_keys"),
                 F.coalesce(F.sum("n"), F.lit(0)).alias("rows")) \
            .select(F.lit(name).alias("check"), "duplicate_keys", F.col("rows").cast("long"))


def uniqueness_checks(sales: DataFrame, clients: DataFrame, leads: DataFrame) -> DataFrame:
    """Q5: primary keys and UNIQUE(external_id, source); a NULL external id
    never collides."""
    return reduce(DataFrame.unionByName, [
        _dups(clients, ["id"], "clients.id"),
        _dups(sales, ["id"], "sales.id"),
        _dups(leads, ["id"], "leads.id"),
        _dups(leads, ["external_id", "source"], "leads.external_id_source"),
    ])


def name_id_pairs(sales: DataFrame) -> DataFrame:
    """(name_key, client_id) pairs with the smallest spelling and the number
    of sales rows: the one pre-aggregate every duplicate job starts from
    (map-side combined, so a hot name or client costs one row per task)."""
    return (sales.filter(F.col("client_id").isNotNull())
                 .groupBy(F.lower("client_name").alias("name_key"), "client_id")
                 .agg(F.min("client_name").alias("_n"), F.count(F.lit(1)).alias("n_rows")))


def duplicate_groups_from_pairs(pairs: DataFrame) -> DataFrame:
    g = pairs.groupBy("name_key").agg(F.min("_n").alias("name"), F.count("client_id").alias("id_count"))
    return g.filter(F.col("id_count") > 1)


def duplicate_client_names(sales: DataFrame) -> DataFrame:
    """Name groups (lower-case) that carry more than one client id:
    name_key, name (smallest spelling), id_count."""
    return duplicate_groups_from_pairs(name_id_pairs(sales))


def duplicate_members_from_pairs(pairs: DataFrame) -> DataFrame:
    groups = duplicate_groups_from_pairs(pairs).select("name_key")
    return pairs.join(groups, "name_key", "left_semi").select("name_key", "client_id", "n_rows")


def duplicate_client_members(sales: DataFrame) -> DataFrame:
    """A24 members: (name_key, client_id, n_rows) for every id of a duplicate
    group (one row per member instead of an unbounded id list per group)."""
    return duplicate_members_from_pairs(name_id_pairs(sales))


def duplicate_summary(groups: DataFrame, n_names: int = 5) -> DataFrame:
    """Σ(id_count - 1), number of groups, the first ``n_names`` names
    (id_count desc, name asc) and how many groups remain."""
    tot = groups.agg(F.coalesce(F.sum(F.col("id_count") - 1), F.lit(0)).cast("long").alias("total_duplicates"),
                     F.count(F.lit(1)).alias("groups"))
    top = (groups.orderBy(F.desc("id_count"), F.asc("name")).limit(n_names)
                 .agg(F.sort_array(F.collect_list(F.struct(-F.col("id_count"), F.col("name")))).alias("_t")))
    return tot.crossJoin(top).select(
        "total_duplicates", "groups",
        F.coalesce(F.array_join(F.transform("_t", lambda x: x["name"]), ", "), F.lit("")).alias("first_names"),
        F.greatest(F.col("groups") - n_names, F.lit(0)).alias("remaining"))


def table_profile(tables: dict[str, DataFrame]) -> DataFrame:
    """Per table its row count and column count (one aggregate each)."""
    parts = [df.agg(F.count(F.lit(1)).alias("rows"))
               .select(F.lit(name).alias("table"), "rows", F.lit(len(df.columns)).cast("long").alias("columns"))
             for name, df in tables.items()]
    return reduce(DataFrame.unionByName, parts)


def value_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """``table, column, value, num, n``: the distinct values of every column as text (null
    included), with their number where the column is numeric, and their rows.

    Each table is read once: a row becomes one (column, value) pair per column and
    the pairs are combined on the map side, so a value that fills a third of a
    column is one row per task.  Written once; ``session.drop_cut`` deletes it."""
    parts = []
    for name, df in tables.items():
        pairs = [F.struct(F.lit(c).alias("column"), F.col(f"`{c}`").cast("string").alias("value"),
                          (F.col(f"`{c}`").cast("double") if isinstance(t.dataType, NumericType) else F.lit(None).cast("double"))
                          .alias("num")) for c, t in zip(df.columns, df.schema.fields)]
        parts.append(df.select(F.lit(name).alias("table"), F.explode(F.array(*pairs)).alias("p")).select("table", "p.*"))
    pairs = reduce(DataFrame.unionByName, parts)
    return cut_lineage(pairs.groupBy("table", "column", "value", "num").agg(F.count(F.lit(1)).alias("n")), "value-counts")


def column_profile(counts: DataFrame) -> DataFrame:
    """Per column of ``value_counts`` its rows, nulls, distinct values, and least and
    greatest value (numbers as numbers, all else as text)."""
    order = F.struct("num", "value")
    return counts.groupBy("table", "column").agg(
        F.sum("n").alias("rows"), F.coalesce(F.sum(F.when(F.col("value").isNull(), F.col("n"))), F.lit(0)).alias("nulls"),
        F.count("value").alias("distinct_values"),
        F.min(F.when(F.col("value").isNotNull(), order)).value.alias("min_value"),
        F.max(F.when(F.col("value").isNotNull(), order)).value.alias("max_value"))


def foreign_key_profile(counts: DataFrame, edges: list[tuple[str, str, str, str]]) -> DataFrame:
    """Per edge (table, column, parent table, parent column) the rows, the rows
    without a value, and the values and rows that the parent lacks; all edges in
    one join of the distinct values."""
    keys = counts.sparkSession.createDataFrame(edges, "table string, column string, parent string, parent_column string")
    child = counts.select("table", "column", "value", "n").join(F.broadcast(keys), ["table", "column"])     # a row per edge
    known = counts.filter("value is not null").select(F.col("table").alias("parent"), F.col("column").alias("parent_column"),
                                                      "value", F.lit(1).alias("known"))
    matched = child.join(known, ["parent", "parent_column", "value"], "left")
    lost = F.col("value").isNotNull() & F.col("known").isNull()
    return matched.groupBy("table", "column", "parent", "parent_column").agg(
        F.sum("n").alias("rows"), F.coalesce(F.sum(F.when(F.col("value").isNull(), F.col("n"))), F.lit(0)).alias("without"),
        F.count_if(lost).alias("orphan_values"), F.coalesce(F.sum(F.when(lost, F.col("n"))), F.lit(0)).alias("orphan_rows"))


#: FK edges of the business tables
FOREIGN_KEYS = [("sales", "client_id", "clients", "id"), ("leads", "client_id", "clients", "id"),
                ("funnel_events", "client_id", "clients", "id"), ("funnel_events", "lead_id", "leads", "id")]


def latest_rows(tables: dict[str, tuple[DataFrame, list[str]]], n: int = 3) -> dict[str, DataFrame]:
    """The last ``n`` rows of each table by its order columns, a per-task top-n."""
    return {name: df.orderBy(*[F.desc(c) for c in order]).limit(n) for name, (df, order) in tables.items()}


def normalized_sources(raw: DataFrame, col: str = "source") -> DataFrame:
    """S3 applied to raw spellings (row_no, source, normalized)."""
    return raw.select("row_no", F.col(col).alias("source"), normalize_source(col).alias("normalized"))
