"""Period bundles and analysis snapshots.

A snapshot is a one-row nested DataFrame built only from small aggregates
(products, calendar buckets, top-5 clients, metric rows), so ``collect_list``
here never gathers fact rows.  It can be written as nested JSON / Parquet
(``sources.sinks.write_snapshot``) or collected by a caller for display.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.buckets import (GROUPINGS, KEY_PATTERNS, bucket_interval, bucket_key, bucket_start, normalize_grouping,
                                 valid_bucket_key)
from ..operators import compare as C
from ..operators import evolution as EV
from ..operators.filters import Filters, filter_sales


@dataclass
class PeriodData:
    filters: Filters
    grouping: str
    table: DataFrame
    metrics: DataFrame
    evolution: DataFrame
    products: DataFrame
    top_clients: DataFrame
    daily: DataFrame


def period_base(sales: DataFrame, f: Filters | None) -> DataFrame:
    """One pass over the period's sales: a pre-aggregate per (client id,
    client name, product, day) with row count, amount and min / max price.  All five period aggregates are exact roll-ups of
    it, so the fact table (and the joins behind a view) is read once."""
    s = filter_sales(sales, f)
    return s.groupBy("client_id", "client_name", "product_type", "date").agg(
        F.count(F.lit(1)).alias("n"), F.sum("price").alias("amt"),
        F.min("price").alias("mn"), F.max("price").alias("mx"))


def _summary_from_base(b: DataFrame) -> DataFrame:
    g = b.groupBy("product_type").agg(F.sum("n").alias("quantity"), F.sum("amt").alias("_t"),
                                      F.min("mn").alias("_mn"), F.max("mx").alias("_mx"))
    t = F.col("_t").cast("double")
    return g.select("product_type", F.col("quantity").cast("long").alias("quantity"), t.alias("total_sales"),
                    (t / F.col("quantity")).alias("avg_price"), F.col("_mn").cast("double").alias("min_price"),
                    F.col("_mx").cast("double").alias("max_price"))


def _metrics_from_base(b: DataFrame) -> DataFrame:
    from ..functions.metrics import safe_ratio
    pc = (b.groupBy(F.coalesce("client_id", "client_name").alias("_ck"))
           .agg(F.sum("amt").alias("_amt"), F.sum("n").alias("_n")))
    g = pc.agg(F.sum("_amt").alias("_t"), F.sum("_n").alias("_n"), F.count("_ck").alias("unique_clients"))
    t = F.coalesce(F.col("_t").cast("double"), F.lit(0.0))
    n = F.coalesce(F.col("_n"), F.lit(0)).cast("long")
    return g.select(t.alias("total_sales"), n.alias("transactions"), safe_ratio(t, n).alias("avg_ticket"),
                    n.alias("total_quantity"), F.col("unique_clients").cast("long").alias("unique_clients"))


def _evolution_from_base(b: DataFrame, g: str) -> DataFrame:
    from ..functions.buckets import bucket_key, bucket_label, bucket_start
    agg = b.groupBy(bucket_start("date", g).alias("_start")).agg(F.sum("amt").cast("double").alias("total"))
    return agg.select(bucket_key("_start", g).alias("key"), bucket_label("_start", g).alias("label"), "total")


def _products_from_base(b: DataFrame) -> DataFrame:
    from ..functions.metrics import safe_pct
    per = b.groupBy(F.col("product_type").alias("label")).agg(F.sum("amt").alias("_v"))
    tot = per.agg(F.sum("_v").alias("_tot"))
    out = per.crossJoin(F.broadcast(tot)).select(
        "label", F.col("_v").cast("double").alias("value"), safe_pct(F.col("_v"), F.col("_tot")).alias("percentage"))
    idx = F.row_number().over(Window.orderBy(F.desc("value"), F.asc("label"))) - 1
    return out.withColumn("color_index", idx.cast("long"))


def _top_from_base(b: DataFrame, n: int = 5) -> DataFrame:
    from ..functions.metrics import safe_pct
    per = (b.filter(F.col("client_id").isNotNull()).groupBy("client_id")
            .agg(F.max_by("client_name", F.struct("date", "client_name")).alias("name"),
                 F.sum("n").alias("transactions"), F.sum("amt").alias("_amt"), F.max("date").alias("last_date")))
    tot = b.agg(F.sum("amt").alias("_tot"))
    ranked = per.crossJoin(F.broadcast(tot)).select(
        "client_id", "name", F.col("_amt").cast("double").alias("total_amount"),
        F.col("transactions").cast("long").alias("transactions"),
        safe_pct(F.col("_amt"), F.col("_tot")).alias("percentage_of_total"), "last_date")
    order = [F.desc("total_amount"), F.desc("transactions"), F.desc("last_date"), F.asc("client_id")]
    top = ranked.orderBy(*order).limit(n)
    return top.withColumn("rank", F.row_number().over(Window.orderBy(*order)).cast("long")).drop("last_date")


def _daily_from_base(b: DataFrame) -> DataFrame:
    return b.groupBy("date").agg(F.sum("n").alias("n"), F.sum("amt").alias("amt"))


def period_data(sales: DataFrame, f: Filters, grouping: str = "day", materialize: bool = False) -> PeriodData:
    """The five aggregates of one period and its daily series, all rolled up from one
    pre-aggregate of the period's sales (``period_base``).  With
    ``materialize`` the pre-aggregate is written once under the shared
    checkpoint folder (``session.cut_lineage``) and read by all of them."""
    g = normalize_grouping(grouping)
    b = period_base(sales, f)
    if materialize:
        from ..session import cut_lineage
        b = cut_lineage(b, "period-base")
    return PeriodData(f, g, _summary_from_base(b), _metrics_from_base(b), _evolution_from_base(b, g),
                      _products_from_base(b), _top_from_base(b), _daily_from_base(b))


def _nest(df: DataFrame, name: str, order: list[str]) -> DataFrame:
    """Collect a *small* aggregate into one array column, ordered."""
    cols = df.columns
    st = F.struct(*[F.col(c) for c in order], F.struct(*[F.col(c) for c in cols]).alias("_v"))
    return df.agg(F.transform(F.array_sort(F.collect_list(st)), lambda x: x["_v"]).alias(name))


def _period_struct(p: PeriodData) -> DataFrame:
    m = p.metrics.select(F.struct(*p.metrics.columns).alias("metrics"))
    t = _nest(p.table.withColumn("_o", -F.col("total_sales")), "table", ["_o", "product_type"]) \
        .select(F.transform("table", lambda x: x.dropFields("_o")).alias("table"))
    e = _nest(p.evolution, "evolution", ["key"])
    d = _nest(p.products, "product_distribution", ["color_index"])
    tc = _nest(p.top_clients, "top_clients", ["rank"])
    one = F.broadcast                                  # every side is one row
    return (m.crossJoin(one(t)).crossJoin(one(e)).crossJoin(one(d)).crossJoin(one(tc))
             .select(F.struct(F.lit(p.filters.date_start).alias("date_start"),
                              F.lit(p.filters.date_end).alias("date_end"),
                              F.lit(p.filters.client_name).alias("client_name"),
                              F.lit(p.filters.product_type).alias("product_type")).alias("filters"),
                     F.lit(p.grouping).alias("grouping"), "metrics", "table", "evolution",
                     "product_distribution", "top_clients"))


def normal_snapshot(sales: DataFrame, f: Filters, grouping: str = "day", materialize: bool = False) -> DataFrame:
    """C4: one-row snapshot (mode 'normal', period A only)."""
    a = _period_struct(period_data(sales, f, grouping, materialize))
    return a.select(F.lit("normal").alias("mode"), F.struct(*a.columns).alias("period_a"))


def compare_snapshot(sales: DataFrame, fa: Filters, fb: Filters, grouping: str = "month",
                     materialize: bool = True) -> DataFrame:
    """A, B, metric changes (C1), evolution points (T5) and product
    comparison (C2).  Empty when either period has no sales.

    With ``materialize`` the sales of both periods are read (and joined, where
    they are a view) once and written under the shared checkpoint folder; all
    parts are derived from that table."""
    g = normalize_grouping(grouping)
    if materialize:
        from ..session import cut_lineage
        either = filter_sales(sales, fa).unionByName(filter_sales(sales, fb).filter(~fa.predicate()))
        sales = cut_lineage(either.select("client_id", "client_name", "product_type", "price", "date"), "compare-base")
    a = _period_struct(period_data(sales, fa, g))
    b = _period_struct(period_data(sales, fb, g))
    cm = _nest(C.compare_metrics(sales, fa, fb), "metrics", ["metric"])
    pts = _nest(EV.evolution_points(sales, fa, fb, g), "points", ["key"])
    cp = _nest(C.compare_products(sales, fa, fb), "products", ["product_type"])
    snap = (a.select(F.struct(*a.columns).alias("period_a"))
             .crossJoin(F.broadcast(b.select(F.struct(*b.columns).alias("period_b"))))
             .crossJoin(F.broadcast(cm)).crossJoin(F.broadcast(pts)).crossJoin(F.broadcast(cp))
             .select(F.lit("compare").alias("mode"), "period_a", "period_b",
                     F.struct("metrics", F.struct("points").alias("evolution"), "products").alias("comparison")))
    has = (F.col("period_a.metrics.transactions") > 0) & (F.col("period_b.metrics.transactions") > 0)
    return snap.filter(has)


def validate_points(points: DataFrame, grouping: str) -> DataFrame:
    """C6 on evolution points (T5 rows): (key, violation) for each broken
    rule; empty = valid.  Rules: key format (S13), start < end, difference =
    B - A within 1e-9, keys strictly increasing, intervals not overlapping (one
    may start where the one before ends).  Order is that of the column ``pos``
    (array position) where there is one, else of the start.  The lag window
    runs over the already-aggregated points only."""
    w = Window.orderBy("pos" if "pos" in points.columns else "start")
    p = points.select("*", F.lag("key").over(w).alias("_pk"), F.lag("end").over(w).alias("_pe"))
    rules = [
        ("bad_key_format", ~valid_bucket_key("key", grouping)),
        ("start_not_before_end", ~(F.col("start") < F.col("end"))),
        ("difference_mismatch", F.abs(F.col("difference") - (F.col("value_b") - F.col("value_a"))) > 1e-9),
        ("keys_not_increasing", F.col("_pk").isNotNull() & (F.col("key") <= F.col("_pk"))),
        ("overlapping_intervals", F.col("_pe").isNotNull() & (F.col("start") < F.col("_pe"))),
    ]
    hits = F.filter(F.array(*[F.when(c, F.lit(n)) for n, c in rules]), lambda x: x.isNotNull())
    return p.select("key", F.explode(hits).alias("violation"))


def _valid_key(key, grouping) -> Column:
    """S13 with the grouping in a column; an unknown grouping has no valid key."""
    out = F.lit(False)
    for g in GROUPINGS:
        out = F.when(grouping == g, valid_bucket_key(key, g)).otherwise(out)
    return out


def point_violations(points: Column, grouping: Column) -> Column:
    """C6 on an array of evolution points, in its order: (key, violation) of every
    broken rule of every point.  Each point meets the one before it inside the
    array, so any number of snapshots is checked without a window or a shuffle."""
    def rules(p: Column, before: Column) -> Column:
        checks = [
            ("bad_key_format", ~_valid_key(p.key, grouping)),
            ("start_not_before_end", ~(p.start < p.end)),
            ("difference_mismatch", F.abs(p.difference - (p.value_b - p.value_a)) > 1e-9),
            ("keys_not_increasing", before.isNotNull() & (p.key <= before.key)),
            ("overlapping_intervals", before.isNotNull() & (p.start < before.end)),
        ]
        hits = F.filter(F.array(*[F.when(c, F.lit(n)) for n, c in checks]), lambda x: x.isNotNull())
        return F.transform(hits, lambda v: F.struct(p.key.alias("key"), v.alias("violation")))

    # the points and the same points one place later, point by point
    shifted = F.slice(F.concat(F.array(F.get(points, F.lit(-1))), points), F.lit(1), F.size(points))
    return F.flatten(F.zip_with(points, shifted, rules))


def validate_snapshot(snapshot: DataFrame, grouping: str | None = None, by: list[str] = ()) -> DataFrame:
    """C6 on snapshot rows: ``by`` (columns that name a snapshot), ``key`` (null for a
    rule of the whole snapshot), ``violation``.

    Snapshot rules: periods present by mode, comparison and points present,
    both periods with one grouping.  Point rules: ``point_violations``, with the
    grouping of the snapshot's period A unless ``grouping`` is given.  All rows
    are checked in one projection.
    """
    s = snapshot
    checks = [("missing_period_a", F.col("period_a").isNull())]
    if "period_b" in s.columns:
        checks += [("missing_period_b", F.col("period_b").isNull()),
                   ("no_points", F.size("comparison.evolution.points") == 0),
                   ("grouping_mismatch", F.col("period_a.grouping") != F.col("period_b.grouping"))]
    if "mode" in s.columns:
        normal = F.col("mode") == "normal"
        parts = [c for c in ("period_b", "comparison") if c in s.columns]
        checks = [(n, c if n == "missing_period_a" else ~normal & c) for n, c in checks]
        checks += [(f"{c}_in_normal_mode", normal & F.col(c).isNotNull()) for c in parts]
        checks += [("missing_comparison", ~normal & (F.col("comparison").isNull() if "comparison" in parts else F.lit(True))),
                   ("unknown_mode", ~F.col("mode").isin("normal", "compare"))]
    none = F.lit(None).cast("string")
    hits = F.filter(F.array(*[F.when(c, F.struct(none.alias("key"), F.lit(n).alias("violation"))) for n, c in checks]),
                    lambda x: x.isNotNull())
    if "period_b" in s.columns:
        of = F.lit(grouping) if grouping is not None else F.col("period_a.grouping")
        points = point_violations(F.col("comparison.evolution.points"), of)
        hits = F.concat(hits, F.coalesce(points, F.slice(hits, 1, 0)))
    return s.select(*by, F.explode(hits).alias("v")).select(*by, "v.*")


def product_snapshots(sales: DataFrame, fa: Filters, fb: Filters, groupings=GROUPINGS) -> DataFrame:
    """C5 in short form for every product and grouping at once: ``product_type,
    grouping, mode, period_a, period_b`` (grouping, transactions, total) and
    ``comparison.evolution.points`` (T5 points in order), for products with sales
    in either period.  The facts are reduced to a row per product and day in one
    read; an array holds at most the buckets of both periods."""
    pa, pb = fa.predicate(), fb.predicate()
    marked = sales.filter(pa | pb).select("product_type", "date", "price", pa.alias("_a"), pb.alias("_b"))
    daily = marked.groupBy("product_type", "date").agg(
        F.sum(F.when(F.col("_a"), F.col("price"))).alias("a"), F.sum(F.when(F.col("_b"), F.col("price"))).alias("b"),
        F.count_if(F.col("_a")).alias("na"), F.count_if(F.col("_b")).alias("nb"))
    per_grouping = [F.struct(F.lit(g).alias("grouping"), bucket_start("date", g).alias("start"),
                             bucket_key(bucket_start("date", g), g).alias("key"),
                             F.struct(*[x.alias(n) for x, n in zip(bucket_interval(bucket_start("date", g), g), ("s", "e"))]).alias("i"))
                    for g in groupings]
    buckets = daily.withColumn("g", F.explode(F.array(*per_grouping))).groupBy(
        "product_type", "g.grouping", "g.key", F.col("g.i.s").alias("start"), F.col("g.i.e").alias("end")).agg(
        *[F.sum(c).alias(c) for c in ("a", "b", "na", "nb")])
    va, vb = (F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in ("a", "b"))
    point = F.struct("start", "key", "end", va.alias("value_a"), vb.alias("value_b"), (vb - va).alias("difference"))
    g = buckets.groupBy("product_type", "grouping").agg(
        F.array_sort(F.collect_list(point)).alias("points"), *[F.sum(c).alias(c) for c in ("a", "b", "na", "nb")])

    def period(n: str, t: str) -> Column:
        return F.struct("grouping", F.col(n).alias("transactions"), F.coalesce(F.col(t).cast("double"), F.lit(0.0)).alias("total_sales"))

    return g.select("product_type", "grouping", F.lit("compare").alias("mode"), period("na", "a").alias("period_a"),
                    period("nb", "b").alias("period_b"), F.struct(F.struct("points").alias("evolution")).alias("comparison"))


__all__ = ["PeriodData", "period_data", "normal_snapshot", "compare_snapshot",
           "validate_points", "point_violations", "validate_snapshot", "product_snapshots", "KEY_PATTERNS"]
