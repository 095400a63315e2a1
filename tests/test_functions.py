import datetime as dt

from pyspark.sql import functions as F

from salescope.functions import buckets as B
from salescope.functions import dates as DT
from salescope.functions import metrics as M
from salescope.functions import text as T


def one(spark, *cols):
    return spark.range(1).select(*cols).first()


def test_bucket_keys_iso_week_edges(spark):
    d = F.lit("2021-01-03").cast("date")
    r = one(spark, B.bucket_key(d, "week").alias("k"), B.bucket_label(d, "week").alias("l"),
            B.bucket_start(d, "week").alias("s"))
    assert r.k == "2020-W53" and r.l == "Sem 53" and r.s == dt.date(2020, 12, 28)
    d2 = F.lit("2024-12-30").cast("date")
    assert one(spark, B.bucket_key(d2, "week").alias("k")).k == "2025-W01"


def test_bucket_keys_and_labels(spark):
    d = F.lit("2024-03-05").cast("date")
    r = one(spark, *[B.bucket_key(d, g).alias(g) for g in B.GROUPINGS])
    assert (r.day, r.month, r.quarter, r.year) == ("2024-03-05", "2024-03", "2024-Q1", "2024")
    r = one(spark, *[B.bucket_label(d, g).alias(g) for g in B.GROUPINGS])
    assert (r.day, r.week, r.month, r.quarter, r.year) == ("05/03", "Sem 10", "Mar 24", "Q1 24", "2024")


def test_bucket_interval_end_is_next_start_minus_1us(spark):
    s, e = B.bucket_interval(F.lit("2024-02-01").cast("date"), "month")
    r = one(spark, s.alias("s"), e.alias("e"))
    assert r.e == dt.datetime(2024, 2, 29, 23, 59, 59, 999999)
    s, e = B.bucket_interval(F.lit("2024-10-01").cast("date"), "quarter")
    assert one(spark, e.alias("e")).e == dt.datetime(2024, 12, 31, 23, 59, 59, 999999)


def test_is_partial_literal_midnight_end(spark):
    s, e = B.bucket_interval(F.lit("2024-05-31").cast("date"), "day")
    r = one(spark, B.is_partial(s, e, "2024-05-01", "2024-05-31").alias("p"),
            B.is_partial(s, e).alias("none"))
    assert r.p is True and r.none is False


def test_valid_bucket_key(spark):
    cases = [("2024-02-29", "day", True), ("2023-02-29", "day", False), ("2020-W53", "week", True),
             ("2021-W53", "week", False), ("2024-Q5", "quarter", False), ("2024-13", "month", False),
             ("2024", "year", True), ("24", "year", False)]
    for k, g, ok in cases:
        assert one(spark, B.valid_bucket_key(F.lit(k), g).alias("v")).v is ok, (k, g)


def test_parse_import_date_formats(spark):
    cases = {"2024-03-05": dt.date(2024, 3, 5), "5/3/2024": dt.date(2024, 3, 5), "2024/03/05": dt.date(2024, 3, 5),
             "05-03-2024": dt.date(2024, 3, 5), "05/03/24": dt.date(2024, 3, 5), "05/03/69": dt.date(1969, 3, 5),
             "05/03/68": dt.date(2068, 3, 5), "2024-03-05 10:11:12": dt.date(2024, 3, 5),
             "05/03/2024 10:11:12": dt.date(2024, 3, 5), " 2024-03-05 ": dt.date(2024, 3, 5),
             "2024-02-30": None, "not a date": None}
    for s, want in cases.items():
        assert one(spark, DT.parse_import_date(F.lit(s)).alias("d")).d == want, s


def test_parse_date_default_and_excel_serial(spark):
    v, e = DT.parse_date_or_default(F.lit("  "), "2024-05-15")
    r = one(spark, v.alias("v"), e.alias("e"))
    assert r.v == dt.date(2024, 5, 15) and r.e is None
    v, e = DT.parse_date_or_default(F.lit("xx"), "2024-05-15")
    assert one(spark, e.alias("e")).e == "Fecha con formato desconocido: xx"
    assert one(spark, DT.parse_import_date(F.lit(45000), numeric=True).alias("d")).d == dt.date(2023, 3, 15)


def test_normalize_iso(spark):
    for s, want in {"2024-13-45": "2024-13-45", "5/3/2024": "2024-03-05", "2024.03.05": "2024-03-05",
                    "": None, "junk": None}.items():
        assert one(spark, DT.normalize_iso(F.lit(s)).alias("d")).d == want, s


def test_normalize_source_expected_values(spark):
    spell = ["Facebook Lead Ads", " IG ", "google_ads", "Google Search Ads", "LinkedIn", "tiktok-ads", "CSV",
             "meta ads", "referral", "newsletter_ads", "Instagram Lead Form", "unknown_platform"]
    want = ["meta_ads", "meta_ads", "google_ads", "google search", "linkedin_ads", "tiktok_ads", "manual_import",
            "meta_ads", "referral", "newsletter", "meta_ads", "unknown_platform"]
    got = [one(spark, T.normalize_source(F.lit(s)).alias("n")).n for s in spell]
    assert got == want


def test_cif_truth_table(spark):
    ok = ["A12345678", "B-12345678", "ESB12345678", ""]
    bad = ["AB", "TOOLONGCIF12345", "A1234@678"]
    for c in ok + bad:
        err = one(spark, T.client_field_error(F.lit("Acme"), F.lit(c), F.lit(None), F.lit(None)).alias("e")).e
        assert (err is None) == (c in ok), c


def test_client_rules_order_and_email(spark):
    e = one(spark, T.client_field_error(F.lit("A"), F.lit("x"), F.lit("bad"), F.lit("x")).alias("e")).e
    assert e == T.CLIENT_ERRORS["name"]
    e = one(spark, T.client_field_error(F.lit("Acme"), F.lit(""), F.lit("bad"), F.lit("x")).alias("e")).e
    assert e == T.CLIENT_ERRORS["email"]
    e = one(spark, T.client_field_error(F.lit("Acme"), F.lit(""), F.lit("a@b.com"), F.lit("x")).alias("e")).e
    assert e == T.CLIENT_ERRORS["contact"]


def test_positive_number_rules(spark):
    for s, bad in {"12.5": False, " 3 ": False, "0": True, "-5": True, "": True, "abc": True, "nan": True,
                   "inf": True, "1_000": True, "12d": True, "1e3": False}.items():
        v, e = T.positive_number(F.lit(s), "price")
        assert (one(spark, e.alias("e")).e is not None) == bad, s


def test_lead_id_sha1(spark):
    import hashlib
    want = hashlib.sha1(b"C001_2024-05-01_meta_ads").hexdigest()
    got = one(spark, T.lead_id(F.lit(None).cast("string"), F.lit("C001"), F.lit("2024-05-01").cast("date"),
                               F.lit("meta_ads")).alias("i")).i
    assert got == want
    assert one(spark, T.lead_id(F.lit("X9"), F.lit(None), F.lit(None), F.lit(None)).alias("i")).i == "X9"


def test_formatting_and_masking(spark):
    r = one(spark, T.format_eur(F.lit(1234567.891)).alias("a"), T.format_eur(F.lit(1234), 0).alias("b"),
            T.format_eur_signed(F.lit(-1234.5)).alias("c"), T.format_eur_signed(F.lit(0)).alias("d"),
            T.format_eur(F.lit(None).cast("double")).alias("e"))
    assert (r.a, r.b, r.c, r.d, r.e) == ("€ 1.234.567,89", "€ 1.234", "-1.234,50", "+0,00", "€ 0,00")
    r = one(spark, T.mask_sensitive(F.lit("secret")).alias("a"), T.mask_sensitive(F.lit("-")).alias("b"),
            T.mask_sensitive(F.lit("")).alias("c"))
    assert (r.a, r.b, r.c) == ("••••••••", "-", "")


def test_ratios_and_pct_change(spark):
    r = one(spark, M.safe_ratio(F.lit(5), F.lit(0)).alias("a"), M.safe_pct_change(F.lit(0), F.lit(5)).alias("b"),
            M.safe_pct_change(F.lit(0), F.lit(0)).alias("c"), M.safe_pct_change(F.lit(200), F.lit(50)).alias("d"))
    assert (r.a, r.b, r.c, r.d) == (0.0, 100.0, 0.0, -75.0)


def test_products_text_and_labels(spark):
    r = one(spark, T.products_text(F.array(F.lit("A"), F.lit("B"), F.lit("C"))).alias("a"),
            T.products_text(F.array().cast("array<string>")).alias("b"),
            T.source_label(F.lit("META_ADS")).alias("c"), T.source_label(F.lit(None).cast("string")).alias("d"),
            T.source_label(F.lit("referral"), table="marketing").alias("e"))
    assert (r.a, r.b, r.c, r.d, r.e) == ("A, B, +1", "-", "Meta Ads", "—", "Referral")


def test_shift_years_leap_day(spark):
    assert one(spark, DT.shift_years(F.lit("2024-02-29").cast("date"), -1).alias("d")).d == dt.date(2023, 2, 28)
