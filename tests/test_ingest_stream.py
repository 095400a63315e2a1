import os
import tempfile

from pyspark.sql import functions as F

from conftest import rows
from salescope.operators import ingest as I
from salescope.sources import delimited as DL
from salescope.sources import sinks as SK


def _write(d, name, text):
    p = os.path.join(d, name)
    with open(p, "w", encoding="utf-8") as f:
        f.write(text)
    return p


def test_normalise_header_rules(spark):
    cells = ["\ufeffNombre\xa0 Cliente ", None, "  Tipo   De  Producto", "\uff29\uff24"]
    got = spark.createDataFrame([(c,) for c in cells], "c string").select(DL.normalised_header(F.col("c")).alias("n"))
    assert [r.n for r in got.collect()] == ["nombre cliente", "", "tipo de producto", "id"]
    m = DL.map_headers(spark, ["Cliente", "Nombre", "ID Cliente", "Tipo", "Importe", "Fecha"], "sales")
    assert m == {"client_name": "Cliente", "client_id": "ID Cliente", "product_type": "Tipo",
                 "price": "Importe", "date": "Fecha"}
    assert DL.map_headers(spark, ["Plataforma", "Inversión"], "marketing_spend") == {"source": "Plataforma",
                                                                                "amount": "Inversión"}
    assert DL.missing_columns(spark, ["created_at"], "leads") == ["source"]


def test_read_classify_and_validate(spark):
    d = tempfile.mkdtemp(prefix="ingest-")
    _write(d, "ventas.csv", "﻿cliente;id cliente;tipo;precio;fecha\n"
                            "Acme;C1;Servicio;100,5;2024-05-01\n"
                            "Acme;C1;Servicio;12.5;05/03/2024\n"
                            " ;C2;Producto;3;\n"
                            "Beta;C2;Producto;-1;2024-05-01\n"
                            "Beta;C3;Producto;7;garbage\n")
    sep = DL.sniff_delimiter(spark, os.path.join(d, "ventas.csv"))
    assert sep == ";"
    raw = DL.to_logical(DL.read_delimited(spark, os.path.join(d, "ventas.csv")), "sales")
    valid, rejected = I.validate_sales(raw, "2024-05-15")
    v = rows(valid.orderBy("row_no"))
    assert [x["row_no"] for x in v] == [3] and v[0]["price"] == 12.5
    rj = {x["row_no"]: x["error"] for x in rows(rejected)}
    assert set(rj) == {2, 4, 5, 6}
    assert rj[2] == "El campo 'price' debe ser numérico, recibido: '100,5'"
    assert rj[4] == "El campo obligatorio 'client_name' está vacío"
    assert rj[5] == "El campo 'price' debe ser mayor que 0, recibido: -1.0"
    assert rj[6] == "Fecha con formato desconocido: garbage"
    assert valid.count() + rejected.count() == raw.count()

    _write(d, "leads.csv", "created_at,source,status,external_id\n2024-05-01,Meta Ads,new,E1\n")
    _write(d, "spend.csv", "platform,spend,month\nmeta,10,2024-05-01\n")
    _write(d, "mixed.csv", "client_name,client_id,product_type,price,date,source\nA,C1,P,1,2024-01-01,fb\n")
    _write(d, "junk.csv", "foo,bar\n1,2\n")
    c = {os.path.basename(x["file"]): x for x in rows(DL.classify_files(spark, d + "/*.csv"))}
    assert c["leads.csv"]["detected_type"] == "leads" and c["spend.csv"]["detected_type"] == "marketing_spend"
    assert c["mixed.csv"]["detected_type"] == "mixed" and c["junk.csv"]["detected_type"] == "invalid"
    assert c["junk.csv"]["missing_leads"] == ["created_at", "source"] and c["leads.csv"]["row_count"] == 1


def test_import_leads_dedup_and_idempotence(spark):
    raw = spark.createDataFrame([
        (2, "E1", "2024-05-01", "Facebook Lead Ads", "new", None, None),
        (3, "E1", "2024-05-02", "fb", "contacted", None, None),          # same id -> duplicate
        (4, None, "2024-05-03", "google", "new", None, "C9"),            # hashed id, unknown client
        (5, "E2", "2024-05-03", "google", None, None, None),             # no status
        (6, "E3", "bad", "google", "new", None, None),                   # rejected
        (7, "E4", "", "LinkedIn", "meeting", "2024-05-09", "C1"),        # default date
    ], "row_no long, external_id string, created_at string, source string, status string, "
       "meeting_date string, client_id string")
    store = spark.createDataFrame([], "id string, external_id string, created_at date, source string, "
                                      "status string, meeting_date date, client_id string")
    clients = spark.createDataFrame([("C1",)], "id string")
    r = I.import_leads(raw, store, clients, "2024-05-15", on_unknown_client="null")
    ins = {x["row_no"]: x for x in rows(r.valid)}
    assert set(ins) == {2, 4, 7}
    assert ins[4]["client_id"] is None and len(ins[4]["id"]) == 40
    assert str(ins[7]["created_at"]) == "2024-05-15"
    assert r.extra["duplicates"].count() == 1 and r.extra["missing_status"].count() == 1
    assert r.rejected.count() == 1
    # importing the same file again into the updated store inserts nothing
    store2 = store.unionByName(r.valid.select(*I.LEAD_COLS))
    again = I.import_leads(raw, store2, clients, "2024-05-15", on_unknown_client="null")
    assert again.valid.count() == 0
    failed = I.import_leads(raw, store, clients, "2024-05-15", on_unknown_client="fail")
    assert failed.valid.count() == 0 and [x["client_id"] for x in rows(failed.extra["unknown_clients"])] == ["C9"]


def test_new_clients_and_sinks(spark):
    raw = spark.createDataFrame([(2, "First", "N1", "P", "5", "2024-01-01"), (3, "Second", "N1", "P", "6", ""),
                                 (4, "Known", "C1", "P", "1", "")],
                                "row_no long, client_name string, client_id string, product_type string, "
                                "price string, date string")
    clients = spark.createDataFrame([("C1", "Known", "-", None, None, None)],
                                    "id string, name string, cif string, address string, contact_person string, "
                                    "email string")
    r = I.import_sales(raw, clients, "2024-05-15")
    nc = rows(r.extra["new_clients"])
    assert nc == [{"id": "N1", "name": "First", "cif": "-", "address": None, "contact_person": None, "email": None}]
    d = tempfile.mkdtemp(prefix="sink-")
    SK.write_rejects(r.rejected, d + "/rejects", "imp1")
    log = I.import_log_row(spark, "ventas.csv", r.valid.count(), r.rejected.count(), 0.0, kind="leads")
    SK.append_import_log(log, d + "/log")
    back = spark.read.parquet(d + "/log").first()
    assert back.file_name == "leads: ventas.csv" and back.total_rows == 3


def test_streaming_sales_import(spark):
    from salescope.streaming.file_import import start_sales_import
    d = tempfile.mkdtemp(prefix="stream-")
    os.makedirs(d + "/in")
    _write(d + "/in", "a.csv", "client_name,client_id,product_type,price,date\nA,C1,P,10,2024-01-01\nB,C2,P,x,\n")
    q = start_sales_import(spark, d + "/in", d + "/out", d + "/ckpt",
                           ["client_name", "client_id", "product_type", "price", "date"], "2024-05-15")
    q.awaitTermination(120)
    assert spark.read.parquet(d + "/out/sales").count() == 1
    assert spark.read.parquet(d + "/out/rejected").count() == 1
    _write(d + "/in", "b.csv", "client_name,client_id,product_type,price,date\nC,C3,P,5,2024-01-02\n")
    q = start_sales_import(spark, d + "/in", d + "/out", d + "/ckpt",
                           ["client_name", "client_id", "product_type", "price", "date"], "2024-05-15")
    q.awaitTermination(120)
    assert spark.read.parquet(d + "/out/sales").count() == 2     # the first file is not re-imported


def test_streaming_leads_import(spark):
    from salescope.streaming.file_import import start_leads_import
    d = tempfile.mkdtemp(prefix="stream-leads-")
    os.makedirs(d + "/in")
    _write(d + "/in", "l.csv", "created_at,source,status,external_id\n2024-05-01,fb,new,E1\n2024-05-02,fb,new,E1\n")
    clients = spark.createDataFrame([("C1",)], "id string")
    q = start_leads_import(spark, d + "/in", d + "/store", clients, d + "/ckpt",
                           ["created_at", "source", "status", "external_id"], "2024-05-15")
    q.awaitTermination(120)
    st = rows(spark.read.parquet(d + "/store"))
    assert len(st) == 1 and st[0]["source"] == "meta_ads"


def test_import_mixed_counts(spark):
    raw = spark.createDataFrame([
        (2, "A", "C1", "P", "10", "2024-01-01", "fb", "new", "E1", "2024-01-01"),
        (3, "B", "C2", "P", "x", "2024-01-01", "", "new", "E2", "2024-01-01"),
        (4, "", "C3", "P", "5", "2024-01-01", "google", "new", "E3", "bad"),
    ], "row_no long, client_name string, client_id string, product_type string, price string, date string, "
       "source string, status string, external_id string, created_at string")
    store = spark.createDataFrame([], "id string, external_id string, created_at date, source string, "
                                      "status string, meeting_date date, client_id string")
    clients = spark.createDataFrame([("C1",)], "id string")
    r = I.import_mixed(raw, store, clients, "2024-05-15")
    c = r["counts"].first()
    assert (c.total, c.leads, c.sales, c.invalid) == (3, 1, 1, 1)


def test_insert_leads_rules(spark, seed):
    from salescope.operators import maintain as MT
    new = spark.createDataFrame([
        ("L001", None, None, "meta_ads", "new", None, None),            # exists
        ("N1", None, None, "meta_ads", " Meeting ", "2024-05-20", None),
        ("N2", None, None, "meta_ads", "meh", None, None),
    ], "id string, external_id string, created_at date, source string, status string, meeting_date string, "
       "client_id string")
    r = MT.insert_leads(seed["leads"], new)
    assert [x["id"] for x in rows(r.applied)] == ["N1"] and r.table.count() == 6
    assert {x["id"] for x in rows(r.rejected)} == {"L001", "N2"}


def test_row_numbers_across_splits(spark):
    """A file read in many splits keeps exact line-based row numbers."""
    d = tempfile.mkdtemp(prefix="split-")
    n = 20000
    body = "client_name,client_id,product_type,price,date\n" + "".join(
        f"N{i},C{i % 7},P,{i + 1},2024-01-01\n" for i in range(n))
    p = _write(d, "big.csv", body)
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "16384")
    try:
        raw = DL.read_delimited(spark, p, sep=",")
        assert raw.rdd.getNumPartitions() > 5
        got = {r["client_name"]: r["row_no"] for r in raw.select("client_name", "row_no").collect()}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert len(got) == n and all(got[f"N{i}"] == i + 2 for i in range(n))


def test_folder_of_mixed_layouts(spark):
    """Each file keeps its own delimiter, column order and quoting."""
    d = tempfile.mkdtemp(prefix="mixed-")
    _write(d, "a.csv", "cliente,id cliente,producto,precio\nAna,C1,P,10\n")
    _write(d, "b.csv", "producto;precio;cliente;id cliente\nQ;20;Bob;C2\n")
    _write(d, "c.csv", 'cliente,id cliente,"producto",precio\n"Line\nbreak",C3,R,30\n')
    _write(d, "d.csv", "")
    _write(d, "e.csv", '"cliente, nombre",x\n1,2\n')
    c = {os.path.basename(r.file): r for r in DL.classify_files(spark, d + "/*.csv").collect()}
    assert {k: (r.detected_type, r.delimiter, r.quoted_breaks) for k, r in c.items()} == {
        "a.csv": ("sales", ",", False), "b.csv": ("sales", ";", False), "c.csv": ("sales", ",", True),
        "d.csv": ("invalid", ",", False), "e.csv": ("invalid", ",", False)}
    assert c["e.csv"].headers == ["cliente, nombre", "x"] and c["d.csv"].row_count == 0
    got = {(r.client_name, r.client_id, r.product_type, r.price, r.row_no) for r in DL.read_folder(spark, d + "/*.csv", "sales").collect()}
    assert got == {("Ana", "C1", "P", "10", 2), ("Bob", "C2", "Q", "20", 2), ("Line\nbreak", "C3", "R", "30", 2)}


def test_import_keeps_files_apart_and_appends_once(spark):
    """Equal row numbers of two files are different rows; ids repeat on a second import."""
    raw = spark.createDataFrame([("a.csv", 2, "A", "C1", "P", "1", "2024-01-01"), ("b.csv", 2, "B", "C1", "P", "2", "2024-01-01"),
                                 ("b.csv", 3, "\t", "C1", "P", "2", "2024-01-01")],
                                "_file string, row_no long, client_name string, client_id string, product_type string, price string, date string")
    clients = spark.createDataFrame([], "id string")
    store = spark.createDataFrame([], "id string, client_name string, client_id string, product_type string, price decimal(18,2), date date")
    r = I.import_sales(raw, clients, "2024-05-15", store)
    assert rows(r.extra["new_clients"])[0]["name"] == "A"
    assert r.extra["counts"].first()[:] == (3, 2, 1)
    d = tempfile.mkdtemp(prefix="append-")
    SK.append_import(r, d + "/sales", d + "/clients", d + "/rejects", "one")
    stored = spark.read.parquet(d + "/sales")
    assert stored.count() == 2 and spark.read.parquet(d + "/clients").count() == 1
    again = I.import_sales(raw, spark.read.parquet(d + "/clients"), "2024-05-15", stored)
    assert again.extra["append"].count() == 0 and again.extra["new_clients"].count() == 0


def test_two_lead_files_with_equal_rows(spark):
    raw = spark.createDataFrame([(f, n, f"E{n}", "2024-05-01", "fb", "new") for f in ("a", "b") for n in (2, 3)],
                                "_file string, row_no long, external_id string, created_at string, source string, status string")
    store = spark.createDataFrame([], "id string, external_id string, created_at date, source string, "
                                      "status string, meeting_date date, client_id string")
    r = I.import_leads(raw, store, spark.createDataFrame([("C1",)], "id string"), "2024-05-15")
    assert r.valid.count() == 2
    assert {(x["_file"], x["row_no"]) for x in rows(r.extra["duplicates"])} == {("b", 2), ("b", 3)}


def test_streaming_store_faults_are_not_an_empty_store(spark):
    from salescope.streaming.file_import import start_leads_import
    d = tempfile.mkdtemp(prefix="stream-fault-")
    os.makedirs(d + "/in")
    os.makedirs(d + "/store/batch_id=7")
    _write(d + "/store/batch_id=7", "part-0.parquet", "not parquet")
    _write(d + "/in", "l.csv", "created_at,source,status,external_id\n2024-05-01,fb,new,E1\n")
    q = start_leads_import(spark, d + "/in", d + "/store", spark.createDataFrame([("C1",)], "id string"), d + "/ckpt",
                           ["created_at", "source", "status", "external_id"], "2024-05-15")
    try:
        q.awaitTermination(120)
    except Exception:  # noqa: BLE001 - the query reports the fault
        pass
    assert q.exception() is not None


def test_appended_files_are_seen_by_the_next_read(spark):
    from salescope.sources.tables import read_table
    d = tempfile.mkdtemp(prefix="reads-")
    spark.range(3).write.parquet(d + "/t.parquet")
    assert read_table(spark, d, "t").count() == 3
    spark.range(5).write.mode("append").parquet(d + "/t.parquet")
    assert read_table(spark, d, "t").count() == 8
