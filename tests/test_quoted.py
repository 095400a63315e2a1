"""Delimited files with quoted line breaks, read in splits."""

import csv
import random

import pytest
from pyspark.sql import functions as F

from salescope.session import drop_cut
from salescope.sources import delimited as DL
from salescope.sources import quoted as Q


@pytest.fixture()
def small_splits(spark):
    old = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4k")
    spark.conf.set("spark.sql.files.openCostInBytes", "1k")
    yield
    for k, v in old.items():
        spark.conf.set(k, v)


def _cell(rng, sep):
    kind = rng.random()
    if kind < 0.3:
        return rng.choice(["abc", "x y", '5" pipe', "12", "é", 'a""b'])
    if kind < 0.5:
        return '"' + rng.choice([f"a{sep}b", 'q ""in"" q', '""', "x,y"]) + '"'
    lines = [rng.choice(["line", "", 'a "" b', f'""{sep}""', sep, f" {sep} "]) for _ in range(rng.choice([1, 2, 3, 9, 40]))]
    return '"x' + "\n".join(lines) + '"'


def _files(folder, sep, seed):
    rng = random.Random(seed)
    for f in range(3):
        with open(folder / f"f{f}.csv", "w") as out:
            out.write(("﻿" if f == 1 else "") + sep.join(["id", "a", "b"]) + "\n")
            for i in range(400):
                out.write(f"{f}-{i}{sep}" + sep.join(_cell(rng, sep) for _ in range(2)) + "\n")
                if rng.random() < 0.05:
                    out.write("\n")


@pytest.mark.parametrize("sep", [",", ";"])
def test_equals_csv_reader_over_many_splits(spark, tmp_path, small_splits, sep):
    _files(tmp_path, sep, 4)
    assert spark.read.text(str(tmp_path)).rdd.getNumPartitions() > 8
    rows = Q.read_quoted(spark, str(tmp_path), ["id", "a", "b"], sep)
    got = sorted((r._file.rsplit("/", 1)[1], r.row_no, r.id, r.a, r.b) for r in rows.collect())
    want = []
    for f in range(3):
        with open(tmp_path / f"f{f}.csv", newline="", encoding="utf-8-sig") as lines:
            records = [r for r in csv.reader(lines, delimiter=sep) if r]
        want += [(f"f{f}.csv", n, *(x or None for x in r)) for n, r in enumerate(records[1:], 2)]
    assert got == sorted(want, key=str) or got == sorted(want)
    drop_cut(rows)


def test_equals_multi_line_and_folder(spark, tmp_path, small_splits):
    for f in range(2):
        with open(tmp_path / f"s{f}.csv", "w") as out:
            out.write("Cliente;ID Cliente;Producto;Precio\n")
            for i in range(300):
                out.write(f'"A ""{i}"";\n\nB";C{i};P;{i}.5\n')
    whole = (spark.read.option("header", True).option("multiLine", True).option("sep", ";").option("escape", '"')
             .csv(str(tmp_path)))
    got = DL.read_folder(spark, str(tmp_path), "sales")
    assert (sorted((r.client_name, r.client_id, r.price) for r in got.collect())
            == sorted((r.Cliente, r["ID Cliente"], r.Precio) for r in whole.collect()))
    assert sorted(r.row_no for r in got.collect()) == sorted([*range(2, 302)] * 2)


def test_quote_without_end_is_reported(spark, tmp_path, small_splits):
    (tmp_path / "a.csv").write_text("id,a\n1,x\n2,\"open\n" + "3,y\n" * 3000)
    (tmp_path / "b.csv").write_text("id,a\n1,\"p\nq\"\n")
    records, too_long = Q.assemble_records(Q.text_lines(spark, str(tmp_path)), ",", max_record=500)
    assert [(r.record, r.lines) for r in too_long.collect()] == [(3, 3001)]
    assert sorted(tuple(r)[1:] for r in Q.parse_records(records, ["id", "a"], ",").collect()) == [(2, "1", "p\nq"), (2, "1", "x")]


def test_no_lines_and_blank_lines(spark):
    schema = "_file string, _block long, _pos long, value string"
    none = Q.assemble_records(spark.createDataFrame([], schema), ",")
    assert [x.count() for x in none] == [0, 0]
    rows = [("f", 0, 0, ""), ("f", 0, 1, "h"), ("f", 0, 2, None), ("f", 7, 0, '"a'), ("f", 9, 0, ""), ("f", 11, 5, 'b"'), ("f", 11, 6, "  ")]
    records, _ = Q.assemble_records(spark.createDataFrame(rows, schema), ",")
    assert sorted((r.record, r.value) for r in records.collect()) == [(1, "h"), (2, '"a\n\nb"')]


def test_one_scan_and_no_gathering(spark, tmp_path):
    (tmp_path / "a.csv").write_text("id,a\n1,\"p\nq\"\n")
    plan = Q.read_quoted(spark, str(tmp_path), ["id", "a"], ",")._jdf.queryExecution().executedPlan().toString()
    assert "FileScan text" not in plan          # the lines were written once, by splits


def test_column_names():
    assert DL.column_names(["a", "", "B", "b", None]) == ["a", "_c1", "B2", "b3", "_c4"]
