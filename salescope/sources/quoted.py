"""Delimited files whose quoted cells hold line breaks, read by many tasks.

Spark splits text files at line ends, but not CSV files with quoted line breaks
(``multiLine`` gives a whole file to one task).  Whether a line begins inside a
quoted cell depends on all lines before it.  That state is found by a parallel
prefix scan:

1. Every line is a function from the state before it (outside or inside a quoted
   cell) to the state behind it.  There are four such functions: keep, flip, and
   the two constants.
2. Each split composes the functions of its lines; a split so becomes one small
   row with its own function, its lines and the records that begin in it, for
   either state at its start.
3. A running composition over the splits of a file gives the true state at the
   start of each, and a running sum the number of its first record.
4. Lines that are a record of their own stay where they are.  Only the lines of
   broken records, which may lie in two or more splits, are grouped by record.
   Records are parsed by Spark's own CSV rules (``from_csv``).

The windows over lines are those of a split, whose size is bounded by
``spark.sql.files.maxPartitionBytes``; those over splits have one row per split.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import cut_lineage

#: a broken record of more characters is reported, not assembled: an opening
#: quote without end makes the rest of its file one record
MAX_RECORD = 16_000_000

_PLAIN, _IN, _CLOSED = 0, 1, 2      # outside, inside, just behind a closing quote


def _state_behind(line: Column, sep: Column, inside: bool) -> Column:
    """Whether the line ends inside a quoted cell, if it began outside or
    ``inside``.  One step per quote: it opens a cell only where one begins,
    doubled inside it stands for itself, elsewhere it is an ordinary character."""
    pieces = F.split(line, '"', -1)
    before = F.slice(pieces, 1, F.size(pieces) - 1)             # the text in front of each quote
    numbered = F.transform(before, lambda text, i: F.struct(text.alias("text"), i.alias("i")))
    plain, within, closed = (F.lit(x) for x in (_PLAIN, _IN, _CLOSED))

    def at_quote(state: Column, piece: Column) -> Column:
        begins = (piece.i == 0) & (piece.text == "") & (state == plain)
        doubled = (state == closed) & (piece.text == "")
        opens = begins | doubled | F.endswith(piece.text, sep)
        return F.when(state == within, closed).when(opens, within).otherwise(plain)

    last = F.aggregate(numbered, within if inside else plain, at_quote)
    return F.when(F.contains(line, F.lit('"')), last == within).otherwise(F.lit(inside))


def _running(flips: Column, fixed: Column, window) -> tuple[Column, Column]:
    """Running composition over a window: (state if the start was outside, if it
    was inside).  The last constant decides, then every flip behind it."""
    flipped = F.coalesce(F.sum(flips.cast("int")).over(window), F.lit(0)) % 2 == 1
    constant = F.last(fixed, ignorenulls=True).over(window)     # (value, flips up to it)
    since = (F.coalesce(F.sum(flips.cast("int")).over(window), F.lit(0)) - constant.flips) % 2 == 1
    known = constant.isNotNull()
    return (F.when(known, constant.value != since).otherwise(flipped),
            F.when(known, constant.value != since).otherwise(~flipped))


def _composed(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """``rows`` (with ``if_out``, ``if_in``: the state behind each) with
    ``before_out, before_in``: the state before each, by that at the group's start."""
    upto = Window.partitionBy(*keys).orderBy(order)
    earlier = upto.rowsBetween(Window.unboundedPreceding, -1)
    flips = F.col("if_out") & ~F.col("if_in")
    rows = rows.withColumn("_flips", F.sum(flips.cast("int")).over(upto.rowsBetween(Window.unboundedPreceding, 0)))
    fixed = F.when(F.col("if_out") == F.col("if_in"),
                   F.struct(F.col("if_out").alias("value"), F.col("_flips").alias("flips")))
    out, within = _running(flips, fixed, earlier)
    return rows.withColumns({"before_out": out, "before_in": within}).drop("_flips")


def line_states(lines: DataFrame, sep: str | Column) -> DataFrame:
    """``_file, _block, _pos, value`` lines (``_block`` ascending over the splits of a
    file, ``_pos`` over the lines of a split) with ``record``: the number of the
    record that the line belongs to, from 1, and ``part``: null for a line that is
    a record of its own, else its place in the file, (split, line).

    Blank lines outside quoted cells belong to no record and are left out.  A
    byte-order mark before the first line is dropped.  The lines are written once
    under the shared checkpoint folder; ``session.drop_cut`` of the result deletes
    them when nothing reads it any more.
    """
    sep = F.lit(sep) if isinstance(sep, str) else sep
    text = F.ltrim(F.coalesce("value", F.lit("")), F.lit("﻿"))
    rows = lines.select("_file", "_block", "_pos", text.alias("value")).withColumns(
        {"if_out": _state_behind(F.col("value"), sep, False), "if_in": _state_behind(F.col("value"), sep, True)})
    split = ["_file", "_block"]
    rows = _composed(rows, split, "_pos")
    blank = F.trim("value") == ""
    upto = Window.partitionBy(*split).orderBy("_pos").rowsBetween(Window.unboundedPreceding, 0)
    begins = {s: (~F.col(f"before_{s}") & ~blank).cast("long") for s in ("out", "in")}
    rows = rows.withColumns({f"begun_{s}": F.sum(b).over(upto) for s, b in begins.items()})
    # written once: the files are scanned and their lines shuffled a single time
    written = rows = cut_lineage(rows, "csv-lines")

    def behind(s: str) -> Column:
        return F.when(F.col(f"before_{s}"), F.col("if_in")).otherwise(F.col("if_out"))

    # one row per split: its own function and the records that begin in it
    last = F.struct("_pos", behind("out").alias("o"), behind("in").alias("i"))
    splits = rows.groupBy(*split).agg(F.max(last).alias("last"), F.max("begun_out").alias("n_out"),
                                      F.max("begun_in").alias("n_in"))
    splits = _composed(splits.select(*split, F.col("last.o").alias("if_out"), F.col("last.i").alias("if_in"),
                                     "n_out", "n_in"), ["_file"], "_block")
    started = F.when(F.col("inside"), F.col("n_in")).otherwise(F.col("n_out"))
    before = Window.partitionBy("_file").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    starts = splits.select(*split, F.col("before_out").alias("inside"), "n_out", "n_in").select(
        *split, "inside", F.coalesce(F.sum(started).over(before), F.lit(0)).alias("records_before"))

    found = rows.join(starts, split).withColumn(
        "within", F.when(F.col("inside"), F.col("before_in")).otherwise(F.col("before_out")))
    begun = F.when(F.col("inside"), F.col("begun_in")).otherwise(F.col("begun_out"))
    alone = ~F.col("within") & ~F.col("if_out")
    out = found.filter(~(blank & ~F.col("within"))).select(
        "_file", "_block", "_pos", "value", (F.col("records_before") + begun).alias("record"),
        F.when(~alone, F.struct("_block", "_pos")).alias("part"))
    out._cut_path = written._cut_path
    return out


def assemble_records(lines: DataFrame, sep: str | Column, max_record: int = MAX_RECORD) -> tuple[DataFrame, DataFrame]:
    """(records ``_file, record, value``, too long ones ``_file, record, lines,
    characters``) of the lines ``_file, _block, _pos, value``.

    Line breaks inside a cell become ``\\n``.  Only the lines of broken records
    are shuffled by record; those of a record beyond ``max_record`` characters
    are counted, never gathered.  ``drop_cut`` of the records deletes the lines
    that both results read.
    """
    states = line_states(lines, sep)
    whole = states.filter("part is null").select("_file", "record", "value")
    pieces = states.filter("part is not null")
    sizes = pieces.groupBy("_file", "record").agg(
        F.count(F.lit(1)).alias("lines"), (F.sum(F.length("value")) + F.count(F.lit(1)) - 1).alias("characters"))
    fitting = sizes.filter(F.col("characters") <= max_record)
    joined = (pieces.join(fitting.select("_file", "record"), ["_file", "record"], "left_semi")
              .groupBy("_file", "record").agg(F.array_sort(F.collect_list(F.struct("part", "value"))).alias("p"))
              .select("_file", "record", F.array_join(F.transform("p", lambda x: x.value), "\n").alias("value")))
    records = whole.union(joined)
    records._cut_path = states._cut_path
    return records, sizes.filter(F.col("characters") > max_record)


def parse_records(records: DataFrame, columns: list[str], sep: str) -> DataFrame:
    """``_file, row_no`` and the cells of the records behind the header (record 1),
    as text under the given names; missing cells are null, surplus ones dropped."""
    schema = ", ".join(f"c{i} string" for i in range(len(columns)))
    cells = F.from_csv("value", schema, {"sep": sep, "quote": '"', "escape": '"', "mode": "PERMISSIVE"})
    data = records.filter("record > 1").select("_file", F.col("record").alias("row_no"), cells.alias("cells"))
    return data.select("_file", "row_no", *[F.col(f"cells.c{i}").alias(c) for i, c in enumerate(columns)])


def text_lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """The lines of text files with their file, split and place in the split."""
    lines = spark.read.text(path)
    return lines.select(F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_block"),
                        F.monotonically_increasing_id().alias("_pos"), "value")


def read_quoted(spark: SparkSession, path: str | list[str], columns: list[str], sep: str) -> DataFrame:
    """I1 for files of one layout with quoted line breaks: all-string rows with
    ``_file`` and ``row_no`` (records count, the header being 1), by as many tasks
    as the files have splits.  Records beyond ``MAX_RECORD`` are left out; they
    are listed by ``unassembled``."""
    records, _ = assemble_records(text_lines(spark, path), sep)
    rows = parse_records(records, columns, sep)
    rows._cut_path = records._cut_path
    return rows


def unassembled(spark: SparkSession, path: str | list[str], sep: str, max_record: int = MAX_RECORD) -> DataFrame:
    """``_file, record, lines, characters`` of the records that ``read_quoted`` leaves out."""
    return assemble_records(text_lines(spark, path), sep, max_record)[1]
