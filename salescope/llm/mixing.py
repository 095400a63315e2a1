"""Mixing sources to target weights by Pfair scheduling.

Each source is cut into blocks of equally many rows.  In the fluid schedule every
source advances in proportion to its weight w until its blocks are used up; then
it leaves, and the others go on under re-normalised weights.  A block is released
in the slot in which the fluid schedule starts it and due at the end of the slot
in which the fluid schedule ends it: without exits, floor(k / w) and
ceil((k + 1) / w) for block k (from 0).  Earliest deadline first over the released
blocks then meets every window, so at every slot every source is less than one
block from its fluid share, over the whole schedule.

Windows come from integers, so they are exact however long the schedule is.  One
task streams the schedule, holds a row per source and writes a row per block; the
rows meet it in a join on (source, block).  Blocks grow with the corpus so that
there are at most ``SLOTS`` of them, which bounds that task at any size.

A source's surplus over its own weight (of all rows) is held back: the mixture
(``in_mix``) holds all other rows.  Blocks held back follow after the mixture, in
proportion to what their sources have left.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from fractions import Fraction
from itertools import islice

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .inputs import pick, share

#: least rows of a block, and most blocks of a schedule
BLOCK_ROWS, SLOTS = 16, 1 << 22
#: sources whose part counts are broadcast; more of them meet the rows in a shuffle
BROADCAST_SOURCES = 100_000
#: weights are integers up to this one
_UNIT = 1 << 40


def source_weights(sizes: dict[str, int], exponent: float) -> dict[str, float]:
    """Target weights: shares of the sources raised to ``exponent`` (1: as they
    are, 0: all alike)."""
    return {s: n ** exponent for s, n in sizes.items()}


def whole_weights(weights: dict[str, float]) -> dict[str, int]:
    """The weights in units of the largest over 2^40, one unit at least."""
    top = Fraction(max(weights.values(), default=1))
    return {s: max(1, round(Fraction(w) / top * _UNIT)) for s, w in weights.items()}


def quotas(sizes: dict[str, int], weights: dict[str, int], block_rows: int) -> dict[str, tuple[int, int]]:
    """(blocks in the mixture, all blocks) by source."""
    rows, total = sum(sizes.values()), sum(weights[s] for s in sizes)
    out = {}
    for s, n in sizes.items():
        blocks = -(-n // block_rows)
        out[s] = (min(blocks, -(-weights[s] * rows // (total * block_rows))), blocks)
    return out


def phases(weights: list[int], blocks: list[int]) -> list[tuple[Fraction, int, int]]:
    """The fluid schedule between exits: (blocks per unit of weight at the end, blocks
    of the sources that have left, weight of the others)."""
    out, gone, rate = [], 0, sum(weights)
    leaves = sorted((Fraction(b, w), b, w) for w, b in zip(weights, blocks))
    for k, (end, b, w) in enumerate(leaves):
        if not out or out[-1][0] != end:
            out.append((end, gone, rate))
        gone, rate = gone + b, rate - w
    return out


def windows(weight: int, blocks: int, fluid: list[tuple[Fraction, int, int]]) -> Iterator[tuple[int, int, int]]:
    """(release, deadline, block) of a source's blocks, in order."""
    at = 0
    for k in range(blocks):
        end, gone, rate = fluid[at]
        release = gone + rate * k // weight
        while (k + 1) * end.denominator > end.numerator * weight:
            at += 1
            end, gone, rate = fluid[at]
        yield release, gone - (-rate * (k + 1) // weight), k


def schedule(weights: list[int], blocks: list[int]) -> Iterator[tuple[int, int, int, int, int]]:
    """(source number, block, release, deadline, slot) in slot order: earliest deadline
    first among the released blocks, ties by source number."""
    some = [s for s, b in enumerate(blocks) if b]
    fluid = phases([weights[s] for s in some], [blocks[s] for s in some])
    of = {s: windows(weights[s], blocks[s], fluid) for s in some}
    waiting = [(*next(of[s]), s) for s in some]
    heapq.heapify(waiting)
    ready = []
    for slot in range(sum(blocks)):
        while waiting and waiting[0][0] <= slot:
            release, deadline, k, s = waiting[0]
            heapq.heappush(ready, (deadline, s, k, release))
            following = next(of[s], None)
            if following is None:
                heapq.heappop(waiting)
            else:
                heapq.heapreplace(waiting, (*following, s))
        deadline, s, k, release = heapq.heappop(ready)
        yield s, k, release, deadline, slot


def _scheduled(spark, names: list[str], parts: list[tuple[list[int], list[int], list[int], bool]]) -> DataFrame:
    """A row for every block.  ``parts`` follow each other: (weights, blocks, number of the
    first block by source, whether it is the mixture)."""
    shared = share(spark, (names, parts))

    def run(batches):
        names, parts = shared()
        for _ in (row for batch in batches for row in range(batch.num_rows)):
            start = 0
            for weights, blocks, skip, in_mix in parts:
                rows = schedule(weights, blocks)
                while some := list(islice(rows, 1 << 16)):
                    s, k, release, deadline, slot = zip(*some)
                    yield pa.record_batch([
                        pa.array([names[x] for x in s], pa.string()), pa.array([skip[x] + y for x, y in zip(s, k)], pa.int64()),
                        *[pa.array([start + y for y in x], pa.int64()) for x in (release, deadline, slot)],
                        pa.array([in_mix] * len(s))], names=["source", "block", "release", "deadline", "slot", "in_mix"])
                start += sum(blocks)

    return spark.range(0, 1, 1, 1).mapInArrow(
        run, "source string, block long, release long, deadline long, slot long, in_mix boolean")


def pfair_mix(docs: DataFrame, weights: dict[str, float] | None = None, id_col: str = "doc_id",
              source_col: str = "source", block_rows: int | None = None, exponent: float = 0.9,
              rows_per_part: int = 2000) -> DataFrame:
    """One row per input row: ``doc_id, source, block, block_row, release,
    deadline, slot, in_mix``.

    ``block`` numbers a source's blocks from 0; ``release``, ``deadline`` and
    ``slot`` count slots from the start.  ``in_mix`` marks the rows up to the
    source's weight (in whole blocks); the mixture has a block in every slot
    from 0 on, and blocks held back follow it.  ``weights`` maps sources to positive
    numbers (taken to 2^-40 of the largest); by default they follow from the row
    counts.  Sources without a weight are an error, weights of absent sources are
    ignored.  A block has ``block_rows`` rows, by default 16 or as many as make
    ``SLOTS`` blocks of all rows.  A null source
    is the source ''.  Rows of a source are ordered by id hash, id (nulls
    first), so copies and runs of ids are spread; equal rows are
    interchangeable.  An empty table gives an empty result.  The driver holds a
    row for every source, however many there are.

    A source may hold any share of the rows: rows are numbered in parts of about
    ``rows_per_part`` rows that are shifted by the counts of the parts before.
    """
    spark = docs.sparkSession
    rows = pick(docs, doc_id=id_col, source=source_col).select(
        "doc_id", F.coalesce(F.col("source").cast("string"), F.lit("")).alias("source"))
    sizes = {r["source"]: r["count"] for r in rows.groupBy("source").count().collect()}
    if weights is None:
        weights = source_weights(sizes, exponent)
    if missing := sorted(set(sizes) - set(weights)):
        raise ValueError(f"no weight for sources {missing[:5]}")
    block_rows = block_rows or max(BLOCK_ROWS, math.ceil(sum(sizes.values()) / SLOTS))
    names, units = sorted(sizes), whole_weights({s: weights[s] for s in sizes})
    quota = quotas(sizes, units, block_rows)
    kept, left = [quota[s][0] for s in names], [quota[s][1] - quota[s][0] for s in names]
    slots = _scheduled(spark, names, [([units[s] for s in names], kept, [0] * len(names), True), (left, left, kept, False)])

    of = spark.createDataFrame([(s, -(-sizes[s] // rows_per_part)) for s in names], "source string, parts long")
    of = F.broadcast(of) if len(names) <= BROADCAST_SOURCES else of
    rows = rows.join(of, "source").withColumn("h", F.xxhash64("doc_id")).withColumn(
        "part", F.floor(F.shiftrightunsigned("h", 33) * F.col("parts") / F.lit(1 << 31)).cast("long")).drop("parts")
    before = Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = rows.groupBy("source", "part").agg(F.count(F.lit(1)).alias("n")).select(
        "source", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    in_part = Window.partitionBy("source", "part").orderBy("h", "doc_id")
    numbered = rows.withColumn("i", F.row_number().over(in_part).cast("long") - 1).join(offsets, ["source", "part"])
    number = F.col("i") + F.col("offset")
    numbered = numbered.select("doc_id", "source", F.floor(number / block_rows).alias("block"),
                               (number % block_rows).cast("int").alias("block_row"))
    return numbered.join(slots.hint("merge"), ["source", "block"]).select(
        "doc_id", "source", "block", "block_row", "release", "deadline", "slot", "in_mix")
