"""Exact deduplication by skew-safe combining.

Two texts are equal when they are identical after deleting white space
(``[\\x20\\x09-\\x0D]``).  The groups are combined in three steps, each of which
compares the full normalised content and not only its digest:

1. *local*: the map side of the first aggregation merges equal texts that one
   task has read;
2. *salted*: the same aggregation merges what different tasks found, per
   (digest, content, salt).  The salt follows from the row id, so a text that
   makes up a third of the corpus is spread over ``salts`` reducers;
3. *global*: the salt winners of one content are combined; a group has at most
   ``salts`` rows here, whatever its size.

The row that stays has the most code points in its original text, then the
smallest id.  Its order key is one struct, so every step is a plain ``min``.

The decisions return to the rows by digest.  The winners (ids, digests, counts)
are written once under the shared checkpoint folder; a digest that stands for
several contents keeps them beside it, and only then are texts joined again.
The row side of the join carries ids and digests and is a plain equi-join, so
adaptive execution splits a hot digest.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage
from .inputs import pick

#: white space that normalisation deletes
_SPACE = " \t\n\x0b\x0c\r"


def normalised(text: Column) -> Column:
    """The text without white space; null counts as empty."""
    return F.translate(F.coalesce(text, F.lit("")), _SPACE, "")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                salts: int = 32, digest=lambda c: F.sha2(c.cast("binary"), 256)) -> DataFrame:
    """One row per input row: ``doc_id, keep_id, group_size, kept, text_sha256``.

    Empty and null texts are equal to each other and to texts of white space
    only.  Rows that repeat an id and text count in ``group_size`` as often as
    they occur; they are all ``kept`` if their id is the one that stays (ids
    decide, the rows are indistinguishable).  A null id loses against every
    other id of the same length.  An empty table gives an empty result.

    ``digest`` is a parameter so that tests can force collisions; results never
    depend on the digest being free of them.
    """
    rows = pick(docs, doc_id=id_col, text=text_col).select(
        "doc_id", normalised(F.col("text")).alias("norm"),
        F.length(F.coalesce("text", F.lit(""))).alias("points"))
    rows = rows.withColumn("digest", digest(F.col("norm")))
    # smallest first: most code points, real ids before null, smallest id
    order = F.struct((-F.col("points")).alias("p"), F.col("doc_id").isNull().alias("no_id"),
                     F.col("doc_id").alias("id"))
    salted = (rows.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(salts)))
              .groupBy("digest", "norm", "salt")
              .agg(F.min(order).alias("best"), F.count(F.lit(1)).alias("n")))
    # dealt by digest alone, so that all contents behind one digest meet in one
    # task (at most ``salts`` rows per content) and can be counted there
    groups = (salted.repartition("digest").groupBy("digest", "norm")
              .agg(F.min("best").alias("best"), F.sum("n").alias("group_size")))
    variants = F.count(F.lit(1)).over(Window.partitionBy("digest"))
    winners = cut_lineage(
        groups.withColumn("variants", variants)
        .select("digest", F.col("best.id").alias("keep_id"), "group_size",
                F.when(F.col("variants") > 1, F.col("norm")).alias("content")), "dedup-winners")
    # texts travel a last time only if some digest stands for several contents
    collided = winners.filter("content is not null")
    out = rows.select("doc_id", "digest").join(winners.filter("content is null"), "digest")
    if not collided.isEmpty():
        r, c = rows.alias("r"), collided.alias("c")
        same = (F.col("r.digest") == F.col("c.digest")) & (F.col("r.norm") == F.col("c.content"))
        out = out.unionByName(r.join(c, same).select("r.doc_id", "r.digest", "keep_id", "group_size", "content"))
    return out.select("doc_id", "keep_id", "group_size",
                      F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"),
                      F.col("digest").alias("text_sha256"))
