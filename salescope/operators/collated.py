"""Client names compared by collation instead of folded copies.

The columns below carry a Spark collation, so grouping, joining and ordering
compare names by its rules without ``lower()`` and without tables of characters:

* ``UTF8_LCASE``: upper and lower case of any script fall together;
* ``UNICODE_CI``: case, composed and decomposed letters and full-width forms
  fall together, accents stay apart; names sort as in a directory;
* ``UNICODE_AI``: accents fall together, case stays apart.

These go beyond the reference's rule, which folds ASCII letters only (``É`` and
``é`` are two names there).  ``quality`` and ``clients`` keep that rule; these
operators are for stores whose names come from several systems.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

NAMES = "UNICODE_CI"


def _by(column: str, collation: str) -> Column:
    return F.collate(F.trim(column), collation)


def same_names(clients: DataFrame, collation: str = NAMES) -> DataFrame:
    """A row per name that several clients share: ``name`` (least spelling by bytes),
    ``n_clients``, ``n_spellings``, ``first_id``.  Spellings are counted per name and
    spelling first, so a frequent name is a few rows at its task."""
    spellings = clients.filter(F.trim("name") != "").groupBy(
        _by("name", collation).alias("_k"), F.trim("name").alias("_s")).agg(
        F.count(F.lit(1)).alias("_n"), F.min("id").alias("_id"))
    # Every row of a group has another spelling: the count of rows is the count of spellings
    return spellings.groupBy("_k").agg(
        F.min("_s").alias("name"), F.sum("_n").alias("n_clients"), F.count(F.lit(1)).alias("n_spellings"),
        F.min("_id").alias("first_id")).filter("n_clients > 1").drop("_k")


def name_flags(clients: DataFrame, collation: str = NAMES) -> DataFrame:
    """``id, name, same_name_as``: the least id among the clients of the same name, for
    every client.  Names without text are their own."""
    first = clients.filter(F.trim("name") != "").groupBy(_by("name", collation).alias("_k")).agg(F.min("id").alias("_first"))
    c = clients.select("id", "name", _by("name", collation).alias("_n"))
    return c.join(first, F.col("_n") == F.col("_k"), "left").select(
        "id", "name", F.coalesce("_first", "id").alias("same_name_as"))


def resolve_names(rows: DataFrame, clients: DataFrame, name: str = "client_name", collation: str = NAMES) -> DataFrame:
    """``rows`` with ``resolved_id``, the least client id whose name is the row's; null
    without one.  A name is one row on the clients' side, so no row is multiplied."""
    known = clients.filter(F.trim("name") != "").groupBy(_by("name", collation).alias("_k")).agg(
        F.min("id").alias("resolved_id"))
    keyed = rows.withColumn("_n", _by(name, collation))
    return keyed.join(known, F.col("_n") == F.col("_k"), "left").drop("_n", "_k")


def in_directory_order(clients: DataFrame, collation: str = NAMES) -> list[Column]:
    """Ordering of a listing by name: by the collation, ties by bytes, then id."""
    return [_by("name", collation), F.col("name"), F.col("id")]
