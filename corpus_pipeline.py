"""Corpus pipeline: from ``documents`` to training shards.

Every stage takes (spark, docs, sf_dir) and works on all rows that the stage
before it kept.  All but the last return the columns of ``documents``.

1. language ID        rows without an identified language go
2. near duplicates    one document of each group of linked texts stays
                      (five-word n-grams, Jaccard similarity of 0.8 or more)
3. decontamination    documents that hold a test item go
4. mixing             rows beyond the sources' target weights are held back
5. sharding           jump hashing into shards, rows numbered inside them

Rows with a null id take part, but only stages that decide by text (1, 3) can
remove them.  Repeated rows count as one document from stage 2 on.  Columns
beyond those of ``documents`` pass through.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from salescope.llm import decontaminate, lang_id, mixing, ngram_join, sharding
from salescope.llm.inputs import id_split, read_table
from salescope.session import cut_lineage

SHARDS = 40
#: SQL cannot express the stages; tests hold them against brute force
ORACLE_SQL = None


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = lang_id.train(docs.filter(id_split("doc_id", 3) != 1))
    return lang_id.keep_identified(docs, model)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    linked = ngram_join.link_components(docs, width=5, num=80, den=100, text_key=True)
    others = cut_lineage(linked.filter("component_id != doc_id").select("doc_id", "text_key").distinct(), "copies")
    left = (docs.doc_id == others.doc_id) & (F.xxhash64(docs.text) == others.text_key)
    return docs.join(ngram_join.small(others), left, "left_anti").dropDuplicates(["doc_id", "text"])


def remove_test_items(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.drop_contaminated(docs, read_table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    # an id may have several texts: each is a row of its own
    keyed = docs.select(F.struct("doc_id", F.xxhash64("text").alias("text_key")).alias("key"), "source")
    held_back = mixing.pfair_mix(keyed, id_col="key").filter("not in_mix").select("doc_id.*").distinct()
    left = (docs.doc_id == held_back.doc_id) & (F.xxhash64(docs.text) == held_back.text_key)
    return docs.join(held_back, left, "left_anti")


def assign_shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return sharding.shard_rows(docs, SHARDS, carry=docs.columns)


STAGES = [
    ("language ID", identify_language),
    ("n-gram Jaccard join", drop_near_duplicates),
    ("benchmark decontamination", remove_test_items),
    ("mixing sources to target weights", mix_sources),
    ("sharding", assign_shards),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = cut_lineage(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
