"""Thin registered queries: each operator with its production parameters over
its whole table.  ``ORACLE`` has DuckDB SQL where SQL can express the result."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (decontaminate, exact_dedup, html_extract, lang_id, license_scan, lm_score, mixing, ngram_join, prefix_trie,
               quality, sharding, structure_repair, url_filter, url_rules)
from .inputs import id_split, read_table

SHARDS = 40

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return register


@query("op1_cotrained_quality")
def op1_cotrained_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


@query("op2_pfair_mix")
def op2_pfair_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.pfair_mix(read_table(spark, sf_dir, "documents"))


@query("op3_license_scan")
def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = license_scan.scan(read_table(spark, sf_dir, "documents"))
    return found.drop("detections")


@query("op4_decontaminate")
def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


@query("op5_language_id")
def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    held_out = id_split("doc_id", 3) == 1
    model = lang_id.train(docs.filter(~held_out))
    return lang_id.predict(docs, model, keep={"held_out": held_out})


@query("op6_context_tree_weighting")
def op6_context_tree_weighting(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    scored = lm_score.score_texts(docs, id_split("doc_id", 5) != 1)
    return scored.select("doc_id", (~F.col("trained")).alias("held_out"), "n_tokens", "n_known", "train_tokens",
                         "base_score", "score", "bits_per_byte")


@query("op7_ngram_jaccard_join")
def op7_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.link_components(read_table(spark, sf_dir, "documents"), width=3, num=90, den=100)


@query("op8_jump_shards")
def op8_jump_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_rows(read_table(spark, sf_dir, "documents"), SHARDS)


@query("op9_template_removal")
def op9_template_removal(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract(read_table(spark, sf_dir, "pages"))


@query("op10_exact_dedup", r"""
with rows as (
  select doc_id, length(coalesce(text, '')) as points,
         sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) as text_sha256
  from documents)
select doc_id,
       first_value(doc_id) over (partition by text_sha256 order by points desc, doc_id nulls last) as keep_id,
       count(*) over (partition by text_sha256) as group_size,
       doc_id is not distinct from first_value(doc_id) over
         (partition by text_sha256 order by points desc, doc_id nulls last) as kept,
       text_sha256
from rows
""")
def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(read_table(spark, sf_dir, "documents"))


URL_RULES = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"),
             ("net", "/es/", "block"), ("net", "/fr/", "block")]


def _url_sql() -> str:
    fits = " ".join(
        f"when (host = '{h}' or ends_with(host, '.{h}')) and starts_with(path, '{p}') then '{h}{p} {v}'"
        for h, p, v in sorted(URL_RULES, key=lambda r: -len(r[0] + r[1])))
    words = ", ".join(f"'{w}'" for w in url_rules.BLOCKED_WORDS)
    return rf"""
with urls as (
  select page_id,
         translate(regexp_extract(coalesce(url, ''), '://([^/?#]*)', 1),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
         regexp_extract(coalesce(url, ''), '://[^/?#]*([^?#]*)', 1) as path
  from pages),
fitting as (select *, case {fits} end as fit from urls)
select page_id, host, path, split_part(fit, ' ', 1) as rule,
       coalesce(split_part(fit, ' ', 2),
                case when list_has_any(regexp_split_to_array(host, '[-_.]'), [{words}])
                     then 'block' else 'allow' end) as verdict
from fitting
"""


@query("op11_url_filter", _url_sql())
def op11_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    words = spark.createDataFrame([(w, "block") for w in url_rules.BLOCKED_WORDS], "word string, verdict string")
    return url_filter.judge_urls(read_table(spark, sf_dir, "pages"), url_filter.build_index(rules, words))


@query("op12_prefix_trie")
def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.conversation_trie(read_table(spark, sf_dir, "conversations"), rebuild=True)


@query("op13_structure_repair")
def op13_structure_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return structure_repair.repair_conversations(structure_repair.damaged(read_table(spark, sf_dir, "conversations")))
