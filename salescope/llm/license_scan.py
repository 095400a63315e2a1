"""Licence scan with ordered signature rules, in built-in expressions only.

1. *Gate.* A few substring tests on the lower-cased text decide whether any
   rule can match; other texts are only counted.
2. *Prefilter.* A gated text is normalised to lower-case words joined by single
   spaces; each rule is tried only where its keyword occurs.
3. *Places.* Splitting the normalised text by a rule's regex gives the pieces
   between its matches; counting the spaces on the way gives word intervals.
4. *Resolution.* A detection is suppressed when another one of the same or a
   higher priority contains it.  In order of (start, longest, priority), a
   container always comes first, so one pass with the furthest end so far of
   each priority is enough.

The whole scan is one projection of the rows: no shuffle, no group.
"""

from __future__ import annotations

import json
import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .inputs import pick
from .license_rules import rules

#: what stands between words in any text
_BETWEEN = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: every match of every rule contains one of these words, or the words "cc by"
GATE = ("licen", "spdx", "copyright", "reserved", "domain", "hereby", "redistribution", "altered",
        "proprietary", "creative", "cc0", "gplv", "gpl", "wtfpl", "attribution", "historical")
_GATE_CC = r"cc" + _BETWEEN + "by"

_RULE_TYPE = "array<struct<rule:string,priority:int,relevance:double,label:string,keyword:string,regex:string,base:boolean>>"
_HIT = "array<struct<first:bigint,last:bigint,priority:int,rule:string,label:string,relevance:double,base:boolean>>"
_LEVELS = 4


def _spaces(s: Column) -> Column:
    return (F.length(s) - F.length(F.replace(s, F.lit(" "), F.lit("")))).cast("long")


def _places(text: Column, rule: Column) -> Column:
    """Word intervals of a rule's matches in a normalised text."""
    between = F.split(text, rule.regex, -1)
    found = F.regexp_extract_all(text, rule.regex, F.lit(0))
    empty = F.lit(None).cast(_HIT)
    start = F.struct(F.lit(0).cast("long").alias("seen"), F.coalesce(empty, F.array().cast(_HIT)).alias("out"))

    def step(s, x):
        first = s.seen + _spaces(x.gap) - 1
        last = first + _spaces(x.hit)
        hit = F.struct(first.alias("first"), last.alias("last"), rule.priority.alias("priority"),
                       rule.rule.alias("rule"), rule.label.alias("label"),
                       rule.relevance.alias("relevance"), rule.base.alias("base"))
        return F.struct((s.seen + _spaces(x.gap) + _spaces(x.hit)).alias("seen"),
                        F.concat(s.out, F.array(hit)).alias("out"))

    pairs = F.zip_with(F.slice(between, F.lit(1), F.size(found)), found,
                       lambda g, h: F.struct(g.alias("gap"), h.alias("hit")))
    return F.aggregate(pairs, start, step, lambda s: s.out)


def _resolved(hits: Column) -> Column:
    """The detections that no other of the same or a higher priority contains."""
    order = F.transform(hits, lambda h: F.struct(h["first"].alias("a"), (-h["last"]).alias("b"),
                                                 (-h.priority).alias("c"), h.rule.alias("d"), h.alias("hit")))
    none = F.lit(-1).cast("long")
    start = F.struct(*[none.alias(f"end{p}") for p in range(1, _LEVELS + 1)],
                     F.array().cast(_HIT).alias("out"))

    def step(s, x):
        h = x.hit
        ends = [s[f"end{p}"] for p in range(1, _LEVELS + 1)]
        over = F.greatest(*[F.when(h.priority <= p, ends[p - 1]).otherwise(none) for p in range(1, _LEVELS + 1)])
        return F.struct(*[F.when(h.priority == p, F.greatest(ends[p - 1], h["last"])).otherwise(ends[p - 1]).alias(f"end{p}")
                          for p in range(1, _LEVELS + 1)],
                        F.when(over >= h["last"], s.out).otherwise(F.concat(s.out, F.array(h))).alias("out"))

    return F.aggregate(F.array_sort(order), start, step, lambda s: s.out)


def normalised_words(text: Column) -> Column:
    """Lower-case words, each with one space before it and one after the last."""
    low = F.translate(text, string.ascii_uppercase, string.ascii_lowercase)
    return F.concat(F.lit(" "), F.trim(F.regexp_replace(low, _BETWEEN, " ")), F.lit(" "))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rule_table: list[dict] | None = None) -> DataFrame:
    """One row per input row: ``doc_id, n_words, n_base, first_word, last_word,
    base_labels, labels, score, detections``.

    ``n_base``, ``first_word``, ``last_word`` and ``base_labels`` come from all
    places of the base phrases, before any suppression; ``labels`` adds those of
    the detections that remain.  ``score`` is the relevance of the best remaining
    detection (0: none).  Null and empty texts have no words, null positions,
    empty labels and score 0.  Repeated rows and ids give one row each.
    """
    table = rules() if rule_table is None else rule_table
    known = F.from_json(F.lit(json.dumps(table)), _RULE_TYPE)
    text = F.coalesce(F.col("text"), F.lit(""))
    low = F.lower(text)
    gate = low.rlike(_GATE_CC)
    for word in GATE:
        gate = gate | F.contains(low, F.lit(word))
    rows = pick(docs, doc_id=id_col, text=text_col).select(
        "doc_id", F.split(text, _BETWEEN).alias("parts"), F.when(gate, normalised_words(text)).alias("words"))
    # words = the parts without an empty first or last one
    empty_ends = (F.when(F.col("parts")[0] == "", 1).otherwise(0)
                  + F.when((F.size("parts") > 1) & (F.element_at("parts", -1) == ""), 1).otherwise(0))
    rows = rows.select("doc_id", (F.size("parts") - empty_ends).cast("long").alias("n_words"), "words")
    words = F.col("words")
    tried = F.filter(known, lambda r: F.contains(words, r.keyword))
    hits = F.flatten(F.transform(tried, lambda r: _places(words, r)))
    rows = rows.select("doc_id", "n_words", F.when(words.isNotNull(), hits).alias("hits"))
    rows = rows.select("doc_id", "n_words", F.filter("hits", lambda h: h.base).alias("base"),
                       F.when(F.size("hits") > 0, _resolved(F.col("hits"))).alias("detections"))
    base_labels = F.array_distinct(F.transform("base", lambda h: h.label))
    own = F.transform(F.filter("detections", lambda h: h.label != ""), lambda h: h.label)
    no_labels = F.array().cast("array<string>")
    text_of = lambda a: F.array_join(F.array_sort(F.array_distinct(a)), ",")
    return rows.select(
        "doc_id", "n_words",
        F.when(F.col("base").isNull(), 0).otherwise(F.size("base")).cast("long").alias("n_base"),
        F.array_min(F.transform("base", lambda h: h["first"])).alias("first_word"),
        F.array_max(F.transform("base", lambda h: h["first"])).alias("last_word"),
        F.coalesce(text_of(base_labels), F.lit("")).alias("base_labels"),
        F.coalesce(text_of(F.concat(F.coalesce(base_labels, no_labels), F.coalesce(own, no_labels))),
                   F.lit("")).alias("labels"),
        F.coalesce(F.array_max(F.transform("detections", lambda h: h.relevance)), F.lit(0.0)).alias("score"),
        F.coalesce("detections", F.array().cast(_HIT)).alias("detections"))
