"""Nulls, empty and very long texts, ties, repeated rows, empty tables and
clashing extra columns: each operator has a defined result for them."""

import hashlib
import re
import uuid
import zlib

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from salescope.llm import (decontaminate, exact_dedup, html_extract, inputs, lang_id, license_scan, lm_score,
                           mixing, ngram_join, quality, sharding)

SCHEMA = ("doc_id long, text string, lang string, source string, n_chars long, digest string, norm string, "
          "score double, shard int, slot long, block long, rep long, n long, meta string, part int, trained boolean")
LONG = ("lorem ipsum dolor sit amet " * 8000).strip()


@pytest.fixture(scope="module")
def docs(spark):
    def row(i, text, lang="en", source="s1", n=10):
        return (i, text, lang, source, n, "x", "y", 1.0, 7, 8, 9, 10, 11, "m", 1, True)
    return spark.createDataFrame([
        row(1, "the quick brown fox jumps over the lazy dog"),
        row(2, "the quick  brown fox\tjumps over the lazy dog"),      # equal without white space
        row(2, "the quick  brown fox\tjumps over the lazy dog"),      # repeated row
        row(3, None, None, None, None),
        row(4, "", None, "s2", 0),
        row(5, " \t\r\n\x0b\x0c"),
        row(6, LONG, "la", "s2", len(LONG)),
        row(7, "...!!! 123", "en", "s3", -5),
        row(None, "id is missing here", "en", "s3"),
        row(8, "größe ÄÖ straße ñandú", "de", "s3"),
    ], SCHEMA)


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


def by_id(df):
    out = {}
    for r in df.collect():
        out.setdefault(r.doc_id, []).append(r)
    return out


def test_exact_dedup(docs, nothing):
    got = by_id(exact_dedup.exact_dedup(docs))
    assert sum(map(len, got.values())) == 10
    # the longest original stays; the repeated row counts twice
    assert [(r.keep_id, r.group_size, r.kept) for r in got[1] + got[2]] == [(2, 3, False), (2, 3, True), (2, 3, True)]
    # null, empty and white space only are one group; five code points beat none
    assert [(r.keep_id, r.group_size, r.kept) for i in (3, 4, 5) for r in got[i]] == [(5, 3, False), (5, 3, False), (5, 3, True)]
    assert got[3][0].text_sha256 == hashlib.sha256(b"").hexdigest()
    assert got[None][0].keep_id is None and got[None][0].kept
    assert exact_dedup.exact_dedup(nothing).count() == 0


def test_exact_dedup_compares_content_behind_equal_digests(spark):
    docs = spark.createDataFrame([(1, "a"), (2, " a"), (3, "b"), (4, "b"), (5, "c")], "doc_id long, text string")
    got = by_id(exact_dedup.exact_dedup(docs, digest=lambda c: F.lit("same")))
    assert {i: (r[0].keep_id, r[0].group_size) for i, r in got.items()} == {1: (2, 2), 2: (2, 2), 3: (3, 2), 4: (3, 2), 5: (5, 1)}


def jump(key, n):
    b, j = -1, 0
    key &= (1 << 64) - 1
    while j < n:
        b = j
        key = (key * 2862933555777941757 + 1) & ((1 << 64) - 1)
        j = int(float(b + 1) * (float(1 << 31) / float((key >> 33) + 1)))
    return b


def test_sharding(spark, docs, nothing):
    got = by_id(sharding.shard_rows(docs, 40, carry=docs.columns))
    for i, text in ((1, "the quick brown fox jumps over the lazy dog"), (3, ""), (6, LONG), (8, "größe ÄÖ straße ñandú")):
        data = text.encode()
        assert got[i][0][:4] == (i, len(data) + 16, zlib.crc32(data), "key")
        assert (got[i][0].shard, got[i][0].grown_shard) == (jump(i, 40), jump(i, 41))
    assert got[None][0].shard == jump(0, 40)
    assert got[1][0].lang == "en" and got[1][0].digest == "x"        # carried; its own shard column gave way
    assert sharding.shard_rows(nothing, 40).count() == 0
    ids = spark.range(-2000, 2000).select(F.col("id").alias("doc_id"), F.lit("x").alias("text"))
    rows = sharding.shard_rows(ids, 7, rows_per_part=50).collect()
    assert all((r.shard, r.grown_shard) == (jump(r.doc_id, 7), jump(r.doc_id, 8)) for r in rows)
    assert all(r.grown_shard in (r.shard, 7) for r in rows)
    for s in range(7):
        own = sorted(r.slot for r in rows if r.shard == s)
        assert own == list(range(len(own)))


WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = {k: k + 32 for k in range(65, 91)}


def test_license_scan(spark, docs, nothing):
    got = by_id(license_scan.scan(docs))
    assert (got[3][0].n_words, got[3][0].first_word, got[3][0].labels, got[3][0].score) == (0, None, "", 0.0)
    assert got[6][0].n_words == 40000 and got[5][0].n_words == 0 and got[7][0].n_words == 1
    assert license_scan.scan(nothing).count() == 0
    texts = [
        "Licensed under the Apache License, Version 2.0.", "x GNU\nGeneral-Public  LICENSE x gnu general public license, version 3",
        "cc by cc-by CC.BY-NC 4.0", "Released under the MIT License.", "mit licenses", "amit license", "CC BY",
        "not licensed under the mit license", "SPDX-License-Identifier: BSD-3-Clause", "All rights reserved.",
        "permission is hereby\n granted, free of charge, to any person obtaining a copy", "driver's license", "Ä" * 5,
        "GPLv3 code", "a " * 3000 + "MIT license " * 700, "creative commons attribution share alike 4.0", "the unlicense"]
    found = by_id(license_scan.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")))
    phrases = [("gnu general public license", "gpl"), ("apache license", "apache"), ("cc by", "cc-by"), ("mit license", "mit")]
    for i, text in enumerate(texts):
        words = WORD.findall(text.translate(LOWER))
        places = [(k, label) for phrase, label in phrases for p in [phrase.split()]
                  for k in range(len(words)) if words[k:k + len(p)] == p]
        r = found[i][0]
        at = [k for k, _ in places]
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == (
            len(words), len(places), min(at, default=None), max(at, default=None), ",".join(sorted({x for _, x in places}))), text
        assert set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(","))
    labels = [found[i][0].labels for i in range(len(texts))]
    assert labels[0] == "apache,apache-2.0" and labels[1] == "gpl,gpl-3.0" and labels[2] == "cc-by,cc-by-nc"
    assert labels[7] == "mit" and labels[8] == "bsd-3-clause" and labels[9] == "proprietary" and labels[10] == "mit"
    assert labels[11] == "" and labels[13] == "gpl-3.0" and labels[15] == "cc-by-sa" and labels[16] == "unlicense"
    # containment: the name inside the notice is suppressed
    kept = [d.rule for d in found[0][0].detections]
    assert kept == ["apache-2.0/notice"]


def test_license_gate_and_keywords_lose_nothing(spark):
    """Every rule is found through gate and keyword on a text that it matches."""
    from salescope.llm.license_rules import LICENCES, OTHERS, rules
    assert len(rules()) > 300
    names = {label: spdx for label, spdx, _ in LICENCES}
    texts = [f"SPDX-License-Identifier: {spdx.replace(' ', '-')}" for spdx in names.values()]
    table = rules()
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = by_id(license_scan.scan(docs))
    for k, label in enumerate(names):
        assert label in got[k][0].labels.split(","), label
    for r in table:
        gate = [*license_scan.GATE, "cc by"]
        sample = " " + re.sub(r"\[sc\]", "s", r["keyword"]) + " "
        assert r["keyword"] == "" or isinstance(sample, str)
        # a regex without any gate word could never be reached
        plain = r["regex"].replace("[sc]", "s")
        assert any(g in plain for g in gate) or "|attribution)" in plain or "by|" in plain, r["rule"]
    assert len(OTHERS) == len({o[0] for o in OTHERS})


def test_language_id(docs, nothing):
    model = lang_id.train(docs)
    assert model.langs == ["de", "en", "la"]
    got = by_id(lang_id.predict(docs, model, keep={"held_out": F.col("doc_id") == 1}))
    assert got[1][0].held_out and got[1][0].lang_pred == "en" and got[6][0].lang_pred == "la"
    assert [(got[i][0].lang_pred, got[i][0].score) for i in (3, 4, 5, 7)] == [("und", 0.0)] * 4
    assert len(got[2]) == 2 and 0 <= got[8][0].score <= 1
    untrained = lang_id.train(nothing)
    assert {r.lang_pred for r in lang_id.predict(docs, untrained).collect()} == {"und"}
    assert lang_id.predict(nothing, model).count() == 0
    kept = lang_id.keep_identified(docs, model)
    assert kept.columns == docs.columns and kept.filter("doc_id in (3, 4, 5, 7)").count() == 0


def test_language_id_matches_counting_by_hand(spark):
    import math
    from collections import Counter
    import numpy as np
    docs = spark.createDataFrame([("xx", "abba"), ("yy", "b c"), ("xx", "cab")], "lang string, text string")
    bits = 12
    model = lang_id.train(docs, bits=bits)
    def bins(text):
        p = " " + text + " "
        out = Counter()
        for n, found in zip(lang_id.ORDERS, lang_id._bins(np.frombuffer(p.encode("utf-32-le"), np.uint32), bits)):
            assert len(found) == len(p) - n + 1
            out.update(found.tolist())
        return out
    counts = {"xx": bins("abba") + bins("cab"), "yy": bins("b c")}
    for text in ("abc", "b"):
        for k, lang in enumerate(("xx", "yy")):
            total = sum(counts[lang].values())
            want = math.log({"xx": 2, "yy": 1}[lang] / 3) + sum(
                n * math.log((counts[lang][b] + 0.5) / (total + 0.5 * 2 ** bits)) for b, n in bins(text).items())
            assert math.isclose(model.scores(text)[k], want, rel_tol=1e-5)


def test_long_text_in_pieces_equals_whole(monkeypatch):
    import numpy as np
    text = "Straße und Gänge, " * 40
    whole = np.sort(np.concatenate(list(lang_id._text_bins(text, 10))))
    monkeypatch.setattr(lang_id, "_PIECE", 37)
    assert (np.sort(np.concatenate(list(lang_id._text_bins(text, 10)))) == whole).all()


def test_lm_score(docs, nothing):
    got = by_id(lm_score.score_texts(docs, F.col("doc_id") != 1, depth=2))
    assert sum(map(len, got.values())) == 10 and len(got[2]) == 2
    assert [(got[i][0].n_tokens, got[i][0].n_known) for i in (3, 4, 5)] == [(1, 1)] * 3
    assert got[6][0].n_tokens == 40001 and got[6][0].score < 0
    assert not got[None][0].trained
    assert lm_score.score_texts(nothing, F.lit(True)).count() == 0
    untrained = lm_score.score_texts(docs.filter("doc_id = 4"), F.lit(False)).first()
    assert (untrained.train_tokens, untrained.n_known) == (0, 0) and untrained.bits_per_byte == pytest.approx(8)


def test_ngram_join(docs, nothing):
    got = by_id(ngram_join.link_components(docs))
    assert [(got[i][0].n_shingles, got[i][0].component_id) for i in (1, 2, 3, 4, 5)] == [(7, 1), (7, 1), (0, 3), (0, 4), (0, 5)]
    assert got[7][0].n_shingles == 1 and got[6][0].n_shingles == 5
    assert got[None][0].component_id is None
    assert ngram_join.link_components(nothing).count() == 0


def test_ngram_join_takes_long_texts_a_few_megabytes_at_a_time(spark, tmp_path, monkeypatch):
    keys = ["spark.sql.execution.arrow.maxBytesPerBatch", "spark.sql.parquet.columnarReaderBatchSize"]
    before = [spark.conf.get(k) for k in keys]
    shingle_heads, at = ngram_join.shingle_heads, str(tmp_path)

    def measured(docs, *rest):
        def note(batches):
            for batch in batches:
                with open(f"{at}/{uuid.uuid4().hex}", "w") as f:
                    f.write(f"{batch.num_rows} {batch.nbytes}")
                yield batch
        return shingle_heads(docs.mapInArrow(note, docs.schema), *rest)

    monkeypatch.setattr(ngram_join, "shingle_heads", measured)
    texts = spark.range(0, 3000, 1, 1).selectExpr("id as doc_id", "repeat(concat('w', id, ' '), 1000) as text")
    got = ngram_join.link_components(texts)
    seen = [tuple(map(int, p.read_text().split())) for p in tmp_path.iterdir()]
    assert sum(rows for rows, _ in seen) == 3000 and sum(size for _, size in seen) > 12_000_000
    assert max(size for _, size in seen) < 6_000_000
    assert got.filter("n_shingles = 1 and component_id = doc_id").count() == got.count() == 3000
    assert [spark.conf.get(k) for k in keys] == before


def test_settings_go_back_after_an_error(spark):
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key)
    with pytest.raises(ValueError):
        with inputs.small_batches(spark):
            assert spark.conf.get(key) != before
            raise ValueError
    assert spark.conf.get(key) == before


def test_pieces_hold_all_rows_in_order():
    batch = pa.record_batch([pa.array(range(1000))], names=["i"])
    parts = list(inputs.pieces(batch, 300))
    assert [p.num_rows for p in parts] == [300, 300, 300, 100]
    assert pa.Table.from_batches(parts).column("i").to_pylist() == list(range(1000))
    assert list(inputs.pieces(batch.slice(0, 0))) == []


def test_decontaminate(spark, docs, nothing):
    tests = spark.createDataFrame([(1, "Quick brown fox jumps; over the lazy dog", 1.0), (2, None, 1.0), (3, "", 1.0), (4, "two words", 1.0),
                                   (5, "dolor sit amet lorem", 1.0)], "item_id long, text string, score double")
    got = {(r.doc_id, r.item_id): r for r in decontaminate.contaminated(docs, tests).collect()}
    assert set(got) == {(1, 1), (2, 1), (6, 5)}
    assert (got[1, 1].score, got[1, 1].first_word, got[1, 1].last_word) == (1.0, 1, 8)
    assert decontaminate.contaminated(docs, tests).count() == 4                     # the repeated row
    kept = decontaminate.drop_contaminated(docs, tests)
    assert kept.columns == docs.columns and sorted((r.doc_id or 0) for r in kept.select("doc_id").collect()) == [0, 3, 4, 5, 7, 8]
    assert decontaminate.contaminated(nothing, tests).count() == 0
    assert decontaminate.contaminated(docs, tests.limit(0)).count() == 0
    assert decontaminate.drop_contaminated(docs, tests.limit(0)).count() == 10


def test_pfair_mix(docs, nothing):
    got = mixing.pfair_mix(docs, block_rows=1).collect()
    assert len(got) == 10 and {r.source for r in got} == {"", "s1", "s2", "s3"}
    assert len({r.slot for r in got}) == 10
    assert mixing.pfair_mix(nothing).count() == 0
    with pytest.raises(ValueError):
        mixing.pfair_mix(docs, weights={"s1": 1.0})


def test_html_extract(spark):
    rows = [(1, "https://a.example/x", None), (2, None, ""), (3, "not a url", "plain &amp; text"),
            (4, "https://a.example/y", "<article><h1>T&eacute;st</h1><p>one\n two<br>three<p>four<div class='ad'>buy</div></article><footer>f"),
            (4, "https://a.example/y", "<article><h1>T&eacute;st</h1><p>one\n two<br>three<p>four<div class='ad'>buy</div></article><footer>f")]
    got = html_extract.extract(spark.createDataFrame([r + ("h",) for r in rows], "page_id long, url string, html string, host string")).collect()
    texts = {r.page_id: (r.text, r.n_chars) for r in got}
    assert len(got) == 5
    assert texts == {1: ("", 0), 2: ("", 0), 3: ("plain & text", 12), 4: ("Tést\none two three\nfour", 23)}
    assert html_extract.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0
    long = "<article>" + "<p>word &lt; more</p>" * 20000 + "</article>"
    r = html_extract.extract(spark.createDataFrame([(1, "u", long)], "page_id long, url string, html string")).first()
    assert r.text == "\n".join(["word < more"] * 20000)


def test_quality(spark, docs, nothing):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    got = quality.classify(docs, labels).collect()
    assert len(got) == 10 and all(r.score == 1.0 and r.toxic_score == 0.0 and r.keep for r in got)
    assert quality.classify(nothing, labels).count() == 0
    labels = spark.createDataFrame([(1, 1, 0), (1, 1, 0), (3, None, 0), (4, 0, None), (6, 0, 1), (99, 1, 1), (None, 1, 1)],
                                   "doc_id long, quality int, toxic int")
    assert quality.classify(docs, labels).count() == 10
