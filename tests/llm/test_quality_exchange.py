"""Co-training over all unlabelled rows, and languages without a limit."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from salescope.llm import lang_id, quality

DOCS = "doc_id long, text string, source string, lang string, n_chars long"


def _text(rnd, words, n=30):
    return " ".join(rnd.choice(words) for _ in range(n))


@pytest.fixture(scope="module")
def corpus(spark):
    """Labelled rows of sources a and b; unlabelled ones of a, b and c, all bad in c."""
    rnd = random.Random(3)
    plain = [f"w{k}" for k in range(60)]
    good, bad = plain + ["fine"] * 8, plain + ["buy"] * 8
    rows, labels = [], []
    for i in range(1200):
        q = int(rnd.random() < 0.5)
        source = rnd.choice("aab" if q else "abb")
        rows.append((i, _text(rnd, good if q else bad), source, "en", 100))
        if i < 400:
            labels.append((i, q, 0))
    rows += [(i, _text(rnd, bad), "c", "en", 100) for i in range(2000, 2400)]
    rows += [(5000, _text(rnd, plain), "c", "en", 100), (5001, _text(rnd, plain), "a", "en", 100), (None, "fine", "a", None, None)]
    return (spark.createDataFrame(rows, DOCS).repartition(7),
            spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))


def _inputs(docs):
    return docs.select("doc_id", "text", quality._metadata("source", "lang", "n_chars").alias("meta"))


def test_a_source_without_labels_is_learned_by_exchange(corpus):
    docs, labels = corpus
    meta = {r: dict(quality.classify(docs, labels, rounds=r).filter("doc_id >= 5000").select("doc_id", "meta_score").collect())
            for r in (0, 3)}
    assert meta[3][5000] < meta[0][5000] - 0.1 and meta[3][5000] < 0.35 < meta[3][5001]


def test_sums_equal_counting_by_hand(corpus):
    docs, labels = corpus
    rows = _inputs(docs)
    models = quality.train(rows, labels, ["quality"], rounds=0)
    model = models["quality"]
    got = quality.confident_sums(rows, models)
    table = quality._featurised(rows).toArrow()
    want = {k: np.zeros((2, n + 1)) for k, n in ((0, quality.Styles.size), (1, quality._META_BINS))}
    for r in table.to_pylist():
        words, meta = np.array(r["words"], np.int64), np.array(r["meta"], np.int64)
        views = [model.styles.of(np.array([r["styles"]]), words, np.zeros(len(words), np.int64)), (meta, np.zeros(3, np.int64))]
        for k in (0, 1):
            odds, (low, high) = model.log_odds(1 - k, *views[1 - k], 1)[0], model.bounds[1 - k]
            for label, sure in ((0, odds <= low), (1, odds >= high)):
                if sure:
                    np.add.at(want[k][label], np.append(views[k][0], -1), 1)
    for k in (0, 1):
        n, features = got["quality", k]
        assert n.tolist() == want[k][:, -1].tolist() and (features == want[k][:, :-1]).all()
    assert got["quality", 1][0].sum() > 1000                  # the text view is sure of most rows, labelled or not


def test_labels_of_an_id_count_once_and_conflicts_not_at_all(spark, corpus):
    _, labels = corpus
    more = labels.union(labels).union(spark.createDataFrame([(3, 0, 0), (3, 1, 0), (None, 1, 1), (7, None, 1)], labels.schema))
    got = quality._labelled(more, ["quality", "toxic"], 10_000)
    want = labels.filter("doc_id <> 3")
    assert sorted(got.collect()) == sorted(want.collect())
    assert quality._labelled(more, ["quality", "toxic"], 50).count() == 50


def test_repeated_rows_of_a_labelled_id_change_nothing(corpus):
    docs, labels = corpus
    often = docs.union(docs.filter("doc_id < 40")).union(docs.filter("doc_id < 40"))
    one, two = ({r.doc_id: r.score for r in quality.classify(d, labels).filter("doc_id is not null").distinct().collect()}
                for d in (docs, often))
    assert one.keys() == two.keys() and all(one[k] == pytest.approx(two[k]) for k in one)


def test_confident_bound():
    odds = np.array([5.0] * 30 + [4.0] * 30 + [3.0] * 30)
    y = np.array([1.0] * 60 + [0.0] * 30)
    assert quality._sure(odds, y, 0.95) == 4.0
    assert quality._sure(odds, 1 - y, 0.95) == np.inf
    assert quality._sure(odds - 4, y, 0.95) == pytest.approx(np.log(9))


def test_more_languages_than_a_full_matrix_has_room_for(spark):
    rnd = random.Random(9)
    letters = "abcdefghijklmnopqrstuvwxyz"
    rows = []
    for k in range(600):
        own = ["".join(rnd.choice(letters) for _ in range(6)) for _ in range(5)]
        rows += [(f"l{k:03}", " ".join(rnd.choice(own) for _ in range(40))) for _ in range(2)]
    docs = spark.createDataFrame(rows, "lang string, text string").withColumn("doc_id", F.monotonically_increasing_id())
    model = lang_id.train(docs, max_cells=1 << 20)
    assert len(model.langs) == 600 and model.matrix.size <= 1 << 20
    got = lang_id.predict(docs, model, keep={"lang": F.col("lang")})
    assert got.filter("lang = lang_pred").count() > 1100
