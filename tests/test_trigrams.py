"""Substring search over trigram postings against the plain scan."""

import random

import pytest
from pyspark.sql import functions as F

from salescope.operators.filters import search_clients
from salescope.sources import trigrams as TG


@pytest.fixture(scope="module")
def clients(spark):
    """One name on a third of the rows; accents, wide characters, short, empty and missing names."""
    rnd = random.Random(4)
    rows = []
    for i in range(6000):
        name = "Talleres Común" if i % 3 == 0 else "".join(rnd.choice("abcdeÁñ 漢%_") for _ in range(rnd.choice([1, 2, 3, 5, 9, 20])))
        rows.append((str(i), name))
    rows += [("e", ""), ("n", None), ("m", None), ("astral", "x😀yz😀"), ("astral", "x😀yz😀")]
    return spark.createDataFrame(rows, "id string, name string")


@pytest.fixture(scope="module")
def store(clients, tmp_path_factory):
    return TG.build_trigrams(clients, F.col("name"), str(tmp_path_factory.mktemp("trigrams")), parts=12)


@pytest.mark.parametrize("term", ["común", "TALLERES", "res co", "abc", "ába", "ÑÑ%", "_a%", "漢漢", "😀yz", "yz😀", "a", "%", "zzzz",
                                  "", None, "  ", "talleres común y más", " abc "])
def test_search_equals_the_scan(clients, store, term):
    got, want = (sorted(map(str, d.collect())) for d in (store.search(term), search_clients(clients, term)))
    assert got == want


def test_random_terms_equal_the_scan(clients, store):
    rnd, names = random.Random(8), [r.name for r in clients.filter("length(name) > 4").collect()]
    for _ in range(12):
        name = rnd.choice(names)
        a = rnd.randrange(len(name) - 2)
        term = name[a:a + rnd.choice([3, 4, 6])]
        assert store.search(term).count() == search_clients(clients, term).count() > 0


def test_parts_without_candidates_are_not_read(clients, store):
    found = store.search("talleres co")
    assert "dynamicpruning" in found._jdf.queryExecution().toString().lower()
    parts = store._rows().select("_part").distinct().count()
    with_rows = store.candidates("talleres co").select("part").distinct().count()
    assert parts > 6 and 1 < with_rows < parts              # the common name is spread, other parts are left out


def test_rows_are_kept_and_empty_tables_searched(spark, clients, store, tmp_path):
    assert sorted(map(str, store.rows().collect())) == sorted(map(str, clients.collect()))
    empty = TG.build_trigrams(clients.limit(0), F.col("name"), str(tmp_path / "empty"))
    assert [empty.search(t).count() for t in ("abc", "a", None)] == [0, 0, 0]
