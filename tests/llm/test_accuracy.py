"""Operators against brute force, exact laws or held-out labels."""

import math
import random
import re
from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from salescope.llm import components, decontaminate, html_extract, lm_score, mixing, ngram_join, queries, quality
from salescope.llm.inputs import id_split, read_table

SF = "/root/testdata/sf0.001"
LOWER = {k: k + 32 for k in range(65, 91)}


def find(parent, x):
    while parent.setdefault(x, x) != x:
        x = parent[x]
    return x


def brute_components(texts, width, num, den):
    sets, parent = {}, {}
    for i, t in texts.items():
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(LOWER))
        sets[i] = {tuple(w[k:k + width]) for k in range(len(w) - width + 1)} or ({tuple(w)} if w else set())
    ids = sorted(i for i in sets if sets[i])
    for k, a in enumerate(ids):
        for b in ids[k + 1:]:
            if min(len(sets[a]), len(sets[b])) * den < max(len(sets[a]), len(sets[b])) * num:
                continue
            both = len(sets[a] & sets[b])
            if both * den >= num * (len(sets[a]) + len(sets[b]) - both):
                x, y = find(parent, a), find(parent, b)
                parent[max(x, y)] = min(x, y)
    return {i: (len(s), find(parent, i) if s else i) for i, s in sets.items()}


@pytest.mark.parametrize("width,num", [(3, 90), (5, 80), (1, 60)])
def test_ngram_join_equals_brute_force_on_edited_copies(spark, width, num, monkeypatch):
    monkeypatch.setattr(ngram_join, "HEAVY", 4)         # so that long lists and short heads occur
    rnd, texts = random.Random(width), {}
    vocabulary = [f"w{k}" for k in range(400)]
    passage = [rnd.choice(vocabulary) for _ in range(60)]
    for i in range(260):
        kind = rnd.random()
        if kind < 0.45 and texts:
            w = rnd.choice(list(texts.values())).split()
            for _ in range(rnd.choice([0, 0, 1, 1, 2, 4])):
                if w:
                    w[rnd.randrange(len(w))] = rnd.choice(vocabulary)
        elif kind < 0.6:
            w = passage + [rnd.choice(vocabulary) for _ in range(rnd.choice([0, 2, 5, 40]))]
        else:
            w = [rnd.choice(vocabulary) for _ in range(rnd.choice([0, 1, 2, 5, 9, 12, 18, 21, 26, 40, 120]))]
        texts[i] = " ".join(w)
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.link_components(docs, width=width, num=num).collect()}
    assert got == brute_components(texts, width, num, 100)


@pytest.mark.parametrize("held", [0, 10**6])
def test_heavy_elements_come_last(spark, monkeypatch, held):
    monkeypatch.setattr(ngram_join, "HELD_HEAVY", held)
    rows = spark.createDataFrame([(1, 7, [1, 5, 9]), (2, 8, [2]), (3, 9, [5, -4, 3])], "rep long, n long, elements array<long>")
    heavy = spark.createDataFrame([(5,), (-4,), (77,)], "h long")
    got = sorted(tuple(r) for r in ngram_join._light_first(rows, heavy).collect())
    assert got == [(1, 7, [1, 9, 5], 2), (2, 8, [2], 1), (3, 9, [3, -4, 5], 1)]
    assert ngram_join._light_first(rows.filter("rep < 0"), heavy).count() == 0


def test_repeated_rows_lose_no_link(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "HEAVY", 4)
    rnd, texts = random.Random(8), {}
    passages = [[f"p{k}x{j}" for j in range(60)] for k in range(4)]
    for i in range(120):
        w = passages[i % 4] + [f"o{i // 8}x{j}" for j in range(i % 5 * 4)]
        for _ in range(rnd.choice([0, 1, 2])):
            w[rnd.randrange(len(w))] = f"n{rnd.randrange(900)}"
        texts[i] = " ".join(w)
    docs = spark.createDataFrame(list(texts.items()) * 4, "doc_id long, text string")
    got = [(r.doc_id, (r.n_shingles, r.component_id)) for r in ngram_join.link_components(docs, width=3, num=80).collect()]
    assert len(got) == 480 and dict(got) == brute_components(texts, 3, 80, 100)
    assert set(got) == set(dict(got).items())


def test_prefixes_hold_different_elements(spark, monkeypatch):
    lists = []
    monkeypatch.setattr(ngram_join, "HEAVY", 4)
    monkeypatch.setattr(ngram_join, "_shared_buckets", lambda rows, f=ngram_join._shared_buckets: lists.append(rows.collect()) or f(rows))
    passage = [f"p{j}" for j in range(60)]
    rows = [(i, " ".join(passage + [f"o{i}x{j}" for j in range(3)])) for i in range(12)]
    ngram_join.link_components(spark.createDataFrame(rows * 4, "doc_id long, text string"), width=3, num=80).collect()
    posted = Counter((r.rep, r.n) for r in lists[0])
    assert posted == Counter({(i, 61): 61 - 49 + 1 for i in range(12)})
    assert len({(r.rep, r.bucket) for r in lists[0]}) == len(lists[0])


@pytest.mark.parametrize("limit", [0, 500_000])
def test_sets_and_lists_are_shuffled_no_second_time(spark, monkeypatch, limit):
    plans = []

    def cut(df, name, f=ngram_join.cut_lineage):
        plans.append((name, df._jdf.queryExecution().executedPlan().toString()))
        return f(df, name)
    monkeypatch.setattr(ngram_join, "HEAVY", 4)
    monkeypatch.setattr(ngram_join, "_BROADCAST_ROWS", limit)
    monkeypatch.setattr(ngram_join, "cut_lineage", cut)
    passages = [[f"p{k}x{j}" for j in range(60)] for k in range(4)]
    texts = {i: " ".join(passages[i % 4] + [f"o{i // 8}x{j}" for j in range(i % 5 * 4)]) for i in range(120)}
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
        got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.link_components(docs, width=3, num=80).collect()}
        rows = spark.createDataFrame([(b, r, r % c) for b, c in ((1, 1), (2, 2), (3, 9)) for r in range(c * 2)],
                                     "bucket long, rep long, component long")
        shared = ngram_join._shared_buckets(rows)
        assert shared._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1
        assert sorted(map(tuple, shared.collect())) == sorted(tuple(r) for r in rows.collect() if r.bucket > 1)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert got == brute_components(texts, 3, 80, 100)
    wide = [name for name, plan in plans if name in ("heavy", "members") and "SortMergeJoin" in plan]
    assert {name for name, _ in plans} >= {"heavy", "members"} and bool(wide) == (limit == 0)


def _passages(rnd, changed):
    """Texts by id: of each of 12 passages one whole copy and some with ``changed`` words replaced."""
    texts = {}
    for k in range(12):
        words = [f"p{k}x{j}" for j in range(150)]
        for i, c in enumerate([0, *changed]):
            w = list(words)
            for at in rnd.sample(range(150), c):
                w[at] = f"n{k}x{i}x{at}"
            texts[k * 100 + i] = " ".join(w)
    return texts


def test_bitmaps_differ_in_no_more_places_than_sets():
    rnd = np.random.default_rng(5)
    for n, m, both in [(0, 0, 0), (0, 5, 0), (1, 1, 1), (20, 25, 18), (300, 300, 300), (300, 290, 280), (500, 530, 490),
                       (1000, 1030, 0), (9000, 8000, 7900), (100, 9000, 100)]:
        e = np.unique(rnd.integers(0, 1 << 62, n + m))
        a, b = np.sort(e[:n]), np.sort(e[n - both:n - both + m])
        x, y = ngram_join._bitmap(a), ngram_join._bitmap(b)
        apart = ngram_join._bits_apart(x, y)
        assert apart == ngram_join._bits_apart(y, x) <= len(np.setxor1d(a, b))
        assert len(x) <= max(32, len(a) // 8) and (both > 0 or n == 0 or apart > 0.1 * n)


def test_sets_of_pairs_far_apart_are_not_fetched(spark, monkeypatch):
    texts, fetched = _passages(random.Random(3), [1, 15, 15, 20, 30]), []
    monkeypatch.setattr(ngram_join, "_fetch", lambda docs, wanted, *rest, f=ngram_join._fetch:
                        fetched.extend(r.rep for r in wanted.collect()) or f(docs, wanted, *rest))
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.link_components(docs).collect()}
    assert got == brute_components(texts, 3, 90, 100)
    linked = {i for i in texts if i % 100 < 2}
    assert set(fetched) >= {i for i, (_, c) in got.items() if c != i} and set(fetched) <= linked


@pytest.mark.parametrize("longer, held", [(1, 10**6), (1, 0), (3, 0)])
def test_texts_of_heavy_elements_lose_no_link(spark, monkeypatch, longer, held):
    monkeypatch.setattr(ngram_join, "HEAVY", 2)
    monkeypatch.setattr(ngram_join, "LONGER", longer)
    monkeypatch.setattr(ngram_join, "HELD_HEAVY", held)
    texts = _passages(random.Random(4), [1, 2, 9, 9, 9, 9, 12, 15, 30])
    docs = spark.createDataFrame(list(texts.items()) * 2, "doc_id long, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.link_components(docs).collect()}
    assert got == brute_components(texts, 3, 90, 100)


def test_longer_heads_do_for_most_texts_of_heavy_elements(spark, monkeypatch):
    written, texts = [], _passages(random.Random(6), [9] * 12)
    monkeypatch.setattr(ngram_join, "HEAVY", 2)
    monkeypatch.setattr(ngram_join, "cut_lineage", lambda df, name, f=ngram_join.cut_lineage:
                        written.append((name, out := f(df, name), out.count() if name != "sets" else
                                        out.agg(F.sum(F.size("elements"))).first()[0] or 0)) or out)
    # words of their own beside a passage that many share
    texts = {i: t + " " + " ".join(f"o{i}x{j}" for j in range(120)) for i, t in texts.items()}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.link_components(docs).collect()}
    assert got == brute_components(texts, 3, 90, 100)
    assert 0 < sum(k for name, _, k in written if name == "sets") < 0.6 * sum(n for n, _ in got.values())


@pytest.mark.parametrize("limit", [0, 500_000])
def test_heads_and_sets_are_deleted(spark, monkeypatch, tmp_path, limit):
    monkeypatch.setattr(ngram_join, "HEAVY", 2)
    monkeypatch.setattr(ngram_join, "_BROADCAST_ROWS", limit)
    texts = _passages(random.Random(7), [0, 1, 9, 15])
    monkeypatch.setattr("salescope.session.checkpoint_dir", lambda spark: str(tmp_path))
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.link_components(docs).collect()}
    assert got == brute_components(texts, 3, 90, 100)
    assert {p.name.split("-")[1] for p in tmp_path.glob("salescope-*")} <= {"shingles", "classes", "cc"}


def test_heavy_elements_alone_are_shuffled(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "HELD_HEAVY", 0)
    rows = spark.createDataFrame([(1, 7, 8, 3, [1, 5, 9]), (1, 7, 9, 3, [2, 5, 6])], "rep long, s1 long, s2 long, n long, elements array<long>")
    out = ngram_join._light_first(rows, spark.createDataFrame([(5,), (9,)], "h long"))
    assert sorted(map(tuple, out.collect())) == [(1, 7, 8, 3, [1, 5, 9], 1), (1, 7, 9, 3, [2, 6, 5], 2)]
    exploded = re.findall(r"Generate explode\(elements#\d+\), (\[[^\]]*\])", out._jdf.queryExecution().executedPlan().toString())
    assert exploded and all(re.fullmatch(r"\[rep#\d+L\]", x) for x in exploded)


def test_pipeline_stages_tell_texts_of_an_id_apart(spark):
    import corpus_pipeline
    words = lambda t: " ".join(f"{t}{k}" for k in range(30))
    docs = spark.createDataFrame([(1, words("a"), "s"), (2, words("a"), "s"), (2, words("b"), "s"), (2, words("b"), "s")],
                                 "doc_id long, text string, source string")
    got = corpus_pipeline.drop_near_duplicates(spark, docs, "")
    assert got.columns == docs.columns and sorted((r.doc_id, r.text[0]) for r in got.collect()) == [(1, "a"), (2, "b")]
    many = spark.createDataFrame([(k % 500, f"{k}", "hot" if k % 3 else f"s{k % 7}") for k in range(3000)],
                                 "doc_id long, text string, source string")
    mixed = mixing.pfair_mix(many.select(F.struct("doc_id", F.xxhash64("text")).alias("key"), "source"), id_col="key")
    assert corpus_pipeline.mix_sources(spark, many, "").count() == mixed.filter("in_mix").count() < 3000


def test_ngram_join_on_the_documents(spark):
    texts = {r.doc_id: r.text for r in read_table(spark, SF, "documents").collect()}
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in queries.QUERIES["op7_ngram_jaccard_join"](spark, SF).collect()}
    assert got == brute_components(texts, 3, 90, 100)


def test_subset_sizes_cover_every_linked_pair_of_small_sets():
    for num, den in ((90, 100), (80, 100)):
        for n in range(1, 30):
            for t in range(n, 30):
                for both in range(n + 1):
                    if both * den >= num * (n + t - both):
                        c = -(-num * t // den)
                        assert both >= c and c in ngram_join._subset_sizes(n, 29, num, den)
                        assert c in ngram_join._subset_sizes(t, 29, num, den)


def test_components_on_chains_and_stars(spark):
    edges = [(k, k + 1) for k in range(100, 140)] + [(7, k) for k in range(200, 230)] + [(5, 5), (300, 301)]
    random.Random(1).shuffle(edges)
    edges = [(b, a) if k % 2 else (a, b) for k, (a, b) in enumerate(edges)]
    got = {r.node: r.component for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    want = {k: 100 for k in range(100, 141)} | {k: 7 for k in [7, *range(200, 230)]} | {300: 300, 301: 300}
    assert got == want


def brute_ctw(train, depth):
    nodes, pad = {}, [10] * depth
    for s in train:
        x = pad + list(s)
        for i in range(depth, len(x)):
            for k in range(8):
                pre, bit = (1 << k) | (x[i] >> (8 - k)), (x[i] >> (7 - k)) & 1
                for d in range(depth + 1):
                    nodes.setdefault((pre, tuple(x[i - d:i])), [0, 0])[bit] += 1
    children = defaultdict(list)
    for pre, c in nodes:
        if c:
            children[pre, c[1:]].append((pre, c))

    def log_kt(a, b):
        return math.lgamma(a + .5) + math.lgamma(b + .5) - math.lgamma(a + b + 1) - 2 * math.lgamma(.5)

    def log_pw(node):
        e = log_kt(*nodes[node])
        return e if len(node[1]) == depth else math.log(.5) + np.logaddexp(e, sum(map(log_pw, children[node])))

    def score(s):
        x, total = pad + list(s), 0.0
        for i in range(depth, len(x)):
            for k in range(8):
                pre, bit, p = (1 << k) | (x[i] >> (8 - k)), (x[i] >> (7 - k)) & 1, None
                for d in range(depth, -1, -1):
                    node = (pre, tuple(x[i - d:i]))
                    if node in nodes:
                        n = nodes[node]
                        kt = (n[bit] + .5) / (sum(n) + 1)
                        w = 1.0 if p is None else math.exp(math.log(.5) + log_kt(*n) - log_pw(node))
                        p = w * kt + (1 - w) * (p or 0)
                total += math.log10(.5 if p is None else p)
        return total
    return score


def test_lm_scores_equal_brute_force(spark):
    rnd = random.Random(1)
    texts = [(i, " ".join("".join(rnd.choice("abcÉ") for _ in range(rnd.randint(1, 4))) for _ in range(rnd.randint(0, 9))))
             for i in range(20)] + [(40, None), (41, ""), (42, "zzz qqq")]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    got = lm_score.score_texts(docs, F.col("doc_id") % 5 != 1, depth=2, block_bytes=150).collect()
    train = [lm_score._words(t) for i, t in texts if i % 5 != 1]
    score, of = brute_ctw([lm_score._stream(w) for w in train], 2), dict(texts)
    counts = Counter(x for w in train for x in [*w, b"\n"])
    n, v = sum(counts.values()), len(counts)
    for r in got:
        own = lm_score._words(of[r.doc_id])
        assert r.score == pytest.approx(score(lm_score._stream(own)), abs=1e-9)
        assert r.base_score == pytest.approx(sum(math.log10((counts[x] + .5) / (n + .5 * (v + 1))) for x in [*own, b"\n"]), abs=1e-9)
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(own) + 1, sum(counts[x] > 0 for x in [*own, b"\n"]), n)


def test_lm_probabilities_of_a_context_sum_to_one():
    rnd = np.random.default_rng(3)
    stream = np.frombuffer(bytes(rnd.choice(list(b"ab c"), 300).tolist()), np.uint8)
    grams, n = np.unique(lm_score._grams(stream, 2), return_counts=True)
    before = (grams >> np.uint64(8)) & np.uint64(255)
    parts = [lm_score.subtree_roots(grams[before == b], n[before == b], 2) for b in np.unique(before)]
    root = lm_score.root_nodes(*[np.concatenate(c) for c in zip(*parts)])
    context = grams[0] >> np.uint64(8)
    alike = before == (context & np.uint64(255))
    own = grams[alike]
    every = np.unique(np.concatenate([own, (context << np.uint64(8)) | np.arange(256, dtype=np.uint64)]))
    count = np.zeros(len(every), np.int64)
    count[np.searchsorted(every, own)] = n[alike]
    p = 10 ** lm_score.log10_probabilities(every, count, 2, root)
    assert p[(every >> np.uint64(8)) == context].sum() == pytest.approx(1)


def test_held_out_language_accuracy(spark):
    docs = read_table(spark, "/root/testdata/sf0.01", "documents").select("doc_id", "lang")
    got = queries.QUERIES["op5_language_id"](spark, "/root/testdata/sf0.01").filter("held_out").join(docs, "doc_id")
    right, n = got.agg(F.sum((F.col("lang") == F.col("lang_pred")).cast("int")), F.count("lang")).first()
    assert right / n > 0.95


def test_held_out_quality_and_toxicity(spark):
    sf = "/root/testdata/sf0.1"
    docs, labels = read_table(spark, sf, "documents"), read_table(spark, sf, "labels")
    train = labels.filter(id_split("doc_id", 4) != 1)
    got = quality.classify(docs, train).join(labels.filter(id_split("doc_id", 4) == 1), "doc_id")
    r = got.agg(F.avg(((F.col("score") >= .5) == (F.col("quality") == 1)).cast("int")),
                F.avg(((F.col("toxic_score") >= .5) == (F.col("toxic") == 1)).cast("int"))).first()
    assert min(r) > 0.95


def test_alignment_finds_edited_copies(spark):
    rnd = random.Random(5)
    vocabulary = [f"w{k}" for k in range(3000)]
    items = [[rnd.choice(vocabulary) for _ in range(40)] for _ in range(6)]
    rows, want = [], set()
    for i in range(60):
        w = [rnd.choice(vocabulary) for _ in range(rnd.randint(0, 200))]
        if i % 3 == 0:
            k = rnd.randrange(6)
            copy = [x for x in items[k] if rnd.random() > 0.07]
            copy = [rnd.choice(vocabulary) if rnd.random() < 0.07 else x for x in copy]
            at = rnd.randint(0, len(w))
            w[at:at] = copy
            want.add((i, k))
        rows.append((i, " ".join(w)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    tests = spark.createDataFrame([(k, " ".join(x)) for k, x in enumerate(items)], "item_id long, text string")
    assert {(r.doc_id, r.item_id) for r in decontaminate.contaminated(docs, tests).collect()} == want
    # blocks of items give the same rows
    assert {(r.doc_id, r.item_id) for r in decontaminate.contaminated(docs, tests, block_bytes=300).collect()} == want


def test_single_edited_and_half_copies_are_found(spark):
    words = lambda t, n: [f"{t}{k}" for k in range(n)]
    items = [words(t, 40) for t in "abcd"]
    docs = [[x if k % 4 else f"other{k}" for k, x in enumerate(items[0])],       # every 4th word replaced
            [x if k % 5 else f"other{k}" for k, x in enumerate(items[1])],
            items[2][:21],                                                      # half a copy
            items[3][20:] + words("y", 90) + items[3][:20],                     # two parts, each below half
            items[3][:10] + ["new"] * 15 + items[3][10:]]                       # an insertion
    docs = [words("x", 30) + d + words("z", 30) for d in docs]
    docs += [words("x", 5) + items[0][:4] for _ in range(50)]                   # a common passage
    docs = spark.createDataFrame([(k, " ".join(d)) for k, d in enumerate(docs)], "doc_id long, text string")
    tests = spark.createDataFrame([(k, " ".join(x)) for k, x in enumerate(items)], "item_id long, text string")
    got = {(r.doc_id, r.item_id): round(r.score, 4) for r in decontaminate.contaminated(docs, tests).collect()}
    assert got == {(0, 0): 0.6375, (1, 1): 0.7125, (2, 2): 0.525, (3, 3): 0.5, (4, 3): 0.8125}


def test_left_out_stretches_hold_no_match():
    rnd = np.random.default_rng(1)
    for _ in range(300):
        item, window = rnd.integers(0, 12, 10).astype(np.uint64), rnd.integers(0, 40, 60).astype(np.uint64)
        at = rnd.integers(0, 40)
        window[at:at + 2 * rnd.integers(1, 6):2] = item[:len(window[at:at + 2 * rnd.integers(1, 6):2])][0]
        whole = decontaminate.local_alignment(item, window)[0]
        parts = [decontaminate.local_alignment(item, window[a:b])[0]
                 for a, b in decontaminate._dense(np.unique(item), len(item), window, 0.5)]
        assert max(parts, default=0) == whole if whole >= 0.5 else max(parts, default=0) < 0.5


def test_alignment_score_equals_the_textbook_recursion():
    rnd = np.random.default_rng(0)
    for _ in range(40):
        a, b = rnd.integers(0, 4, rnd.integers(1, 9)), rnd.integers(0, 4, rnd.integers(1, 12))
        h = np.zeros((len(a) + 1, len(b) + 1), int)
        for i in range(1, len(a) + 1):
            for j in range(1, len(b) + 1):
                h[i, j] = max(0, h[i - 1, j - 1] + (2 if a[i - 1] == b[j - 1] else -1), h[i - 1, j] - 1, h[i, j - 1] - 1)
        assert decontaminate.align(a, b)[0] == h.max()


def test_rare_seeds_lose_no_pair_of_any_alignment(spark):
    """Equal to Smith-Waterman on all pairs of edited copies and clean texts, 20 to 35 % of the words replaced."""
    rnd = random.Random(12)
    common = [f"c{k}" for k in range(25)]
    word = lambda: rnd.choice(common) if rnd.random() < 0.5 else f"w{rnd.randrange(4000)}"
    items = [[word() for _ in range(n)] for n in (7, 9, 14, 20, 30, 41, 55, 60)]
    docs = []
    for k in range(240):
        item, rate = items[k % 8], rnd.choice([0, 0.2, 0.25, 0.3, 0.35])
        copy = [x if rnd.random() > rate else word() for x in item]
        if k % 5 == 1:
            copy = [x for x in copy if rnd.random() > 0.12]
        if k % 5 == 2:
            copy = [y for x in copy for y in ([x, word()] if rnd.random() < 0.15 else [x])]
        if k % 5 == 3:
            copy = copy[:2 * len(copy) // 3]
        docs.append([word() for _ in range(rnd.randrange(60))] + copy * (k % 7 != 6) + [word() for _ in range(rnd.randrange(60))])
    third = [x if k % 3 else f"other{k}" for k, x in enumerate(items[7], 1)]          # no three words in a row
    docs.append([*common, *third, *common])
    want = set()
    for i, d in enumerate(docs):
        for j, x in enumerate(items):
            names = {w: n for n, w in enumerate({*d, *x})}
            score = decontaminate.align(np.array([names[w] for w in x]), np.array([names[w] for w in d]))[0]
            if score >= 0.5 * 2 * len(x):
                want.add((i, j))
    frame = spark.createDataFrame([(k, " ".join(d)) for k, d in enumerate(docs)], "doc_id long, text string")
    tests = spark.createDataFrame([(k, " ".join(x)) for k, x in enumerate(items)], "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in decontaminate.contaminated(frame, tests).collect()}
    assert got == want and len(want) > 120 and (240, 7) in want


def test_items_of_one_or_two_words_must_occur_whole(spark):
    docs = spark.createDataFrame([(1, "an abracadabra here"), (2, "open sesame now"), (3, "open the sesame")], "doc_id long, text string")
    tests = spark.createDataFrame([(1, "Abracadabra!"), (2, "open sesame"), (3, "...")], "item_id long, text string")
    assert {(r.doc_id, r.item_id) for r in decontaminate.contaminated(docs, tests).collect()} == {(1, 1), (2, 2)}


def test_leaked_items_are_found_however_common(spark):
    item = " ".join(f"a{k}" for k in range(30))
    docs = spark.createDataFrame([(i, f"x{i} y{i} {item if i % 2 else 'none'} z{i}") for i in range(200)], "doc_id long, text string")
    tests = spark.createDataFrame([(1, item)], "item_id long, text string")
    assert sorted(r.doc_id for r in decontaminate.contaminated(docs, tests).collect()) == list(range(1, 200, 2))


def test_documents_with_whole_test_items_are_found(spark):
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    sf = "/root/testdata/sf0.01"
    flat = lambda t: " " + " ".join(word.findall(t.translate(LOWER))) + " "
    items = [(r.item_id, flat(r.text)) for r in read_table(spark, sf, "benchmark").collect()]
    want = {(r.doc_id, i) for r in read_table(spark, sf, "documents").collect() for i, t in items if t in flat(r.text)}
    got = {(r.doc_id, r.item_id) for r in queries.QUERIES["op4_decontaminate"](spark, sf).collect()}
    assert want and got >= want and len(got) <= 1.1 * len(want)


def test_pfair_deviation_stays_under_one_block():
    rnd = random.Random(2)
    for weights in ([1], [1, 1], [7, 2, 1], [rnd.randrange(1, 100) for _ in range(23)], [10 ** 6, 999, 7, 1],
                    [int(1e6 / (k + 1) ** 1.3) for k in range(120)]):
        scale = 6000 / sum(weights)
        blocks = [max(1, round(w * scale * rnd.choice([1, 1, 0.4]))) for w in weights]
        total = sum(weights)
        done, first = [0] * len(weights), None
        for t, (s, k, release, deadline, slot) in enumerate(mixing.schedule(weights, blocks)):
            assert slot == t and release <= slot < deadline and k == done[s]
            done[s] += 1
            if (t + 1) * max(w / b for w, b in zip(weights, blocks)) < total:           # no source has left
                assert all(abs(d * total - w * (t + 1)) < total for d, w in zip(done, weights))
                first = t
        assert done == blocks and first is not None
        def spent(v):
            return sum(min(b, w * v) for w, b in zip(weights, blocks))
        for s, w in enumerate(weights):
            for release, deadline, k in list(mixing.windows(w, blocks[s], mixing.phases(weights, blocks)))[:50]:
                assert release == math.floor(spent(Fraction(k, w))) and deadline == math.ceil(spent(Fraction(k + 1, w)))


def test_the_output_keeps_the_target_weights(spark):
    sizes = {"hot": 30000, "b": 9000, "c": 2500, "d": 700, "e": 130, "f": 21}
    docs = spark.createDataFrame([(k, s) for s, n in sizes.items() for k in range(n)], "doc_id long, source string")
    weights = {"hot": 0.6, "b": 0.3, "c": 0.07, "d": 0.02, "e": 0.009, "f": 0.001}
    got = mixing.pfair_mix(docs, weights=weights, block_rows=8).groupBy("slot", "source", "in_mix").count().collect()
    done, total = Counter(), sum(map(Fraction, weights.values()))
    leaves = min(-(-n // 8) / weights[s] for s, n in sizes.items())
    checked = 0
    for r in sorted((r for r in got if r.in_mix), key=lambda r: r.slot):
        done[r.source] += 1
        if r.slot + 1 < leaves:
            checked += 1
            assert all(abs(done[s] - Fraction(w) / total * (r.slot + 1)) < 1 for s, w in weights.items())
    assert checked == 1888       # e leaves after 17 / 0.009 slots


def test_blocks_grow_with_the_corpus(spark, monkeypatch):
    monkeypatch.setattr(mixing, "SLOTS", 50)
    docs = spark.range(5000).selectExpr("id doc_id", "if(id % 3 = 0, 'a', 'b') source")
    got = mixing.pfair_mix(docs).collect()
    assert len(got) == 5000 and max(r.block_row for r in got) == 99 and max(r.slot for r in got) <= 52
    assert all(r.release <= r.slot < r.deadline for r in got)


def test_mixture_of_the_documents(spark):
    rows = queries.QUERIES["op2_pfair_mix"](spark, "/root/testdata/sf0.01").collect()
    assert len(rows) == 1000 and all(r.release <= r.slot < r.deadline for r in rows)
    per_slot = Counter((r.slot, r.source) for r in rows)
    assert max(per_slot.values()) <= 16 and len({s for s, _ in per_slot}) == len(per_slot)
    end = max(r.slot for r in rows if r.in_mix)
    assert {r.slot for r in rows if r.in_mix} == set(range(end + 1))


def test_a_rare_source_does_not_end_the_mixture(spark):
    rows = [(k, "abcd"[k % 4] if k >= 3 else None) for k in range(40003)]
    got = mixing.pfair_mix(spark.createDataFrame(rows, "doc_id long, source string"), block_rows=1).collect()
    assert len(got) == len({r.slot for r in got}) == 40003 and max(r.slot for r in got) == 40002
    assert sum(r.in_mix for r in got) >= 39900 and all(r.in_mix for r in got if not r.source)
    assert {r.slot for r in got if r.in_mix} == set(range(sum(r.in_mix for r in got)))
    # a, b, c and d stay within a block of each other, and of the rounded frames
    done = Counter()
    for r in sorted(got, key=lambda r: r.slot):
        assert r.release <= r.slot < r.deadline and r.block == done[r.source]
        done[r.source] += 1
        assert not r.in_mix or max(done[s] for s in "abcd") - min(done[s] for s in "abcd") <= 2


def test_only_the_surplus_over_the_weight_is_held_back(spark):
    rows = [(k, f"s{k % 1500}") for k in range(6000)] + [(k, "hot") for k in range(6000, 9000)]
    docs = spark.createDataFrame(rows, "doc_id long, source string")
    got = mixing.pfair_mix(docs, weights={"hot": 1500.0} | {f"s{k}": 6.0 for k in range(1500)}, block_rows=1).collect()
    held = [r for r in got if not r.in_mix]
    assert len(got) == 9000 and {r.source for r in held} == {"hot"} and len(held) == 3000 - 9000 // 7 - 1


def test_recurring_subtrees_of_a_host_are_deleted(spark):
    body = "<html><body><div>Site name and slogan</div><div><p>story number {k} of the day</p></div><div>All the small print</div></body></html>"
    pages = [(k, "https://one.example/a", body.format(k=k)) for k in range(8)]
    # copies of one page are no template; neither is another host's only page
    pages += [(100 + k, "https://two.example/a", body.format(k=1)) for k in range(8)]
    got = {r.page_id: r.text for r in html_extract.extract(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}
    assert all(got[k] == f"story number {k} of the day" for k in range(8))
    assert all(got[100 + k] == "Site name and slogan\nstory number 1 of the day\nAll the small print" for k in range(8))


def test_paragraphs_of_articles_stay_however_often_they_recur(spark):
    page = "<nav>menu</nav><article><p>the same passage</p><p>own {k}</p><div>share box</div></article><div class='comments'>first!</div>"
    pages = [(k, "https://one.example/a", page.format(k=k)) for k in range(6)]
    got = {r.page_id: r.text for r in html_extract.extract(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}
    assert got == {k: f"the same passage\nown {k}" for k in range(6)}


def texts_of(spark, pages):
    pages = spark.createDataFrame(pages, "page_id long, url string, html string")
    return {r.page_id: r.text for r in html_extract.extract(pages).collect()}


def test_marked_elements_go_only_if_their_mark_recurs(spark):
    page = "<article><h1>own {k}</h1><p>text {k}</p><div class='related'>see {k}</div>{more}</article>"
    more = {2: "<h2 id='related-work'>Related work</h2><section id='social-impact'><p>on society</p></section>"}
    got = texts_of(spark, [(k, "https://one.example/a", page.format(k=k, more=more.get(k, ""))) for k in range(6)])
    assert got == {k: f"own {k}\ntext {k}" + "\nRelated work\non society" * (k == 2) for k in range(6)}


def test_all_mains_and_the_text_beside_articles_are_read(spark):
    page = "<main><p>cookies on this site</p><article><p>own {k}</p></article><p>beside {k}</p></main><main><p>second {k}</p></main>"
    got = texts_of(spark, [(k, "https://one.example/a", page.format(k=k)) for k in range(6)])
    assert got == {k: f"own {k}\nbeside {k}\nsecond {k}" for k in range(6)}


def test_templates_are_found_among_copies_and_on_large_hosts(spark):
    body = "<body><div>Site slogan</div><div><p>story {k}</p></div>{more}</body>"
    copied = [(k, "https://one.example/a", body.format(k=min(k, 5), more="")) for k in range(400)]
    assert all(x == f"story {min(k, 5)}" for k, x in texts_of(spark, copied).items())
    banner = [(k, "https://two.example/a", body.format(k=k, more="<div>Section banner</div>" * (k < 24))) for k in range(1600)]
    assert all(x == f"story {k}" for k, x in texts_of(spark, banner).items())


def test_blocks_of_most_texts_of_a_host_go_also_from_articles(spark, monkeypatch):
    page = "<article><p>This site uses cookies</p><p>own {k}</p>{more}</article>"
    pages = [(k, "https://one.example/a", page.format(k=k, more="<p>a shared passage</p>" * (k % 3 == 0))) for k in range(30)]
    pages += [(100 + k, "https://two.example/a", page.format(k=k, more="")) for k in range(12)]       # too few to tell
    want = {k: f"own {k}" + "\na shared passage" * (k % 3 == 0) for k in range(30)}
    want |= {100 + k: f"This site uses cookies\nown {k}" for k in range(12)}
    assert texts_of(spark, pages) == want
    monkeypatch.setattr(html_extract, "BROADCAST_BLOCKS", 0)
    assert texts_of(spark, pages) == want


def test_named_parts_go_from_a_host_of_one_page(spark):
    page = ("<div class='site-header'>Site</div><div id='menu'>a b</div><div class='text'><p class='ad-hoc'>story</p>"
            "<div id='ads-in-history'>more</div></div><div class='list comments'>hi</div><div class='footer'>f</div>")
    article = "<article><p>own</p><section class=comments>reader says hi</section><h2 id='footer'>notes</h2></article>"
    got = texts_of(spark, [(1, "https://one.example/a", page), (2, "https://two.example/a", article)])
    assert got == {1: "story\nmore", 2: "own\nnotes"}


def test_templates_against_a_plain_counter(spark):
    rnd = random.Random(8)
    parts = [f"part {k}" for k in range(40)]
    pages, plain = [], {}
    for k in range(120):
        host, own = f"h{k % 3}", [parts[int(40 * rnd.random() ** 2)] for _ in range(6)]
        plain[k] = (host, [*own, f"text {k}"])
        pages.append((k, f"https://{host}.example/", "<body>" + "".join(f"<div>{x}</div>" for x in plain[k][1]) + "</body>"))
    want = {}
    for k, (host, blocks) in plain.items():
        mates = [set(b) for h, b in plain.values() if h == host]
        often = {x: sum(x in m for m in mates) for x in blocks}
        want[k] = "\n".join(x for x in blocks if not (often[x] >= 3 and often[x] >= min(0.02 * len(mates), 20)))
    assert texts_of(spark, pages) == want


def test_pages_of_open_tags_are_read_in_a_moment():
    import time
    start = time.monotonic()
    for page in ("<div>" * 100_000 + "x", "<nav>" * 50_000 + "<article>x</article>", "<p><b>" * 50_000 + "</i>" * 50_000 + "x"):
        text, _ = html_extract._read(page)
        assert text == "x"
    assert time.monotonic() - start < 30


def test_pages_give_their_articles(spark):
    import html
    pages = {r.page_id: r.html for r in read_table(spark, SF, "pages").collect()}
    for r in queries.QUERIES["op9_template_removal"](spark, SF).collect():
        m = re.search(r"<article>(.*?)(?:</article>|$)", pages[r.page_id], re.S)
        inner = re.sub(r"<br>", " ", re.sub(r"</?b>", "", m[1] if m else ""))
        blocks = [" ".join(html.unescape(x).split()) for x in re.split(r"</?(?:p|h1)>", inner)]
        assert r.text == "\n".join(b for b in blocks if b)
