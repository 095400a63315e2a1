"""Benchmark decontamination: n-gram seeds, then Smith-Waterman alignment.

1. A document and an item meet by the item's n-grams: by one of its rarest, and by as
   many of all as an alignment at the threshold leaves intact.  A replaced or left-out
   word costs three points of the alignment's score and breaks two pairs of words, so
   a copy that reaches the threshold keeps a known number of pairs (``least_seeds``),
   and one of any set that leaves out fewer: the item's most common pairs, by the
   number of items that hold them, are not needed to find it.
2. Where a seed occurs, stretches that hold too few of the item's words for the
   threshold are left out: no alignment with them could reach it.
3. The item is aligned with the words that are left by local alignment.  The
   score is that of the best alignment over the score of a perfect copy, so
   paraphrased, cut and edited copies score high, too.

Test items are a stated query set.  They are handled in blocks of bounded size
(``block_bytes`` of item text); only a block's words and seeds are broadcast.
Documents never move: the pass is narrow.
"""

from __future__ import annotations

import math
from collections import OrderedDict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textbytes as tb
from .inputs import pick, share

#: words of a seed (items of fewer than three times as many words: one more, or the whole item)
SEED = 2
#: least share of a perfect copy's alignment score
THRESHOLD = 0.5
_MATCH, _MISMATCH, _GAP = 2, -1, -1
_CACHE = 20_000


def seed_length(length: int, n: int) -> int:
    """Words of the seeds of an item of ``length`` words."""
    return n if length >= 3 * n else min(length, n + 1)


def least_seeds(length: int, n: int, threshold: float) -> int:
    """How many of an item's seeds occur in a text that reaches the threshold.  The
    alignment may lose ``2 * (1 - threshold) * length`` points: a replaced or missing
    word costs three and breaks ``n`` seeds, a word cut off at the ends costs two and
    breaks one, an added word costs one and breaks ``n - 1`` (up to half of the loss
    may be added words; beyond that a single seed finds the text, if one is intact)."""
    if length < 3 * n:
        return 1
    loss = 2 * (1 - threshold) * length
    return max(1, math.ceil(length - (n - 1) - loss / 2 * (n - 1) - loss / 2 * n / 3 - 1e-9))


def span(length: int, threshold: float) -> int:
    """Most words over which an alignment at the threshold spreads."""
    return math.ceil(length * (3 - 2 * threshold))


class Seeds:
    """The n-grams of the items of a block that have seeds of ``n`` words: sorted grams,
    and the (item, place) pairs behind each; ``rare`` marks those that find an item."""

    def __init__(self, n: int, grams: np.ndarray, items: np.ndarray, places: np.ndarray, need: np.ndarray):
        self.n, self.least = n, int(need[items].min())
        self.grams, of = np.unique(grams, return_inverse=True)
        held = np.unique(np.stack([of, items]), axis=1)[0] if len(of) else of
        common = np.bincount(held, minlength=len(self.grams))[of]
        # the least common of every item first; all but need - 1 of them are seeds
        order = np.lexsort((grams, common, items))
        first = np.searchsorted(items[order], items[order], "left")
        last = np.searchsorted(items[order], items[order], "right")
        rare = np.zeros(len(of), bool)
        rare[order] = np.arange(len(of)) - first < last - first - (need[items[order]] - 1)
        by_gram = np.argsort(of, kind="stable")
        self.items, self.places, self.rare = items[by_gram], places[by_gram], rare[by_gram]
        self.start = np.searchsorted(of[by_gram], np.arange(len(self.grams) + 1))

    def behind(self, grams: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(index of the gram given, index of the pair) of all pairs behind grams."""
        size = self.start[grams + 1] - self.start[grams]
        of = np.repeat(np.arange(len(grams)), size)
        return of, np.arange(len(of)) - np.repeat(np.cumsum(size) - size, size) + self.start[grams][of]


class Items:
    """A block of test items: word hashes and seeds."""

    def __init__(self, ids: list, texts: list, n: int, threshold: float):
        column = pa.array(texts, pa.string())
        self.ids, self.words = list(ids), []
        for a, b, data, offsets in tb.slices(column):
            words, rows = tb.word_hashes(data, offsets, tb.WORD_BYTES)
            at = np.searchsorted(rows, np.arange(b - a + 1))
            self.words += [words[at[k]:at[k + 1]] for k in range(b - a)]
        self.distinct = [np.unique(words) for words in self.words]
        self.need = np.array([least_seeds(len(w), n, threshold) for w in self.words], np.int64)
        self.span = np.array([span(len(w), threshold) for w in self.words], np.int64)
        self.seeds = []
        for k in sorted({seed_length(len(w), n) for w in self.words if len(w)}):
            parts = [(item, *tb.ngram_hashes(w, np.zeros(len(w), np.int64), k))
                     for item, w in enumerate(self.words) if len(w) and seed_length(len(w), n) == k]
            self.seeds.append(Seeds(k, np.concatenate([g for _, g, _ in parts]),
                                    np.concatenate([np.full(len(g), item) for item, g, _ in parts]),
                                    np.concatenate([at for _, _, at in parts]), self.need))

    def hits(self, column: pa.Array):
        """(row, words of the row, item, places in the row where the item may start) of the
        rows and items that have enough seeds in common."""
        for a, _, data, offsets in tb.slices(column):
            words, rows = tb.word_hashes(data, offsets, tb.WORD_BYTES)
            for seeds in self.seeds:
                grams, at = tb.ngram_hashes(words, rows, seeds.n)
                if not len(grams):
                    continue
                k = np.searchsorted(seeds.grams, grams)
                k[k == len(seeds.grams)] = 0
                found = np.flatnonzero(seeds.grams[k] == grams)
                if not len(found):
                    continue
                of_row = rows[at[found]]
                for part in np.split(found, np.flatnonzero(np.diff(of_row)) + 1):
                    if len(part) < seeds.least:
                        continue
                    row = int(rows[at[part[0]]])
                    for item, starts in self._enough(seeds, k[part], at[part]):
                        lo, hi = np.searchsorted(rows, (row, row + 1))
                        yield a + row, words[lo:hi], item, np.unique(starts - lo)

    def _enough(self, seeds: Seeds, grams: np.ndarray, at: np.ndarray):
        """(item, places where it may start) of the items with enough seeds, one of them rare, and
        enough of them within the words that an alignment at the threshold may span."""
        pairs = seeds.behind(np.unique(grams))[1]
        count = np.bincount(seeds.items[pairs], minlength=len(self.need))
        rare = np.zeros(len(self.need), bool)
        rare[seeds.items[pairs[seeds.rare[pairs]]]] = True
        enough = rare & (count >= self.need)
        if not enough.any():
            return
        of, pairs = seeds.behind(grams)
        some = enough[seeds.items[pairs]]
        behind, pos, place = seeds.items[pairs[some]], at[of[some]], seeds.places[pairs[some]]
        order = np.lexsort((pos, behind))
        behind, pos, place = behind[order], pos[order], place[order]
        first = np.append(True, (np.diff(behind) != 0) | (np.diff(pos) != 0))       # an item at a place once
        item, spot = behind[first], pos[first]
        last = np.arange(len(item)) + self.need[item] - 1
        end = np.minimum(last, len(item) - 1)
        near = np.flatnonzero((last == end) & (item[end] == item) & (spot[end] - spot <= self.span[item]))
        if not len(near):
            return
        size = len(item) + 1
        inside = np.cumsum(np.bincount(near, minlength=size) - np.bincount(last[near] + 1, minlength=size)) > 0
        kept = np.flatnonzero(inside[np.cumsum(first) - 1])
        for part in np.split(kept, np.flatnonzero(np.diff(behind[kept])) + 1):
            yield int(behind[part[0]]), pos[part] - place[part]


def align(item: np.ndarray, window: np.ndarray) -> tuple[int, int, int]:
    """(score, end in item, end in window) of the best local alignment; the ends
    are exclusive, the first best in (item, window) order wins."""
    m = len(window)
    column = np.arange(m + 1) * -_GAP
    above, best = np.zeros(m + 1, np.int64), (0, 0, 0)
    for i, word in enumerate(item.tolist()):
        row = np.zeros(m + 1, np.int64)
        row[1:] = above[:-1] + np.where(window == word, _MATCH, _MISMATCH)
        row = np.maximum(np.maximum(row, above + _GAP), 0)
        row = np.maximum.accumulate(row + column) - column        # gaps along the window
        j = int(row.argmax())
        if row[j] > best[0]:
            best = (int(row[j]), i + 1, j)
        above = row
    return best


def local_alignment(item: np.ndarray, window: np.ndarray) -> tuple[float, int, int]:
    """(score of 0..1 against a perfect copy, first and end word in the window)."""
    score, i, j = align(item, window)
    if not score:
        return 0.0, 0, 0
    _, _, back = align(item[:i][::-1], window[:j][::-1])
    return score / (_MATCH * len(item)), j - back, j


def _windows(length: int, n_words: int, starts: np.ndarray):
    """Word ranges of a document around the sorted places where the item may start."""
    slack = length // 2 + 2
    lo, hi = np.maximum(starts - slack, 0), np.minimum(starts + length + slack, n_words)
    cuts = np.flatnonzero(lo[1:] > hi[:-1])
    return zip(lo[np.append(0, cuts + 1)].tolist(), hi[np.append(cuts, -1)].tolist())


def _dense(distinct: np.ndarray, length: int, window: np.ndarray, threshold: float):
    """Ranges of a window outside which no alignment reaches the threshold: one that
    does matches ``threshold`` of the item's words at least, and its gaps are too
    few to spread them over more than ``span`` words."""
    k = np.searchsorted(distinct, window)
    k[k == len(distinct)] = 0
    total = np.concatenate([[0], np.cumsum(distinct[k] == window)])
    words = min(span(length, threshold), len(window))
    at = np.flatnonzero(total[words:] - total[:-words or None] >= threshold * length - 1e-9)
    if not len(at):
        return
    cuts = np.flatnonzero(np.diff(at) > words)
    for lo, hi in zip(at[np.append(0, cuts + 1)].tolist(), at[np.append(cuts, -1)].tolist()):
        yield lo, hi + words


def _matches(items: Items, threshold: float):
    """A function from a text column to (row, item, score, first, last, places)."""
    cache: OrderedDict = OrderedDict()

    def aligned(item, words, lo, hi):
        key = (item, words[lo:hi].tobytes())
        if key not in cache:
            cache[key] = local_alignment(items.words[item], words[lo:hi])
            if len(cache) > _CACHE:
                cache.popitem(last=False)
        return cache[key]

    def regions(item, words, starts):
        length = len(items.words[item])
        for lo, hi in _windows(length, len(words), starts):
            for a, b in _dense(items.distinct[item], length, words[lo:hi], threshold):
                yield lo + a, lo + b

    def run(column):
        for row, words, item, starts in items.hits(column):
            found = [(s, lo + a, lo + b) for lo, hi in regions(item, words, starts)
                     for s, a, b in [aligned(item, words, lo, hi)] if s >= threshold]
            if found:
                s, a, b = max(found, key=lambda f: (f[0], -f[1]))
                yield row, items.ids[item], s, a, b - 1, len(found)
    return run


def _blocks(benchmark: DataFrame, n: int, threshold: float, block_bytes: int):
    """The item blocks, one at a time, in the driver."""
    size = benchmark.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, math.ceil(size / block_bytes))
    for b in range(blocks):
        own = benchmark.filter(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == b).select("item_id", "text").toArrow()
        yield Items(own["item_id"].to_pylist(), own["text"].to_pylist(), n, threshold)


def _prepared(docs: DataFrame, benchmark: DataFrame, n: int, threshold: float, block_bytes: int):
    for items in _blocks(benchmark, n, threshold, block_bytes):
        yield share(docs.sparkSession, items)


def contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                 item_col: str = "item_id", item_text_col: str = "text", seed: int = SEED,
                 threshold: float = THRESHOLD, block_bytes: int = 16 << 20) -> DataFrame:
    """``doc_id, item_id, score, first_word, last_word, places``: a row for every
    document and test item whose best alignment reaches ``threshold``.

    Words are ASCII letters and digits (A-Z lower-cased) and all non-ASCII
    characters.  ``places`` counts the separate regions that reach the
    threshold; the word range is that of the best one, the first on ties.  Null
    and empty texts match nothing; an item of one or two words must occur as a whole, one
    of three to five words with three in a row (at a ``seed`` of two).  Repeated document rows or items give repeated result rows.  An empty
    table on either side gives an empty result.
    """
    rows = pick(docs, doc_id=id_col, text=text_col)
    tests = pick(benchmark, item_id=item_col, text=item_text_col)
    types = [rows.schema["doc_id"].dataType.simpleString(), tests.schema["item_id"].dataType.simpleString()]
    schema = f"doc_id {types[0]}, item_id {types[1]}, score double, first_word long, last_word long, places long"
    out = docs.sparkSession.createDataFrame([], schema)
    for shared in _prepared(rows, tests, seed, threshold, block_bytes):
        def run(batches, shared=shared):
            match = _matches(shared(), threshold)
            for batch in batches:
                ids, found = batch.column(0).to_pylist(), list(match(batch.column(1)))
                if found:
                    row, item, score, first, last, places = zip(*found)
                    yield pa.record_batch([
                        pa.array([ids[r] for r in row], batch.schema.field(0).type), pa.array(item),
                        pa.array(score, pa.float64()), pa.array(first, pa.int64()),
                        pa.array(last, pa.int64()), pa.array(places, pa.int64())],
                        names=["doc_id", "item_id", "score", "first_word", "last_word", "places"])
        out = out.union(rows.mapInArrow(run, schema))
    return out


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id",
                      item_text_col: str = "text", seed: int = SEED, threshold: float = THRESHOLD,
                      block_bytes: int = 16 << 20) -> DataFrame:
    """The rows of ``docs`` without a match, all columns as they are."""
    at = docs.columns.index(text_col)
    tests = pick(benchmark, item_id=item_col, text=item_text_col)
    for shared in _prepared(docs.select(F.col(text_col).alias("text")), tests, seed, threshold, block_bytes):
        def run(batches, shared=shared):
            match = _matches(shared(), threshold)
            for batch in batches:
                keep = np.ones(batch.num_rows, bool)
                keep[[found[0] for found in match(batch.column(at))]] = False
                yield batch.filter(pa.array(keep))
        docs = docs.mapInArrow(run, docs.schema)
    return docs
