"""Quality classifier by co-training of a text view and a metadata view.

*Text view.*  Hashed words and the style of a text: shares of capital letters,
digits, symbols and exclamation marks, distinct words and lines, the commonest
word, word length and text length, each cut into quantile bins.
*Metadata view.*  Source, language and declared length of the row; never text.

Both views are logistic regressions that start from a bounded sample of labelled
rows.  In every round one pass over *all* other rows scores both views; the rows
that one view is confident about (as precise as ``confident`` on labelled rows, for
either class on its own) are pseudo-labelled for the *other* view.  What a view learns from them are the rates of its features in either class, summed in
Spark.  Their log ratios become the centre that the view's weights are drawn to
when it is refitted on the labelled rows: a feature that no labelled row has gets
its weight from the pseudo-labels, a well-covered one from the labels.  Rates do
not depend on how many rows there are, so the method behaves alike at every size.

Afterwards each view's output is calibrated on labelled rows that no training
saw, and the calibrated log odds are combined there, too.

The driver holds at most ``labelled_rows`` rows and, per round, one number per
feature, class and view (at most 2^``_WORD_BITS`` words and 400 other features).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textbytes as tb
from .inputs import pick, share

LABELLED_ROWS = 8000
#: a view is confident beyond the log odds at which this share of at least _SUPPORT labelled rows is right,
#: and where its own probability is _LEAST at least
ROUNDS, CONFIDENT, _SUPPORT, _LEAST = 3, 0.95, 20, 0.9
_STYLES, _BINS = 9, 12
#: words are hashed into 2^_WORD_BITS features, of which a view uses the _WORDS most telling ones
_WORD_BITS, _WORDS = 15, 1000
_META_BINS = 256

_UPPER = tb.byte_class([(65, 90)])
_LETTER = tb.byte_class([(65, 90), (97, 122), (0x80, 0xFF)])
_DIGIT = tb.byte_class([(48, 57)])
_SYMBOL = tb.byte_class([(33, 47), (58, 64), (91, 96), (123, 126)]) & ~np.isin(np.arange(256), [ord(c) for c in ".,;'\"-:"])


def _row_sums(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])
    return total[offsets[1:]] - total[offsets[:-1]]


def _texts(column: pa.Array):
    """(rows of a slice, styles, word features, row of each word)."""
    for a, b, data, offsets in tb.slices(column):
        size = np.maximum(np.diff(offsets), 1)
        words, rows = tb.word_hashes(data, offsets, tb.WORD_BYTES)
        n = np.bincount(rows, minlength=b - a)
        order = np.lexsort((words, rows))
        r, w = rows[order], words[order]
        new = np.ones(len(r), bool)
        new[1:] = (r[1:] != r[:-1]) | (w[1:] != w[:-1])
        run = np.diff(np.append(np.flatnonzero(new), len(r)))
        distinct = np.bincount(r[new], minlength=b - a)
        commonest = np.zeros(b - a)
        np.maximum.at(commonest, r[new], run)
        bins = (w[new] >> np.uint64(64 - _WORD_BITS)).astype(np.int64)
        lines = _row_sums(data == 10, offsets) + 1
        starts, ends, line_row = tb.word_spans(data, offsets, ~tb.byte_class([(10, 10)]))
        line_hash = tb.hash_spans(data, starts, ends)
        pairs = np.unique(np.stack([line_row.astype(np.uint64), line_hash]), axis=1)[0].astype(np.int64) if len(line_row) else line_row
        letters = _row_sums(_LETTER[data], offsets)
        some = np.maximum(n, 1)
        yield a, b, np.stack([
            _row_sums(_UPPER[data], offsets) / np.maximum(letters, 1), _row_sums(_DIGIT[data], offsets) / size,
            _row_sums(_SYMBOL[data], offsets) / size, _row_sums(data == 33, offsets) / size,
            distinct / some, commonest / some, letters / some,
            np.bincount(pairs, minlength=b - a) / np.maximum(lines, 1), np.log1p(n)], axis=1), bins, r[new]


# ---- model --------------------------------------------------------------------

class Logistic:
    """Logistic regression over rows of active feature indexes, its weights drawn
    to ``centre`` by an L2 penalty."""

    def __init__(self, centre: np.ndarray):
        self.centre, self.weights, self.bias = centre, centre.copy(), 0.0

    def fit(self, at: np.ndarray, rows: np.ndarray, y: np.ndarray, l2: float = 1.0, steps: int = 120) -> "Logistic":
        """``at[k]`` is active in row ``rows[k]``; Adam on the full batch."""
        n, w = len(y), np.append(self.centre, 0.0)
        m, v = np.zeros_like(w), np.zeros_like(w)
        for t in range(1, steps + 1):
            z = np.bincount(rows, w[at], n) + w[-1]
            gap = 1 / (1 + np.exp(-np.clip(z, -60, 60))) - y
            g = np.append(np.bincount(at, gap[rows], len(w) - 1) + l2 * (w[:-1] - self.centre), gap.sum()) / max(n, 1)
            m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
            w -= 0.15 * (m / (1 - 0.9 ** t)) / (np.sqrt(v / (1 - 0.99 ** t)) + 1e-9)
        self.weights, self.bias = w[:-1], float(w[-1])
        return self

    def log_odds(self, at: np.ndarray, rows: np.ndarray, n: int) -> np.ndarray:
        return np.bincount(rows, self.weights[at], n) + self.bias


def _two_views(a: np.ndarray, b: np.ndarray, y: np.ndarray, steps: int = 50) -> np.ndarray:
    """Logistic fit of y on two log odds and a constant (ridge Newton steps)."""
    x, w = np.stack([a, b, np.ones(len(a))], axis=1), np.zeros(3)
    for _ in range(steps):
        p = 1 / (1 + np.exp(-x @ w))
        h = (x * (p * (1 - p))[:, None]).T @ x + 1e-2 * np.eye(3)
        w += np.linalg.solve(h, x.T @ (y - p) - 1e-2 * w)
    return w


class Sample:
    """Labelled rows in the driver: features of both views, sparse."""

    def __init__(self, table: pa.Table):
        self.styles = np.array(table["styles"].to_pylist(), float).reshape(-1, _STYLES)
        words = table["words"].combine_chunks()
        self.word = words.flatten().to_numpy()
        self.word_row = np.repeat(np.arange(len(words)), np.diff(words.offsets.to_numpy()))
        meta = table["meta"].combine_chunks()
        self.meta = meta.flatten().to_numpy()
        self.meta_row = np.repeat(np.arange(len(meta)), np.diff(meta.offsets.to_numpy()))
        self.n = len(self.styles)


class Styles:
    """Quantile bins of the styles, cut on labelled rows; with the words behind
    them they are the features that a pass sums up."""

    size = _STYLES * _BINS + (1 << _WORD_BITS)

    def __init__(self, own: np.ndarray):
        self.cuts = [np.unique(np.quantile(own[:, k], np.linspace(0, 1, _BINS + 1)[1:-1])) for k in range(_STYLES)]

    def of(self, styles: np.ndarray, word: np.ndarray, word_row: np.ndarray):
        """(active features, row of each)."""
        bins = np.stack([np.searchsorted(c, styles[:, k], "right") + k * _BINS for k, c in enumerate(self.cuts)], axis=1)
        return (np.concatenate([bins.ravel(), word + _STYLES * _BINS]),
                np.concatenate([np.repeat(np.arange(len(styles)), _STYLES), word_row]))


def _sure(odds: np.ndarray, y: np.ndarray, confident: float) -> float:
    """The least log odds (of _LEAST at least) from which on a share ``confident`` of
    the rows is of class 1, _SUPPORT rows or more (infinite: none); rows of equal
    odds stay together."""
    order = np.argsort(-odds, kind="stable")
    right, n = np.cumsum(y[order]), np.arange(1, len(y) + 1)
    last = np.append(np.diff(odds[order]) != 0, True)
    good = np.flatnonzero(last & (n >= _SUPPORT) & (right >= confident * n))
    return max(float(odds[order][good[-1]]), np.log(_LEAST / (1 - _LEAST))) if len(good) else np.inf


def _telling_words(hits: np.ndarray, df: np.ndarray, good: float, n: float) -> np.ndarray:
    """The words whose class shares differ most: ``df`` of ``n`` rows have a word,
    ``hits`` of them among the ``good`` rows of class 1."""
    rate = good / n
    spread = np.sqrt(np.maximum(df * rate * (1 - rate) * np.maximum(1 - df / n, 0), 1e-9))
    z = np.where(df >= 5, np.abs(hits - df * rate) / spread, 0)
    best = np.argsort(-z, kind="stable")[:_WORDS]
    return np.sort(best[z[best] >= 5])


class Model:
    """Both views, and the combination of their calibrated log odds."""

    def __init__(self, sample: Sample, y: np.ndarray, held: np.ndarray, confident: float = CONFIDENT):
        """``y``: labels of the sample rows; ``held``: rows for calibration only."""
        self.sample, self.y, self.held, self.confident = sample, y, held, confident
        self.styles = Styles(sample.styles[~held])
        self.learned = [0, 0]                     # pseudo-labelled rows that each view was refitted with
        self.views, self.bounds = [None, None], [None, None]
        for k in (0, 1):
            self.refit(k, None)

    def _sample_view(self, k: int, rows: np.ndarray):
        """Active features of view ``k`` in the given sample rows, numbered from 0."""
        s = self.sample
        at, of = self.styles.of(s.styles, s.word, s.word_row) if k == 0 else (s.meta.astype(np.int64), s.meta_row)
        number = np.full(s.n, -1)
        number[rows] = np.arange(len(rows))
        use = number[of] >= 0
        return at[use], number[of[use]]

    def refit(self, k: int, found: tuple[np.ndarray, np.ndarray] | None) -> None:
        """Fit view ``k`` on the labelled rows; ``found``: rows of either class that
        the other view is confident about, and per class the rows with each feature."""
        train = np.flatnonzero(~self.held)
        y, size = self.y[train], (Styles.size, _META_BINS)[k]
        at, rows = self._sample_view(k, train)
        df, hits = np.bincount(at, minlength=size).astype(float), np.bincount(at, y[rows], size)
        good, n, centre = y.sum(), float(len(y)), np.zeros(size)
        if found is not None and found[0].max() > 0:
            # a class that the other view is never confident about has the rates of its labelled rows
            known = np.stack([(df - hits) / (n - good), hits / good])
            rates = np.where(found[0][:, None] > 0, found[1] / np.maximum(found[0], 1)[:, None], known)
            self.learned[k] = int(found[0].sum())
            # pseudo-labels weigh as much as the labelled rows of their class
            hits, df = hits + rates[1] * good, df + rates[1] * good + rates[0] * (n - good)
            centre = np.log((rates[1] + 2 / n) / (rates[0] + 2 / n))
            good, n = 2 * good, 2 * n
        active = np.arange(size)
        if k == 0:
            first = _STYLES * _BINS
            active = np.concatenate([np.arange(first), first + _telling_words(hits[first:], df[first:], good, n)])
        to = np.full(size, -1)
        to[active] = np.arange(len(active))
        use, centre = to[at] >= 0, centre[active]
        at, rows = to[at[use]], rows[use]
        if centre.any():                          # features are not independent: one factor for all, from the labels
            centre = max(_two_views(np.bincount(rows, centre[at], len(y)), np.zeros(len(y)), y)[0], 0.0) * centre
        self.views[k] = (to, Logistic(centre).fit(at, rows, y))
        odds = self.views[k][1].log_odds(at, rows, len(y))
        self.bounds[k] = (-_sure(-odds, 1 - y, self.confident), _sure(odds, y, self.confident))

    def log_odds(self, k: int, at: np.ndarray, rows: np.ndarray, n: int) -> np.ndarray:
        to, view = self.views[k]
        at = to[at]
        use = at >= 0
        return view.log_odds(at[use], rows[use], n)

    def finish(self) -> "Model":
        """Platt scaling per view, then the combination of the calibrated views."""
        rows = np.flatnonzero(self.held)
        odds = [self.log_odds(k, *self._sample_view(k, rows), len(rows)) for k in (0, 1)]
        truth = self.y[rows]
        self.scales = [_two_views(o, np.zeros_like(o), truth) for o in odds]
        self.combine = _two_views(*[s[0] * o + s[2] for s, o in zip(self.scales, odds)], truth)
        return self.bare()

    def bare(self) -> "Model":
        """Without the sample: what tasks need."""
        out = object.__new__(Model)
        out.__dict__.update({k: v for k, v in self.__dict__.items() if k not in ("sample", "y", "held")})
        return out

    def active(self, styles, word, word_row, meta, meta_row):
        """(active features, rows) of both views."""
        return self.styles.of(styles, word, word_row), (meta, meta_row)

    def probability(self, styles, word, word_row, meta, meta_row):
        """(combined, text view, metadata view) probabilities of rows."""
        n = len(styles)
        odds = [self.log_odds(k, *x, n) for k, x in enumerate(self.active(styles, word, word_row, meta, meta_row))]
        odds = [s[0] * o + s[2] for s, o in zip(self.scales, odds)]
        both = self.combine[0] * odds[0] + self.combine[1] * odds[1] + self.combine[2]
        return [1 / (1 + np.exp(-np.clip(x, -60, 60))) for x in (both, *odds)]


# ---- Spark ---------------------------------------------------------------------

def _metadata(source: str, lang: str, n_chars: str):
    """Feature indexes of the metadata view, in built-in expressions."""
    def bucket(c, first, size):
        return (F.pmod(F.xxhash64(F.coalesce(F.col(c).cast("string"), F.lit(""))), F.lit(size)) + first).cast("int")
    length = F.floor(2 * F.log2(1 + F.greatest(F.coalesce(F.col(n_chars).cast("double"), F.lit(0.0)), F.lit(0.0))))
    return F.array(bucket(source, 0, 160), bucket(lang, 160, 32),
                   (192 + F.least(length, F.lit(63))).cast("int"))


def _featurised(rows: DataFrame) -> DataFrame:
    def run(batches):
        for batch in batches:
            styles, words = [None] * batch.num_rows, [None] * batch.num_rows
            for a, b, s, w, r in _texts(batch.column(1)):
                cuts = np.searchsorted(r, np.arange(b - a + 1))
                for k in range(b - a):
                    styles[a + k], words[a + k] = s[k], w[cuts[k]:cuts[k + 1]]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), pa.array(styles, pa.list_(pa.float64())), pa.array(words, pa.list_(pa.int64()))],
                names=["doc_id", "meta", "styles", "words"])
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.select("doc_id", "text", "meta").mapInArrow(
        run, f"doc_id {kind}, meta array<int>, styles array<double>, words array<long>")


def _labelled(labels: DataFrame, targets: list[str], n: int) -> DataFrame:
    """At most ``n`` labelled ids, a repeatable sample by id hash, one row each.  An
    id with different values of a label counts as unlabelled."""
    known = labels.select("doc_id", *targets).filter(
        "doc_id is not null" + "".join(f" and {t} is not null" for t in targets))
    each = known.groupBy("doc_id").agg(*[f(t).alias(f"{t}_{f.__name__}") for t in targets for f in (F.min, F.max)])
    for t in targets:
        each = each.filter(F.col(f"{t}_min") == F.col(f"{t}_max")).withColumnRenamed(f"{t}_min", t)
    return each.select("doc_id", *targets).orderBy(F.xxhash64("doc_id"), "doc_id").limit(n)


def confident_sums(rows: DataFrame, models: dict[str, Model]) -> dict:
    """Per target and view: rows of either class that the *other* view is confident
    about, and per class the rows with each feature, over all ``rows`` (``text,
    meta``).  Every task adds up its own rows; the sums have a row per target, view,
    class and feature, whatever the number of rows."""
    names = sorted(models)
    shared = share(rows.sparkSession, {t: models[t].bare() for t in names})
    sizes = (Styles.size, _META_BINS)

    def run(batches):
        models = shared()
        total = [[np.zeros((2, s + 1), np.int64) for s in sizes] for _ in names]
        for batch in batches:
            meta = np.array(batch.column(1).to_pylist(), np.int64).reshape(-1, 3)
            for a, b, styles, word, row in _texts(batch.column(0)):
                n = b - a
                for t, name in enumerate(names):
                    m = models[name]
                    views = m.active(styles, word, row, meta[a:b].ravel(), np.repeat(np.arange(n), 3))
                    for k in (0, 1):
                        at, of = views[k]
                        odds, (low, high) = m.log_odds(1 - k, *views[1 - k], n), m.bounds[1 - k]
                        for label, sure in ((0, odds <= low), (1, odds >= high)):
                            total[t][k][label] += np.append(np.bincount(at[sure[of]], minlength=sizes[k]), sure.sum())
        for t in range(len(names)):
            for k in (0, 1):
                for label in (0, 1):
                    at = np.flatnonzero(total[t][k][label])
                    slot = np.full(len(at), 4 * t + 2 * k + label, np.int32)
                    yield pa.record_batch([pa.array(slot), pa.array(at.astype(np.int32)), pa.array(total[t][k][label][at])],
                                          names=["slot", "feature", "n"])
    sums = rows.select("text", "meta").mapInArrow(run, "slot int, feature int, n long").groupBy("slot", "feature").agg(
        F.sum("n").alias("n")).toArrow()
    slot, feature, n = (sums[c].to_numpy() for c in ("slot", "feature", "n"))
    out = {}
    for t, name in enumerate(names):
        for k in (0, 1):
            table = np.zeros((2, sizes[k] + 1))
            for label in (0, 1):
                own = slot == 4 * t + 2 * k + label
                table[label, feature[own]] = n[own]
            out[name, k] = (table[:, -1], table[:, :-1])
    return out


def train(docs: DataFrame, labels: DataFrame, targets: list[str], labelled_rows: int = LABELLED_ROWS,
          rounds: int = ROUNDS, confident: float = CONFIDENT) -> dict[str, Model | None]:
    """A model per 0/1 label column (None where the sample has one class only).
    ``docs``: ``doc_id, text, meta``; all rows but those of the sample are scored
    and may be pseudo-labelled in every round."""
    picked = _labelled(labels, targets, labelled_rows).toArrow()
    names = F.broadcast(docs.sparkSession.createDataFrame(picked.select(["doc_id"])))       # at most labelled_rows ids
    # one row per id, however often it occurs
    once = docs.join(names, "doc_id", "left_semi").groupBy("doc_id").agg(
        F.min(F.struct(F.xxhash64("text").alias("h"), "text", "meta")).alias("r")).select("doc_id", "r.text", "r.meta")
    table = _featurised(once).toArrow()
    table = table.take(np.argsort(table["doc_id"].to_numpy(), kind="stable"))
    truth = {d: [picked[t][k].as_py() for t in targets] for k, d in enumerate(picked["doc_id"].to_pylist())}
    y = np.array([[float(v > 0) for v in truth[d]] for d in table["doc_id"].to_pylist()]).reshape(-1, len(targets))
    held = np.arange(len(y)) % 4 == 0
    sample = Sample(table)
    both = [all(set(np.unique(y[m, k])) == {0.0, 1.0} for m in (held, ~held)) for k in range(len(targets))]
    models = {t: Model(sample, y[:, k], held, confident) for k, t in enumerate(targets) if both[k]}
    others = docs.join(names, "doc_id", "left_anti")
    for _ in range(rounds if models else 0):
        found = confident_sums(others, models)
        for (t, k), sums in found.items():
            models[t].refit(k, sums)
    return {t: models[t].finish() if t in models else None for t in targets}


def classify(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
             source_col: str = "source", lang_col: str = "lang", length_col: str = "n_chars",
             labelled_rows: int = LABELLED_ROWS, rounds: int = ROUNDS) -> DataFrame:
    """One row per input row: ``doc_id, score, text_score, meta_score,
    toxic_score, keep``.

    ``score`` is the combined probability of good quality, ``toxic_score`` that
    of toxic text (the same method on the other label); ``keep`` holds where the
    first is at least 1/2 and the second below.  A label with a single class in
    the sample gives that class's score (quality 1, toxic 0) without a model.
    Null and empty texts have neutral styles and no words; null metadata are
    values of their own.  Repeated rows get equal scores; repeated labels of an
    id count once, an id with different labels counts as unlabelled, and of a
    labelled id with several rows one stands for it.  Empty tables give an empty
    result or untrained scores.
    """
    rows = pick(docs, doc_id=id_col, text=text_col, source=source_col, lang=lang_col, n_chars=length_col).select(
        "doc_id", "text", _metadata("source", "lang", "n_chars").alias("meta"))
    models = train(rows, labels, ["quality", "toxic"], labelled_rows, rounds)
    shared = share(docs.sparkSession, models)

    def run(batches):
        models = shared()
        quality, toxic = models["quality"], models["toxic"]
        for batch in batches:
            out = np.tile([1.0, 1.0, 1.0, 0.0], (batch.num_rows, 1))
            meta = np.array(batch.column(2).to_pylist(), np.int64).reshape(-1, 3)
            for a, b, styles, word, row in _texts(batch.column(1)):
                own = (styles, word, row, meta[a:b].ravel(), np.repeat(np.arange(b - a), 3))
                if quality is not None:
                    out[a:b, 0], out[a:b, 1], out[a:b, 2] = quality.probability(*own)
                if toxic is not None:
                    out[a:b, 3] = toxic.probability(*own)[0]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *[pa.array(out[:, k]) for k in range(4)], pa.array((out[:, 0] >= 0.5) & (out[:, 3] < 0.5))],
                names=["doc_id", "score", "text_score", "meta_score", "toxic_score", "keep"])
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, score double, text_score double, meta_score double, "
                                "toxic_score double, keep boolean")
