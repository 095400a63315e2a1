"""Language identification: multinomial naive Bayes over hashed character
n-grams.

Training counts each language's n-grams in 2^bits bins.  Every task adds up its
own rows and emits one sparse row per (language, bin); a partial aggregation
and a sum finish the table.  It has at most languages x bins rows, whatever the
corpus size, and becomes the log-probability matrix that is broadcast.  Its size is
bounded by ``max_cells``: beyond that many languages the n-grams share fewer bins.

Scoring hashes the n-grams of a batch and adds matrix rows per text in numpy;
texts are processed in slices, a long one piece by piece, so memory is bounded.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .inputs import pick, pieces, share

ORDERS = (1, 2, 3)
UNKNOWN = "und"
#: characters handled at a time
_PIECE = 1 << 18
_MUL = [np.uint32(0x9E3779B1), np.uint32(0x85EBCA77), np.uint32(0xC2B2AE3D)]


def _bins(points: np.ndarray, bits: int):
    """Per order: the bin of the n-gram that starts at each position of a text
    padded with a space on both ends."""
    for n in ORDERS:
        if len(points) < n:
            continue
        h = np.full(len(points) - n + 1, n * 0x27D4EB2F & 0xFFFFFFFF, np.uint32)
        for k in range(n):
            h = (h ^ points[k:len(points) - n + 1 + k]) * _MUL[k]
            h ^= h >> np.uint32(15)
        yield h >> np.uint32(32 - bits)


def _pieces(text: str):
    """Code points of the lower-cased text between spaces, in bounded pieces
    that overlap by the longest n-gram less one."""
    padded = " " + text.lower() + " "
    step = _PIECE - (max(ORDERS) - 1)
    for a in range(0, max(1, len(padded) - (max(ORDERS) - 1)), step):
        yield a == 0, np.frombuffer(padded[a:a + _PIECE].encode("utf-32-le", "surrogatepass"), np.uint32)


def _text_bins(text: str, bits: int):
    """Bins of all n-grams of a text, each n-gram once."""
    for first, points in _pieces(text):
        for n, bins in zip(ORDERS, _bins(points, bits)):
            # the shorter n-grams of an overlap were counted in the piece before
            yield bins if first else bins[max(ORDERS) - n:]


def count_ngrams(labelled: DataFrame, bits: int) -> DataFrame:
    """``lang, bin, n`` of all training texts (columns ``lang, text``)."""
    def run(batches):
        counts: dict[str, np.ndarray] = {}
        for batch in (part for whole in batches for part in pieces(whole)):
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                own = counts.setdefault(lang, np.zeros(1 << bits, np.int64))
                for bins in _text_bins(text, bits):
                    if len(bins) < 1 << (bits - 4):
                        np.add.at(own, bins, 1)
                    else:
                        own += np.bincount(bins, minlength=1 << bits)
        for lang, own in counts.items():
            at = np.flatnonzero(own)
            yield pa.record_batch([pa.array([lang] * len(at), pa.string()), pa.array(at.astype(np.int32)),
                                   pa.array(own[at])], names=["lang", "bin", "n"])
    found = labelled.select("lang", "text").mapInArrow(run, "lang string, bin int, n long")
    return found.groupBy("lang", "bin").agg(F.sum("n").alias("n"))


class Model:
    """Languages (sorted), the log-probability matrix [bin, language], log priors."""

    def __init__(self, langs: list[str], matrix: np.ndarray, prior: np.ndarray, bits: int):
        self.langs, self.matrix, self.prior, self.bits = langs, matrix, prior, bits

    def scores(self, text: str) -> np.ndarray:
        total = self.prior.copy()
        for bins in _text_bins(text, self.bits):
            total += self.matrix[bins].sum(axis=0, dtype=np.float64)
        return total

    def best(self, text: str | None) -> tuple[str, float]:
        """The most probable language and its posterior probability."""
        if text is None or not self.langs or not any(map(str.isalpha, text)):
            return UNKNOWN, 0.0
        s = self.scores(text)
        k = int(np.argmax(s))
        return self.langs[k], float(1 / np.exp(s - s[k]).sum())


def train(docs: DataFrame, lang_col: str = "lang", text_col: str = "text", bits: int = 16,
          smoothing: float = 0.5, max_cells: int = 1 << 24) -> Model:
    """Fit on all given rows with a language and a text.  There are 2^``bits`` bins,
    fewer where languages x bins would exceed ``max_cells`` (256 bins at least); the
    number of languages has no limit."""
    rows = pick(docs, lang=lang_col, text=text_col).filter("lang is not null and text is not null")
    priors = {r[0]: r[1] for r in rows.groupBy("lang").count().collect()}
    while bits > 8 and len(priors) << bits > max_cells:
        bits -= 1
    langs = sorted(priors)
    table = count_ngrams(rows, bits).toArrow() if langs else None
    counts = np.zeros((1 << bits, len(langs)))
    if table is not None and table.num_rows:
        at = {lang: k for k, lang in enumerate(langs)}
        column = table["lang"].combine_chunks().dictionary_encode()
        column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
        of = np.array([at[x] for x in column.dictionary.to_pylist()])[column.indices.to_numpy()]
        counts[table["bin"].to_numpy(), of] = table["n"].to_numpy()
    total = counts.sum(axis=0)
    matrix = np.log((counts + smoothing) / (total + smoothing * (1 << bits)))
    n = np.array([priors[x] for x in langs], float)
    return Model(langs, matrix.astype(np.float32), np.log(n / n.sum()) if langs else n, bits)


def predict(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text",
            keep: dict[str, Column] | None = None) -> DataFrame:
    """``doc_id, lang_pred, score`` (and the columns of ``keep``) per input row.

    ``score`` is the posterior probability of the predicted language.  A null
    text, one without letters, or a model without languages gives ``und`` and
    score 0.  Ties go to the language that sorts first.  Rows may repeat.
    """
    spark = docs.sparkSession
    shared = share(spark, model)
    extra = {k: v.alias(k) for k, v in (keep or {}).items()}
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), *extra.values())
    names = ["doc_id", *extra, "lang_pred", "score"]

    def run(batches):
        m = shared()
        for batch in batches:
            lang, score = [], []
            for text in batch.column(1).to_pylist():
                found = m.best(text)
                lang.append(found[0])
                score.append(found[1])
            columns = [batch.column(0), *[batch.column(i) for i in range(2, batch.num_columns)],
                       pa.array(lang, pa.string()), pa.array(score, pa.float64())]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name != "text")
    return rows.mapInArrow(run, f"{schema}, lang_pred string, score double")


def keep_identified(docs: DataFrame, model: Model, text_col: str = "text", min_score: float = 0.5) -> DataFrame:
    """The rows of ``docs`` whose language is identified with at least
    ``min_score``; all columns stay as they are."""
    shared = share(docs.sparkSession, model)
    at = docs.columns.index(text_col)

    def run(batches):
        m = shared()
        for batch in (part for whole in batches for part in pieces(whole)):
            found = (m.best(text) for text in batch.column(at).to_pylist())
            yield batch.filter(pa.array([lang != UNKNOWN and score >= min_score for lang, score in found], pa.bool_()))
    return docs.mapInArrow(run, docs.schema)
