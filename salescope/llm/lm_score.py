"""Context-tree weighting over bytes, scored in corpus-wide blocks.

*Text model.*  A text is its words (lower-cased A-Z, split at white space), each
followed by a space, then an end byte; contexts reach back ``depth`` bytes, and
end bytes stand before the first word.

*Tree.*  A byte is eight binary decisions.  The decision behind each of the 255
bit prefixes has its own context tree over the preceding bytes.  A node holds
the training counts of its zeros and ones, its Krichevsky-Trofimov block
probability Pe, and

    Pw = 1/2 Pe + 1/2 prod Pw(children)        (Pw = Pe at full depth)

With the trained tree, the probability of a bit mixes the KT estimates of all
depths along the context path, each node stopping with weight 1/2 Pe / Pw; a
context that training never saw passes on to its longest seen suffix.

*In Spark.*  Rows are dealt into blocks of bounded size by id.  A block reports
its distinct (depth + 1)-grams and words with their training counts; a window
over the key adds the blocks up.  The grams of one preceding byte form one
subtree of the root, a group bounded by the gram alphabet and not by the corpus;
the root itself has 255 nodes, whose sums over 256 subtrees are all that the
driver sees.  Each gram gets one log probability, which returns to the blocks
that asked for it, beside the word counts; the blocks then score their texts.
No table of the whole corpus is broadcast or collected.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage

DEPTH = 4
BLOCK_BYTES = 16 << 20
_END = b"\n"
_LN2 = math.log(2)
#: texts scored at a time
_TEXTS = 256


# ---- texts -------------------------------------------------------------------

def _words(text: str | None) -> list[bytes]:
    return [] if text is None else text.encode("utf-8", "surrogatepass").lower().split()


def _stream(words: list[bytes]) -> bytes:
    return b" ".join(words) + b" " + _END if words else _END


def _grams(stream: np.ndarray, depth: int) -> np.ndarray:
    """The (depth + 1)-gram that ends at each byte after the first ``depth``."""
    g = np.zeros(len(stream) - depth, np.uint64)
    for k in range(depth + 1):
        g = (g << np.uint64(8)) | stream[k:len(stream) - depth + k]
    return g


def _text_grams(streams: list[bytes], depth: int) -> np.ndarray:
    """Grams of the texts in order, one per byte; each text starts after end bytes."""
    if not streams:
        return np.zeros(0, np.uint64)
    pad = _END * depth
    joined = np.frombuffer(pad + pad.join(streams), np.uint8)
    grams = _grams(joined, depth)
    lens = np.array([len(s) for s in streams], np.int64)
    inside = np.ones(len(grams), bool)
    gaps = np.cumsum(lens[:-1]) + depth * np.arange(len(lens) - 1)
    for k in range(depth):
        inside[gaps + k] = False
    return grams[inside]


def _distinct_grams(streams: list[bytes], depth: int, piece: int = 1 << 20) -> tuple[np.ndarray, np.ndarray]:
    """(sorted grams, counts) of texts; each piece of about ``piece`` bytes is
    reduced to its distinct grams before the next one is expanded."""
    found = []
    a = size = 0
    for b, s in enumerate(streams, 1):
        size += len(s)
        if size >= piece or b == len(streams):
            found.append(np.unique(_text_grams(streams[a:b], depth), return_counts=True))
            a, size = b, 0
    if not found:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    grams, at = np.unique(np.concatenate([f[0] for f in found]), return_inverse=True)
    return grams, np.bincount(at, np.concatenate([f[1] for f in found]), len(grams)).astype(np.int64)


class _Positions:
    """Positions of keys in a sorted array that holds them all: a hashed slot
    per key, and a binary search for the keys whose slot another one has."""

    def __init__(self, keys: np.ndarray):
        self.keys = keys
        self.shift = np.uint64(64 - max(8, min(24, int(len(keys)).bit_length() + 4)))
        self.slots = np.zeros(1 << int(64 - self.shift), np.int32)
        self.slots[self._slot(keys)] = np.arange(len(keys), dtype=np.int32)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return (keys * np.uint64(0x9E3779B97F4A7C15)) >> self.shift

    def __call__(self, wanted: np.ndarray) -> np.ndarray:
        at = self.slots[self._slot(wanted)]
        other = np.flatnonzero(self.keys[at] != wanted)
        at[other] = np.searchsorted(self.keys, wanted[other])
        return at


def _count_block(texts, train, depth: int):
    """(kind, key, training count) of the distinct grams (0) and words (1) of a block."""
    grams: dict[int, np.ndarray] = {}
    words: dict[bytes, int] = {}
    parts: list[list[bytes]] = [[], []]
    for text, trains in zip(texts, train):
        own = _words(text)
        parts[int(trains)].append(_stream(own))
        own.append(_END)
        if trains:
            for w in own:
                words[w] = words.get(w, 0) + 1
        else:
            for w in own:
                words.setdefault(w, 0)
    seen, count = _distinct_grams(parts[1], depth)
    asked = np.setdiff1d(_distinct_grams(parts[0], depth)[0], seen, assume_unique=True)
    key = np.concatenate([seen, asked, np.array([xxhash.xxh3_64_intdigest(w) for w in words], np.uint64)])
    n = np.concatenate([count, np.zeros(len(asked), np.int64), np.array(list(words.values()), np.int64)])
    kind = np.repeat(np.array([0, 1], np.int32), [len(seen) + len(asked), len(words)])
    return kind, key.astype(np.uint64).view(np.int64), n.astype(np.int64)


# ---- the tree ----------------------------------------------------------------

def _lgamma(x: np.ndarray) -> np.ndarray:
    """log Gamma for x > 0: Stirling's series after shifting x past 8."""
    shift = np.ones_like(x)
    y = x.copy()
    for _ in range(8):
        low = y < 8
        shift[low] *= y[low]
        y[low] += 1
    inv = 1 / y
    series = inv * (1 / 12 - inv * inv * (1 / 360 - inv * inv * (1 / 1260 - inv * inv / 1680)))
    return (y - 0.5) * np.log(y) - y + 0.5 * math.log(2 * math.pi) + series - np.log(shift)


def log_kt(n0: np.ndarray, n1: np.ndarray) -> np.ndarray:
    """log of the KT block probability of n0 zeros and n1 ones."""
    n0, n1 = n0.astype(float), n1.astype(float)
    return _lgamma(n0 + 0.5) + _lgamma(n1 + 0.5) - _lgamma(n0 + n1 + 1) - math.log(math.pi)


class _Level:
    """Nodes of one bit position and depth, and the node of every gram."""

    def __init__(self, context: np.ndarray, prefix: np.ndarray, bit: np.ndarray, n: np.ndarray):
        keys, self.at = np.unique((context << np.uint64(8)) | prefix, return_inverse=True)
        self.n1 = np.bincount(self.at, n * bit, len(keys))
        self.n0 = np.bincount(self.at, n * (1 - bit), len(keys))
        self.seen = self.n0 + self.n1 > 0
        self.log_pe = log_kt(self.n0, self.n1)
        self.log_pw = self.log_pe

    def weigh(self, below: "_Level") -> None:
        """Pw from the children; ``at`` of any gram maps a child to its parent."""
        parent = np.zeros(len(below.n0), np.int64)
        parent[below.at] = self.at
        children = np.bincount(parent, below.log_pw, len(self.n0))
        self.log_pw = np.logaddexp(self.log_pe, children) - _LN2

    def stop(self) -> np.ndarray:
        return np.exp(self.log_pe - _LN2 - self.log_pw)

    def estimate(self, bit: np.ndarray) -> np.ndarray:
        """KT estimate of each gram's bit."""
        n0, n1 = self.n0[self.at], self.n1[self.at]
        return (np.where(bit == 1, n1, n0) + 0.5) / (n0 + n1 + 1)


def _decisions(grams: np.ndarray, n: np.ndarray, depth: int):
    """Per bit position: its number, the bit of every gram, and the levels from
    full depth up to depth 1, weighed."""
    symbol = grams & np.uint64(255)
    for k in range(8):
        bit = ((symbol >> np.uint64(7 - k)) & np.uint64(1)).astype(np.int64)
        prefix = (np.uint64(1) << np.uint64(k)) | (symbol >> np.uint64(8 - k))
        levels = []
        for d in range(depth, 0, -1):
            context = (grams >> np.uint64(8)) & np.uint64((1 << (8 * d)) - 1)
            level = _Level(context, prefix, bit, n)
            if levels:
                level.weigh(levels[-1])
            levels.append(level)
        yield prefix.astype(np.int64), bit, levels


def subtree_roots(grams: np.ndarray, n: np.ndarray, depth: int):
    """(prefix, zeros, ones, log Pw) of the depth-1 nodes of one preceding byte."""
    out = []
    for prefix, _, levels in _decisions(grams, n, depth):
        top = levels[-1]
        own = np.zeros(len(top.n0), np.int64)
        own[top.at] = prefix
        out.append((own[top.seen], top.n0[top.seen], top.n1[top.seen], top.log_pw[top.seen]))
    return [np.concatenate(c) for c in zip(*out)]


def root_nodes(prefix: np.ndarray, n0: np.ndarray, n1: np.ndarray, log_pw: np.ndarray) -> np.ndarray:
    """Zeros, ones and stop weight of the 255 root nodes, by bit prefix."""
    a, b, below = (np.bincount(prefix, x, 256) if len(prefix) else np.zeros(256) for x in (n0, n1, log_pw))
    log_pe = log_kt(a, b)
    stop = np.exp(log_pe - np.logaddexp(log_pe, below))
    return np.stack([a, b, stop])


def log10_probabilities(grams: np.ndarray, n: np.ndarray, depth: int, root: np.ndarray) -> np.ndarray:
    """log10 P(last byte | the bytes before it) of each gram of one preceding byte."""
    total = np.zeros(len(grams))
    for prefix, bit, levels in _decisions(grams, n, depth):
        p, known = np.full(len(grams), 0.5), np.zeros(len(grams), bool)
        for level in levels:
            here, kt = level.seen[level.at], level.estimate(bit)
            w = np.where(known, level.stop()[level.at], 1.0)
            p = np.where(here, w * kt + (1 - w) * p, p)
            known |= here
        zeros, ones, stop = root[:, prefix]
        kt = (np.where(bit == 1, ones, zeros) + 0.5) / (zeros + ones + 1)
        w = np.where(known, stop, 1.0)
        total += np.log10(w * kt + (1 - w) * p)
    return total


# ---- Spark -------------------------------------------------------------------

def _columns(table: pa.Table, *names: str) -> list[np.ndarray]:
    return [table[x].to_numpy() for x in names]


def _gram_probabilities(totals: DataFrame, depth: int) -> DataFrame:
    """``key, value``: log10 probability of every gram of ``key, n``."""
    dealt = totals.withColumn("before", F.shiftright("key", 8).bitwiseAND(F.lit(255)))

    def roots(table: pa.Table) -> pa.Table:
        key, n = _columns(table, "key", "n")
        prefix, n0, n1, log_pw = subtree_roots(key.view(np.uint64), n, depth)
        return pa.table({"prefix": prefix, "n0": n0, "n1": n1, "log_pw": log_pw})

    top = dealt.groupBy("before").applyInArrow(roots, "prefix long, n0 double, n1 double, log_pw double")
    top = top.groupBy("prefix").agg(*[F.sum(c).alias(c) for c in ("n0", "n1", "log_pw")]).orderBy("prefix").toArrow()
    root = root_nodes(*_columns(top, "prefix", "n0", "n1", "log_pw"))

    def score(table: pa.Table) -> pa.Table:
        key, n = _columns(table, "key", "n")
        return pa.table({"key": key, "value": log10_probabilities(key.view(np.uint64), n, depth, root)})

    return dealt.groupBy("before").applyInArrow(score, "key long, value double")


def score_texts(docs: DataFrame, train: Column, id_col: str = "doc_id", text_col: str = "text",
                depth: int = DEPTH, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row per input row: ``doc_id, n_tokens, n_known, train_tokens,
    base_score, score, bits_per_byte, trained``.

    ``train`` marks the rows to learn from (null: no).  Tokens are the words and
    one end.  ``score`` is the model's log10 probability of the text and
    ``bits_per_byte`` the code length that it gives per byte of the text model;
    ``base_score`` is the additively smoothed unigram score.  A null or empty
    text is its end alone.  Rows may repeat; an empty table gives an empty
    result; without training rows all KT estimates are 1/2.
    """
    if depth > 6:
        raise ValueError("a gram of more than 7 bytes does not fit a long key")
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"),
                       F.coalesce(train, F.lit(False)).alias("trained"))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, math.ceil(size / block_bytes))
    rows = rows.withColumn("block", F.pmod(F.xxhash64("doc_id"), F.lit(blocks)).cast("int"))

    def count(table: pa.Table) -> pa.Table:
        kind, key, n = _count_block(table["text"].to_pylist(), table["trained"].to_pylist(), depth)
        block = np.full(len(key), table["block"][0].as_py(), np.int32)
        return pa.table({"block": block, "kind": kind, "key": key, "n": n})

    counts = cut_lineage(rows.groupBy("block").applyInArrow(count, "block int, kind int, key long, n long"), "lm-counts")
    # every key has at most one row per block here
    words = counts.filter("kind = 1")
    whole = words.withColumn("value", F.sum("n").over(Window.partitionBy("key")).cast("double"))
    tokens = words.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    distinct = words.filter("n > 0").select("key").distinct().count()

    grams = counts.filter("kind = 0")
    totals = cut_lineage(grams.groupBy("key").agg(F.sum("n").alias("n")), "lm-grams")
    values = grams.select("block", "kind", "key").join(_gram_probabilities(totals, depth), "key")
    model = whole.select("block", "kind", "key", "value").unionByName(values.select("block", "kind", "key", "value"))

    unit = tokens + 0.5 * (distinct + 1)

    def score(texts: pa.Table, model: pa.Table) -> pa.Table:
        kind, key, value = _columns(model, "kind", "key", "value")
        key = key.view(np.uint64)
        is_gram = kind == 0
        order = np.argsort(key[is_gram])
        positions, log_p = _Positions(key[is_gram][order]), value[is_gram][order]
        count = dict(zip(key[~is_gram].tolist(), value[~is_gram].tolist()))
        number: dict[bytes, int] = {}                    # distinct words in order of their first use
        counts: list[float] = []
        n_tokens, n_known, base, total, n_bytes = [], [], [], [], []
        for chunk in texts["text"].chunks:
            for a in range(0, len(chunk), _TEXTS):
                streams, lens, tokens_of = [], [], []
                for text in chunk.slice(a, _TEXTS).to_pylist():
                    own = _words(text)
                    stream = _stream(own)
                    own.append(_END)
                    streams.append(stream)
                    lens.append(len(own))
                    for w in own:
                        k = number.get(w)
                        if k is None:
                            k = number[w] = len(counts)
                            counts.append(count[xxhash.xxh3_64_intdigest(w)])
                        tokens_of.append(k)
                c = np.array(counts)[tokens_of]
                first = np.cumsum([0, *lens[:-1]])
                base += np.add.reduceat(np.log10((c + 0.5) / unit), first).tolist()
                n_known += np.add.reduceat((c > 0).astype(np.int64), first).tolist()
                n_tokens += lens
                sizes = [len(s) for s in streams]
                found = log_p[positions(_text_grams(streams, depth))]
                total += np.add.reduceat(found, np.cumsum([0, *sizes[:-1]])).tolist()
                n_bytes += sizes
        bits = [-t / math.log10(2) / b for t, b in zip(total, n_bytes)]
        return pa.table({
            "doc_id": texts["doc_id"], "n_tokens": pa.array(n_tokens, pa.int64()), "n_known": pa.array(n_known, pa.int64()),
            "train_tokens": pa.array([tokens] * len(total), pa.int64()), "base_score": pa.array(base, pa.float64()),
            "score": pa.array(total, pa.float64()), "bits_per_byte": pa.array(bits, pa.float64()), "trained": texts["trained"]})

    kind_of_id = rows.schema["doc_id"].dataType.simpleString()
    return rows.groupBy("block").cogroup(model.groupBy("block")).applyInArrow(
        score, f"doc_id {kind_of_id}, n_tokens long, n_known long, train_tokens long, base_score double, "
               "score double, bits_per_byte double, trained boolean")
