"""URL filters over a sorted digest array.

The rules become one array of 64-bit xxhash keys in ascending order, with the
full key strings and a short payload beside it.  Spark sorts the entries and
writes them as pieces under the shared checkpoint folder; every executor fetches
each piece once (``SparkContext.addFile``), unpacks it into flat files beside
its copy and maps those into memory, so all Python workers of a machine share
one copy in the page cache and neither the driver nor a broadcast holds the
list.  A batch of URLs is probed by vectorised binary search; a digest that is
found counts only if the stored string is the probed one, whatever other strings
share the digest.

Keys of three kinds, which cannot be equal to each other (a rule's key has a
``/``, the others have none):

* ``host/path`` of a rule; payload: its verdict,
* ``host:<host>`` of a host that has rules; payload: the lengths of their paths,
  so only prefixes of those lengths are probed,
* ``word:<word>`` of a host word that is blocked or allowed where no rule fits.

Probes cost one binary search per host suffix, host word and path prefix; rows
are not shuffled.
"""

from __future__ import annotations

import math
import os
import string
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
import xxhash
from pyspark import SparkFiles
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage, drop_cut
from .inputs import pick

#: seed of Spark's own xxhash64, which makes the keys of the array
_SEED = 42
#: entries of one piece of the array
PIECE_ROWS = 4_000_000


def digest_of(key: Column) -> Column:
    """64-bit key of an entry: xxHash64 of its UTF-8 bytes."""
    return F.xxhash64(key)


def _hashes(keys: list[bytes]) -> np.ndarray:
    """The same digests in a task."""
    out = np.fromiter((xxhash.xxh64_intdigest(k, _SEED) for k in keys), np.uint64, len(keys))
    return out.view(np.int64)


def url_host(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased."""
    found = F.regexp_extract(F.coalesce(url, F.lit("")), "://([^/?#]*)", 1)
    return F.translate(found, string.ascii_uppercase, string.ascii_lowercase)


def url_path(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), "://[^/?#]*([^?#]*)", 1)


class UrlIndex:
    """A written digest array: the names of its pieces and the table to drop."""

    def __init__(self, pieces: list[str], table: DataFrame):
        self.pieces, self._table = pieces, table

    def drop(self) -> None:
        """Delete the written pieces, once nothing probes them any more."""
        drop_cut(self._table)


def build_index(rules: DataFrame, words: DataFrame | None = None, digest=digest_of,
                piece_rows: int = PIECE_ROWS) -> UrlIndex:
    """The digest array of ``rules`` (host, path, verdict) and ``words`` (word, verdict).

    A path starts with ``/`` and ends anywhere; hosts and words are compared
    with lower-cased hosts.  Rows with a null are left out.  Of rules with the
    same host and path, ``allow`` wins over ``block`` (the least verdict).
    ``digest`` is a parameter so that tests can force collisions.
    """
    spark = rules.sparkSession
    given = rules.select("host", "path", "verdict").dropna()
    exact = given.select(F.concat("host", "path").alias("key"), F.col("verdict").alias("payload"))
    lengths = F.array_join(F.array_sort(F.collect_set(F.length("path"))).cast("array<string>"), ",")
    hosts = given.groupBy("host").agg(lengths.alias("payload")).select(
        F.concat(F.lit("host:"), "host").alias("key"), "payload")
    entries = exact.union(hosts)
    if words is not None:
        entries = entries.union(words.select("word", "verdict").dropna().select(
            F.concat(F.lit("word:"), "word"), "verdict"))
    entries = entries.groupBy("key").agg(F.min("payload").alias("payload")).withColumn("digest", digest(F.col("key")))
    entries = cut_lineage(entries, "url-entries")
    pieces = max(1, math.ceil(entries.count() / piece_rows))
    table = cut_lineage(entries.repartitionByRange(pieces, "digest").sortWithinPartitions("digest", "key"),
                        "url-pieces")
    drop_cut(entries)
    files = table.inputFiles()
    for f in files:
        spark.sparkContext.addFile(f)
    return UrlIndex([f.rsplit("/", 1)[1] for f in files], table)


class _Piece:
    """One piece of the array, mapped into memory."""

    def __init__(self, name: str):
        source = SparkFiles.get(name)
        self._flat = source + ".flat"
        if not os.path.isdir(self._flat):
            self._unpack(source)
        self.digests = self._map("digests", np.int64)
        self._ends, self._bytes = self._map("ends", np.int64), self._map("bytes", np.uint8)

    def _unpack(self, source: str) -> None:
        """Flat files beside the fetched piece, written batch by batch and put
        in place by one rename; workers that come second leave theirs out."""
        work = f"{source}.{uuid.uuid4().hex}"
        os.mkdir(work)
        end = 0
        with open(f"{work}/digests", "wb") as digests, open(f"{work}/ends", "wb") as ends, \
                open(f"{work}/bytes", "wb") as strings:
            for batch in pq.ParquetFile(source).iter_batches(65_536, columns=["digest", "key", "payload"]):
                digests.write(batch["digest"].to_numpy(zero_copy_only=False).astype(np.int64).tobytes())
                for pair in zip(batch["key"].to_pylist(), batch["payload"].to_pylist()):
                    for text in pair:
                        raw = text.encode()
                        strings.write(raw)
                        end += len(raw)
                        ends.write(end.to_bytes(8, "little"))
        try:
            os.rename(work, self._flat)
        except OSError:                 # another worker of this executor was first
            for f in os.listdir(work):
                os.unlink(f"{work}/{f}")
            os.rmdir(work)

    def _map(self, name: str, kind) -> np.ndarray:
        path = f"{self._flat}/{name}"
        return np.memmap(path, kind, "r") if os.path.getsize(path) else np.zeros(0, kind)

    def _string(self, i: int) -> bytes:
        a = int(self._ends[i - 1]) if i else 0
        return self._bytes[a:int(self._ends[i])].tobytes()

    def find(self, keys: list[bytes], digests: np.ndarray, out: list) -> None:
        """Put the payload of every key that this piece stores at its place in ``out``."""
        first = np.searchsorted(self.digests, digests, "left")
        last = np.searchsorted(self.digests, digests, "right")
        for k in np.flatnonzero(first < last):
            for i in range(int(first[k]), int(last[k])):
                if self._string(2 * i) == keys[k]:
                    out[k] = self._string(2 * i + 1).decode()


class _Array:
    """All pieces of the digest array."""

    def __init__(self, names: list[str], hashes=_hashes):
        self._pieces, self._hashes = [_Piece(n) for n in names], hashes

    def payloads(self, keys: list[bytes]) -> list:
        """The payload of each key, None where the array does not hold it."""
        out = [None] * len(keys)
        if keys:
            digests = self._hashes(keys)
            for piece in self._pieces:
                piece.find(keys, digests, out)
        return out


def _suffixes(host: str) -> list[str]:
    parts = host.split(".")
    return [".".join(parts[k:]) for k in range(len(parts))]


def _words(host: str) -> list[str]:
    return [w for w in host.replace("-", ".").replace("_", ".").split(".") if w]


def _judge_batch(array: _Array, host: pa.Array, path: pa.Array, default: str) -> tuple[list, list]:
    """(rule, verdict) of every row of a batch."""
    coded = host.dictionary_encode()
    hosts, codes = coded.dictionary.to_pylist(), coded.indices.to_numpy()
    suffixes, words = [_suffixes(h) for h in hosts], [_words(h) for h in hosts]

    listed = sorted({s for row in suffixes for s in row})
    lengths = dict(zip(listed, array.payloads([f"host:{s}".encode() for s in listed])))
    wanted = sorted({w for row in words for w in row})
    said = dict(zip(wanted, array.payloads([f"word:{w}".encode() for w in wanted])))

    by_word = []
    for row in words:
        verdicts = {said[w] for w in row} - {None}
        by_word.append(min(verdicts) if verdicts else default)
    rules = np.full(len(host), None, object)
    verdicts = np.array(by_word, object)[codes] if len(host) else np.zeros(0, object)
    longest = np.full(len(host), -1, np.int64)

    members: dict[str, list[int]] = {}
    for code, row in enumerate(suffixes):
        for s in row:
            if lengths[s] is not None:
                members.setdefault(s, []).append(code)
    # longer hosts first: they win among rules of the same length
    for s in sorted(members, key=lambda s: (-len(s), s)):
        rows = np.flatnonzero(np.isin(codes, members[s]))
        paths = path.take(pa.array(rows))
        for n in map(int, lengths[s].split(",")):
            prefix = pc.utf8_slice_codeunits(paths, 0, n).dictionary_encode()
            tried = prefix.dictionary.to_pylist()
            found = array.payloads([(s + p).encode() for p in tried])
            # a shorter path is not a prefix of the rule's length
            hit = np.array([f is not None and len(p) == n for p, f in zip(tried, found)], bool)
            at = prefix.indices.to_numpy()
            better = hit[at] & (longest[rows] < len(s) + n)
            for k in np.flatnonzero(better):
                rules[rows[k]], verdicts[rows[k]] = s + tried[at[k]], found[at[k]]
            longest[rows[better]] = len(s) + n
    return rules.tolist(), verdicts.tolist()


def judge_urls(pages: DataFrame, index: UrlIndex, id_col: str = "page_id", url_col: str = "url",
               default: str = "allow", hashes=_hashes) -> DataFrame:
    """``<id_col>, host, path, rule, verdict``: one row per input row.

    A rule fits its host and all hosts below it if the URL's path starts with
    the rule's path.  Of the rules that fit, the longest (host and path
    together, in characters) decides, then the one with the longer host.
    Without a rule, ``rule`` is null and the words of the host decide: it is
    allowed or blocked by its listed words (the least verdict, so ``allow``
    wins), else ``default``.

    A null URL and one without ``://`` have an empty host and path and get
    ``default``; so does an empty URL.  Hosts are taken as written, with user and
    port.  Very long URLs are judged whole.  Repeated rows are judged alike.  An
    empty table gives an empty result, other columns are ignored.
    """
    names = list(index.pieces)
    rows = pick(pages, page_id=id_col, url=url_col).select(
        "page_id", url_host(F.col("url")).alias("host"), url_path(F.col("url")).alias("path"))
    kind = rows.schema["page_id"].dataType.simpleString()

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        array = _Array(names, hashes)
        for batch in batches:
            rule, verdict = _judge_batch(array, batch["host"], batch["path"], default)
            yield pa.RecordBatch.from_arrays(
                [batch["page_id"], batch["host"], batch["path"], pa.array(rule, pa.string()),
                 pa.array(verdict, pa.string())], ["page_id", "host", "path", "rule", "verdict"])

    out = rows.mapInArrow(judge, f"page_id {kind}, host string, path string, rule string, verdict string")
    return out.withColumnRenamed("page_id", id_col)
