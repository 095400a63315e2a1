"""Size-aware heavy-light set join on word n-grams.

Two texts link when the Jaccard similarity of their distinct word n-grams is at
least ``num / den``.  Components of links are wanted, and no link between
different texts may be lost.

*Classes.*  Texts with the same word sequence have the same set; one of them
represents the class.

*Boundary.*  Sets of up to ``x`` elements are small, the others large; ``x`` is
chosen by cost from the size histogram (rows that subsets of a size would make
against postings that scanning the lists would read).

*Small sets.*  If the larger of two linked sets has t elements, they share at
least c = ceil(num t / den) of them, so they share a subset of exactly c
elements.  Small sets enumerate these fixed-size subsets, for each t that a
partner of theirs can have; a shared subset is a candidate.

*Large sets.*  Under any global order of the elements, linked sets share one of
their first n - ceil(num n / den) + 1 elements.  The order is: light elements by
hash, then heavy ones by hash, an element being heavy when its inverted list is
long.  So the lists that get scanned are short wherever a text has anything of
its own.  Each text posts a hash-ordered head with some slack; texts whose head
has too many heavy elements post from a head ``LONGER`` times as long, and those
that still have too many from their full set.  Small sets that can reach a large
one post as well.

*Near copies first.*  Texts that share one of their ``SEEDS`` least elements are
compared with one of them, and what links becomes a component at once.  From
here on components count, not texts: an element is heavy when many components
have it, and a list that lies in one component is left out.  A large group of
near copies so makes no element heavy and posts nothing.

*Candidates.*  A list of m texts is not expanded into m^2 pairs: its pivot (the
member that has the element first in its order) is compared with the others of
other components, and the components that this yields are merged.  Pairs of a
list that are still in different components are then compared one by one, so
nothing is lost.  Size and positional filters apply to every pair before it is
made.  Every set has a parity bitmap (for each value of the low bits of its
hashes, whether an odd number of elements has it); where the bitmaps of two sets
differ, the sets differ, which rules out most pairs.  Every candidate left is
verified on the full sets, the only step that moves them.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage, drop_cut
from . import textbytes as tb
from .components import components
from .inputs import pick, share, small_batches

#: largest size whose subsets may be enumerated; the boundary is chosen below it
SMALL_MAX = 29
#: postings that one posting of a list is worth against one subset row
SCAN_COST = 4.0
#: an element in the heads of more components than this is heavy
HEAVY = 32
#: least elements of a text that bring it to its near copies
SEEDS = 3
#: a longer head holds so many times the elements of a head
LONGER = 3
#: bits of a set's bitmap at least; larger sets have the largest power of two up to their size
LEAST_BITS = 256
#: bytes of text hashed at a time; the working arrays take about fifty times as much
SLICE_BYTES = 1 << 18

_SHINGLED = "doc_id long, text_key long, n_shingles long, s1 long, s2 long, head array<long>, bits binary"


def _least_share(n: int, num: int, den: int) -> int:
    """Elements that a set of n shares with any partner of at least its size."""
    return -(-num * n // den)


def _head_size(n: int, num: int, den: int) -> int:
    p = n - _least_share(n, num, den) + 1
    return n if n <= SMALL_MAX else min(n, p + p // 8 + 2)


def _bitmap(found: np.ndarray) -> bytes:
    """The parity bitmap of a set of hashes."""
    size = max(LEAST_BITS, 1 << max(len(found).bit_length() - 1, 0))
    odd = np.bincount(found & (size - 1), minlength=size) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


def _bits_apart(x: bytes, y: bytes) -> int:
    """Places where two bitmaps differ, after the larger is folded to the size of the other:
    at most the number of elements that only one of the sets has."""
    a, b = sorted((np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)), key=len)
    return int(np.bitwise_count(a ^ np.bitwise_xor.reduce(b.reshape(-1, len(a)), axis=0)).sum())


def _sets(column: pa.Array, width: int):
    """For every slice of the texts, a list of (row, sorted distinct n-gram hashes,
    hash of the word sequence)."""
    for a, b, data, offsets in tb.slices(column, SLICE_BYTES):
        out = []
        words, rows = tb.word_hashes(data, offsets, tb.NOT_SPACE)
        grams, at = tb.ngram_hashes(words, rows, width)
        grams = (grams >> np.uint64(1)).astype(np.int64)
        word_at = np.searchsorted(rows, np.arange(b - a + 1))
        gram_at = np.searchsorted(rows[at], np.arange(b - a + 1))
        for k in range(b - a):
            own = words[word_at[k]:word_at[k + 1]]
            if len(own) >= width:
                found = np.unique(grams[gram_at[k]:gram_at[k + 1]])
            elif len(own):
                found = np.array([xxhash.xxh3_64_intdigest(own.tobytes(), seed=len(own)) >> 1], np.int64)
            else:
                found = np.zeros(0, np.int64)
            out.append((a + k, found, xxhash.xxh3_128_intdigest(own.tobytes()) if len(own) else None))
        yield out


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def _sequence(seq: int | None) -> tuple:
    return (None, None) if seq is None else (_signed(seq >> 64), _signed(seq & ((1 << 64) - 1)))


def shingle_heads(docs: DataFrame, width: int, num: int, den: int) -> DataFrame:
    def run(batches):
        for batch in batches:
            ids, keys = batch.column(0), batch.column(2)
            for part in _sets(batch.column(1), width):
                at = pa.array([row for row, _, _ in part], pa.int64())
                s1, s2 = zip(*[_sequence(seq) for _, _, seq in part])
                heads = [found[:_head_size(len(found), num, den)] for _, found, _ in part]
                yield pa.record_batch([ids.take(at), keys.take(at),
                                       pa.array([len(found) for _, found, _ in part], pa.int64()), pa.array(s1, pa.int64()),
                                       pa.array(s2, pa.int64()), pa.array(heads, pa.list_(pa.int64())),
                                       pa.array([_bitmap(found) for _, found, _ in part], pa.binary())],
                                      names=["doc_id", "text_key", "n_shingles", "s1", "s2", "head", "bits"])
    return docs.select("doc_id", "text", F.xxhash64("text").alias("text_key")).mapInArrow(run, _SHINGLED)


def full_sets(docs: DataFrame, width: int, upto=None) -> DataFrame:
    """Sets of the texts; with ``upto``, a function of their size, so many of their least elements."""
    def run(batches):
        for batch in batches:
            for part in _sets(batch.column(1), width):
                s1, s2 = zip(*[_sequence(seq) for _, _, seq in part])
                yield pa.record_batch([batch.column(0).take(pa.array([row for row, _, _ in part], pa.int64())),
                                       pa.array(s1, pa.int64()), pa.array(s2, pa.int64()),
                                       pa.array([found[:upto(len(found)) if upto else None] for _, found, _ in part],
                                                pa.list_(pa.int64()))],
                                      names=["rep", "s1", "s2", "elements"])
    return docs.select("doc_id", "text").mapInArrow(run, "rep long, s1 long, s2 long, elements array<long>")


def _subset_sizes(n: int, x: int, num: int, den: int) -> list[int]:
    """Sizes of the subsets that a small set of n enumerates."""
    return sorted({_least_share(t, num, den) for t in range(n, min(x, n * den // num) + 1)})


def _subset_rows(n: int, x: int, num: int, den: int) -> float:
    from math import comb
    return sum(comb(n, c) for c in _subset_sizes(n, x, num, den))


def boundary(histogram: dict[int, int], num: int, den: int) -> int:
    """The size up to which enumerating subsets is cheaper than scanning lists."""
    def cost(x):
        return sum(k * (_subset_rows(n, x, num, den) if n <= x else SCAN_COST * _head_size(n, num, den))
                   for n, k in histogram.items() if n <= SMALL_MAX)
    return min(range(SMALL_MAX + 1), key=lambda x: (cost(x), x))


def subset_buckets(reps: DataFrame, x: int, num: int, den: int) -> DataFrame:
    """``bucket, rep, n, pos, component`` of the fixed-size subsets of the small sets."""
    def run(batches):
        for batch in batches:
            b, r, s, of = [], [], [], []
            for rep, n, head, component in zip(*(batch.column(i).to_pylist() for i in range(4))):
                own = tb.mix(np.array(head, np.int64).view(np.uint64))
                total = own.sum(dtype=np.uint64)
                for c in _subset_sizes(n, x, num, den):
                    left_out = list(combinations(range(n), n - c))
                    gone = own[np.array(left_out, np.int64)].sum(axis=1, dtype=np.uint64) if n > c else np.zeros(1, np.uint64)
                    b.append(tb.mix((total - gone) * np.uint64(2 * c + 1)).view(np.int64) | np.int64(-1 << 63))
                    r += [rep] * len(left_out)
                    s += [n] * len(left_out)
                    of += [component] * len(left_out)
            b = np.concatenate(b) if b else np.zeros(0, np.int64)
            yield pa.record_batch([pa.array(b), pa.array(r, pa.int64()), pa.array(s, pa.int64()),
                                   pa.array(np.zeros(len(b), np.int64)), pa.array(of, pa.int64())],
                                  names=["bucket", "rep", "n", "pos", "component"])
    return (reps.filter(F.col("n").between(1, x)).select("rep", "n", "head", "component")
            .mapInArrow(run, "bucket long, rep long, n long, pos long, component long"))


def _shared_buckets(rows: DataFrame) -> DataFrame:
    """The rows whose bucket has several components.  Most buckets have one row, so an
    aggregate beside the rows would shuffle nearly as much again as the rows."""
    bucket = Window.partitionBy("bucket")
    return (rows.withColumn("c1", F.min("component").over(bucket)).withColumn("c2", F.max("component").over(bucket))
            .filter("c1 != c2").drop("c1", "c2"))


def _pairs(a: str, b: str) -> list:
    return [F.least(a, b).alias("a"), F.greatest(a, b).alias("b")]


def _near_copies(reps: DataFrame, docs: DataFrame, width: int, num: int, den: int) -> DataFrame:
    """Links of texts with a least element in common: every text of a seed's list against
    one of them."""
    seeds = reps.select("rep", "n", F.explode(F.slice("head", 1, SEEDS)).alias("bucket"))
    pivots = seeds.groupBy("bucket").agg(F.min(F.struct("n", "rep")).alias("pivot"), F.count(F.lit(1)).alias("k"))
    least, most = F.col("pivot.n"), F.col("n")              # the pivot is the smallest
    star = cut_lineage(seeds.join(pivots.filter("k > 1"), "bucket")
                       .filter((F.col("rep") != F.col("pivot.rep")) & (least * den >= most * num))
                       .select(*_pairs("rep", "pivot.rep")).distinct(), "star")
    likely = cut_lineage(_plausible(star, reps, num, den), "likely")
    links = _verified(likely, docs, width, num, den)
    drop_cut(star, likely)
    return links


def _may_link(n1, p1, n2, p2, num: int, den: int):
    """Size and positional filter of two members of a bucket."""
    least = F.when(n1 < n2, n1).otherwise(n2)
    most = F.when(n1 < n2, n2).otherwise(n1)
    best = 1 + F.least(n1 - p1 - 1, n2 - p2 - 1)
    return (least * den >= most * num) & (best * (num + den) >= (n1 + n2) * num)


def _verified(pairs: DataFrame, docs: DataFrame, width: int, num: int, den: int) -> DataFrame:
    """The pairs whose full sets link, written."""
    sets = cut_lineage(_fetch(docs, _ends(pairs).distinct(), width), "sets")
    a = sets.select(F.col("rep").alias("a"), F.col("elements").alias("of_a"))
    b = sets.select(F.col("rep").alias("b"), F.col("elements").alias("of_b"))
    same = F.size(F.array_intersect("of_a", "of_b"))
    links = cut_lineage(pairs.join(a, "a").join(b, "b")
                        .filter(same * (num + den) >= (F.size("of_a") + F.size("of_b")) * num).select("a", "b"), "links")
    drop_cut(sets)
    return links


def link_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                    width: int = 3, num: int = 90, den: int = 100, text_key: bool = False) -> DataFrame:
    """One row per input row: ``doc_id, n_shingles, component_id``, and with
    ``text_key`` the xxhash64 of the row's text.

    ``component_id`` is the smallest id reachable over links, the row itself
    included.  Words are split at ``[\\x20\\x09-\\x0D]`` after lower-casing A-Z; a
    text with fewer words than ``width`` has its whole sequence as its only
    element.  Texts without words (null, empty, white space only) have the empty
    set and link with nothing, not even with each other.  Ids are longs; rows
    that repeat an id and text belong to one class, a null id takes no part as
    the smallest.  N-grams are compared by 64-bit hashes, word sequences by
    128-bit hashes.  An empty table gives an empty result.
    """
    docs = pick(docs, doc_id=id_col, text=text_col).withColumn("doc_id", F.col("doc_id").cast("long"))
    with small_batches(docs.sparkSession):
        return _linked(docs, width, num, den, text_key)


def _linked(docs: DataFrame, width: int, num: int, den: int, text_key: bool) -> DataFrame:
    """``link_components`` of ``doc_id, text``; the table returned has no Python step."""
    rows = cut_lineage(shingle_heads(docs, width, num, den).withColumn("row", F.monotonically_increasing_id()), "shingles")
    # one row of each class, however often its id and text repeat
    named = rows.filter("n_shingles > 0 and doc_id is not null")
    first_row = F.min(F.struct("doc_id", "row"))
    classes = cut_lineage(named.groupBy("s1", "s2").agg(first_row.alias("first"))
                          .select("s1", "s2", F.col("first.doc_id").alias("rep"), F.col("first.row").alias("row")), "classes")
    # an id that represents several texts is one node; each text posts its own prefix.  The rows
    # that go are fewer than those that stay, and only their numbers are moved
    repeats = cut_lineage(named.select("row").join(classes.select("row"), "row", "left_anti"), "repeats")
    texts = _beside(named, repeats, "row", "left_anti")
    reps = texts.select(
        F.col("doc_id").alias("rep"), "s1", "s2", F.col("n_shingles").alias("n"), "head", "bits")
    with_heads, rows = rows, cut_lineage(rows.select("doc_id", "text_key", "n_shingles", "s1", "s2"), "shingles")
    histogram = {r[0]: r[1] for r in reps.filter(F.col("n") <= SMALL_MAX).groupBy("n").count().collect()}
    x = boundary(histogram, num, den)

    # components of near copies; from here on they count, not texts
    links = _near_copies(reps, docs, width, num, den)
    near = cut_lineage(components(links).select(F.col("node").alias("rep"), "component"), "near")
    placed = _beside(reps, near, "rep", "left")
    reps = placed.withColumn("component", F.coalesce("component", "rep"))

    posting = reps.filter(F.col("n") >= _least_share(x + 1, num, den)).withColumn(
        "p", (F.col("n") - F.ceil(F.col("n") * num / den) + 1).cast("int")).withColumnRenamed("head", "elements").drop("bits")
    first = _first_elements(posting, docs, width, num, den)
    lists = first.select("rep", "n", "component", F.posexplode("first").alias("pos", "bucket")).select(
        "bucket", "rep", "n", F.col("pos").cast("long").alias("pos"), "component")
    subsets = subset_buckets(reps, x, num, den)
    # the pivot of a bucket: the member that has its element earliest
    early = F.struct((F.col("pos") / F.col("n")).alias("r"), *[F.col(c).alias(c) for c in ("rep", "n", "pos", "component")])
    other = (F.col("component") != F.col("pivot.component")) & _may_link(
        F.col("n"), F.col("pos"), F.col("pivot.n"), F.col("pivot.pos"), num, den)
    members = cut_lineage(_shared_buckets(lists.unionByName(subsets))
                          .withColumn("pivot", F.min(early).over(Window.partitionBy("bucket")))
                          .withColumn("partner", F.when(other, F.col("pivot.rep"))).drop("pivot"), "members")
    drop_cut(first)

    comp = _merge(members, docs, reps, links, width, num, den)
    drop_cut(with_heads, repeats, near, links, texts, placed)
    node = classes.drop("row").join(comp, F.col("rep") == F.col("node"), "left").select(
        "s1", "s2", F.coalesce("component", "rep").alias("class_component"))
    return rows.join(node, ["s1", "s2"], "left").select(
        "doc_id", "n_shingles", F.coalesce("class_component", "doc_id").alias("component_id"), *["text_key"] * text_key)


def _first_elements(posting: DataFrame, docs: DataFrame, width: int, num: int, den: int) -> DataFrame:
    """``rep, n, component, first``, written: the first ``p`` elements of every set in the
    global order.  ``posting`` has their heads as ``elements``."""
    keys = ["rep", "s1", "s2", "n", "component", "p"]
    too_short = (F.col("n_light") < F.col("p")) & (F.size("ordered") < F.col("n"))
    sizes = (lambda n: LONGER * _head_size(n, num, den), None)
    of = lambda sets, short: sets.join(small(short), ["rep", "s1", "s2"]).select(*keys, "elements")

    # heavy elements: those that many heads post, and those that many of the texts share whose
    # shorter heads consist of such elements
    level, asked = posting, []
    heavy = _often(posting.select("component", F.explode("elements").alias("h")))
    for upto in sizes:
        short = cut_lineage(_light_first(level, heavy).filter(too_short).select(*keys).distinct(), "short")
        sets = cut_lineage(_fetch(docs, short, width, upto), "sets")
        level = of(sets, short)
        also = _often(level.select("component", F.explode("elements").alias("h")))
        narrower, heavy = heavy, cut_lineage(heavy.union(also).distinct(), "heavy")
        drop_cut(narrower, also)
        asked.append((short, sets))

    # the global order: light elements by hash, then heavy ones by hash
    prefix = F.slice("ordered", F.lit(1), F.col("p")).alias("first")
    level, first, done = posting, [], [heavy]
    for upto, (before, sets) in zip(sizes, asked):
        placed = cut_lineage(_light_first(level, heavy).withColumn(
            "first", F.when(~too_short, prefix)).drop("ordered", "n_light"), "placed")
        short = cut_lineage(placed.filter("first is null").drop("first").distinct(), "short")
        late = cut_lineage(_fetch(docs, short.join(before.select("rep"), "rep", "left_anti"), width, upto), "sets")
        level = of(sets.union(late), short)
        first.append(placed.filter("first is not null"))
        done += [before, sets, placed, short, late]
    # texts that were fetched come as often as their rows do
    longer = first[1].union(_light_first(level, heavy).select(*keys, prefix)).dropDuplicates(["rep", "s1", "s2"])
    out = cut_lineage(first[0].union(longer.select(*first[0].columns)).select("rep", "n", "component", "first"), "first")
    drop_cut(*done)
    return out


#: heavy elements that a task holds as one sorted array (16 MB); more take a shuffle join
HELD_HEAVY = 2_000_000
#: elements that a task orders at a time
HELD_ELEMENTS = 100_000


def _light_first(rows: DataFrame, heavy: DataFrame) -> DataFrame:
    """``rows`` with ``ordered``, the distinct ``elements`` in the global order (light ones by
    hash, then heavy ones by hash), and ``n_light``, the number of light ones; without
    ``elements``."""
    others = [c for c in rows.columns if c != "elements"]
    if heavy.count() <= HELD_HEAVY:
        table = share(rows.sparkSession, np.sort(heavy.toArrow()["h"].to_numpy()))

        def run(batches):
            known = table()
            for batch in batches:
                size = pc.list_value_length(batch.column("elements")).to_numpy(zero_copy_only=False)
                # a slice of about HELD_ELEMENTS elements at a time
                cuts = np.flatnonzero(np.diff(np.cumsum(size) // HELD_ELEMENTS)) + 1
                for a, b in zip([0, *cuts], [*cuts, len(size)]):
                    part = batch.slice(a, b - a)
                    values = part.column("elements").flatten().to_numpy(zero_copy_only=False)
                    ends = np.concatenate([[0], np.cumsum(size[a:b])]).astype(np.int32)
                    at = np.minimum(np.searchsorted(known, values), max(len(known) - 1, 0))
                    dear = known[at] == values if len(known) else np.zeros(len(values), bool)
                    row = np.repeat(np.arange(b - a, dtype=np.int32), np.diff(ends))
                    order = np.lexsort((values, dear, row))
                    light = np.bincount(row, weights=~dear, minlength=b - a).astype(np.int64)
                    ordered = pa.ListArray.from_arrays(pa.array(ends), pa.array(values[order], pa.int64()))
                    yield pa.record_batch([*[part.column(c) for c in others], ordered, pa.array(light)],
                                          names=[*others, "ordered", "n_light"])

        kinds = dict(rows.dtypes)
        return rows.select(*others, "elements").mapInArrow(
            run, ", ".join([*[f"{c} {kinds[c]}" for c in others], "ordered array<long>", "n_light long"]))
    # of the elements, only those that are heavy come back; a row is told by its id, and what
    # another text of the id brings along is heavy too
    hits = (rows.select("rep", F.explode("elements").alias("h")).join(heavy, "h", "left_semi")
            .groupBy("rep").agg(F.collect_set("h").alias("heavy")))
    none = F.array().cast("array<long>")
    return (rows.join(hits, "rep", "left").withColumn("heavy", F.coalesce("heavy", none))
            .withColumn("light", F.array_sort(F.array_except("elements", "heavy")))
            .withColumn("ordered", F.concat("light", F.array_sort(F.array_intersect("elements", "heavy"))))
            .select(*others, "ordered", F.size("light").cast("long").alias("n_light")))


def _often(rows: DataFrame) -> DataFrame:
    """The elements ``h`` that more than ``HEAVY`` components have, written.  Texts are counted
    first, by half of the element, which takes half the bytes to shuffle; only elements of many
    texts are then counted by component.  The first count is written too: joined as it is, all
    rows would be shuffled before its size is known."""
    half = F.col("h").bitwiseAND(F.lit(0xFFFFFFFF)).alias("half")
    many = lambda x, by: x.groupBy(by).agg(F.count(F.lit(1)).alias("k")).filter(F.col("k") > HEAVY).select(by)
    texts = cut_lineage(many(rows.select(half), "half"), "often")
    found = cut_lineage(many(rows.withColumn("half", half).join(small(texts), "half").select("h", "component").distinct(), "h"),
                        "heavy")
    drop_cut(texts)
    return found


#: rows of a table that is broadcast (one to six longs each, so at most about 70 MB as a hash
#: table); larger ones take a shuffle join
_BROADCAST_ROWS = 500_000


def _few(table: DataFrame) -> bool:
    return table.limit(_BROADCAST_ROWS + 1).count() <= _BROADCAST_ROWS


def small(table: DataFrame) -> DataFrame:
    """Broadcast hint for a narrow table whose row count allows it."""
    return F.broadcast(table) if _few(table) else table


def _beside(rows: DataFrame, table: DataFrame, on: str, how: str) -> DataFrame:
    """Wide ``rows`` joined with a narrow written table; written if they have to be shuffled
    for that, so that it happens once."""
    return rows.join(F.broadcast(table), on, how) if _few(table) else cut_lineage(rows.join(table, on, how), "heads")


def _fetch(docs: DataFrame, wanted: DataFrame, width: int, upto=None) -> DataFrame:
    """Sets ``rep, elements`` of the wanted ids (which may repeat), see ``full_sets``."""
    ids = wanted.select(F.col("rep").alias("doc_id")).distinct()
    return full_sets(docs.join(small(ids), "doc_id", "left_semi"), width, upto)


def _plausible(pairs: DataFrame, reps: DataFrame, num: int, den: int) -> DataFrame:
    """The pairs that their bitmaps do not rule out: where these differ, the sets differ, and a
    linked pair can differ only so much."""
    narrow = reps.join(small(_ends(pairs).distinct()), "rep", "left_semi")
    side = lambda x: narrow.select(F.col("rep").alias(x), F.col("n").alias(f"n_{x}"), F.col("bits").alias(f"bits_{x}"))
    both = pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", (F.col("n_a") + F.col("n_b")).alias("n"), "bits_a", "bits_b")

    def run(batches):
        for batch in batches:
            apart = [_bits_apart(x, y) for x, y in zip(batch.column("bits_a").to_pylist(), batch.column("bits_b").to_pylist())]
            n = batch.column("n").to_numpy()
            keep = (n - np.array(apart, np.int64)) * (num + den) >= 2 * num * n
            yield batch.select(["a", "b"]).filter(pa.array(keep))

    return both.mapInArrow(run, "a long, b long").distinct()


def _ends(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.explode(F.array("a", "b")).alias("rep"))


def _merge(members: DataFrame, docs: DataFrame, reps: DataFrame, links: DataFrame,
           width: int, num: int, den: int) -> DataFrame:
    """``node, component`` over the links found so far and those among bucket members."""
    star = cut_lineage(members.filter("partner is not null").select(*_pairs("rep", "partner")).distinct(), "star")
    likely = cut_lineage(_plausible(star, reps, num, den), "likely")
    found = _verified(likely, docs, width, num, den)
    links = links.union(found)
    drop_cut(likely)
    comp = components(links)
    # buckets that still span several components: their remaining pairs, one by one
    known = members.drop("component", "partner").join(small(comp.withColumnRenamed("node", "rep")), "rep", "left").withColumn(
        "component", F.coalesce("component", "rep"))
    known = cut_lineage(_shared_buckets(known), "open")
    drop_cut(members)
    u, v = known.alias("u"), known.alias("v")
    rest = u.join(v, (F.col("u.bucket") == F.col("v.bucket")) & (F.col("u.rep") < F.col("v.rep"))
                  & (F.col("u.component") != F.col("v.component"))
                  & _may_link(F.col("u.n"), F.col("u.pos"), F.col("v.n"), F.col("v.pos"), num, den))
    rest = cut_lineage(rest.select(F.col("u.rep").alias("a"), F.col("v.rep").alias("b")).distinct()
                       .join(star, ["a", "b"], "left_anti"), "rest")
    drop_cut(star, known)
    compared, rest = rest, cut_lineage(_plausible(rest, reps, num, den), "likely")
    drop_cut(compared)
    if rest.isEmpty():
        drop_cut(rest, found)
        return comp
    more = _verified(rest, docs, width, num, den)
    if not more.isEmpty():
        comp = components(links.union(more))
    drop_cut(rest, found, more)
    return comp
