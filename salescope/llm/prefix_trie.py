"""Prefix trie of conversations by whole-sequence collapse.

1. *Collapse*: conversations whose turns are all equal become one weighted
   sequence.  Its member with the smallest id stands for it; the ids of all
   members (the end list of the node where they end) go into a digest.
2. *Leaves*: only now every sequence is spread into its prefixes.  Sequences that
   are a proper prefix of another one are dropped by an anti-join; what is left
   are the leaves of the trie.
3. *Weighted prefixes*: one aggregation over the prefixes gives members, smallest
   member and leaves of every node.

A prefix is known by 128 bits: the exclusive or of the position-tagged hashes of
its turns, so whole conversations are compared by a plain aggregation and
prefixes by a running one, and no text leaves the first projection.

What a subtree saves is the sum of (members - 1) * bytes over its nodes, that is
sum(members * bytes) - sum(bytes).  The first part is, over the sequences through
a node, weight * bytes from that depth on.  In the second each node must count
once: it counts with the sequence of its smallest member.  That sequence owns
all deeper nodes of its path too (the smallest of a set is the smallest of its
subsets), so one depth per sequence, where it starts to own nodes, is enough.

A frequent first turn or a conversation that a third of all others repeat is
one key of partial aggregations only; children ask for their parent in salted
groups.  A single conversation is numbered
by a window, which streams and spills.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage
from .inputs import pick

#: ids of one piece of an end list lie in one range of this many integers
_ENDS = 1000
#: groups in which the children of a node ask for their parent
_SALTS = 64


def numbered_turns(conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn",
                   role_col: str = "role", text_col: str = "text") -> DataFrame:
    """``conv, pos, h1, h2, bytes``: the turns of each conversation, numbered from 1.

    Order: turn (null first), role, digest of the text; turns that are equal in
    all of these are interchangeable.  A null role or text is empty.  Rows
    without a conversation id belong to no conversation and are left out.
    """
    rows = pick(conversations, conv=conv_col, turn=turn_col, role=role_col, text=text_col).filter("conv is not null")
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    rows = rows.select(F.col("conv").cast("long").alias("conv"), "turn", role.alias("role"),
                       F.xxhash64(F.lit(1), role, text).alias("h1"), F.xxhash64(F.lit(2), text, role).alias("h2"),
                       F.octet_length(text).cast("long").alias("bytes"))
    order = Window.partitionBy("conv").orderBy(F.col("turn").asc_nulls_first(), "role", "h1", "h2")
    return rows.select("conv", F.row_number().over(order).alias("pos"), "h1", "h2", "bytes")


def rebuilt_turns(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(turns ``conv, pos, h1, h2, bytes``, conversations ``conv, len``) after every
    conversation c took over the first h turns of conversation c - c % 5 (fewer
    if that has fewer, none if it is absent) in place of its own first h turns;
    h = crc32(decimal c) % 9.

    A conversation serves at most nine others and gives at most eight turns to each.
    """
    c = F.col("conv")
    sizes = turns.groupBy("conv").agg(F.max("pos").alias("n"))
    asked = sizes.select("conv", "n", (F.crc32(c.cast("string").cast("binary")) % 9).cast("int").alias("h"),
                         (c - c % 5).alias("base"))
    known = sizes.select(F.col("conv").alias("base"), F.col("n").alias("base_n"))
    convs = asked.join(known, "base", "left").select(
        "conv", "h", "base", F.least("h", F.coalesce("base_n", F.lit(0))).alias("k"),
        (F.least("h", F.coalesce("base_n", F.lit(0))) + F.greatest(F.col("n") - F.col("h"), F.lit(0))).alias("len"))
    own = (turns.join(convs.select("conv", "h", "k"), "conv").filter("pos > h")
           .select("conv", (F.col("k") + F.col("pos") - F.col("h")).alias("pos"), "h1", "h2", "bytes"))
    given = turns.filter("pos <= 8 and conv % 5 = 0").withColumnRenamed("conv", "base")
    taken = (given.join(convs.filter("k > 0").select("conv", "base", "k"), "base").filter("pos <= k")
             .select("conv", "pos", "h1", "h2", "bytes"))
    return own.union(taken), convs.select("conv", "len")


def _tagged(first: str, second: str, seed: int):
    return F.xxhash64(F.lit(seed), "pos", first, second)


def weighted_sequences(turns: DataFrame, convs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(members ``conv, len, x1, x2``, sequences ``len, x1, x2, rep, weight``):
    identical conversations collapsed, ``rep`` their smallest id."""
    whole = turns.groupBy("conv").agg(F.bit_xor(_tagged("h1", "h2", 3)).alias("x1"),
                                      F.bit_xor(_tagged("h2", "h1", 4)).alias("x2"))
    zero = F.lit(0).cast("long")
    members = convs.join(whole, "conv", "left").select(
        "conv", "len", F.coalesce("x1", zero).alias("x1"), F.coalesce("x2", zero).alias("x2"))
    members = cut_lineage(members, "trie-members")
    return members, members.groupBy("len", "x1", "x2").agg(F.min("conv").alias("rep"),
                                                           F.count(F.lit(1)).alias("weight"))


def end_digests(members: DataFrame) -> DataFrame:
    """``len, x1, x2, ends_sha256``: SHA-256 of the decimal ids of each sequence's
    members, ascending and comma-joined.

    Ids of one range of ``_ENDS`` integers are joined first, so a row holds at
    most that many; a task then feeds the pieces of a sequence, in order, to one
    running digest and keeps no list.
    """
    ids = F.array_join(F.array_sort(F.collect_list("conv")).cast("array<string>"), ",")
    pieces = (members.groupBy("len", "x1", "x2", F.floor(F.col("conv") / F.lit(_ENDS)).alias("at"))
              .agg(ids.alias("ids")))
    keys = ["len", "x1", "x2"]
    in_order = pieces.repartition(*keys).sortWithinPartitions(*keys, "at")

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state = None, None
        names = [*keys, "ends_sha256"]
        for batch in batches:
            done = []
            for *now, ids in zip(*(batch[c].to_pylist() for c in [*keys, "ids"])):
                if now == key:
                    state.update(b",")
                else:
                    if key is not None:
                        done.append((*key, state.hexdigest()))
                    key, state = now, hashlib.sha256()
                state.update(ids.encode())
            if done:
                yield pa.RecordBatch.from_pylist([dict(zip(names, d)) for d in done], schema)
        if key is not None:
            yield pa.RecordBatch.from_pylist([dict(zip(names, (*key, state.hexdigest())))], schema)

    schema = pa.schema([("len", pa.int32()), ("x1", pa.int64()), ("x2", pa.int64()), ("ends_sha256", pa.string())])
    return in_order.mapInArrow(digest, "len int, x1 long, x2 long, ends_sha256 string")


def prefixes(turns: DataFrame, sequences: DataFrame) -> DataFrame:
    """``rep, weight, len, depth, p1, p2, q1, q2, bytes, rest``: every prefix of every
    sequence, the empty one included.  p: its hash, q: that of the prefix before
    it, ``bytes``: those of its last text, ``rest``: bytes from there to the end."""
    steps = turns.join(sequences.select(F.col("rep").alias("conv"), "rep", "weight", "len"), "conv")
    so_far = Window.partitionBy("rep").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    t1, t2 = _tagged("h1", "h2", 3), _tagged("h2", "h1", 4)
    steps = steps.select("rep", "weight", "len", "pos", t1.alias("t1"), t2.alias("t2"), "bytes")
    totals = steps.groupBy("rep").agg(F.sum("bytes").alias("total"))
    steps = steps.withColumns({"p1": F.bit_xor("t1").over(so_far), "p2": F.bit_xor("t2").over(so_far),
                               "run": F.sum("bytes").over(so_far)})
    steps = steps.join(totals, "rep").select(
        "rep", "weight", "len", F.col("pos").alias("depth"), "p1", "p2",
        F.col("p1").bitwiseXOR(F.col("t1")).alias("q1"), F.col("p2").bitwiseXOR(F.col("t2")).alias("q2"),
        "bytes", (F.col("total") - F.col("run") + F.col("bytes")).alias("rest"))
    zero, none = F.lit(0).cast("long"), F.lit(None).cast("long")
    roots = sequences.join(totals, "rep", "left").select(
        "rep", "weight", "len", F.lit(0).alias("depth"), zero.alias("p1"), zero.alias("p2"), none.alias("q1"),
        none.alias("q2"), zero.alias("bytes"), F.coalesce("total", zero).alias("rest"))
    return steps.union(roots)


def leaf_sequences(paths: DataFrame, sequences: DataFrame) -> DataFrame:
    """The sequences that are no proper prefix of another one."""
    inner = paths.filter("depth < len").select(F.col("depth").alias("len"), F.col("p1").alias("x1"),
                                               F.col("p2").alias("x2")).distinct()
    return sequences.join(inner, ["len", "x1", "x2"], "left_anti")


def trie_nodes(turns: DataFrame, convs: DataFrame) -> DataFrame:
    """One row per distinct prefix of the conversations ``convs`` (conv, len) with
    the turns ``turns`` (conv, pos, h1, h2, bytes; pos from 1 without gaps):
    ``conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens,
    ends_sha256``, all but the digest long.

    ``conv_id`` is the smallest member; with ``depth`` it names the node.  A node
    where no conversation ends has the digest of the empty list.  Conversations
    without turns are members of the root (depth 0) only.  No conversation at
    all gives no node.
    """
    members, sequences = weighted_sequences(turns, convs)
    sequences = cut_lineage(sequences, "trie-sequences")
    paths = cut_lineage(prefixes(turns, sequences), "trie-prefixes")
    leaves = leaf_sequences(paths, sequences).select("rep", F.lit(1).alias("leaf"))

    node = ["depth", "p1", "p2"]
    nodes = (paths.join(leaves, "rep", "left").groupBy(*node)
             .agg(F.sum("weight").alias("n_convs"), F.min("rep").alias("rep"), F.min("q1").alias("q1"),
                  F.min("q2").alias("q2"), F.sum("leaf").alias("n_leaves"),
                  F.sum(F.col("weight") * F.col("rest")).alias("carried")))
    nodes = cut_lineage(nodes, "trie-nodes")

    # where each sequence starts to own nodes, and the bytes it owns
    tops = nodes.groupBy("rep").agg(F.min("depth").alias("top"))
    owned = paths.join(tops, "rep").filter("depth = top").select("rep", "top", F.col("rest").alias("owned"))
    counted = paths.join(owned, "rep").groupBy(*node).agg(
        F.sum(F.when(F.col("depth") >= F.col("top"), F.col("rest")).otherwise(F.col("owned"))).alias("stored"))
    children = nodes.filter("depth > 0").groupBy((F.col("depth") - 1).alias("depth"), F.col("q1").alias("p1"),
                                                 F.col("q2").alias("p2")).agg(F.count(F.lit(1)).alias("n_children"))
    # below its top a sequence is its own parent; only tops look for theirs.  A node
    # may have any number of children: they ask in _SALTS groups per parent
    above = nodes.select((F.col("depth") + 1).alias("depth"), F.col("p1").alias("q1"), F.col("p2").alias("q2"),
                         F.col("rep").alias("parent"))
    asking = (nodes.join(tops, "rep").filter("depth = top and depth > 0")
              .select(*node, "q1", "q2", F.pmod("p1", F.lit(_SALTS)).alias("salt")))
    answers = asking.select("depth", "q1", "q2", "salt").distinct().join(above, ["depth", "q1", "q2"])
    parents = asking.join(answers, ["depth", "q1", "q2", "salt"]).select(*node, "parent")
    ends = end_digests(members).select(F.col("len").alias("depth"), F.col("x1").alias("p1"),
                                       F.col("x2").alias("p2"), "ends_sha256")
    zero = F.lit(0)
    out = (nodes.join(counted, node).join(children, node, "left").join(parents, node, "left")
           .join(ends, node, "left"))
    return out.select(
        F.col("rep").alias("conv_id"), F.col("depth").cast("long").alias("depth"),
        F.when(F.col("depth") > 0, F.coalesce("parent", "rep")).alias("parent_conv_id"),
        "n_convs", F.coalesce("n_children", zero).cast("long").alias("n_children"),
        F.coalesce("n_leaves", zero).cast("long").alias("n_leaves"),
        (F.col("carried") - F.col("stored")).alias("saved_tokens"),
        F.coalesce("ends_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("ends_sha256"))


def conversation_trie(conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn",
                      role_col: str = "role", text_col: str = "text", rebuild: bool = False) -> DataFrame:
    """``trie_nodes`` of a table of turns, of its ``rebuilt_turns`` if asked for.

    Nulls, ties and rows without an id: see ``numbered_turns``.  Repeated rows
    are turns of their own.  Empty and very long texts take part whole (their
    digests do).  Other columns are ignored; an empty table gives no node.
    """
    turns = cut_lineage(numbered_turns(conversations, conv_col, turn_col, role_col, text_col), "trie-turns")
    if rebuild:
        rows, convs = rebuilt_turns(turns)
        rebuilt = cut_lineage(rows, "trie-rebuilt")
        return trie_nodes(rebuilt, convs)
    return trie_nodes(turns, turns.groupBy("conv").agg(F.max("pos").alias("len")))
