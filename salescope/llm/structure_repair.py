"""Conversation structure repair by depth-first branch and bound.

A conversation is legal when the initials of its roles read ``(s?(ua)+)?``.  The
cheapest edits that make it legal are searched over the rows in order; a node of
the search is (rows done, last role).  The search keeps

* an explicit stack, most promising child on top,
* a *suffix lower bound* per row: the rest is cut into windows of a few rows,
  each of which must at least cost its own cheapest handling from any role to
  any role,
* an *incumbent*, the cheapest (cost, audit) known; a prefix whose cost and bound
  cannot beat it is dropped,
* a *dominance table*: per node the best (cost, audit) prefix that reached it; a
  worse one is dropped.

The search ends when the stack is empty, which proves the incumbent optimal.
(cost, audit) is preserved under appending: two prefixes of the same node with
the same cost are never a prefix of each other, since further letters cost more.
So a long conversation is searched in stretches of rows, the table's entries at
the end of one being the starts of the next, and time and memory grow with its
length and not with its square.

Rows travel to the search as one code each (role initial, fault), the texts go in
a second pass where the finished audit precedes the rows of its conversation
and a running digest takes them one by one: a task holds an audit and one Arrow
batch, never the texts of a conversation.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .inputs import pick

OK, BLANK, DUPLICATE, TRUNCATED = range(4)
#: last role of a legal prefix
START, SYSTEM, USER, ASSISTANT = range(4)
#: role initial of a row: s, u, a, any other
_INITIALS = "sua"
DROPPED = -1

KEEP, REROLE, DELETE, INSERT, CUT_OFF = 0, 1, 2, 5, 5      # costs
#: (role, initial of the row) -> role after keeping the row
_KEEPS = {(START, 0): SYSTEM, (START, 1): USER, (SYSTEM, 1): USER, (USER, 2): ASSISTANT, (ASSISTANT, 1): USER}
#: role after writing the only role that can follow
_NEXT = {START: USER, SYSTEM: USER, USER: ASSISTANT, ASSISTANT: USER}
_WRITTEN = {USER: "user", ASSISTANT: "assistant"}
_SPACE = " \t\n\x0b\x0c\r"

#: rows of a window of the lower bound, rows of a stretch of the search
_WINDOW, _STRETCH = 4, 16
#: results of conversations of at most so many rows are kept within a batch
_SHORT = 8


def _edits(code: int, role: int) -> Iterator[tuple[str, int, int]]:
    """(letter, cost, role after) of the edits of a row."""
    initial, fault = divmod(code, 4)
    yield "D", DELETE, role
    if fault not in (BLANK, DUPLICATE):
        extra = CUT_OFF if fault == TRUNCATED else 0
        if (role, initial) in _KEEPS:
            yield "K", KEEP + extra, _KEEPS[role, initial]
        yield "R", REROLE + extra, _NEXT[role]


def _window_cost(codes: bytes) -> int:
    """Least cost of a window of rows from any role to any role."""
    costs = dict.fromkeys(range(4), 0)
    for code in codes:
        for role, cost in list(costs.items()):
            after = _NEXT[role]
            costs[after] = min(costs[after], cost + INSERT)
        reached: dict[int, int] = {}
        for role, cost in costs.items():
            for _, extra, after in _edits(code, role):
                reached[after] = min(reached.get(after, 1 << 60), cost + extra)
        costs = {r: reached.get(r, 1 << 60) for r in range(4)}
    return min(costs.values())


def suffix_bounds(codes: bytes, known: dict | None = None) -> list[int]:
    """For every row, what the rows from there on cost at least.  ``known`` keeps
    the costs of windows between calls (there are 16 codes, so 16^4 windows)."""
    known = {} if known is None else known
    out = [0] * (len(codes) + 1)
    for i in range(len(codes) - 1, -1, -1):
        window = codes[i:i + _WINDOW]
        if window not in known:
            known[window] = _window_cost(window)
        out[i] = known[window] + out[min(i + _WINDOW, len(codes))]
    return out


def _first_solution(codes: bytes) -> int:
    """Cost of a quick legal repair: the bound that the search starts with."""
    cost, role = 0, START
    for code in codes:
        _, extra, role_after = min(_edits(code, role), key=lambda e: (e[1], e[0] != "K"))
        cost, role = cost + extra, role_after
    while role not in (START, ASSISTANT):
        cost, role = cost + INSERT, _NEXT[role]
    return min(cost, DELETE * len(codes))


def _search(codes: bytes, begin: int, end: int, starts: list, bounds: list[int], ceiling: int) -> dict:
    """Best (cost, rank of the start, letters) of every role at row ``end``, over
    all ways from ``starts`` (role, cost) at row ``begin``; ``ceiling`` is the
    cost of a known repair.  At the last row of the conversation roles are
    completed by insertions, and an incumbent is kept."""
    final = end == len(codes)
    best: dict[tuple[int, int], tuple] = {}
    stack = []
    for rank, (role, cost) in enumerate(starts):
        best[begin, role] = (cost, rank, "")
        stack.append((begin, role, best[begin, role]))
    stack.sort(key=lambda s: (-s[2][0], -s[2][1]))
    incumbent = (ceiling + 1, 0, "")
    while stack:
        i, role, label = stack.pop()
        if best[i, role] != label:                       # a better prefix came here since
            continue
        cost, rank, letters = label
        if cost + bounds[i] > ceiling or (cost + bounds[i], rank, letters) > (incumbent[0], incumbent[1],
                                                                              incumbent[2][:len(letters)]):
            continue
        if i == end:
            if final and role in (START, ASSISTANT):
                incumbent = min(incumbent, label)
                ceiling = min(ceiling, cost)
                continue
            if not final:
                continue
        edits = [] if i == end else [(i + 1, *e) for e in _edits(codes[i], role)]
        edits.append((i, "I", INSERT, _NEXT[role]))
        children = []
        for at, letter, extra, after in edits:
            child = (cost + extra, rank, letters + letter)
            if (at, after) not in best or child < best[at, after]:
                best[at, after] = child
                children.append((cost + extra + bounds[at], child, at, after))
        children.sort(reverse=True)
        stack += [(at, after, child) for _, child, at, after in children]
    if final:
        return {ASSISTANT: incumbent}
    return {role: best[end, role] for role in range(4) if (end, role) in best}


def repair(codes: bytes, known: dict | None = None) -> tuple[int, str]:
    """(cost, audit) of the cheapest legal repair of a conversation, the least
    audit among equals.  A code is 4 * role initial (0 s, 1 u, 2 a, 3 other)
    + fault (0 none, 1 blank, 2 duplicate, 3 truncated)."""
    bounds, ceiling = suffix_bounds(codes, known), _first_solution(codes)
    starts, parts = [(START, 0)], [None]
    begin = 0
    while True:
        end = min(begin + _STRETCH, len(codes))
        reached = _search(codes, begin, end, starts, bounds, ceiling)
        # ranks: whole audits in order, which (rank, letters) gives
        ranked = sorted(reached.items(), key=lambda r: r[1][1:])
        parts_now = [(parts[rank], letters) for _, (_, rank, letters) in ranked]
        if end == len(codes):
            pieces, at = [], parts_now[0]
            while at is not None:
                pieces.append(at[1])
                at = at[0]
            return ranked[0][1][0], "".join(reversed(pieces))
        starts, parts = [(role, cost) for role, (cost, _, _) in ranked], parts_now
        begin = end


class _Rewriter:
    """Feeds the repaired lines of one conversation to a digest."""

    def __init__(self, audit: str):
        self._audit, self._at, self._role, self._lines = audit, 0, START, 0
        self._digest = hashlib.sha256()

    def _line(self, role: str, text: str) -> None:
        self._digest.update(f"{chr(10) if self._lines else ''}{role}:{text}".encode())
        self._lines += 1

    def _insertions(self) -> None:
        while self._audit.startswith("I", self._at):
            self._at += 1
            self._role = _NEXT[self._role]
            self._line(_WRITTEN[self._role], "")

    def row(self, initial: int, role: str, text: str) -> None:
        self._insertions()
        letter = self._audit[self._at]
        self._at += 1
        if letter == "K":
            self._role = _KEEPS[self._role, initial]
            self._line(role, text)
        elif letter == "R":
            self._role = _NEXT[self._role]
            self._line(_WRITTEN[self._role], text)

    def digest(self) -> str:
        self._insertions()
        return self._digest.hexdigest()


def damaged(conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn",
            role_col: str = "role", text_col: str = "text") -> DataFrame:
    """The contract's damage, by d = crc32(``conv_id:turn``) % 20: 0 drops a row
    (it stays here with ``dropped``), 1 empties its text, 2 removes ``[.!?]``, 3
    repeats it, 4 sets role ``user``.  A null in any of the four columns counts as
    one space.  ``conv_id, turn, dropped, role, text`` and the order ``tie, copy``
    of rows of one turn: role, digest of the text as given, copy."""
    rows = pick(conversations, conv_id=conv_col, turn=turn_col, role=role_col, text=text_col)

    def spaced(c: str) -> Column:
        return F.coalesce(F.col(c).cast("string"), F.lit(" "))

    damage = (F.crc32(F.concat_ws(":", spaced("conv_id"), spaced("turn")).cast("binary")) % 20).cast("int")
    rows = rows.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
                       spaced("role").alias("role"), spaced("text").alias("text"), damage.alias("d"))
    d = F.col("d")
    copies = F.sequence(F.lit(0), F.when(d == 3, 1).otherwise(0))
    return rows.select(
        "conv_id", "turn", (d == 0).alias("dropped"), F.struct("role", F.xxhash64("text").alias("t")).alias("tie"),
        F.explode(copies).alias("copy"), F.when(d == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(d == 1, "").when(d == 2, F.translate("text", ".!?", "")).otherwise(F.col("text")).alias("text"))


def undamaged(conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn",
              role_col: str = "role", text_col: str = "text") -> DataFrame:
    """The rows as given in the form that ``repair_conversations`` takes; nulls as there."""
    rows = pick(conversations, conv_id=conv_col, turn=turn_col, role=role_col, text=text_col)
    role, text = F.coalesce("role", F.lit(" ")), F.coalesce("text", F.lit(" "))
    return rows.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
                       F.lit(False).alias("dropped"), F.struct(role.alias("role"), F.xxhash64(text).alias("t")).alias("tie"),
                       F.lit(0).alias("copy"), role.alias("role"), text.alias("text"))


def _coded(rows: DataFrame) -> DataFrame:
    """The rows with ``code``; texts that no repair can use are null from here on."""
    bare = F.translate("text", _SPACE, "")
    same = (Window.partitionBy("conv_id", "role", "t1", "t2")
            .orderBy(F.col("turn").asc_nulls_first(), "tie", "copy"))
    marks = rows.select(
        "conv_id", "turn", "dropped", "tie", "copy", "role",
        F.xxhash64(F.lit(1), "text").alias("t1"), F.xxhash64(F.lit(2), "text").alias("t2"),
        (bare == "").alias("blank"),
        (~F.substring(bare, -1, 1).isin(".", "!", "?")).alias("open")).filter("not dropped")
    fault = (F.when(F.col("blank"), BLANK).when(F.row_number().over(same) > 1, DUPLICATE)
             .when(F.col("open"), TRUNCATED).otherwise(OK))
    initial = F.substring("role", 1, 1)
    place = F.when(initial == "s", 0).when(initial == "u", 1).when(initial == "a", 2).otherwise(3)
    return marks.select("conv_id", "turn", "tie", "copy", (place * 4 + fault).alias("code"))


def _audits(coded: DataFrame) -> DataFrame:
    """One row per conversation: its counts, cost and audit."""
    schema = pa.schema([("conv_id", pa.int64()), *[(c, pa.int64()) for c in (
        "gaps", "blank", "duplicate", "truncated", "illegal", "cost")], ("audit", pa.string())])

    def closed(conv, codes: bytearray, turns: list, windows: dict, short: dict) -> dict:
        low, high, distinct = turns
        initials = [c // 4 for c in codes]
        faults = [0] * 4
        for c in codes:
            faults[c % 4] += 1
        legal = {(0, 1), (1, 2), (2, 1)}
        if len(codes) > _SHORT:
            cost, audit = repair(bytes(codes), windows)
        else:               # most conversations repeat a short pattern
            if bytes(codes) not in short:
                short[bytes(codes)] = repair(bytes(codes), windows)
            cost, audit = short[bytes(codes)]
        return {"conv_id": conv, "gaps": high - low + 1 - distinct if distinct else 0,
                "blank": faults[BLANK], "duplicate": faults[DUPLICATE], "truncated": faults[TRUNCATED],
                "illegal": sum(p not in legal for p in zip(initials, initials[1:])), "cost": cost, "audit": audit}

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, codes, turns, caches = None, None, None, ({}, {})
        for batch in batches:
            done = []
            caches[1].clear()
            for now, turn, code in zip(*(batch[c].to_pylist() for c in ("conv_id", "turn", "code"))):
                if codes is None or now != conv:
                    if codes is not None:
                        done.append(closed(conv, codes, turns, *caches))
                    conv, codes, turns = now, bytearray(), [0, 0, 0]
                if code == DROPPED:
                    continue
                codes.append(code)
                if turn is not None and (not turns[2] or turn != turns[1]):      # rows come in order of turn
                    turns = [turn if not turns[2] else turns[0], turn, turns[2] + 1]
            if done:
                yield pa.RecordBatch.from_pylist(done, schema)
        if codes is not None:
            yield pa.RecordBatch.from_pylist([closed(conv, codes, turns, *caches)], schema)

    in_order = coded.repartition("conv_id").sortWithinPartitions(
        "conv_id", F.col("turn").asc_nulls_first(), "tie", "copy").select("conv_id", "turn", "code")
    return in_order.mapInArrow(
        solve, "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string")


def repair_conversations(rows: DataFrame) -> DataFrame:
    """One row per conversation of ``damaged`` or ``undamaged`` rows: ``conv_id, gaps,
    blank, duplicate, truncated, illegal, cost, audit, repaired_sha256``.

    A row's first fault counts: blank, duplicate (role and text seen earlier),
    truncated.  A null conversation id is a conversation of its own; one whose
    rows were all dropped has zeros, an empty audit and the digest of the empty
    text.  Rows of one turn follow role and digest of the text as given, repeated
    ones each other.  A role that starts with none of s, u, a (empty or null
    ones too) fits nowhere and is renamed or deleted.  Very long texts are read
    whole; an empty table gives an empty result.
    """
    ends = rows.filter("dropped").select("conv_id", F.lit(None).cast("long").alias("turn"), "tie", "copy",
                                         F.lit(DROPPED).alias("code"))
    coded = _coded(rows)
    audits = _audits(coded.union(ends))
    initial = F.substring("role", 1, 1)
    place = F.when(initial == "s", 0).when(initial == "u", 1).when(initial == "a", 2).otherwise(3)
    none = F.lit(None)
    heads = audits.select("conv_id", F.lit(0).alias("part"), none.cast("long").alias("turn"),
                          none.cast(dict(rows.dtypes)["tie"]).alias("tie"), F.lit(0).alias("copy"),
                          F.lit(0).alias("initial"), none.cast("string").alias("role"), F.col("audit").alias("text"),
                          F.struct("gaps", "blank", "duplicate", "truncated", "illegal", "cost").alias("counts"))
    lines = rows.filter("not dropped").select(
        "conv_id", F.lit(1), "turn", "tie", "copy", place, "role", "text",
        none.cast(dict(heads.dtypes)["counts"]))
    in_order = heads.union(lines).repartition("conv_id").sortWithinPartitions(
        "conv_id", "part", F.col("turn").asc_nulls_first(), "tie", "copy").select(
        "conv_id", "part", "initial", "role", "text", "counts")
    counts = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
    schema = pa.schema([("conv_id", pa.int64()), *[(c, pa.int64()) for c in counts], ("audit", pa.string()),
                        ("repaired_sha256", pa.string())])

    def rewrite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head, lines = None, None
        for batch in batches:
            done = []
            for conv, part, initial, role, text, kept in zip(*(batch[c].to_pylist() for c in (
                    "conv_id", "part", "initial", "role", "text", "counts"))):
                if part == 0:
                    if head is not None:
                        done.append(head | {"repaired_sha256": lines.digest()})
                    head, lines = {"conv_id": conv, **kept, "audit": text}, _Rewriter(text)
                else:
                    lines.row(initial, role, text)
            if done:
                yield pa.RecordBatch.from_pylist(done, schema)
        if head is not None:
            yield pa.RecordBatch.from_pylist([head | {"repaired_sha256": lines.digest()}], schema)

    return in_order.mapInArrow(
        rewrite, ", ".join(["conv_id long", *[f"{c} long" for c in counts], "audit string", "repaired_sha256 string"]))
