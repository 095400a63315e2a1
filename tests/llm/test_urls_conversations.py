"""URL filter, conversation trie and structure repair against plain brute force."""

import hashlib
import itertools
import random
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from salescope.llm import prefix_trie, queries, structure_repair, url_filter
from salescope.llm.structure_repair import _NEXT, _edits

SF = "/root/testdata/sf0.001"
EMPTY = hashlib.sha256(b"").hexdigest()


# --- URL filter ---------------------------------------------------------------------------------

def test_url_filter_equals_sql(spark):
    con = duckdb.connect()
    con.execute(f"create view pages as select * from '{SF}/pages.parquet'")
    want = sorted(map(str, con.sql("select page_id, host, path, rule, verdict from ("
                                   + queries.ORACLE["op11_url_filter"] + ")").fetchall()))
    got = sorted(str(tuple(r)) for r in queries.QUERIES["op11_url_filter"](spark, SF).collect())
    assert got == want and any("block" in g for g in got)


def _parts(url):
    rest = (url or "").partition("://")[2]
    n = next((i for i, c in enumerate(rest) if c in "/?#"), len(rest))
    host = rest[:n].translate({c: c + 32 for c in range(65, 91)})
    m = next((i for i, c in enumerate(rest[n:]) if c in "?#"), len(rest) - n)
    return host, rest[n:n + m]


def _plain_verdict(url, rules, words):
    host, path = _parts(url)
    fits = [(len(h + p), len(h), h + p, v) for h, p, v in rules
            if (host == h or host.endswith("." + h)) and path.startswith(p)]
    if fits:
        return host, path, max(fits)[2], max(fits)[3]
    said = {words[w] for w in host.replace("-", ".").replace("_", ".").split(".") if w in words}
    return host, path, None, min(said) if said else "allow"


URLS = [None, "", "no scheme", "http://", "HTTPS://WWW.Example.COM", "http://a.com/x?y#z", "ftp://u:p@b.a.com:80/x/y",
        "http://com/", "x://a.com//x", "http://é.a.com/ñ/ü", "http://pills.a.com", "http://good-pills.b.org/",
        "http://a.com/" + "x" * 300_000, "http://a.com?q=http://evil.org/", "http://a..com/x", "http://.com/"]


@pytest.mark.parametrize("collide", [False, True])
def test_url_filter_equals_brute_force(spark, collide):
    rng = random.Random(7)
    hosts = ["com", "a.com", "b.a.com", "evil.org", "org", "é.a.com", "c.d.e.net"]
    paths = ["/", "/x", "/x/", "/x/y", "/ñ", "/" + "x" * 200]
    rules = list({(rng.choice(hosts), rng.choice(paths)): rng.choice(["allow", "block"]) for _ in range(25)}.items())
    rules = [(h, p, v) for (h, p), v in rules]
    rules += [(f"h{i}.org", f"/{i % 7}", "block") for i in range(300)]
    words = {"pills": "block", "good": "allow", "spam": "block"}
    urls = URLS + [f"http://{rng.choice(['', 'w.', 'spam-x.'])}{rng.choice(hosts)}{rng.choice(paths)}{rng.choice(['', '?x', 'z'])}"
                   for _ in range(300)] + [f"http://h{i}.org/{i % 9}" for i in range(300)]
    pages = spark.createDataFrame([(i, u, "h", "r") for i, u in enumerate(urls)] + [(None, "http://a.com/x", "", "")],
                                  "page_id long, url string, host string, rule string")
    extra = {}
    if collide:         # all digests are 0 to 2
        extra = {"hashes": lambda keys: np.array([len(k) % 3 for k in keys], np.int64)}
    index = url_filter.build_index(
        spark.createDataFrame(rules + [("a.com", None, "block"), rules[0][:2] + ("block",)],
                              "host string, path string, verdict string"),
        spark.createDataFrame(list(words.items()), "word string, verdict string"), piece_rows=100,
        **({"digest": lambda k: (F.octet_length(k) % 3).cast("long")} if collide else {}))
    assert len(index.pieces) > 1
    got = {r.page_id: tuple(r)[1:] for r in url_filter.judge_urls(pages, index, **extra).collect()}
    first = rules[0]
    same = [min(first[2], "block") if r[:2] == first[:2] else r[2] for r in rules]
    rules = [(h, p, v) for (h, p, _), v in zip(rules, same)]
    assert len(got) == len(urls) + 1
    for i, u in enumerate(urls):
        assert got[i] == _plain_verdict(u, rules, words), u
    assert got[None][:2] == ("a.com", "/x")
    assert url_filter.judge_urls(pages.limit(0), index, **extra).count() == 0


def test_url_filter_without_rules(spark):
    pages = spark.createDataFrame([(1, "http://a.com/"), (1, "http://a.com/")], "page_id long, url string")
    index = url_filter.build_index(spark.createDataFrame([], "host string, path string, verdict string"))
    assert [tuple(r) for r in url_filter.judge_urls(pages, index, default="block").collect()] == [
        (1, "a.com", "/", None, "block")] * 2


# --- conversation trie --------------------------------------------------------------------------

SCHEMA = "conv_id long, turn long, role string, text string, pos int, depth long, weight long"


def _table(spark, rows):
    return spark.createDataFrame([(*r, 1, 2, 3) for r in rows], SCHEMA)


def _plain_rebuilt(rows):
    convs = {}
    for c, t, role, text in rows:
        if c is not None:
            convs.setdefault(c, []).append((t is not None, t or 0, role or "", text or ""))
    turns = {c: [x[2:] for x in sorted(v, key=lambda x: x[:3])] for c, v in convs.items()}
    out = {}
    for c, own in turns.items():
        h = zlib.crc32(str(c).encode()) % 9
        base = turns.get(c - int(np.fmod(c, 5)), [])
        out[c] = base[:h] + own[h:]
    return out


def _plain_trie(convs):
    members = {}
    for c, seq in convs.items():
        for d in range(len(seq) + 1):
            members.setdefault(tuple(seq[:d]), []).append(c)
    out = []
    for node, found in members.items():
        below = [n for n in members if n[:len(node)] == node]
        inner = {n[:-1] for n in members if n}
        ends = sorted(c for c in found if len(convs[c]) == len(node))
        out.append((min(found), len(node), min(members[node[:-1]]) if node else None, len(found),
                    sum(len(n) == len(node) + 1 for n in below), sum(n not in inner for n in below),
                    sum((len(members[n]) - 1) * len(n[-1][1].encode()) for n in below if n),
                    hashlib.sha256(",".join(map(str, ends)).encode()).hexdigest()))
    return sorted(out, key=str)


def _trie(df, **kw):
    return sorted((tuple(r) for r in prefix_trie.conversation_trie(df, **kw).collect()), key=str)


def test_trie_query_equals_brute_force(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/conversations.parquet").collect()]
    got = sorted((tuple(r) for r in queries.QUERIES["op12_prefix_trie"](spark, SF).collect()), key=str)
    assert got == _plain_trie(_plain_rebuilt(rows))


def test_trie_of_small_alphabet(spark):
    """Many equal prefixes, conversations that end inside others, and all edge rows."""
    rng = random.Random(3)
    rows = [(c, t, rng.choice("ua"), rng.choice(["x", "yé"])) for c in [*range(-12, 60), 1000, 1500, 2500, 12345678901]
            for t in range(rng.choice([1, 2, 3, 5, 12]))]
    rows += [(70, t, "u", "same") for t in range(9)] + [(75, t, "u", "same") for t in range(9)]
    rows += [(71, None, "u", "first"), (71, 0, None, None), (72, 5, "u", "z" * 200_000), (73, 0, "u", "x"),
             (73, 0, "u", "x"), (None, 0, "u", "nobody's"), (74, 1, "", "")]
    df = _table(spark, rows)
    assert _trie(df, rebuild=True) == _plain_trie(_plain_rebuilt(rows))
    plain = {}
    for c, t, role, text in sorted((r for r in rows if r[0] is not None), key=lambda r: (r[0], r[1] is not None, r[1] or 0)):
        plain.setdefault(c, []).append((role or "", text or ""))
    assert _trie(df) == _plain_trie(plain)
    assert _trie(df.limit(0), rebuild=True) == []


def test_trie_of_copies_only(spark):
    df = _table(spark, [(c, t, "u", f"t{t}") for c in range(2500) for t in range(3)])
    got = _trie(df)
    assert len(got) == 4
    ends = ",".join(map(str, range(2500)))
    assert [r for r in got if r[1] == 3] == [(0, 3, 0, 2500, 0, 1, 2499 * 2, hashlib.sha256(ends.encode()).hexdigest())]
    assert [r for r in got if r[1] == 0] == [(0, 0, None, 2500, 1, 1, 2499 * 6, EMPTY)]


# --- structure repair ---------------------------------------------------------------------------

def _plain_repair(codes):
    """Best (cost, audit) per last role, row by row, without bounds or search."""
    def with_insertions(best):
        changed = True
        while changed:
            changed = False
            for role, (cost, audit) in list(best.items()):
                new, after = (cost + 5, audit + "I"), _NEXT[role]
                if after not in best or new < best[after]:
                    best[after], changed = new, True
        return best
    best = {0: (0, "")}
    for code in codes:
        best, before = {}, with_insertions(best)
        for role, (cost, audit) in before.items():
            for letter, extra, after in _edits(code, role):
                new = (cost + extra, audit + letter)
                best[after] = min(best.get(after, new), new)
    best = with_insertions(best)
    return min(v for role, v in best.items() if role in (0, 3))


def _legal(initials):
    rest = initials[1:] if initials[:1] == "s" and len(initials) > 1 else initials
    return rest == "ua" * (len(rest) // 2)


def _exhaustive(rows):
    """All edit sequences of a tiny conversation, straight from the rules."""
    best = None
    gaps = [["", "I", "II"]] * (len(rows) + 1)
    for letters in itertools.product("KRD", repeat=len(rows)):
        for holes in itertools.product(*gaps):
            audit = "".join(h + x for h, x in itertools.zip_longest(holes, letters, fillvalue=""))
            for names in itertools.product("ua", repeat=sum(x in "RI" for x in audit)):
                names, cost, out, row = list(names), 0, "", 0
                for x in audit:
                    if x == "I":
                        cost, out = cost + 5, out + names.pop(0)
                        continue
                    initial, fault = rows[row]
                    row += 1
                    if x == "D":
                        cost += 2
                        continue
                    if fault in (1, 2):
                        cost = None
                        break
                    cost += (x == "R") + 5 * (fault == 3)
                    out += initial if x == "K" else names.pop(0)
                if cost is not None and _legal(out) and (best is None or (cost, audit) < best):
                    best = (cost, audit)
    return best


def test_search_equals_exhaustive_enumeration():
    rng = random.Random(5)
    for n in (0, 1, 2, 3) * 12:
        rows = [(rng.choice("suax"), rng.choice([0, 0, 1, 2, 3])) for _ in range(n)]
        assert structure_repair.repair(bytes("suax".index(i) * 4 + f for i, f in rows)) == _exhaustive(rows), rows


def test_search_of_long_conversations():
    rng = random.Random(6)
    for n in (5, 15, 16, 17, 33, 100, 1000):
        for faults in ([0, 0, 0, 3], [0, 1, 2, 3], [3], [3, 3, 0]):
            for initials in ([1, 2], [0, 1, 2, 3], [1], [2]):
                codes = bytes(rng.choice(initials) * 4 + rng.choice(faults) for _ in range(n))
                assert structure_repair.repair(codes) == _plain_repair(codes)
    bounds = structure_repair.suffix_bounds(bytes([4, 4, 9, 15, 0, 8] * 5))
    assert bounds[-1] == 0 and bounds[0] <= structure_repair.repair(bytes([4, 4, 9, 15, 0, 8] * 5))[0]


def _plain_structure(rows):
    """The contract, conversation by conversation."""
    convs = {}
    for c, t, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        kept = convs.setdefault(c, [])
        d = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        tie = (t is not None, t or 0, role, text)
        if d == 1:
            text = ""
        if d == 2:
            text = text.translate({ord(x): None for x in ".!?"})
        if d == 4:
            role = "user"
        if d:
            kept += [(tie, role, text, t)] * (2 if d == 3 else 1)
    out = []
    for c, kept in convs.items():
        kept.sort(key=lambda k: k[0])
        seen, codes, faults = set(), [], [0] * 4
        for _, role, text, _ in kept:
            bare = text.translate({ord(x): None for x in " \t\n\x0b\x0c\r"})
            fault = 1 if not bare else 2 if (role, text) in seen else 3 if bare[-1] not in ".!?" else 0
            seen.add((role, text))
            faults[fault] += 1
            codes.append(("sua".find(role[:1] or " ") % 4) * 4 + fault)
        turns = [t for *_, t in kept if t is not None]
        pairs = [(a[1][:1] + b[1][:1]) for a, b in zip(kept, kept[1:])]
        cost, audit = _plain_repair(codes)
        lines, last, at = [], 0, iter(kept)
        for x in audit:
            row = next(at) if x != "I" else None
            if x == "D":
                continue
            initial = row[1][:1] if x == "K" else ""
            last = {"s": 1, "u": 2, "a": 3}[initial] if x == "K" else _NEXT[last]
            lines.append(f"{row[1] if x == 'K' else {2: 'user', 3: 'assistant'}[last]}:{row[2] if row else ''}")
        out.append((c, max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, *faults[1:],
                    sum(p not in ("su", "ua", "au") for p in pairs), cost, audit,
                    hashlib.sha256("\n".join(lines).encode()).hexdigest()))
    return sorted(out, key=str)


def _repaired(df):
    return sorted((tuple(r) for r in structure_repair.repair_conversations(structure_repair.damaged(df)).collect()),
                  key=str)


def test_repair_query_equals_brute_force(spark):
    for sf in (SF, "/root/testdata/sf0.01"):
        rows = [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").collect()]
        got = sorted((tuple(r) for r in queries.QUERIES["op13_structure_repair"](spark, sf).collect()), key=str)
        assert got == _plain_structure(rows)


def test_repair_of_edge_rows(spark):
    rng = random.Random(9)
    rows = [(c, rng.choice([None, 0, 1, 2, 3, 9]) if c % 3 else t, rng.choice(["user", "assistant", "system", "u", "tool", "", None]),
             f"{c} {t} " + rng.choice(["Yes.", "no", "Why? \n", "", "\t"])) for c in range(40) for t in range(rng.choice([1, 4, 9]))]
    # within a turn, texts order by digest: keep turns of a conversation apart where the brute force sorts by text
    rows = list({(c, t): (c, t, r, x) for c, t, r, x in rows}.values())
    rows += [(None, 1, "user", "a."), (None, None, "assistant", None), (50, 2, "user", "x" * 300_000), (51, 7, "user", "Twice."),
             (51, 7, "user", "Twice."), (52, 0, None, None)]
    df = _table(spark, rows)
    got = _repaired(df)
    assert got == _plain_structure(rows)
    assert _repaired(df.limit(0)) == []


def test_repair_of_dropped_and_intact_conversations(spark):
    gone = next(c for c in range(100_000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    assert _repaired(_table(spark, [(gone, 0, "user", "Hi.")])) == [(gone, 0, 0, 0, 0, 0, 0, "", EMPTY)]
    rows = [(1, 0, "system", "Be kind."), (1, 1, "user", "Hi!"), (1, 2, "assistant", "Hello."), (1, 5, "assistant", "Hello.")]
    got = structure_repair.repair_conversations(structure_repair.undamaged(_table(spark, rows))).collect()
    text = "system:Be kind.\nuser:Hi!\nassistant:Hello."
    assert [tuple(r) for r in got] == [(1, 2, 0, 1, 0, 1, 2, "KKKD", hashlib.sha256(text.encode()).hexdigest())]
