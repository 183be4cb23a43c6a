"""The prefix trie against plain loops, and structure repair against an exhaustive search."""

import hashlib
import heapq
import random
import re
import zlib

import pytest
from conftest_llm import DATA
from pyspark.sql import types as T

from postsift.llm import prefix_trie as P
from postsift.llm import structure_repair as R

TURNS = T.StructType([T.StructField("conv_id", T.LongType()), T.StructField("turn", T.LongType()), T.StructField("role", T.StringType()),
                      T.StructField("text", T.StringType()), *[T.StructField(c, T.StringType()) for c in (
                          "path", "key", "shard", "node", "kind", "t", "tie", "copy", "cost", "audit", "letter", "__damage", "__base")]])
COLUMNS = ("conv_id", "turn", "role", "text")


def frame(spark, rows):
    """Conversations with extra columns that the operators use inside."""
    return spark.createDataFrame([(*r, *["x"] * (len(TURNS) - 4)) for r in rows], TURNS)


def digest(role, text):
    return hashlib.sha256(f"{len(role)}:{role}{text}".encode()).hexdigest()


def conversations(rows, missing, keep_null):
    found = {}
    for conv, turn, role, text in rows:
        if conv is not None or keep_null:
            role, text = missing if role is None else role, missing if text is None else text
            found.setdefault(conv, []).append((turn is not None, turn or 0, digest(role, text), turn, role, text))
    return {c: [t[3:] for t in sorted(v, key=lambda t: t[:3])] for c, v in found.items()}


def brute_trie(rows):
    convs = conversations(rows, "", False)
    whole = {}
    for c, turns in convs.items():
        h = zlib.crc32(str(c).encode()) % 9
        whole[c] = [t[1:] for t in convs.get(c - c % 5, [])[:h] + turns[h:]]
    nodes = {}
    for c, turns in whole.items():
        for d in range(len(turns) + 1):
            nodes.setdefault(tuple(turns[:d]), []).append(c)
    out = []
    for p, members in nodes.items():
        below = [q for q in nodes if q[:len(p)] == p]
        leaf = [q for q in below if not any(x[:-1] == q for x in nodes if x)]
        saved = sum((len(nodes[q]) - 1) * len(q[-1][1].encode()) for q in below if q)
        ends = ",".join(map(str, sorted(c for c in members if len(whole[c]) == len(p))))
        out.append((min(members), len(p), min(nodes[p[:-1]]) if p else None, len(members), sum(len(q) == len(p) + 1 for q in below),
                    len(leaf), saved, hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=repr)


def random_turns(seed, convs, copies=1):
    random_ = random.Random(seed)
    texts = ["Hello.", "Yes!", "no end", "Why?", "", " \n", "Ça va? ", "What", None]
    rows = []
    for c in range(convs):
        shape = random.Random(seed + c // copies)
        for turn in range(shape.randrange(0, 9)):
            role = shape.choice(["user", "assistant", "user", "assistant", "system", "tool", None, ""])
            rows.append((c, shape.choice([turn, turn, turn, None, turn + 2]), role, shape.choice(texts)))
    random_.shuffle(rows)
    return rows


ODD = [(None, 1, "user", "lost"), (5, 0, "user", "a" * 200_000), (5, 0, "user", "a" * 200_000), (5, None, None, None), (-3, 1, "user", "x."),
       (-5, 0, "system", "s.")]


def trie_rows(df):
    return sorted((tuple(r) for r in df.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens",
                                               "ends_sha256").collect()), key=repr)


@pytest.mark.parametrize("shards", [1, 3, 40])
def test_trie_matches_loops(spark, shards):
    # The remainder keeps the sign, as in SQL, which Python's does not: negative ids are left to the next test.
    rows = random_turns(1, 60) + random_turns(5000, 60, copies=20) + [r for r in ODD if r[0] is None or r[0] >= 0]
    got = trie_rows(P.trie(P.rebuilt(P.digests(frame(spark, rows))), shards))
    assert got == brute_trie(rows)


def test_trie_of_odd_rows(spark):
    assert P.trie(P.rebuilt(P.digests(frame(spark, [])))).collect() == []
    rows = trie_rows(P.trie(P.rebuilt(P.digests(frame(spark, ODD)))))
    root = next(r for r in rows if r[1] == 0)
    assert root[0] == -5 and root[2] is None and root[3] == 3


def test_hot_copies_spread_over_shards(spark):
    rows = [(c, t, "user", f"turn {t}") for c in range(600) for t in range(3)]
    paths = P.rebuilt(P.digests(frame(spark, rows)))
    assert len(P.splitters(paths, 8)) >= 3
    assert trie_rows(P.trie(paths, 8)) == brute_trie(rows)


def test_skeleton_is_bounded(spark, monkeypatch):
    monkeypatch.setattr(P, "SKELETON_BYTES", 300)
    rows = random_turns(3, 80)
    paths = P.rebuilt(P.digests(frame(spark, rows)))
    assert sum(len(p) for p, _ in P.splitters(paths, 50)) <= 300
    assert trie_rows(P.trie(paths, 50)) == brute_trie(rows)


def damage(rows):
    out = []
    for conv, turns in conversations(rows, " ", True).items():
        kept = []
        for turn, role, text in turns:
            kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
            text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
            kept += [(turn, "user" if kind == 4 else role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
        out.append((conv, kept))
    return out


def faults(turns):
    seen, out = set(), []
    for _, role, text in turns:
        body = text.rstrip(" \t\n\x0b\x0c\r")
        out.append("blank" if not body else "duplicate" if (role, text) in seen else "truncated" if body[-1] not in ".!?" else None)
        seen.add((role, text))
    return out


def cheapest(turns, found):
    """Uniform-cost search over (rows used, roles given so far), which knows nothing of suffixes."""
    full = re.compile("(s?(ua)+)?")
    heap, best = [(0, "", 0, "", ())], {}
    while heap:
        cost, audit, at, initials, made = heapq.heappop(heap)
        if at == len(turns) and full.fullmatch(initials):
            return cost, audit, made
        key = (at, initials[-2:] if len(initials) > 1 else initials)
        if best.setdefault(key, (cost, audit)) < (cost, audit):
            continue
        def go(extra, letter, used, role=None, text=""):
            grown = initials + (role or "")[:1] if role is not None else initials
            if role is None or re.fullmatch("s?(ua)*u?", grown):
                heapq.heappush(heap, (cost + extra, audit + letter, at + used, grown, made if role is None else (*made, f"{role}:{text}")))
        for role in ("user", "assistant"):
            go(3, "I", 0, role)
        if at < len(turns):
            _, role, text = turns[at]
            go(4, "D", 1)
            if found[at] not in ("blank", "duplicate"):
                extra = 3 if found[at] == "truncated" else 0
                if role:
                    go(extra, "K", 1, role, text)
                for new in ("user", "assistant"):
                    go(extra + 3, "R", 1, new, text)


def brute_repair(rows):
    out = []
    for conv, turns in damage(rows):
        found = faults(turns)
        cost, audit, made = cheapest(turns, found)
        numbers = [t for t, _, _ in turns if t is not None]
        gaps = max(numbers) - min(numbers) + 1 - len(set(numbers)) if numbers else 0
        firsts = [r[:1] for _, r, _ in turns]
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(firsts, firsts[1:]))
        out.append((conv, gaps, found.count("blank"), found.count("duplicate"), found.count("truncated"), illegal, cost, audit,
                    hashlib.sha256("\n".join(made).encode()).hexdigest()))
    return sorted(out, key=repr)


def test_repair_matches_search(spark):
    rows = random_turns(11, 120) + random_turns(700, 60, copies=10) + ODD
    # The damage of a conversation hangs on its number, so the same turns under other numbers differ.
    rows += [(c + 1000, t, r, x) for c, t, r, x in random_turns(900, 80)]
    got = sorted((tuple(r) for r in R.repaired(R.damaged(frame(spark, rows))).collect()), key=repr)
    assert got == brute_repair(rows)
    assert {e for r in got for e in r[7]} == set("DIKR")


def test_repair_of_the_table(spark):
    df = spark.read.parquet(f"{DATA}/conversations.parquet")
    rows = [tuple(r) for r in df.select(*COLUMNS).collect()]
    got = sorted((tuple(r) for r in R.repaired(R.damaged(df)).collect()), key=repr)
    assert got == brute_repair(rows)


def test_repair_of_nothing_and_of_dropped_rows(spark):
    assert R.repaired(R.damaged(frame(spark, []))).collect() == []
    conv = next(c for c in range(1000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    row = R.repaired(R.damaged(frame(spark, [(conv, 0, "user", "gone.")]))).collect()
    assert [tuple(r) for r in row] == [(conv, 0, 0, 0, 0, 0, 0, "", hashlib.sha256().hexdigest())]


def test_automaton_shares_suffixes():
    automaton = R.Automaton()
    assert automaton.repair("ua"[::-1]) == (0, "KK")
    kept = automaton.nodes[1]
    assert automaton.repair("sua"[::-1]) == (0, "KKK") and automaton.nodes[1] is kept
    assert automaton.repair("uu"[::-1]) == (3, "KR") and automaton.repair("x") == (4, "D") and automaton.repair("s") == (4, "D")
    assert automaton.repair("U") == (4, "D") and automaton.repair("") == (0, "")
    long = "ua" * 5000
    assert automaton.repair(long[::-1]) == (0, "K" * 10_000) and R.entry.cache_info().currsize < 500
