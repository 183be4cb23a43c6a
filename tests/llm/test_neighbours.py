"""Jaccard join, suffix dedup and decontamination against plain loops over small fixtures."""

import itertools
import random
import re

import numpy as np
from conftest_llm import BASE, EDGE, docs_frame, prose

from postsift.llm import decontam as D
from postsift.llm import jaccard_join as J
from postsift.llm import suffix_dedup as X


def variants(count):
    """Copies of two texts with words changed here and there, near and far."""
    random_ = random.Random(5)
    out = []
    for i in range(count):
        words = (prose(8, 90) if i % 4 else prose(9, 90)).split()
        for _ in range(random_.choice([0, 1, 1, 2, 3, 6, 12])):
            words[random_.randrange(len(words))] = f"new{random_.randrange(50)}"
        out.append((100 + i, " ".join(words)))
    return out


def brute_classes(rows, threshold=0.8):
    sets = []
    for _, text in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
        sets.append({tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    links, root = [0] * len(rows), list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in itertools.combinations(range(len(rows)), 2):
        shared = len(sets[a] & sets[b])
        if shared and shared >= threshold * (len(sets[a]) + len(sets[b]) - shared) - 1e-9:
            links[a] += 1
            links[b] += 1
            root[find(b)] = find(a)
    members = {}
    for i in range(len(rows)):
        members.setdefault(find(i), []).append(i)
    least = {r: min((rows[i][0] for i in m if rows[i][0] is not None), default=None) for r, m in members.items()}
    return [(rows[i][0], least[find(i)], links[i]) for i in range(len(rows))]


def test_classes_and_links_match_all_pairs(spark, nothing):
    rows = EDGE + variants(150)
    docs = docs_frame(spark, rows)
    want = sorted(map(str, brute_classes(rows)))
    for block in (256, 16):  # small blocks cut the groups into many pairs of blocks
        found = J.near_copies(docs, block=block)
        got = sorted(str((r.doc_id, r.class_id, r.n_links)) for r in found.collect())
        assert got == want
    kept = J.keep_one(docs, found)
    classes = {c for _, c, _ in brute_classes(rows)}
    assert kept.columns == docs.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(map(str, [*(c for c in classes if c is not None), None, None]))
    assert J.near_copies(nothing).count() == 0 and J.keep_one(nothing, J.near_copies(nothing)).count() == 0


def test_pruning_keeps_what_may_reach_the_threshold():
    assert J.posterior(100, 100, 0.8) > 0.999 and J.posterior(10, 100, 0.8) < 1e-12
    need = J.least_matches(100, 0.8, 1e-6)
    assert J.posterior(need, 100, 0.8) >= 1e-6 > J.posterior(need - 1, 100, 0.8)
    sets = [np.unique(np.random.default_rng(s).integers(0, 500, 300, dtype=np.uint64)) for s in range(12)]
    p, q = np.triu_indices(12, 1)
    want = [len(set(sets[i].tolist()) & set(sets[j].tolist())) for i, j in zip(p, q)]
    assert J.intersections(sets, p, q, 64).tolist() == want and J.intersections(sets, p[:5], q[:5]).tolist() == want[:5]


def brute_removal(rows):
    first = {}
    for doc, text in sorted((r for r in rows if r[0] is not None), key=lambda r: r[0]):
        data = (text or "").encode()
        for i in range(len(data) - 49):
            first.setdefault(data[i:i + 50], doc)
    out = []
    for doc, text in rows:
        data = (text or "").encode()
        gone = bytearray(len(data))
        for i in range(len(data) - 49):
            if doc is not None and first[data[i:i + 50]] < doc:
                gone[i:i + 50] = b"\1" * 50
        runs = sum(1 for i, g in enumerate(gone) if g and (i == 0 or not gone[i - 1]))
        out.append((doc, len(data), sum(gone), runs, bytes(b for b, g in zip(data, gone) if not g)))
    return out


def suffix_rows():
    random_ = random.Random(3)
    passages = [prose(20 + i, 12) for i in range(6)] + ["x" * 200, "ab" * 90, "éàü" * 40]
    rows = [(i, t) for i, t in EDGE if i not in (9, 10)] + [(30, "z" * 49), (31, "z" * 49), (32, "y" * 50), (33, "y" * 50), (34, "y" * 51)]
    for i in range(60):
        parts = [random_.choice(passages) if random_.random() < 0.5 else prose(1000 + i * 10 + k, 6, 9000) for k in range(5)]
        rows.append((50 + i, " ".join(p[random_.randrange(4):len(p) - random_.randrange(4)] for p in parts)))
    return rows + [(70, rows[-1][1]), (70, rows[-2][1])]


def test_removed_bytes_match_brute_force(spark, nothing, monkeypatch):
    rows = suffix_rows()
    for cell_bytes, flush in ((8 << 20, 1 << 20), (512, 40)):  # many cells, many flushes
        monkeypatch.setattr(X, "CELL_BYTES", cell_bytes)
        monkeypatch.setattr(X, "FLUSH_ANCHORS", flush)
        got = X.without_repeats(docs_frame(spark, rows)).collect()
        assert sorted(map(str, ((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in got))) == \
            sorted(map(str, brute_removal(rows)))
    assert X.without_repeats(nothing).count() == 0


def test_contexts_of_a_hot_core_do_not_meet_in_one_group(spark, monkeypatch):
    shared = prose(77, 20)
    rows = [(i, f"{prose(5000 + i, 4, 9000)}{shared}{prose(7000 + i, 12, 9000)}") for i in range(90)] + suffix_rows()[-12:]
    docs = docs_frame(spark, rows)
    assert len(X.hot_cores(docs, "doc_id", "text")) == 0  # too few documents for the default
    sizes, spans_of = [], X._spans_of
    monkeypatch.setattr(X, "SAMPLE_ONE_IN", 1)
    for flush in (1 << 20, 100):
        monkeypatch.setattr(X, "FLUSH_CONTEXTS", flush)
        assert 1 <= len(X.hot_cores(docs, "doc_id", "text")) <= 20
        got = X.without_repeats(docs).collect()
        assert sorted(map(str, ((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in got))) == \
            sorted(map(str, brute_removal(rows)))
    monkeypatch.setattr(X, "FLUSH_CONTEXTS", 1 << 20)
    cells = X.string_cells(docs, "doc_id", "text").coalesce(1).sortWithinPartitions("cell").toArrow()
    monkeypatch.setattr(X, "_spans_of", lambda items: sizes.append(len({x[4] for x in items})) or spans_of(items))
    list(X._repeated_strings(iter(cells.to_batches())))
    assert max(sizes) < X.HOT_SAMPLED


def test_anchors_cover_every_string_in_chunks(monkeypatch):
    data = np.frombuffer(prose(4, 900).encode(), np.uint8)
    bounds = np.array([0, 10, 1000, 1049, 1100, len(data)])
    monkeypatch.setattr(X, "CHUNK", 256)
    _, place, first, last = X.anchors(data, bounds)
    named = sorted(s for lo, hi in zip(first, last) for s in range(lo, hi + 1))
    assert named == [s for lo, hi in zip(bounds, bounds[1:]) for s in range(lo, hi - 49)]
    assert ((first <= place) & (place <= first + 25) & (last <= place)).all()


def brute_coverage(doc, item, seed):
    """Share of ``item`` tiled: mark the longest unmarked match, the first of equal ones, again and again."""
    marked_d, marked_i, covered = set(), set(), 0
    while True:
        best = (0, 0, 0)
        for a, b in itertools.product(range(len(doc)), range(len(item))):
            n = 0
            while (a + n < len(doc) and b + n < len(item) and doc[a + n] == item[b + n]
                   and a + n not in marked_d and b + n not in marked_i):
                n += 1
            best = max(best, (n, -a, -b))
        n, a, b = best[0], -best[1], -best[2]
        if n < seed:
            return covered / len(item)
        marked_d.update(range(a, a + n))
        marked_i.update(range(b, b + n))
        covered += n


def found_leaks(spark, rows, items, **options):
    bench = spark.createDataFrame(items, "item_id long, text string")
    docs = docs_frame(spark, list(rows)).drop("__leaks")
    return [(r.doc_id, r["__leaks"]) for r in D.with_leaks(docs, bench, "__leaks", **options).collect()]


def test_a_phrase_that_most_texts_hold_brings_few_pairs_together(spark):
    phrase = "as has been said before in this very place"
    items = [(i, f"{prose(600 + i, 30, 9000)} {phrase}") for i in range(30)] + [(90, phrase), (91, f"{phrase} again")]
    rows = [(i, f"{prose(800 + i, 20, 9000)} {phrase} {items[i][1] if i < 5 else ''}") for i in range(60)]
    got = dict(found_leaks(spark, rows, items))
    assert all({x.item_id for x in got[i]} == {90, 91} | ({i} if i < 5 else set()) for i in range(60))


def test_tiles_of_moved_passages(spark, edge, nothing, monkeypatch):
    random_ = random.Random(6)
    items = [prose(200 + i, 40, 60).split() for i in range(4)] + [["one", "two"]]
    docs = []
    for i in range(40):
        item = items[i % 4]
        cuts = sorted(random_.sample(range(1, 40), 3))
        parts = [item[a:b] for a, b in zip([0, *cuts], [*cuts, 40])]
        random_.shuffle(parts)
        words = prose(300 + i, 20, 60).split()
        for part in parts[: random_.randrange(1, 5)]:
            words += part + prose(400 + i, 3, 60).split()
        docs.append((i, words))
    texts = [(i, " ".join(w).upper().replace(" ", ", ")) for i, w in docs]
    block = [(10 + i, " ".join(item)) for i, item in enumerate(items)]
    got = found_leaks(spark, texts + texts[:3], block, coverage=0.3)
    assert len(got) == 43
    for i, leaks in got:
        want = {10 + k: round(c, 6) for k, item in enumerate(items[:4]) if (c := brute_coverage(docs[i][1], item, 5)) >= 0.3}
        assert {x.item_id: round(x.coverage, 6) for x in leaks} == want

    # An item that stands there whole is found, however short, but for one and two words.
    short = [(1, "one two three"), (2, "Four, five six seven!"), (3, "one two"), (4, "three one two")]
    found = found_leaks(spark, enumerate(["x one two three y one two three", "four five six", "zero four FIVE six seven", None, "one two"]), short)
    assert [[x.item_id for x in leaks] for _, leaks in sorted(found)] == [[1], [], [2], [], []] and sorted(found)[0][1][0].coverage == 1
    # One word again and again: a run a diagonal, not every pair of places.
    assert len(D.seed_runs([(np.arange(19_996), np.arange(196))])) < 20_200
    same = sorted(found_leaks(spark, [(0, "again " * 20_000), (1, "again " * 60)], [(1, "again " * 200)], coverage=0.25))
    assert [[tuple(x) for x in leaks] for _, leaks in same] == [[(1, 1.0, 1)], [(1, 0.3, 1)]]

    bench = spark.createDataFrame([(1, BASE), (2, None), (3, "one two"), (4, prose(4, 90)), (4, prose(4, 90))], "item_id long, text string")
    for bits in (D.MOST_BITS, 6):  # a table that tells windows apart, one that lets all of them pass
        monkeypatch.setattr(D, "MOST_BITS", bits)
        rows = D.report(edge, bench)
        found = sorted((str(r.doc_id), r.item_ids) for r in rows.collect() if r.leaked)
        assert found == [("1", [1]), ("10", [4, 4]), ("10", [4, 4]), ("2", [1]), ("3", [1])]
    assert D.keep_clean(edge, bench).count() == len(EDGE) - 5 and D.keep_clean(edge, bench).columns == edge.columns
    assert D.report(nothing, bench).count() == 0 and D.report(edge, bench.limit(0)).filter("leaked").count() == 0
