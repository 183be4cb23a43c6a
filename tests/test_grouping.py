"""SimHash, banded pairs, components and numbering against brute force."""

import random

import pytest
from pyspark.sql import functions as F

from postsift.operators import components
from postsift.operators import grouping as G
from postsift.operators import simhash as S
from postsift.operators.components import connected_components
from postsift.session import cut_lineage


def signed(value):
    return value - (1 << 64) if value >= 1 << 63 else value


def unsigned(value):
    return value % (1 << 64)


def close(a, b, threshold=6):
    bands = any((a >> 16 * k) & 0xFFFF == (b >> 16 * k) & 0xFFFF for k in range(4))
    return bands and bin(a ^ b).count("1") <= threshold


def clustered_hashes(seed, centres, per_centre):
    rng = random.Random(seed)
    out = []
    for _ in range(centres):
        base = rng.getrandbits(64)
        for _ in range(per_centre):
            h = base
            for bit in rng.sample(range(64), rng.randint(0, 5)):
                h ^= 1 << bit
            out.append(h)
    return sorted(set(out))


@pytest.mark.parametrize("limit, chunk", [(512, 4096), (1, 4096), (1, 3), (4, 2)])
def test_pairs_match_brute_force_however_buckets_are_split(spark, limit, chunk):
    hashes = clustered_hashes(7, 4, 25)
    nodes = spark.createDataFrame([(i, "d", signed(h)) for i, h in enumerate(hashes)], "id long, domain string, simhash long")
    got = [tuple(r) for r in G.lsh_pairs(nodes, bucket_limit=limit, chunk_rows=chunk).select("id_a", "id_b").collect()]
    want = [(i, j) for i in range(len(hashes)) for j in range(i + 1, len(hashes)) if close(hashes[i], hashes[j])]
    assert sorted(got) == want


def brute_components(n, edges):
    parent = list(range(n))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        ra, rb = find(a), find(b)
        parent[max(ra, rb)] = min(ra, rb)
    return {i: find(i) for i in range(n)}


@pytest.mark.parametrize("limit", [512, 1])
def test_template_components_match_brute_force(spark, limit):
    rng = random.Random(3)
    hashes = clustered_hashes(11, 5, 14)
    rows = []
    for seq in range(160):
        rows.append((seq, str(seq), rng.choice(["a.co", "a.co", "b.co"]), f"s{rng.randint(0, 60)}", f"p{rng.randint(0, 2)}", 10,
                     signed(rng.choice(hashes))))
    df = spark.createDataFrame(rows, "seq long, message_id string, domain string, template_subject string, prefix string, "
                                     "norm_len int, simhash long")
    got = {r["seq"]: r["component"] for r in G.template_components(df, bucket_limit=limit).collect()}
    edges = [(a[0], b[0]) for a in rows for b in rows if a[0] < b[0] and a[2] == b[2]
             and (a[3:5] == b[3:5] or close(unsigned(a[6]), unsigned(b[6])))]
    assert got == brute_components(160, edges)


@pytest.mark.parametrize("limit, chunk", [(512, 4096), (1, 50)])
def test_scattered_variants_contract_along_few_edges(spark, monkeypatch, limit, chunk):
    """Dense clusters have pairs by the hundred thousand; the edges of all rounds together stay linear in the rows."""
    rng, hashes = random.Random(9), []
    for size in (1200, 150, 1, 1):
        base = rng.getrandbits(64)
        hashes += [base ^ sum(1 << bit for bit in rng.sample(range(64), rng.randint(0, 5))) for _ in range(size)]
    hashes = list(dict.fromkeys(hashes))
    pairs = [(i, j) for i in range(len(hashes)) for j in range(i + 1, len(hashes)) if close(hashes[i], hashes[j])]
    edges = []
    monkeypatch.setattr(G, "connected_components", lambda e: edges.append(e.count()) or connected_components(e))
    nodes = spark.createDataFrame([(i, "d", signed(h), i) for i, h in enumerate(hashes)], "id long, domain string, simhash long, root long")
    got = {r["id"]: r["root"] for r in G.contracted(nodes, bucket_limit=limit, chunk_rows=chunk).collect()}
    assert got == brute_components(len(hashes), pairs)
    assert len(pairs) > 50 * len(hashes) and sum(edges) < 6 * len(hashes)


def test_near_copy_edges_are_true_and_join_dense_clusters(spark):
    hashes = clustered_hashes(5, 2, 60)
    nodes = spark.createDataFrame([(i, "d", signed(h)) for i, h in enumerate(hashes)], "id long, domain string, simhash long")
    edges = G._near_copies(nodes, 6, 4).distinct().collect()
    assert edges
    assert all(close(hashes[r["u"]], hashes[r["v"]]) for r in edges)


def test_components_of_a_long_chain_a_star_and_a_cycle(spark):
    chain = [(i, i + 1) for i in range(1, 300)]
    star = [(1000, 1000 + i) for i in range(1, 200)]
    cycle = [(2000 + i, 2000 + (i + 1) % 7) for i in range(7)]
    edges = spark.createDataFrame(chain + star + cycle + [(5, 5)], "u long, v long")
    got = {r["node"]: r["component"] for r in connected_components(edges).collect()}
    assert got == {**{i: 1 for i in range(1, 301)}, **{1000 + i: 1000 for i in range(200)}, **{2000 + i: 2000 for i in range(7)}}


def test_no_edges_give_no_components(spark):
    assert connected_components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_simhash_of_empty_text_is_zero_and_ties_set_bits(spark):
    
    df = spark.createDataFrame([(0, ""), (1, "a b"), (2, "one two three four five")], "seq long, t string")
    got = {r["seq"]: unsigned(r["simhash"]) for r in S.simhash64(df, "t", ["seq"]).collect()}

    assert got == {0: 0, 1: 0x9eeb7fffe6ffbfec, 2: 0xdc03e03d4e0479e6}


def test_simhash_counts_per_text_what_it_counts_per_shingle(spark):
    texts = ["", "a", "a b", "a b c", "a b c d", "a b c d e a b c d", " a b c d e", "a  b c d e f", "a b c  d e f g", "a b c d ", "\u00e9 b c d \U0001f600", None]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(20, "a b c d"), (20, "d e f g h"), (None, "x"), (None, "y z")], "seq long, t string")
    counted = S.simhash64(df, "t", ["seq"])
    exploded = S.simhash64(df, "t", ["seq"], lambda c: S.md5_hash(c))
    assert sorted(map(str, counted.collect())) == sorted(map(str, exploded.collect()))
    # One row per text reaches the sums, not one per shingle.
    plan = counted._jdf.queryExecution().toString()
    assert "Generate" not in plan


def test_numbering_orders_by_size_then_first_message(spark):
    members = [(0, 0), (1, 0), (2, 2), (3, 3), (4, 3), (5, 5), (400000, 400000), (400001, 400000), (400002, 400000)]
    df = spark.createDataFrame([(s, str(s), 9 - s % 3, c) for s, c in members], "seq long, message_id string, norm_len int, component long")
    numbers = {r["component"]: (r["template_group_id"], r["group_size"]) for r in G.numbered_groups(df).collect()}
    assert numbers == {400000: ("group_00001", 3), 0: ("group_00002", 2), 3: ("group_00003", 2), 2: ("group_00004", 1),
                       5: ("group_00005", 1)}
    groups = G.group_table(df)
    chunks = G.group_members(df, groups, span=2).filter("template_group_id = 'group_00001'").orderBy("chunk").collect()
    assert [r["message_ids"] for r in chunks] == [["400000", "400001"], ["400002"]]
    assert groups.filter(F.col("component") == 0).first()["rep_seq"] == 1


def test_no_table_of_the_corpus_is_broadcast_by_the_grouping(spark, capsys):
    """Written tables of ids are small files; the planner would collect their rows in the driver."""
    hashes = clustered_hashes(3, 4, 10)
    rows = [(i, str(i), 5, "d", "s", f"p{i % 6}", signed(h)) for i, h in enumerate(hashes)]
    marked = cut_lineage(spark.createDataFrame(rows, "seq long, message_id string, norm_len int, domain string, template_subject string, "
                                                     "prefix string, simhash long"))
    nodes = cut_lineage(G.vertices(marked).withColumn("root", F.col("id")))
    banded = cut_lineage(G._banded(nodes, 4))
    edges = cut_lineage(G._near_copies(nodes, 6, 4).filter("u <> v"))
    steps = [G._banded(nodes, 4), G._near_copies(nodes, 6, 4), G._exact_edges(marked, nodes), G._star_edges(banded, 6, 0, 4096),
             G._contracting_edges(banded, 6, 4, 1, 4), G.lsh_pairs(nodes), G.template_components(marked), components._large_star(edges),
             components._small_star(edges)]
    capsys.readouterr()
    for step in steps:
        step.explain()
        plan = capsys.readouterr().out
        assert "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan
