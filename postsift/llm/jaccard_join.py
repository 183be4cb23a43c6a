"""N-gram Jaccard join with Bayesian candidate pruning.

Documents with equal shingle sets are one class member with a count. Banded MinHash collects candidates into
candidate groups through edges linear in the members. Inside a group, MinHash values are compared a few at a time and
a pair is dropped as soon as the posterior probability that it reaches the threshold is below ``tolerance``; what
survives is verified on the whole shingle sets. Groups are cut into blocks and only pairs of blocks become rows, so a
group of any size spreads over tasks and its pairs are counted, never written.

Defined cases: words are runs without ASCII white space, compared as they are; a text of one to four words has its
whole as the only shingle; a null, empty or blank text has no shingle, no link and a class of its own. A class is named
by its smallest doc_id (null ids are passed over). Repeated rows count as documents of their own.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from postsift.llm.batches import bounded_batches, groups
from postsift.llm.shingles import shingle_set, word_codes
from postsift.operators.components import connected_components
from postsift.session import write_stage

SHINGLE = 5
THRESHOLD = 0.8
BANDS, ROWS = 52, 7
STEP = 28
TOLERANCE = 1e-6
BLOCK = 256


def multipliers(count: int) -> np.ndarray:
    return np.random.default_rng(7).integers(0, 2**32, count, dtype=np.uint32) | np.uint32(1)


def minhashes(shingles: np.ndarray, factors: np.ndarray, chunk: int = 1024) -> np.ndarray:
    """The low half of the least product for each factor; low halves of minima are spread evenly."""
    x = (shingles >> np.uint64(32)).astype(np.uint32)
    least = np.full(len(factors), 2**32 - 1, np.uint32)
    for at in range(0, len(x), chunk):
        np.minimum(least, np.multiply.outer(factors, x[at: at + chunk]).min(axis=1), out=least)
    return least.astype(np.uint16)


def posterior(matches: int, compared: int, threshold: float) -> float:
    """P(similarity >= threshold) after ``matches`` of ``compared`` values agreed, from a uniform prior."""
    n = compared + 1
    return sum(comb(n, i) * threshold**i * (1 - threshold) ** (n - i) for i in range(matches + 1))


def least_matches(compared: int, threshold: float, tolerance: float) -> int:
    """The fewest agreeing values with which a pair stays."""
    return next((m for m in range(compared + 1) if posterior(m, compared, threshold) >= tolerance), compared)


def survivors(signs: np.ndarray, p: np.ndarray, q: np.ndarray, needs: list[int], step: int) -> tuple[np.ndarray, np.ndarray]:
    """The pairs (p, q) left after comparing ``step`` more values at a time."""
    matches = np.zeros(len(p), np.int64)
    for k, need in enumerate(needs):
        cols = slice(k * step, (k + 1) * step)
        matches += (signs[p, cols] == signs[q, cols]).sum(axis=1)
        alive = matches >= need
        p, q, matches = p[alive], q[alive], matches[alive]
    return p, q


def intersections(sets: list[np.ndarray], p: np.ndarray, q: np.ndarray, chunk: int = 4096) -> np.ndarray:
    """Shared shingles of each pair: pair by pair if they are few, else by products of presence matrices."""
    m = len(sets)
    if len(p) <= 2 * m:
        return np.array([len(np.intersect1d(sets[i], sets[j], assume_unique=True)) for i, j in zip(p, q)], np.int64)
    owner = np.repeat(np.arange(m), [len(s) for s in sets])
    names, code, n = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = n > 1
    place = np.cumsum(shared) - 1
    owner, code = owner[shared[code]], place[code[shared[code]]]
    total = np.zeros((m, m), np.float32)
    for at in range(0, int(shared.sum()), chunk):
        here = (code >= at) & (code < at + chunk)
        present = np.zeros((m, chunk), np.float32)
        present[owner[here], code[here] - at] = 1
        total += present @ present.T
    return total[p, q].astype(np.int64)


def labels(m: int, p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """The least member reached over the pairs, for each of m members."""
    label = np.arange(m)
    while True:
        low = np.minimum(label[p], label[q])
        new = label.copy()
        np.minimum.at(new, p, low)
        np.minimum.at(new, q, low)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def sketches(docs: DataFrame, key: str, text: str, size: int, bands: int, rows: int) -> DataFrame:
    """(key, text_hash, digest, bands) per row; digest and bands are null where a text has no shingle."""
    kind = docs.schema[key].dataType
    schema = T.StructType([T.StructField("key", kind), T.StructField("text_hash", T.LongType()),
                           T.StructField("digest", T.BinaryType()), T.StructField("bands", T.ArrayType(T.LongType()))])

    def sketched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        factors, mix = multipliers(bands * rows), np.arange(bands, dtype=np.uint64)
        for batch in bounded_batches(batches, 2):
            codes, begins = word_codes(batch.column(2))
            digests, found = [], []
            for i in range(batch.num_rows):
                shingles = shingle_set(codes[begins[i]: begins[i + 1]], size)
                if len(shingles):
                    digests.append(hashlib.blake2b(shingles.tobytes(), digest_size=16).digest())
                    found.append(_band_hashes(minhashes(shingles, factors), mix))
                else:
                    digests.append(None)
                    found.append(None)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(digests, pa.binary()), pa.array(found, pa.list_(pa.int64()))],
                names=["key", "text_hash", "digest", "bands"])

    body = F.coalesce(F.col(text), F.lit(""))
    return docs.select(F.col(key).alias("key"), F.xxhash64(body).alias("text_hash"), body.alias("text")).mapInArrow(sketched, schema)


def _band_hashes(sign: np.ndarray, mix: np.ndarray) -> np.ndarray:
    out = mix.copy()
    for column in sign.reshape(len(mix), -1).T.astype(np.uint64):
        out = (out ^ column) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(32)
    return out.view(np.int64)


def _verified(group: pa.Table, size: int, threshold: float, needs: list[int], factors: np.ndarray) -> tuple:
    """(nodes, links, labels) of the members of one block pair that have a link in it."""
    codes, begins = word_codes(group.column("text").combine_chunks())
    sets = [shingle_set(codes[b:e], size) for b, e in zip(begins, begins[1:])]
    signs = np.stack([minhashes(s, factors) for s in sets])
    sides, node, copies = (group.column(c).to_numpy() for c in ("side", "node", "copies"))
    cross = len(np.unique(sides)) > 1
    p, q = np.meshgrid(np.flatnonzero(sides == 0), np.flatnonzero(sides == 1), indexing="ij") if cross \
        else np.triu_indices(len(sets), 1)
    p, q = survivors(signs, np.ravel(p), np.ravel(q), needs, STEP)
    sizes = np.array([len(s) for s in sets])
    shared = intersections(sets, p, q)
    linked = shared * (1 + threshold) >= threshold * (sizes[p] + sizes[q]) - 1e-9
    p, q = p[linked], q[linked]
    links = np.bincount(p, copies[q], len(sets)) + np.bincount(q, copies[p], len(sets))
    any_ = links > 0
    return node[any_], links[any_].astype(np.int64), node[labels(len(sets), p, q)[any_]]


def verified_links(grouped: DataFrame, size: int, threshold: float, tolerance: float, bands: int, rows: int, block: int) -> DataFrame:
    """(node, links, label) from (group, node, copies, text): per member and block pair, its links and its least fellow."""
    sizes = grouped.groupBy("group").agg(F.count(F.lit(1)).alias("m")).filter("m > 1").select(
        F.col("group").alias("g"), F.ceil(F.col("m") / F.lit(block)).cast("int").alias("blocks"))
    rows_ = grouped.join(sizes, F.col("group") == F.col("g")).drop("g").withColumn("mine", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    rows_ = rows_.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rows_ = rows_.select("group", F.least("mine", "other").alias("lo"), F.greatest("mine", "other").alias("hi"),
                         (F.col("mine") > F.col("other")).cast("int").alias("side"), "node", "copies", "text")
    factors = multipliers(bands * rows)
    needs = [least_matches(k, threshold, tolerance) for k in range(STEP, bands * rows + 1, STEP)]

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in groups(batches, ["group", "lo", "hi"]):
            if group.num_rows < 2:
                continue
            node, links, label = _verified(group, size, threshold, needs, factors)
            yield pa.RecordBatch.from_arrays([pa.array(node), pa.array(links), pa.array(label)], ["node", "links", "label"])

    cells = rows_.repartition("group", "lo", "hi").sortWithinPartitions("group", "lo", "hi")
    return cells.mapInArrow(verify, "node long, links long, label long")


def near_copies(docs: DataFrame, key: str = "doc_id", text: str = "text", size: int = SHINGLE, threshold: float = THRESHOLD,
                tolerance: float = TOLERANCE, bands: int = BANDS, rows: int = ROWS, block: int = BLOCK) -> DataFrame:
    """(key, text_hash, class_id, n_links): one row per row of ``docs``.

    ``n_links`` counts the other documents with a similarity of ``threshold`` or more; classes are the connected
    components of the links.
    """
    sketch, _ = write_stage(sketches(docs, key, text, size, bands, rows), "sketches")
    members = (sketch.filter(F.col("digest").isNotNull()).groupBy("digest", "bands")
               .agg(F.min("key").alias("first"), F.count(F.lit(1)).alias("copies")))
    members, _ = write_stage(members.withColumn("node", F.monotonically_increasing_id()), "members")

    banded = members.select("node", F.explode("bands").alias("band"))
    heads = (banded.groupBy("band").agg(F.min("node").alias("head"), F.count(F.lit(1)).alias("n"))
             .filter("n > 1").select(F.col("band").alias("b"), "head"))
    edges = (banded.join(heads, F.col("band") == F.col("b")).filter(F.col("node") != F.col("head"))
             .select(F.col("node").alias("u"), F.col("head").alias("v")))
    groups = connected_components(edges).select(F.col("node").alias("n"), F.col("component").alias("group"))

    # A member's text is that of its first document; of rows that share its id the digest tells which it is.
    wanted = members.join(groups, F.col("node") == F.col("n")).select("group", "node", "copies", "digest", "first")
    homes = sketch.select("key", "text_hash", F.col("digest").alias("d"))
    homes = (wanted.join(homes, (F.col("digest") == F.col("d")) & F.col("first").eqNullSafe(F.col("key")))
             .groupBy("group", "node", "copies", "first").agg(F.min("text_hash").alias("h")))
    body = F.coalesce(F.col(text), F.lit(""))
    bodies = docs.select(F.col(key).alias("k"), body.alias("text"))
    found = (bodies.join(homes, F.col("k").eqNullSafe(F.col("first")) & (F.xxhash64("text") == F.col("h")))
             .select("group", "node", "copies", "text").dropDuplicates(["node"]))
    grouped, _ = write_stage(found, "candidates")

    links, _ = write_stage(verified_links(grouped, size, threshold, tolerance, bands, rows, block), "links")
    joined = connected_components(links.select(F.col("node").alias("u"), F.col("label").alias("v")))
    counts = links.groupBy("node").agg(F.sum("links").alias("links")).select(F.col("node").alias("ln"), "links")
    classes = joined.select(F.col("node").alias("cn"), F.col("component").alias("c"))
    known = (members.filter("copies > 1").select("node").union(counts.select("ln")).distinct()
             .select(F.col("node").alias("kn")))
    info = (members.drop("bands").join(known, F.col("node") == F.col("kn"))
            .join(classes, F.col("node") == F.col("cn"), "left").join(counts, F.col("node") == F.col("ln"), "left")
            .select("digest", "first", F.coalesce("c", "node").alias("root"),
                    (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links")))
    names = info.groupBy("root").agg(F.min("first").alias("class_id")).select(F.col("root").alias("r"), "class_id")
    info = info.join(names, F.col("root") == F.col("r")).select(F.col("digest").alias("d"), "class_id", "n_links")
    return (sketch.select("key", "text_hash", "digest").join(info, F.col("digest") == F.col("d"), "left")
            .select(F.col("key").alias(key), "text_hash", F.coalesce("class_id", "key").alias("class_id"),
                    F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links")))


def keep_one(docs: DataFrame, classes: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` that name their class, with their own columns; a row that repeats id and text counts once."""
    losers = (classes.filter(~F.col(key).eqNullSafe(F.col("class_id")))
              .select(F.col(key).alias("k"), F.col("text_hash").alias("h")).distinct())
    # A document travels as one column, so that its names cannot meet those used here.
    doc = F.col("doc")
    rows = docs.select(F.struct("*").alias("doc"))
    rows = rows.select("doc", doc[key].alias("id"), F.xxhash64(F.coalesce(doc[text], F.lit(""))).alias("hash"))
    rows = rows.join(losers, F.col("id").eqNullSafe(F.col("k")) & (F.col("hash") == F.col("h")), "left_anti")
    return rows.dropDuplicates(["id", "hash"]).select("doc.*")
