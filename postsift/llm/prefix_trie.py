"""Prefix trie of conversations by splitters and a skeleton.

A conversation is the string of its turns' digests. Sampled conversations split all of them into ranges; the trie of
the splitters' paths, the skeleton, is broadcast. Every shard is one sorted range: a node that is no prefix of a
splitter has all its members in one shard, which finishes it while it streams over its sorted rows. Skeleton nodes may
have members in many shards; each shard gives a partial aggregate of them, and these are reduced by node.

The sample, the skeleton and its broadcast are held under ``SKELETON_BYTES`` whatever the input. Copies of one
conversation are cut by their ids, so a group of any size spreads over shards. What one task holds is the digests of
single conversations (16 bytes a turn), the open path, and the finished children of its open nodes.

Defined cases: a null conv_id is no conversation. Null roles and texts are empty. Null turns come first; turns of one
number come in the order of their digests, repeated rows are turns of their own. ``%`` keeps the sign of the id, as in
SQL. Very long texts count by their digest and size only. An empty table gives no node, not even a root. Only conv_id,
turn, role and text are read, so other columns may have any names.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_right
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postsift.session import cut_lineage

KEY = 16
#: Bytes of all sampled paths; a skeleton node takes 16 of them.
SKELETON_BYTES = 4 << 20
#: Sampled conversations for each splitter.
OVERSAMPLE = 8
#: Characters of member ids in one partial list.
PIECE = 1 << 16
BATCH = 4096
#: A rebuilt conversation takes at most this many turns from another one.
HEAD = 8

OUT = ("kind int, node int, shard int, part int, conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, "
       "n_leaves long, saved_tokens long, text_bytes long, ends string")
NAMES = [field.split()[0] for field in OUT.split(", ")]
FINISHED, PARTIAL, ENDS = range(3)


def digests(conversations: DataFrame) -> DataFrame:
    """(conv_id, turns): each conversation's turns in order, as (key, bytes)."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    key = F.substring(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256), 1, 2 * KEY)
    turn = F.struct(F.col("turn").isNotNull().alias("has"), F.col("turn").alias("turn"), key.alias("key"),
                    F.octet_length(text).cast("long").alias("bytes"))
    rows = conversations.filter(F.col("conv_id").isNotNull()).select(F.col("conv_id").cast("long").alias("conv_id"), turn.alias("t"))
    return rows.groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("turns"))


def rebuilt(turns: DataFrame) -> DataFrame:
    """(conv_id, path, sizes): the first h turns of conversation c - c % 5, then c's own after its first h."""
    heads = turns.filter(F.col("conv_id") % 5 == 0).select(F.col("conv_id").alias("__base"), F.slice("turns", 1, HEAD).alias("__head"))
    h = (F.crc32(F.col("conv_id").cast("string")) % (HEAD + 1)).cast("int")
    joined = turns.join(heads, F.col("conv_id") - F.col("conv_id") % 5 == F.col("__base"), "left")
    head = F.when(F.col("__head").isNull(), F.slice("turns", 1, 0)).otherwise(F.slice("__head", F.lit(1), h))
    whole = F.concat(head, F.slice("turns", h + 1, F.greatest(F.size("turns") - h, F.lit(0))))
    return joined.select("conv_id", whole.alias("t")).select(
        "conv_id", F.unhex(F.array_join("t.key", "")).alias("path"), F.col("t.bytes").alias("sizes"))


def splitters(paths: DataFrame, shards: int) -> list[tuple[bytes, int]]:
    """At most ``shards`` - 1 (path, conv_id) from a sample by hash of under ``SKELETON_BYTES``, in order.

    Fewer or uneven splitters change the size of shards, never a result.
    """
    rows = paths.count()
    if not rows:
        return []
    draw = F.pmod(F.xxhash64("conv_id"), F.lit(1 << 40))
    limit = min(1 << 40, (OVERSAMPLE * shards << 40) // rows)
    while limit:
        sample = paths.filter(draw < limit)
        if (sample.agg(F.sum(F.length("path") + 2 * KEY)).first()[0] or 0) <= SKELETON_BYTES:
            found = sorted((bytes(r.path), r.conv_id) for r in sample.select("path", "conv_id").collect())
            return found[OVERSAMPLE - 1::OVERSAMPLE] if len(found) >= OVERSAMPLE else found[:1]
        limit //= 2
    return []


class Skeleton:
    """The trie of the splitters' paths; node 0 is the root."""

    def __init__(self, found: list[tuple[bytes, int]]):
        self.splitters = found
        self.nodes: dict[tuple[int, bytes], int] = {}
        self.parents, self.depths = [-1], [0]
        for path, _ in found:
            node = 0
            for at in range(0, len(path), KEY):
                step = (node, path[at: at + KEY])
                if step not in self.nodes:
                    self.nodes[step] = len(self.parents)
                    self.parents.append(node)
                    self.depths.append(self.depths[node] + 1)
                node = self.nodes[step]


def _sharded(skeleton: Skeleton) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pairs = zip(batch.column("path").to_pylist(), batch.column("conv_id").to_pylist())
            shard = pa.array([bisect_right(skeleton.splitters, pair) for pair in pairs], pa.int32())
            yield pa.RecordBatch.from_arrays([shard, *(batch.column(n) for n in ("conv_id", "path", "sizes"))],
                                             ["shard", "conv_id", "path", "sizes"])

    return run


class Node:
    """An open node of one shard."""

    __slots__ = ("skeleton", "depth", "bytes", "n", "least", "children", "leaves", "saved", "closed", "hash", "ends", "part", "chars")

    def __init__(self, skeleton: int | None, depth: int, size: int):
        self.skeleton, self.depth, self.bytes = skeleton, depth, size
        self.n = self.children = self.leaves = self.saved = self.part = self.chars = 0
        self.least: int | None = None
        self.closed: list[tuple] = []
        self.hash, self.ends = None, []

    def take(self, n: int, least: int) -> None:
        self.n += n
        self.least = least if self.least is None or least < self.least else self.least


class Shard:
    """Streams over one sorted range and keeps only the open path."""

    def __init__(self, number: int, skeleton: Skeleton):
        self.number, self.skeleton = number, skeleton
        self.path, self.stack, self.rows = b"", [Node(0, 0, 0)], []

    def _row(self, kind: int, node: int | None, **values) -> None:
        row = dict.fromkeys(NAMES) | {"kind": kind, "node": node, "shard": self.number} | values
        self.rows.append(tuple(row[n] for n in NAMES))

    def _piece(self, node: Node) -> None:
        if node.ends:
            self._row(ENDS, node.skeleton, part=node.part, ends=",".join(node.ends))
            node.part, node.chars, node.ends = node.part + 1, 0, []

    def _finished(self, child: tuple, parent: Node) -> None:
        conv, depth, n, children, leaves, saved, ends = child
        whole = parent.skeleton is None
        self._row(FINISHED, parent.skeleton, conv_id=conv, depth=depth, parent_conv_id=parent.least if whole else None,
                  n_convs=n, n_children=children, n_leaves=leaves, saved_tokens=saved, ends=ends)

    def _close(self) -> None:
        node = self.stack.pop()
        parent = self.stack[-1] if self.stack else None
        for child in node.closed:
            self._finished(child, node)
        if parent:
            parent.take(node.n, node.least)
        if node.skeleton is not None:
            self._piece(node)
            self._row(PARTIAL, node.skeleton, conv_id=node.least, depth=node.depth, n_convs=node.n, n_children=node.children,
                      n_leaves=node.leaves, saved_tokens=node.saved, text_bytes=node.bytes)
            return
        node.leaves = node.leaves or 1
        node.saved += (node.n - 1) * node.bytes
        parent.children, parent.leaves, parent.saved = parent.children + 1, parent.leaves + node.leaves, parent.saved + node.saved
        ends = (node.hash or hashlib.sha256()).hexdigest()
        done = (node.least, node.depth, node.n, node.children, node.leaves, node.saved, ends)
        if parent.skeleton is None:
            parent.closed.append(done)
        else:
            self._finished(done, parent)

    def add(self, conv: int, path: bytes, sizes: list[int]) -> None:
        shared, most = 0, min(len(path), len(self.path))
        while shared < most and path[shared: shared + KEY] == self.path[shared: shared + KEY]:
            shared += KEY
        while len(self.stack) > shared // KEY + 1:
            self._close()
        for at in range(shared, len(path), KEY):
            above = self.stack[-1].skeleton
            found = None if above is None else self.skeleton.nodes.get((above, path[at: at + KEY]))
            self.stack.append(Node(found, at // KEY + 1, sizes[at // KEY]))
        self.path, node, text = path, self.stack[-1], str(conv)
        node.take(1, conv)
        if node.skeleton is None:
            if node.hash is None:
                node.hash = hashlib.sha256(text.encode())
            else:
                node.hash.update(b"," + text.encode())
            return
        node.ends.append(text)
        node.chars += len(text)
        if node.chars >= PIECE:
            self._piece(node)

    def finish(self) -> None:
        while self.stack:
            self._close()


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    types = {"int": pa.int32(), "long": pa.int64(), "string": pa.string()}
    columns = [pa.array([r[i] for r in rows], types[field.split()[1]]) for i, field in enumerate(OUT.split(", "))]
    return pa.RecordBatch.from_arrays(columns, NAMES)


def _local(skeleton: Skeleton) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard: Shard | None = None
        for batch in batches:
            for number, conv, path, sizes in zip(*(batch.column(n).to_pylist() for n in ("shard", "conv_id", "path", "sizes"))):
                if shard is None or shard.number != number:
                    if shard:
                        shard.finish()
                        yield _batch(shard.rows)
                    shard = Shard(number, skeleton)
                shard.add(conv, path, sizes)
                if len(shard.rows) >= BATCH:
                    yield _batch(shard.rows)
                    shard.rows = []
        if shard:
            shard.finish()
            yield _batch(shard.rows)

    return run


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of each node's pieces, which come sorted; one piece is held at a time."""
    node, digest = None, hashlib.sha256()

    def out() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([node], pa.int32()), pa.array([digest.hexdigest()])], ["node", "ends_sha256"])

    for batch in batches:
        for number, piece in zip(batch.column("node").to_pylist(), batch.column("ends").to_pylist()):
            if number != node:
                if node is not None:
                    yield out()
                node, digest = number, hashlib.sha256()
                digest.update(piece.encode())
            else:
                digest.update(b"," + piece.encode())
    if node is not None:
        yield out()


def _reduced(local: DataFrame, skeleton: Skeleton) -> list[tuple]:
    """One row per skeleton node: partial aggregates summed by Spark, subtrees rolled up over the bounded skeleton."""
    sums = local.filter(F.col("kind") == PARTIAL).groupBy("node").agg(
        F.min("conv_id").alias("least"), *[F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens")],
        F.max("text_bytes").alias("size"))
    pieces = local.filter(F.col("kind") == ENDS).select("node", "shard", "part", "ends")
    hashes = pieces.repartition("node").sortWithinPartitions("node", "shard", "part").mapInArrow(_hashed, "node int, ends_sha256 string")
    ends = {r.node: r.ends_sha256 for r in hashes.collect()}
    rows = {r.node: r.asDict() for r in sums.collect()}
    empty = hashlib.sha256().hexdigest()
    # A node is numbered after its parent, so going down the numbers visits children first.
    for node in range(len(skeleton.parents) - 1, -1, -1):
        row = rows[node]
        row["n_leaves"] = row["n_leaves"] or 1
        row["saved_tokens"] += (row["n_convs"] - 1) * row["size"] if node else 0
        if node:
            above = rows[skeleton.parents[node]]
            above["n_children"] += 1
            above["n_leaves"] += row["n_leaves"]
            above["saved_tokens"] += row["saved_tokens"]
    return [(node, row["least"], skeleton.depths[node], rows[skeleton.parents[node]]["least"] if node else None, row["n_convs"],
             row["n_children"], row["n_leaves"], row["saved_tokens"], ends.get(node, empty)) for node, row in sorted(rows.items())]


def trie(paths: DataFrame, shards: int | None = None) -> DataFrame:
    """(conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256) per node.

    ``paths`` has (conv_id, path, sizes) as from :func:`rebuilt`: 16 bytes and one size per turn.
    """
    spark = paths.sparkSession
    paths = cut_lineage(paths, "paths")
    columns = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    schema = "node int, " + ", ".join(f"{c} {'string' if c == 'ends_sha256' else 'long'}" for c in columns)
    if paths.isEmpty():
        return spark.createDataFrame([], schema).drop("node")
    skeleton = Skeleton(splitters(paths, shards or int(spark.conf.get("spark.sql.shuffle.partitions"))))
    sharded = paths.mapInArrow(_sharded(skeleton), "shard int, conv_id long, path binary, sizes array<long>")
    ranges = sharded.repartition("shard").sortWithinPartitions("shard", "path", "conv_id")
    local = cut_lineage(ranges.mapInArrow(_local(skeleton), OUT), "trie")
    top = spark.createDataFrame(_reduced(local, skeleton), schema)
    finished = local.filter(F.col("kind") == FINISHED).withColumnRenamed("ends", "ends_sha256")
    # One row per skeleton node, bounded by SKELETON_BYTES.
    above = F.broadcast(top.select(F.col("node").alias("__n"), F.col("conv_id").alias("__conv")))
    rest = finished.join(above, F.col("node") == F.col("__n"), "left").withColumn(
        "parent_conv_id", F.coalesce("parent_conv_id", "__conv"))
    return top.select(columns).unionByName(rest.select(columns))
