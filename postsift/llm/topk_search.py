"""Exact top-k inner products over vectors in descending length.

Candidates are sorted by length and packed into blocks of bounded bytes, longest first. The first block gives every
query a lower bound of its k-th score; queries are packed by the candidate length below which that bound cannot be
reached. A block of queries meets only the candidate blocks above its cutoff. Inside a pair of blocks the vectors are
rotated by the eigenvectors of the Gram matrix, so that the first few coordinates hold most of the product; what the
rest can add is at most the product of the residual lengths (Cauchy-Schwarz), and pairs that cannot reach the query's
k-th score go before they are multiplied out. Survivors are scored in whole numbers.

Defined cases: vectors that are null or hold null or non-finite components take no part; shorter vectors count as
filled up with zeros, an empty one is the zero vector. Components are cut to the range of a long, as Spark's cast does,
and so is a score. Rows that share the query's id are its own and no candidates; a null id is no query and comes after
all others on ties. Repeated rows are candidates, and queries, one by one. Very long vectors make smaller blocks, of
one row at least. An empty table, or one without queries, gives no rows. Only the key and the vector are read, so other
columns may have any names.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from postsift.session import cut_lineage

#: Bytes of whole numbers in a block of candidates and of queries.
BLOCK_BYTES = 1 << 20
#: Rows of a block that are compared at once.
SLICE = 512
#: Shares of the Gram matrix's trace after which partial sums are checked.
PARTIAL = (0.4, 0.8)
#: Bounds are computed in floating point; they are widened by this share of the product of the lengths.
SLACK = 1e-9
#: Whole numbers below this are exact in double precision.
EXACT = float(1 << 53)

BLOCK = "block long, top double, ids array<bigint>, ints binary, floors binary"
HITS = "block long, row int, query_id long, vec_id long, score long"


def quantised(df: DataFrame, key: str = "vec_id", vector: str = "embedding", scale: float = 256.0) -> DataFrame:
    """(id, ints, length): floor(scale * component) of the vectors that take part."""
    values = F.transform(F.col(f"`{vector}`"), lambda x: x.cast("double"))
    # NaN is greater than any number here, so the comparison drops it as well.
    usable = F.forall(values, lambda x: F.coalesce(F.abs(x) < F.lit(float("inf")), F.lit(False)))
    rows = df.filter(F.col(f"`{vector}`").isNotNull() & usable).select(
        F.col(f"`{key}`").cast("long").alias("id"), F.transform(values, lambda x: F.floor(x * F.lit(scale)).cast("long")).alias("ints"))
    squares = F.aggregate("ints", F.lit(0.0), lambda total, x: total + x.cast("double") * x.cast("double"))
    return rows.withColumn("length", F.sqrt(squares))


def _matrix(lists: pa.ListArray, dims: int) -> np.ndarray:
    """The lists as rows of whole numbers, filled up with zeros."""
    sizes = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    out = np.zeros((len(lists), dims), np.int64)
    out[np.arange(dims) < sizes[:, None]] = lists.flatten().to_numpy(zero_copy_only=False)
    return out


def _grams(dims: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    upper = np.triu_indices(dims)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((dims, dims))
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                rows = _matrix(batch.column(0).slice(at, SLICE), dims).astype(float)
                total += rows.T @ rows
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(upper[0]))), pa.array(total[upper])], ["cell", "value"])

    return run


def rotation(rows: DataFrame, dims: int) -> tuple[np.ndarray, list[int]]:
    """The eigenvectors of the Gram matrix, strongest first, and the widths at which partial sums are checked.

    Every row counts; one matrix of ``dims`` squared reaches the driver, whatever the number of rows.
    """
    sums = rows.select("ints").mapInArrow(_grams(dims), "cell long, value double").groupBy("cell").agg(F.sum("value").alias("value"))
    gram, upper = np.zeros((dims, dims)), np.triu_indices(dims)
    for cell, value in sums.collect():
        i, j = upper[0][cell], upper[1][cell]
        gram[i, j] = gram[j, i] = value
    scale = np.abs(gram).max() or 1.0
    energy, vectors = np.linalg.eigh(gram / scale)
    energy, vectors = np.maximum(energy[::-1], 0), vectors[:, ::-1]
    share = np.cumsum(energy) / max(energy.sum(), 1e-300)
    widths = sorted({int(np.searchsorted(share, p)) + 1 for p in PARTIAL})
    return vectors, [w for w in widths if w < dims]


def _packed(dims: int, with_floor: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Sorted rows (id, ints, order, floor) to blocks of bounded size, numbered by task."""
    most = max(1, BLOCK_BYTES // (8 * max(dims, 1)))

    def block(number: int, ids: list, ints: list, order: float, floors: list) -> pa.RecordBatch:
        whole = np.concatenate(ints)
        return pa.RecordBatch.from_arrays([
            pa.array([number], pa.int64()), pa.array([order]), pa.array([ids], pa.list_(pa.int64())),
            pa.array([whole.tobytes()], pa.binary()), pa.array([np.concatenate(floors).tobytes()], pa.binary())],
            ["block", "top", "ids", "ints", "floors"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        ids: list = []
        ints: list = []
        floors: list = []
        order = 0.0
        for batch in batches:
            at = 0
            while at < batch.num_rows:
                part = batch.slice(at, most - len(ids))
                if not ids:
                    order = part.column(2)[0].as_py()
                ids += part.column(0).to_pylist()
                ints.append(_matrix(part.column(1), dims))
                floors.append(part.column(3).to_numpy() if with_floor else np.zeros(0))
                at += part.num_rows
                if len(ids) == most:
                    yield block(number, ids, ints, order, floors)
                    number, ids, ints, floors = number + 1, [], [], []
        if ids:
            yield block(number, ids, ints, order, floors)

    return run


def _best(rows: np.ndarray, ids: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    """Places of the k best of each row: highest score, smallest id, null ids (masked) last."""
    nulls = np.ma.getmaskarray(ids)
    order = np.lexsort((ids.data, nulls, ~scores, rows))
    sorted_rows = rows[order]
    starts = np.searchsorted(sorted_rows, sorted_rows)
    return order[np.arange(len(order)) - starts < k]


class Side:
    """One block, unpacked and rotated."""

    def __init__(self, ids: list, ints: bytes, dims: int, turn: np.ndarray, widths: list[int]):
        self.ids = np.ma.array([0 if i is None else i for i in ids], np.int64, mask=[i is None for i in ids])
        self.ints = np.frombuffer(ints, np.int64).reshape(len(ids), dims)
        real = self.ints.astype(float)
        self.lengths = np.sqrt((real * real).sum(axis=1))
        self.turned = real @ turn
        after = np.cumsum((self.turned * self.turned)[:, ::-1], axis=1)[:, ::-1]
        self.rest = {w: np.sqrt(after[:, w]) for w in widths}


def _products(a: np.ndarray, b: np.ndarray, exact: bool) -> np.ndarray:
    """All inner products of two slices, as longs."""
    if exact:
        return (a.astype(float) @ b.astype(float).T).astype(np.int64)
    whole = a.astype(object) @ b.astype(object).T
    return np.clip(whole, -(1 << 63), (1 << 63) - 1).astype(np.int64)


def search_blocks(queries: Side, others: Side, floors: np.ndarray, k: int, widths: list[int]) -> tuple[np.ndarray, ...]:
    """(row, id place, score) of each query's k best in a block of candidates sorted by falling length.

    ``floors`` are scores that the query's k-th best is known to reach; only what reaches them is returned.
    """
    floors = floors.copy()
    rows, places, scores = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    exact = queries.lengths.max() * others.lengths.max() < EXACT
    for at in range(0, len(others.ids), SLICE):
        part = slice(at, min(at + SLICE, len(others.ids)))
        reach = queries.lengths * others.lengths[at]
        live = np.flatnonzero(reach * (1 + SLACK) >= floors)
        if not len(live):
            break
        for lo in range(0, len(live), SLICE):
            mine = live[lo: lo + SLICE]
            slack = SLACK * np.outer(queries.lengths[mine], others.lengths[part])
            open_ = queries.ids[mine].data[:, None] != others.ids[part].data[None, :]
            open_ |= np.ma.getmaskarray(others.ids[part])[None, :]
            for width in widths:
                bound = queries.turned[mine, :width] @ others.turned[part, :width].T
                bound += np.outer(queries.rest[width][mine], others.rest[width][part]) + slack
                open_ &= bound >= floors[mine, None]
            i, j = np.nonzero(open_)
            if not len(i):
                continue
            used = np.unique(i)
            found = _products(queries.ints[mine[used]], others.ints[part], exact)[np.searchsorted(used, i), j]
            enough = found >= floors[mine[i]]
            rows = np.concatenate([rows, mine[i[enough]]])
            places = np.concatenate([places, at + j[enough]])
            scores = np.concatenate([scores, found[enough]])
        keep = _best(rows, others.ids[places], scores, k)
        rows, places, scores = rows[keep], places[keep], scores[keep]
        counts = np.bincount(rows, minlength=len(floors))
        last = np.cumsum(counts)[counts >= k] - 1
        floors[rows[last]] = np.maximum(floors[rows[last]], scores[last].astype(float) * (1 - np.sign(scores[last]) * 1e-15))
    return rows, places, scores


def _seeded(dims: int, turn: np.ndarray, widths: list[int], head: tuple[list, bytes], k: int) -> Callable:
    """Adds (order, floor) to rows (id, ints, length): the k-th score within the longest candidates, and the length it asks for."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        others = Side(*head, dims, turn, widths)
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                part = batch.slice(at, SLICE)
                queries = Side(part.column(0).to_pylist(), _matrix(part.column(1), dims).tobytes(), dims, turn, widths)
                floors = np.full(part.num_rows, -np.inf)
                rows, _, scores = search_blocks(queries, others, floors, k, widths)
                counts = np.bincount(rows, minlength=len(floors))
                last = np.cumsum(counts)[counts >= k] - 1
                floors[rows[last]] = scores[last].astype(float) * (1 - np.sign(scores[last]) * 1e-15)
                asked = np.where(floors > 0, floors / np.maximum(queries.lengths, 1e-300) * (1 - 2 * SLACK), 0.0)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(asked), pa.array(floors)],
                                                 ["id", "ints", "order", "floor"])

    return run


def _searched(dims: int, turn: np.ndarray, widths: list[int], k: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                number, ids, ints, floors, other_ids, other_ints = (batch.column(c)[i].as_py() for c in range(6))
                queries, others = Side(ids, ints, dims, turn, widths), Side(other_ids, other_ints, dims, turn, widths)
                rows, places, scores = search_blocks(queries, others, np.frombuffer(floors), k, widths)
                found = others.ids[places]
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.full(len(rows), number)), pa.array(rows.astype(np.int32)), pa.array(queries.ids[rows].data),
                    pa.array(found.data, mask=np.ma.getmaskarray(found)), pa.array(scores)],
                    ["block", "row", "query_id", "vec_id", "score"])

    return run


def top_k(rows: DataFrame, is_query: Column, k: int = 5) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` highest inner products of every query row with all other rows.

    ``rows`` has (id, ints, length) as from :func:`quantised`; ``is_query`` picks the queries among them.
    """
    spark = rows.sparkSession
    rows = cut_lineage(rows, "vectors")
    none = spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    dims = rows.agg(F.max(F.size("ints"))).first()[0]
    if dims is None:
        return none
    dims = max(dims, 1)
    turn, widths = rotation(rows, dims)
    # Equal lengths are cut by a hash, so that copies of one vector spread over tasks.
    by_length = rows.repartitionByRange(F.desc("length"), F.xxhash64("id")).sortWithinPartitions(F.desc("length"))
    others = cut_lineage(by_length.select("id", "ints", "length", F.lit(0.0).alias("floor"))
                         .mapInArrow(_packed(dims, False), BLOCK), "candidate_blocks")
    longest = others.agg(F.max("top")).first()[0]
    head = others.filter(F.col("top") == F.lit(longest)).select("ids", "ints").limit(1).collect()[0]
    # One block, of BLOCK_BYTES or one row, travels with the tasks.
    seeded = (rows.filter(is_query & F.col("id").isNotNull()).select("id", "ints")
              .mapInArrow(_seeded(dims, turn, widths, (head.ids, bytes(head.ints)), k), "id long, ints array<bigint>, order double, floor double"))
    by_cutoff = seeded.repartitionByRange("order", F.xxhash64("id")).sortWithinPartitions("order")
    asking = cut_lineage(by_cutoff.mapInArrow(_packed(dims, True), BLOCK), "query_blocks")
    # Blocks of the stated query set meet the blocks that are long enough; no row is paired with a row here.
    met = asking.alias("q").join(others.alias("c"), F.col("c.top") >= F.col("q.top")).select(
        "q.block", "q.ids", "q.ints", "q.floors", F.col("c.ids").alias("other_ids"), F.col("c.ints").alias("other_ints"))
    hits = met.mapInArrow(_searched(dims, turn, widths, k), HITS)
    rank = F.row_number().over(W.partitionBy("block", "row").orderBy(F.desc("score"), F.asc_nulls_last("vec_id")))
    return hits.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
