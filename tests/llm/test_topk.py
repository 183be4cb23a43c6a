"""Exact search against plain whole-number products."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from postsift.llm import topk_search as K

VECTORS = T.StructType([T.StructField("vec_id", T.LongType()), T.StructField("embedding", T.ArrayType(T.DoubleType())),
                        *[T.StructField(c, T.StringType()) for c in ("id", "ints", "length", "block", "row", "score", "rank", "top")]])


def frame(spark, rows):
    """Vectors with extra columns that the operator uses inside."""
    return spark.createDataFrame([(*r, *["x"] * (len(VECTORS) - 2)) for r in rows], VECTORS)


def brute(rows, k=5, step=50):
    whole = [(i, [max(-(1 << 63), min((1 << 63) - 1, math.floor(256 * x))) for x in v]) for i, v in rows
             if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for q, a in whole:
        if q is not None and q % step == 0:
            scores = sorted((-max(-(1 << 63), min((1 << 63) - 1, sum(x * y for x, y in zip(a, b)))), c is None, c or 0) for c, b in whole if c != q)
            out += [(q, n + 1, None if null else c, -s) for n, (s, null, c) in enumerate(scores[:k])]
    return sorted(out, key=repr)


def searched(spark, rows, k=5, step=50):
    return sorted(map(tuple, K.top_k(K.quantised(frame(spark, rows)), F.col("id") % step == 0, k).collect()), key=repr)


def vectors(seed, n, dims=12):
    random_ = np.random.default_rng(seed)
    spread = random_.normal(size=(n, dims)) * np.exp(-np.arange(dims) / 3) * np.exp(random_.normal(size=(n, 1)))
    return [(i, v.tolist()) for i, v in enumerate(spread)]


@pytest.mark.parametrize("block", [1 << 20, 700])
def test_search_matches_loops(spark, monkeypatch, block):
    monkeypatch.setattr(K, "BLOCK_BYTES", block)
    rows = vectors(1, 400) + [(1000 + i, [1.5] * 12) for i in range(150)]
    assert searched(spark, rows, step=20) == brute(rows, step=20)


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 2.0]), (0, [1.0, 2.0]), (50, [0.0, 0.0]), (100, []), (1, [3.0]), (2, None), (3, [1.0, None]), (4, [nan, 1.0]), (5, [inf, 0.0]),
            (None, [1.0, 2.0]), (6, [1.0, 2.0, 9.0]), (7, [-1.0, -2.0]), (7, [-1.0, -2.0]), (8, [2.0, 1.5])]
    assert searched(spark, rows) == brute(rows)
    assert searched(spark, []) == [] and searched(spark, [(50, None)]) == [] and searched(spark, [(50, [1.0])]) == []
    assert searched(spark, [(1, [1.0]), (2, [1.0])]) == []


def test_large_components_stay_whole(spark):
    rows = [(0, [1e13, 1.0]), (1, [1e13, 1.0]), (2, [1e13, 1.0 + 2 ** -8]), (3, [1e300, -1e300]), (4, [-1e300, 1.0]), (5, [0.0, 3.0])]
    rows += [(50, [2.0 ** 20, 5.0]), (51, [2.0 ** 21, 7.0])]
    assert searched(spark, rows) == brute(rows)


def test_bounds_prune(spark):
    """Most products are never made, and none that counts is missed."""
    rows = np.array([v for _, v in vectors(3, 3000, 32)])
    ints = np.floor(rows * 256).astype(np.int64)
    ints = ints[np.argsort(-np.sqrt((ints * ints).sum(1)))]
    turn = np.linalg.eigh(ints.T @ ints)[1][:, ::-1]
    made = []
    real = K._products
    try:
        K._products = lambda a, b, exact: made.append(len(a) * len(b)) or real(a, b, exact)
        queries = K.Side(list(range(100)), ints[::30][:100].tobytes(), 32, turn, [4, 12])
        others = K.Side(list(range(1000, 4000)), ints.tobytes(), 32, turn, [4, 12])
        got = K.search_blocks(queries, others, np.full(100, -np.inf), 5, [4, 12])
    finally:
        K._products = real
    assert sum(made) < 0.5 * 100 * 3000
    scores = ints[::30][:100] @ ints.T
    for row in range(100):
        assert sorted(got[2][got[0] == row])[::-1] == sorted(scores[row])[::-1][:5]
