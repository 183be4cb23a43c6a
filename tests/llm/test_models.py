"""Held-out quality of the trained operators, and odd inputs."""

import random

import numpy as np
import pyarrow as pa
from conftest_llm import docs_frame, prose
from pyspark.sql import functions as F

from postsift.llm import langid as L
from postsift.llm import ngrams as N
from postsift.llm import queries as Q
from postsift.llm import sampling as S
from postsift.llm import toxicity as X


def toxic_text(seed, words):
    random_ = random.Random(seed)
    out = prose(seed, words, 2000).split()
    for _ in range(max(1, words // 40)):
        out[random_.randrange(words)] = random_.choice(["zorkblat", "zorkblot", "zorkblam"])
    return " ".join(out)


def test_misspellings_share_their_ngrams():
    clean = [prose(i, 120, 2000) for i in range(80)]
    toxic = [toxic_text(500 + i, 120) for i in range(80)]
    model = X.train(clean + toxic, [0] * 80 + [1] * 80)
    unseen = [toxic_text(900 + i, 150).replace("zorkbl", "zorkbly") for i in range(30)]
    scores = model.score(pa.array(unseen + [prose(5000 + i, 150, 2000) for i in range(30)] + [None, ""]))
    assert (scores[:30] >= X.THRESHOLD).mean() >= 0.9 and (scores[30:60] < X.THRESHOLD).mean() >= 0.9
    assert scores[60] == scores[61] == 1 / (1 + np.exp(-model.bias)) and ((scores >= 0) & (scores <= 1)).all()
    assert (X.train(["a b"], [1]).score(pa.array(["a b", None])) < 1e-6).all()


def test_toxicity_of_odd_rows(spark, edge, nothing):
    labels = spark.createDataFrame([(1, 1), (2, 0), (3, None), (4, 0), (None, 1), (77, 1)], "doc_id long, toxic int")
    model = X.fit(edge, labels, F.lit(True))
    rows = X.scored(edge, model).collect()
    assert len(rows) == edge.count() and all(0 <= r.score <= 1 and r.predicted == int(r.score >= X.THRESHOLD) for r in rows)
    assert X.scored(nothing, X.fit(nothing, labels, F.lit(True))).count() == 0


def test_language_held_out_accuracy(spark):
    rows = Q.QUERIES["op8_language_id"](spark, "/root/testdata/sf0.01")
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang")
    rate = rows.filter("held_out").join(docs, "doc_id").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0]
    assert rate > 0.95 and rows.filter("score < 0 or score > 1").count() == 0


def test_languages_of_odd_rows(spark, edge, nothing):
    model = L.fit(edge, F.lit(True))
    rows = L.predicted(edge, model).collect()
    assert len(rows) == edge.count() and sum(r.lang_pred == L.UNKNOWN for r in rows) == 4
    assert all(r.score == 0 for r in rows if r.lang_pred == L.UNKNOWN)
    assert L.predicted(nothing, model).count() == 0
    digits = docs_frame(spark, [(1, "12 34 !?"), (2, "ab")])
    assert [r.lang_pred for r in L.predicted(digits, L.fit(nothing, F.lit(True))).collect()] == [L.UNKNOWN] * 2


def test_kernel_counts_shared_presences():
    bits = L.presences(pa.array(["abc abc", "xabc"]))
    grams = [{"<a"[0:0] + g for n in range(1, 5) for g in (f"<{w}>"[i:i + n] for i in range(len(w) + 3 - n))} for w in ("abc", "xabc")]
    assert bits.sum(axis=1).tolist() == [len(g) for g in grams]
    assert (bits[0] & bits[1]).sum() == len(grams[0] & grams[1])


def test_least_hashed_equals_a_whole_sort(spark):
    rows = [(g, k) for k in range(3000) for g in ("a", "b") if k % 3 or g == "a"] + [("a", 7)] * 2000 + [(None, 1), ("b", None), ("c", 5)]
    table = spark.createDataFrame(rows, "lang string, doc_id long").repartition(16)
    hashes = {r.k: r.h for r in spark.range(3000).select(F.col("id").alias("k"), F.xxhash64("id").alias("h")).collect()}
    want = {}
    for g, k in set(rows):
        if g is not None and k is not None:
            want.setdefault(g, []).append((hashes[k], k))
    for n in (1, 40, 5000):
        found = sorted((r.g, r.k) for r in S.least_hashed(table, "lang", "doc_id", n).collect())
        assert found == sorted((g, k) for g, ks in want.items() for _, k in sorted(ks)[:n])


def test_samples_are_bounded_for_repeated_rows(spark):
    docs = docs_frame(spark, [(i % 3, f"text {i}") for i in range(300)])
    least = [min(f"text {i}" for i in range(k, 300, 3)) for k in range(3)]
    assert sorted(r.text for r in L.labelled_sample(docs, F.lit(True), per_lang=2).collect()) == sorted(
        least[k] for k in [r.k for r in S.least_hashed(docs, "lang", "doc_id", 2).collect()])
    labels = spark.createDataFrame([(i % 3, i % 3 % 2) for i in range(60)] + [(1, 0)], "doc_id long, toxic int")
    rows = X.labelled_sample(docs, labels, F.lit(True)).collect()
    assert sorted((r.text, r.label) for r in rows) == sorted([(least[0], 0), (least[1], 0), (least[1], 1), (least[2], 0)])


def bag(word):
    """Buckets of a word's n-grams and of the word itself, from one n-gram at a time."""
    return N.char_ngrams(np.array([word], object), X.LOW, X.HIGH, X.BUCKETS)[1].tolist()


def test_toxicity_equals_a_slow_version():
    """The same training written with lists of n-grams per text and dense numpy rows, and scores word by word."""
    texts = [prose(i, 30, 60) for i in range(40)] + [toxic_text(500 + i, 45) for i in range(40)]
    y = np.array([0] * 40 + [1] * 40)
    model = X.train(texts, y.tolist(), epochs=6, least_docs=3)
    bags = [[b for w in t.split() for b in bag(w)] for t in texts]
    found = {b: [sum(b in set(g) for g, c in zip(bags, y) if c == k) for k in (0, 1)] for b in {b for g in bags for b in g}}
    used = sorted(b for b, n in found.items() if sum(n) >= 3)
    ratio = np.array([np.log((found[b][1] / 40 + 3 / 80) / (found[b][0] / 40 + 3 / 80)) for b in used])
    ratio[np.abs(ratio) <= X.TELLING] = 0
    share = np.array([[g.count(b) / len(g) for b in used] for g in bags])
    axis = np.random.default_rng(11).normal(0, 1, X.DIM)
    axis /= np.linalg.norm(axis)
    params = [np.outer(ratio, axis), np.stack([-axis / 2, axis / 2], 1), np.array([[0.0, X.PRIOR]])]
    m, v = [0 * p for p in params], [0 * p for p in params]
    for step in range(1, 7):
        mean = X.SCALE * share @ params[0]
        p = np.exp(mean @ params[1] + params[2])
        g = (p / p.sum(1, keepdims=True) - np.stack([1 - y, y], 1)) / 80
        for k, grad in enumerate((X.SCALE * share.T @ (g @ params[1].T), mean.T @ g, g.sum(0, keepdims=True))):
            m[k], v[k] = 0.9 * m[k] + 0.1 * grad, 0.999 * v[k] + 0.001 * grad**2
            spread = np.sqrt(v[k] / (1 - 0.999**step))
            params[k] = params[k] * (1 - X.DECAY * (k == 0)) - X.RATE * (m[k] / (1 - 0.9**step)) / (spread + X.SMOOTH * spread.max() + 1e-30)
    logits = dict(zip(used, X.SCALE * params[0] @ (params[1][:, 1] - params[1][:, 0])))
    bias = params[2][0, 1] - params[2][0, 0]
    asked = texts[::7] + ["zorkblyt Unseen, words!", ""]
    for text, score in zip(asked, model.score(pa.array(asked))):
        hits = [logits.get(b, 0) for w in text.lower().replace(",", " ").replace("!", " ").split() for b in bag(w)]
        assert abs(score - 1 / (1 + np.exp(-(sum(hits) / max(len(hits), 1) + bias)))) < 2e-3


def test_ridge_equals_a_dense_solve():
    """Kernel ridge regression on the whole kernel that the landmarks span, solved over rows instead of features."""
    spell = {"x": "abcde", "y": "cdefg", "z": "efgha"}
    draw = random.Random(8)
    langs = [draw.choice("xxyz") for _ in range(60)]
    texts = [" ".join("".join(draw.choice(spell[k]) for _ in range(4)) for _ in range(6)) for k in langs]
    model = L.train(texts, langs, landmarks=24)

    def grams(text):
        return set(np.flatnonzero(L.presences(pa.array([text]))[0]).tolist())

    def kernel(a, b):
        a, b = [grams(t) for t in a], [grams(t) for t in b]
        return np.array([[len(s & t) / np.sqrt(len(s) * len(t)) for t in b] for s in a])

    marks = [t for k in "xyz" for t in [t for t, lang in zip(texts, langs) if lang == k][:8]]
    among = np.linalg.pinv(kernel(marks, marks), rcond=1e-6, hermitian=True)
    rows, asked = kernel(texts, marks), texts[:10] + ["abcd efgh", "hhhh"]
    s = np.array([1 / 3 / langs.count(k) for k in langs])
    target = np.array([[1.0 if k == lang else -1.0 for k in "xyz"] for lang in langs])
    centre, mean = s @ rows, s @ target
    left = np.sqrt(s)[:, None] * (rows - centre)
    dual = np.linalg.solve(left @ among @ left.T + L.RIDGE * np.eye(60), np.sqrt(s)[:, None] * (target - mean))
    want = (kernel(asked, marks) - centre) @ among @ left.T @ dual + mean
    got = model.kernel(L.presences(pa.array(asked))) @ model.weights + model.bias
    assert np.abs(got - want).max() < 1e-3
    found, scores = model.predict(pa.array(asked))
    assert found == ["xyz"[k] for k in want.argmax(axis=1)] and np.allclose(scores, np.clip((want.max(axis=1) + 1) / 2, 0, 1), atol=1e-3)
