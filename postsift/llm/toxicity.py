"""Toxicity from subword bags: embeddings averaged into a linear softmax, both trained together in numpy.

A word is the bag of its character n-grams and itself; a text is the mean of all its bags. Misspellings that training
never saw share n-gram vectors with the words it saw. Once trained, a vector matters only through its logit, so
scoring looks up one number per n-gram, once per different word of a batch.

Defined cases: a null or empty text scores as the bias alone. Rows whose label is null are not learned from. Repeated
rows score alike; without labelled rows of both classes every score is 0, and an empty table gives an empty one. A
document labelled both ways is learned from as both. Texts of any length are scored whole. Only the named columns are
read, so other columns may have any names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from postsift.llm.batches import bounded_batches
from postsift.llm.ngrams import char_ngrams, summed, words_of
from postsift.llm.sampling import least_hashed

LOW, HIGH = 3, 5
BUCKETS = 1 << 17
DIM = 8
EPOCHS = 30
LEAST_DOCS = 10
RATE = 0.05
#: Log odds below this start at 0.
TELLING = 1.5
SCALE = 100.0
SMOOTH = 0.1
#: The first bias: a text of words that say nothing is clean.
PRIOR = -4.0
DECAY = 0.001
#: The fit's bounds: labelled rows of each class, and characters of a row that may be chosen.
PER_CLASS = 1000
FIT_CHARS = 20_000
THRESHOLD = 0.7


@dataclass
class Model:
    """What is left of vectors and softmax: the logit that each bucket adds, and the bias."""

    logits: np.ndarray
    bias: float

    def word_scores(self, names: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        owner, bucket = char_ngrams(names, LOW, HIGH, len(self.logits))
        return np.bincount(owner, self.logits[bucket], len(names)), np.bincount(owner, minlength=len(names))

    def score(self, texts: pa.Array) -> np.ndarray:
        words = words_of(texts)
        total, count = self.word_scores(words.names)
        mean = summed(total[words.which], words.begins) / np.maximum(summed(count[words.which], words.begins), 1)
        return 1 / (1 + np.exp(-np.clip(mean + self.bias, -50, 50)))


class _Sparse:
    """A weighted 0/1 incidence in both orders, for sums over either side without a loop."""

    def __init__(self, row: np.ndarray, col: np.ndarray, rows: int, cols: int, weight: np.ndarray | None = None):
        self.shape = (rows, cols)
        self.sides = []
        for a, b, n in ((row, col, rows), (col, row, cols)):
            order = np.argsort(a, kind="stable").astype(np.int32)
            a_, b_ = a[order].astype(np.int32), b[order].astype(np.int32)
            starts = np.flatnonzero(np.append(True, a_[1:] != a_[:-1])) if len(a_) else np.zeros(0, np.int64)
            self.sides.append((a_[starts], starts, b_, None if weight is None else weight[order][:, None], n))

    def dot(self, x: np.ndarray, side: int = 0) -> np.ndarray:
        at, starts, other, weight, n = self.sides[side]
        out = np.zeros((n, x.shape[1]), np.float32)
        if len(starts):
            taken = x[other]
            out[at] = np.add.reduceat(taken if weight is None else taken * weight, starts)
        return out


def _incidence(names: np.ndarray, buckets: int, step: int = 20_000) -> tuple[np.ndarray, np.ndarray]:
    """char_ngrams of many words in small integers, some words at a time."""
    owners, found = [np.zeros(0, np.int32)], [np.zeros(0, np.int32)]
    for at in range(0, len(names), step):
        owner, bucket = char_ngrams(names[at: at + step], LOW, HIGH, buckets)
        owners.append((owner + at).astype(np.int32))
        found.append(bucket.astype(np.int32))
    return np.concatenate(owners), np.concatenate(found)


def _frequent(doc, word, owner, bucket, buckets, y, least) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The buckets that occur in ``least`` documents, their log odds, and the incidence of words with those only."""
    order = np.argsort(owner, kind="stable").astype(np.int32)
    sizes = np.bincount(owner, minlength=word.max() + 1 if len(word) else 0)
    firsts = np.cumsum(sizes) - sizes
    frequency = np.zeros((2, buckets))
    cuts = np.searchsorted(doc, np.arange(len(y) + 1))
    for toxic, lo, hi in zip(y.astype(int), cuts, cuts[1:]):
        n = sizes[word[lo:hi]]
        at = np.repeat(firsts[word[lo:hi]] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        frequency[toxic, np.unique(bucket[order[at]])] += 1
    keep = frequency.sum(axis=0)[bucket] >= least
    used, place = np.unique(bucket[keep], return_inverse=True)
    clean, toxic = (frequency[c, used] / (y == c).sum() for c in (0, 1))
    ratio = np.log((toxic + least / len(y)) / (clean + least / len(y)))
    return used, np.where(np.abs(ratio) > TELLING, ratio, 0), owner[keep], place.astype(np.int32)


def train(texts: list[str | None], toxic: list[int], epochs: int = EPOCHS, rate: float = RATE, decay: float = DECAY,
          dim: int = DIM, buckets: int = BUCKETS, least_docs: int = LEAST_DOCS) -> Model:
    """Full-batch Adam on the cross entropy with the classes weighted alike.

    Vectors start along one axis at the log odds of their n-gram, so that n-grams of either class alone need not be
    told from common words by many steps.
    """
    y = np.array(toxic, np.float32)
    if not len(y) or y.min() == y.max():
        return Model(np.zeros(buckets), -50.0)
    words = words_of(pa.array(texts, pa.string()))
    owner, bucket = _incidence(words.names, buckets)
    doc = np.repeat(np.arange(len(y)), np.diff(words.begins))
    pair, count = np.unique(doc * len(words.names) + words.which, return_counts=True)
    doc, word = pair // len(words.names), pair % len(words.names)
    bags = np.bincount(owner, minlength=len(words.names))
    size = np.maximum(np.bincount(doc, bags[word] * count, len(y)), 1)
    used, ratio, owner, bucket = _frequent(doc, word, owner, bucket, buckets, y, least_docs)
    in_doc = _Sparse(doc, word, len(y), len(words.names), (count / size[doc]).astype(np.float32))
    in_word = _Sparse(owner, bucket, len(words.names), len(used))

    random = np.random.default_rng(11)
    axis = random.normal(0, 1, dim)
    axis = (axis / np.linalg.norm(axis)).astype(np.float32)
    params = [np.outer(ratio, axis).astype(np.float32), np.stack([-axis / 2, axis / 2], axis=1),
              np.array([[0, PRIOR]], np.float32)]
    first, second = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    share = np.where(y == 1, 0.5 / y.sum(), 0.5 / (len(y) - y.sum())).astype(np.float32)[:, None]
    target = np.stack([1 - y, y], axis=1)
    for step in range(1, epochs + 1):
        vectors, weights, bias = params
        mean = SCALE * in_doc.dot(in_word.dot(vectors))
        logits = mean @ weights + bias
        p = np.exp(logits - logits.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        g = (p - target) * share
        back = SCALE * in_word.dot(in_doc.dot(g @ weights.T, 1), 1)
        for k, grad in enumerate((back, mean.T @ g, g.sum(axis=0, keepdims=True))):
            first[k] = 0.9 * first[k] + 0.1 * grad
            second[k] = 0.999 * second[k] + 0.001 * grad * grad
            spread = np.sqrt(second[k] / (1 - 0.999**step))
            # Beside the largest gradient those of rare n-grams are small: they stay near 0 and learn no text by heart.
            params[k] = params[k] * (1 - decay * (k == 0)) - rate * (first[k] / (1 - 0.9**step)) / (spread + SMOOTH * spread.max(initial=0) + 1e-30)
    vectors, weights, bias = params
    out = np.zeros(buckets)
    out[used] = SCALE * vectors @ (weights[:, 1] - weights[:, 0])
    return Model(out, float(bias[0, 1] - bias[0, 0]))


def remainder(key: str, divisor: int) -> Column:
    """crc32 of the key as text, modulo ``divisor``."""
    return F.pmod(F.crc32(F.col(key).cast("string").cast("binary")), F.lit(divisor))


def labelled_sample(docs: DataFrame, labels: DataFrame, allowed: Column, key: str = "doc_id", text: str = "text",
                    label: str = "toxic", per_class: int = PER_CLASS, chars: int = FIT_CHARS) -> DataFrame:
    """(text, label): at most ``per_class`` rows of each class, those with the least hash of their key.

    Of rows that share key and label the least text stands for all, so the bound holds for repeated rows too.
    """
    small = docs.filter(F.length(text) <= chars).select(F.col(key).alias("key"), F.col(text).alias("text"))
    known = (labels.filter(allowed & F.col(label).isin(0, 1)).select(F.col(key).alias("lk"), F.col(label).alias("label"))
             .join(small.select("key"), F.col("lk") == F.col("key"), "left_semi"))
    # At most two per_class rows of two numbers: the bound that lets them be broadcast.
    picked = F.broadcast(least_hashed(known, "label", "lk", per_class))
    return (small.join(picked, F.col("key") == F.col("k")).groupBy("key", F.col("g").alias("label"))
            .agg(F.min("text").alias("text")).select("text", "label"))


def fit(docs: DataFrame, labels: DataFrame, allowed: Column, **names) -> Model:
    rows = labelled_sample(docs, labels, allowed, **names).collect()
    rows.sort(key=lambda r: (r.label, r.text))
    return train([r.text for r in rows], [r.label for r in rows])


def scorer(spark, model: Model):
    """A column function from texts to scores."""
    shared = spark.sparkContext.broadcast(model)

    @arrow_udf("double")
    def score(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            parts = [shared.value.score(b.column(0)) for b in
                     bounded_batches(iter([pa.RecordBatch.from_arrays([texts], ["t"])]), 0)]
            yield pa.array(np.concatenate(parts) if parts else [], pa.float64())

    return score


def scored(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """(key, score, predicted): one row per row of ``docs``, over the whole text."""
    rows = docs.select(key, scorer(docs.sparkSession, model)(F.col(text)).alias("score"))
    return rows.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
