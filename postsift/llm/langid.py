"""Language identification with string kernels.

The kernel of two texts is the number of character n-grams (of all lengths from 1 to 4 together) that occur in both,
over the root of the product of their numbers: a blended spectrum of presences. Nyström landmarks turn it into a few
hundred features, one-versus-rest kernel ridge regression separates the languages, and a batch is scored by two
matrix products.

Defined cases: a text that is null or has no letter is ``und`` with score 0. Rows without a language are not learned
from. Repeated rows are predicted alike; of languages with equal outputs the first in the alphabet is taken. Without
training rows everything is ``und``, and an empty table gives an empty one. Texts of any length are predicted whole.
Only the named columns are read, so other columns may have any names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from postsift.llm.batches import bounded_batches
from postsift.llm.ngrams import char_ngrams, words_of
from postsift.llm.sampling import least_hashed

LOW, HIGH = 1, 4
BUCKETS = 1 << 16
LANDMARKS = 192
RIDGE = 1e-3
#: The fit's bounds: rows of each language, and characters of a row that may be chosen.
PER_LANG = 400
FIT_CHARS = 20_000
UNKNOWN = "und"
TEXTS = 64


def presences(texts: pa.Array) -> np.ndarray:
    """One row of bits per text: which n-gram buckets occur in it."""
    words = words_of(texts, r"\pL")
    owner, bucket = char_ngrams(words.names, LOW, HIGH, BUCKETS, whole=False)
    order = np.argsort(owner, kind="stable")
    bucket = bucket[order]
    sizes = np.bincount(owner, minlength=len(words.names))
    firsts = np.cumsum(sizes) - sizes
    out = np.zeros((len(texts), BUCKETS), bool)
    for i, (lo, hi) in enumerate(zip(words.begins, words.begins[1:])):
        seen = np.unique(words.which[lo:hi])
        n = sizes[seen]
        out[i, bucket[np.repeat(firsts[seen] - (np.cumsum(n) - n), n) + np.arange(n.sum())]] = True
    return out


@dataclass
class Model:
    """``weights`` takes kernel values with the landmarks to one output per language."""

    langs: list[str]
    columns: np.ndarray  # buckets that occur in a landmark
    landmarks: np.ndarray  # landmark by column, scaled
    weights: np.ndarray
    bias: np.ndarray

    def kernel(self, bits: np.ndarray) -> np.ndarray:
        size = np.sqrt(np.maximum(bits.sum(axis=1), 1)).astype(np.float32)
        return bits[:, self.columns].astype(np.float32) @ self.landmarks.T / size[:, None]

    def predict(self, texts: pa.Array) -> tuple[list[str], np.ndarray]:
        langs, scores = [], []
        for at in range(0, len(texts), TEXTS):
            bits = presences(texts.slice(at, TEXTS))
            outputs = self.kernel(bits) @ self.weights + self.bias
            best = outputs.argmax(axis=1) if self.langs else np.zeros(len(bits), np.int64)
            known = bits.any(axis=1) & bool(self.langs)
            langs += [self.langs[b] if k else UNKNOWN for b, k in zip(best, known)]
            top = outputs[np.arange(len(bits)), best] if self.langs else np.zeros(len(bits))
            scores.append(np.where(known, np.clip((top + 1) / 2, 0, 1), 0))
        return langs, np.concatenate(scores) if scores else np.zeros(0)


def train(texts: list[str | None], langs: list[str], landmarks: int = LANDMARKS, ridge: float = RIDGE) -> Model:
    """Landmarks are taken evenly from the languages; outputs are 1 for a language and -1 for the others."""
    names = sorted(set(langs))
    if not names:
        return Model([], np.zeros(0, np.int64), np.zeros((0, 0), np.float32), np.zeros((0, 0)), np.zeros(0))
    y = np.array([names.index(x) for x in langs])
    chosen = np.concatenate([np.flatnonzero(y == k)[: max(1, landmarks // len(names))] for k in range(len(names))])
    marks = presences(pa.array([texts[i] for i in chosen], pa.string()))
    columns = np.flatnonzero(marks.any(axis=0))
    scaled = (marks[:, columns] / np.sqrt(np.maximum(marks.sum(axis=1), 1))[:, None]).astype(np.float32)
    model = Model(names, columns, scaled, np.zeros((len(chosen), len(names))), np.zeros(len(names)))
    among = model.kernel(marks).astype(np.float64)
    values, vectors = np.linalg.eigh((among + among.T) / 2)
    good = values > 1e-6 * values.max()
    root = vectors[:, good] / np.sqrt(values[good])
    rows = [model.kernel(presences(pa.array(texts[at: at + TEXTS], pa.string()))) for at in range(0, len(texts), TEXTS)]
    features = np.concatenate(rows).astype(np.float64) @ root
    target = np.where(y[:, None] == np.arange(len(names)), 1.0, -1.0)
    share = 1 / np.bincount(y, minlength=len(names))[y]  # languages count alike
    share = (share / share.sum())[:, None]
    centre, mean = (share * features).sum(axis=0), (share * target).sum(axis=0)
    x = features - centre
    solved = np.linalg.solve(x.T @ (share * x) + ridge * np.eye(x.shape[1]), x.T @ (share * (target - mean)))
    model.weights = (root @ solved).astype(np.float32)
    model.bias = (mean - centre @ solved).astype(np.float32)
    return model


def labelled_sample(docs: DataFrame, allowed: Column, key: str = "doc_id", text: str = "text", lang: str = "lang",
                    per_lang: int = PER_LANG, chars: int = FIT_CHARS) -> DataFrame:
    """(text, lang): at most ``per_lang`` rows of each language, those with the least hash of their key.

    Of rows that share key and language the least text stands for all, so the bound holds for repeated rows too.
    """
    rows = (docs.filter(allowed & F.col(lang).isNotNull() & F.col(text).rlike(r"\p{L}") & (F.length(text) <= chars))
            .select(F.col(key).alias("key"), F.col(lang).alias("lang"), F.col(text).alias("text")))
    picked = least_hashed(rows, "lang", "key", per_lang)
    # per_lang keys for each language: the bound that lets them be broadcast.
    return (rows.join(F.broadcast(picked), (F.col("key") == F.col("k")) & (F.col("lang") == F.col("g")))
            .groupBy("key", "lang").agg(F.min("text").alias("text")).select("text", "lang"))


def fit(docs: DataFrame, allowed: Column, **names) -> Model:
    rows = labelled_sample(docs, allowed, **names).collect()
    rows.sort(key=lambda r: (r.lang, r.text))
    order = np.random.default_rng(3).permutation(len(rows))
    return train([rows[i].text for i in order], [rows[i].lang for i in order])


def predicted(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, lang_pred, score): one row per row of ``docs``, over the whole text."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @pandas_udf("lang string, score double")
    def predict(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            langs, scores = [], [np.zeros(0)]
            whole = pa.RecordBatch.from_arrays([pa.array(texts, pa.string(), from_pandas=True)], ["t"])
            for part in bounded_batches(iter([whole]), 0):
                found, score = shared.value.predict(part.column(0))
                langs += found
                scores.append(score)
            yield pd.DataFrame({"lang": langs, "score": np.concatenate(scores)})

    rows = docs.select(key, predict(F.col(text)).alias("__p"))
    return rows.select(key, F.col("__p.lang").alias("lang_pred"), F.col("__p.score").alias("score"))
