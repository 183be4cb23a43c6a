"""What fits and scores read: texts cleaned once, one copy of the rows for all classes, vectors that are never shuffled."""

import math
import pickle
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.ml.classification import LogisticRegression, OneVsRest
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from postsift.operators import features as FE
from postsift.operators import logistic
from postsift.operators import models as ML
from postsift.operators.logistic import BlockLogisticRegression, BlockOneVsRest
from postsift.plans import model_queries as Q
from test_features import grams

MAIL = "seq long, account string, message_id string, label string, training_text string"


def test_the_split_reads_cleaned_texts(spark, monkeypatch):
    plans, examples = [], ML.examples
    monkeypatch.setattr(ML, "examples", lambda df, *more: plans.append(df._jdf.queryExecution().optimizedPlan().toString()) or examples(df, *more))
    Q._split(spark, "/root/testdata/sf0.001")
    assert len(plans) == 1 and "ArrowEvalPython" not in plans[0] and "explode" not in plans[0]


def test_one_vs_rest_fits_all_classes_over_one_copy_of_the_rows(spark, monkeypatch):
    rows = [(i, "a", str(i), "abc"[i % 3], f"w{i % 7} w{i % 5} {'xyz'[i % 3]}{i % 4}") for i in range(90)]
    begun, begin = [], BlockLogisticRegression._begun
    monkeypatch.setattr(BlockLogisticRegression, "_begun", lambda self, *more: begun.append(1) or begin(self, *more))
    mail = spark.createDataFrame(rows, MAIL)
    model = ML.train_ngram(mail, loss="ova")
    assert len(begun) == 1 and len(model.model.models) == 3
    assert {r["label"]: r["mass"] for r in model.class_mass(mail).collect()} == {k: pytest.approx(30, abs=0.25) for k in "abc"}


@pytest.mark.parametrize("chunk", [7, 1 << 15])
def test_one_vs_rest_has_the_optimum_of_spark_ml(spark, monkeypatch, chunk):
    monkeypatch.setattr(logistic, "CHUNK_ENTRIES", chunk)
    draw = np.random.default_rng(3)
    rows = spark.createDataFrame([(float(i % 3), Vectors.sparse(12, {int(j): float(draw.integers(1, 4)) for j in {i % 3, *draw.integers(0, 12, 4)}}))
                                  for i in range(150)], ["label", "features"]).repartition(2).cache()
    wanted = {"family": "binomial", "standardization": False, "regParam": 1 / 50, "maxIter": 500}
    solver = BlockLogisticRegression(tol=1e-8, **wanted)
    ours = BlockOneVsRest(classifier=solver).fit(rows)
    solver.release()
    theirs = OneVsRest(classifier=LogisticRegression(tol=1e-12, **wanted)).fit(rows)
    for a, b in zip(ours.models, theirs.models, strict=True):
        assert a.coefficients.toArray() == pytest.approx(b.coefficients.toArray(), abs=1e-3)
        assert a.intercept == pytest.approx(b.intercept, abs=1e-3) and a.getLabelCol() == b.getLabelCol()


def test_a_fit_has_no_more_tasks_than_cores(spark):
    data = spark.range(1000, numPartitions=40)
    assert ML._gathered(data, 1_000_000).rdd.getNumPartitions() == spark.sparkContext.defaultParallelism
    assert ML._gathered(data, 3000).rdd.getNumPartitions() == 2


@pytest.mark.parametrize("value, kind", [(3.0, np.uint8), (0.5, np.float32), (0.1, np.float64)])
def test_blocks_hold_all_values_exactly(value, kind):
    kinds, sizes = pa.array([0, 0, 1, 0], pa.int8()), pa.array([4, 4, None, 4], pa.int32())
    indices = pa.array([[0, 2], [], None, [3]], pa.list_(pa.int32()))
    values = pa.array([[1.0, value], [], [5.0, 6.0, 7.0, 8.0], [9.0]], pa.list_(pa.float64()))
    vectors = pa.StructArray.from_arrays([kinds, sizes, indices, values], ["type", "size", "indices", "values"])
    batch = pa.RecordBatch.from_arrays([vectors, pa.array([0, 1, 2, 1], pa.int32()), pa.array([1.0, 2.0, 3.0, 4.0])], ["v", "l", "w"])
    wanted = np.array([[1, 0, value, 0], [0, 0, 0, 0], [5, 6, 7, 8], [0, 0, 0, 9]])
    for entries, most in ((100, 100), (100, 3), (2, 100), (1, 1)):
        found, labels, weights, kinds = [], [], [], set()
        for made in logistic._stacked(entries, most)([batch, batch]):
            size, columns, counts, row, held, label, weight = pickle.loads(made.column(0)[0].as_py())
            dense = np.zeros((len(label), size))
            dense[row, np.repeat(columns, counts)] = held
            found.append(dense)
            labels += label.tolist()
            weights += weight.tolist()
            kinds.add(held.dtype)
            assert len(label) <= most
        assert np.array_equal(np.concatenate(found), np.concatenate([wanted, wanted])) and np.dtype(kind) in kinds
        assert labels == [0, 1, 2, 1] * 2 and weights == [1, 2, 3, 4] * 2


def test_ngrams_are_the_most_frequent_of_the_rows(spark):
    rows = [(1, "b a  b"), (2, "a b"), (3, "c"), (4, "c x"), (5, "b\ta"), (6, "")]
    df = spark.createDataFrame(rows, "seq long, t string")
    features = ML.NgramFeatures.fit(df, "t", 2, 2, 4)
    assert features.vocabulary.vocabulary == ["b", "a", "a b", "b a"]
    found = {r["seq"]: r["features"] for r in features.transform(df, "t").collect()}
    assert found[1] == Vectors.sparse(4, {0: 2.0, 1: 1.0, 2: 1.0, 3: 1.0}) and found[4] == Vectors.sparse(4, {})
    assert found[5] == Vectors.sparse(4, {0: 1.0, 1: 1.0, 3: 1.0}) and len(found) == 6
    with pytest.raises(ValueError, match="n-gram"):
        ML.NgramFeatures.fit(df, "t", 2, 7, 4)


@pytest.mark.parametrize("held", [1, 200_000])
def test_tfidf_vectors_are_made_where_the_rows_are(spark, monkeypatch, held):
    monkeypatch.setattr(FE, "ENTRIES_HELD", held)
    rows = [(1, "p", "The cat; the hat x"), (2, "q", "a cat sat"), (2, "r", "cat cat"), (3, "s", ""), (4, "t", None), (None, "u", "cat"), (5, "v", "thé cat")]
    df = spark.createDataFrame(rows, "seq long, name string, t string")
    features = FE.fit_text_features(df, "t", 2, 5)
    made = features.transform(df, "t")
    plan = made._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "Aggregate" not in plan and "Join" not in plan
    vocab = {(r["block"], r["term"]): r for r in features.vocab.collect()}
    texts = {}
    for key, _, text in rows:
        texts[key] = texts.get(key, "") + " ; " + (text or "").lower().replace("é", "e")
    got = [(r["seq"], r["name"], r["features"]) for r in made.collect()]
    # Rows of one key share a vector, and come as a join by the key gives them; those without a key go.
    assert Counter((s, n) for s, n, _ in got) == {(1, "p"): 1, (2, "q"): 2, (2, "r"): 2, (3, "s"): 1, (4, "t"): 1, (5, "v"): 1}
    assert features.rows(df) == len(got)
    for key, _, vector in got:
        want = {}
        for block in ("word", "char"):
            split = [grams(t, block) for t in texts[key].split(" ; ")]
            tf = Counter(g for part in split for g in part if (block, g) in vocab)
            w = {g: (1 + math.log(n)) * vocab[block, g]["idf"] for g, n in tf.items()}
            norm = math.sqrt(sum(x * x for x in w.values()))
            want |= {vocab[block, g]["index"]: x / norm for g, x in w.items()}
        assert vector.size == features.size and dict(zip(vector.indices.tolist(), vector.values.tolist())) == pytest.approx(want, abs=1e-12)


def test_texts_are_prepared_once_for_totals_and_weights(spark):
    df = spark.createDataFrame([(1, "the cat"), (2, "a cat")], "seq long, t string").withColumn("t", F.upper("t"))
    plan = FE.char_tfidf(df, "t")._jdf.queryExecution().optimizedPlan().toString()
    assert "upper" not in plan and "ArrowEvalPython" not in plan
