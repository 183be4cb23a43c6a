"""Fits over blocks of rows: the optimum of Spark ML's own solver, in few passes, and from where the last fit ended."""

import numpy as np
import pytest
from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.linalg import Vectors

from postsift.operators import logistic
from postsift.operators import models as ML
from postsift.operators.logistic import BlockLogisticRegression


def _rows(spark, classes):
    draw, size = np.random.default_rng(1), 40
    rows = [(float(i % classes), Vectors.sparse(size, {int(j): float(draw.integers(1, 9)) * (5 if j == 0 else 1)
                                                       for j in {0, i % classes + 1, *draw.integers(0, size, 6)}}), float(draw.random() + 0.5))
            for i in range(200)]
    rows.append((0.0, Vectors.sparse(size, {}), 1.0))
    return spark.createDataFrame(rows, ["label", "features", "weight"]).repartition(2).cache()


@pytest.mark.parametrize("family, classes", [("multinomial", 3), ("binomial", 2)])
def test_the_optimum_is_that_of_spark_ml(spark, family, classes, tmp_path, monkeypatch):
    monkeypatch.setattr(logistic, "BLOCK_ENTRIES", 100)
    rows = _rows(spark, classes)
    wanted = {"family": family, "standardization": False, "regParam": 1 / 100, "weightCol": "weight", "maxIter": 500}
    theirs, solver = LogisticRegression(tol=1e-13, **wanted).fit(rows), BlockLogisticRegression(tol=1e-7, **wanted)
    solver.fit(rows).save(str(tmp_path / "model"))
    solver.release()
    ours = LogisticRegressionModel.load(str(tmp_path / "model"))
    assert ours.coefficientMatrix.toArray() == pytest.approx(theirs.coefficientMatrix.toArray(), abs=1e-2)
    assert ours.interceptVector.toArray() == pytest.approx(theirs.interceptVector.toArray(), abs=1e-2)
    scores = [np.array([r["probability"].toArray() for r in m.transform(rows).collect()]) for m in (ours, theirs)]
    assert scores[0] == pytest.approx(scores[1], abs=1e-2)


def test_one_fit_of_the_first_effort_settles_long_rows_of_rare_terms(spark, monkeypatch):
    """No second effort: the first certificate holds."""
    draw = np.random.default_rng(2)
    rows = []
    for i in range(240):
        common = " ".join(f"c{j}" for j in draw.integers(0, 20, 60))
        rows.append((i, "a", str(i), "abcd"[draw.integers(0, 4)], common + " " + " ".join(f"r{j}" for j in draw.integers(0, 1200, 30))))
    mail = spark.createDataFrame(rows, "seq long, account string, message_id string, label string, training_text string")
    efforts, fit = [], BlockLogisticRegression._fit_java
    monkeypatch.setattr(BlockLogisticRegression, "_fit_java", lambda self, data: efforts.append(self.getMaxIter()) or fit(self, data))
    model = ML.train_ngram(mail)
    assert efforts == [100]
    mass = {r["label"]: r["mass"] for r in model.class_mass(mail).collect()}
    assert mass == {k: pytest.approx(sum(r[3] == k for r in rows), abs=0.25) for k in "abcd"}


def test_a_further_fit_goes_on_from_the_last(spark):
    rows = _rows(spark, 3)
    solver = BlockLogisticRegression(family="multinomial", standardization=False, regParam=1 / 800, tol=1e-9, maxIter=20)
    solver.fit(rows)
    before = solver._state["at"][0]
    solver.setMaxIter(1).fit(rows)
    assert solver._state["at"][0] < before
    solver.release()
    assert solver._state is None


def test_one_label_has_all_the_probability(spark):
    rows = [(i, "a", str(i), "up", f"w{i % 3} w{i % 4}") for i in range(12)]
    mail = spark.createDataFrame(rows, "seq long, account string, message_id string, label string, training_text string")
    assert {r["candidates"][0]["confidence"] for r in ML.train_ngram(mail).candidates(mail).collect()} == {1.0}
