"""What trainers learn from, when their fits count as done, and the document they leave."""

import json

import pytest
from pyspark.sql import functions as F

from postsift.operators import models as ML
from postsift.operators import scoring as C
from postsift.sources import mail as M


def test_a_message_exported_twice_is_one_example(spark):
    rows = [(1, "a", "1", "fyi", "x"), (2, "a", "1", "done", "y"), (3, "b", "1", "fyi", "z"), (4, "a", "2", "", "x"), (5, "a", "3", "fyi", "")]
    mail = spark.createDataFrame(rows, "seq long, account string, message_id string, label string, t string")
    assert {r["seq"] for r in ML.examples(mail, "t").collect()} == {1, 3}
    assert {r["seq"] for r in ML.examples(mail, "t", ()).collect()} == {1, 2, 3}


def test_fits_go_on_until_probabilities_add_up(spark):
    rows = [(i, "a", str(i), "up" if i % 3 else "down", f"w{i % 7} w{i % 5} {'good' if i % 3 else 'bad'} n{i}") for i in range(90)]
    rows += [(i + 100, "a", str(i), "down", "a repeat that must not count") for i in range(90)]
    mail = spark.createDataFrame(rows, "seq long, account string, message_id string, label string, training_text string")
    model = ML.train_ngram(mail, first_iter=1)
    mass = {r["label"]: r["mass"] for r in model.class_mass(ML.examples(mail, "training_text")).collect()}
    assert mass == {"up": pytest.approx(60, abs=0.3), "down": pytest.approx(30, abs=0.3)}


def test_efforts_grow_by_what_the_last_fit_lacked(spark, monkeypatch):
    """A surplus that falls with the square of the iterations: no fit between the first and the one that settles."""
    tried = []

    class Solver:
        def setMaxIter(self, n):
            self.n = n
            return self

        def setTol(self, tolerance):
            tried.append((self.n, tolerance))

        def fit(self, data):
            return self.n

    monkeypatch.setattr(ML, "_surplus", lambda model, *more: 3.25 * (100 / model) ** 2)
    assert ML.fit_certified(Solver(), None, 4, 3383, 100) == 400
    assert tried == [(100, 1e-6), (400, pytest.approx(1e-8))]
    tried.clear()
    monkeypatch.setattr(ML, "_surplus", lambda model, *more: 0.3)
    with pytest.raises(RuntimeError, match="did not settle"):
        ML.fit_certified(Solver(), None, 4, 3383, 1)
    assert [n for n, _ in tried] == [1 << k for k in range(ML.EFFORTS)]


@pytest.mark.parametrize("loss", ["softmax", "ova"])
def test_a_fit_goes_through_the_coefficients_once_a_task(spark, loss):
    """Blocks of the default size, 1 MB, would make every task go through them for each of its blocks."""
    rows = [(i, "a", str(i), "up" if i % 3 else "down", f"w{i % 7} {'good' if i % 3 else 'bad'}") for i in range(60)]
    mail = spark.createDataFrame(rows, "seq long, account string, message_id string, label string, training_text string")
    fitted = ML.train_ngram(mail, loss=loss).model
    models = fitted.models if loss == "ova" else [fitted]
    assert {m.getMaxBlockSizeInMB() for m in models} == {ML.BLOCK_MB}


def test_rows_without_a_whole_vector_are_no_examples(spark):
    rows = [(i, "a", str(i), "up" if i % 2 else "down", [float(i % 2), 1.0]) for i in range(20)] + [(30, "a", "30", "lost", None),
                                                                                               (31, "a", "31", "lost", [1.0, None])]
    vectors = spark.createDataFrame(rows, "seq long, account string, message_id string, label string, embedding array<double>")
    assert ML.train_embedding(vectors).labels == ["down", "up"]


def test_the_metrics_document_is_one_sorted_file(spark, tmp_path):
    rows = spark.createDataFrame([("b", "train", None), ("a", "valid", "a"), ("b", "valid", "a"), ('q"', "valid", 'q"')],
                                 "label string, split string, prediction string")
    path = str(tmp_path / "metrics.json")
    for c in (4.0, 2.0):
        M.write_document(C.metrics_document(rows, {"c": c, "body_chars": None}), path)
    text = (tmp_path / "metrics.json").read_text()
    found = json.loads(text)
    assert json.dumps(found, sort_keys=True, separators=(",", ":")) == text.strip()
    assert (found["c"], found["body_chars"], found["examples"], found["train_examples"], found["valid_examples"]) == (2.0, None, 4, 1, 3)
    assert found["label_counts"] == {"a": 1, "b": 2, 'q"': 1} and found["accuracy"] == pytest.approx(2 / 3)
    assert found["classification_report"]["a"] == {"f1-score": pytest.approx(2 / 3), "precision": 0.5, "recall": 1.0, "support": 1}
    assert not (tmp_path / "metrics.json.writing").exists() and not (tmp_path / "metrics.json.previous").exists()
    with pytest.raises(ValueError, match="one row"):
        M.write_document(spark.createDataFrame([], "value string"), path)
