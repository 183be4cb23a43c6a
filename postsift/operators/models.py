"""Text and embedding classifiers on Spark ML, with the evaluation of a held-out split."""

from __future__ import annotations

import json
import math
from dataclasses import dataclass, field

from pyspark.ml.classification import LogisticRegressionModel, OneVsRest, OneVsRestModel
from pyspark.ml.feature import CountVectorizerModel
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from postsift.functions.arrays import l2_normalize
from postsift.operators.features import TextFeatures, fit_text_features, summed_terms, tallier, with_vectors
from postsift.operators.logistic import BlockLogisticRegression, BlockOneVsRest
from postsift.operators.rows import keep_one, labelled_only
from postsift.operators.scoring import softmax, topk

#: N-grams that a model knows at the most.
MAX_NGRAMS = 1 << 18
#: Gradients of many partitions are summed in this many steps before they reach the driver.
AGGREGATION_DEPTH = 3
#: Fits before one counts as failed, and the most that the iterations grow by from one to the next.
EFFORTS = 8
MAX_GROWTH = 8
#: The model's parameter of that name; scoring stacks no rows.
BLOCK_MB = 64.0
#: Rows of a task in training, at least.
ROWS_PER_TASK = 2000


def label_index(labels: list[str], c: Column) -> Column:
    return F.array_position(F.array(*map(F.lit, labels)), c).cast("double") - 1


def known_labels(df: DataFrame) -> list[str]:
    """The sorted label set: a handful of class names, the only thing collected for training."""
    labels = [r["label"] for r in df.select("label").distinct().orderBy("label").collect()]
    if not labels:
        raise ValueError("no labelled examples")
    return labels


def class_weights(df: DataFrame, labels: list[str]) -> DataFrame:
    """Add ``class_weight`` = rows / (classes * rows of the label)."""
    sizes = df.groupBy(F.col("label").alias("__l")).agg(F.count(F.lit(1)).alias("__n"))
    total = F.sum("__n").over(W.partitionBy())
    weighted = sizes.select("__l", (total / (F.lit(len(labels)) * F.col("__n"))).alias("class_weight"))
    # One row per class of the model.
    return df.join(F.broadcast(weighted), F.col("label") == F.col("__l")).drop("__l")


def _gathered(data: DataFrame, rows: int) -> DataFrame:
    """``data`` in as few tasks as its rows need, one a core at the most: every task sends a gradient of all coefficients in every pass."""
    return data.coalesce(max(1, min(-(-rows // ROWS_PER_TASK), data.sparkSession.sparkContext.defaultParallelism)))


def examples(df: DataFrame, text: str | None = None, keys: list[str] = ("account", "message_id")) -> DataFrame:
    """What a trainer may learn from: rows with a label and with text, the first of each key.

    Keys are compared null-safe, so mail without an id is one example a mailbox; ``keys=()`` keeps repeated rows.
    """
    usable = labelled_only(df)
    if text is not None:
        usable = usable.filter(F.col(text) != "")
    return keep_one(usable, list(keys)) if keys else usable


def _surplus(model, data: DataFrame, classes: int, weight: Column) -> float:
    """The largest difference, over the classes, of summed probability and rows.

    The intercept is free of penalty, so its gradient is this difference, and zero at the optimum.
    """
    scored = model.transform(data)
    if "probability" in scored.columns and not isinstance(model, OneVsRestModel):
        probability = vector_to_array(F.col("probability"))
    else:
        probability = F.transform(vector_to_array(F.col("rawPrediction")), lambda m: 1 / (1 + F.exp(-m)))
    scored = scored.select(probability.alias("p"), "label_index", weight.alias("w"))
    sums = scored.agg(*[F.sum(F.col("w") * (F.get("p", F.lit(k)) - (F.col("label_index") == k).cast("double"))).alias(f"s{k}")
                        for k in range(classes)]).first()
    return max(abs(s or 0.0) for s in sums)


def fit_certified(estimator, data: DataFrame, classes: int, rows: int, first_iter: int, weight: Column | None = None):
    """Fits with growing effort until every class's summed probability equals its rows.

    The iterations grow at once by what is missing: the surplus falls about with their square. They at least double, and the
    solver's own tolerance falls tenfold for each doubling.
    The certificate allows a quarter of a row, or a millionth of all rows where that is more.
    """
    solver = estimator.getClassifier() if isinstance(estimator, OneVsRest) else estimator
    allowed, effort, tolerance = max(0.25, 1e-6 * rows), first_iter, 1e-6
    for _ in range(EFFORTS):
        solver.setMaxIter(effort).setTol(tolerance)
        model = estimator.fit(data)
        surplus = _surplus(model, data, classes, F.lit(1.0) if weight is None else weight)
        if surplus <= allowed:
            return model
        growth = math.ceil(min(MAX_GROWTH, max(2, math.sqrt(surplus / allowed))))
        effort, tolerance = growth * effort, tolerance / 10 ** math.ceil(math.log2(growth))
    raise RuntimeError(f"the fit did not settle in {effort} iterations")


def fit_logistic(df: DataFrame, labels: list[str], c: float, first_iter: int, balanced: bool, rows: int | None = None):
    """Multinomial L2 logistic regression; the penalty follows C through 1 / (C * weight sum).

    ``rows`` saves a count where making ``df`` is dear.
    """
    rows = df.count() if rows is None else rows
    lr = BlockLogisticRegression(featuresCol="features", labelCol="label_index", family="multinomial", elasticNetParam=0.0,
                                 standardization=False, aggregationDepth=AGGREGATION_DEPTH, maxBlockSizeInMB=BLOCK_MB,
                                 regParam=1.0 / (c * max(rows, 1)))
    data = df.withColumn("label_index", label_index(labels, F.col("label")))
    if balanced:
        data, lr = class_weights(data, labels), lr.setWeightCol("class_weight")
    try:
        return fit_certified(lr, data, len(labels), rows, first_iter, F.col("class_weight") if balanced else None)
    finally:
        lr.release()


@dataclass
class NgramFeatures:
    """Counts of known word n-grams, n = 1..word_n; the vocabulary is what the training rows hold."""

    word_n: int
    vocabulary: CountVectorizerModel
    _known: object = field(default=None, init=False, repr=False, compare=False)

    @staticmethod
    def _words(column: str):
        """The words of a text with one space between them."""
        return F.array_join(F.filter(F.split(F.coalesce(F.col(f"`{column}`"), F.lit("")), r"\s+"), lambda t: t != ""), " ")

    @classmethod
    def fit(cls, df: DataFrame, column: str, word_n: int, min_rows: int, size: int) -> NgramFeatures:
        """The ``size`` most frequent n-grams of at least ``min_rows`` rows, the first in order of those as frequent.

        No more than that reaches one task or the driver. Their strings stay in the JVM.
        """
        words = df.select(F.monotonically_increasing_id().alias("__row"), cls._words(column).alias("words"))
        terms = summed_terms(words, "word", word_n).filter(F.col("df") >= min_rows).orderBy(F.desc("total"), "term").limit(size)
        listed = F.transform(F.array_sort(F.collect_list(F.struct(-F.col("total"), "term"))), lambda t: t["term"])
        found = terms.agg(listed.alias("terms"))._jdf.first().getList(0)
        if not len(found):
            raise ValueError(f"no n-gram is in {min_rows} rows")
        sc = df.sparkSession.sparkContext
        strings = sc._jvm.java.util.Arrays.copyOf(found.toArray(), len(found), sc._gateway.new_array(sc._jvm.java.lang.String, 0).getClass())
        vocabulary = CountVectorizerModel._create_from_java_class("org.apache.spark.ml.feature.CountVectorizerModel", strings)
        vocabulary._set(vocabSize=size, minDF=float(min_rows), inputCol="__grams", outputCol="features")
        return cls(word_n, vocabulary)

    def transform(self, df: DataFrame, column: str) -> DataFrame:
        """Adds a sparse vector per row; rows stay in their tasks."""
        if self._known is None:
            terms = self.vocabulary.vocabulary
            self._known = df.sparkSession.sparkContext.broadcast(({t: i for i, t in enumerate(terms)}, len(terms)))
        known, counting = self._known, tallier("word", self.word_n)

        def encoder():
            import numpy as np

            index, size = known.value
            tally = counting(index.get)

            def encode(rows):
                at, times = tally(rows[0])
                order = at.argsort()
                return at[order].astype(np.int32), times[order].astype(float)

            return size, encode

        return with_vectors(df.withColumn("__words", self._words(column)), ["__words"], encoder, "features")

    def save(self, path: str) -> dict:
        self.vocabulary.write().overwrite().save(f"{path}/vocabulary")
        return {"kind": "ngram", "word_n": self.word_n}


@dataclass
class EmbeddingFeatures:
    """A vector column, scaled to unit length."""

    def transform(self, df: DataFrame, column: str) -> DataFrame:
        return df.withColumn("features", array_to_vector(l2_normalize(F.col(column))))

    def save(self, path: str) -> dict:
        return {"kind": "embedding"}


@dataclass
class Classifier:
    """A fitted model that turns rows into the top-k candidate labels."""

    model: object
    labels: list[str]
    features: TextFeatures | NgramFeatures | EmbeddingFeatures

    def _scored(self, df: DataFrame, text: str) -> tuple[DataFrame, Column]:
        scored = self.model.transform(self.features.transform(df, text))
        if "probability" in scored.columns:
            return scored, vector_to_array(F.col("probability"))
        # One-vs-rest gives margins: decision scores become probabilities.
        return scored, softmax(vector_to_array(F.col("rawPrediction")))

    def candidates(self, df: DataFrame, text: str = "training_text", k: int = 3, out: str = "candidates") -> DataFrame:
        scored, probability = self._scored(df, text)
        return scored.withColumn(out, topk(probability, self.labels, k)).select(*df.columns, out)

    def predict(self, df: DataFrame, text: str = "training_text") -> DataFrame:
        return (self.candidates(df, text, 1, "__c").withColumn("prediction", F.get(F.col("__c"), F.lit(0))["label"])
                .drop("__c"))

    def class_mass(self, df: DataFrame, text: str = "training_text") -> DataFrame:
        """(label, mass): summed probability of each label; one-vs-rest models count each label's own sigmoid.

        Over the training rows of a converged model it is the number of rows of the label.
        """
        scored, probability = self._scored(df, text)
        if "probability" not in scored.columns:
            probability = F.transform(vector_to_array(F.col("rawPrediction")), lambda m: 1 / (1 + F.exp(-m)))
        return (scored.select(F.posexplode(probability).alias("i", "p")).groupBy("i").agg(F.sum("p").alias("mass"))
                .select(F.get(F.array(*map(F.lit, self.labels)), F.col("i")).alias("label"), "mass"))

    def save(self, spark: SparkSession, path: str) -> None:
        """Model, labels and features below ``path``, for :func:`load_classifier`."""
        self.model.write().overwrite().save(f"{path}/model")
        about = {"labels": self.labels, "ova": isinstance(self.model, OneVsRestModel), "features": self.features.save(path)}
        spark.createDataFrame([(json.dumps(about),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/about")


def load_classifier(spark: SparkSession, path: str) -> Classifier:
    about = json.loads(spark.read.text(f"{path}/about").first()["value"])
    made = about["features"]
    kind = made.pop("kind")
    if kind == "tfidf":
        features = TextFeatures(spark.read.parquet(f"{path}/vocabulary"), **made)
    elif kind == "ngram":
        features = NgramFeatures(made["word_n"], CountVectorizerModel.load(f"{path}/vocabulary"))
    else:
        features = EmbeddingFeatures()
    reader = OneVsRestModel if about["ova"] else LogisticRegressionModel
    return Classifier(reader.load(f"{path}/model"), about["labels"], features)


def train_tfidf(train: DataFrame, text: str = "training_text", c: float = 4.0, first_iter: int = 500, balanced: bool = False,
                word_n: int = 2, char_n: int = 5, min_df: int = 2, max_features: int = 120_000,
                keys: list[str] = ("account", "message_id")) -> Classifier:
    train = examples(train, text, keys)
    labels = known_labels(train)
    fitted: TextFeatures = fit_text_features(train, text, word_n, char_n, min_df, max_features)
    rows = fitted.rows(train)
    # Vectors are made again where they are read: they are many times as large as the text.
    data = _gathered(fitted.transform(train.select("seq", "label", text), text).select("label", "features"), rows)
    if balanced:
        data = data.persist()
    try:
        model = fit_logistic(data, labels, c, first_iter, balanced, rows)
    finally:
        data.unpersist()
    return Classifier(model, labels, fitted)


def train_ngram(train: DataFrame, text: str = "training_text", loss: str = "softmax", word_n: int = 2, c: float = 4.0,
                first_iter: int = 100, min_rows: int = 2, size: int = MAX_NGRAMS, keys: list[str] = ("account", "message_id")) -> Classifier:
    """Linear model over word n-gram counts; ``loss`` is "softmax" or "ova" (one model per label).

    N-grams of a single row say nothing about others and make most of the coefficients; ``min_rows=1`` keeps them.
    """
    if loss not in ("softmax", "ova"):
        raise ValueError(f"unsupported loss: {loss}")
    train = examples(train, text, keys)
    labels = known_labels(train)

    features = NgramFeatures.fit(train, text, word_n, min_rows, size)
    rows = train.count()
    data = _gathered(features.transform(train.select("label", text), text).select("label", "features"), rows).persist()
    try:
        if loss == "softmax":
            model = fit_logistic(data, labels, c, first_iter, False, rows)
        else:
            binary = BlockLogisticRegression(featuresCol="features", labelCol="label_index", family="binomial", standardization=False,
                                             aggregationDepth=AGGREGATION_DEPTH, maxBlockSizeInMB=BLOCK_MB, regParam=1.0 / (c * max(rows, 1)))
            every = BlockOneVsRest(classifier=binary, featuresCol="features", labelCol="label_index")
            indexed = data.withColumn("label_index", label_index(labels, F.col("label")))
            try:
                model = fit_certified(every, indexed, len(labels), rows, first_iter)
            finally:
                binary.release()
    finally:
        data.unpersist()
    return Classifier(model, labels, features)


def train_embedding(train: DataFrame, vectors: str = "embedding", c: float = 1.0, first_iter: int = 100,
                    balanced: bool = False, keys: list[str] = ("account", "message_id")) -> Classifier:
    """Rows whose vector is null or holds a null are no examples."""
    whole = F.coalesce(~F.exists(F.col(vectors), lambda x: x.isNull()), F.lit(False))
    train = examples(train.filter(whole), None, keys)
    labels = known_labels(train)

    features = EmbeddingFeatures()
    data = _gathered(features.transform(train.select("label", vectors), vectors).select("label", "features"), train.count()).persist()
    try:
        model = fit_logistic(data, labels, c, first_iter, balanced)
    finally:
        data.unpersist()
    return Classifier(model, labels, features)
