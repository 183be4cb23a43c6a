"""Evaluation reports, top-k scoring, guarded classification and the draft gate."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postsift import constants as K
from postsift.functions import text as T
from postsift.functions.arrays import let


def label_counts(df: DataFrame) -> DataFrame:
    return df.groupBy("label").agg(F.count(F.lit(1)).alias("n"))


def classification_report(df: DataFrame, label: str = "label", prediction: str = "prediction",
                          labels: DataFrame | None = None) -> DataFrame:
    """Per-label precision, recall, F1 and support, then accuracy, macro and weighted rows.

    Rows collapse to (label, prediction) counts first; all later steps run on that confusion table. ``labels`` (a
    ``label`` column) is the whole label set: one that occurs on neither side counts with zeros in the macro average.
    """
    confusion = df.groupBy(F.col(label).alias("y"), F.col(prediction).alias("p")).agg(F.count(F.lit(1)).alias("n"))
    sides = confusion.select(
        "n", F.explode(F.array(F.struct(F.col("y").alias("label"), F.lit(1).alias("truth")),
                               F.struct(F.col("p").alias("label"), F.lit(0).alias("truth")))).alias("s"),
        (F.col("y") == F.col("p")).alias("hit"))
    per = sides.groupBy(F.col("s.label").alias("label")).agg(
        F.sum(F.when(F.col("s.truth") == 1, F.col("n")).otherwise(0)).alias("support"),
        F.sum(F.when(F.col("s.truth") == 0, F.col("n")).otherwise(0)).alias("predicted"),
        F.sum(F.when((F.col("s.truth") == 1) & F.col("hit"), F.col("n")).otherwise(0)).alias("tp"))
    if labels is not None:
        known = labels.select(F.col("label").alias("__l")).distinct()
        per = per.join(known, F.col("label") == F.col("__l"), "full").select(
            F.coalesce("label", "__l").alias("label"), *[F.coalesce(c, F.lit(0)).alias(c) for c in ("support", "predicted", "tp")])
    zero = F.lit(0.0)
    per = (per.withColumn("precision", F.when(F.col("predicted") > 0, F.col("tp") / F.col("predicted")).otherwise(zero))
           .withColumn("recall", F.when(F.col("support") > 0, F.col("tp") / F.col("support")).otherwise(zero)))
    both = F.col("precision") + F.col("recall")
    per = per.withColumn("f1", F.when(both > 0, 2 * F.col("precision") * F.col("recall") / both).otherwise(zero))
    scores = ["precision", "recall", "f1"]
    total = F.sum("support")
    overall = per.agg(
        (F.sum("tp") / total).alias("accuracy"), total.alias("total"),
        *[F.avg(s).alias(f"m_{s}") for s in scores],
        *[(F.sum(F.col(s) * F.col("support")) / total).alias(f"w_{s}") for s in scores])
    summary = overall.select(F.explode(F.array(
        F.struct(F.lit("accuracy").alias("label"), *[F.col("accuracy").alias(s) for s in scores],
                 F.col("total").alias("support")),
        F.struct(F.lit("macro avg").alias("label"), *[F.col(f"m_{s}").alias(s) for s in scores],
                 F.col("total").alias("support")),
        F.struct(F.lit("weighted avg").alias("label"), *[F.col(f"w_{s}").alias(s) for s in scores],
                 F.col("total").alias("support")))).alias("r")).select("r.*")
    return per.select("label", *scores, "support").unionByName(summary)


def metrics_document(rows: DataFrame, settings: dict | None = None, label: str = "label", prediction: str = "prediction",
                     split: str = "split") -> DataFrame:
    """(value): one JSON document about a trained model, all keys sorted.

    ``rows`` are all examples with their split; ``prediction`` counts in the rows of "valid". The document holds the
    ``settings``, the numbers of examples, the label counts, the accuracy and the report over every label. One aggregate
    of the examples and one of the validation rows feed it; what is gathered is a few rows per label.
    """
    spark = rows.sparkSession
    counts = rows.groupBy(F.col(label).alias("label")).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col(split) == "valid").alias("valid"))

    def listed(text: Column) -> Column:
        """One object of all rows, sorted by label; ``text`` is a row's own object with the label as its one key."""
        inner = F.substring(text, F.lit(2), F.length(text) - 2)
        joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("label", inner.alias("t")))), lambda e: e["t"]), ",")
        return F.concat(F.lit("{"), joined, F.lit("}"))

    one = lambda value: F.to_json(F.create_map(F.col("label"), value))
    sizes = counts.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("examples"), F.coalesce(F.sum("valid"), F.lit(0)).alias("valid_examples"),
        listed(one(F.col("n"))).alias("label_counts"))
    sizes = sizes.select(F.explode(F.map_from_arrays(
        F.array(*map(F.lit, ("examples", "valid_examples", "train_examples", "label_counts"))),
        F.array(F.col("examples").cast("string"), F.col("valid_examples").cast("string"),
                (F.col("examples") - F.col("valid_examples")).cast("string"), F.col("label_counts")))).alias("name", "value"))
    report = classification_report(rows.filter(F.col(split) == "valid"), label, prediction, rows.select(F.col(label).alias("label")))
    cell = F.when(F.col("label") == "accuracy", one(F.col("f1"))).otherwise(one(F.struct(
        F.col("f1").alias("f1-score"), "precision", "recall", "support")))
    scores = report.agg(listed(cell).alias("classification_report"),
                        F.coalesce(F.max(F.when(F.col("label") == "accuracy", F.col("f1"))).cast("string"), F.lit("null")).alias("accuracy"))
    scores = scores.select(F.explode(F.create_map(
        F.lit("classification_report"), F.col("classification_report"), F.lit("accuracy"), F.col("accuracy"))).alias("name", "value"))
    given = spark.createDataFrame([(k, json.dumps(v, sort_keys=True)) for k, v in (settings or {}).items()], "name string, value string")
    parts = sizes.unionByName(scores).unionByName(given)
    text = F.to_json(F.create_map("name", F.lit(0)))
    named = F.concat(F.substring(text, F.lit(2), F.length(text) - 3), F.col("value"))
    return parts.agg(F.concat(F.lit("{"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("name", named.alias("t")))),
                                                                   lambda e: e["t"]), ","), F.lit("}")).alias("value"))


def precision_at_1(df: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    hit = F.avg((F.col(label) == F.col(prediction)).cast("double"))
    return df.agg(F.count(F.lit(1)).alias("examples"), hit.alias("precision_at_1"), hit.alias("recall_at_1"))


def softmax(scores: Column) -> Column:
    """Probabilities from decision scores, shifted by the maximum."""
    shifted = let(F.struct(scores.cast("array<double>").alias("s"), F.array_max(scores).cast("double").alias("top")),
                  lambda v: F.transform(v["s"], lambda x: F.exp(x - v["top"])))
    summed = let(shifted, lambda e: F.struct(e.alias("e"), F.aggregate(e, F.lit(0.0), lambda a, x: a + x).alias("total")))
    return let(summed, lambda v: F.transform(v["e"], lambda e: e / v["total"]))


def topk(probabilities: Column, labels: list[str], k: int = 3) -> Column:
    """The ``k`` most probable labels, highest first; the later label wins an exact tie."""
    named = F.transform(probabilities, lambda p, i: F.struct(
        p.alias("confidence"), i.alias("pos"), F.get(F.array(*map(F.lit, labels)), i).alias("label")))
    best = F.slice(F.sort_array(named, asc=False), 1, k)
    return F.transform(best, lambda c: F.struct(c["label"].alias("label"), c["confidence"].alias("confidence")))


def with_prediction(df: DataFrame, candidates: Column) -> DataFrame:
    df = df.withColumn("candidates", candidates)
    return (df.withColumn("label", F.get(F.col("candidates"), F.lit(0))["label"])
            .withColumn("confidence", F.get(F.col("candidates"), F.lit(0))["confidence"]))


def guard_with_rules(df: DataFrame, candidates: Column, source: str = "scoring_text") -> DataFrame:
    """A keyword hit decides with fixed confidence; otherwise the model's candidates stand."""
    df = T.classify_by_rules(df, source, "__rule")
    ruled = F.array(F.struct(F.col("__rule").alias("label"), F.lit(K.RULE_CONFIDENCE).alias("confidence")))
    return with_prediction(df, F.when(F.col("__rule").isNotNull(), ruled).otherwise(candidates)).drop("__rule")


def mailbox_label(c: Column) -> Column:
    chain = F
    for label, folder in K.MAILBOX_LABELS.items():
        chain = chain.when(c == label, F.lit(folder))
    return chain


def draft_gate(df: DataFrame, owner: str, blocked_senders: DataFrame, label: str = "label") -> DataFrame:
    """Add ``should_auto_draft`` and, when false, the first reason as ``draft_block_reason``.

    Markers are looked up in the sender only, never in the subject.
    """
    df = df.withColumn("__email", T.extract_email(F.col("from")))
    blocked = blocked_senders.select(F.lower("email").alias("__blocked")).distinct()
    df = df.join(blocked, F.col("__email") == F.col("__blocked"), "left")
    df = df.withColumns({
        "__local": F.regexp_replace(F.substring_index("__email", "@", 1), "[._+]+", "-"),
        "__domain": F.substring_index("__email", "@", -1),
        "__name": F.lower(T.display_name(F.col("from")))})
    # The markers become columns of their own: the reason chain tests and prints each of them.
    df = df.withColumns({
        "__on_local": T.first_contained(F.col("__local"), K.DRAFT_LOCAL_MARKERS),
        "__on_name": T.first_contained(F.col("__name"), K.AUTOMATED_NAME_MARKERS),
        "__on_domain": T.first_contained(F.col("__domain"), K.DRAFT_DOMAIN_MARKERS)})
    on_local, on_name, on_domain = F.col("__on_local"), F.col("__on_name"), F.col("__on_domain")
    reason = (
        F.when(~F.col(label).isin(K.DRAFT_LABELS), F.concat(F.lit("label_not_draftable:"), F.col(label)))
        .when(~F.contains(F.lower(F.coalesce("to", F.lit(""))), F.lit(owner.lower())),
              F.lit(f"not_directly_to_owned_mailbox:{owner}"))
        .when(F.col("__email") == "", F.lit("sender_not_found"))
        .when(F.col("__email") == owner.lower(), F.lit("sender_is_owner"))
        .when(F.col("__blocked").isNotNull(), F.concat(F.lit("automated_sender:"), F.col("__email")))
        .when(on_local.isNotNull(), F.concat(F.lit("automated_sender_local:"), on_local))
        .when(on_name.isNotNull(), F.concat(F.lit("automated_sender_name:"), on_name))
        .when(on_domain.isNotNull(), F.concat(F.lit("automated_sender_domain:"), F.col("__domain"))))
    return (df.withColumn("draft_block_reason", reason)
            .withColumn("should_auto_draft", F.col("draft_block_reason").isNull())
            .drop("__email", "__blocked", "__local", "__domain", "__name", "__on_local", "__on_name", "__on_domain"))


def draft_candidates(df: DataFrame, class_labels: list[str]) -> DataFrame:
    """Messages not yet handled: no system label, not classified, and no draft in their thread.

    ``gmail_label_names`` carries the names; ``class_labels`` are the folders that mark a classified message.
    """
    names = F.coalesce(F.col("gmail_label_names"), F.array().cast("array<string>"))
    drafted = (df.filter(F.array_contains(names, K.DRAFT_READY_LABEL) & F.col("thread_id").isNotNull())
               .select("account", "thread_id").distinct())
    done = F.array(*map(F.lit, [*K.SYSTEM_MAIL_LABELS, K.DRAFT_READY_LABEL, *class_labels]))
    return df.filter(~F.arrays_overlap(names, done)).join(drafted, ["account", "thread_id"], "left_anti")
