"""Labelling one representative per template, the confidence gate, reviews and label expansion."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postsift import constants as K
from postsift.functions import text as T
from postsift.operators.rows import keep_one
from postsift.schemas import LABEL_ANSWER, LABEL_RESPONSE


def existing_ids(df: DataFrame, keys: list[str] = ("message_id",)) -> DataFrame:
    """The distinct keys of rows with an id, which is the last key."""
    return df.filter(F.col(keys[-1]) != "").select(*keys).distinct()


def pending_records(df: DataFrame, done: DataFrame, limit: int | None = None, keys: list[str] = ("message_id",)) -> DataFrame:
    """Rows whose key is not in ``done``, in order; a missing id is always pending."""
    known = existing_ids(done, keys).select(*[F.col(k).alias(f"__{k}") for k in keys])
    same = F.col(keys[-1]) == F.col(f"__{keys[-1]}")
    for key in keys[:-1]:
        same = same & F.col(key).eqNullSafe(F.col(f"__{key}"))
    pending = df.join(known, same, "left_anti")
    return pending if limit is None else pending.orderBy("seq").limit(limit)


def label_requests(df: DataFrame, model: str, prompt: str, max_body_chars: int | None = None) -> DataFrame:
    """One JSON request per record for a batch labeller, with a strict answer schema."""
    def text_or_blank(name: str) -> Column:
        return F.coalesce(F.col(name), F.lit("")).alias(name)

    df = T.strip_reply_noise(df, T.body_source(df), "__body", max_body_chars)
    mail = F.to_json(F.struct(
        *[text_or_blank(n) for n in ("subject", "from", "to", "date", "snippet")],
        F.col("__body").alias("body"),
        F.coalesce(F.col("gmail_label_names"), F.array().cast("array<string>")).alias("gmail_label_names")))

    def message(role: str, content: Column) -> Column:
        return F.struct(F.lit(role).alias("role"), F.array(
            F.struct(F.lit("input_text").alias("type"), content.alias("text"))).alias("content"))

    def kind(name: str, **more: Column) -> Column:
        return F.struct(F.lit(name).alias("type"), *[c.alias(n) for n, c in more.items()])

    answer = F.struct(
        F.lit("object").alias("type"), F.lit(False).alias("additionalProperties"),
        F.struct(kind("string", enum=F.array(*map(F.lit, K.LABELS))).alias("label"),
                 kind("number", minimum=F.lit(0), maximum=F.lit(1)).alias("confidence"),
                 kind("string").alias("reason")).alias("properties"),
        F.array(*map(F.lit, ("label", "confidence", "reason"))).alias("required"))
    form = F.struct(F.lit("json_schema").alias("type"), F.lit("email_label").alias("name"),
                    F.lit(True).alias("strict"), answer.alias("schema"))
    return df.select("message_id", mail.alias("mail_json"), F.to_json(F.struct(
        F.lit(model).alias("model"),
        F.array(message("system", F.lit(prompt)), message("user", mail)).alias("input"),
        F.struct(form.alias("format")).alias("text"),
        F.lit(120).alias("max_output_tokens"))).alias("request"))


def parse_label_responses(df: DataFrame, source: str = "response") -> DataFrame:
    """Add ``openai_label``, ``openai_confidence``, ``openai_reason`` or a ``parse_error``.

    The answer is the top-level text, else the first usable part: per item the first part that holds
    a refusal or a text counts, and the first item whose part is not empty decides.
    """
    df = df.withColumn("__r", F.from_json(source, LABEL_RESPONSE))
    first_parts = F.transform(F.col("__r.output"), lambda item: F.get(F.filter(
        item["content"], lambda p: (F.coalesce(p["refusal"], F.lit("")) != "") | p["text"].isNotNull()), F.lit(0)))
    df = df.withColumn("__part", F.get(F.filter(first_parts, lambda p: (
        F.coalesce(p["refusal"], F.lit("")) != "") | (F.coalesce(p["text"], F.lit("")) != "")), F.lit(0)))
    top = F.col("__r.output_text")
    df = df.withColumn("__refused", (F.coalesce(top, F.lit("")) == "") & (
        F.coalesce(F.col("__part.refusal"), F.lit("")) != ""))
    df = df.withColumn("__text", F.when(top != "", top).otherwise(F.col("__part.text")))
    df = df.withColumn("__a", F.from_json("__text", LABEL_ANSWER))
    label = F.col("__a.label")
    error = (F.when(F.col("__refused"), F.concat(F.lit("refusal: "), F.col("__part.refusal")))
             .when(F.coalesce(F.col("__text"), F.lit("")) == "", "no output text")
             .when(~F.coalesce(label.isin(K.LABELS), F.lit(False)),
                   F.concat(F.lit("invalid label: "), F.coalesce(label, F.lit("none")))))
    df = df.withColumn("parse_error", error)
    fine = F.col("parse_error").isNull()
    return (df.withColumn("openai_label", F.when(fine, label))
            .withColumn("openai_confidence", F.when(fine, F.col("__a.confidence")))
            .withColumn("openai_reason", F.when(fine, F.col("__a.reason")))
            .drop("__r", "__part", "__refused", "__text", "__a"))


def confidence_gate(df: DataFrame, min_confidence: float = K.MIN_CONFIDENCE) -> DataFrame:
    sure = F.col("openai_confidence") >= min_confidence
    return (df.withColumn("label", F.when(sure, F.col("openai_label")).otherwise(""))
            .withColumn("review_status", F.when(sure, "auto_accepted").otherwise("needs_review")))


def merge_reviews(base: DataFrame, reviewed: DataFrame, with_display_text: bool = True,
                  max_chars: int | None = None) -> DataFrame:
    """Base rows overridden, field by field, by the last review of the same message."""
    latest = keep_one(reviewed, ["message_id"], last=True)
    fields = [c for c in latest.columns if c not in ("seq", "message_id")]
    over = latest.select(F.col("message_id").alias("__id"), F.lit(True).alias("__hit"),
                         *[F.col(f"`{c}`").alias(f"__r_{c}") for c in fields])
    joined = base.join(over, F.col("message_id").eqNullSafe(F.col("__id")), "left")
    columns = [F.coalesce(F.col(f"`__r_{c}`"), F.col(f"`{c}`")).alias(c) if c in fields else F.col(f"`{c}`")
               for c in base.columns]
    columns += [F.col(f"`__r_{c}`").alias(c) for c in fields if c not in base.columns]
    merged = joined.select(*columns)
    if not with_display_text:
        return merged
    source = F.col("text")
    if "training_text" in merged.columns:
        source = F.when(F.col("training_text") != "", F.col("training_text")).otherwise(source)
    return T.strip_reply_noise(merged, source, "display_text", max_chars)


def upsert_reviews(base: DataFrame, reviewed: DataFrame, updates: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Apply (seq, message_id, label, review_status) updates; returns the new reviews and the rejects."""
    known = base.select("message_id").distinct().withColumn("__known", F.lit(True))
    checked = updates.join(known, "message_id", "left").withColumn(
        "reject_reason", F.when(~F.coalesce(F.col("label").isin(K.LABELS), F.lit(False)), "invalid label")
        .when(F.col("__known").isNull(), "message not found")).drop("__known")
    rejected = checked.filter(F.col("reject_reason").isNotNull())
    accepted = keep_one(checked.filter(F.col("reject_reason").isNull()), ["message_id"], last=True)
    current = merge_reviews(keep_one(base, ["message_id"]), reviewed)
    change = accepted.select(F.col("message_id").alias("__id"), F.col("seq").alias("__seq"), F.col("label").alias("__label"),
                             F.coalesce("review_status", F.lit("reviewed")).alias("__status"))
    fresh = (current.join(change, F.col("message_id") == F.col("__id"))
             .withColumn("seq", F.col("__seq")).withColumn("label", F.col("__label"))
             .withColumn("review_status", F.col("__status")).withColumn("review_source", F.lit("manual_ui"))
             .drop("__id", "__seq", "__label", "__status"))
    kept = keep_one(reviewed, ["message_id"], last=True).join(
        change.select(F.col("__id").alias("message_id")), "message_id", "left_anti")
    return kept.unionByName(fresh, allowMissingColumns=True), rejected


def review_queue(df: DataFrame) -> DataFrame:
    """Unreviewed rows, largest template first."""
    pending = F.coalesce(F.col("review_status"), F.lit("")) != "reviewed"
    return df.filter(pending).orderBy(F.desc("template_group_size"), "seq")


def review_progress(df: DataFrame) -> DataFrame:
    return df.agg(F.count_if(F.col("review_status") == "reviewed").alias("reviewed"),
                  F.count(F.lit(1)).alias("total"))


def export_reviewed(df: DataFrame) -> DataFrame:
    return df.filter(F.col("label").isin(K.LABELS))


def _same(keys: Sequence[str]) -> Column:
    return reduce(and_, [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys])


def _raw_with_group(raw: DataFrame, assignments: DataFrame, keys: Sequence[str]) -> DataFrame:
    last_raw = keep_one(raw, list(keys), last=True)
    marks = assignments.select(*[F.col(k).alias(f"__{k}") for k in keys], F.col("template_group_id"),
                               F.col("group_size").cast("int").alias("template_group_size"),
                               "representative_message_id")
    return last_raw.join(marks, _same(keys)).drop(*[f"__{k}" for k in keys])


def expand_labels(raw: DataFrame, assignments: DataFrame, reps: DataFrame, respect_gate: bool = False,
                  keys: Sequence[str] = ("message_id",)) -> DataFrame:
    """Carry each representative's label to every message of its template.

    ``keys`` say which message an assignment means; with ``("account", "message_id")`` mailboxes may share ids.

    By default a label blanked by the confidence gate comes back from ``openai_label``;
    ``respect_gate`` leaves it empty.
    """
    last_rep = keep_one(reps.filter(F.col("template_group_id") != ""), ["template_group_id"], last=True)
    label = F.when(F.col("label") != "", F.col("label"))
    label = F.coalesce(label, F.lit("")) if respect_gate else F.coalesce(
        label, F.when(F.col("openai_label") != "", F.col("openai_label")), F.lit(""))
    rep = (last_rep.withColumn("__label", label)
           .select(F.col("template_group_id").alias("__gid"), "__label",
                   F.coalesce("openai_label", "__label").alias("openai_label"), "openai_confidence", "openai_reason",
                   F.coalesce("review_status", F.lit("propagated")).alias("review_status")))
    carried = [c for c in ("openai_label", "openai_confidence", "openai_reason", "review_status") if c in raw.columns]
    rows = _raw_with_group(raw.drop(*carried), assignments, keys)
    return (rows.join(rep, F.col("template_group_id") == F.col("__gid"))
            .withColumn("label", F.col("__label")).withColumn("label_source", F.lit("template_group"))
            .drop("__gid", "__label"))


def missing_groups(raw: DataFrame, assignments: DataFrame, reps: DataFrame, keys: Sequence[str] = ("message_id",)) -> DataFrame:
    """Groups that have a message but no labelled representative."""
    known = reps.filter(F.col("template_group_id") != "").select("template_group_id").distinct()
    ids = raw.select(*[F.col(k).alias(f"__{k}") for k in keys]).distinct()
    present = assignments.join(ids, _same(keys), "left_semi")
    return present.join(known, "template_group_id", "left_anti").select("template_group_id").distinct()
