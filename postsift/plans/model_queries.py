"""Features, model training with held-out evaluation, scoring, and the streaming path."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postsift.functions import text as T
from postsift.functions.arrays import l2_normalize as l2_normalized
from postsift.operators import features as FE
from postsift.operators import models as ML
from postsift.operators import scoring as C
from postsift.operators.rows import stratified_split
from postsift.plans import fixtures as X
from postsift.plans import oracle_text as O
from postsift.plans.registry import register, with_ctes
from postsift.plans.row_queries import SPLIT_CTES
from postsift.plans.score_queries import GATE_CTES, OWNER, blocked_senders
from postsift.plans.sender_queries import BASE, LABELS, NAMES, REASONED, SAMPLES
from postsift.session import cut_lineage, scratch_path, write_stage
from postsift.streaming import mail_stream as ST

_PLAIN = f"plain AS (SELECT seq, strip_accents(lower({O.clean(O.present([*O.HEADERS, ('', 'text')]))})) AS p FROM emails)"
_WORDS = (_PLAIN, "toks AS (SELECT seq, regexp_extract_all(p, '[\\p{L}\\p{N}_]{2,}') AS t FROM plain)",
          "terms AS (SELECT seq, unnest(list_concat(t, list_transform(range(1, len(t)), lambda i: t[i] || ' ' || t[i + 1]))) AS term FROM toks)")
_CHARS = (_PLAIN, "words AS (SELECT seq, ' ' || unnest(string_split(p, ' ')) || ' ' AS w FROM plain)",
          "terms AS (SELECT seq, unnest(flatten(list_transform([3, 4, 5], lambda n: list_transform(range(1, length(w) - n + 2), "
          "lambda i: substring(w, i, n))))) AS term FROM words WHERE length(w) > 2)")
_WEIGHTS = (
    "tf AS (SELECT seq, term, count(*) AS tf FROM terms GROUP BY ALL)",
    "vocab AS (SELECT term, count(*) AS df, ln((1.0 + (SELECT count(*) FROM emails)) / (1.0 + count(*))) + 1 AS idf FROM tf "
    "GROUP BY term HAVING count(*) >= 2 ORDER BY sum(tf) DESC, term LIMIT 120000)",
    "w AS (SELECT seq, term, df, (ln(tf) + 1) * idf AS x FROM tf JOIN vocab USING (term))",
    "weights AS (SELECT seq, term, df, x / sqrt(sum(x * x) OVER (PARTITION BY seq)) AS weight FROM w)")
_BY_TERM = ("SELECT term, count(*) AS messages, round(sum(weight), 6) AS total_weight, round(max(weight), 6) AS top_weight "
            "FROM weights GROUP BY term")


def _by_term(weights: DataFrame) -> DataFrame:
    return weights.groupBy("term").agg(F.count(F.lit(1)).alias("messages"), F.round(F.sum("weight"), 6).alias("total_weight"),
                                       F.round(F.max("weight"), 6).alias("top_weight"))


@register("word_tfidf", with_ctes(O.EMAILS_CTE, *_WORDS, *_WEIGHTS, select=_BY_TERM))
def word_tfidf(spark, sf):
    mail = X.emails(spark, sf)
    return _by_term(FE.word_tfidf(T.join_email_fields(mail), "joined_text", n_docs=mail.count()))


@register("char_tfidf", with_ctes(O.EMAILS_CTE, *_CHARS, *_WEIGHTS, select=_BY_TERM))
def char_tfidf(spark, sf):
    mail = X.emails(spark, sf)
    return _by_term(FE.char_tfidf(T.join_email_fields(mail), "joined_text", n_docs=mail.count()))


@register("l2_normalize", """
WITH x AS (SELECT vec_id, unnest(range(0, len(embedding))) AS pos, unnest(embedding)::DOUBLE AS v FROM embeddings)
SELECT vec_id, pos, round(v / sqrt(sum(v * v) OVER (PARTITION BY vec_id)), 6) AS value FROM x""")
def l2_normalize(spark, sf):
    return X.table(spark, sf, "embeddings").select("vec_id", F.posexplode(l2_normalized(F.col("embedding"))).alias("pos", "v")
                                                   ).select("vec_id", F.col("pos").cast("long").alias("pos"), F.round("v", 6).alias("value"))


SCORED_CTE = ("scored AS (SELECT *, " + O.clean(
    "concat('subject: ', subject, ' from: ', sender, ' to: ', rcpt, ' snippet: ', snippet, ' ', "
    "CASE WHEN text <> '' THEN concat('body: ', text) ELSE '' END)") + " AS scoring FROM emails)")


def _cleaned(mail: DataFrame) -> DataFrame:
    """Mail with its training text over whole bodies, cleaned once for all that read it."""
    return cut_lineage(T.training_text(mail, body_chars=None).select("seq", "account", "message_id", "label", "training_text"), "cleaned")


def _split(spark, sf, cleaned: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Training and validation rows, over whole bodies; without ``cleaned`` mail, only what has a label is cleaned."""
    cleaned = _cleaned(ML.labelled_only(X.emails(spark, sf))) if cleaned is None else cleaned
    usable = ML.examples(cleaned, "training_text")
    rows = cut_lineage(stratified_split(usable).select("seq", "account", "message_id", "label", "training_text", "split"), "split")
    return rows.filter(F.col("split") == "train"), rows.filter(F.col("split") == "valid")


def _evaluated(model: ML.Classifier, train: DataFrame, valid: DataFrame, text: str = "training_text") -> DataFrame:
    """(label, train_rows, support, in_range): what a converged model's probabilities, and its report, must add up to."""
    mass = model.class_mass(train, text).select(F.col("label").alias("__l"), F.round("mass").cast("long").alias("train_rows"))
    report = C.classification_report(model.predict(valid, text), labels=train.select("label"))
    good = F.lit(True)
    for score in ("precision", "recall", "f1"):
        good = good & F.col(score).between(0, 1)
    return mass.join(report, F.col("label") == F.col("__l")).select(
        "label", "train_rows", F.col("support").cast("long").alias("support"), good.alias("in_range"))


_EVALUATED = ("SELECT label, count(*) FILTER (WHERE split = 'train') AS train_rows, count(*) FILTER (WHERE split = 'valid') AS support, "
              "true AS in_range FROM split GROUP BY label")
_MAIL_EVALUATED = with_ctes(O.EMAILS_CTE, *SPLIT_CTES, select=_EVALUATED)


# Every message is exported twice, a third of the second bodies edited: the first of each is the example.
@register("trainer_examples", with_ctes(O.EMAILS_CTE, select=(
    "SELECT account, message_id, label, md5(text) AS text_md5 FROM emails WHERE label <> ''")))
def trainer_examples(spark, sf):
    found = ML.examples(X.reexported(spark, sf), "text")
    return found.select("account", "message_id", "label", F.md5("text").alias("text_md5"))


@register("train_tfidf_eval", _MAIL_EVALUATED)
def train_tfidf_eval(spark, sf):
    train, valid = _split(spark, sf)
    return _evaluated(ML.train_tfidf(train), train, valid)


@register("train_ngram_eval", _MAIL_EVALUATED)
def train_ngram_eval(spark, sf):
    train, valid = _split(spark, sf)
    return _evaluated(ML.train_ngram(train), train, valid)


@register("train_ngram_ova_eval", _MAIL_EVALUATED)
def train_ngram_ova_eval(spark, sf):
    train, valid = _split(spark, sf)
    return _evaluated(ML.train_ngram(train, loss="ova"), train, valid)


@register("train_embedding_eval", """WITH split AS (SELECT CAST(label AS VARCHAR) AS label, CASE WHEN row_number() OVER (
PARTITION BY label ORDER BY md5(concat('7|', vec_id)), vec_id) <= CASE WHEN count(*) OVER (PARTITION BY label) > 1 THEN greatest(1,
round_even(count(*) OVER (PARTITION BY label) * 0.15, 0)) ELSE 0 END THEN 'valid' ELSE 'train' END AS split FROM embeddings)
""" + _EVALUATED)
def train_embedding_eval(spark, sf):
    vectors = X.table(spark, sf, "embeddings").select("vec_id", F.col("label").cast("string").alias("label"), "embedding")
    rows = cut_lineage(stratified_split(vectors, key="vec_id", order="vec_id"), "split")
    train, valid = rows.filter(F.col("split") == "train"), rows.filter(F.col("split") == "valid")
    return _evaluated(ML.train_embedding(train, keys=()), train, valid, "embedding")


# The scored rows are checked for what any model must give: known labels, falling confidences, all messages.
_RANKS = "least(3, (SELECT count(DISTINCT label) FROM emails WHERE label <> ''))"


def _checked_topk(scored: DataFrame, labels: list[str]) -> DataFrame:
    pairs = F.transform("candidates", lambda c, i: F.struct(
        (i + 1).cast("long").alias("rank"),
        (c["label"].isin(labels) & c["confidence"].between(0, 1)
         & F.coalesce(c["confidence"] <= F.get("candidates", i - 1)["confidence"], F.lit(True))).alias("valid")))
    return scored.select("message_id", F.explode(pairs).alias("c")).select("message_id", "c.rank", "c.valid")


_TOPK = with_ctes(O.EMAILS_CTE, select=f"SELECT message_id, unnest(range(1, {_RANKS} + 1)) AS rank, true AS valid FROM emails")


def _score(spark, sf, train) -> DataFrame:
    mail = _cleaned(X.emails(spark, sf))
    model = train(_split(spark, sf, mail)[0])
    return _checked_topk(model.candidates(mail.select("seq", "message_id", "training_text")), model.labels)


@register("score_topk", _TOPK)
def score_topk(spark, sf):
    return _score(spark, sf, ML.train_ngram)


@register("score_topk_tfidf", _TOPK)
def score_topk_tfidf(spark, sf):
    return _score(spark, sf, ML.train_tfidf)


def _reloaded(spark, model: ML.Classifier) -> ML.Classifier:
    path = scratch_path(spark, "model")
    model.save(spark, path)
    return ML.load_classifier(spark, path)


def _same(spark, model: ML.Classifier, rows: DataFrame, text: str, key: str) -> DataFrame:
    again = _reloaded(spark, model).candidates(rows, text).select(F.col(key).alias("__k"), F.col("candidates").alias("__c"))
    close = lambda a, b: (a["label"] == b["label"]) & (F.abs(a["confidence"] - b["confidence"]) < 1e-9)
    return model.candidates(rows, text).join(again, F.col(key) == F.col("__k")).select(
        key, F.forall(F.zip_with("candidates", "__c", close), lambda same: same).alias("same"))


@register("saved_ngram_model", with_ctes(O.EMAILS_CTE, select="SELECT message_id, true AS same FROM emails"))
def saved_ngram_model(spark, sf):
    mail = _cleaned(X.emails(spark, sf))
    model = ML.train_ngram(_split(spark, sf, mail)[0], loss="ova")
    return _same(spark, model, mail.select("message_id", "training_text"), "training_text", "message_id")


@register("saved_tfidf_model", with_ctes(O.EMAILS_CTE, *SPLIT_CTES, select="SELECT message_id, true AS same FROM split WHERE split = 'valid'"))
def saved_tfidf_model(spark, sf):
    train, valid = _split(spark, sf)
    return _same(spark, ML.train_tfidf(train), valid, "training_text", "message_id")


@register("saved_embedding_model", "SELECT vec_id, true AS same FROM embeddings")
def saved_embedding_model(spark, sf):
    vectors = X.table(spark, sf, "embeddings").select("vec_id", F.col("label").cast("string").alias("label"), "embedding")
    return _same(spark, ML.train_embedding(vectors, keys=()), vectors, "embedding", "vec_id")


def _ngram_candidates(spark, sf):
    """Scores with a model that was saved and loaded, as a daily job does."""
    model = _reloaded(spark, ML.train_ngram(_split(spark, sf)[0]))
    return lambda df: model.candidates(T.scoring_text(df, "scoring_text"), "scoring_text"), model.labels


# A rule decides exactly; where the model does, its label must be a known one with a fair confidence.
_GUARDED = ("SELECT message_id, coalesce(rule, 'model') AS decision, CASE WHEN rule IS NOT NULL THEN CAST(0.99 AS DOUBLE) END AS rule_confidence, "
            "true AS valid FROM (SELECT message_id, {rule} AS rule FROM {source}) r")


def _checked_guard(df: DataFrame, labels: list[str], *more: str) -> DataFrame:
    ruled = F.col("rule").isNotNull()
    return df.select("message_id", F.when(ruled, F.col("label")).otherwise("model").alias("decision"),
                     F.when(ruled, F.col("confidence")).alias("rule_confidence"),
                     (ruled | (F.col("label").isin(labels) & F.col("confidence").between(0, 1))).alias("valid"), *more)


@register("classify_guarded", with_ctes(O.EMAILS_CTE, SCORED_CTE, select=_GUARDED.format(rule=O.rule("scoring"), source="scored")))
def classify_guarded(spark, sf):
    candidates, labels = _ngram_candidates(spark, sf)
    decided = C.guard_with_rules(candidates(X.emails(spark, sf)), F.col("candidates"))
    return _checked_guard(T.classify_by_rules(decided, "scoring_text", "rule"), labels)


def _mail_stream(spark, sf) -> DataFrame:
    """The mail view as a folder of files that a stream picks up."""
    landed = cut_lineage(X.emails(spark, sf), "landing")
    return ST.read_stream(spark, landed.inputFiles()[0].rsplit("/", 1)[0], landed.schema)


@register("stream_classify", with_ctes(O.EMAILS_CTE, SCORED_CTE, select=(
    _GUARDED.format(rule=O.rule("scoring"), source="scored").replace("true AS valid", "true AS valid, true AS gated"))))
def stream_classify(spark, sf):
    out, state = scratch_path(spark, "classified"), scratch_path(spark, "state")
    candidates, labels = _ngram_candidates(spark, sf)
    blocked = cut_lineage(blocked_senders(X.emails(spark, sf)), "blocked")

    def decided(batch: DataFrame) -> DataFrame:
        gated = ST.classify(candidates(batch), OWNER, blocked)
        fits = F.col("mailbox_label").eqNullSafe(C.mailbox_label(F.col("label"))) & (
            F.col("should_auto_draft") == F.col("draft_block_reason").isNull())
        return _checked_guard(T.classify_by_rules(gated.withColumn("gated", fits), "scoring_text", "rule"), labels, "gated")

    ST.append_batches(_mail_stream(spark, sf), decided, out, state)
    return spark.read.parquet(out).drop("batch")


_STREAM_GATE = tuple(c.replace(f"coalesce({O.rule('text')}, label) AS decided FROM emails",
                               f"coalesce({O.rule('scoring')}, 'misc') AS decided FROM scored") for c in GATE_CTES)


@register("stream_rules_gate", with_ctes(*BASE, NAMES, REASONED, LABELS, SAMPLES, SCORED_CTE, *_STREAM_GATE, select=(
    "SELECT message_id, decided AS label, reason AS draft_block_reason, reason IS NULL AS should_auto_draft FROM gated")))
def stream_rules_gate(spark, sf):
    out, state = scratch_path(spark, "gated"), scratch_path(spark, "state")
    blocked = cut_lineage(blocked_senders(X.emails(spark, sf)), "blocked")
    decided = ST.classify(_mail_stream(spark, sf), OWNER, blocked)
    ST.append_stream(decided.select("message_id", "label", "draft_block_reason", "should_auto_draft"), out, state)
    return spark.read.parquet(out)


@register("stream_dedupe", """
SELECT DISTINCT event_type AS account, CAST(user_id AS VARCHAR) AS message_id, CAST(NULL AS VARCHAR) AS row FROM events WHERE user_id % 50 <> 0
UNION ALL SELECT event_type, NULL, CAST(event_id AS VARCHAR) FROM events WHERE user_id % 50 = 0""")
def stream_dedupe(spark, sf):
    """Some events have no id: all of them pass, and ``row`` tells them apart."""
    out, state = scratch_path(spark, "deduped"), scratch_path(spark, "state")
    missing = F.col("user_id") % 50 == 0
    # Four files, one per micro-batch, dealt by a hash: old dates come late and keys recur in later batches.
    events = X.table(spark, sf, "events").select(
        F.col("event_type").alias("account"), F.when(~missing, F.col("user_id").cast("string")).alias("message_id"),
        F.when(missing, F.col("event_id").cast("string")).alias("row"))
    landed, folder = write_stage(events.repartition(4, F.xxhash64("account", "message_id", "row")), "events")
    ST.append_unseen(ST.read_stream(spark, folder, landed.schema, max_files=1), out, state)
    return spark.read.parquet(out).select("account", "message_id", "row")


@register("stream_row_parity", with_ctes(O.EMAILS_CTE, select=(
    "SELECT account, count(*) AS rows_in, count(*) AS rows_out, count(*) FILTER (WHERE mailbox IS NOT NULL) AS mapped FROM "
    f"(SELECT account, {O.rule('text')} AS mailbox FROM emails) GROUP BY account")))
def stream_row_parity(spark, sf):
    out, state = scratch_path(spark, "mapped"), scratch_path(spark, "state")
    mapped = T.classify_by_rules(_mail_stream(spark, sf), "text", "label")
    ST.append_stream(mapped.select("message_id", "account", C.mailbox_label(F.col("label")).alias("mailbox_label")), out, state)
    incoming = X.emails(spark, sf).groupBy("account").agg(F.count(F.lit(1)).alias("rows_in"))
    outgoing = spark.read.parquet(out).groupBy(F.col("account").alias("__a")).agg(
        F.count(F.lit(1)).alias("rows_out"), F.count("mailbox_label").alias("mapped"))
    return incoming.join(outgoing, F.col("account") == F.col("__a"), "left").drop("__a")
