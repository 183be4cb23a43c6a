"""Text projections, rules and label names over the mail view and the page table."""

from __future__ import annotations

from pyspark.sql import functions as F

from postsift.functions import text as T
from postsift.plans import fixtures as X
from postsift.plans import oracle_text as O
from postsift.plans.registry import register, with_ctes


def _over_mail(name: str, column: str, sql: str, *ctes: str, source: str = "emails"):
    return register(name, with_ctes(O.EMAILS_CTE, *ctes, select=f"SELECT message_id, {sql} AS {column} FROM {source}"))


@_over_mail("clean_text", "cleaned", O.clean("text"))
def clean_text(spark, sf):
    return T.clean_text(X.emails(spark, sf), "text", "cleaned").select("message_id", "cleaned")


@register("clean_pages_html", f"SELECT page_id, {O.clean('html')} AS cleaned FROM pages")
def clean_pages_html(spark, sf):
    return T.clean_text(X.table(spark, sf, "pages"), "html", "cleaned").select("page_id", "cleaned")


@_over_mail("strip_reply_noise", "stripped", "s_t", O.strip_ctes("s", "emails", "text", 3000), source="s")
def strip_reply_noise(spark, sf):
    return T.strip_reply_noise(X.emails(spark, sf), "text", "stripped").select("message_id", "stripped")


@_over_mail("strip_reply_noise_whole", "stripped", "s_t", O.strip_ctes("s", "emails", "text", None), source="s")
def strip_reply_noise_whole(spark, sf):
    return T.strip_reply_noise(X.emails(spark, sf), "text", "stripped", None).select("message_id", "stripped")


@_over_mail("join_email_fields", "joined_text", O.clean(O.present([*O.HEADERS, ("", "text")])))
def join_email_fields(spark, sf):
    return T.join_email_fields(X.emails(spark, sf)).select("message_id", "joined_text")


def _training_sql(stripped: str | None) -> str:
    return O.clean(O.present([*O.HEADERS, *([("body: ", stripped)] if stripped else [])]))


@_over_mail("training_text", "training_text", _training_sql(None))
def training_text(spark, sf):
    return T.training_text(X.emails(spark, sf), body_chars=0).select("message_id", "training_text")


@_over_mail("training_text_body_300", "training_text", _training_sql("s_t"), O.strip_ctes("s", "emails", "text", 300),
            source="s")
def training_text_body_300(spark, sf):
    return T.training_text(X.emails(spark, sf), body_chars=300).select("message_id", "training_text")


@_over_mail("training_text_full", "training_text", _training_sql("s_t"), O.strip_ctes("s", "emails", "text", None),
            source="s")
def training_text_full(spark, sf):
    return T.training_text(X.emails(spark, sf), body_chars=None).select("message_id", "training_text")


_SCORING = ("concat('subject: ', subject, ' from: ', sender, ' to: ', rcpt, ' snippet: ', snippet, "
            "' ', CASE WHEN {b} <> '' THEN concat('body: ', {b}) ELSE '' END)")


@_over_mail("scoring_text", "scoring_text", O.clean(_SCORING.format(b="text")))
def scoring_text(spark, sf):
    return T.scoring_text(X.emails(spark, sf)).select("message_id", "scoring_text")


@_over_mail("scoring_text_body_300", "scoring_text", O.clean(_SCORING.format(b="s_t")),
            O.strip_ctes("s", "emails", "text", 300), source="s")
def scoring_text_body_300(spark, sf):
    return T.scoring_text(X.emails(spark, sf), body_chars=300).select("message_id", "scoring_text")


@_over_mail("labeller_text", "training_text",
            "concat('subject: ', subject, ' from: ', sender, ' snippet: ', snippet, "
            "CASE WHEN s_t <> '' THEN concat(' ', s_t) ELSE '' END)",
            O.strip_ctes("s", "emails", "text"), source="s")
def labeller_text(spark, sf):
    return T.labeller_text(X.emails(spark, sf)).select("message_id", "training_text")


@_over_mail("normalize_label", "normalized", O.normalize_label("concat(subject, ' & ', account)"))
def normalize_label(spark, sf):
    return X.emails(spark, sf).select("message_id", T.normalize_label(F.concat("subject", F.lit(" & "), "account"))
                                      .alias("normalized"))


@_over_mail("sender_domain", "domain", O.domain_of())
def sender_domain(spark, sf):
    return X.emails(spark, sf).select("message_id", T.sender_domain(F.col("from")).alias("domain"))


@_over_mail("extract_email", "email", O.EMAIL_OF)
def extract_email(spark, sf):
    return X.emails(spark, sf).select("message_id", T.extract_email(F.col("from")).alias("email"))


DISPLAY_NAME = (
    "regexp_replace(trim(regexp_replace(trim(CASE WHEN {e} = '' THEN replace(sender, '<>', '') "
    "ELSE replace(replace(sender, concat('<', {e}, '>'), ''), {e}, '') END), '^\"+|\"+$', '', 'g')), '\\s+', ' ', 'g')"
).format(e=O.EMAIL_OF)


@_over_mail("display_name", "display_name", DISPLAY_NAME)
def display_name(spark, sf):
    return X.emails(spark, sf).select("message_id", T.display_name(F.col("from")).alias("display_name"))


def similarity_ctes(domain: str | None = None) -> tuple[str, ...]:
    return (O.EMAILS_CTE, O.strip_ctes("s", "emails", "text"),
            O.similarity_ctes("sim", "s", "s_t", O.domain_of() if domain is None else O.q(domain)))


@register("similarity_text", with_ctes(*similarity_ctes(), select="SELECT message_id, norm AS similarity_text FROM sim"))
def similarity_text(spark, sf):
    return T.similarity_text(X.emails(spark, sf)).select("message_id", "similarity_text")


TOKENS = "string_split(norm, ' ')"


@register("shingles", with_ctes(
    *similarity_ctes(), f"sh AS (SELECT message_id, {O.shingles(TOKENS)} AS l FROM sim)",
    select="SELECT message_id, unnest(range(0, len(l))) AS pos, unnest(l) AS shingle FROM sh"))
def shingles(spark, sf):
    df = T.similarity_text(X.emails(spark, sf))
    return df.select("message_id", F.posexplode(T.shingles(F.col("similarity_text"))).alias("pos", "shingle"))


@_over_mail("rule_label", "rule_label", O.rule("text"))
def rule_label(spark, sf):
    return T.classify_by_rules(X.emails(spark, sf), "text").select("message_id", "rule_label")
