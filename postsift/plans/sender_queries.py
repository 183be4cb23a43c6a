"""Sender mining."""

from __future__ import annotations

from pyspark.sql import functions as F

from postsift import constants as K
from postsift.operators import senders as S
from postsift.plans import fixtures as X
from postsift.plans import oracle_text as O
from postsift.plans.registry import register, with_ctes
from postsift.plans.text_queries import DISPLAY_NAME

FOUND = (f"found0 AS (SELECT *, {O.EMAIL_OF} AS email, {DISPLAY_NAME} AS name FROM emails)",
         "found AS (SELECT seq, email, split_part(email, '@', 2) AS domain, name, "
         "CASE WHEN label <> '' THEN label ELSE 'unknown' END AS label, substring(subject, 1, 140) AS subject "
         "FROM found0 WHERE email <> '')")
COUNTS = "counts AS (SELECT email, domain, count(*) AS n FROM found GROUP BY ALL)"
NAMES = ("names AS (SELECT email, arg_max(name, n * 1000000000000 - first_seq) AS display_name FROM "
         "(SELECT email, name, count(*) AS n, min(seq) AS first_seq FROM found WHERE name <> '' GROUP BY ALL) GROUP BY email)")
REASONED = (
    "reasoned AS (SELECT c.email, c.domain, c.n, coalesce(m.display_name, '') AS display_name, "
    + O.first_contained("regexp_replace(split_part(c.email, '@', 1), '[._+]+', '-', 'g')", K.AUTOMATED_LOCAL_WORDS, "local:")
    + " AS r1, " + O.first_contained("lower(coalesce(m.display_name, ''))", K.AUTOMATED_NAME_MARKERS, "name:")
    + " AS r2, " + O.first_contained("c.domain", K.AUTOMATED_DOMAIN_MARKERS, "domain:")
    + " AS r3 FROM counts c LEFT JOIN names m ON c.email = m.email)")
LABELS = ("labels_of AS (SELECT email, '{' || string_agg('\"' || label || '\":' || n, ',' ORDER BY n DESC, f) || '}' AS labels "
          "FROM (SELECT email, label, count(*) AS n, min(seq) AS f FROM found GROUP BY ALL) GROUP BY email)")
SAMPLES = ("samples AS (SELECT email, rn AS position, subject FROM (SELECT *, row_number() OVER (PARTITION BY email "
           "ORDER BY seq) AS rn FROM found) WHERE rn <= 3)")
REASONS = "array_to_string(list_filter([r1, r2, r3], lambda r: r IS NOT NULL), '|')"
BASE = (O.EMAILS_CTE, *FOUND, COUNTS)


@register("sender_counts", with_ctes(*BASE, select="SELECT email, domain, n AS count FROM counts"))
def sender_counts(spark, sf):
    return S.sender_counts(X.emails(spark, sf))


@register("top_domains", with_ctes(*BASE, select=(
    "SELECT domain, count(*) AS count FROM found GROUP BY domain ORDER BY count(*) DESC, min(seq) LIMIT 50")))
def top_domains(spark, sf):
    return S.top_domains(X.emails(spark, sf))


@register("sender_display_name", with_ctes(*BASE, NAMES, select="SELECT email, display_name FROM names"))
def sender_display_name(spark, sf):
    return S.sender_display_names(X.emails(spark, sf))


@register("sender_labels", with_ctes(*BASE, LABELS, select="SELECT email, labels FROM labels_of"))
def sender_labels(spark, sf):
    return S.sender_labels(X.emails(spark, sf))


@register("sender_samples", with_ctes(*BASE, SAMPLES, select="SELECT email, position, subject FROM samples"))
def sender_samples(spark, sf):
    return S.sender_samples(X.emails(spark, sf))


@register("sender_reasons", with_ctes(*BASE, NAMES, REASONED, select=f"SELECT email, {REASONS} AS reasons FROM reasoned"))
def sender_reasons(spark, sf):
    mail = X.emails(spark, sf)
    named = S.sender_counts(mail).join(S.sender_display_names(mail), "email", "left")
    return S.with_reasons(named).select("email", F.array_join("reasons", "|").alias("reasons"))


@register("sender_candidates", with_ctes(*BASE, NAMES, REASONED, LABELS, SAMPLES, select=(
    f"SELECT r.email, r.n AS count, r.display_name, {REASONS} AS reasons, l.labels, s.sample_subjects FROM reasoned r "
    "JOIN labels_of l ON r.email = l.email JOIN (SELECT email, string_agg(subject, '|' ORDER BY position) AS sample_subjects "
    "FROM samples GROUP BY email) s ON r.email = s.email "
    "WHERE r1 IS NOT NULL OR r2 IS NOT NULL OR (r3 IS NOT NULL AND r.n >= 3)")))
def sender_candidates(spark, sf):
    return (S.mine_senders(X.emails(spark, sf))["candidates"]
            .withColumn("reasons", F.array_join("reasons", "|"))
            .withColumn("sample_subjects", F.array_join("sample_subjects", "|")))


@register("domain_candidates", with_ctes(*BASE, select=(
    "SELECT domain, count(*) AS count FROM found GROUP BY domain HAVING count(*) >= 3 AND "
    + O.first_contained("domain", K.AUTOMATED_DOMAIN_MARKERS) + " IS NOT NULL")))
def domain_candidates(spark, sf):
    return S.mine_senders(X.emails(spark, sf))["domain_candidates"]


@register("sender_totals", with_ctes(*BASE, select=(
    "SELECT (SELECT count(*) FROM emails) AS records, count(*) AS unique_senders, "
    "count(DISTINCT domain) AS unique_domains FROM counts")))
def sender_totals(spark, sf):
    return S.mine_senders(X.emails(spark, sf))["totals"]
