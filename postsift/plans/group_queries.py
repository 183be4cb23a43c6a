"""Template grouping, labelling of representatives, reviews and expansion."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from postsift import constants as K
from postsift.operators import grouping as G
from postsift.operators import labelling as L
from postsift.operators import simhash as S
from postsift.plans import fixtures as X
from postsift.plans import oracle_text as O
from postsift.plans.registry import register, with_ctes
from postsift.plans.text_queries import TOKENS, similarity_ctes
from postsift.session import cut_lineage

ONE_DOMAIN = "one.example.com"
PROMPT = "Choose one label for the message and answer with JSON only."


def _sig_ctes(domain: str | None) -> tuple[str, ...]:
    h = "('0x' || substring(md5(f), 1, 16))::UBIGINT"
    sums = ", ".join(f"count(*) FILTER (WHERE (({h} >> {k}) & 1) = 1) AS c{k}" for k in range(64))
    bits = " + ".join(f"CASE WHEN 2 * c{k} >= n THEN {1 << k}::UBIGINT ELSE 0::UBIGINT END" for k in range(64))
    subject = "lower(subject)"
    for pattern, repl in ((r"(?i)\b[a-z]{1,10}-\d+\b", "ISSUE"), (r"\b#?\d+\b", "NUM"), (r"\s+", " "), (r"^\s+|\s+$", "")):
        subject = O.sub(subject, pattern, repl)
    return (
        *similarity_ctes(domain),
        f"feats AS (SELECT seq, unnest({O.shingles(TOKENS)}) AS f FROM sim)",
        f"sums AS (SELECT seq, count(*) AS n, {sums} FROM feats GROUP BY seq)",
        f"sig AS (SELECT sim.seq, message_id, dom, substring({subject}, 1, 160) AS tsub, "
        f"md5(array_to_string(list_slice({TOKENS}, 1, 60), ' ')) AS prefix, length(norm) AS norm_len, "
        f"CASE WHEN n IS NULL THEN 0::UBIGINT ELSE {bits} END AS h FROM sim LEFT JOIN sums ON sim.seq = sums.seq)",
    )


_BANDS = " OR ".join(f"((a.h >> {16 * b}) & 65535) = ((b.h >> {16 * b}) & 65535)" for b in range(4))


def _component_ctes(domain: str | None) -> tuple[str, ...]:
    return (
        *_sig_ctes(domain),
        f"linked AS (SELECT a.seq AS u, b.seq AS v FROM sig a JOIN sig b ON a.dom = b.dom AND a.seq <> b.seq AND ("
        f"(a.tsub = b.tsub AND a.prefix = b.prefix) OR (bit_count(xor(a.h, b.h)) <= 6 AND ({_BANDS}))))",
        "reach(node, root) AS (SELECT seq, seq FROM sig UNION SELECT l.v, r.root FROM reach r JOIN linked l ON r.node = l.u)",
        "comp AS (SELECT node AS seq, min(root) AS component FROM reach GROUP BY node)",
        "sized AS (SELECT component, count(*) AS group_size, "
        "arg_min(s.message_id, (CASE WHEN norm_len = 0 THEN 999999 ELSE norm_len END) * 100000000000 + s.seq) AS rep_id "
        "FROM comp JOIN sig s ON comp.seq = s.seq GROUP BY component)",
        "groups AS (SELECT *, 'group_' || lpad(CAST(row_number() OVER (ORDER BY group_size DESC, component) AS VARCHAR), 5, '0') "
        "AS template_group_id FROM sized)",
        "assign AS (SELECT comp.seq, CAST(comp.seq AS VARCHAR) AS message_id, g.template_group_id, g.group_size, "
        "g.rep_id AS representative_message_id FROM comp JOIN groups g ON comp.component = g.component)",
    )


def _domain(one: bool):
    return F.lit(ONE_DOMAIN) if one else None


def _signed(spark, sf, one: bool = False) -> DataFrame:
    return S.signatures(X.emails(spark, sf), domain=_domain(one))


_written: dict[tuple, DataFrame] = {}


def grouped(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Components and groups of the one-domain view, written once per session.

    The pipeline stops here for people and outside labellers, so what follows reads these tables.
    """
    key = (spark.sparkContext.applicationId, sf)
    if key not in _written:
        components = cut_lineage(G.template_components(_signed(spark, sf, True)), "components")
        _written[key] = components, cut_lineage(G.group_table(components), "groups")
    return _written[key]


for _one in (False, True):
    _tag = "_one_domain" if _one else ""
    _dom = ONE_DOMAIN if _one else None

    def _simhash(spark, sf, one=_one):
        return _signed(spark, sf, one).select("message_id", F.lower(F.lpad(F.hex("simhash"), 16, "0")).alias("simhash"))

    register(f"simhash{_tag}", with_ctes(*_sig_ctes(_dom), select=(
        "SELECT message_id, lower(lpad(hex(h), 16, '0')) AS simhash FROM sig")))(_simhash)

    def _exact(spark, sf, one=_one):
        return _signed(spark, sf, one).groupBy("domain", "template_subject", "prefix").agg(
            F.count(F.lit(1)).alias("messages"), F.min("seq").alias("first_seq"))

    register(f"exact_template_groups{_tag}", with_ctes(*_sig_ctes(_dom), select=(
        "SELECT dom AS domain, tsub AS template_subject, prefix, count(*) AS messages, min(seq) AS first_seq "
        "FROM sig GROUP BY ALL")))(_exact)

    def _pairs(spark, sf, one=_one):
        nodes = cut_lineage(G.vertices(_signed(spark, sf, one)), "vertices")
        return G.lsh_pairs(nodes).select("id_a", "id_b", F.col("distance").cast("long").alias("distance"))

    register(f"lsh_pairs{_tag}", with_ctes(
        *_sig_ctes(_dom), "node AS (SELECT dom, h, min(seq) AS id FROM sig GROUP BY ALL)",
        select=f"SELECT a.id AS id_a, b.id AS id_b, CAST(bit_count(xor(a.h, b.h)) AS BIGINT) AS distance FROM node a "
               f"JOIN node b ON a.dom = b.dom AND a.id < b.id WHERE bit_count(xor(a.h, b.h)) <= 6 AND ({_BANDS})"))(_pairs)

    def _components(spark, sf, one=_one):
        return G.template_components(_signed(spark, sf, one)).select("message_id", "component")

    register(f"template_components{_tag}", with_ctes(*_component_ctes(_dom), select=(
        "SELECT CAST(seq AS VARCHAR) AS message_id, component FROM comp")))(_components)

# The second export edits every third body, so that each domain holds variants of its own messages.
_VARIANTS = tuple(c.replace(O.EMAILS_CTE, O.REEXPORT_CTE.replace("mails AS (", "emails AS (", 1)) for c in _sig_ctes(None))


@register("lsh_pairs_variants", with_ctes(
    *_VARIANTS, "node AS (SELECT dom, h, min(seq) AS id FROM sig GROUP BY ALL)",
    select=f"SELECT a.id AS id_a, b.id AS id_b, CAST(bit_count(xor(a.h, b.h)) AS BIGINT) AS distance FROM node a "
           f"JOIN node b ON a.dom = b.dom AND a.id < b.id WHERE bit_count(xor(a.h, b.h)) <= 6 AND ({_BANDS})"))
def lsh_pairs_variants(spark, sf):
    nodes = cut_lineage(G.vertices(S.signatures(X.reexported(spark, sf))), "vertices")
    return G.lsh_pairs(nodes).select("id_a", "id_b", F.col("distance").cast("long").alias("distance"))


GROUPED = _component_ctes(ONE_DOMAIN)


@register("assignments", with_ctes(*GROUPED, select=(
    "SELECT template_group_id, message_id, representative_message_id, group_size FROM assign")))
def assignments(spark, sf):
    return G.assignments(*grouped(spark, sf)).drop("seq").withColumn("group_size", F.col("group_size").cast("long"))


@register("representatives", with_ctes(*GROUPED, select=(
    "SELECT g.template_group_id, g.group_size AS template_group_size, sim.message_id, sim.subject, sim.norm AS similarity_text "
    "FROM groups g JOIN sim ON g.rep_id = sim.message_id")))
def representatives(spark, sf):
    from postsift.functions.text import similarity_text

    reps = G.representatives(X.emails(spark, sf), grouped(spark, sf)[1])
    return similarity_text(reps, domain=F.lit(ONE_DOMAIN)).select(
        "template_group_id", F.col("template_group_size").cast("long").alias("template_group_size"), "message_id",
        "subject", "similarity_text")


@register("group_members", with_ctes(*GROUPED, select=(
    "SELECT template_group_id, CAST(floor(seq / 10000) AS BIGINT) AS chunk, string_agg(message_id, ',' ORDER BY seq) AS message_ids "
    "FROM assign GROUP BY ALL")))
def group_members(spark, sf):
    return G.group_members(*grouped(spark, sf)).withColumn("message_ids", F.array_join("message_ids", ","))


@register("grouping_summary", with_ctes(*GROUPED, select=(
    "SELECT (SELECT count(*) FROM comp) AS input_records, (SELECT count(*) FROM groups) AS representatives, "
    "(SELECT count(*) FROM assign) AS assignments, (SELECT max(group_size) FROM groups) AS largest_group")))
def grouping_summary(spark, sf):
    return G.grouping_summary(grouped(spark, sf)[1]).withColumn("largest_group", F.col("largest_group").cast("long"))


# Representatives with an answer: one account stays unlabelled, and low confidence blanks the label.
_REPS_SQL = ("reps AS (SELECT g.template_group_id, CASE WHEN confidence >= 0.85 THEN lab ELSE '' END AS label, lab AS openai_label, "
             "confidence AS openai_confidence, CASE WHEN confidence >= 0.85 THEN 'auto_accepted' ELSE 'needs_review' END "
             "AS review_status FROM groups g JOIN (SELECT *, CASE WHEN label = '' THEN 'payment' ELSE label END AS lab "
             "FROM emails) e ON g.rep_id = e.message_id WHERE e.account <> 'src3')")


def labelled_representatives(spark, sf) -> DataFrame:
    reps = G.representatives(X.emails(spark, sf), grouped(spark, sf)[1])
    answered = (reps.filter(F.col("account") != "src3")
                .withColumn("openai_label", F.when(F.col("label") == "", "payment").otherwise(F.col("label")))
                .withColumn("openai_confidence", F.col("confidence"))
                .withColumn("openai_reason", F.concat(F.lit("from "), F.col("account"))))
    return L.confidence_gate(answered)


@register("confidence_gate", with_ctes(*GROUPED, _REPS_SQL, select="SELECT * FROM reps"))
def confidence_gate(spark, sf):
    return labelled_representatives(spark, sf).select("template_group_id", "label", "openai_label", "openai_confidence",
                                                      "review_status")


def _expand_select(label: str) -> str:
    return (f"SELECT a.message_id, a.template_group_id, a.group_size AS template_group_size, a.representative_message_id, "
            f"{label} AS label, r.openai_label, r.openai_confidence, r.review_status, 'template_group' AS label_source, e.text "
            f"FROM assign a JOIN (SELECT * FROM mails QUALIFY row_number() OVER (PARTITION BY message_id ORDER BY seq DESC) = 1) e "
            f"ON a.message_id = e.message_id JOIN reps r ON a.template_group_id = r.template_group_id")


def _expand(spark, sf, respect_gate: bool) -> DataFrame:
    marks = G.assignments(*grouped(spark, sf))
    out = L.expand_labels(X.reexported(spark, sf), marks, labelled_representatives(spark, sf), respect_gate)
    return out.select("message_id", "template_group_id", F.col("template_group_size").cast("long").alias("template_group_size"),
                      "representative_message_id", "label", "openai_label", "openai_confidence", "review_status",
                      "label_source", "text")


@register("expand_labels", with_ctes(*GROUPED, _REPS_SQL, O.REEXPORT_CTE, select=_expand_select(
    "CASE WHEN r.label <> '' THEN r.label ELSE r.openai_label END")))
def expand_labels(spark, sf):
    return _expand(spark, sf, False)


@register("expand_labels_gated", with_ctes(*GROUPED, _REPS_SQL, O.REEXPORT_CTE, select=_expand_select("r.label")))
def expand_labels_gated(spark, sf):
    return _expand(spark, sf, True)


@register("missing_groups", with_ctes(*GROUPED, _REPS_SQL, select=(
    "SELECT DISTINCT template_group_id FROM assign WHERE template_group_id NOT IN (SELECT template_group_id FROM reps)")))
def missing_groups(spark, sf):
    return L.missing_groups(X.emails(spark, sf), G.assignments(*grouped(spark, sf)), labelled_representatives(spark, sf))


@register("pending_records", with_ctes(O.EMAILS_CTE, select=(
    "SELECT message_id FROM (SELECT message_id FROM emails WHERE label = '' ORDER BY seq LIMIT 250)")))
def pending_records(spark, sf):
    mail = X.emails(spark, sf)
    return L.pending_records(mail, mail.filter(F.col("label") != ""), 250).select("message_id")


def _request_sql() -> str:
    fields = [("subject", "subject"), ("from", "sender"), ("to", "rcpt"), ("date", "mail_date"), ("snippet", "snippet"),
              ("body", "s_t")]
    parts = " || ',' || ".join(f"'\"{n}\":' || CAST(to_json({v}) AS VARCHAR)" for n, v in fields)
    mail = f"'{{' || {parts} || ',\"gmail_label_names\":' || CAST(to_json(string_split(label_ids_csv, ',')) AS VARCHAR) || '}}'"
    labels = "[" + ",".join(f'"{x}"' for x in K.LABELS) + "]"
    prompt = PROMPT
    head = ('{"model":"small","input":[{"role":"system","content":[{"type":"input_text","text":"' + prompt
            + '"}]},{"role":"user","content":[{"type":"input_text","text":')
    tail = ('}]}],"text":{"format":{"type":"json_schema","name":"email_label","strict":true,"schema":{"type":"object",'
            '"additionalProperties":false,"properties":{"label":{"type":"string","enum":' + labels + '},'
            '"confidence":{"type":"number","minimum":0,"maximum":1},"reason":{"type":"string"}},'
            '"required":["label","confidence","reason"]}}},"max_output_tokens":120}')
    return (f"SELECT message_id, m AS mail_json, concat({O.q(head)}, CAST(to_json(m) AS VARCHAR), {O.q(tail)}) AS request "
            f"FROM (SELECT message_id, {mail} AS m FROM s)")


@register("label_requests", with_ctes(O.EMAILS_CTE, O.strip_ctes("s", "emails", "text"), select=_request_sql()))
def label_requests(spark, sf):
    return L.label_requests(X.emails(spark, sf).withColumn("gmail_label_names", F.col("label_ids")), "small", PROMPT)


_RESPONSES = f"resp AS ({X.duck(X.RESPONSES)})"


@register("label_responses", with_ctes(_RESPONSES, O.EMAILS_CTE, select="""
SELECT e.message_id,
  CASE WHEN k IN (0, 1, 5, 7) THEN lab END AS openai_label,
  CASE WHEN k IN (0, 1, 5, 7) THEN confidence END AS openai_confidence,
  CASE WHEN k IN (0, 1, 5, 7) THEN concat('from ', account) END AS openai_reason,
  CASE k WHEN 2 THEN 'refusal: will not label' WHEN 3 THEN 'invalid label: other' WHEN 4 THEN 'no output text'
         WHEN 6 THEN 'invalid label: none' END AS parse_error
FROM (SELECT *, seq % 8 AS k, CASE WHEN label = '' THEN 'payment' ELSE label END AS lab FROM emails) e
JOIN resp ON resp.message_id = e.message_id"""))
def label_responses(spark, sf):
    return L.parse_label_responses(X.label_responses(spark, sf)).select(
        "message_id", "openai_label", "openai_confidence", "openai_reason", "parse_error")


def _review_base(spark, sf) -> DataFrame:
    sure = F.col("confidence") >= K.MIN_CONFIDENCE
    return (X.emails(spark, sf).withColumn("review_status", F.when(sure, "auto_accepted").otherwise("needs_review"))
            .withColumn("template_group_size", F.length("account") * 10 + F.length("subject")))


def _reviews(spark, sf) -> DataFrame:
    """Two reviews of every labelled message; the second changes the label and has no snippet."""
    second = F.col("seq") >= 10 ** 12
    return (X.reexported(spark, sf).filter(F.col("label") != "")
            .select("seq", "message_id", "subject", F.when(second, "payment").otherwise(F.col("label")).alias("label"),
                    F.when(~second, "draft snippet").alias("snippet"), F.lit("reviewed").alias("review_status")))


_BASE = ("base AS (SELECT *, CASE WHEN confidence >= 0.85 THEN 'auto_accepted' ELSE 'needs_review' END AS status, "
         "length(account) * 10 + length(subject) AS template_group_size FROM emails)")
_MERGED = ("merged AS (SELECT * REPLACE (CASE WHEN label <> '' THEN 'payment' ELSE label END AS label, "
           "CASE WHEN label <> '' THEN 'reviewed' ELSE status END AS status) FROM base)")


@register("merge_reviews", with_ctes(
    O.EMAILS_CTE, _BASE, _MERGED, O.strip_ctes("s", "merged", "text"),
    select="SELECT message_id, label, status AS review_status, snippet, s_t AS display_text FROM s"))
def merge_reviews(spark, sf):
    return L.merge_reviews(_review_base(spark, sf), _reviews(spark, sf)).select(
        "message_id", "label", "review_status", "snippet", "display_text")


# Every message gets an update; one account names unknown messages, another an invalid label.
def _upsert(spark, sf):
    mail = X.emails(spark, sf)
    updates = mail.select(
        (F.col("seq") + 2 * 10 ** 12).alias("seq"),
        F.when(F.col("account") == "src0", F.concat(F.lit("x"), "message_id")).otherwise(F.col("message_id")).alias("message_id"),
        F.when(F.col("account") == "src1", "other").otherwise("done").alias("label"),
        F.lit(None).cast("string").alias("review_status"))
    return L.upsert_reviews(_review_base(spark, sf), _reviews(spark, sf), updates)


@register("upsert_reviews", with_ctes(O.EMAILS_CTE, select="""
SELECT message_id, 'done' AS label, 'reviewed' AS review_status, 'manual_ui' AS review_source
FROM emails WHERE account NOT IN ('src0', 'src1')
UNION ALL
SELECT message_id, 'payment', 'reviewed', NULL FROM emails WHERE account IN ('src0', 'src1') AND label <> ''"""))
def upsert_reviews(spark, sf):
    return _upsert(spark, sf)[0].select("message_id", "label", "review_status", "review_source")


@register("rejected_reviews", with_ctes(O.EMAILS_CTE, select="""
SELECT CASE account WHEN 'src0' THEN concat('x', message_id) ELSE message_id END AS message_id,
       CASE account WHEN 'src0' THEN 'message not found' ELSE 'invalid label' END AS reject_reason
FROM emails WHERE account IN ('src0', 'src1')"""))
def rejected_reviews(spark, sf):
    return _upsert(spark, sf)[1].select("message_id", "reject_reason")


@register("review_queue", with_ctes(O.EMAILS_CTE, _BASE, _MERGED, select=(
    "SELECT message_id, template_group_size FROM merged WHERE status <> 'reviewed'")))
def review_queue(spark, sf):
    merged = L.merge_reviews(_review_base(spark, sf), _reviews(spark, sf), with_display_text=False)
    return L.review_queue(merged).select("message_id", F.col("template_group_size").cast("long").alias("template_group_size"))


@register("review_progress", with_ctes(O.EMAILS_CTE, _BASE, _MERGED, select=(
    "SELECT count(*) FILTER (WHERE status = 'reviewed') AS reviewed, count(*) AS total FROM merged")))
def review_progress(spark, sf):
    return L.review_progress(L.merge_reviews(_review_base(spark, sf), _reviews(spark, sf), with_display_text=False))


@register("export_reviewed", with_ctes(O.EMAILS_CTE, select=(
    "SELECT message_id, label FROM emails WHERE label IN (" + ", ".join(O.q(x) for x in K.LABELS) + ")")))
def export_reviewed(spark, sf):
    return L.export_reviewed(X.emails(spark, sf)).select("message_id", "label")
