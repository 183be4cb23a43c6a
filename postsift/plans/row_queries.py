"""Sources, deduplication, splitting and oversampling."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postsift import constants as K
from postsift.functions import text as T
from postsift.operators import labelling as L
from postsift.operators import rows as R
from postsift.plans import fixtures as X
from postsift.plans import oracle_text as O
from postsift.plans.registry import register, with_ctes
from postsift.schemas import raw_message
from postsift.session import scratch_path
from postsift.sources import mail as M

THREADS_CTE = f"threads AS ({X.duck(X.THREAD_MAIL)})"


@register("scan_emails", with_ctes(O.EMAILS_CTE, select=(
    "SELECT message_id, account, subject, sender, internal_date, md5(text) AS text_md5, label, label_ids_csv, "
    "CASE WHEN seq % 2 = 0 THEN concat('{\"importance\":', seq % 5, ',\"read\":true}') END AS extra_fields FROM emails")))
def scan_emails(spark, sf):
    """Half of the messages hold fields that the schema does not know; they are written and read again with the rest."""
    path = scratch_path(spark, "scan")
    more = F.concat(F.lit('{"importance":'), (F.col("seq") % 5).cast("string"), F.lit(',"read":true}'))
    M.write_jsonl(X.emails(spark, sf).withColumn(M.EXTRA, F.when(F.col("seq") % 2 == 0, more)).drop("seq", "confidence"), path)
    return M.read_emails(spark, [path]).select(
        "message_id", "account", "subject", F.col("from").alias("sender"), "internal_date", F.md5("text").alias("text_md5"),
        "label", F.array_join("label_ids", ",").alias("label_ids_csv"), M.EXTRA)


# Mail in id order, in two folders; the later ids are the second folder's.
_NUMBERED = ("SELECT message_id, (row_number() OVER (PARTITION BY later ORDER BY seq) - 1) AS line, later AS folder FROM "
             "(SELECT *, CASE WHEN seq % 3 = 0 THEN 1 ELSE 0 END AS later FROM emails) e")


@register("line_numbers", with_ctes(O.EMAILS_CTE, select=_NUMBERED))
def line_numbers(spark, sf):
    """Numbers kept by a manifest: the second folder is listed after the first is numbered, and comes first by name."""
    base = scratch_path(spark, "numbered")
    mail = X.emails(spark, sf).select("seq", "message_id")
    for folder, rows in ((f"{base}/z", F.col("seq") % 3 != 0), (f"{base}/a", F.col("seq") % 3 == 0)):
        ordered = mail.filter(rows).repartition(1).sortWithinPartitions("seq")
        ordered.select(F.to_json(F.struct("message_id")).alias("value")).write.text(folder)
        found = M.read_emails(spark, [f"{base}/z"] if folder.endswith("z") else [f"{base}/a", f"{base}/z"], manifest=f"{base}/manifest")
    return found.select("message_id", F.col("seq").bitwiseAND(F.lit((1 << M.LINE_BITS) - 1)).alias("line"),
                        F.shiftright("seq", M.LINE_BITS).alias("folder"))


@register("existing_ids", with_ctes(THREADS_CTE, select="SELECT DISTINCT message_id FROM threads WHERE message_id <> ''"))
def existing_ids(spark, sf):
    return L.existing_ids(X.thread_mail(spark, sf))


# Three MIME shapes: nested plain parts, HTML only, and plain beside HTML; leaves lie 2, 6 and 9 levels deep.
def _raw(spark, sf) -> DataFrame:
    def coded(c):
        return F.translate(F.regexp_replace(F.base64(F.encode(c, "UTF-8")), "[\r\n=]", ""), "+/", "-_")

    def nested(kind, c):
        leaf = F.to_json(F.struct(F.lit(kind).alias("mimeType"), F.struct(coded(c).alias("data")).alias("body")))
        levels = F.element_at(F.array(F.lit(1), F.lit(5), F.lit(8)), (F.col("seq") % 5 % 3 + 1).cast("int"))
        return F.concat(F.repeat(F.lit('{"mimeType":"multipart/related","parts":['), levels), leaf, F.repeat(F.lit("]}"), levels))

    mail = X.emails(spark, sf)
    plain2 = F.concat_ws(",", nested("text/plain", F.col("snippet")), nested("text/html", F.col("subject")), nested("text/plain", F.col("text")))
    html = nested("text/html", F.col("text"))
    both = F.concat_ws(",", nested("text/html", F.col("subject")), nested("text/plain", F.col("text")))
    parts = F.when(F.col("seq") % 3 == 0, plain2).when(F.col("seq") % 3 == 1, html).otherwise(both)

    def header(name, value):
        return F.struct(F.lit(name).alias("name"), value.alias("value"))

    headers = F.array(header("SUBJECT", F.col("subject")), header("From", F.col("from")), header("from", F.lit("second")),
                      header("To", F.col("to")))
    payload = F.concat(F.lit('{"headers":'), F.to_json(headers), F.lit(',"mimeType":"multipart/mixed","parts":['), parts, F.lit("]}"))
    return mail.select(
        "seq", F.col("message_id").alias("id"), F.col("thread_id").alias("threadId"), F.col("label_ids").alias("labelIds"),
        F.col("internal_date").alias("internalDate"), "snippet",
        F.from_json(payload, raw_message(M.PART_DEPTH)["payload"].dataType).alias("payload"))


@register("flatten_messages", with_ctes(O.EMAILS_CTE, select=(
    "SELECT message_id, thread_id, subject, sender, rcpt, '' AS cc, " + O.clean("snippet") + " AS snippet, "
    + O.clean("CASE WHEN seq % 3 = 0 THEN concat(snippet, chr(10), text) ELSE text END") + " AS text, "
    "'action_needed' AS label FROM emails")))
def flatten_messages(spark, sf):
    flat = M.flatten_messages(_raw(spark, sf), "office", "Action Needed")
    return flat.select("message_id", "thread_id", "subject", F.col("from").alias("sender"), F.col("to").alias("rcpt"), "cc",
                       "snippet", "text", "label")


# The mailbox's labels are the ids its messages carry; system labels have no name of their own.
_MAILBOX = ("ids AS (SELECT seq, message_id, unnest(string_split(label_ids_csv, ',')) AS label_id, "
            "unnest(range(0, len(string_split(label_ids_csv, ',')))) AS pos FROM emails), "
            "mailbox AS (SELECT DISTINCT label_id, CASE label_id WHEN 'L_ready' THEN 'AI/draft ready' ELSE "
            "upper(replace(substring(label_id, 3), '_', ' ')) END AS name FROM ids WHERE starts_with(label_id, 'L_'))")


def _mailbox(mail: DataFrame) -> DataFrame:
    ids = mail.select(F.explode("label_ids").alias("label_id")).distinct().filter(F.startswith("label_id", F.lit("L_")))
    name = F.upper(F.replace(F.substring("label_id", 3, 100), F.lit("_"), F.lit(" ")))
    return ids.withColumn("name", F.when(F.col("label_id") == "L_ready", K.DRAFT_READY_LABEL).otherwise(name))


# Half of the accounts name the labels otherwise, and one id is unknown to the other half.
_OTHER = "(account IN ('src1', 'src3', 'src5', 'src7', 'src9', 'src11', 'src13', 'src15', 'src17', 'src19'))"


def mailbox_labels(mail: DataFrame) -> DataFrame:
    """(account, label_id, name): the labels that an account's messages carry, each mailbox with its own rows."""
    carried = mail.select("account", F.explode("label_ids").alias("label_id")).distinct()
    names = _mailbox(mail).withColumnRenamed("label_id", "__id")
    return carried.join(names, F.col("label_id") == F.col("__id")).drop("__id")


def _account_labels(mail: DataFrame) -> DataFrame:
    named = mailbox_labels(mail)
    other = F.expr(_OTHER)
    return named.withColumn("name", F.when(other, F.concat(F.col("name"), F.lit(" 2"))).otherwise(F.col("name"))).filter(
        other | (F.col("label_id") != "L_ready"))


@register("map_label_names", with_ctes(O.EMAILS_CTE, _MAILBOX, select=(
    "SELECT i.message_id, string_agg(CASE WHEN m.name IS NULL THEN i.label_id "
    f"WHEN {_OTHER} THEN m.name || ' 2' WHEN i.label_id = 'L_ready' THEN i.label_id ELSE m.name END, '|' ORDER BY i.pos) "
    "AS gmail_label_names FROM ids i JOIN emails e ON e.seq = i.seq LEFT JOIN mailbox m ON i.label_id = m.label_id GROUP BY i.message_id")))
def map_label_names(spark, sf):
    mail = X.emails(spark, sf)
    return M.map_label_names(mail, _account_labels(mail)).select("message_id", F.array_join("gmail_label_names", "|").alias("gmail_label_names"))


def _dictionary_sql() -> str:
    rows = ", ".join(f"({O.q(label)}, {O.q(alias)}, {i})" for label, aliases in K.LABEL_ALIASES.items()
                     for i, alias in enumerate([label, *aliases]))
    return f"dict(canonical, alias, priority) AS (VALUES {rows})"


_RESOLVED = ("resolved AS (SELECT canonical, arg_min(label_id, priority) AS label_id FROM dict JOIN mailbox "
             "ON lower(alias) = lower(name) GROUP BY canonical)")
_LABELS = (O.EMAILS_CTE, _MAILBOX, _dictionary_sql(), _RESOLVED)


@register("resolve_labels", with_ctes(*_LABELS, select="SELECT canonical, label_id FROM resolved"))
def resolve_labels(spark, sf):
    return M.resolve_labels(M.label_dictionary(spark), _mailbox(X.emails(spark, sf)))


@register("missing_labels", with_ctes(*_LABELS, select=(
    "SELECT DISTINCT canonical FROM dict WHERE canonical NOT IN (SELECT canonical FROM resolved)")))
def missing_labels(spark, sf):
    return M.missing_labels(M.label_dictionary(spark), _mailbox(X.emails(spark, sf)))


@register("extract_by_label", with_ctes(*_LABELS, select=(
    "SELECT canonical AS label, message_id FROM ids JOIN resolved ON ids.label_id = resolved.label_id "
    "QUALIFY row_number() OVER (PARTITION BY canonical ORDER BY seq) <= 20")))
def extract_by_label(spark, sf):
    mail = X.emails(spark, sf)
    return M.extract_by_label(mail, M.resolve_labels(M.label_dictionary(spark), _mailbox(mail)), 20).select("label", "message_id")


@register("extract_by_label_all", with_ctes(*_LABELS, select=(
    "SELECT canonical AS label, message_id FROM ids JOIN resolved ON ids.label_id = resolved.label_id")))
def extract_by_label_all(spark, sf):
    mail = X.emails(spark, sf)
    return M.extract_by_label(mail, M.resolve_labels(M.label_dictionary(spark), _mailbox(mail))).select("label", "message_id")


# Both halves of a two-account export use the same ids; one account's mail is stored.
_TWO = ("two AS (SELECT message_id, 'old' AS account, seq FROM emails WHERE label <> '' UNION ALL "
        "SELECT message_id, 'new', seq FROM emails)")


@register("append_new_accounts", with_ctes(O.EMAILS_CTE, _TWO, select=(
    "SELECT account, message_id FROM two WHERE NOT (account = 'old')")))
def append_new_accounts(spark, sf):
    mail, keys = X.emails(spark, sf), ["account", "message_id"]
    old = mail.filter(F.col("label") != "").withColumn("account", F.lit("old"))
    both = old.unionByName(mail.withColumn("account", F.lit("new")))
    return M.append_new(both, L.existing_ids(old, keys), keys=keys).select(*keys)


@register("append_new", with_ctes(O.EMAILS_CTE, select="SELECT message_id, subject FROM emails WHERE label = ''"))
def append_new(spark, sf):
    mail = X.emails(spark, sf)
    return M.append_new(mail, L.existing_ids(mail.filter(F.col("label") != ""))).select("message_id", "subject")


def _line_sql(text: str) -> str:
    return (f"SELECT seq, concat('__label__', {O.normalize_label('label')}, ' ', {text}) AS value FROM emails "
            f"WHERE label <> '' AND {text} <> ''")


@register("training_lines", with_ctes(O.EMAILS_CTE, select=_line_sql(O.clean(O.present(O.HEADERS)))))
def training_lines(spark, sf):
    return R.training_lines(X.emails(spark, sf))


@register("training_lines_body", with_ctes(O.EMAILS_CTE, select=_line_sql(O.clean(O.present([*O.HEADERS, ("", "text")])))))
def training_lines_body(spark, sf):
    return R.training_lines(X.emails(spark, sf), include_body=True)


@register("labelled_only", with_ctes(THREADS_CTE, select=(
    f"SELECT seq, {O.normalize_label('label')} AS label FROM threads WHERE {O.normalize_label('label')} <> ''")))
def labelled_only(spark, sf):
    return R.labelled_only(X.thread_mail(spark, sf)).select("seq", "label")


@register("dedupe_key", with_ctes(THREADS_CTE, select=(
    f"SELECT account, message_id, {O.normalize_label('label')} AS label, text FROM threads WHERE {O.normalize_label('label')} <> '' "
    "QUALIFY row_number() OVER (PARTITION BY account, message_id ORDER BY seq) = 1")))
def dedupe_key(spark, sf):
    return R.dedupe_key(X.thread_mail(spark, sf)).select("account", "message_id", "label", "text")


@register("dedupe_content", with_ctes(O.REEXPORT_CTE, select=(
    "SELECT seq, account, message_id FROM mails QUALIFY row_number() OVER (PARTITION BY account, message_id, "
    + O.clean(O.present([*O.HEADERS, ("", "text")])) + " ORDER BY seq) = 1")))
def dedupe_content(spark, sf):
    return R.dedupe_content(X.reexported(spark, sf)).select("seq", "account", "message_id")


SPLIT_CTES = ("labelled AS (SELECT * FROM emails WHERE label <> '')",
          "split AS (SELECT seq, message_id, label, CASE WHEN row_number() OVER (PARTITION BY label "
          "ORDER BY md5(concat('7|', message_id)), seq) <= CASE WHEN count(*) OVER (PARTITION BY label) > 1 THEN greatest(1, "
          "round_even(count(*) OVER (PARTITION BY label) * 0.15, 0)) ELSE 0 END THEN 'valid' ELSE 'train' END AS split FROM labelled)")


def split_mail(spark, sf) -> DataFrame:
    return R.stratified_split(R.labelled_only(X.emails(spark, sf)))


@register("stratified_split", with_ctes(O.EMAILS_CTE, *SPLIT_CTES, select="SELECT message_id, label, split FROM split"))
def stratified_split(spark, sf):
    return split_mail(spark, sf).select("message_id", "label", "split")


@register("split_sizes", with_ctes(O.EMAILS_CTE, *SPLIT_CTES, select=(
    "SELECT label, count(*) AS n, count(*) FILTER (WHERE split = 'valid') AS valid_rows, "
    "count(*) FILTER (WHERE split = 'train') AS train_rows FROM split GROUP BY label")))
def split_sizes(spark, sf):
    return R.split_sizes(R.labelled_only(X.emails(spark, sf)).groupBy("label").agg(F.count(F.lit(1)).alias("n")))


MIN_PER_LABEL = 50
_OVER = (O.EMAILS_CTE, *SPLIT_CTES,
         "train AS (SELECT *, count(*) OVER (PARTITION BY label) AS n, row_number() OVER (PARTITION BY label ORDER BY seq) - 1 "
         "AS r FROM split WHERE split = 'train')",
         f"draws AS (SELECT label, n, copy, ('0x' || substring(md5(concat('7|', label, '|', copy)), 1, 15))::BIGINT % n AS pick "
         f"FROM (SELECT label, n, unnest(range(1, {MIN_PER_LABEL} - n + 1)) AS copy FROM (SELECT DISTINCT label, n FROM train) "
         f"WHERE n < {MIN_PER_LABEL}))",
         "balanced AS (SELECT message_id, label, CAST(0 AS BIGINT) AS copy FROM train UNION ALL SELECT t.message_id, t.label, d.copy "
         "FROM draws d JOIN train t ON d.label = t.label AND d.pick = t.r)")


def _balanced(spark, sf) -> DataFrame:
    return R.oversample(split_mail(spark, sf).filter(F.col("split") == "train"), MIN_PER_LABEL)


@register("oversample", with_ctes(*_OVER, select="SELECT message_id, label, copy FROM balanced"))
def oversample(spark, sf):
    return _balanced(spark, sf).select("message_id", "label", F.col("copy").cast("long").alias("copy"))


@register("oversample_sizes", with_ctes(*_OVER, select="SELECT label, count(*) AS n FROM balanced GROUP BY label"))
def oversample_sizes(spark, sf):
    return _balanced(spark, sf).groupBy("label").agg(F.count(F.lit(1)).alias("n"))
