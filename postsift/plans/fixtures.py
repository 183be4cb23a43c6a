"""Mail-shaped views over the test tables, written once in SQL that both engines accept.

The header and reply material the plain-text tables lack is derived from each row, so every view
grows with its table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

EMAILS = """
SELECT seq, message_id, account, thread_id, subject, sender, rcpt, cc, mail_date, internal_date, snippet, body AS text,
       label, confidence,
       concat('INBOX',
              CASE WHEN label <> '' THEN concat(',L_', label) ELSE '' END,
              CASE WHEN seq % 8 = 0 THEN ',L_payment' ELSE '' END,
              CASE WHEN seq % 13 = 0 THEN ',SENT' ELSE '' END,
              CASE WHEN seq % 17 = 0 THEN ',L_ready' ELSE '' END) AS label_ids_csv
FROM (
  SELECT
    d.doc_id AS seq,
    CAST(d.doc_id AS STRING) AS message_id,
    d.source AS account,
    CAST(CAST(floor(d.doc_id / 3) AS BIGINT) AS STRING) AS thread_id,
    concat(CASE WHEN d.doc_id % 5 = 0 THEN concat('TICK-', CAST(d.doc_id AS STRING), ' ') ELSE '' END,
           substring(split_part(d.text, chr(10), 1), 1, 120)) AS subject,
    CASE d.doc_id % 7
      WHEN 0 THEN concat('No Reply <no-reply@', d.source, '.example.com>')
      WHEN 1 THEN concat('alerts@', d.source, '.example.com')
      WHEN 2 THEN concat('GitHub <x', CAST(d.doc_id % 5 AS STRING), '@github.example.com>')
      WHEN 3 THEN concat('"Person  ', CAST(d.doc_id % 37 AS STRING), '" <Person', CAST(d.doc_id % 37 AS STRING), '@',
                         d.source, '.Example.COM>')
      WHEN 4 THEN CASE WHEN d.doc_id % 3 = 0 THEN 'undisclosed sender' ELSE concat('bob@', d.source, '.example.com') END
      ELSE concat('Person ', CAST(d.doc_id % 37 AS STRING), ' <person', CAST(d.doc_id % 37 AS STRING), '@', d.source,
                  '.example.com>')
    END AS sender,
    CASE WHEN d.doc_id % 2 = 0 THEN 'Owner <owner@example.com>' ELSE 'list@example.com' END AS rcpt,
    CASE WHEN d.doc_id % 6 = 0 THEN concat('copy', CAST(d.doc_id % 11 AS STRING), '@example.org') ELSE '' END AS cc,
    concat('day ', CAST(d.doc_id % 28 AS STRING)) AS mail_date,
    CAST(1704067200000 + d.doc_id * 60000 AS STRING) AS internal_date,
    substring(d.text, 1, 200) AS snippet,
    concat(
      d.text,
      CASE WHEN d.doc_id % 9 = 0 THEN concat(chr(10), 'Write to ops', CAST(d.doc_id AS STRING),
           '@example.com or see https://example.com/t/', CAST(d.doc_id AS STRING),
           ' before 12/05/2024, total usd 450.50, ref deadbeef', CAST(10000 + d.doc_id AS STRING)) ELSE '' END,
      CASE WHEN d.doc_id % 11 = 0 THEN '<br/><style>p {{}}</style>see <b>Tom &amp;amp; Co</b> &quot;now&quot;</p>' ELSE '' END,
      CASE WHEN d.doc_id % 6 = 0 THEN concat(chr(10), 'Thanks,', chr(10), 'Name') ELSE '' END,
      CASE WHEN d.doc_id % 10 = 1 THEN concat(chr(10), ' > quoted line', chr(10), 'after the quote') ELSE '' END,
      CASE WHEN d.doc_id % 4 = 0 THEN concat(chr(10), 'On Monday a colleague wrote:', chr(10), '> earlier text') ELSE '' END,
      CASE WHEN d.doc_id % 10 = 3 THEN concat(chr(10), '-----Original Message-----', chr(10), 'older text') ELSE '' END
    ) AS body,
    CASE WHEN l.quality = 1 AND l.toxic = 0 THEN 'fyi'
         WHEN l.quality = 0 AND l.toxic = 0 THEN 'misc'
         WHEN l.quality = 1 AND l.toxic = 1 THEN 'action_needed'
         WHEN l.quality = 0 AND l.toxic = 1 THEN 'urgent'
         ELSE '' END AS label,
    CAST((d.n_chars % 41 + 60) AS DOUBLE) / 100 AS confidence
  FROM {documents} d LEFT JOIN {labels} l ON d.doc_id = l.doc_id
) base
"""

# A second export that overlaps the first; every third body was edited in between.
REEXPORT = """
SELECT * FROM ({emails}) first_export
UNION ALL
SELECT seq + 1000000000000 AS seq, message_id, account, thread_id, subject, sender, rcpt, cc, mail_date, internal_date,
       snippet, CASE WHEN seq % 3 = 0 THEN concat(text, ' edited') ELSE text END AS text, label, confidence, label_ids_csv
FROM ({emails}) second_export
"""

# Answers of an external labeller, in each shape the parser must handle, one per message.
# "~" stands for an escaped quote inside the nested JSON text.
RESPONSES = """
SELECT seq, message_id, replace(CASE seq % 8
    WHEN 0 THEN concat('{{"output_text":"', answer, '"}}')
    WHEN 1 THEN concat('{{"output":[{{"content":[{{"text":"', answer, '"}}]}}]}}')
    WHEN 2 THEN '{{"output":[{{"content":[{{"refusal":"will not label"}}]}}]}}'
    WHEN 3 THEN '{{"output_text":"{{~label~:~other~,~confidence~:0.9,~reason~:~r~}}"}}'
    WHEN 4 THEN '{{"output":[]}}'
    WHEN 5 THEN concat('{{"output":[{{"content":[{{"text":""}}]}},{{"content":[{{"text":"', answer,
                       '"}},{{"refusal":"late"}}]}}]}}')
    WHEN 6 THEN '{{"output_text":"not json"}}'
    ELSE concat('{{"output_text":"","output":[{{"content":[]}},{{"content":[{{"text":"', answer, '"}}]}}]}}')
  END, '~', concat(chr(92), chr(34))) AS response
FROM (
  SELECT seq, message_id,
         concat('{{~label~:~', CASE WHEN label = '' THEN 'payment' ELSE label END, '~,~confidence~:',
                CAST(confidence AS STRING), ',~reason~:~from ', account, '~}}') AS answer
  FROM ({emails}) e
) a
"""

# Conversations as mail: one id per thread, so ids repeat in turn order.
THREAD_MAIL = """
SELECT conv_id * 1000 + turn AS seq, role AS account, CAST(conv_id AS STRING) AS message_id,
       concat('turn ', CAST(turn AS STRING)) AS subject, text,
       CASE role WHEN 'user' THEN 'Action Needed' WHEN 'assistant' THEN 'FYI' ELSE ' ' END AS label
FROM {conversations}
"""


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A test table; one stored in fewer splits than there are cores is spread out once.

    A table of cluster size has far more splits than cores and is read as it lies.
    """
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    cores = spark.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores)


def _as_mail(df: DataFrame) -> DataFrame:
    return (df.withColumnRenamed("sender", "from").withColumnRenamed("rcpt", "to")
            .withColumnRenamed("mail_date", "date")
            .withColumn("label_ids", F.split("label_ids_csv", ",")).drop("label_ids_csv"))


def sql_emails(spark: SparkSession, sf_dir: str, sql: str = EMAILS) -> DataFrame:
    return spark.sql(sql.replace("{emails}", EMAILS), documents=_table(spark, sf_dir, "documents"),
                     labels=_table(spark, sf_dir, "labels"))


def emails(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _as_mail(sql_emails(spark, sf_dir))


def reexported(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _as_mail(sql_emails(spark, sf_dir, REEXPORT))


def label_responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sql_emails(spark, sf_dir, RESPONSES)


def thread_mail(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(THREAD_MAIL, conversations=_table(spark, sf_dir, "conversations"))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return _table(spark, sf_dir, name)


def duck(sql: str) -> str:
    """The same view as DuckDB text, table names in place of the parameters."""
    return (sql.replace("{emails}", EMAILS)
            .format(documents="documents", labels="labels", conversations="conversations"))
