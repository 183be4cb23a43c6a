"""Mining automated senders: aggregates at sender, name, label and domain grain."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from postsift import constants as K
from postsift.functions import text as T
from postsift.session import cut_lineage


def _narrow(df: DataFrame) -> DataFrame:
    """What the report needs of each row; email and domain are null where the header holds no address."""
    email = F.nullif(T.extract_email(F.col("from")), F.lit(""))
    return (df.withColumn("email", email)
            .select("seq", "email", F.substring_index("email", "@", -1).alias("domain"),
                    T.display_name(F.col("from")).alias("name"),
                    F.when(F.col("label") != "", F.col("label")).otherwise("unknown").alias("label"),
                    F.substring(F.coalesce("subject", F.lit("")), 1, K.SENDER_SAMPLE_CHARS).alias("subject")))


def with_sender(df: DataFrame) -> DataFrame:
    """Rows whose sender header holds an address, reduced to what the report needs."""
    return _narrow(df).filter(F.col("email").isNotNull())


def _singles(rows: DataFrame) -> DataFrame:
    """Every row as a cell of its own."""
    return rows.withColumn("n", F.lit(1)).withColumn("first_seq", F.col("seq"))


def cells(rows: DataFrame) -> DataFrame:
    """(email, domain, name, label, n, first_seq): what all counts of the report can be rolled up from."""
    return rows.groupBy("email", "domain", "name", "label").agg(
        F.count(F.lit(1)).alias("n"), F.min("seq").alias("first_seq"))


def _sum(by: DataFrame, *keys: str) -> DataFrame:
    return by.groupBy(*keys).agg(F.sum("n").alias("n"), F.min("first_seq").alias("first_seq"))


def _counts(by: DataFrame) -> DataFrame:
    return by.groupBy("email", "domain").agg(F.sum("n").alias("count"))


def _domains(by: DataFrame) -> DataFrame:
    return by.groupBy("domain").agg(F.sum("n").alias("count"), F.min("first_seq").alias("first_seq"))


def _top(domains: DataFrame, n: int) -> DataFrame:
    return domains.orderBy(F.desc("count"), "first_seq").limit(n).select("domain", "count")


def _names(by: DataFrame) -> DataFrame:
    names = _sum(by.filter(F.col("name") != ""), "email", "name")
    return names.groupBy("email").agg(
        F.max_by("name", F.struct("n", -F.col("first_seq"))).alias("display_name"))


def _labels(by: DataFrame) -> DataFrame:
    entries = F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("k"), "first_seq", "label", "n")))
    return _sum(by, "email", "label").groupBy("email").agg(F.to_json(F.map_from_entries(
        F.transform(entries, lambda e: F.struct(e["label"], e["n"])))).alias("labels"))


def _samples(rows: DataFrame, n: int) -> DataFrame:
    first = (rows.select("email", "seq", "subject")
             .withColumn("position", F.row_number().over(W.partitionBy("email").orderBy("seq")))
             .filter(F.col("position") <= n))
    return first.select("email", "position", "subject")


def sender_counts(df: DataFrame) -> DataFrame:
    return _counts(_singles(with_sender(df)))


def domain_counts(df: DataFrame) -> DataFrame:
    return _domains(_singles(with_sender(df)))


def top_domains(df: DataFrame, n: int = K.TOP_DOMAINS) -> DataFrame:
    return _top(domain_counts(df), n)


def sender_display_names(df: DataFrame) -> DataFrame:
    """Most common non-empty name; the first seen wins a tie."""
    return _names(_singles(with_sender(df)))


def sender_labels(df: DataFrame) -> DataFrame:
    """Label histogram per sender as JSON text, most frequent first, first seen on ties."""
    return _labels(_singles(with_sender(df)))


def sender_samples(df: DataFrame, n: int = K.SENDER_SAMPLE_SUBJECTS) -> DataFrame:
    """First ``n`` subjects per sender; the rank limit is applied before the shuffle as well as after."""
    return _samples(with_sender(df), n)


def with_reasons(senders: DataFrame) -> DataFrame:
    """(email, domain, display_name) -> the automation reasons, in local, name, domain order."""
    # Staged, so that each long marker chain reads a column instead of repeating the expression.
    staged = senders.withColumns({
        "__local": F.regexp_replace(F.lower(F.substring_index("email", "@", 1)), "[._+]+", "-"),
        "__name": F.lower(F.coalesce("display_name", F.lit(""))),
        "__domain": F.lower("domain")})
    return staged.withColumn("reasons", F.array_compact(F.array(
        T.first_contained(F.col("__local"), K.AUTOMATED_LOCAL_WORDS, "local:"),
        T.first_contained(F.col("__name"), K.AUTOMATED_NAME_MARKERS, "name:"),
        T.first_contained(F.col("__domain"), K.AUTOMATED_DOMAIN_MARKERS, "domain:")))).drop("__local", "__name", "__domain")


def mine_senders(df: DataFrame, min_count: int = 3) -> dict[str, DataFrame]:
    """The sender report as tables: candidates, domain candidates, top domains and totals.

    The mail is read once, into a written table of narrow rows, and counted once, into a written table of cells; every
    table of the report is rolled up from these. Candidates stay rows of a table rather than one array, so the report
    has no driver-sized row.
    """
    rows = cut_lineage(_narrow(df), "sender_rows")
    every = cut_lineage(cells(rows), "sender_cells")
    found, by = rows.filter(F.col("email").isNotNull()), every.filter(F.col("email").isNotNull())
    named = _counts(by).join(_names(by), "email", "left")
    reasoned = with_reasons(named.withColumn("display_name", F.coalesce("display_name", F.lit(""))))
    strong = F.exists("reasons", lambda r: F.startswith(r, F.lit("local:")) | F.startswith(r, F.lit("name:")))
    candidates = reasoned.filter((F.size("reasons") > 0) & ((F.col("count") >= min_count) | strong))
    samples = (_samples(found, K.SENDER_SAMPLE_SUBJECTS).groupBy("email")
               .agg(F.array_sort(F.collect_list(F.struct("position", "subject"))).alias("s"))
               .select("email", F.col("s.subject").alias("sample_subjects")))
    candidates = (candidates.join(_labels(by), "email").join(samples, "email")
                  .select("email", "count", "display_name", "reasons", "labels", "sample_subjects")
                  .orderBy(F.desc("count"), "email"))
    domains = _domains(by)
    marked = T.first_contained(F.lower("domain"), K.AUTOMATED_DOMAIN_MARKERS).isNotNull()
    domain_candidates = (domains.filter((F.col("count") >= min_count) & marked).select("domain", "count")
                         .orderBy(F.desc("count"), "domain"))
    totals = every.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("records"), F.countDistinct("email").alias("unique_senders"),
                       F.countDistinct("domain").alias("unique_domains"))
    return {"candidates": candidates, "domain_candidates": domain_candidates,
            "top_domains": _top(domains, K.TOP_DOMAINS), "totals": totals}
