"""URL filter: listed rules first, mined association rules for the rest; DataFrame functions only.

Pages under a listed rule carry its verdict as a label. FP-growth over their URL tokens and label finds token
combinations that go with one verdict; those with enough support and confidence judge the pages no rule lists. Pages
meet rules through an inverted index, in which each rule is posted under its rarest token.

Defined cases: a url that is null or has no ``://`` has an empty host and path and no tokens, so it gets the default
verdict; an empty table gives an empty one. A path that is empty starts with no rule's path. Repeated rows are judged alike, null ids are carried along,
and only the id and the url are read. Without labelled pages nothing is mined.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postsift.session import write_stage

MIN_SUPPORT = 0.01
MIN_CONFIDENCE = 0.95
MIN_COUNT = 20
DEFAULT = "allow"
LABEL = "label="


@dataclass(frozen=True)
class ListedRule:
    verdict: str
    host: str
    path: str

    @property
    def text(self) -> str:
        return self.host + self.path


# The listed rules of the task.
LISTED = (
    ListedRule("allow", "org", "/"), ListedRule("block", "example.org", "/es/"), ListedRule("block", "example.org", "/en/1"),
    ListedRule("allow", "com", "/fr/"), ListedRule("block", "com", "/de/"),
)


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, ASCII capitals lowered."""
    host = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)\A.*?://([^/?#]*)", 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)\A.*?://[^/?#]*([^?#]*)", 1)


def listed_rule(host: Column, path: Column, rules: Sequence[ListedRule]) -> tuple[Column, Column]:
    """Text and verdict of the longest rule whose host is ``host`` or a parent of it and whose path begins ``path``."""
    text, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda r: len(r.text)):
        fits = ((host == rule.host) | host.endswith(f".{rule.host}")) & path.startswith(rule.path)
        text, verdict = F.when(fits, rule.text).otherwise(text), F.when(fits, rule.verdict).otherwise(verdict)
    return text, verdict


def url_tokens(url: Column, host: Column, path: Column) -> Column:
    """Distinct host labels, path words and query terms, each marked with its place."""
    query = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)\A.*?://[^?#]*\?([^#]*)", 1)
    marked = lambda value, cut, place: F.transform(
        F.filter(F.split(value, cut), lambda t: t != ""), lambda t: F.concat(F.lit(place), t))
    return F.array_distinct(F.concat(marked(host, r"\.", "h:"), marked(path, r"[^\p{L}\p{N}]+", "p:"), marked(query, "&", "q:")))


def support_share(rows: int, min_support: float, min_count: int) -> float:
    """The share of ``rows`` that is at least ``min_support`` and at least ``min_count`` rows."""
    return min(1.0, max(min_support, min_count / max(rows, 1)))


def frequent_tokens(labelled: DataFrame, least: float) -> DataFrame:
    """(token, same) of the tokens in at least ``least`` rows; ``same`` is the first of those that share all rows.

    Tokens that always occur together double the frequent combinations each and say nothing of their own, so one of
    them stands for all in mining and matching. Sums of the rows' hashes tell sets of rows apart. At most tokens-per-url
    times rows / ``least`` tokens are left.
    """
    row = F.xxhash64("tokens").cast("decimal(20,0)")
    counted = (labelled.select(F.explode("tokens").alias("token"), row.alias("row")).groupBy("token")
               .agg(F.count(F.lit(1)).alias("n"), F.sum("row").alias("rows")).filter(F.col("n") >= least))
    first = counted.groupBy(F.col("n").alias("n_"), F.col("rows").alias("rows_")).agg(F.min("token").alias("same"))
    return counted.join(first, (F.col("n") == F.col("n_")) & (F.col("rows") == F.col("rows_"))).select("token", "same")


def mine_rules(labelled: DataFrame, share: float, min_confidence: float = MIN_CONFIDENCE) -> DataFrame:
    """(antecedent, verdict, confidence, support, head) from (tokens, verdict); ``head`` is the rarest antecedent token.

    A combination must occur in ``share`` of the rows.
    """
    items = labelled.select(F.concat("tokens", F.array(F.concat(F.lit(LABEL), "verdict"))).alias("items"))
    model = FPGrowth(itemsCol="items", minSupport=share, minConfidence=min_confidence).fit(items)
    label = F.get("consequent", 0)
    rules = model.associationRules.filter(label.startswith(LABEL)).select(
        F.array_sort("antecedent").alias("antecedent"), F.substring(label, len(LABEL) + 1, 1 << 20).alias("verdict"),
        "confidence", "support")
    single = model.freqItemsets.filter(F.size("items") == 1).select(F.get("items", 0).alias("token"), "freq")
    posted = (rules.select("antecedent", F.explode("antecedent").alias("t"))
              .join(single, F.col("t") == F.col("token"))
              .groupBy("antecedent").agg(F.min(F.struct("freq", "token")).alias("rarest"))
              .select(F.col("antecedent").alias("__a"), F.col("rarest.token").alias("head")))
    return rules.join(posted, F.col("antecedent") == F.col("__a")).drop("__a")


def matched(signatures: DataFrame, rules: DataFrame) -> DataFrame:
    """(signature, mined, mined_rule, confidence) of the best rule inside each token array.

    Best is the highest confidence, then the longest antecedent, then the highest support, then by the text.
    """
    met = (signatures.select("signature", F.explode("signature").alias("token"))
           .join(rules, F.col("token") == F.col("head"))
           .filter(F.size(F.array_except("antecedent", "signature")) == 0))
    best = F.max(F.struct("confidence", F.size("antecedent").alias("n"), "support", "verdict",
                          F.array_join("antecedent", " ").alias("text")))
    return met.groupBy("signature").agg(best.alias("b")).select(
        F.col("signature").alias("__s"), F.col("b.verdict").alias("mined"), F.col("b.text").alias("mined_rule"),
        F.col("b.confidence").alias("confidence"))


def judge(pages: DataFrame, rules: Sequence[ListedRule] = LISTED, min_support: float = MIN_SUPPORT,
          min_confidence: float = MIN_CONFIDENCE, min_count: int = MIN_COUNT, default: str = DEFAULT, key: str = "page_id", url: str = "url") -> DataFrame:
    """(key, host, path, rule, verdict, mined_rule, confidence): one row per page.

    A combination needs a share of ``min_support`` and ``min_count`` of the labelled rows, as a confidence from a few
    rows says nothing. A page's tokens shrink to frequent ones, each under the name that stands for it, and then to
    those that occur in a rule. At most tokens-per-url / ``min_support`` tokens can, so their list is bounded whatever
    the number of pages, and equal remains are matched once.
    """
    rows = pages.select(F.col(key).alias("key"), F.col(url).alias("url"))
    rows = rows.select("key", "url", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    text, verdict = listed_rule(F.col("host"), F.col("path"), rules)
    rows = rows.select("key", "host", "path", text.alias("rule"), verdict.alias("verdict"),
                       url_tokens(F.col("url"), F.col("host"), F.col("path")).alias("tokens"))
    rows, _ = write_stage(rows, "url_tokens")
    labelled = rows.filter(F.col("verdict").isNotNull())
    n_labelled = labelled.count()
    share = support_share(n_labelled, min_support, min_count)
    same = {r.token: r.same for r in frequent_tokens(labelled, share * n_labelled * (1 - 1e-9)).collect()}
    if same:
        stands = F.create_map(*[F.lit(x) for pair in sorted(same.items()) for x in pair])
        kept = F.array_distinct(F.filter(F.transform("tokens", lambda t: F.try_element_at(stands, t)), lambda t: t.isNotNull()))
    else:
        kept = F.array().cast("array<string>")
    rows = rows.withColumn("tokens", kept)
    mined, _ = write_stage(mine_rules(rows.filter(F.col("verdict").isNotNull()), share, min_confidence), "url_rules")
    used = [r[0] for r in mined.select(F.explode("antecedent")).distinct().collect()]
    known = F.array(*[F.lit(t) for t in sorted(used)]) if used else F.array().cast("array<string>")
    rows = rows.withColumn("signature", F.array_sort(F.array_intersect("tokens", known)))
    signatures = rows.filter(F.col("rule").isNull() & (F.size("signature") > 0)).select("signature").distinct()
    # A page under a listed rule needs no other: it keeps its own row out of the join by a null key.
    asked = F.when(F.col("rule").isNull(), F.col("signature"))
    out = rows.withColumn("asked", asked).join(matched(signatures, mined), F.col("asked") == F.col("__s"), "left")
    return out.select(F.col("key").alias(key), "host", "path", "rule",
                      F.coalesce("verdict", "mined", F.lit(default)).alias("verdict"), "mined_rule", "confidence")
