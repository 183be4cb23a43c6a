"""Quality rules as a bitmask ledger.

Every rule is evaluated once per document: the ledger holds the measurements and one bit per failed rule. A policy
is a named set of rules; applying one, or comparing many, only reads the bits, so a new policy version or an ablation
never touches the texts again.

Defined cases: a null or empty text has no words, measures 0 everywhere and fails ``few_words``. Nulls in other
columns do not matter. Repeated rows are measured row by row. Columns of the input may have any names.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postsift.llm.exprs import SPACE_CHARS, let, words

SYMBOLS = "#*$%&|<>"
WINDOW = 3
MEASURES = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "n_letters", "n_upper")


Rule = tuple[str, Callable[[Column], Column]]


@dataclass(frozen=True)
class Policy:
    """A version of the rule set: a document is kept if none of ``rules`` failed."""

    version: str
    rules: tuple[str, ...]


#: Rule name and failure test over the measures; the place in the list is the bit, so new rules go to the end.
RULES: tuple[Rule, ...] = (
    ("few_words", lambda m: m["n_words"] < 50),
    ("repeated_words", lambda m: m["n_repeat_words"] * 100 > m["n_words"] * 50),
    ("word_length", lambda m: (m["word_chars"] < m["n_words"] * 2) | (m["word_chars"] > m["n_words"] * 15)),
    ("symbols", lambda m: m["n_symbols"] * 5 > m["n_words"]),
    ("duplicate_lines", lambda m: m["n_dup_lines"] * 2 > m["n_lines"]),
    ("few_letters", lambda m: m["n_letters"] * 10 < m["word_chars"] * 6),
    ("shouting", lambda m: m["n_upper"] * 2 > m["n_letters"]),
)
BASE = Policy("base", ("few_words", "repeated_words"))
V1 = Policy("v1", ("few_words", "repeated_words", "word_length", "symbols", "duplicate_lines", "few_letters", "shouting"))


def policy_mask(policy: Policy, rules: Sequence[Rule] = RULES) -> int:
    names = [name for name, _ in rules]
    return sum(1 << names.index(name) for name in policy.rules)


def _repeated_words(words: Column) -> Column:
    """Words in windows that occur twice or more; windows are compared by a 64-bit hash, inside one text only."""
    windows = F.when(F.size(words) >= WINDOW, F.sort_array(F.transform(
        F.sequence(F.lit(0), F.size(words) - WINDOW),
        lambda i: F.struct(F.xxhash64(*[F.get(words, i + k) for k in range(WINDOW)]).alias("h"), i.alias("at")))))
    same = lambda all_, x, i: F.coalesce(x["h"] == F.get(all_, i)["h"], F.lit(False))
    starts = lambda all_: F.sort_array(F.transform(
        F.filter(all_, lambda x, i: same(all_, x, i - 1) | same(all_, x, i + 1)), lambda x: x["at"]))
    covered = lambda begun: F.aggregate(
        F.transform(begun, lambda at, i: F.least(F.lit(WINDOW), F.coalesce(at - F.get(begun, i - 1), F.lit(WINDOW)))),
        F.lit(0).cast("long"), lambda total, n: total + n)
    return F.coalesce(let(windows, lambda w: let(starts(w), covered)), F.lit(0))


def measures(text: Column) -> Column:
    """A struct of MEASURES, all long."""

    def of(body: Column) -> Column:
        lines = F.filter(F.split(body, "\n"), lambda line: F.translate(line, SPACE_CHARS, "") != "")
        left = lambda pattern: F.length(F.regexp_replace(body, pattern, ""))
        from_words = let(words(body), lambda w: F.struct(F.size(w).alias("n"), _repeated_words(w).alias("repeated")))
        from_lines = let(lines, lambda x: F.struct(F.size(x).alias("n"), (F.size(x) - F.size(F.array_distinct(x))).alias("dup")))
        return let(F.struct(from_words.alias("w"), from_lines.alias("l")), lambda c: F.struct(*[
            value.cast("long").alias(name) for name, value in zip(MEASURES, (
                c["w"]["n"], F.length(F.translate(body, SPACE_CHARS, "")), F.length(body) - F.length(F.translate(body, SYMBOLS, "")),
                c["l"]["n"], c["l"]["dup"], c["w"]["repeated"], left(r"\P{L}+"), left(r"\P{Lu}+")), strict=True)]))

    return let(F.coalesce(text, F.lit("")), of)


def fail_bits(m: Column, rules: Sequence[Rule]) -> Column:
    """Bit i is set if rule i failed."""
    bits = F.lit(0).cast("long")
    for i, (_, failed) in enumerate(rules):
        bits = bits.bitwiseOR(F.when(failed(m), F.lit(1 << i)).otherwise(0).cast("long"))
    return bits


def ledger(docs: DataFrame, key: str = "doc_id", text: str = "text", rules: Sequence[Rule] = RULES) -> DataFrame:
    """(key, MEASURES, fail_bits): one row per row of ``docs``; no row is moved."""
    entry = let(measures(F.col(text)), lambda m: F.struct(
        *[m[name].alias(name) for name in MEASURES], fail_bits(m, rules).alias("fail_bits")))
    return docs.select(F.col(key), entry.alias("__entry")).select(key, "__entry.*")


def passes(policy: Policy, rules: Sequence[Rule] = RULES, bits: Column | str = "fail_bits") -> Column:
    column = F.col(bits) if isinstance(bits, str) else bits
    return column.bitwiseAND(F.lit(policy_mask(policy, rules)).cast("long")) == 0


def keep_passing(docs: DataFrame, policy: Policy = V1, text: str = "text", rules: Sequence[Rule] = RULES) -> DataFrame:
    """The rows of ``docs`` that pass ``policy``, with their own columns; no row is moved."""
    return docs.filter(passes(policy, rules, let(measures(F.col(text)), lambda m: fail_bits(m, rules))))


def ablations(entries: DataFrame, policies: Sequence[Policy], rules: Sequence[Rule] = RULES) -> DataFrame:
    """(version, rule, documents, failed, only_this, kept_without) for every rule of every policy.

    ``only_this`` counts the documents that no other rule of the policy rejects; ``kept_without`` is what the policy
    keeps if the rule is taken out. Documents are first counted by their bits, so the work after that one partial
    aggregate depends on the number of rules only.
    """
    names = [name for name, _ in rules]
    counts = entries.groupBy("fail_bits").agg(F.count(F.lit(1)).alias("n"))
    cells = [F.struct(F.lit(p.version).alias("version"), F.lit(rule).alias("rule"),
                      F.lit(policy_mask(p, rules)).cast("long").alias("mask"),
                      F.lit(1 << names.index(rule)).cast("long").alias("bit")) for p in policies for rule in p.rules]
    by_cell = counts.withColumn("c", F.explode(F.array(*cells))).select("fail_bits", "n", "c.*")
    hit = F.col("fail_bits").bitwiseAND(F.col("mask"))
    failed = hit.bitwiseAND(F.col("bit")) != 0
    rest = F.col("fail_bits").bitwiseAND(F.col("mask").bitwiseXOR(F.col("bit")))
    total = lambda test: F.coalesce(F.sum(F.when(test, F.col("n"))), F.lit(0))
    return by_cell.groupBy("version", "rule").agg(
        F.sum("n").alias("documents"), total(failed).alias("failed"), total(hit == F.col("bit")).alias("only_this"),
        total(rest == 0).alias("kept_without"))
