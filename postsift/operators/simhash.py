"""Message signatures: template key parts and 64-bit SimHash, one narrow row per message."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType

from postsift import constants as K
from postsift.functions import text as T

_LOW = (1 << 32) - 1


def md5_hash(c: Column) -> Column:
    """First 64 bits of MD5: available in every SQL engine, so results can be cross-checked."""
    return F.conv(F.substring(F.md5(c), 1, 16), 16, -10).cast("long")


def xx_hash(c: Column) -> Column:
    """Spark's own 64-bit hash: cheaper than MD5, for corpora that need no outside check."""
    return F.xxhash64(c)


def _as_long(unsigned: int) -> int:
    return unsigned - (1 << 64) if unsigned >= 1 << 63 else unsigned


def _md5_counter(width: int):
    # A local function is shipped by value, so executors need no copy of this package.
    def count(texts: pd.Series) -> pd.Series:
        from hashlib import md5

        import numpy as np

        def one(text):
            words = (text or "").encode().split(b" ")
            if len(words) <= width or not all(words[:width]):
                found = [word for word in words if word]
            elif all(words):
                found = list(map(b" ".join, zip(*[words[i:] for i in range(width)])))
            else:
                runs = zip(*[words[i:] for i in range(width)])
                found = [b" ".join(run) for run in runs if all(run)]
            raw = np.frombuffer(b"".join([md5(f).digest() for f in found]), np.uint8).reshape(-1, 16)[:, :8]
            ones = np.unpackbits(raw, axis=1).sum(axis=0, dtype=np.int64)[::-1]
            return [len(found), *(ones[:32] + (ones[32:] << 32))]

        return texts.map(one)

    return F.pandas_udf(count, ArrayType(LongType()))


_md5_counts = _md5_counter(K.SHINGLE_WIDTH)


def simhash64(df: DataFrame, tokens: str, keys: list[str],
              feature_hash: Callable[[Column], Column] = md5_hash, out: str = "simhash") -> DataFrame:
    """SimHash of a token-string column, grouped by ``keys`` (which must identify a row).

    Each shingle's hash adds to 32 sums that hold two 32-bit counters each, for bits k and k+32. The
    sums combine before the shuffle, so one short row per message moves, never its text. MD5 sums are
    counted per text in a helper, other hashes per shingle.
    """
    if feature_hash is md5_hash:
        counted = df.select(*keys, _md5_counts(F.col(tokens)).alias("__c"))
        sums = counted.groupBy(*keys).agg(F.sum(F.get("__c", F.lit(0))).alias("__n"),
                                          *[F.sum(F.get("__c", F.lit(k + 1))).alias(f"__s{k}") for k in range(32)])
    else:
        features = df.select(*keys, F.explode_outer(T.shingles(F.col(tokens))).alias("__f"))
        features = features.select(*keys, feature_hash(F.col("__f")).alias("__h"))
        pair = F.lit((1 << 32) | 1)
        sums = features.groupBy(*keys).agg(
            F.count("__h").alias("__n"),
            *[F.sum(F.shiftright("__h", k).bitwiseAND(pair)).alias(f"__s{k}") for k in range(32)])
    bits = F.lit(0).cast("long")
    for k in range(32):
        low = F.col(f"__s{k}").bitwiseAND(F.lit(_LOW))
        high = F.shiftrightunsigned(f"__s{k}", 32)
        for count, bit in ((low, k), (high, k + 32)):
            bits = bits.bitwiseOR(F.when(count * 2 >= F.col("__n"), F.lit(_as_long(1 << bit))).otherwise(F.lit(0)))
    return sums.select(*keys, F.when(F.col("__n") == 0, F.lit(0)).otherwise(bits).cast("long").alias(out))


def template_subject(c: Column) -> Column:
    c = F.lower(F.coalesce(c, F.lit("")))
    c = F.regexp_replace(c, r"(?iuU)\b[a-z]{1,10}-\d+\b", "ISSUE")
    c = F.regexp_replace(c, r"(?U)\b#?\d+\b", "NUM")
    c = T.strip_space(F.regexp_replace(c, rf"(?U){T.SPACE}+", " "))
    return F.substring(c, 1, K.TEMPLATE_SUBJECT_CHARS)


def signatures(df: DataFrame, max_chars: int | None = None, domain: Column | None = None,
               feature_hash: Callable[[Column], Column] = md5_hash) -> DataFrame:
    """(seq, message_id, domain, template_subject, prefix, norm_len, simhash).

    ``domain`` overrides the sender's domain, e.g. to group across senders.
    """
    dom = T.sender_domain(F.col("from")) if domain is None else domain
    norm = T.similarity_text(df, "__norm", max_chars, domain)
    narrow = norm.select(
        "seq", "message_id", dom.alias("domain"), template_subject(F.col("subject")).alias("template_subject"),
        F.md5(F.substring_index("__norm", " ", K.TEMPLATE_PREFIX_TOKENS)).alias("prefix"),
        F.char_length("__norm").alias("norm_len"), "__norm")
    keys = ["seq", "message_id", "domain", "template_subject", "prefix", "norm_len"]
    return simhash64(narrow, "__norm", keys, feature_hash)
