"""Text operators over a column: ``op(df, source, out, …) -> df``.

Expressions stay on the JVM except HTML entity decoding. Long chains are staged through temporary
columns, so a value used twice is computed once and the expression tree stays small. Patterns carry
the Java flags that give them Unicode meaning (``(?U)``) and ``\\n`` as the only line end (``(?d)``).
"""

from __future__ import annotations

import html
import itertools
from collections.abc import Callable
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from postsift import constants as K
from postsift.functions.arrays import let

_counter = itertools.count()

# White space as the corpus tools understand it: Unicode white space and the four separators.
SPACE = r"[\s\x1c-\x1f]"
NON_SPACE = r"[^\s\x1c-\x1f]"
# The same characters one by one, for trimming without a pattern.
SPACES = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"


def _tmp() -> str:
    return f"__t{next(_counter)}"


def _col(source: str | Column) -> Column:
    return F.col(f"`{source}`") if isinstance(source, str) else source


def fields_present(pairs: list[tuple[str, str | Column]]) -> Column:
    """``prefix value`` for every non-empty value, joined by one space."""
    return F.concat_ws(" ", *[
        F.when(_col(value) != "", F.concat(F.lit(prefix), _col(value))) for prefix, value in pairs
    ])


def strip_space(c: Column) -> Column:
    return F.btrim(c, F.lit(SPACES))


def _where(c: Column, needed: Callable[[Column], Column], pattern: str, repl: str) -> Column:
    """Replace matches in the texts that hold what every match needs; the others are not searched."""
    return let(c, lambda v: F.when(needed(v), F.regexp_replace(v, pattern, repl)).otherwise(v))


def _holds(*parts: str) -> Callable[[Column], Column]:
    return lambda v: reduce(lambda a, b: a | b, [F.contains(v, F.lit(p)) for p in parts])


def _finds(pattern: str) -> Callable[[Column], Column]:
    return lambda v: v.rlike(pattern)


def _entity_decoder():
    # A local function is shipped by value, so executors need no copy of this package.
    def decode(values: pd.Series) -> pd.Series:
        return values.map(html.unescape, na_action="ignore")

    return F.pandas_udf(decode, StringType())


_decode_entities = _entity_decoder()


def unescape(df: DataFrame, source: str | Column, out: str) -> DataFrame:
    """Decode HTML entities; only values that contain ``&`` travel to Python, the rest as nulls.

    The one-element explode keeps the optimizer from folding everything between two decoders into
    one expression: it merges projections that both hold a Python function, whatever their cost.
    """
    value, coded = _tmp(), _tmp()
    df = df.withColumn(value, F.coalesce(_col(source), F.lit("")))
    df = df.withColumn(coded, F.when(F.contains(F.col(value), F.lit("&")), F.col(value)))
    decoded = F.coalesce(_decode_entities(F.col(coded)), F.col(value))
    kept = [F.col(f"`{c}`") for c in df.columns if c not in (out, value, coded)]
    return df.select(*kept, F.explode(F.array(decoded)).alias(out))


def _drop_scripts(c: Column) -> Column:
    return _where(c, _holds("</"), r"(?isU)<(script|style).*?</\1>", " ")


def _drop_tags(c: Column) -> Column:
    return _where(c, _holds("<"), r"<[^>]++>", " ")


def _mask_and_collapse(c: Column) -> Column:
    """Addresses masked, and every run of white space, line ends included, made one space."""
    c = _where(c, _holds("://"), rf"(?U)https?://{NON_SPACE}+", " URL ")
    # A match always begins at the start of its token, so anchor there: linear on long tokens.
    c = _where(c, _holds("@"), rf"(?U)(?<!{NON_SPACE}){NON_SPACE}+@{NON_SPACE}+", " EMAIL ")
    return strip_space(F.regexp_replace(c, rf"(?U){SPACE}+", " "))


def clean_text(df: DataFrame, source: str | Column, out: str) -> DataFrame:
    decoded = _tmp()
    df = unescape(df, source, decoded)
    return df.withColumn(out, _mask_and_collapse(_drop_tags(_drop_scripts(F.col(decoded))))).drop(decoded)


def _before(text: Column, marker: str) -> Column:
    return F.split(text, f"(?imdU){marker}", 2)[0]


# How the lines that markers match begin; one search passes most texts over. Letters that other letters fold to are left out.
_QUOTE_LINE = r"\n(?:[oO][nN] |[fF][rR][oO][mM]:|--|_____)"
_SIGNATURE_LINE = r"\n(?:--|[rR][eE][gG][aA][rR][dD]|[tT][hH][aA][nN]|[bB][eE])"


def _cut_quoted(c: Column) -> Column:
    """Cut at the first marker, in list order, that matches; a match is never empty."""
    def cut(whole: Column) -> Column:
        chain = F.when(~whole.rlike(_QUOTE_LINE), whole)
        for marker in K.QUOTE_MARKERS:
            chain = chain.when(whole.rlike(f"(?imdU){marker}"), _before(whole, marker))
        return chain.otherwise(whole)

    return let(c, cut)


def _cut_signature(c: Column) -> Column:
    """As for quotes, but a marker whose first hit lies too early is passed over."""
    def cut(whole: Column) -> Column:
        chain = F.when(~whole.rlike(_SIGNATURE_LINE), whole)
        for marker in K.SIGNATURE_MARKERS:
            head = _before(whole, marker)
            chain = chain.when(whole.rlike(f"(?imdU){marker}") & (F.char_length(head) > K.SIGNATURE_MIN_START), head)
        return chain.otherwise(whole)

    return let(c, cut)


def _limit_words(c: Column, max_chars: int | None) -> Column:
    if max_chars is None:
        return c
    return F.when(F.char_length(c) > max_chars, F.regexp_replace(F.substring(c, 1, max_chars), r" [^ ]*\z", "")
                  ).otherwise(c)


def body_source(df: DataFrame) -> Column:
    """``body_raw`` where a row has it, as quote and signature marks need its line breaks; else ``text``."""
    return F.coalesce("body_raw", "text") if "body_raw" in df.columns else F.col("text")


def strip_reply_noise(df: DataFrame, source: str | Column, out: str, max_chars: int | None = 3000) -> DataFrame:
    """The newest human-written part of a message; ``max_chars=None`` keeps all of it."""
    t = _tmp()
    df = unescape(df, source, t)
    c = F.replace(F.replace(F.col(t), F.lit("\r\n"), F.lit("\n")), F.lit("\r"), F.lit("\n"))
    c = _drop_scripts(c)
    c = _where(c, _holds("<"), rf"(?iU)<br{SPACE}*/?>", "\n")
    c = _where(c, _holds("</"), rf"(?iU)</p{SPACE}*>", "\n")
    lines = F.transform(F.split(_cut_quoted(_drop_tags(c)), "\n"), strip_space)
    kept = F.array_join(F.filter(lines, lambda line: ~F.startswith(line, F.lit(">"))), "\n")
    df = clean_text(df.withColumn(t, _cut_signature(kept)), t, t)
    return df.withColumn(out, _limit_words(F.col(t), max_chars)).drop(*([t] if t != out else []))


HEADER_FIELDS = [(f"{name}: ", name) for name in ("subject", "from", "to", "cc", "snippet")]


def join_email_fields(df: DataFrame, out: str = "joined_text") -> DataFrame:
    return clean_text(df, fields_present([*HEADER_FIELDS, ("", "text")]), out)


def training_text(df: DataFrame, out: str = "training_text", body_chars: int | None = 0) -> DataFrame:
    """Header fields, and the stripped body up to ``body_chars`` (0: none, None: all of it)."""
    if body_chars == 0:
        return clean_text(df, fields_present(HEADER_FIELDS), out)
    body = _tmp()
    df = strip_reply_noise(df, body_source(df), body, body_chars)
    return clean_text(df, fields_present([*HEADER_FIELDS, ("body: ", body)]), out).drop(body)


def scoring_text(df: DataFrame, out: str = "scoring_text", body_chars: int | None = None) -> DataFrame:
    """The text a deployed model sees: fixed prefixes even when empty; ``None`` keeps the raw body."""
    body = _tmp()
    if body_chars is None:
        df = df.withColumn(body, F.coalesce(F.col("text"), F.lit("")))
    elif body_chars > 0:
        df = strip_reply_noise(df, body_source(df), body, body_chars)
    else:
        df = df.withColumn(body, F.lit(""))
    parts = [F.concat(F.lit(f"{n}: "), F.coalesce(_col(n), F.lit(""))) for n in ("subject", "from", "to", "snippet")]
    last = F.when(F.col(body) != "", F.concat(F.lit("body: "), F.col(body))).otherwise("")
    return clean_text(df, F.concat_ws(" ", *parts, last), out).drop(body)


def labeller_text(df: DataFrame, out: str = "training_text", max_chars: int | None = None) -> DataFrame:
    """Subject, sender, snippet and stripped body; the parts are not cleaned again as a whole."""
    body = _tmp()
    df = strip_reply_noise(df, body_source(df), body, max_chars)
    parts = [F.concat(F.lit(f"{n}: "), F.coalesce(_col(n), F.lit(""))) for n in ("subject", "from", "snippet")]
    return df.withColumn(out, F.concat_ws(" ", *parts, F.when(F.col(body) != "", F.col(body)))).drop(body)


def sender_domain(c: Column) -> Column:
    lowered = F.lower(F.coalesce(c, F.lit("")))
    domain = F.regexp_extract(lowered, r"@([a-z0-9.-]+\.[a-z]{2,})", 1)
    return F.when(domain != "", domain).otherwise(F.substring(lowered, 1, 80))


# For each similarity mask what a text with a match must hold, and what a match begins with: a test that is cheaper than the
# word boundary and comes before it. Texts are in lower case here but for the words of the masks.
_MASK_NEEDS = [
    (_holds("://"), ""),
    (_holds("@"), ""),
    (_finds(r"-(?U)\d"), ""),
    (_holds("#"), ""),
    (_finds(r"(?U)\d[:/.-]\d"), r"(?=\d)"),
    (_finds(r"(?U)\d{4}"), r"(?=\d{4})"),
    (_finds(r"(?U)\d"), r"(?=\d)"),
    (_holds("num", "NUM"), ""),
    (_finds("[a-f0-9]{8}"), "(?=[a-f0-9]{8})"),
]


def similarity_text(df: DataFrame, out: str = "similarity_text", max_chars: int | None = None,
                    domain: Column | None = None) -> DataFrame:
    """Subject, domain, snippet and body with volatile values masked, as a token string.

    The masks insert upper-case words into lower-cased text and tokens are lower case only, so a
    masked value vanishes; that is the defined behaviour.
    """
    t = _tmp()
    df = strip_reply_noise(df, body_source(df), t, max_chars)
    c = F.lower(F.concat_ws(
        " ",
        F.concat(F.lit("subject: "), F.coalesce(F.col("subject"), F.lit(""))),
        F.concat(F.lit("from: "), sender_domain(F.col("from")) if domain is None else domain),
        F.concat(F.lit("snippet: "), F.coalesce(F.col("snippet"), F.lit(""))),
        F.when(F.col(t) != "", F.col(t)),
    ))
    for (pattern, repl), (needed, start) in zip(K.SIMILARITY_MASKS, _MASK_NEEDS, strict=True):
        c = _where(c, needed, f"(?iuU){start}{pattern}", repl)
    df = df.withColumn(t, F.regexp_extract_all(c, F.lit(K.SIMILARITY_TOKEN), F.lit(0)))
    kept = F.filter(F.col(t), lambda x, i: (i == 0) | ~(
        x.isin(K.COLLAPSED_TOKENS) & (x == F.get(F.col(t), i - 1))))
    return df.withColumn(out, F.array_join(kept, " ")).drop(t)


def shingles(c: Column, width: int = K.SHINGLE_WIDTH) -> Column:
    """Word shingles of a token string; texts of at most ``width`` tokens give their tokens.

    A lookahead at every token start reads the overlapping shingles in one regex pass; slicing a
    token array in a lambda would evaluate the array again for each shingle. A match takes its whole
    first token, so the search goes on at the next one.
    """
    run = " ".join(["[^ ]++"] * width)
    windows = F.regexp_extract_all(c, F.lit(f"(?=({run}))[^ ]++"), F.lit(1))
    return F.when(c.rlike(f"^{run} "), windows).otherwise(F.filter(F.split(c, " "), lambda x: x != ""))


def normalize_label(c: Column) -> Column:
    lowered = F.replace(F.lower(strip_space(F.coalesce(c, F.lit("")))), F.lit("&"), F.lit(" and "))
    return F.regexp_replace(F.regexp_replace(lowered, "[^a-z0-9]+", "_"), "^_+|_+$", "")


def prefixed_label(c: Column) -> Column:
    return F.concat(F.lit("__label__"), normalize_label(c))


def strip_label_prefix(c: Column) -> Column:
    return F.regexp_replace(c, "^__label__", "")


def extract_email(c: Column) -> Column:
    return F.lower(F.regexp_extract(F.coalesce(c, F.lit("")), f"(?iu){K.ADDRESS}", 0))


def display_name(c: Column) -> Column:
    """The header without its address; only the lower-cased form of the address is removed."""
    raw, email = F.coalesce(c, F.lit("")), extract_email(c)
    name = F.replace(raw, F.concat(F.lit("<"), email, F.lit(">")), F.lit(""))
    name = F.when(email == "", name).otherwise(F.replace(name, email, F.lit("")))
    name = strip_space(F.regexp_replace(strip_space(name), r'^"+|"+\z', ""))
    return F.regexp_replace(name, rf"(?U){SPACE}+", " ")


def first_contained(c: Column, words: list[str], prefix: str = "") -> Column:
    """``prefix`` + the first word of the list found in ``c``, else null."""
    chain = F
    for word in words:
        chain = chain.when(F.contains(c, F.lit(word)), F.lit(prefix + word))
    return chain


def classify_by_rules(df: DataFrame, source: str | Column, out: str = "rule_label",
                      rules: list[tuple[str, list[str]]] = K.KEYWORD_RULES) -> DataFrame:
    t = _tmp()
    df = clean_text(df, source, t).withColumn(t, F.lower(t))
    chain = F
    for label, phrases in rules:
        hit = reduce(lambda a, b: a | b, [F.contains(F.col(t), F.lit(p)) for p in phrases])
        chain = chain.when(hit, F.lit(label))
    return df.withColumn(out, chain).drop(t)
