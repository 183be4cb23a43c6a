"""DuckDB text building blocks for the oracles, written apart from the Spark expressions."""

from __future__ import annotations

from postsift import constants as K
from postsift.plans import fixtures as X

def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def unescape(x: str) -> str:
    for entity, char in (("&quot;", '"'), ("&copy;", "©"), ("&middot;", "·"), ("&amp;", "&")):
        x = f"replace({x}, {q(entity)}, {q(char)})"
    return x


def sub(x: str, pattern: str, repl: str) -> str:
    return f"regexp_replace({x}, {q(pattern)}, {q(repl)}, 'g')"


def clean(x: str) -> str:
    x = unescape(f"coalesce({x}, '')")
    for pattern, repl in (
        (r"(?is)<script.*?</script>", " "), (r"(?is)<style.*?</style>", " "), (r"<[^>]+>", " "), (r"[\r\n]", " "),
        (r"https?://\S+", " URL "), (r"\S+@\S+", " EMAIL "), (r"\s+", " "), (r"^\s+|\s+$", ""),
    ):
        x = sub(x, pattern, repl)
    return x


def strip_ctes(prefix: str, source: str, column: str, max_chars: int | None = None, pre: str = "") -> str:
    """CTEs ending in ``{prefix}``: the source's rows plus ``{prefix}_t``, the stripped text."""
    p, t = prefix, f"{prefix}_t"
    x = unescape(f"coalesce({column}, '')")
    x = f"replace(replace({x}, chr(13)||chr(10), chr(10)), chr(13), chr(10))"
    for pattern, repl in ((r"(?is)<script.*?</script>", " "), (r"(?is)<style.*?</style>", " "),
                          (r"(?i)<br\s*/?>", "\n"), (r"(?i)</p\s*>", "\n"), (r"<[^>]+>", " ")):
        x = sub(x, pattern, repl)
    cut = " ".join(
        f"WHEN regexp_matches({t}, {q('(?im)' + m)}) THEN regexp_replace({t}, {q('(?im)' + m + '(?s:.*)')}, '')"
        for m in K.QUOTE_MARKERS)
    heads = [f"regexp_replace({t}, {q('(?im)' + m + '(?s:.*)')}, '')" for m in K.SIGNATURE_MARKERS]
    sign = " ".join(
        f"WHEN regexp_matches({t}, {q('(?im)' + m)}) AND length({h}) > {K.SIGNATURE_MIN_START} THEN {h}"
        for m, h in zip(K.SIGNATURE_MARKERS, heads))
    lines = (f"array_to_string(list_filter(list_transform(string_split({t}, chr(10)), "
             f"lambda s: regexp_replace(s, '^\\s+|\\s+$', '', 'g')), lambda s: NOT starts_with(s, '>')), chr(10))")
    done = clean(t)
    if max_chars is not None:
        last = (f"SELECT * REPLACE (CASE WHEN length({t}) > {max_chars} THEN "
                f"regexp_replace(substring({t}, 1, {max_chars}), ' [^ ]*$', '') ELSE {t} END AS {t}) FROM {p}5")
    else:
        last = f"SELECT * FROM {p}5"
    return (f"{p}1 AS (SELECT *, {x} AS {t} FROM {source}),\n"
            f"{p}2 AS (SELECT * REPLACE (CASE {cut} ELSE {t} END AS {t}) FROM {p}1),\n"
            f"{p}3 AS (SELECT * REPLACE ({lines} AS {t}) FROM {p}2),\n"
            f"{p}4 AS (SELECT * REPLACE (CASE {sign} ELSE {t} END AS {t}) FROM {p}3),\n"
            f"{p}5 AS (SELECT * REPLACE ({done} AS {t}) FROM {p}4),\n"
            f"{p} AS ({last})")


EMAILS_CTE = f"emails AS ({X.duck(X.EMAILS)})"
REEXPORT_CTE = f"mails AS ({X.duck(X.REEXPORT)})"


def present(pairs: list[tuple[str, str]]) -> str:
    """``prefix value`` of every non-empty value joined by a space."""
    items = ", ".join(f"CASE WHEN {v} <> '' THEN concat({q(p)}, {v}) END" for p, v in pairs)
    return f"array_to_string(list_filter([{items}], lambda s: s IS NOT NULL), ' ')"


HEADERS = [("subject: ", "subject"), ("from: ", "sender"), ("to: ", "rcpt"), ("cc: ", "cc"), ("snippet: ", "snippet")]
EMAIL_OF = "lower(regexp_extract(coalesce(sender, ''), " + q("(?i)" + K.ADDRESS) + ", 0))"


def domain_of(x: str = "sender") -> str:
    d = f"regexp_extract(lower({x}), '@([a-z0-9.-]+\\.[a-z]{{2,}})', 1)"
    return f"CASE WHEN {d} <> '' THEN {d} ELSE substring(lower({x}), 1, 80) END"


def normalize_label(x: str) -> str:
    x = f"replace(lower({sub(x, '^\\s+|\\s+$', '')}), '&', ' and ')"
    return sub(sub(x, "[^a-z0-9]+", "_"), "^_+|_+$", "")


def similarity_ctes(prefix: str, stripped: str, body: str, domain: str) -> str:
    """CTEs ending in ``{prefix}`` with ``norm``, the similarity text, and ``dom``."""
    x = (f"lower(concat('subject: ', subject, ' from: ', dom, ' snippet: ', snippet, "
         f"CASE WHEN {body} <> '' THEN concat(' ', {body}) ELSE '' END))")
    masked = "lowered"
    for pattern, repl in K.SIMILARITY_MASKS:
        masked = sub(masked, "(?i)" + pattern, repl)
    tokens = f"regexp_extract_all(masked, {q(K.SIMILARITY_TOKEN)})"
    collapsed = ", ".join(q(t) for t in K.COLLAPSED_TOKENS)
    return (f"{prefix}1 AS (SELECT *, {domain} AS dom FROM {stripped}),\n"
            f"{prefix}2 AS (SELECT *, {x} AS lowered FROM {prefix}1),\n"
            f"{prefix}3 AS (SELECT *, {masked} AS masked FROM {prefix}2),\n"
            f"{prefix}4 AS (SELECT *, {tokens} AS toks FROM {prefix}3),\n"
            f"{prefix} AS (SELECT *, array_to_string(list_filter(toks, lambda s, i: i = 1 OR NOT (s IN ({collapsed}) "
            f"AND s = toks[i - 1])), ' ') AS norm FROM {prefix}4)")


def shingles(tokens: str, width: int = K.SHINGLE_WIDTH) -> str:
    return (f"CASE WHEN len({tokens}) <= {width} THEN {tokens} ELSE list_transform(range(1, len({tokens}) - {width - 2}), "
            f"lambda i: array_to_string(list_slice({tokens}, i, i + {width - 1}), ' ')) END")


def first_contained(x: str, words: list[str], prefix: str = "") -> str:
    return "CASE " + " ".join(f"WHEN contains({x}, {q(w)}) THEN {q(prefix + w)}" for w in words) + " END"


def rule(x: str) -> str:
    t = f"lower({clean(x)})"
    return "CASE " + " ".join(
        "WHEN " + " OR ".join(f"contains({t}, {q(p)})" for p in phrases) + f" THEN {q(label)}"
        for label, phrases in K.KEYWORD_RULES) + " END"
