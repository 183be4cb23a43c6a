"""DuckDB text of the queries of this subpackage that SQL can express."""

from __future__ import annotations

_WORD = r"[^\x20\x09-\x0D]+"
_SPACE = r"[\x20\x09-\x0D]"

_LEDGER = rf"""
WITH texts AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents),
lists AS (SELECT *, regexp_extract_all(t, '{_WORD}') AS w,
    list_filter(string_split(t, chr(10)), lambda x: regexp_replace(x, '{_SPACE}', '', 'g') <> '') AS lines FROM texts),
windows AS (SELECT rid, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS win
    FROM (SELECT rid, w, unnest(range(1, len(w) - 1)) AS i FROM lists) s),
starts AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, win) AS n FROM windows) c WHERE n >= 2),
covered AS (SELECT rid, count(DISTINCT i + k) AS n_repeat_words
    FROM starts CROSS JOIN (SELECT unnest([0, 1, 2]) AS k) o GROUP BY rid),
measured AS (SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words,
    CAST(length(regexp_replace(t, '{_SPACE}', '', 'g')) AS BIGINT) AS word_chars,
    CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
    CAST(len(lines) AS BIGINT) AS n_lines, CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
    CAST(coalesce(n_repeat_words, 0) AS BIGINT) AS n_repeat_words,
    length(regexp_replace(t, '\P{{L}}', '', 'g')) AS n_letters, length(regexp_replace(t, '\P{{Lu}}', '', 'g')) AS n_upper
    FROM lists LEFT JOIN covered USING (rid)),
ledger AS (SELECT *, CAST((CASE WHEN n_words < 50 THEN 1 ELSE 0 END)
    + (CASE WHEN 100 * n_repeat_words > 50 * n_words THEN 2 ELSE 0 END)
    + (CASE WHEN word_chars < 2 * n_words OR word_chars > 15 * n_words THEN 4 ELSE 0 END)
    + (CASE WHEN 5 * n_symbols > n_words THEN 8 ELSE 0 END)
    + (CASE WHEN 2 * n_dup_lines > n_lines THEN 16 ELSE 0 END)
    + (CASE WHEN 10 * n_letters < 6 * word_chars THEN 32 ELSE 0 END)
    + (CASE WHEN 2 * n_upper > n_letters THEN 64 ELSE 0 END) AS BIGINT) AS fail_bits FROM measured)
"""

QUALITY = _LEDGER + """
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, (fail_bits & 3) <> 0 AS base_failed,
       fail_bits = 0 AS kept, fail_bits, 'v1' AS policy FROM ledger
"""

_RULES = ("few_words", "repeated_words", "word_length", "symbols", "duplicate_lines", "few_letters", "shouting")

ABLATIONS = _LEDGER + ", cells AS (" + " UNION ALL ".join(
    f"SELECT '{version}' AS version, '{rule}' AS rule, {mask} AS mask, {1 << i} AS bit"
    for version, mask in (("base", 3), ("v1", 127)) for i, rule in enumerate(_RULES) if mask >> i & 1) + """)
SELECT version, rule, count(*) AS documents, count(*) FILTER (WHERE (fail_bits & bit) <> 0) AS failed,
       count(*) FILTER (WHERE (fail_bits & mask) = bit) AS only_this,
       count(*) FILTER (WHERE (fail_bits & (mask - bit)) = 0) AS kept_without
FROM ledger CROSS JOIN cells GROUP BY version, rule
"""

_DIGIT = "substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((CAST('0x' || substr(h, {at}, 5) AS INTEGER) >> {shift}) & 31), 1)"
_BASE32 = " || ".join(_DIGIT.format(at=5 * j + 1, shift=15 - 5 * k) for j in range(8) for k in range(4))

WARC = f"""
WITH hashed AS (SELECT page_id, coalesce(html, '') AS body, sha1(coalesce(html, '')) AS h FROM pages),
firsts AS (SELECT h, min(page_id) AS first_id FROM hashed GROUP BY h)
SELECT page_id, CAST(strlen(body) AS BIGINT) AS payload_bytes, {_BASE32} AS payload_digest,
       CASE WHEN page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> first_id THEN first_id END AS refers_to
FROM hashed JOIN firsts USING (h)
"""

JACCARD = rf"""
WITH RECURSIVE lists AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{_WORD}') AS w FROM documents),
sets AS (SELECT doc_id, list_distinct(CASE WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE
    list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS s FROM lists WHERE len(w) > 0),
rows_ AS (SELECT doc_id, len(s) AS n, unnest(s) AS x FROM sets),
common AS (SELECT a.doc_id AS u, b.doc_id AS v, any_value(a.n) AS nu, any_value(b.n) AS nv, count(*) AS k
    FROM rows_ a JOIN rows_ b ON a.x = b.x AND a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id),
links AS (SELECT u, v FROM common WHERE 5 * k >= 4 * (nu + nv - k)),
reach(node, root) AS (SELECT doc_id, doc_id FROM documents UNION SELECT l.v, r.root FROM reach r JOIN links l ON r.node = l.u),
classes AS (SELECT node, min(root) AS class_id FROM reach GROUP BY node),
counts AS (SELECT u, count(*) AS n FROM links GROUP BY u)
SELECT doc_id, class_id, CAST(coalesce(n, 0) AS BIGINT) AS n_links
FROM documents JOIN classes ON doc_id = node LEFT JOIN counts ON doc_id = u
"""

TOP_K = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS e FROM embeddings
    WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.e, c.e) AS BIGINT) AS score
    FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM scored) r WHERE rank <= 5
"""

TRIE = r"""
WITH RECURSIVE t AS (SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST,
    sha256(concat(length(coalesce(role, '')), ':', role, text))) AS pos FROM conversations WHERE conv_id IS NOT NULL),
ids AS (SELECT DISTINCT conv_id, CAST(conv_id AS VARCHAR) AS s FROM t),
crc(conv_id, s, i, v) AS (SELECT conv_id, s, 0, CAST(4294967295 AS BIGINT) FROM ids
    UNION ALL SELECT conv_id, s, i + 1, CASE WHEN w & 1 = 1 THEN xor(w >> 1, 3988292384) ELSE w >> 1 END
    FROM (SELECT conv_id, s, i, CASE WHEN i % 8 = 0 THEN xor(v, CAST(ascii(substr(s, i // 8 + 1, 1)) AS BIGINT)) ELSE v END AS w
        FROM crc WHERE i < 8 * length(s)) b),
cut AS (SELECT conv_id, xor(v, 4294967295) % 9 AS h FROM crc WHERE i = 8 * length(s)),
rebuilt AS (SELECT conv_id, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY part, pos) AS pos FROM (
    SELECT c.conv_id, 0 AS part, pos, role, text FROM cut c JOIN t ON t.conv_id = c.conv_id - c.conv_id % 5 WHERE pos <= h
    UNION ALL SELECT c.conv_id, 1, pos, role, text FROM cut c JOIN t ON t.conv_id = c.conv_id WHERE pos > h) u),
pre(conv_id, d, k, up, bytes) AS (SELECT conv_id, CAST(0 AS BIGINT), '', '', CAST(0 AS BIGINT) FROM ids
    UNION ALL SELECT p.conv_id, d + 1, md5(concat(k, length(role), ':', role, text)), k, CAST(strlen(text) AS BIGINT)
    FROM pre p JOIN rebuilt r ON r.conv_id = p.conv_id AND r.pos = p.d + 1),
nodes AS (SELECT k, any_value(d) AS depth, any_value(up) AS up, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(bytes) AS bytes
    FROM pre GROUP BY k),
kids AS (SELECT up, count(*) AS n_children FROM nodes WHERE depth > 0 GROUP BY up),
below AS (SELECT DISTINCT a.k AS top, b.k AS k FROM pre a JOIN pre b ON a.conv_id = b.conv_id AND a.d <= b.d),
sums AS (SELECT top, count(*) FILTER (WHERE n_children IS NULL) AS n_leaves, CAST(sum((n_convs - 1) * bytes) AS BIGINT) AS saved_tokens
    FROM below JOIN nodes USING (k) LEFT JOIN kids ON kids.up = nodes.k GROUP BY top),
lasts AS (SELECT conv_id, arg_max(k, d) AS k FROM pre GROUP BY conv_id),
ends AS (SELECT k, string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) AS e FROM lasts GROUP BY k)
SELECT n.conv_id, n.depth, p.conv_id AS parent_conv_id, n.n_convs, coalesce(n_children, 0) AS n_children, n_leaves, saved_tokens,
    sha256(coalesce(e, '')) AS ends_sha256
FROM nodes n LEFT JOIN nodes p ON n.depth > 0 AND p.k = n.up LEFT JOIN kids ON kids.up = n.k JOIN sums ON sums.top = n.k
LEFT JOIN ends ON ends.k = n.k
"""
