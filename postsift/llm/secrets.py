"""Secret scan with multipart credential linking, in DataFrame functions only.

Strong patterns are reported wherever they match. Weak ones (a user name, mail address or account, a key-like token or
short secret, an address of a service: each alone says little) are reported only where complementary parts meet: parts
are spans, scopes are stretches of one document, and an interval join finds the parts within ``scope`` code points of
each other that do not overlap. A weak identifier needs a key, a weak key an identifier, an address both; weak parts
may complete each other.

Defined cases: a null text is an empty one and has no spans; an empty table gives an empty one. A text of any length is
matched whole. Repeated rows, and different texts under one id, get their own spans each. Null ids are ordinary values.
Spans that start together are ordered as the kinds are listed. Columns other than the key and the text are not read, so
their names may be any.
"""

from __future__ import annotations

from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postsift.llm.exprs import let
from postsift.session import write_stage

# The strong patterns, and the least length of what must be matched.
ASSIGN = (r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6)
ACCESS = (r"AKIA[A-Z0-9]+", 0, 20)
HEX = (r"[0-9a-f]+", 0, 24)
STRONG = {"assign": ASSIGN, "access": ACCESS, "hex": HEX}

# Weak parts: names of users and accounts, key-like tokens and short secrets, and addresses of services.
PREFIXES = "ASIA|AIDA|AROA|AGPA|ANPA|SK|AC"
_FREE, _IS, _END = r"(?<![A-Za-z0-9_])", r"""["']?\x20*[:=]\x20*["']?""", r"(?![A-Za-z0-9+/=])"
WEAK_ID = (
    rf"{_FREE}(?:(?:{PREFIXES})[A-Z0-9]{{12,}}(?![A-Za-z0-9_])"
    rf"|(?i:user_?name|user_?id|user|login|client_?id|account_?id|account|access_?key_?id){_IS}[A-Za-z0-9._@+-]{{3,}}"
    r"|[A-Za-z0-9._+-]{1,64}@[A-Za-z0-9-]{1,63}(?:\.[A-Za-z0-9-]{1,63}){1,8})", 0, 5)
WEAK_KEY = (
    r"(?<![A-Za-z0-9+/=_])(?:(?=[A-Za-z0-9+/]*[0-9])(?=[A-Za-z0-9+/]*[a-z])(?=[A-Za-z0-9+/]*[A-Z])"
    rf"(?:[A-Za-z0-9+/]{{32,}}={{0,2}}|[A-Za-z0-9]{{20,31}}{_END})"
    rf"|(?=[0-9a-f]*[0-9])(?=[0-9a-f]*[a-f])[0-9a-f]{{16,23}}{_END}"
    rf"""|(?i:pwd|pass|passphrase|pin|auth|credentials?|private_?key|access_?key){_IS}[^\x20\x09-\x0D"',;]{{4,}})""", 0, 4)
WEAK_ENDPOINT = (
    rf"{_FREE}(?:(?:https?|ftps?|sftp|ssh|ldaps?|smtps?|amqps?|rediss?|mongodb|mysql|postgres(?:ql)?)://[A-Za-z0-9._~:/?%@+-]{{4,}}"
    rf"|(?i:host_?name|host|server|endpoint|base_?url){_IS}[A-Za-z0-9][A-Za-z0-9._:/-]{{2,}}"
    r"|[A-Za-z0-9-]{1,63}(?:\.[A-Za-z0-9-]{1,63}){1,8}:[0-9]{2,5}(?![0-9]))", 0, 6)
WEAK = {"weak_id": WEAK_ID, "weak_key": WEAK_KEY, "weak_endpoint": WEAK_ENDPOINT}
KINDS = (*STRONG, *WEAK)

#: Which role a span of each kind plays in a credential.
ROLES = {"assign": "key", "access": "id", "hex": "key", "weak_id": "id", "weak_key": "key", "weak_endpoint": "endpoint"}
#: What must be near a weak span for it to be reported.
NEEDS = {"weak_id": ("key",), "weak_key": ("id",), "weak_endpoint": ("id", "key")}
SCOPE = 400
SPAN = "array<struct<start:long,stop:long>>"


def find_spans(text: Column, pattern: str, group: int, least: int) -> Column:
    """Leftmost non-overlapping matches as [start, stop) in code points, without those whose ``group`` is too short.

    The pieces between matches and the matches alternate, so their lengths add up to the positions.
    """
    none = F.array().cast(SPAN)

    def spans(whole: Column) -> Column:
        judged = whole if group == 0 else F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
        pairs = F.zip_with(whole, judged, lambda w, j: F.struct(F.length(w).alias("w"), F.length(j).alias("j")))
        steps = F.zip_with(pairs, F.slice(F.split(text, pattern, -1), F.lit(1), F.size(whole)),
                           lambda m, b: F.struct(m["w"].alias("w"), m["j"].alias("j"), F.length(b).alias("b")))
        return F.aggregate(
            steps, F.struct(F.lit(0).cast("long").alias("at"), none.alias("out")),
            lambda acc, s: F.struct(
                (acc["at"] + s["b"] + s["w"]).alias("at"),
                F.when(s["j"] >= least, F.concat(acc["out"], F.array(F.struct(
                    (acc["at"] + s["b"]).alias("start"), (acc["at"] + s["b"] + s["w"]).alias("stop")))))
                .otherwise(acc["out"]).alias("out")),
            lambda acc: acc["out"])

    return let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)),
               lambda whole: F.when(F.size(whole) > 0, spans(whole)).otherwise(none))


def _overlap(a: Column, b: Column) -> Column:
    return (a["start"] < b["stop"]) & (b["start"] < a["stop"])


def scanned(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, text_hash, one span array per kind): the only pass over the texts.

    Runs below the least length cannot match, so the patterns of plain runs ask for it at once; an assignment must be
    matched first and judged then, as a short value still uses up its characters. Every link needs an identifier and a
    key: weak keys are looked for only in texts that hold an identifier, addresses only in those that hold both.
    """
    runs = {"access": r"AKIA[A-Z0-9]{16,}", "hex": r"[0-9a-f]{24,}"}
    none = F.array().cast(SPAN)

    def found(body: Column, kind: str) -> Column:
        pattern, group, least = (STRONG | WEAK)[kind]
        return find_spans(body, runs.get(kind, pattern), group, least)

    def holds(spans: Column, role: str) -> Column:
        return reduce(or_, [F.size(spans[k]) > 0 for k in STRONG if ROLES[k] == role])

    def with_ids(body: Column) -> Column:
        # No weak identifier is without one of these.
        may = body.contains("@") | body.contains("=") | body.contains(":") | body.rlike(f"(?:{PREFIXES})[A-Z0-9]{{12}}")
        return F.struct(*[found(body, k).alias(k) for k in STRONG], F.when(may, found(body, "weak_id")).otherwise(none).alias("weak_id"))

    def with_keys(body: Column, m: Column) -> Column:
        ids = holds(m, "id") | (F.size(m["weak_id"]) > 0)
        return F.struct(m.alias("m"), ids.alias("ids"), F.when(ids, found(body, "weak_key")).otherwise(none).alias("weak_key"))

    def with_endpoints(body: Column, n: Column) -> Column:
        both = n["ids"] & (holds(n["m"], "key") | (F.size(n["weak_key"]) > 0))
        endpoints = F.when(both, found(body, "weak_endpoint")).otherwise(none)
        return F.struct(*[n["m"][k].alias(k) for k in (*STRONG, "weak_id")], n["weak_key"].alias("weak_key"),
                        endpoints.alias("weak_endpoint"))

    def disjoint(m: Column) -> Column:
        strong = F.concat(*[m[k] for k in STRONG])
        return F.struct(*[m[k].alias(k) for k in STRONG], *[
            F.filter(m[k], lambda s: ~F.exists(strong, lambda b: _overlap(s, b))).alias(k) for k in WEAK])

    body = F.coalesce(F.col(text), F.lit(""))
    spans = let(let(let(with_ids(body), lambda m: with_keys(body, m)), lambda n: with_endpoints(body, n)), disjoint)
    rows = docs.select(F.col(key).alias("key"), F.xxhash64(body).alias("text_hash"), spans.alias("spans"))
    return rows.select("key", "text_hash", "spans.*")


def _near(weak: DataFrame, parts: DataFrame, role: str, scope: int) -> DataFrame:
    """Rows of ``weak`` with a part of ``role`` beside them, at most ``scope`` code points away in the same document.

    A part that overlaps the span is the same text read another way and says nothing more.
    """
    cells = lambda lo, hi: F.explode(F.sequence(F.floor(lo / scope), F.floor(hi / scope)))
    left = weak.withColumn("cell", cells(F.greatest(F.col("start") - scope, F.lit(0)), F.col("stop") + scope))
    right = parts.filter(F.col("role") == role).select(
        F.col("key").alias("k"), F.col("text_hash").alias("h"), F.col("start").alias("a"), F.col("stop").alias("b"),
        cells(F.col("start"), F.col("stop")).alias("c"))
    met = (F.col("key").eqNullSafe(F.col("k")) & (F.col("text_hash") == F.col("h")) & (F.col("cell") == F.col("c"))
           & (F.col("a") - F.col("stop") <= scope) & (F.col("start") - F.col("b") <= scope)
           & ((F.col("a") >= F.col("stop")) | (F.col("b") <= F.col("start"))))
    return left.join(right, met, "left_semi").drop("cell").distinct()


def _tagged(kind: str) -> Column:
    return F.transform(F.col(kind), lambda s: F.struct(
        F.lit(kind).alias("kind"), F.lit(ROLES[kind]).alias("role"), s["start"].alias("start"), s["stop"].alias("stop")))


def linked(found: DataFrame, scope: int = SCOPE) -> DataFrame:
    """(key, text_hash, kind, start, stop) of the weak spans whose complementary parts are near; one row per span."""
    # Only texts that hold a weak span and a part of every role it needs send their parts to the join.
    holds = {role: reduce(or_, [F.size(k) > 0 for k in KINDS if ROLES[k] == role]) for role in set(ROLES.values())}
    may_link = reduce(or_, [(F.size(k) > 0) & reduce(and_, [holds[r] for r in roles]) for k, roles in NEEDS.items()])
    tagged = F.concat(*[_tagged(k) for k in KINDS])
    parts = (found.filter(may_link).select("key", "text_hash", F.explode(tagged).alias("p"))
             .select("key", "text_hash", "p.*").distinct())
    out = None
    for kind, roles in NEEDS.items():
        weak = parts.filter(F.col("kind") == kind).drop("role")
        for role in roles:
            weak = _near(weak, parts, role, scope)
        out = weak if out is None else out.unionByName(weak)
    return out


def _joined(spans: Column) -> Column:
    """kind:start:stop by start, then by the order of KINDS, comma-joined."""
    return F.array_join(F.transform(
        F.sort_array(spans),
        lambda s: F.concat_ws(":", F.get(F.array(*[F.lit(k) for k in KINDS]), s["kind"]), s["start"], s["stop"])), ",")


def _ranked(kind: str) -> Column:
    return F.transform(F.col(kind), lambda s: F.struct(
        s["start"].alias("start"), F.lit(KINDS.index(kind)).alias("kind"), s["stop"].alias("stop")))


def scan(docs: DataFrame, key: str = "doc_id", text: str = "text", scope: int = SCOPE) -> DataFrame:
    """(key, text_hash, base, all): per row of ``docs`` the strong spans and all reported ones.

    Both are arrays of (start, kind, stop), kind being the place in KINDS, in the order of the documents' text.
    The scanned spans are written once: the texts are read and matched one time only.
    """
    found, _ = write_stage(scanned(docs, key, text), "secret_spans")
    number = F.create_map(*[x for i, k in enumerate(KINDS) for x in (F.lit(k), F.lit(i))])
    added = (linked(found, scope).groupBy("key", "text_hash")
             .agg(F.collect_list(F.struct(F.col("start"), number[F.col("kind")].alias("kind"), F.col("stop"))).alias("more"))
             .select(F.col("key").alias("k"), F.col("text_hash").alias("h"), "more"))
    rows = found.select("key", "text_hash", F.sort_array(F.concat(*[_ranked(k) for k in STRONG])).alias("base"))
    kind = "array<struct<start:long,kind:int,stop:long>>"
    rows = rows.join(added, F.col("key").eqNullSafe(F.col("k")) & (F.col("text_hash") == F.col("h")), "left")
    return rows.select(
        F.col("key").alias(key), "text_hash", F.col("base").cast(kind).alias("base"),
        F.sort_array(F.concat(F.col("base").cast(kind), F.coalesce(F.col("more").cast(kind), F.array().cast(kind)))).alias("all"))


def digests(scans: DataFrame, key: str = "doc_id") -> DataFrame:
    """The span table as counts and text: (key, n_assign, n_access, n_hex, base_sha256, spans, n_linked)."""
    count = lambda i: F.size(F.filter("base", lambda s: s["kind"] == i)).cast("long")
    return scans.select(
        key, *[count(i).alias(f"n_{k}") for i, k in enumerate(STRONG)],
        F.sha2(_joined(F.col("base")).cast("binary"), 256).alias("base_sha256"), _joined(F.col("all")).alias("spans"),
        (F.size("all") - F.size("base")).cast("long").alias("n_linked"))


def redacted(docs: DataFrame, key: str = "doc_id", text: str = "text", mark: str = "[SECRET]", scope: int = SCOPE) -> DataFrame:
    """``docs`` with every reported span, or run of overlapping ones, replaced by ``mark``; other rows stay as they are."""
    spans = (scan(docs, key, text, scope).filter(F.size("all") > 0)
             .select(F.col(key).alias("k"), F.col("text_hash").alias("h"), F.col("all").alias("spans"))
             .dropDuplicates(["k", "h"]))
    # A document travels as one column, so that its names cannot meet those used here.
    rows = docs.select(F.struct("*").alias("doc"))
    doc, all_ = F.col("doc"), F.col("spans")
    body = F.coalesce(doc[text], F.lit(""))
    rows = rows.withColumn("hash", F.xxhash64(body)).join(spans, doc[key].eqNullSafe(F.col("k")) & (F.col("hash") == F.col("h")), "left")
    part = lambda lo, hi: F.substring(body, (lo + 1).cast("int"), (hi - lo).cast("int"))
    step = lambda acc, s: F.struct(
        F.greatest(acc["at"], s["stop"]).alias("at"),
        F.when(s["start"] >= acc["at"], F.concat(acc["out"], part(acc["at"], s["start"]), F.lit(mark)))
        .otherwise(acc["out"]).alias("out"))
    clean = F.aggregate(all_, F.struct(F.lit(0).cast("long").alias("at"), F.lit("").alias("out")), step,
                        lambda acc: F.concat(acc["out"], part(acc["at"], F.length(body).cast("long"))))
    new = F.when(all_.isNotNull(), clean).otherwise(doc[text])
    return rows.select(*[(new if c == text else doc[c]).alias(c) for c in docs.columns])
