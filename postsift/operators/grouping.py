"""Near-duplicate template grouping: exact template keys and banded SimHash, joined into components.

Copies collapse before anything is paired: a vertex is a distinct (domain, simhash), so a template
sent to a third of the corpus is one vertex. Band buckets are joined on equality; a bucket that is
still large is refined on further hash bits, which loses no pair within the threshold, and what stays
large after that is cut into chunk pairs, so no task ever holds a whole bucket.
"""

from __future__ import annotations

from collections.abc import Sequence

import itertools

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from postsift import constants as K
from postsift.operators.components import connected_components
from postsift.operators.rows import rank_within, seq_bucket
from postsift.session import cut_lineage

BUCKET_LIMIT = 512
CHUNK_ROWS = 4096
MEMBER_SPAN = 10_000
BUCKET = ["domain", "band", "slice"]
#: Rounds along stars, and rows that share a head.
STAR_ROUNDS = 2
STAR_ROWS = 4096
#: Every round but the stars at least halves the roots that still have a close pair.
MAX_ROUNDS = 60


def _sorted_side(df: DataFrame) -> DataFrame:
    """A side of a join that grows with the corpus: it is sorted and merged, never collected in the driver for a broadcast.

    Tables of ids compress so well that their file sizes pass the planner's check for a broadcast when their rows should not.
    """
    return df.hint("merge")


def hash_bits(simhash: Column, start: int, width: int) -> Column:
    return F.shiftrightunsigned(simhash, start).bitwiseAND(F.lit((1 << width) - 1))


def hamming(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def vertices(signed: DataFrame) -> DataFrame:
    """Distinct (domain, simhash) with the first message as vertex id."""
    return signed.groupBy("domain", "simhash").agg(F.min("seq").alias("id"), F.count(F.lit(1)).alias("copies"))


def _first_agreeing(diff: Column, blocks: list[tuple[int, int]]) -> Column:
    chain = F
    for i, (start, width) in enumerate(blocks):
        chain = chain.when(hash_bits(diff, start, width) == 0, F.lit(i))
    return chain


def _pairs(keyed: DataFrame, keys: list[str], threshold: int, extra: Column, carried: list[str] = ()) -> DataFrame:
    """Join rows that share ``keys`` and keep each close pair once, with the lower id first."""
    fields = {"id": "id", "simhash": "hash", "root": "root", **{c: c for c in carried}}
    left = keyed.select(*keys, *[F.col(c).alias(f"{n}_a") for c, n in fields.items()])
    right = keyed.select(*[F.col(k).alias(f"__{k}") for k in keys], *[F.col(c).alias(f"{n}_b") for c, n in fields.items()])
    same = [F.col(k) == F.col(f"__{k}") for k in keys]
    close = ((F.col("id_a") < F.col("id_b")) & (F.col("root_a") != F.col("root_b"))
             & (hamming(F.col("hash_a"), F.col("hash_b")) <= threshold))
    joined = left.join(_sorted_side(right), [*same, close & extra])
    return joined.select("id_a", "id_b", "hash_a", "hash_b", "root_a", "root_b")


def lsh_pairs(nodes: DataFrame, threshold: int = K.HAMMING_THRESHOLD, bands: int = K.SIMHASH_BANDS,
              bucket_limit: int = BUCKET_LIMIT, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """Pairs of vertices of one domain that share a band and differ in at most ``threshold`` bits.

    A pair is kept only in the first band it shares, so no distinct is needed. ``nodes`` has (id,
    domain, simhash) and optionally ``root``; vertices of one root are not paired again.
    """
    width = 64 // bands
    if "root" not in nodes.columns:
        nodes = nodes.withColumn("root", F.col("id"))
    band_blocks = [(b * width, width) for b in range(bands)]
    banded = nodes.select("id", "domain", "simhash", "root", F.posexplode(F.array(
        *[hash_bits(F.col("simhash"), start, size) for start, size in band_blocks])).alias("band", "slice"))
    bucket = ["domain", "band", "slice"]
    sizes = (banded.groupBy(*bucket).agg(F.count(F.lit(1)).alias("size"), F.min("root").alias("lo"),
                                         F.max("root").alias("hi"))
             .filter((F.col("size") > 1) & (F.col("lo") != F.col("hi")))
             .select(*[F.col(k).alias(f"__{k}") for k in bucket], "size"))
    sized = cut_lineage(banded.join(_sorted_side(sizes), [F.col(k) == F.col(f"__{k}") for k in bucket])
                        .drop(*[f"__{k}" for k in bucket]), "banded")
    diff = F.col("hash_a").bitwiseXOR(F.col("hash_b"))
    first_band = F.col("band") == _first_agreeing(diff, band_blocks)
    found = _pairs(sized.filter(F.col("size") <= bucket_limit), bucket, threshold, first_band)
    large = sized.filter(F.col("size") > bucket_limit).drop("size")
    # One small count over a written table; most corpora of distinct templates have no such bucket.
    if not large.isEmpty():
        found = found.unionByName(_refined_pairs(large, threshold, bands, chunk_rows, first_band))
    return found.select("id_a", "id_b", hamming(F.col("hash_a"), F.col("hash_b")).alias("distance"),
                        "root_a", "root_b")


def _block_masks(threshold: int, bands: int) -> tuple[Column, list[tuple[int, int]]]:
    """Per band, the bit masks of threshold + 2 blocks of the bits outside it, and all pairs of blocks."""
    width, blocks = 64 // bands, threshold + 2
    others = [[bit for b in range(bands) if b != band for bit in range(b * width, (b + 1) * width)]
              for band in range(bands)]

    def mask(band: int, block: int) -> int:
        bits = others[band]
        lo, hi = len(bits) * block // blocks, len(bits) * (block + 1) // blocks
        value = sum(1 << bit for bit in bits[lo:hi])
        return value - (1 << 64) if value >= 1 << 63 else value

    masks = F.array(*[F.array(*[F.lit(mask(band, k)).cast("long") for k in range(blocks)]) for band in range(bands)])
    return F.get(masks, F.col("band")), list(itertools.combinations(range(blocks), 2))


def _refined(large: DataFrame, threshold: int, bands: int) -> DataFrame:
    """The rows of oversized buckets once for every pair of blocks, with the bits of the two in ``part``.

    A close pair differs in at most ``threshold`` of the threshold + 2 blocks, so at least two agree.
    """
    row, combos = _block_masks(threshold, bands)
    first = F.array(*[F.lit(i) for i, _ in combos])
    second = F.array(*[F.lit(j) for _, j in combos])
    return (large.withColumn("combo", F.explode(F.sequence(F.lit(0), F.lit(len(combos) - 1))))
            .withColumn("part", F.col("simhash").bitwiseAND(
                F.get(row, F.get(first, F.col("combo"))).bitwiseOR(F.get(row, F.get(second, F.col("combo")))))))


def _refined_pairs(large: DataFrame, threshold: int, bands: int, chunk_rows: int, first_band: Column) -> DataFrame:
    """Pairs of oversized buckets: rows meet on (bucket, two agreeing blocks), and a pair is kept where those are its first two."""
    keyed, (row, combos) = _refined(large, threshold, bands), _block_masks(threshold, bands)
    cell = ["domain", "band", "slice", "combo", "part"]
    sizes = (keyed.groupBy(*cell).agg(F.count(F.lit(1)).alias("n"), F.min("root").alias("lo"), F.max("root").alias("hi"))
             .filter((F.col("n") > 1) & (F.col("lo") != F.col("hi")))
             .select(*[F.col(k).alias(f"__{k}") for k in cell],
                     F.ceil(F.col("n") / F.lit(chunk_rows)).cast("int").alias("chunks")))
    keyed = keyed.join(_sorted_side(sizes), [F.col(k) == F.col(f"__{k}") for k in cell]).drop(*[f"__{k}" for k in cell])
    # Chunk pairs: a row of chunk c goes to (c, d) for every d, so any two rows meet exactly once.
    chunk = F.pmod(F.xxhash64("id"), F.col("chunks")).cast("int")
    keyed = (keyed.withColumn("chunk", chunk)
             .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
             .withColumn("c_lo", F.least("chunk", "other")).withColumn("c_hi", F.greatest("chunk", "other")))
    diff = F.col("hash_a").bitwiseXOR(F.col("hash_b"))
    chain = F
    for n, (i, j) in enumerate(combos):
        both = F.get(row, F.lit(i)).bitwiseOR(F.get(row, F.lit(j)))
        chain = chain.when(diff.bitwiseAND(both) == 0, F.lit(n))
    # Rows of one chunk share a cell with every other chunk too; they count only in their own.
    once = (F.col("c_lo") == F.col("c_hi")) | (F.col("chunk_a") != F.col("chunk_b"))
    return _pairs(keyed, [*cell, "c_lo", "c_hi"], threshold, first_band & (F.col("combo") == chain) & once, ["chunk"])


def _star_masks(threshold: int, bands: int) -> list[int]:
    """Bit sets of at most ``threshold`` positions that cover the hash and leave a band untouched."""
    width = 64 // bands
    # A range of at most ``width`` positions touches two bands at the most.
    if threshold < 1 or bands < 3 or threshold > width:
        return []
    return [sum(1 << bit for bit in range(start, min(start + threshold, 64))) for start in range(0, 64, threshold)]


def _near_copies(nodes: DataFrame, threshold: int, bands: int) -> DataFrame:
    """Edges from every vertex to the least vertex that equals it outside one short bit range.

    Two such vertices differ in at most ``threshold`` bits and share a band, so the edges are true
    ones; they are linear in the number of vertices, where a dense cluster's pairs are quadratic.
    """
    keep = [((1 << 64) - 1) ^ m for m in _star_masks(threshold, bands)]
    if not keep:
        return nodes.select(F.col("id").alias("u"), F.col("id").alias("v")).limit(0)
    signed = [k - (1 << 64) if k >= 1 << 63 else k for k in keep]
    masked = nodes.select("id", "domain", F.posexplode(F.array(
        *[F.col("simhash").bitwiseAND(F.lit(k)) for k in signed])).alias("range", "rest"))
    cell = ["domain", "range", "rest"]
    heads = (masked.groupBy(*cell).agg(F.min("id").alias("head"), F.count(F.lit(1)).alias("n"))
             .filter(F.col("n") > 1).select(*[F.col(k).alias(f"__{k}") for k in cell], "head"))
    return (masked.join(_sorted_side(heads), [F.col(k) == F.col(f"__{k}") for k in cell])
            .filter(F.col("id") != F.col("head")).select(F.col("id").alias("u"), F.col("head").alias("v")))


def _exact_edges(signed: DataFrame, nodes: DataFrame) -> DataFrame:
    """Vertex to exact-template edges; a template is a vertex of its own, numbered below zero."""
    key = ["domain", "template_subject", "prefix"]
    distinct = signed.groupBy(*key, "simhash").agg(F.min("seq").alias("s"))
    heads = distinct.groupBy(*key).agg(F.min("s").alias("head"), F.count(F.lit(1)).alias("n")).filter(F.col("n") > 1)
    shared = distinct.join(_sorted_side(heads.select(*[F.col(k).alias(f"__{k}") for k in key], "head")),
                           [F.col(k) == F.col(f"__{k}") for k in key])
    ids = nodes.select(F.col("domain").alias("__d"), F.col("simhash").alias("__h"), "id")
    return (shared.join(_sorted_side(ids), (F.col("domain") == F.col("__d")) & (F.col("simhash") == F.col("__h")))
            .select(F.col("id").alias("u"), (-F.col("head") - 1).alias("v")))


def _banded(nodes: DataFrame, bands: int) -> DataFrame:
    """Rows of the band buckets that hold more than one root, with the bucket's size."""
    width = 64 // bands
    rows = nodes.select("id", "domain", "simhash", "root", F.posexplode(F.array(
        *[hash_bits(F.col("simhash"), b * width, width) for b in range(bands)])).alias("band", "slice"))
    sizes = (rows.groupBy(*BUCKET).agg(F.count(F.lit(1)).alias("size"), F.min("root").alias("lo"), F.max("root").alias("hi"))
             .filter(F.col("lo") != F.col("hi")).select(*[F.col(k).alias(f"__{k}") for k in BUCKET], "size"))
    return rows.join(_sorted_side(sizes), [F.col(k) == F.col(f"__{k}") for k in BUCKET]).drop(*[f"__{k}" for k in BUCKET])


def _star_edges(banded: DataFrame, threshold: int, turn: int, star_rows: int) -> DataFrame:
    """Edges from the roots of close rows to the root of a head, one head for every ``star_rows`` rows of a bucket.

    Every row is compared with one head, so the work is linear; which row is head changes with ``turn``.
    """
    part = F.pmod(F.xxhash64("id", F.lit(turn)), F.ceil(F.col("size") / F.lit(star_rows)))
    rows, cell = banded.withColumn("part", part), [*BUCKET, "part"]
    head = F.min_by(F.struct(F.col("simhash").alias("hash"), F.col("root").alias("to")), F.xxhash64("id", F.lit(-turn - 1)))
    heads = rows.groupBy(*cell).agg(head.alias("head")).select(*[F.col(k).alias(f"__{k}") for k in cell], "head.hash", "head.to")
    met = rows.join(_sorted_side(heads), [F.col(k) == F.col(f"__{k}") for k in cell])
    close = (F.col("root") != F.col("to")) & (hamming(F.col("simhash"), F.col("hash")) <= threshold)
    return met.filter(close).select(F.col("root").alias("u"), F.col("to").alias("v")).distinct()


def _closest_edges(rows: DataFrame, cell: list[str], threshold: int, chunk_rows: int) -> DataFrame:
    """One edge per row to the closest other root among the rows of its cell, if any is close enough.

    Rows of a cell's most frequent root need not look for others: what is close to them looks for them. So a cell that
    has nearly contracted costs its few other rows times its size. Large cells are cut into chunk pairs.
    """
    counts = rows.groupBy(*cell, "root").agg(F.count(F.lit(1)).alias("n"))
    cells = counts.groupBy(*cell).agg(F.max_by("root", F.struct("n", "root")).alias("main"), F.sum("n").alias("rows"), F.max("n").alias("most"))
    cells = cells.filter(F.col("rows") > F.col("most")).select(
        *[F.col(k).alias(f"__{k}") for k in cell], "main", F.ceil(F.col("rows") / F.lit(chunk_rows)).cast("int").alias("chunks"),
        F.ceil((F.col("rows") - F.col("most")) / F.lit(chunk_rows)).cast("int").alias("askers"))
    placed = rows.join(_sorted_side(cells), [F.col(k) == F.col(f"__{k}") for k in cell]).drop(*[f"__{k}" for k in cell])
    dealt = lambda n: F.pmod(F.xxhash64("id"), n).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
    asking = placed.filter(F.col("root") != F.col("main")).select(
        *cell, dealt(F.col("askers")).alias("asker"), F.col("id").alias("from"), F.col("simhash").alias("hash"), F.col("root").alias("u"),
        every(F.col("chunks")).alias("chunk"))
    asked = placed.select(*[F.col(k).alias(f"__{k}") for k in cell], dealt(F.col("chunks")).alias("__chunk"), "simhash", "root",
                          every(F.col("askers")).alias("__asker"))
    same = [F.col(k) == F.col(f"__{k}") for k in (*cell, "chunk", "asker")]
    distance = hamming(F.col("hash"), F.col("simhash"))
    found = asking.join(_sorted_side(asked), [*same, (F.col("u") != F.col("root")) & (distance <= threshold)])
    return (found.groupBy("from", "u").agg(F.min_by("root", F.struct(distance, F.col("root"))).alias("v")).select("u", "v").distinct())


def _contracting_edges(banded: DataFrame, threshold: int, bands: int, bucket_limit: int, chunk_rows: int) -> DataFrame:
    """Edges between roots that have a close pair of rows in some bucket; none are left when no pair crosses roots."""
    edges = _closest_edges(banded.filter(F.col("size") <= bucket_limit), BUCKET, threshold, chunk_rows)
    large = banded.filter(F.col("size") > bucket_limit)
    # One small count over a written table; most corpora of distinct templates have no such bucket.
    if not large.isEmpty():
        # Rows meet where two of threshold + 2 blocks of the other bits agree, as any close pair does.
        edges = edges.unionByName(_closest_edges(_refined(large, threshold, bands), [*BUCKET, "combo", "part"], threshold, chunk_rows)).distinct()
    return edges


def contracted(nodes: DataFrame, threshold: int = K.HAMMING_THRESHOLD, bands: int = K.SIMHASH_BANDS, bucket_limit: int = BUCKET_LIMIT,
               chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """(id, domain, simhash, root) with equal roots for rows that close pairs of one band bucket link.

    Rounds find a few edges per row, contract the roots they link, and go on until no pair crosses roots: first along
    stars, which costs one comparison a row and melts dense clusters, then along each row's closest other root. Edges
    are linear in the rows of every round, however many pairs there are.
    """
    nodes = cut_lineage(nodes, "rooted")
    for turn in range(MAX_ROUNDS):
        banded = cut_lineage(_banded(nodes, bands), "banded")
        if banded.isEmpty():
            return nodes
        star = turn < STAR_ROUNDS
        found = (_star_edges(banded, threshold, turn, STAR_ROWS) if star
                 else _contracting_edges(banded, threshold, bands, bucket_limit, chunk_rows))
        edges = cut_lineage(found, "crossing")
        if edges.isEmpty():
            if star:
                continue
            return nodes
        names = connected_components(edges).withColumnRenamed("node", "__n")
        nodes = cut_lineage(nodes.join(_sorted_side(names), F.col("root") == F.col("__n"), "left").select(
            "id", "domain", "simhash", F.coalesce("component", "root").alias("root")), "rooted")
    raise RuntimeError(f"groups did not settle in {MAX_ROUNDS} rounds")


def template_components(signed: DataFrame, threshold: int = K.HAMMING_THRESHOLD, bands: int = K.SIMHASH_BANDS,
                        bucket_limit: int = BUCKET_LIMIT) -> DataFrame:
    """(seq, message_id, norm_len, component): component is the first seq of the template group.

    Two passes: copies, exact templates and near copies contract first through edges linear in the
    vertices; vertices of different contracted groups then contract by band (:func:`contracted`).
    """
    signed = cut_lineage(signed, "signatures")
    nodes = cut_lineage(vertices(signed), "vertices")
    linear = _exact_edges(signed, nodes).unionByName(_near_copies(nodes, threshold, bands))
    first = cut_lineage(connected_components(linear), "first_pass")
    rooted = (nodes.join(_sorted_side(first.withColumnRenamed("node", "__n")), F.col("id") == F.col("__n"), "left")
              .select("id", "domain", "simhash", F.coalesce("component", "id").alias("root")))
    resolved = contracted(rooted, threshold, bands, bucket_limit).select(
        F.col("domain").alias("__d"), F.col("simhash").alias("__h"), "id", F.col("root").alias("__c"))
    # Template vertices are numbered below zero; name each component by its first message instead.
    names = resolved.groupBy("__c").agg(F.min("id").alias("component"))
    resolved = (resolved.join(_sorted_side(names.withColumnRenamed("__c", "__cc")), F.col("__c") == F.col("__cc"))
                .select("__d", "__h", "component"))
    return (signed.join(_sorted_side(resolved), (F.col("domain") == F.col("__d")) & (F.col("simhash") == F.col("__h")))
            .select("seq", "message_id", "norm_len", "component"))


def numbered_groups(components: DataFrame) -> DataFrame:
    """(component, template_group_id, group_size), largest group first, earliest message on ties.

    The rank is summed from sizes: the distinct sizes (at most the square root of twice the corpus),
    then ranges of first messages inside one size, then the few groups of one range.
    """
    groups = components.groupBy("component").agg(F.count(F.lit(1)).alias("group_size"))
    ranked = rank_within(groups, ["group_size"], seq_bucket("component"), [F.col("component")], "__in_size")
    sizes = groups.groupBy("group_size").agg(F.count(F.lit(1)).alias("n"))
    before = sizes.select(
        F.col("group_size").alias("__size"),
        F.coalesce(F.sum("n").over(W.orderBy(F.desc("group_size")).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
        .alias("__before"))
    number = F.col("__before") + F.col("__in_size")
    digits = F.lpad(number.cast("string"), F.greatest(F.length(number.cast("string")), F.lit(5)), F.lit("0"))
    return (ranked.join(before, F.col("group_size") == F.col("__size"))
            .select("component", F.concat(F.lit("group_"), digits).alias("template_group_id"),
                    F.col("group_size").cast("int").alias("group_size")))


def representative_seqs(components: DataFrame) -> DataFrame:
    """(component, rep_seq): shortest similarity text, empty last, earliest on ties."""
    rank = F.when(F.col("norm_len") == 0, K.EMPTY_TEXT_RANK).otherwise(F.col("norm_len"))
    return (components.groupBy("component")
            .agg(F.min(F.struct(rank.alias("r"), F.col("seq"), F.col("message_id"))).alias("best"))
            .select("component", F.col("best.seq").alias("rep_seq"),
                    F.col("best.message_id").alias("representative_message_id")))


def group_table(components: DataFrame) -> DataFrame:
    """(component, template_group_id, group_size, rep_seq, representative_message_id)."""
    reps = representative_seqs(components).withColumnRenamed("component", "__c")
    return numbered_groups(components).join(reps, F.col("component") == F.col("__c")).drop("__c")


def assignments(components: DataFrame, groups: DataFrame, records: DataFrame | None = None, keys: Sequence[str] = ()) -> DataFrame:
    """One row per message with its group; ``keys`` are further columns taken from ``records``, such as the account."""
    rows = (components.select("seq", "message_id", F.col("component").alias("__c"))
            .join(groups, F.col("component") == F.col("__c"))
            .select("seq", "template_group_id", "message_id", "representative_message_id", "group_size"))
    if not keys:
        return rows
    named = records.select(F.col("seq").alias("__seq"), *keys)
    return rows.join(named, F.col("seq") == F.col("__seq")).drop("__seq")


def representatives(records: DataFrame, groups: DataFrame) -> DataFrame:
    """The representative records with group id and size; member ids are in ``group_members``."""
    marks = groups.select(F.col("rep_seq").alias("__seq"), "template_group_id",
                          F.col("group_size").alias("template_group_size"))
    return records.join(marks, F.col("seq") == F.col("__seq")).drop("__seq")


def group_members(components: DataFrame, groups: DataFrame, span: int = MEMBER_SPAN) -> DataFrame:
    """(template_group_id, chunk, message_ids): all member ids in message order.

    A row holds the members of one ``span`` of seq values, so a huge group is many bounded rows whose
    arrays, read by chunk, are the whole list.
    """
    rows = assignments(components, groups).withColumn("chunk", F.floor(F.col("seq") / F.lit(span)))
    ids = F.array_sort(F.collect_list(F.struct("seq", F.coalesce("message_id", F.lit("")).alias("id"))))
    return (rows.groupBy("template_group_id", "chunk").agg(ids.alias("m"))
            .select("template_group_id", "chunk", F.col("m.id").alias("message_ids")))


def grouping_summary(groups: DataFrame) -> DataFrame:
    covered = F.coalesce(F.sum("group_size"), F.lit(0))
    return groups.agg(covered.alias("input_records"), F.count(F.lit(1)).alias("representatives"), covered.alias("assignments"),
                      F.coalesce(F.max("group_size"), F.lit(0)).alias("largest_group"))
