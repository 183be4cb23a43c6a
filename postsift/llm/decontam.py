"""Benchmark decontamination by greedy string tiling.

Seeds are word windows that a document shares with a benchmark item. Distinct texts and items are joined on them, by
their word codes, not by a hash alone. For each text and item that meet, the longest match of unmarked words is marked
again and again until none of ``seed`` words is left; the marked share of the item is its coverage. Tiles may come in
any order, so a passage whose parts were moved is covered like one that was not.

The whole benchmark never reaches the driver or a task: only a bit table of its windows does, which has a bound and only
saves the join rows that cannot meet. A text covers enough of an item only with a number of its windows, so the
windows that most texts hold, one fewer than that number, need not bring a text and an item together; a common phrase is
joined with the items that consist of nothing rarer. A text meets each item once, however many copies it has.

Defined cases: words are lower-cased runs of letters and digits. A null or blank document has no leak. An item with
fewer than ``seed`` words matches where it stands whole; one with fewer than ``LEAST_WORDS``, null ones among them, is no
evidence and never matches. Repeated items are reported each, items without id as -1; of matches of equal length the
first counts. Very long texts and words repeated without end take time by the product of their places, memory by a
portion of it. An empty benchmark leaks nowhere, an empty table of documents gives no rows. Other columns may have any
names.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import arrow_udf

from postsift.llm.batches import bounded_batches
from postsift.llm.shingles import windows, word_codes
from postsift.session import cut_lineage

SEED = 5
#: Items of fewer words are no evidence, as texts hold them by chance; up to the length of a seed they count as a whole.
LEAST_WORDS = 3
#: Places of shared windows that are held at once.
PAIRS = 1 << 20
COVERAGE = 0.5
#: Entries of the table of known windows: 512 bits a window, 2 ** 27 bits (16 MB) in all at the most, whatever the
#: benchmark. Beyond, more windows pass by chance and are left to the join; none are lost.
WINDOW_BITS = 512
FEWEST_BITS, MOST_BITS = 16, 27
LEAK = "array<struct<item_id:long,coverage:double,tiles:int>>"
SEEDS = T.ArrayType(T.StructType().add("w", T.BinaryType()).add("at", T.ArrayType(T.IntegerType())))
ITEM = (T.StructType().add("words", T.IntegerType()).add("size", T.IntegerType())
        .add("hashes", T.ArrayType(T.LongType())).add("seeds", SEEDS))
TILED = T.StructType().add("coverage", T.DoubleType()).add("tiles", T.IntegerType())
SEEDS_ARROW = pa.list_(pa.struct([("w", pa.binary()), ("at", pa.list_(pa.int32()))]))
ITEM_ARROW = pa.struct([("words", pa.int32()), ("size", pa.int32()), ("hashes", pa.list_(pa.int64())), ("seeds", SEEDS_ARROW)])
TILED_ARROW = pa.struct([("coverage", pa.float64()), ("tiles", pa.int32())])


def normal_words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Word codes and begins of lower-cased texts without signs."""
    plain = pc.replace_substring_regex(pc.utf8_lower(pc.fill_null(texts, "")), r"[^\pL\pN]+", " ")
    return word_codes(plain)


def distinct_windows(codes: np.ndarray, places: np.ndarray, size: int) -> list[dict]:
    """The different windows of ``size`` codes at ``places``, each with all its places."""
    found: dict[bytes, list[int]] = {}
    for place in places.tolist():
        found.setdefault(codes[place: place + size].tobytes(), []).append(place)
    return [{"w": w, "at": at} for w, at in found.items()]


@arrow_udf(ITEM)
def _item_windows(texts: pa.Array, seed: pa.Array) -> pa.Array:
    """Words, length of the windows, their hashes and the windows with their places, of each item."""
    codes, begins = normal_words(texts)
    out = []
    for lo, hi, longest in zip(begins, begins[1:], seed.to_pylist()):
        words = codes[lo:hi]
        size = min(len(words), longest)
        hashes = windows(words, size) if size >= min(LEAST_WORDS, longest) else np.zeros(0, np.uint64)
        out.append({"words": len(words), "size": size, "hashes": np.unique(hashes).view(np.int64),
                    "seeds": distinct_windows(words, np.arange(len(hashes)), size)})
    return pa.array(out, ITEM_ARROW)


def known_windows(items: DataFrame, bits: int) -> np.ndarray:
    """A bit for each value of the upper ``bits`` bits of a window's hash, set where an item has it; built by Spark."""
    place = F.shiftrightunsigned(F.col("hash"), 64 - bits)
    cells = (items.select(F.explode("hashes").alias("hash"))
             .groupBy(F.shiftright(place, 5).cast("int").alias("cell"))
             .agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), (place % 32).cast("int"))).alias("bits")).toArrow())
    table = np.zeros(1 << (bits - 5), np.uint32)
    table[cells["cell"].to_numpy()] = cells["bits"].to_numpy()
    return table


def _shared_windows(known: Broadcast, bits: int, sizes: list[int]):
    """Of each text the windows that an item may have, with their places."""

    def of_part(texts: pa.Array) -> pa.Array:
        codes, begins = normal_words(texts)
        out: list[list[dict]] = [[] for _ in range(len(texts))]
        for size in sizes:
            place = windows(codes, size) >> np.uint64(64 - bits)
            at = np.flatnonzero(known.value[place >> np.uint64(5)] >> (place & np.uint64(31)).astype(np.uint32) & np.uint32(1))
            doc = np.searchsorted(begins, at, "right") - 1
            whole = at + size <= begins[doc + 1]
            at, doc = at[whole], doc[whole]
            for cut in np.split(np.arange(len(at)), np.flatnonzero(np.diff(doc)) + 1) if len(at) else ():
                lo = int(begins[doc[cut[0]]])
                out[doc[cut[0]]] += distinct_windows(codes[lo:], at[cut] - lo, size)
        return pa.array(out, SEEDS_ARROW)

    @arrow_udf(SEEDS)
    def shared(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            whole = iter([pa.RecordBatch.from_arrays([texts], ["t"])])
            parts = [of_part(part.column(0)) for part in bounded_batches(whole, 0)]
            yield pa.concat_arrays(parts) if parts else pa.array([], SEEDS_ARROW)

    return shared


def _merged(runs: np.ndarray) -> np.ndarray:
    """Runs (start in the documents, start in the items, windows), with those that continue one another joined."""
    if not len(runs):
        return runs
    runs = runs[np.lexsort((runs[:, 0], runs[:, 0] - runs[:, 1]))]
    follows = np.zeros(len(runs), bool)
    follows[1:] = (runs[1:, 0] == runs[:-1, 0] + runs[:-1, 2]) & (np.diff(runs[:, 0] - runs[:, 1]) == 0)
    first = np.flatnonzero(~follows)
    return np.column_stack([runs[first, :2], np.add.reduceat(runs[:, 2], first)])


def seed_runs(pairs: list[tuple[np.ndarray, np.ndarray]], portion: int = PAIRS) -> np.ndarray:
    """Runs of shared windows on one diagonal, from the places of each window in the text and in the item.

    A window that repeats in both matches in as many ways as the product of its places. They are taken in portions of
    about ``portion`` places, of which only the runs are kept: a run a diagonal.
    """
    runs, held, size = [np.zeros((0, 3), np.int64)], [], 0
    for mine, theirs in pairs:
        step = max(1, portion // len(theirs))
        for lo in range(0, len(mine), step):
            some = mine[lo: lo + step]
            held.append(np.column_stack([np.repeat(some, len(theirs)), np.tile(theirs, len(some)),
                                         np.ones(len(some) * len(theirs), np.int64)]))
            size += len(held[-1])
            if size >= portion:
                runs.append(_merged(np.concatenate(held)))
                held, size = [], 0
    return _merged(np.concatenate([*runs, *held]))


def greedy_tiles(runs: np.ndarray, seed: int) -> list[tuple[int, int, int]]:
    """Tiles (start in the document, start in the item, words) from runs of seeds, longest first."""
    heap = [(-(int(n) + seed - 1), int(p), int(q)) for p, q, n in runs]
    heapq.heapify(heap)
    in_doc, in_item, tiles = set(), set(), []
    while heap:
        n, a, b = heapq.heappop(heap)
        run = 0
        pieces = []
        for k in range(-n + 1):
            if k < -n and a + k not in in_doc and b + k not in in_item:
                run += 1
                continue
            if run >= seed:
                pieces.append((-run, a + k - run, b + k - run))
            run = 0
        if pieces == [(n, a, b)]:
            tiles.append((a, b, -n))
            in_doc.update(range(a, a - n))
            in_item.update(range(b, b - n))
        else:
            for piece in pieces:
                heapq.heappush(heap, piece)
    return tiles


def tiled(pairs: list[tuple[np.ndarray, np.ndarray]], words: int, size: int, coverage: float) -> dict | None:
    """Coverage and tiles of one item in one text, None below ``coverage``."""
    runs = seed_runs(pairs)
    edges = np.zeros(words + 1, np.int64)
    np.add.at(edges, runs[:, 1], 1)
    np.add.at(edges, runs[:, 1] + runs[:, 2] + size - 1, -1)
    if np.count_nonzero(np.cumsum(edges)) < coverage * words:  # no tiling covers more
        return None
    tiles = greedy_tiles(runs, size)
    share = sum(n for _, _, n in tiles) / words
    return {"coverage": share, "tiles": len(tiles)} if share >= coverage else None


@arrow_udf(TILED)
def _tiled(met: pa.Array, words: pa.Array, size: pa.Array, coverage: pa.Array) -> pa.Array:
    out = []
    for number, row in enumerate(zip(words.to_pylist(), size.to_pylist(), coverage.to_pylist())):
        pairs = met[number].values
        mine, theirs = pairs.field("mine"), pairs.field("theirs")
        places = [(mine[k].values.to_numpy().astype(np.int64), theirs[k].values.to_numpy().astype(np.int64))
                  for k in range(len(pairs))]
        out.append(tiled(places, *row))
    return pa.array(out, TILED_ARROW)


def text_key(text: str) -> Column:
    """What stands for a text in joins; copies have one."""
    return F.unhex(F.sha1(F.col(text).cast("binary")))


def item_windows(benchmark: DataFrame, item_key: str, item_text: str, seed: int, coverage: float) -> DataFrame:
    """(item, ids, words, size, least, hashes, seeds) of the different items; ``least`` places of windows are evidence enough."""
    items = benchmark.select(F.coalesce(F.col(item_key).cast("long"), F.lit(-1)).alias("id"), F.col(item_text).alias("body"))
    items = items.filter("body IS NOT NULL").withColumn("item", text_key("body"))
    items = items.groupBy("item").agg(F.min("body").alias("body"), F.sort_array(F.collect_list("id")).alias("ids"))
    items = items.select("item", "ids", _item_windows("body", F.lit(seed)).alias("x")).select("item", "ids", "x.*")
    least = F.greatest(F.lit(1), F.ceil(F.lit(coverage) * F.col("words") / F.col("size") - 1e-9).cast("int"))
    return items.filter(F.size("hashes") > 0).withColumn("least", least)


def leaks(docs: DataFrame, benchmark: DataFrame, text: str = "text", item_key: str = "item_id", item_text: str = "text",
          seed: int = SEED, coverage: float = COVERAGE) -> DataFrame:
    """(text_key, leaks): one row per different text that leaks items; texts themselves are not moved."""
    spark = docs.sparkSession
    items = cut_lineage(item_windows(benchmark, item_key, item_text, seed, coverage), "decontam_items")
    count = items.agg(F.sum(F.size("hashes"))).first()[0] or 0
    sizes = sorted(r[0] for r in items.select("size").distinct().collect())  # LEAST_WORDS to seed
    bits = min(max(FEWEST_BITS, (WINDOW_BITS * count).bit_length()), MOST_BITS)
    known = spark.sparkContext.broadcast(known_windows(items, bits))

    found = docs.select(text_key(text).alias("text_key"), _shared_windows(known, bits, sizes)(F.col(text)).alias("seeds"))
    found = found.filter(F.size("seeds") > 0).groupBy("text_key").agg(F.first("seeds").alias("seeds"))
    found = cut_lineage(found.select("text_key", F.inline("seeds")), "decontam_seeds")

    theirs = items.select("item", "least", F.inline("seeds")).withColumnRenamed("at", "theirs")
    held = found.groupBy("w").agg(F.count(F.lit(1)).alias("texts")).withColumnRenamed("w", "held")
    commonest = W.partitionBy("item").orderBy(F.desc("texts"), "w").rowsBetween(W.unboundedPreceding, W.currentRow)
    # Windows that no text holds bring nothing together and count as the rarest.
    rare = (theirs.join(held, F.col("w") == F.col("held")).withColumn("places", F.sum(F.size("theirs")).over(commonest))
            .filter(F.col("places") >= F.col("least")).select(F.col("w").alias("rare"), "item"))
    met = found.join(rare, F.col("w") == F.col("rare")).select("text_key", "item").distinct()
    met = (met.join(theirs.withColumnRenamed("item", "i"), F.col("item") == F.col("i"))
           .select(F.col("text_key").alias("k"), F.col("w").alias("v"), "item", "least", "theirs"))
    pairs = (found.join(met, (F.col("text_key") == F.col("k")) & (F.col("w") == F.col("v")))
             .groupBy("text_key", "item")
             .agg(F.collect_list(F.struct(F.col("at").alias("mine"), "theirs")).alias("met"),
                  F.sum(F.size("theirs")).alias("places"), F.first("least").alias("enough"))
             .filter(F.col("places") >= F.col("enough")).drop("places", "enough"))
    whole = items.select(F.col("item").alias("i"), "ids", "words", "size")
    rows = pairs.join(whole, F.col("item") == F.col("i")).select(
        "text_key", "ids", _tiled("met", "words", "size", F.lit(float(coverage))).alias("tiled"))
    rows = rows.filter(F.col("tiled").isNotNull()).select("text_key", F.explode("ids").alias("item_id"), "tiled.*")
    one = F.struct("item_id", "coverage", "tiles")
    return rows.groupBy("text_key").agg(F.sort_array(F.collect_list(one)).cast(LEAK).alias("leaks"))


def with_leaks(docs: DataFrame, benchmark: DataFrame, name: str, text: str = "text", **options) -> DataFrame:
    """``docs`` with a column ``name``: the benchmark items each document leaks, as LEAK."""
    found = cut_lineage(leaks(docs, benchmark, text, **options), "decontam_leaks")
    rows = docs.drop(name).select(F.struct("*").alias("doc"), text_key(text).alias("k"))
    return (rows.join(found, F.col("k") == F.col("text_key"), "left")
            .select("doc.*", F.coalesce("leaks", F.array().cast(LEAK)).alias(name)))


def report(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """(key, leaked, item_ids, coverage, tiles): one row per row of ``docs``; coverage is that of the most covered item."""
    rows = with_leaks(docs.select(F.col(key), F.col(text).alias("__body")), benchmark, "__leaks", "__body", **options)
    best = F.array_max(F.transform("__leaks", lambda x: F.struct(x["coverage"].alias("c"), x["tiles"].alias("t"))))
    return rows.select(key, (F.size("__leaks") > 0).alias("leaked"),
                       F.array_sort(F.col("__leaks.item_id")).alias("item_ids"),
                       F.coalesce(best["c"], F.lit(0.0)).alias("coverage"), F.coalesce(best["t"], F.lit(0)).alias("tiles"))


def keep_clean(docs: DataFrame, benchmark: DataFrame, text: str = "text", **options) -> DataFrame:
    """The rows of ``docs`` that leak no item, with their own columns."""
    found = cut_lineage(leaks(docs, benchmark, text, **options).select("text_key"), "decontam_leaks")
    rows = docs.select(F.struct("*").alias("doc"), text_key(text).alias("k"))
    return rows.join(found, F.col("k") == F.col("text_key"), "left_anti").select("doc.*")
