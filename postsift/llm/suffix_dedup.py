"""Removal of repeated byte strings by winnowing: anchors of least hash, then contexts, then strings.

A byte goes if a string of ``LENGTH`` bytes that covers it also starts in a document with a smaller id. This takes the
place of prefix doubling in Spark: there are no rounds of growing offset, doubling only builds the hash of CORE bytes.
An anchor is done as soon as its core occurs in one document only:

1. Every string of LENGTH bytes is represented by its anchor, the place in it where the hash of CORE bytes (built by
   doubling) is least; equal strings have equal anchors, so one suffix in thirteen or so need be sorted. Anchors are
   ranked by their core, and those whose rank occurs in one document only are done.
2. The rest are ranked again by the context, all the bytes of the strings an anchor stands for: with an equal context
   in an earlier document the whole context is repeated.
3. Anchors of equal core and different context are ranked by each of their strings, past the threshold.

Ranks of one cell (a range of core hashes) meet in one task; before that, every task keeps of equal ranks of its own
only the one of the smallest document, so a string that a third of the documents share arrives once per task. Where a
shared passage ends, one core has as many contexts as documents. Such hot cores are found by their contexts in a
sample, and their strings meet one by one, each in a cell of its own hash. The sample decides only where strings meet:
every string is compared, by its bytes, whichever way it goes.

Defined cases: a null text is empty; documents without id neither lose nor take bytes, as no id is smaller; rows
that share an id do not take bytes from each other. Texts are bytes: what is left may not be valid UTF-8.
"""

from __future__ import annotations

import itertools
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postsift.llm.batches import bounded_batches, groups

LENGTH = 50
CORE = 25
CHUNK = 1 << 20
FLUSH_ANCHORS = 1 << 20
FLUSH_CONTEXTS = 150_000
CELL_BYTES = 8 << 20
LEVEL = 6
#: One in so many pieces of the documents is sampled, and a core with so many contexts in the sample is hot.
SAMPLE_ONE_IN = 256
SAMPLE_PIECE = 64 << 10
HOT_SAMPLED = 64
#: In place of a lead: this is one string of a hot core.
BY_STRING = 255
MIX = np.uint64(0xBF58476D1CE4E5B9)
BYTES = np.random.default_rng(5).integers(1, 2**63, 256, dtype=np.uint64)


def ranks(data: np.ndarray, size: int = CORE) -> np.ndarray:
    """A 64-bit rank of the ``size`` bytes at every place, by doubling: the rank of 2n is made of those of n and n later."""
    powers, n = [(1, BYTES[data])], 1
    while 2 * n <= size:
        x = powers[-1][1]
        y = x[:-n] * np.uint64(pow(0x9E3779B97F4A7C15, n, 2**64)) + x[n:]
        y ^= y >> np.uint64(32)
        powers.append((2 * n, y))
        n *= 2
    out, done = None, 0
    for n, x in reversed(powers):
        if not size & n:
            continue
        out, done = (x, n) if out is None else (_pair(out, x, done), done + n)
    return out * MIX ^ (out * MIX >> np.uint64(29))


def _pair(x: np.ndarray, y: np.ndarray, n: int) -> np.ndarray:
    m = len(y) - n
    z = x[:m] * np.uint64(pow(0x9E3779B97F4A7C15, n, 2**64)) + y[n:]
    return z ^ (z >> np.uint64(32))


def _least_places(values: np.ndarray, width: int) -> np.ndarray:
    """Where the least of each ``width`` values is, the first of equal ones; fewer than 2**24 values."""
    low = np.uint64((1 << 24) - 1)
    key, n = (values & ~low) | np.arange(len(values), dtype=np.uint64), 1
    while 2 * n <= width:
        key = np.minimum(key[:-n], key[n:])
        n *= 2
    if width - n:
        key = np.minimum(key[: n - width], key[width - n:])
    return (key & low).astype(np.int64)


def anchors(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(core rank, place, first string, last string) of every anchor; ``bounds`` part the documents in ``data``.

    Strings are named by their first byte. The work goes over ``data`` in chunks, so a document of any length is fine;
    an anchor at a chunk's end may come twice, with some of its strings each time.
    """
    found = []
    for at in range(0, max(len(data) - LENGTH + 1, 0), CHUNK):
        part = data[at: at + CHUNK + LENGTH - 1]
        core = ranks(part)
        place = _least_places(core, LENGTH - CORE + 1)
        start = at + np.arange(len(place))
        doc = np.searchsorted(bounds, start, "right")
        new = np.append(True, (place[1:] != place[:-1]) | (doc[1:] != doc[:-1]))
        inside = start + LENGTH <= bounds[np.minimum(doc, len(bounds) - 1)]
        new[1:] |= inside[1:] != inside[:-1]
        first = np.flatnonzero(new)
        last = np.append(first[1:], len(place)) - 1
        first, last = first[inside[first]], last[inside[first]]
        found.append((core[place[first]], at + place[first], at + first, at + last))
    if not found:
        return np.zeros(0, np.uint64), *[np.zeros(0, np.int64)] * 3
    return tuple(np.concatenate(x) for x in zip(*found))


def _pack(*columns: np.ndarray) -> bytes:
    """Columns of one length as bytes: steps from row to row, all first bytes, all second bytes and so on, compressed."""
    planes = [np.diff(c, prepend=c.dtype.type(0)).view(np.uint8).reshape(len(c), -1).T.tobytes() for c in columns]
    return zstandard.ZstdCompressor(level=1).compress(b"".join(planes))


def _unpack(data: bytes, *kinds: type) -> list[np.ndarray]:
    raw, width = zstandard.ZstdDecompressor().decompress(data), sum(np.dtype(k).itemsize for k in kinds)
    n, at, out = len(raw) // width, 0, []
    for kind in kinds:
        size = np.dtype(kind).itemsize
        planes = np.frombuffer(raw, np.uint8, n * size, at).reshape(size, n)
        out.append(np.cumsum(np.ascontiguousarray(planes.T).view(kind).ravel(), dtype=kind))
        at += n * size
    return out


CELL_ROW = "cell int, direct boolean, body binary"


def _cell_rows(rows: list[tuple[int, bool, bytes]]) -> pa.RecordBatch:
    cells, direct, bodies = zip(*rows) if rows else ((), (), ())
    return pa.RecordBatch.from_arrays(
        [pa.array(cells, pa.int32()), pa.array(direct, pa.bool_()), pa.array(bodies, pa.binary())], ["cell", "direct", "body"])


def _split(cells: np.ndarray, *columns: np.ndarray) -> Iterator[tuple[int, list[np.ndarray]]]:
    order = np.argsort(cells, kind="stable")
    cells = cells[order]
    cuts = np.flatnonzero(np.append(True, cells[1:] != cells[:-1])) if len(cells) else []
    for lo, hi in zip(cuts, [*cuts[1:], len(cells)]):
        yield int(cells[lo]), [c[order[lo:hi]] for c in columns]


def _settled(columns: tuple[np.ndarray, ...], count: int) -> list[tuple[int, bool, bytes]]:
    """Rows for what needs no cell, spread over all cells in small parts."""
    step = 8192
    return [((at // step + len(columns[0])) % count, True, _pack(*[c[at: at + step] for c in columns]))
            for at in range(0, len(columns[0]), step)]


def _in_several(core: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of every row, whether its core occurs in several documents, and whether it is the first one of its core."""
    order = np.lexsort((doc, core))
    core, doc = core[order], doc[order]
    starts = np.flatnonzero(np.append(True, core[1:] != core[:-1]))
    sizes = np.diff(np.append(starts, len(core)))
    several, first = np.empty(len(core), bool), np.zeros(len(core), bool)
    several[order] = np.repeat(doc[starts] != doc[starts + sizes - 1], sizes)
    first[order[starts]] = True
    return several, first


def _first_ranks(core: np.ndarray, doc: np.ndarray, place: np.ndarray, count: int) -> pa.RecordBatch:
    """One task's anchors for the cells: of a core that it saw in several documents one stands for all."""
    several, first = _in_several(core, doc)
    place, asked = place.astype(np.uint32), first | ~several
    cells = ((core[asked] >> np.uint64(32)) % np.uint64(count)).astype(np.int64)
    rows = [(cell, False, _pack(*columns)) for cell, columns in _split(
        cells, core[asked].astype(np.uint32), doc[asked], place[asked])]
    return _cell_rows(rows + _settled((doc[several], place[several]), count))


def _buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    texts = column.to_pylist()
    return np.frombuffer(b"".join(texts), np.uint8), np.cumsum([0, *map(len, texts)])


def _repeated_cores(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Reduces cells to (doc, place) of the anchors whose core occurs in two documents."""
    for cell in groups(batches, ["cell"]):
        direct, bodies = cell.column("direct").to_pylist(), cell.column("body").to_pylist()
        done = [_unpack(b, np.int64, np.uint32) for d, b in zip(direct, bodies) if d]
        asked = [_unpack(b, np.uint32, np.int64, np.uint32) for d, b in zip(direct, bodies) if not d]
        if asked:
            core, *rest = (np.concatenate(c) for c in zip(*asked))
            several, _ = _in_several(core, rest[0])
            done.append([c[several] for c in rest])
        if done:
            doc, place = (np.concatenate(c) for c in zip(*done))
            yield pa.RecordBatch.from_arrays([pa.array(doc), pa.array(place.astype(np.int32))], ["doc", "place"])


def _met_by(context: bytes, lead: int) -> bytes:
    """What contexts must share to meet: their core, or the whole string of a hot one."""
    return context if lead == BY_STRING else context[lead: lead + CORE]


def _joined_spans(spans: list[tuple[int, int, int, int]]) -> list[tuple[int, int, int, int]]:
    """Spans of one document that touch as one."""
    out: list[tuple[int, int, int, int]] = []
    for doc, tag, start, stop in sorted(spans):
        if out and out[-1][:2] == (doc, tag) and start <= out[-1][3]:
            out[-1] = (doc, tag, out[-1][2], max(stop, out[-1][3]))
        else:
            out.append((doc, tag, start, stop))
    return out


class _Contexts:
    """One task's contexts: of equal ones those of the smallest document are asked about, the rest are settled."""

    def __init__(self, count: int):
        self.count, self.seen, self.hot, self.size = count, {}, {}, 0

    def add(self, context: bytes, lead: int, doc: int, tag: int, start: int) -> None:
        self.seen.setdefault((context, lead), []).append((doc, tag, start))
        self.size += 1

    def add_hot(self, context: bytes, lead: int, doc: int, tag: int, start: int) -> None:
        places = self.hot.setdefault((context, lead), [])
        self.size += 1 if places else len(context) - LENGTH + 1
        places.append((doc, tag, start))

    def _hot_strings(self, settled: list[tuple[int, int, int, int]]) -> dict[tuple[bytes, int], list[tuple[int, int, int]]]:
        """The strings of the hot contexts that are asked about; the others go to ``settled``."""
        strings: dict[tuple[bytes, int], list[tuple[int, int, int]]] = {}
        for (context, _), places in self.hot.items():
            least = min(places)[0]
            for doc, tag, start in places:
                if doc > least:
                    settled.append((doc, tag, start, start + len(context)))
                    continue
                for k in range(len(context) - LENGTH + 1):
                    strings.setdefault((context[k: k + LENGTH], BY_STRING), []).append((doc, tag, start + k))
        return strings

    def flush(self) -> pa.RecordBatch:
        settled, asked = [], {}
        strings = self._hot_strings(settled)
        for (context, lead), places in itertools.chain(self.seen.items(), strings.items()):
            least = min(places)[0]
            cell = zlib.crc32(_met_by(context, lead)) % self.count
            for doc, tag, start in places:
                if doc > least:
                    settled.append((doc, tag, start, start + len(context)))
                else:
                    asked.setdefault(cell, []).append((doc, tag, start, lead, len(context), context))
        if strings:
            settled = _joined_spans(settled)
        rows = []
        for cell, items in asked.items():
            doc, tag, start, lead, size, contexts = zip(*sorted(items))
            head = _pack(np.array(doc, np.int64), np.array(tag, np.uint32), np.array(start, np.uint32), np.array(lead, np.uint8),
                         np.array(size, np.uint8))
            body = zstandard.ZstdCompressor(level=LEVEL).compress(b"".join(contexts))
            rows.append((cell, False, len(head).to_bytes(4, "little") + head + body))
        if settled:
            doc, *rest = np.array(sorted(settled), np.int64).T
            rows += _settled((doc, *[c.astype(np.uint32) for c in rest]), self.count)
        self.seen, self.hot, self.size = {}, {}, 0
        return _cell_rows(rows)


def _spans_of(items: list[tuple[int, int, int, int, bytes]]) -> list[tuple[int, int, int, int]]:
    """(doc, tag, start, stop) repeated in an earlier document, from (doc, tag, start, lead, context) that share a core."""
    if min(items)[0] == max(items)[0]:
        return []
    first: dict[tuple[int, bytes], int] = {}
    for doc, _, _, lead, context in items:
        whole = (lead, context)
        first[whole] = min(doc, first.get(whole, doc))
    strings: dict[bytes, int] = {}
    for (_, context), doc in first.items():
        for k in range(len(context) - LENGTH + 1):
            string = context[k: k + LENGTH]
            if strings.get(string, doc) >= doc:
                strings[string] = doc
    out = []
    for doc, tag, start, lead, context in items:
        if first[lead, context] < doc:
            out.append((doc, tag, start, start + len(context)))
            continue
        begun = None
        for k in range(len(context) - LENGTH + 1):
            if strings[context[k: k + LENGTH]] < doc:
                begun = k if begun is None else begun
                stop = k + LENGTH
            elif begun is not None:
                out.append((doc, tag, start + begun, start + stop))
                begun = None
        if begun is not None:
            out.append((doc, tag, start + begun, start + stop))
    return out


def _repeated_strings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Reduces cells to the (doc, tag, start, stop) that are repeated; the same bytes may come more than once."""
    for cell in groups(batches, ["cell"]):
        spans, by_core = [], {}
        for direct, body in zip(cell.column("direct").to_pylist(), cell.column("body").to_pylist()):
            if direct:
                columns = _unpack(body, np.int64, np.uint32, np.uint32, np.uint32)
                spans += zip(*[c.tolist() for c in columns])
                continue
            n = int.from_bytes(body[:4], "little")
            doc, tag, start, lead, size = (
                c.tolist() for c in _unpack(body[4: 4 + n], np.int64, np.uint32, np.uint32, np.uint8, np.uint8))
            raw, at = zstandard.ZstdDecompressor().decompress(body[4 + n:]), 0
            for d, t, s, x, z in zip(doc, tag, start, lead, size):
                context = raw[at: at + z]
                by_core.setdefault(_met_by(context, x), []).append((d, t, s, x, context))
                at += z
        for items in by_core.values():
            spans += _spans_of(items)
        if spans:
            doc, tag, start, stop = np.array(spans, np.int64).T
            yield pa.RecordBatch.from_arrays(
                [pa.array(doc), pa.array(tag), pa.array(start.astype(np.int32)), pa.array(stop.astype(np.int32))],
                ["doc", "dtag", "start", "stop"])


def packed_texts(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, tag, z): the texts' bytes compressed, which is what travels when documents meet their spans.

    The tag, a checksum of the text, tells rows that share an id apart.
    """

    def squeeze(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = zstandard.ZstdCompressor(level=LEVEL)
        for batch in batches:
            bodies = [press.compress(x) for x in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(bodies, pa.binary())], ["key", "tag", "z"])

    return _bodies(docs, key, text).mapInArrow(squeeze, "key long, tag long, z binary")


def _bodies(docs: DataFrame, key: str, text: str) -> DataFrame:
    body = F.coalesce(F.col(text), F.lit("")).cast("binary")
    return docs.select(F.col(key).cast("long").alias("key"), F.crc32(body).alias("tag"), body.alias("body"))


def first_ranks(docs: DataFrame, key: str, text: str, count: int) -> DataFrame:
    """CELL_ROW: the anchors of all documents, ranked by their core."""

    def rank(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in bounded_batches(batches, 2):
            data, bounds = _buffers(batch.column(2))
            ids = batch.column(0).to_numpy()
            core, place, _, _ = anchors(data, bounds)
            doc = np.searchsorted(bounds, place, "right") - 1
            for at in range(0, len(core), FLUSH_ANCHORS):
                cut = slice(at, at + FLUSH_ANCHORS)
                held.append((core[cut], ids[doc[cut]], place[cut] - bounds[doc[cut]]))
                size += len(core[cut])
                if size >= FLUSH_ANCHORS:
                    yield _first_ranks(*(np.concatenate(c) for c in zip(*held)), count)
                    held, size = [], 0
        if size:
            yield _first_ranks(*(np.concatenate(c) for c in zip(*held)), count)

    rows = _bodies(docs, key, text)
    return rows.filter((F.length("body") >= LENGTH) & F.col("key").isNotNull()).mapInArrow(rank, CELL_ROW)


def hot_cores(docs: DataFrame, key: str, text: str) -> np.ndarray:
    """The sorted ranks of the cores with HOT_SAMPLED or more different contexts in a sample.

    Pieces are sampled, not documents, so one long document counts too. A core with many times
    SAMPLE_ONE_IN * HOT_SAMPLED contexts is all but surely among them.
    """

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, bounds = _buffers(batch.column(0))
            core, _, first, last = anchors(data, bounds)
            raw = data.tobytes()
            crc = [zlib.crc32(raw[lo: hi + LENGTH]) for lo, hi in zip(first.tolist(), last.tolist())]
            yield pa.RecordBatch.from_arrays([pa.array(core.view(np.int64)), pa.array(crc, pa.int64())], ["core", "crc"])

    picked = F.filter(F.sequence(F.lit(0), F.floor((F.length("body") - 1) / SAMPLE_PIECE).cast("int")), lambda i: F.pmod(
        F.xxhash64("key", F.length("body"), i), F.lit(SAMPLE_ONE_IN)) == 0)
    rows = _bodies(docs, key, text).select("key", "body").filter((F.length("body") >= LENGTH) & F.col("key").isNotNull())
    pieces = rows.select("body", F.explode(picked).alias("i")).select(
        F.substring("body", F.col("i") * SAMPLE_PIECE + 1, F.lit(SAMPLE_PIECE + LENGTH - 1)).alias("piece"))
    counts = pieces.mapInArrow(pairs, "core long, crc long").distinct().groupBy("core").agg(F.count(F.lit(1)).alias("n"))
    found = counts.filter(F.col("n") >= HOT_SAMPLED).select("core").toArrow().column("core").to_numpy()
    return np.sort(found.astype(np.int64).view(np.uint64))


def _among(values: np.ndarray, ordered: np.ndarray) -> np.ndarray:
    if not len(ordered):
        return np.zeros(len(values), bool)
    return ordered[np.minimum(np.searchsorted(ordered, values), len(ordered) - 1)] == values


def contexts(joined: DataFrame, count: int, hot: np.ndarray) -> DataFrame:
    """CELL_ROW from (key, tag, z, places): the contexts of the anchors at ``places``, by string where the core is ``hot``."""
    known = joined.sparkSession.sparkContext.broadcast(hot)

    def rank(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = _Contexts(count)
        for batch in batches:
            ids, tags, packed = (batch.column(c).to_pylist() for c in range(3))
            places = batch.column(3)
            unpack = zstandard.ZstdDecompressor()
            texts, begun, size = [], 0, 0
            for i in range(len(ids)):
                texts.append(unpack.decompress(packed[i]))
                size += len(texts[-1])
                if i + 1 < len(ids) and size < CHUNK:
                    continue
                data = b"".join(texts)
                bounds = np.cumsum([0, *map(len, texts)])
                wanted = np.zeros(len(data) + 1, bool)
                for k in range(len(texts)):
                    mine = places[begun + k].values.to_numpy()
                    wanted[bounds[k] + mine[mine < len(texts[k])]] = True  # rows that share an id share their places
                core, place, first, last = anchors(np.frombuffer(data, np.uint8), bounds)
                good = wanted[place]
                doc = np.searchsorted(bounds, first[good], "right") - 1
                for d, p, lo, hi, h in zip(doc.tolist(), place[good].tolist(), first[good].tolist(), last[good].tolist(),
                                           _among(core[good], known.value).tolist()):
                    add = held.add_hot if h else held.add
                    add(data[lo: hi + LENGTH], p - lo, ids[begun + d], tags[begun + d], lo - int(bounds[d]))
                    if held.size >= FLUSH_CONTEXTS:
                        yield held.flush()
                texts, begun, size = [], i + 1, 0
        if held.size:
            yield held.flush()

    return joined.select("key", "tag", "z", "places").mapInArrow(rank, CELL_ROW)


def string_cells(docs: DataFrame, key: str, text: str) -> DataFrame:
    """CELL_ROW: what is left to compare of the anchors whose core occurs in several documents, by cell."""
    total = docs.agg(F.sum(F.octet_length(text))).first()[0] or 0
    count = max(1, -(-total // CELL_BYTES))
    by_cell = lambda rows: rows.repartition("cell").sortWithinPartitions("cell")
    places = (by_cell(first_ranks(docs, key, text, count)).mapInArrow(_repeated_cores, "doc long, place int")
              .groupBy("doc").agg(F.collect_set("place").alias("places")))
    joined = packed_texts(docs, key, text).join(places, F.col("key") == F.col("doc"))
    return by_cell(contexts(joined, count, hot_cores(docs, key, text)))


def repeated_spans(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc, dtag, start, stop) in bytes of the strings that also start in an earlier document; overlaps are not merged."""
    return string_cells(docs, key, text).mapInArrow(_repeated_strings, "doc long, dtag long, start int, stop int")


def _kept(data: bytes, spans: list[dict]) -> tuple[bytes, int, int]:
    """What is left of ``data``, the removed bytes, and the number of maximal removed runs."""
    parts, at, removed, runs, stop = [], 0, 0, 0, -1
    for start, end in sorted((s["start"], s["stop"]) for s in spans):
        if start > stop:
            parts.append(data[at:start])
            runs += 1
            at = start
        if end > at:
            removed += end - at
            at = stop = end
    parts.append(data[at:])
    return b"".join(parts), removed, runs


def without_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_bytes, n_removed, n_spans, kept): one row per row of ``docs``; ``kept`` are the bytes that stay."""
    spans = (repeated_spans(docs, key, text).groupBy("doc", "dtag")
             .agg(F.collect_set(F.struct("start", "stop")).alias("spans")))
    met = (F.col("key") == F.col("doc")) & (F.col("tag") == F.col("dtag"))
    rows = packed_texts(docs, key, text).join(spans, met, "left").select("key", "z", "spans")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor()
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                texts = [unpack.decompress(z) for z in part.column(1).to_pylist()]
                kept, removed, runs = zip(*[_kept(x, s or []) for x, s in zip(texts, part.column(2).to_pylist())])
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array([len(x) for x in texts], pa.int64()), pa.array(removed, pa.int64()),
                     pa.array(runs, pa.int64()), pa.array(kept, pa.binary())], ["key", "n_bytes", "n_removed", "n_spans", "kept"])

    out = rows.mapInArrow(cut, "key long, n_bytes long, n_removed long, n_spans long, kept binary")
    return out.select(F.col("key").cast(docs.schema[key].dataType).alias(key), "n_bytes", "n_removed", "n_spans", "kept")
