"""WARC archives in Zstandard with an embedded dictionary.

A dictionary is built from archived records; each archive begins with it in a skippable frame and holds one frame
per record, so a reader needs nothing but the file and can start at any frame. Payloads that occurred before are
written as revisit records. Spark's text writer commits the files: it puts an empty skippable frame between the
records where lines would have their separator, so a lost executor leaves no partial archive.

Defined cases: a null payload is an empty one; a null url is left out; control characters in a url are
percent-encoded. Rows that repeat both the smallest id and the payload are each a response; a null id is never the
smallest, and a payload that only rows without id have is a response each time. A very long payload is one frame like
any other. An empty table makes no archive. Only page_id, url and html are read, so other columns may have any names.
"""

from __future__ import annotations

import base64
import hashlib
import re
import struct
from collections.abc import Iterator

import pandas as pd
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from postsift.session import scratch_path

# Fixed values of the Zstandard and WARC formats.
SKIPPABLE, DICTIONARY = 0x184D2A50, 0x184D2A5D
NO_RECORD = "P*M\x18\x00\x00\x00\x00"  # an empty skippable frame
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

#: Bytes of records that a dictionary is built from, and what a record's headers take.
SAMPLE_BYTES = 8 << 20
HEADER_BYTES = 512
DICTIONARY_BYTES = 64 << 10
LEVEL = 6
DATE = "2024-01-01T00:00:00Z"

RECORDS = T.StructType([
    T.StructField("page_id", T.LongType()), T.StructField("uri", T.StringType()),
    T.StructField("record_type", T.StringType()), T.StructField("payload_bytes", T.LongType()),
    T.StructField("payload_digest", T.StringType()), T.StructField("refers_to", T.LongType()),
    T.StructField("payload", T.BinaryType())])


def mark_revisits(pages: DataFrame, least: int = 0) -> DataFrame:
    """(page_id, url, payload, sha1, first_id): ``first_id`` is the page whose response holds this page's payload, if another.

    Only ids and digests take part in finding copies; the marks come back to the pages by id and digest, so that one
    payload which very many pages share is no key that their texts meet under.
    """
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url",
                        F.coalesce(F.col("html"), F.lit("")).cast("binary").alias("payload"))
    rows = rows.withColumn("sha1", F.sha1("payload"))
    narrow = rows.filter(F.length("payload") >= least).groupBy("page_id", "sha1").agg(F.count(F.lit(1)).alias("n"))
    first = (narrow.groupBy("sha1").agg(F.min("page_id").alias("first_id"), F.sum("n").alias("n"))
             .filter((F.col("n") > 1) & F.col("first_id").isNotNull()).select(F.col("sha1").alias("__sha1"), "first_id"))
    marks = (narrow.join(first, F.col("sha1") == F.col("__sha1")).filter(~F.col("page_id").eqNullSafe(F.col("first_id")))
             .select(F.col("page_id").alias("__id"), "__sha1", "first_id"))
    return rows.join(marks, F.col("page_id").eqNullSafe(F.col("__id")) & (F.col("sha1") == F.col("__sha1")), "left").drop("__id", "__sha1")


def build_dictionary(pages: DataFrame, size: int = DICTIONARY_BYTES, sample: int = SAMPLE_BYTES) -> bytes:
    """A dictionary from whole records, headers and payload, of a sample by hash; b"" if it is too small to train on.

    The share to sample comes from the number and size of all pages, so that about half of ``sample`` bytes reach the
    driver, and never more than ``sample``. Records over 1/16 of it, which would fill the dictionary alone, are not drawn.
    """
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url",
                        F.coalesce(F.col("html"), F.lit("")).cast("binary").alias("payload"))
    rows = rows.withColumn("bytes", F.length("payload") + F.coalesce(F.octet_length("url"), F.lit(0)) + HEADER_BYTES)
    rows = rows.filter(F.col("bytes") <= sample // 16)
    whole = rows.agg(F.sum("bytes")).first()[0]
    if not whole:
        return b""
    draw, limit = F.pmod(F.xxhash64("page_id", "url"), F.lit(1 << 40)), min(1 << 40, (sample << 39) // whole)
    while rows.filter(draw < limit).agg(F.coalesce(F.sum("bytes"), F.lit(0))).first()[0] > sample:
        limit //= 2
    drawn = rows.filter(draw < limit).select("page_id", "url", "payload", F.sha1("payload")).collect()
    samples = [record(r[0], r[1], bytes(r[2]), r[3], None) for r in drawn]
    size = min(size, sum(map(len, samples)) // 8)
    if len(samples) < 16 or size < 1024:
        return b""
    return zstandard.train_dictionary(size, samples).as_bytes()


def _header(fields: dict[str, str | int]) -> bytes:
    return "".join(f"{k}: {v}\r\n" for k, v in fields.items()).encode()


def _page(page_id: float | int | None) -> str:
    return f"<urn:x-page:{'' if pd.isna(page_id) else int(page_id)}>"


def record(page_id: int | None, url: str | None, payload: bytes, sha1: str, first_id: int | None) -> bytes:
    """One WARC record: a response with the payload, or a revisit that names the page with the same one."""
    revisit = not pd.isna(first_id)
    http = b"HTTP/1.1 200 OK\r\n" + _header({"Content-Type": "text/html; charset=utf-8", "Content-Length": len(payload)}) + b"\r\n"
    block = http if revisit else http + payload
    fields = {"WARC-Type": "revisit" if revisit else "response", "WARC-Record-ID": _page(page_id), "WARC-Date": DATE}
    if url is not None:
        fields["WARC-Target-URI"] = re.sub(r"[\x00-\x1f\x7f]", lambda c: f"%{ord(c[0]):02X}", url)
    fields["WARC-Payload-Digest"] = "sha1:" + base64.b32encode(bytes.fromhex(sha1)).decode()
    if revisit:
        fields |= {"WARC-Refers-To": _page(first_id), "WARC-Profile": PROFILE}
    fields |= {"Content-Type": "application/http;msgtype=response", "Content-Length": len(block)}
    return b"WARC/1.1\r\n" + _header(fields) + b"\r\n" + block + b"\r\n\r\n"


def write_archives(marked: DataFrame, dictionary: bytes, path: str, level: int = LEVEL) -> None:
    """Archives below ``path``, one per partition of ``marked`` that has rows."""

    def frames(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        trained = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
        press = zstandard.ZstdCompressor(level=level, dict_data=trained, write_checksum=True)
        begun = not dictionary
        for batch in batches:
            out = [press.compress(record(*row)) for row in batch.itertuples(index=False, name=None)]
            if out and not begun:
                out.insert(0, struct.pack("<II", DICTIONARY, len(dictionary)) + dictionary)
                begun = True
            yield pd.DataFrame({"frame": out})

    rows = marked.select("page_id", "url", "payload", "sha1", "first_id").mapInPandas(frames, "frame binary")
    rows.select(F.col("frame").cast("string").alias("value")).write.text(path, lineSep=NO_RECORD)


def frames_of(data: bytes, block: int = 1 << 16) -> Iterator[bytes]:
    """The unpacked records of one archive, in order."""
    view, at, reader = memoryview(data), 0, zstandard.ZstdDecompressor()
    while at < len(view):
        magic, size = struct.unpack_from("<II", view, at)
        if magic & 0xFFFFFFF0 == SKIPPABLE:
            if magic == DICTIONARY:
                reader = zstandard.ZstdDecompressor(zstandard.ZstdCompressionDict(bytes(view[at + 8: at + 8 + size])))
            at += 8 + size
            continue
        unpack, parts = reader.decompressobj(), []
        while not unpack.eof:
            if at >= len(view):
                raise ValueError("the archive ends within a record")
            parts.append(unpack.decompress(view[at: at + block]))
            at = min(at + block, len(view))
        at -= len(unpack.unused_data)
        yield b"".join(parts)


def _fields(head: bytes) -> dict[str, str]:
    return dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:] if line)


def _page_of(urn: str | None) -> int | None:
    number = (urn or "").removeprefix("<urn:x-page:").removesuffix(">")
    return int(number) if number else None


def parse_record(data: bytes) -> tuple:
    """A row of RECORDS; a response whose payload is not what its headers say is an error."""
    head, _, rest = data.partition(b"\r\n\r\n")
    fields = _fields(head)
    http, _, payload = rest[: int(fields["Content-Length"])].partition(b"\r\n\r\n")
    kind, digest = fields["WARC-Type"], fields["WARC-Payload-Digest"].removeprefix("sha1:")
    size = int(_fields(http)["Content-Length"])
    if kind == "response" and (len(payload) != size or base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest):
        raise ValueError(f"{fields['WARC-Record-ID']}: the payload differs from its digest")
    return (_page_of(fields["WARC-Record-ID"]), fields.get("WARC-Target-URI"), kind, size, digest,
            _page_of(fields.get("WARC-Refers-To")), payload if kind == "response" else None)


def read_archives(spark: SparkSession, path: str, with_payload: bool = True) -> DataFrame:
    """RECORDS of all archives below ``path``, each verified against its digest."""
    names = RECORDS.names if with_payload else RECORDS.names[:-1]

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for data in batch["content"]:
                chunk: list[tuple] = []
                for found in map(parse_record, frames_of(data)):
                    chunk.append(found[: len(names)])
                    if len(chunk) == 256:
                        yield _frame(chunk, names)
                        chunk = []
                yield _frame(chunk, names)

    files = spark.read.format("binaryFile").load(path).select("content")
    return files.mapInPandas(rows, T.StructType([RECORDS[n] for n in names]))


def _frame(rows: list[tuple], names: list[str]) -> pd.DataFrame:
    out = pd.DataFrame(rows, columns=names)
    return out.astype({"page_id": "Int64", "refers_to": "Int64", "payload_bytes": "int64"})


def archive(pages: DataFrame, least: int = 0, level: int = LEVEL, with_payload: bool = True) -> DataFrame:
    """Writes every page to archives in the shared folder and returns what reading them back gives."""
    spark = pages.sparkSession
    path = scratch_path(spark, "warc")
    write_archives(mark_revisits(pages, least), build_dictionary(pages), path, level)
    return read_archives(spark, path, with_payload)
