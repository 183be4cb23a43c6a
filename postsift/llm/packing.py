"""Packing by power-of-two decomposition.

A document of n tokens is cut into pieces whose lengths are the powers of two in n (whole ``max_len`` pieces first,
then the binary digits of the rest, largest first). Every piece is a training sequence of its own, filed in the
bucket of its length: no sequence crosses documents and none needs padding.

Defined cases: a null or empty text is the end-of-document id alone. Repeated rows are packed row by row, and a null
key stays null. Only the key and the text are read, so other columns may have any names.
"""

from __future__ import annotations

import os
import re
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from postsift.llm.batches import bounded_batches

MAX_LEN = 2048
END_ID = 1
CACHED_WORDS = 200_000


def piece_lengths(n: int, max_len: int = MAX_LEN) -> list[int]:
    """Powers of two that add up to ``n``, largest first, none over ``max_len`` (itself a power of two)."""
    rest = n % max_len
    return [max_len] * (n // max_len) + [1 << b for b in range(max_len.bit_length() - 1, -1, -1) if rest >> b & 1]


class WordTokenizer:
    """Token ids of whole texts through the ids of their words.

    For tokenizers that lower case, drop white space and cut signs from letters, a text's ids are those of its words
    in order, so each different word is encoded once. The cache only saves time; it is emptied when it holds
    ``limit`` words.
    """

    #: Texts in which a sign could join a letter or spell a special token are only cut at white space.
    DELICATE = r"<\||\pM|\x{130}"
    #: Words that normalizing and cutting leave as they are; the model can be asked at once.
    SIMPLE = re.compile("[a-zß-öø-ÿ]+").fullmatch

    def __init__(self, path: str, limit: int = CACHED_WORDS):
        from tokenizers import Tokenizer, pre_tokenizers

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        self.model, self.limit = Tokenizer.from_file(path), limit
        self.known: dict[str, bytes] = {}
        self.spelled = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)

    def _ids(self, words: list[str]) -> list[bytes]:
        if len(self.known) > self.limit:
            self.known = {}
        merge, rest = self.model.model.tokenize, []
        for word in words:
            if word not in self.known:
                if self.SIMPLE(word):
                    letters = word if word.isascii() else self.spelled.pre_tokenize_str(word)[0][0]
                    self.known[word] = array("I", [t.id for t in merge(letters)]).tobytes()
                else:
                    rest.append(word)
        for word, coded in zip(rest, self.model.encode_batch_fast(rest, add_special_tokens=False), strict=True):
            self.known[word] = array("I", coded.ids).tobytes()
        return [self.known[w] for w in words]

    def _simpler(self, texts: pa.Array) -> pa.Array:
        """The texts with fewer different words and the same ids: capitals lowered, an end sign apart from its word."""
        delicate = pc.match_substring_regex(texts, self.DELICATE)
        plain = pc.replace_substring_regex(pc.ascii_lower(texts), r"(\pL)([.,!?;:])(\s|$)", r"\1 \2\3")
        return pc.if_else(delicate, texts, plain)

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids one after the other, and where each text begins in them (one entry more than texts)."""
        lists = pc.ascii_split_whitespace(self._simpler(pc.fill_null(texts, "")))
        bounds = lists.offsets.to_numpy()
        coded = lists.values.slice(bounds[0], bounds[-1] - bounds[0]).dictionary_encode()
        ids = self._ids(coded.dictionary.to_pylist())
        sizes = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
        flat = np.frombuffer(b"".join(ids), np.uint32)
        which = coded.indices.to_numpy()
        taken = sizes[which]
        ends = np.concatenate([[0], np.cumsum(taken)])
        at = np.repeat((np.cumsum(sizes) - sizes)[which] - ends[:-1], taken) + np.arange(ends[-1])
        return flat[at], ends[bounds - bounds[0]]


@lru_cache(maxsize=1)
def worker_tokenizer(path: str) -> WordTokenizer:
    """One per Python worker, so that later tasks find the words of earlier ones."""
    return WordTokenizer(path)


def _pieces(batch: pa.RecordBatch, coder: WordTokenizer, max_len: int, end_id: int) -> pa.RecordBatch:
    ids, begins = coder.encode(batch.column(1))
    data, end = memoryview(ids.astype("<u4").tobytes()), np.array([end_id], "<u4").tobytes()
    row, start, length, total, packed = [], [], [], [], []
    for i in range(batch.num_rows):
        tokens = bytes(data[4 * begins[i]: 4 * begins[i + 1]]) + end
        at = 0
        for size in piece_lengths(len(tokens) // 4, max_len):
            row.append(i)
            start.append(at)
            length.append(size)
            total.append(len(tokens) // 4)
            packed.append(tokens[4 * at: 4 * (at + size)])
            at += size
    return pa.RecordBatch.from_arrays(
        [batch.column(0).take(pa.array(row, pa.int64())), pa.array(start, pa.int64()), pa.array(length, pa.int64()),
         pa.array(total, pa.int64()), pa.array(packed, pa.binary())], ["key", "start", "length", "doc_tokens", "ids"])


def pack(docs: DataFrame, tokenizer_file: str, key: str = "doc_id", text: str = "text", max_len: int = MAX_LEN,
         end_id: int = END_ID) -> DataFrame:
    """(key, start, length, doc_tokens, ids, bucket, sequence_id, offset): one row per piece.

    ``ids`` are little-endian unsigned 32-bit token ids; ``bucket`` is the power of two of the length, by which a
    loader batches; ``sequence_id`` is unique per piece, as each piece is a sequence. ``tokenizer_file`` is a path that
    every executor has. The texts are neither shuffled nor gathered.
    """
    if max_len & (max_len - 1):
        raise ValueError("max_len must be a power of two")
    kind = docs.schema[key].dataType
    schema = T.StructType([T.StructField("key", kind), *[T.StructField(n, T.LongType()) for n in ("start", "length", "doc_tokens")],
                           T.StructField("ids", T.BinaryType())])

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = worker_tokenizer(tokenizer_file)
        for batch in bounded_batches(batches):
            yield _pieces(batch, coder, max_len, end_id)

    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInArrow(packed, schema)
    return rows.select(F.col("key").alias(key), "start", "length", "doc_tokens", "ids",
                       (F.length(F.bin("length")) - 1).alias("bucket"),
                       F.monotonically_increasing_id().alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
