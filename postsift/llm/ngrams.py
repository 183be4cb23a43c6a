"""Words of many texts as a dictionary and indices, and character n-grams of words, in numpy."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc


@dataclass
class Words:
    """Occurrences in order: ``names[which[begins[i]:begins[i + 1]]]`` are the words of text i."""

    names: np.ndarray
    which: np.ndarray
    begins: np.ndarray


def plain(texts: pa.Array, kept: str = r"\pL\pN") -> pa.Array:
    """Lower-cased texts with a blank for every run of characters outside ``kept``; null is empty."""
    return pc.replace_substring_regex(pc.utf8_lower(pc.fill_null(texts, "")), f"[^{kept}]+", " ")


def words_of(texts: pa.Array, kept: str = r"\pL\pN") -> Words:
    lists = pc.ascii_split_whitespace(plain(texts, kept))
    bounds = lists.offsets.to_numpy()
    coded = lists.values.slice(bounds[0], bounds[-1] - bounds[0]).dictionary_encode()
    names, which = coded.dictionary.to_numpy(zero_copy_only=False), coded.indices.to_numpy()
    real = names[which] != "" if len(which) else np.zeros(0, bool)
    ends = np.concatenate([[0], np.cumsum(real)])
    return Words(names, which[real], ends[bounds - bounds[0]])


def char_ngrams(names: np.ndarray, low: int, high: int, buckets: int, whole: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """(word, bucket) of every n-gram of each word with its ends marked, and of the whole word if asked for."""
    if not len(names):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    marked = [f"<{w}>" for w in names]
    sizes = np.array([len(w) for w in marked])
    chars = np.frombuffer("".join(marked).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    owner = np.repeat(np.arange(len(names)), sizes)
    left = np.repeat(np.cumsum(sizes), sizes) - np.arange(len(chars))  # characters up to the word's end
    owners, hashes = [], []
    for n in range(low, high + 1):
        value = np.full(max(len(chars) - n + 1, 0), n, np.uint64)
        for k in range(n):
            value *= np.uint64(0x9E3779B97F4A7C15)
            value += chars[k: k + len(value)]
            value ^= value >> np.uint64(29)
        fits = left[: len(value)] >= n
        owners.append(owner[: len(value)][fits])
        hashes.append(value[fits])
    if whole:
        owners.append(np.arange(len(names)))
        hashes.append(pd.util.hash_array(names.astype(object), categorize=False))
    mixed = np.concatenate(hashes) * np.uint64(0xD6E8FEB86659FD93)
    return np.concatenate(owners), ((mixed >> np.uint64(32)) % np.uint64(buckets)).astype(np.int64)


def summed(values: np.ndarray, begins: np.ndarray) -> np.ndarray:
    """Sums of ``values`` over each range of ``begins``."""
    ends = np.concatenate([[0.0], np.cumsum(values, dtype=np.float64)])
    return ends[begins[1:]] - ends[begins[:-1]]
