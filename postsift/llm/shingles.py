"""Words of many texts as 64-bit codes, and hashes of word windows, in numpy."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc

BASE = np.uint64(0x9E3779B97F4A7C15)


def word_codes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Codes of all words one after the other, and where each text begins in them (one entry more than texts).

    A word is a run without ASCII white space; a null text has none.
    """
    lists = pc.ascii_split_whitespace(pc.fill_null(texts, ""))
    bounds = lists.offsets.to_numpy()
    coded = lists.values.slice(bounds[0], bounds[-1] - bounds[0]).dictionary_encode()
    names = coded.dictionary.to_numpy(zero_copy_only=False)
    codes = pd.util.hash_array(names, categorize=False) if len(names) else np.zeros(0, np.uint64)
    which = coded.indices.to_numpy()
    real = names[which] != "" if len(which) else np.zeros(0, bool)
    ends = np.concatenate([[0], np.cumsum(real)])
    return codes[which[real]] if len(which) else np.zeros(0, np.uint64), ends[bounds - bounds[0]]


def windows(codes: np.ndarray, size: int) -> np.ndarray:
    """A Karp-Rabin hash (modulo 2**64, mixed) of every run of ``size`` codes, one per start."""
    n = len(codes) - size + 1
    if n < 1:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for k in range(size):
        out *= BASE
        out += codes[k: k + n]
    out ^= out >> np.uint64(31)
    out *= np.uint64(0xBF58476D1CE4E5B9)
    out ^= out >> np.uint64(29)
    return out


def shingle_set(codes: np.ndarray, size: int) -> np.ndarray:
    """The sorted distinct shingles of one text; a text shorter than a shingle has its whole as the only one."""
    return np.unique(windows(codes, min(size, len(codes)))) if len(codes) else np.zeros(0, np.uint64)
