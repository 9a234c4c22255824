"""Words and word shingles of whole texts as 64-bit hashes, in Arrow batches."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc

_A, _B, _C = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mixed(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit numbers (the finishing step of SplitMix64)."""
    x = (x ^ (x >> np.uint64(30))) * _B
    x = (x ^ (x >> np.uint64(27))) * _C
    return x ^ (x >> np.uint64(31))


def word_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words in order, A-Z lowered, and the words per text. Null has none."""
    texts = pc.ascii_lower(pc.fill_null(texts.cast(pa.large_string()), ""))
    lists = pc.ascii_split_whitespace(texts)
    words, owner = lists.flatten(), np.asarray(pc.list_parent_indices(lists))
    real = pc.not_equal(words, "")
    encoded = words.filter(real).dictionary_encode()
    known = pd.util.hash_array(encoded.dictionary.to_numpy(zero_copy_only=False), categorize=False).astype(np.uint64)
    counts = np.bincount(owner[np.asarray(real)], minlength=len(texts))
    if not len(known):
        return np.zeros(0, np.uint64), counts
    return known[np.asarray(encoded.indices)], counts


def shingle_sets(texts: pa.Array, width: int = 5) -> list[np.ndarray]:
    """Per text its distinct shingles, as ascending hashes; with fewer words than ``width`` all words as one."""
    words, counts = word_hashes(texts)
    ends = np.cumsum(counts)
    n = max(len(words) - width + 1, 0)
    rolled = np.zeros(n, np.uint64)
    for k in range(width):
        rolled = rolled * _A + words[k:k + n]
    rolled = mixed(rolled)
    out = []
    for a, b in zip((ends - counts).tolist(), ends.tolist()):
        if b - a >= width:
            out.append(np.unique(rolled[a:b - width + 1]))
        elif b > a:
            short = np.array([b - a], np.uint64)
            for w in words[a:b]:
                short = short * _A + w
            out.append(mixed(short ^ _C))
        else:
            out.append(np.zeros(0, np.uint64))
    return out
