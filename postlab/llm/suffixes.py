"""Two-stage suffix sorting and adjacent common prefixes, in numpy."""

from __future__ import annotations

import numpy as np

from postlab.llm.shingles import mixed


def words_at(text: np.ndarray) -> np.ndarray:
    """The 8 bytes from each position as a big-endian number; zeros behind the end."""
    padded = np.concatenate((text, np.zeros(8, np.uint8)))
    out = np.zeros(len(text), np.uint64)
    for j in range(8):
        out = (out << np.uint64(8)) | padded[j:j + len(text)]
    return out


def smaller_than_next(text: np.ndarray) -> np.ndarray:
    """True where a suffix is smaller than the suffix behind it; true for the last."""
    n = len(text)
    differs = np.flatnonzero(text[:-1] != text[1:])
    rises = text[differs] < text[differs + 1]
    at = np.searchsorted(differs, np.arange(n))
    return np.concatenate((rises, [True]))[at]


def prints_at(text: np.ndarray, length: int) -> np.ndarray:
    """A 64-bit fingerprint of the ``length`` bytes from each position, by doubling; zeros follow the end."""
    whole = np.concatenate((text, np.zeros(length, np.uint8)))
    step, h = 1, mixed(whole.astype(np.uint64) + np.uint64(1))
    out, at = np.zeros(len(text), np.uint64), 0
    while step <= length:
        if length & step:
            out = mixed(out ^ (h[at:at + len(text)] + np.uint64(step)))
            at += step
        h = mixed(h[:-step] * np.uint64(0x9E3779B97F4A7C15) + h[step:]) if len(h) > step else h
        step *= 2
    return out


def sort_directly(starts: np.ndarray, words: np.ndarray, prints: np.ndarray, depth: int) -> np.ndarray:
    """Starts ordered by the ``depth`` bytes from each: 8 at a time, and again only what is still tied.

    ``prints``: fingerprints of those bytes. A group in which all agree has nothing left to order.
    """
    order = starts[np.argsort(words[starts], kind="stable")]
    first = words[order]
    new = np.concatenate(([True], first[1:] != first[:-1]))
    n = len(words)
    tied = np.flatnonzero(~(new & np.concatenate((new[1:], [True]))))           # places in groups of two and more
    for done in range(8, depth, 8):
        if not len(tied):
            break
        group = np.cumsum(new[tied])
        same = np.concatenate(([False], group[1:] == group[:-1]))
        unlike = same & np.concatenate(([False], np.diff(prints[order[tied]].view(np.int64)) != 0))
        open_group = np.zeros(int(group[-1]) + 1, bool)
        open_group[group[unlike]] = True
        keep = open_group[group]
        tied, group = tied[keep], group[keep]
        if not len(tied):
            break
        at = order[tied] + done
        key = np.where(at < n, words[np.minimum(at, n - 1)], np.uint64(0))
        same = np.concatenate(([False], group[1:] == group[:-1]))
        differs = same & np.concatenate(([False], key[1:] != key[:-1]))
        if not differs.any():
            continue
        # sort just the groups in which something differs
        moving_group = np.zeros(int(group[-1]) + 1, bool)
        moving_group[group[differs]] = True
        moving = moving_group[group]
        own = tied[moving]
        rank = np.lexsort((key[moving], group[moving]))
        order[own] = order[own][rank]
        sorted_key, sorted_group = key[moving][rank], group[moving][rank]
        new[own] |= np.concatenate(([True], (sorted_key[1:] != sorted_key[:-1]) | (sorted_group[1:] != sorted_group[:-1])))
        tied = tied[~(new[tied] & new[np.minimum(tied + 1, len(new) - 1)] & (tied + 1 < len(new)))]
    return order


def suffix_array(text: np.ndarray, wanted: np.ndarray, words: np.ndarray, prints: np.ndarray, depth: int) -> np.ndarray:
    """The wanted suffixes, ordered by at least their first ``depth`` bytes. The last byte is the smallest, 0.

    Only suffixes smaller than their successors are sorted directly. The others are induced: the buckets of first bytes
    are scanned upwards, and each suffix found puts the one before it, if that is larger, at the next free
    place of its bucket. A bucket's larger suffixes stand before its smaller ones. Scans go a stretch at a time.
    A suffix that isn't wanted takes part where a wanted one is induced from it.
    """
    n = len(text)
    small = smaller_than_next(text)
    # up to the first small one behind it, each suffix is induced from its successor
    small_at = np.flatnonzero(small)
    needed = wanted.copy()
    wanted_at = np.flatnonzero(wanted)
    source = small_at[np.searchsorted(small_at, wanted_at)]
    change = np.zeros(n + 1, np.int64)
    np.add.at(change, wanted_at, 1)
    np.add.at(change, source + 1, -1)
    needed = np.cumsum(change[:-1]) > 0
    sizes = np.bincount(text[needed], minlength=256)
    out = np.zeros(int(sizes.sum()), np.int64)
    heads = np.cumsum(sizes) - sizes
    chosen = small & needed
    smalls = np.bincount(text[chosen], minlength=256)
    ordered = sort_directly(np.flatnonzero(chosen), words, prints, depth)
    from_small = np.cumsum(smalls) - smalls
    free = heads.copy()

    def induce(found: np.ndarray) -> None:
        before = found[found > 0] - 1
        before = before[~small[before] & needed[before]]
        chars = text[before]
        rank = np.argsort(chars, kind="stable")
        before, chars = before[rank], chars[rank]
        cuts = np.flatnonzero(np.concatenate(([True], chars[1:] != chars[:-1]))) if len(chars) else []
        for a, b in zip(cuts, [*cuts[1:], len(chars)]):
            c = chars[a]
            out[free[c]:free[c] + b - a] = before[a:b]
            free[c] += b - a

    for c in np.flatnonzero(sizes):
        done = heads[c]
        while done < free[c]:
            end = free[c]
            induce(out[done:end])
            done = end
        own = ordered[from_small[c]:from_small[c] + smalls[c]]
        out[heads[c] + sizes[c] - smalls[c]:heads[c] + sizes[c]] = own
        induce(own)
    return out[wanted[out]]


def equal_to_previous(order: np.ndarray, prints: np.ndarray) -> np.ndarray:
    """Whether each suffix shares a prefix of the fingerprints' length with the one before it."""
    return np.concatenate(([False], prints[order[1:]] == prints[order[:-1]])) if len(order) else np.zeros(0, bool)
