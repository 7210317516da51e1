"""Suffix arrays and permuted common prefixes of one shard, as array operations.

The shard is a sequence of small integers that ends in a 0 found nowhere else.
Induced sorting goes bucket by bucket; all suffixes of a bucket induce their
predecessors at once, and a bucket that feeds itself (runs of one symbol) takes
one wave for each further symbol of the run.
"""

from __future__ import annotations

import numpy as np

from playseq.llm.text import Rolling

_NAMES = Rolling(21)


def rank_doubling(symbols: np.ndarray) -> np.ndarray:
    """The suffix array of integers, by doubling the compared length; only ties are sorted again."""
    n = len(symbols)
    order = np.argsort(symbols, kind="stable")
    ordered = symbols[order]
    places = np.arange(n)
    new = np.ones(n, bool)
    new[1:] = ordered[1:] != ordered[:-1]
    group = np.maximum.accumulate(np.where(new, places, 0))
    rank = np.empty(n, np.int64)
    rank[order] = group
    reach = 1
    while True:
        tied = np.flatnonzero(~(new & np.append(new[1:], True)))
        if not len(tied):
            return order
        suffix = order[tied]
        after = suffix + reach
        key = group[tied] * (n + 1) + np.where(after < n, rank[np.minimum(after, n - 1)] + 1, 0)
        by_key = np.argsort(key, kind="stable")
        suffix, key = suffix[by_key], key[by_key]
        order[tied] = suffix
        new[tied[1:]] = key[1:] != key[:-1]
        group[tied] = np.maximum.accumulate(np.where(new[tied], tied, 0))
        rank[suffix] = group[tied]
        reach *= 2


def _is_smaller(s: np.ndarray) -> np.ndarray:
    """Which suffixes are smaller than the next one; the last counts as smaller."""
    n = len(s)
    differs = np.append(s[1:] != s[:-1], True)
    decided = np.minimum.accumulate(np.where(differs, np.arange(n), n)[::-1])[::-1]
    up = np.append(s[1:] > s[:-1], True)
    return up[decided]


def _append(sa, fill, symbols, suffixes, step) -> None:
    """Put suffixes into the buckets of their symbols, in order, from `fill` on in direction `step`."""
    by = np.argsort(symbols, kind="stable")
    ordered = symbols[by]
    present, first, counts = np.unique(ordered, return_index=True, return_counts=True)
    within = np.arange(len(by)) - np.repeat(first, counts)
    sa[fill[ordered] + step * within] = suffixes[by]
    fill[present] += step * counts


def _induce(s, smaller, heads, tails, seeds) -> np.ndarray:
    """Sort all suffixes from leftmost-smaller ones given in the order of their buckets."""
    n = len(s)
    sa = np.full(n, -1, np.int64)
    fill = tails - 1
    _append(sa, fill, s[seeds[::-1]], seeds[::-1], -1)
    seeded = fill + 1
    fill = heads.copy()
    used = np.flatnonzero(tails > heads)
    for c in used:  # larger suffixes, smallest bucket first
        at, out = heads[c], []
        while at < fill[c]:
            wave = sa[at : fill[c]] - 1
            at = fill[c]
            wave = wave[wave >= 0]
            wave = wave[~smaller[wave]]
            same = s[wave] == c
            if same.any():
                again = wave[same]
                sa[at : at + len(again)] = again
                fill[c] = at + len(again)
                wave = wave[~same]
            out.append(wave)
        wave = sa[seeded[c] : tails[c]] - 1
        wave = wave[wave >= 0]
        out.append(wave[~smaller[wave]])
        out = np.concatenate(out)
        if len(out):
            _append(sa, fill, s[out], out, 1)
    larger_end = fill
    fill = tails - 1
    for c in used[::-1]:  # smaller suffixes, largest bucket first
        if c == 0:
            continue
        at, out = tails[c] - 1, []
        while at > fill[c]:
            wave = sa[fill[c] + 1 : at + 1][::-1] - 1
            at = fill[c]
            wave = wave[wave >= 0]
            wave = wave[smaller[wave]]
            same = s[wave] == c
            if same.any():
                again = wave[same]
                sa[at - len(again) + 1 : at + 1] = again[::-1]
                fill[c] = at - len(again)
                wave = wave[~same]
            out.append(wave)
        wave = sa[heads[c] : larger_end[c]][::-1] - 1
        wave = wave[wave >= 0]
        out.append(wave[smaller[wave]])
        out = np.concatenate(out)
        if len(out):
            _append(sa, fill, s[out], out, -1)
    sa[0] = n - 1
    return sa


def suffix_array(s: np.ndarray) -> np.ndarray:
    """Induced sorting of a sequence of small integers that ends in its only 0.

    The names of the leftmost-smaller substrings form the shorter sequence whose suffixes
    are sorted first. Names are too many for buckets, so that level uses rank doubling.
    """
    n = len(s)
    if n < 2:
        return np.zeros(n, np.int64)
    smaller = _is_smaller(s)
    leftmost = np.flatnonzero(smaller[1:] & ~smaller[:-1]) + 1
    counts = np.bincount(s)
    tails = np.cumsum(counts)
    heads = tails - counts
    sa = _induce(s, smaller, heads, tails, leftmost)

    is_leftmost = np.zeros(n, bool)
    is_leftmost[leftmost] = True
    ordered = sa[is_leftmost[sa]]
    end = np.empty(n, np.int64)
    end[leftmost] = np.append(leftmost[1:] + 1, n)
    prefix = _NAMES.prefix(s.astype(np.uint64) + np.uint64(1))
    content = _NAMES.between(prefix, ordered, end[ordered])
    names = np.zeros(len(ordered), np.int64)
    names[1:] = np.cumsum(content[1:] != content[:-1])
    if names[-1] + 1 < len(names):
        name_of = np.empty(n, np.int64)
        name_of[ordered] = names
        ordered = leftmost[rank_doubling(name_of[leftmost])]
    return _induce(s, smaller, heads, tails, ordered)


def permuted_common_prefixes(s: np.ndarray, sa: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each suffix, in text order: its predecessor in the suffix array, and their common prefix.

    Only suffixes whose left neighbours differ are compared; elsewhere the length is one
    less than that of the suffix before.
    """
    n = len(s)
    before = np.empty(n, np.int64)
    before[sa[1:]] = sa[:-1]
    before[sa[0]] = -1
    place = np.arange(n)
    compared = (before <= 0) | (place == 0)
    rest = ~compared
    compared[rest] = s[place[rest] - 1] != s[before[rest] - 1]
    length = np.zeros(n, np.int64)
    todo = np.flatnonzero(compared & (before >= 0))
    wide = np.zeros(n + 8, np.uint64)
    for k in range(min(4, n)):  # four symbols of 16 bits side by side
        wide[: n - k] |= s[k:].astype(np.uint64) << np.uint64(16 * k)
    while len(todo):
        a, b = todo + length[todo], before[todo] + length[todo]
        same = wide[a] ^ wide[b]
        equal = same == 0
        found = todo[~equal]
        low = same[~equal]
        length[found] += (
            ((low & np.uint64(0xFFFF)) == 0).astype(np.int64)
            + ((low & np.uint64(0xFFFFFFFF)) == 0)
            + ((low & np.uint64(0xFFFFFFFFFFFF)) == 0)
        )
        todo = todo[equal]
        length[todo] += 4
    last = np.maximum.accumulate(np.where(compared, place, 0))
    return before, length[last] + last - place
