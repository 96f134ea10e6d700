"""Suffix arrays by induced sorting and permuted common prefixes, in numpy.

Suffixes are classified S or L; the leftmost S suffixes of each run (LMS) are sorted
first, the L suffixes are induced from them by a scan up the buckets and the S suffixes
by a scan down. A bucket is scanned in waves, all suffixes that stand in it at a time,
which keeps the work linear and in whole arrays. LMS substrings are sorted by the same
induction and named; where names repeat, the string of names is sorted by doubling its
ranks, which is what takes the place of the scan where there are as many buckets as names.
"""

from __future__ import annotations

import numpy as np


def _classify(t: np.ndarray) -> np.ndarray:
    """True for S suffixes. The last symbol of t must be its least and occur once."""
    n = len(t)
    step = np.flatnonzero(t[1:] != t[:-1])  # equal symbols are of the kind of the next unequal pair
    s = np.ones(n, bool)
    if len(step):
        at = np.searchsorted(step, np.arange(n - 1))
        s[: n - 1] = t[step[at]] < t[step[at] + 1]
    return s


def _induce(t: np.ndarray, is_s: np.ndarray, lms: np.ndarray, symbols: int) -> np.ndarray:
    """The suffix array that follows from the LMS suffixes in the order given."""
    n = len(t)
    size = np.bincount(t, minlength=symbols)
    head = np.concatenate([[0], np.cumsum(size)[:-1]])
    tail = np.cumsum(size)
    sa = np.full(n, -1, np.int64)
    by = t[lms]
    group = np.bincount(by, minlength=symbols)
    first = np.concatenate([[0], np.cumsum(group)])
    lms = lms[np.argsort(by, kind="stable")]
    now = head.copy()
    for c in range(symbols):  # L suffixes, up
        if not size[c]:
            continue
        done, seeds = head[c], lms[first[c] : first[c + 1]]
        while True:
            wave = sa[done : now[c]]
            done = now[c]
            if not len(wave):
                if seeds is None:
                    break
                wave, seeds = seeds, None
            before = wave[wave > 0] - 1
            before = before[~is_s[before]]
            if len(before):
                _place(sa, t, before, now, 1)
    now = tail.copy()
    l_end = head + np.bincount(t[~is_s], minlength=symbols)
    for c in range(symbols - 1, -1, -1):  # S suffixes, down
        if not size[c]:
            continue
        done, l_part = tail[c], True
        while True:
            wave = sa[now[c] : done][::-1]
            done = now[c]
            if not len(wave):
                if not l_part:
                    break
                wave, l_part = sa[head[c] : l_end[c]][::-1], False
            before = wave[wave > 0] - 1
            before = before[is_s[before]]
            if len(before):
                _place(sa, t, before, now, -1)
    sa[0] = n - 1
    return sa


def _place(sa: np.ndarray, t: np.ndarray, at: np.ndarray, now: np.ndarray, step: int) -> None:
    """Puts suffixes into their buckets in order, from `now` on; `now` moves along."""
    c = t[at]
    order = np.argsort(c, kind="stable")
    at, c = at[order], c[order]
    kinds, first, many = np.unique(c, return_index=True, return_counts=True)
    nth = np.arange(len(c)) - np.repeat(first, many)
    sa[now[c] + nth if step > 0 else now[c] - 1 - nth] = at
    now[kinds] += step * many


def _by_doubling(rank: np.ndarray) -> np.ndarray:
    """Order of the suffixes of a string of ranks."""
    n, h = len(rank), 1
    rank = rank.astype(np.int64)
    while True:
        after = np.zeros(n, np.int64)
        after[: n - h] = rank[h:] + 1
        key = rank * (n + 2) + after
        order = np.argsort(key, kind="stable")
        new = np.empty(n, np.int64)
        new[order] = np.concatenate([[0], np.cumsum(key[order][1:] != key[order][:-1])])
        rank = new
        if rank[order[-1]] == n - 1:
            return order
        h *= 2


def suffix_array(t: np.ndarray) -> np.ndarray:
    """Order of the suffixes of t: small integers, the last one less than all others."""
    t = np.ascontiguousarray(t)
    n, symbols = len(t), int(t.max()) + 1 if len(t) else 0
    if n < 2:
        return np.arange(n)
    small = t.astype(np.int16) if symbols < 1 << 15 else t
    is_s = _classify(t)
    lms = np.flatnonzero(is_s[1:] & ~is_s[:-1]) + 1
    if len(lms) > 1:
        is_lms = np.zeros(n, bool)
        is_lms[lms] = True
        sa = _induce(small, is_s, lms, symbols)
        by_substring = sa[is_lms[sa]]
        name = _names(t, lms, by_substring)
        number = np.empty(n, np.int64)
        number[by_substring] = name
        if name[-1] < len(lms) - 1:
            lms = lms[_by_doubling(number[lms])]
        else:
            lms = by_substring
    return _induce(small, is_s, lms, symbols)


def _names(t: np.ndarray, lms: np.ndarray, in_order: np.ndarray) -> np.ndarray:
    """Numbers, from 0, for the LMS substrings in their order: equal ones get the same."""
    n = len(t)
    end = np.empty(n, np.int64)  # of the substring, its last symbol counted: the next LMS suffix's first
    end[lms] = np.concatenate([lms[1:], [n - 1]])
    a, b = in_order[:-1], in_order[1:]
    same = end[a] - a == end[b] - b
    left = np.flatnonzero(same)
    length = (end[a] - a)[left]
    k = 0
    while len(left):
        hit = t[np.minimum(a[left] + k, n - 1)] == t[np.minimum(b[left] + k, n - 1)]
        same[left[~hit]] = False
        go = hit & (k < length)
        left, length = left[go], length[go]
        k += 1
    return np.concatenate([[0], np.cumsum(~same)])


def common_prefixes(t: np.ndarray, sa: np.ndarray, most: int) -> np.ndarray:
    """Permuted: for each position, how many symbols it shares with the suffix before it in the array, up to `most`.

    Symbols are compared in packs where they are small enough for that, then one by one.
    """
    n = len(t)
    out = np.zeros(n, np.int64)
    a, b = sa[1:], sa[:-1]
    padded = np.concatenate([t, np.zeros(most + 8, t.dtype)]).astype(np.int64)
    bits = max(1, int(t.max()).bit_length()) if n else 1
    pack = max(1, min(62 // bits, most))
    packed = np.zeros(len(padded) - pack + 1, np.int64)
    for k in range(pack):
        packed = (packed << bits) | padded[k : len(packed) + k]
    left, k, rest = np.arange(n - 1), 0, []
    while k + pack <= most and len(left):
        hit = packed[a[left] + k] == packed[b[left] + k]
        rest.append((left[~hit], k))
        left, k = left[hit], k + pack
    rest.append((left, k))
    for left, k in rest:
        while len(left):
            out[a[left]] = k
            if k == most:
                break
            left = left[padded[a[left] + k] == padded[b[left] + k]]
            k += 1
    return out
