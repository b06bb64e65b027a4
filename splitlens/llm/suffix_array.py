"""Suffix array by induced sorting and permuted common prefixes, on numpy arrays.

Buckets are scanned one after the other as in the sequential algorithm, but all suffixes that
a bucket induces move in one array step.
"""

from __future__ import annotations

import numpy as np

from . import words as W

#: Alphabets up to this size are sorted by induction; larger ones, which only deeper levels
#: have, by rank doubling over the suffixes still tied.
INDUCED_ALPHABET = 1024


def s_types(t: np.ndarray) -> np.ndarray:
    """Whether each suffix is smaller than the next one; the last one, the sentinel, is."""
    n = len(t)
    differs = np.where(t[:-1] != t[1:], np.arange(n - 1), n - 1)
    at = np.minimum.accumulate(differs[::-1])[::-1]
    out = np.ones(n, bool)
    out[:-1] = (t < np.append(t[1:], t[-1]))[at]
    return out


def _deal(found: list[np.ndarray], t: np.ndarray, buckets: list[list]) -> None:
    """Append suffixes to the buckets of their first symbols, order kept."""
    if not found:
        return
    j = np.concatenate(found)
    if not len(j):
        return
    c = t[j]
    order = np.argsort(c, kind="stable")
    j, c = j[order], c[order]
    cut = np.append(np.flatnonzero(np.append(True, c[1:] != c[:-1])), len(c))
    for a, b in zip(cut[:-1], cut[1:]):
        buckets[c[a]].append(j[a:b])


def _induce(t: np.ndarray, small: np.ndarray, sigma: int, seeds: np.ndarray) -> np.ndarray:
    """All suffixes in order, from the leftmost-smaller ones in ``seeds`` (sorted by bucket)."""
    none = np.zeros(0, np.int64)
    ends = np.searchsorted(t[seeds], np.arange(sigma + 1))
    buckets: list[list] = [[] for _ in range(sigma)]
    large = []
    for c in range(sigma):
        done, found = [], []
        cur = np.concatenate(buckets[c]) if buckets[c] else none
        while len(cur):
            done.append(cur)
            j = cur - 1
            j = j[j >= 0]
            j = j[~small[j]]
            same = t[j] == c
            found.append(j[~same])
            cur = j[same]
        j = seeds[ends[c]:ends[c + 1]] - 1
        found.append(j[j >= 0])
        large.append(np.concatenate(done) if done else none)
        _deal(found, t, buckets)
    buckets = [[] for _ in range(sigma)]
    buckets[t[-1]].append(np.array([len(t) - 1]))
    smaller = [none] * sigma
    for c in range(sigma - 1, -1, -1):
        done, found = [], []
        cur = np.concatenate(buckets[c]) if buckets[c] else none
        while len(cur):
            done.append(cur)
            j = cur - 1
            j = j[j >= 0]
            j = j[small[j]]
            same = t[j] == c
            found.append(j[~same])
            cur = j[same]
        j = large[c][::-1] - 1
        j = j[j >= 0]
        found.append(j[small[j]])
        smaller[c] = np.concatenate(done)[::-1] if done else none
        _deal(found, t, buckets)
    return np.concatenate([x for pair in zip(large, smaller) for x in pair])


def _by_doubling(t: np.ndarray) -> np.ndarray:
    """Suffixes in order, by doubling the sorted length; only tied suffixes are sorted again."""
    n = len(t)
    order = np.argsort(t, kind="stable")
    new = np.append(True, t[order][1:] != t[order][:-1])
    rank = np.empty(n, np.int64)
    rank[order] = np.flatnonzero(new)[np.cumsum(new) - 1]
    tied = order[~(new & np.append(new[1:], True))]
    k = 1
    while len(tied):
        nxt = tied + k
        second = np.where(nxt < n, rank[np.minimum(nxt, n - 1)] + 1, 0)
        o = np.lexsort((second, rank[tied]))
        tied, second, first = tied[o], second[o], rank[tied][o]
        group = np.append(True, first[1:] != first[:-1])
        new = group | np.append(True, second[1:] != second[:-1])
        at = np.arange(len(tied))
        start = np.maximum.accumulate(np.where(group, at, 0))
        rank[tied] = first + np.maximum.accumulate(np.where(new, at, 0)) - start
        tied = tied[~(new & np.append(new[1:], True))]
        k *= 2
    out = np.empty(n, np.int64)
    out[rank] = np.arange(n)
    return out


def _names(t: np.ndarray, lms: np.ndarray, order: np.ndarray) -> np.ndarray:
    """A number for each leftmost-smaller substring, equal for equal ones, in sorted order."""
    gap = np.diff(np.append(lms, len(t)))
    at = np.arange(lms[0], len(t)) - np.repeat(lms, gap)
    with np.errstate(over="ignore"):
        h = np.add.reduceat(W.mix((t[lms[0]:].astype(np.uint64) + np.uint64(1)) * W.GOLDEN) * W.stream(int(gap.max()), 5)[at], lms - lms[0])
        last = t[np.append(lms[1:], len(t) - 1)].astype(np.uint64)
        h = W.mix(h + gap.astype(np.uint64) * W.GOLDEN) + W.mix(last + np.uint64(7))
    place = np.empty(len(t), np.int64)
    place[lms] = np.arange(len(lms))
    sorted_at = place[order]
    g = h[sorted_at]
    names = np.empty(len(lms), np.int64)
    names[sorted_at] = np.cumsum(np.append(True, g[1:] != g[:-1])) - 1
    return names


def suffix_array(t: np.ndarray, sigma: int) -> np.ndarray:
    """The suffixes of ``t`` in order. ``t`` has values below ``sigma`` and ends with its
    unique least one."""
    if sigma > INDUCED_ALPHABET:
        return _by_doubling(t)
    if len(t) == 1:
        return np.zeros(1, np.int64)
    small = s_types(t)
    is_lms = np.append(False, small[1:] & ~small[:-1])
    lms = np.flatnonzero(is_lms)
    rough = _induce(t, small, sigma, lms[np.argsort(t[lms], kind="stable")])
    order = rough[is_lms[rough]]
    names = _names(t, lms, order)
    top = int(names.max()) + 1
    if top < len(lms):  # equal substrings: sort the string of names, which is at most half as long
        order = lms[suffix_array(names, top)]
    return _induce(t, small, sigma, order)


def permuted_common_prefixes(text: np.ndarray, order: np.ndarray, limit: int) -> np.ndarray:
    """At each position, how many bytes its suffix shares with the one before it in ``order``,
    ``limit`` at most. Eight bytes are compared in one step."""
    n = len(text)
    before = np.full(n, -1, np.int64)
    before[order[1:]] = order[:-1]
    padded = np.concatenate([text, np.zeros(limit + 16, np.uint8)])
    word = np.zeros(n + limit + 8, np.uint64)
    for k in range(8):
        word |= padded[k:k + len(word)].astype(np.uint64) << np.uint64(8 * k)
    out = np.zeros(n, np.int64)
    at = np.flatnonzero(before >= 0)
    for k in range(0, limit, 8):
        differ = word[at + k] ^ word[before[at] + k]
        low = differ & (~differ + np.uint64(1))
        out[at] += np.where(differ == 0, 8, np.bitwise_count(low - np.uint64(1)).astype(np.int64) >> 3)
        at = at[differ == 0]
        if not len(at):
            break
    return np.minimum(out, np.minimum(limit, n - np.maximum(np.arange(n), before)))
