"""Suffix array of a shard by induced sorting, and permuted common prefixes, vectorised.

Suffixes are classified as smaller or larger than their right neighbour; the
substrings between leftmost-smaller positions are sorted by inducing, named, and
the string of names is sorted in turn; two linear passes induce all other suffixes.

Inducing goes bucket by bucket, whole frontiers at once. The string of
names has nearly as many buckets as suffixes, where that gains nothing, so its sorting
doubles ranks instead, and ends once they cover ``depth`` symbols: suffixes that
agree on so many need no order for a search for common prefixes of at most that length.
"""

from __future__ import annotations

import numpy as np


def classify(t: np.ndarray) -> np.ndarray:
    """Whether each suffix of ``t`` is smaller than the one to its right; the last one is not."""
    n = len(t)
    step = np.sign(np.diff(t.astype(np.int32), append=-1))
    at = np.where(step != 0, np.arange(n), n)
    nearest = np.minimum.accumulate(at[::-1])[::-1]  # the next place where neighbours differ
    return step[nearest] > 0


def _induce(t: np.ndarray, smaller: np.ndarray, lms: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """The suffixes of ``t``, induced from its leftmost-smaller ones in the order of ``lms``.

    ``starts``: where each symbol's bucket begins, and the end of the last.
    """
    n, symbols = len(t), len(starts) - 1
    sa = np.full(n, -1, np.int64)
    order = np.argsort(t[lms], kind="stable")
    seeds = np.split(lms[order], np.cumsum(np.bincount(t[lms], minlength=symbols))[:-1])
    head, tail = starts[:-1].copy(), starts[1:].copy()

    def deal(found: np.ndarray, forward: bool) -> np.ndarray:
        """Puts suffixes at the open end of their buckets, in order."""
        c = t[found]
        by = np.argsort(c, kind="stable")
        found, c = found[by], c[by]
        counts = np.bincount(c, minlength=symbols)
        first = np.cumsum(counts) - counts
        rank = np.arange(len(found)) - first[c]
        if forward:
            sa[head[c] + rank] = found
            head[:] += counts
        else:
            sa[tail[c] - 1 - rank] = found
            tail[:] -= counts
        return counts

    present = np.flatnonzero(np.diff(starts))
    deal(np.array([n - 1]), True)  # the last suffix is larger than the empty one to its right
    for c in present:
        done = starts[c]
        while done < head[c]:  # larger suffixes of this bucket, as they come in
            part = sa[done : head[c]]
            done = head[c]
            before = part[part > 0] - 1
            before = before[~smaller[before]]
            if len(before):
                deal(before, True)
        before = seeds[c][seeds[c] > 0] - 1
        before = before[~smaller[before]]
        if len(before):
            deal(before, True)
    for c in present[::-1]:
        done = starts[c + 1]
        while done > tail[c]:  # smaller suffixes of this bucket, from its end
            part = sa[tail[c] : done][::-1]
            done = tail[c]
            before = part[part > 0] - 1
            before = before[smaller[before]]
            if len(before):
                deal(before, False)
        part = sa[starts[c] : head[c]][::-1]
        before = part[part > 0] - 1
        before = before[smaller[before]]
        if len(before):
            deal(before, False)
    return sa


def _by_doubling(names: np.ndarray, reach: np.ndarray, depth: int) -> np.ndarray:
    """Order of the suffixes of ``names``, each of which stands for at least ``reach`` symbols, up to ``depth`` symbols."""
    rank, n, width = names.astype(np.int64), len(names), 1
    while True:
        second = np.zeros(n, np.int64)
        second[: n - width] = rank[width:] + 1
        order = np.argsort(rank * np.int64(int(rank.max()) + 2) + second, kind="stable")
        a, b = rank[order], second[order]
        rank = np.empty(n, np.int64)
        rank[order] = np.concatenate([[0], np.cumsum((a[1:] != a[:-1]) | (b[1:] != b[:-1]))])
        width *= 2
        if rank[order[-1]] == n - 1 or width >= n or width * int(reach.min()) >= depth:
            return order


def suffix_array(t: np.ndarray, depth: int = 2**62) -> np.ndarray:
    """Order of the suffixes of ``t`` (small non-negative integers), by their first ``depth`` symbols at least."""
    t = t.astype(np.int64)
    n = len(t)
    if n < 2:
        return np.arange(n)
    smaller = classify(t)
    lms = np.flatnonzero(smaller[1:] & ~smaller[:-1]) + 1
    starts = np.concatenate([[0], np.cumsum(np.bincount(t))])
    if len(lms) > 1:
        sa = _induce(t, smaller, lms, starts)
        is_lms = np.zeros(n, bool)
        is_lms[lms] = True
        order = sa[is_lms[sa]]  # sorted by their substrings
        place = np.empty(n, np.int64)
        place[lms] = np.arange(len(lms))
        end = np.append(lms[1:], n - 1)
        length = end - lms + 1
        size = length[place[order]]
        same = size[1:] == size[:-1]
        a, b, open_ = order[1:], order[:-1], np.flatnonzero(same)
        for k in range(int(size.max())):  # symbol by symbol, while any pair still agrees
            open_ = open_[size[1:][open_] > k]
            if not len(open_):
                break
            differ = t[a[open_] + k] != t[b[open_] + k]
            same[open_[differ]] = False
            open_ = open_[~differ]
        # the last substring ends with the text and has no equal
        same[(a == lms[-1]) | (b == lms[-1])] = False
        name = np.empty(len(lms), np.int64)
        name[place[order]] = np.concatenate([[0], np.cumsum(~same)])
        if name.max() < len(lms) - 1:
            lms = lms[_by_doubling(name, np.maximum(length - 1, 1), depth)]
        else:
            lms = order
    return _induce(t, smaller, lms, starts)


def common_prefix_reaches(data: np.ndarray, sa: np.ndarray, room: np.ndarray, length: int) -> np.ndarray:
    """In text order: whether the suffix shares its first ``length`` bytes with a neighbour in ``sa``.

    The comparison runs over the permuted pairs (suffix, its predecessor in ``sa``), eight
    bytes at a time, for those pairs that still agree. ``room``: bytes from each place to the end of its string.
    """
    before = np.full(len(sa), -1, np.int64)
    before[sa[1:]] = sa[:-1]
    i = np.flatnonzero((room >= length) & (before >= 0))
    i = i[room[before[i]] >= length]
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    words = np.lib.stride_tricks.sliding_window_view(padded, 8)
    j = before[i]
    for k in [*range(0, length - 7, 8), *([length - 8] if length % 8 else [])]:
        if not len(i):
            break
        same = (words[i + k] == words[j + k]).all(axis=1)
        i, j = i[same], j[same]
    out = np.zeros(len(sa), bool)
    out[i] = out[j] = True
    return out
