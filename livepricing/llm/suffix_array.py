"""Suffix arrays by induced sorting, and permuted common prefixes, as numpy passes.

``suffix_array`` classifies suffixes (S: smaller than the next one, L: larger), sorts the
leftmost-smaller (LMS) substrings by inducing, names them, sorts the shorter string of names
recursively where names repeat, and induces the whole order from the sorted LMS suffixes. The
inducing scans run over the buckets of the first symbol: all entries of a bucket known so far
induce their left neighbours at once, in order, and a bucket is scanned again for what it has
induced into itself (runs of one symbol), so every entry is handled once.
"""

from __future__ import annotations

import numpy as np

#: Strings of names with more symbols than this have too many buckets for the bucket scans; their
#: ranks come from the doubled names of the same recursion.
MANY_BUCKETS = 1 << 10


def _kinds(t: np.ndarray) -> np.ndarray:
    """True where the suffix is S; the last one is L (an empty suffix stands behind it)."""
    n = len(t)
    less = np.zeros(n, np.int8)
    less[:-1] = np.sign(t[1:].astype(np.int64) - t[:-1].astype(np.int64))
    less[-1] = -1
    # equal symbols take the kind of the next position that differs
    at = np.where(less != 0, np.arange(n), n)
    nxt = np.minimum.accumulate(at[::-1])[::-1]
    return less[nxt] > 0


def _induce(t: np.ndarray, kind: np.ndarray, lms: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """The order of all suffixes, given LMS positions in order (or, for the first pass, LMS
    positions in any order within their bucket: then LMS substrings come out sorted)."""
    n, k = len(t), len(starts) - 1
    sa = np.full(n, -1, np.int64)
    # L suffixes, buckets upwards: each bucket's L part fills from its start
    head = starts[:-1].copy()
    lms_sym = t[lms]
    lms_cut = np.searchsorted(lms_sym, np.arange(k + 1))

    def spread(src: np.ndarray, want: bool, downwards: bool):
        """Put the left neighbours of ``src`` of the wanted kind into their buckets, in order."""
        left = src[src > 0] - 1
        left = left[kind[left] == want]
        if not len(left):
            return
        sym = t[left]
        if len(left) > 1:
            order = np.argsort(sym, kind="stable")
            left, sym = left[order], sym[order]
        first = np.flatnonzero(np.append(True, sym[1:] != sym[:-1]))
        size = np.diff(np.append(first, len(sym)))
        within = np.arange(len(sym)) - np.repeat(first, size)
        if downwards:
            tail[sym[first]] -= size
            sa[np.repeat(tail[sym[first]] + size - 1, size) - within] = left
        else:
            sa[np.repeat(head[sym[first]], size) + within] = left
            head[sym[first]] += size

    # the empty suffix comes first and induces the last position, which is L
    sa[head[t[n - 1]]] = n - 1
    head[t[n - 1]] += 1
    for c in range(k):
        done = starts[c]
        while done < head[c]:
            upto = head[c]
            spread(sa[done:upto], False, False)
            done = upto
        if lms_cut[c] < lms_cut[c + 1]:
            spread(lms[lms_cut[c]: lms_cut[c + 1]], False, False)
    # S suffixes, buckets downwards: each bucket's S part fills from its end
    tail = starts[1:].copy()
    for c in range(k - 1, -1, -1):
        done = starts[c + 1]
        while done > tail[c]:
            upto = tail[c]
            spread(sa[upto:done][::-1], True, True)
            done = upto
        spread(sa[starts[c]: head[c]][::-1], True, True)
    return sa


def _ranks_by_doubling(t: np.ndarray) -> np.ndarray:
    rank, h, n = t.astype(np.int64), 1, len(t)
    while True:
        after = np.zeros(n, np.int64)
        after[: max(n - h, 0)] = rank[h:] + 1
        key = rank * (int(rank.max()) + 2) + after
        sa = np.argsort(key, kind="stable")
        new = np.zeros(n, np.int64)
        new[sa[1:]] = np.cumsum(key[sa[1:]] != key[sa[:-1]])
        if new[sa[-1]] == n - 1:
            return sa
        rank, h = new, 2 * h


def suffix_array(t: np.ndarray, symbols: int | None = None) -> np.ndarray:
    """Positions of all suffixes of the integer string ``t`` in order; a suffix that is a prefix
    of another one comes first."""
    n = len(t)
    if n < 2:
        return np.arange(n)
    t = t.astype(np.int64)
    k = int(t.max()) + 1 if symbols is None else symbols
    if k > MANY_BUCKETS:
        return _ranks_by_doubling(t)
    kind = _kinds(t)
    starts = np.concatenate([[0], np.cumsum(np.bincount(t, minlength=k))])
    is_lms = np.zeros(n, bool)
    is_lms[1:] = kind[1:] & ~kind[:-1]
    lms = np.flatnonzero(is_lms)
    if len(lms) > 1:
        first = lms[np.argsort(t[lms], kind="stable")]
        sa = _induce(t, kind, first, starts)
        order = sa[is_lms[sa]]
        # equal LMS substrings get one name
        size = np.diff(np.append(lms, n - 1)) + 1
        length = np.zeros(n, np.int64)
        length[lms] = size
        a, b = order[:-1], order[1:]
        same = length[a] == length[b]
        last = lms[-1]
        same &= (a != last) & (b != last)
        live, step = np.flatnonzero(same), 0
        while len(live):
            x, y = a[live] + step, b[live] + step
            eq = (t[x] == t[y]) & (kind[x] == kind[y])
            same[live[~eq]] = False
            step += 1
            live = live[eq & (length[a[live]] > step)]
        name = np.zeros(n, np.int64)
        name[order] = np.concatenate([[0], np.cumsum(~same)])
        names = int(name[order[-1]]) + 1
        sub = name[lms]
        rank = np.argsort(sub, kind="stable") if names == len(lms) else suffix_array(sub, names)
        lms = lms[rank]
    return _induce(t, kind, lms, starts)


def permuted_lcp(t: np.ndarray, sa: np.ndarray, cap: int) -> np.ndarray:
    """plcp[i]: length of the common prefix of suffix i and the one before it in order, counted
    up to ``cap`` (position order; 0 for the first in order). Positions whose prefixes still agree
    are compared eight symbols at a time; symbols must lie below 255, or equal ones there just
    compare symbol by symbol at the end."""
    n = len(t)
    plcp = np.zeros(n, np.int64)
    if n < 2:
        return plcp
    before = np.full(n, n, np.int64)
    before[sa[1:]] = sa[:-1]
    padded = np.concatenate([t.astype(np.int64) + 1, np.zeros(cap + 16, np.int64)])
    narrow = padded.max() < 256
    if narrow:  # eight symbols in a word
        word = np.zeros(len(padded) - 8, np.uint64)
        for i in range(8):
            word = (word << np.uint64(8)) | padded[i: i + len(word)].astype(np.uint64)
    at = np.flatnonzero(before < n)
    other, step = before[at], 0
    ends: list[tuple[np.ndarray, np.ndarray, int]] = []
    while narrow and len(at) and step + 8 <= cap:
        eq = (word[at + step] == word[other + step]) & (np.maximum(at, other) + step + 8 <= n)
        ends.append((at[~eq], other[~eq], step))
        at, other, step = at[eq], other[eq], step + 8
    ends.append((at, other, step))
    for at, other, step in ends:
        while len(at) and step <= cap:
            plcp[at] = step
            eq = padded[at + step] == padded[other + step]
            eq &= np.maximum(at, other) + step < n
            at, other, step = at[eq], other[eq], step + 1
    return plcp
