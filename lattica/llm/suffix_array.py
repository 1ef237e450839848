"""Suffix arrays by induced sorting, and permuted common prefixes, in numpy.

Suffixes are classified as smaller or larger than their right neighbour;
leftmost-smaller (LMS) substrings are sorted by inducing, named, and the string
of names is sorted in turn; from the order of LMS suffixes all others are
induced in two linear passes. Over the few, large buckets of a byte string a pass
goes bucket by bucket, and all suffixes of a bucket induce at once, which keeps the
order a sequential scan would give; over the many buckets of a string of names it
is that scan. The recursion ends where all names differ, whatever the alphabet.
"""

from __future__ import annotations

import numpy as np

#: Letters up to which a pass goes bucket by bucket.
FEW_BUCKETS = 512
#: Places whose common prefixes are compared at a time.
COMPARED = 1 << 16


def _induce(v: np.ndarray, lms: np.ndarray, size: int) -> np.ndarray:
    """All suffixes in order, induced from ``lms`` suffixes in their order. ``v`` ends with a single 0."""

    def deal(to: list[list[np.ndarray]], at: np.ndarray) -> None:
        if not len(at):
            return
        c = v[at]
        order = np.argsort(c, kind="stable")
        at, c = at[order], c[order]
        edge = np.flatnonzero(np.append(True, c[1:] != c[:-1]))
        for b, part in zip(c[edge].tolist(), np.split(at, edge[1:])):
            to[b].append(part)

    def settle(found: list[np.ndarray], c: int) -> np.ndarray:
        """A bucket's suffixes, with those that they induce into the bucket itself."""
        last = found[-1] if len(found) == 1 else np.concatenate(found)
        out = [last]
        while len(last):
            last = last[last > 0] - 1
            last = last[v[last] == c]
            out.append(last)
        return np.concatenate(out)

    none = np.empty(0, np.int64)
    starts: list[list[np.ndarray]] = [[] for _ in range(size)]
    larger: list[list[np.ndarray]] = [[] for _ in range(size)]
    deal(starts, lms)
    left: list[np.ndarray] = [none] * size
    for c in range(size):
        if larger[c]:
            left[c] = settle(larger[c], c)
        if len(left[c]) or starts[c]:
            before = np.concatenate([left[c], *starts[c]])
            before = before[before > 0] - 1
            deal(larger, before[v[before] > c])
    smaller: list[list[np.ndarray]] = [[] for _ in range(size)]
    right: list[np.ndarray] = [none] * size
    for c in range(size - 1, 0, -1):
        if smaller[c]:
            right[c] = settle(smaller[c], c)
        if len(right[c]) or len(left[c]):
            before = np.concatenate([right[c], left[c][::-1]])
            before = before[before > 0] - 1
            deal(smaller, before[v[before] < c])
    out = [np.array([len(v) - 1])]
    for c in range(1, size):
        out += [left[c], right[c][::-1]]
    return np.concatenate(out)


def _induce_scan(v: np.ndarray, smaller: np.ndarray, lms: np.ndarray, size: int) -> np.ndarray:
    """The same order as ``_induce`` gives, by one scan in either direction, for many small buckets.

    Buckets are ranges of one array, with a head and a tail for each; a scan
    meets what it has itself put further on.
    """
    count = np.bincount(v, minlength=size)
    tails = np.cumsum(count)
    order = np.full(len(v), -1, np.int64)
    at = lms[np.argsort(v[lms], kind="stable")]
    own = np.bincount(v[at], minlength=size)
    order[np.repeat(tails - np.cumsum(own), own) + np.arange(len(at))] = at
    # the letter before each place if that suffix is larger, or smaller, than its right neighbour; else 0, as for -1
    before = np.zeros((2, len(v) + 1), np.int64)
    before[0, 1:-1], before[1, 1:-1] = np.where(smaller[:-1], 0, v[:-1]), np.where(smaller[:-1], v[:-1], 0)
    out, larger, less = order.tolist(), before[0].tolist(), before[1].tolist()
    head, tail = (tails - count).tolist(), tails.tolist()
    del order, before, at, own  # as lists from here on
    for i in out:
        if c := larger[i]:
            k = head[c]
            out[k] = i - 1
            head[c] = k + 1
    for i in reversed(out):
        if c := less[i]:
            tail[c] = k = tail[c] - 1
            out[k] = i - 1
    return np.array(out, np.int64)


def _same_as_before(v: np.ndarray, at: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Whether each substring, by place and length, equals the one before it in the list."""
    same = np.zeros(len(at), bool)
    live = np.flatnonzero(size[1:] == size[:-1]) + 1
    k = 0
    while len(live):
        live = live[v[at[live] + k] == v[at[live - 1] + k]]
        k += 1
        whole = size[live] == k
        same[live[whole]] = True
        live = live[~whole]
    return same


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Start positions of the suffixes of a byte string, in order."""
    v = np.append(text.astype(np.int16) + 1, np.int16(0))
    return _sorted(v, 257)[1:]


def _sorted(v: np.ndarray, size: int) -> np.ndarray:
    """Order of the suffixes of ``v``, whose letters are below ``size`` and whose last one is a single 0."""
    n = len(v)
    if n == 1:
        return np.zeros(1, np.int64)
    differs = np.append(np.flatnonzero(v[1:] != v[:-1]), n - 1)
    next_change = differs[np.searchsorted(differs, np.arange(n - 1))]
    smaller = np.append(v[next_change] < v[next_change + 1], True)
    is_lms = np.zeros(n, bool)
    is_lms[1:] = smaller[1:] & ~smaller[:-1]
    lms = np.flatnonzero(is_lms)
    induce = (lambda at: _induce(v, at, size)) if size <= FEW_BUCKETS else (lambda at: _induce_scan(v, smaller, at, size))
    order = induce(lms)
    order = order[is_lms[order]]
    length = np.ones(n, np.int64)
    length[lms[:-1]] = np.diff(lms) + 1
    names = np.cumsum(~_same_as_before(v, order, length[order])) - 1
    if names[-1] + 1 < len(lms):
        name_at = np.empty(n, np.int64)
        name_at[order] = names
        # the last name is the end mark's, the smallest and alone: the recursion's own end
        order = lms[_sorted(name_at[lms], int(names[-1]) + 1)]
    return induce(order)


def permuted_prefixes(text: np.ndarray, order: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each position: the suffix before its own in the order (-1: none), and the common prefix with it.

    Common prefixes are compared only where they cannot follow from the
    position before (irreducible ones); all others are one less than that.
    """
    n = len(text)
    before = np.full(n, -1, np.int64)
    before[order[1:]] = order[:-1]
    here = np.arange(n)
    follows = (here > 0) & (before > 0)
    follows[follows] = text[here[follows] - 1] == text[before[follows] - 1]
    follows &= np.append(False, before[1:] == before[:-1] + 1) & (before >= 0)
    first = np.flatnonzero(~follows)
    common = np.zeros(n, np.int64)
    padded = np.append(text.astype(np.int16), np.full(64, -1, np.int16))
    open_ends = first[before[first] >= 0]
    for part in range(0, len(open_ends), COMPARED):  # of so many places at a time, which bounds the memory
        live, k, step = open_ends[part : part + COMPARED], 0, 4
        while len(live):
            span = k + np.arange(step)
            a = np.minimum(live[:, None] + span, n)
            b = np.minimum(before[live][:, None] + span, n + 1)
            x, y = padded[a], padded[b]
            y[b >= n] = -2
            equal = x == y
            whole = equal.all(1)
            common[live[~whole]] = k + equal[~whole].argmin(1)
            live, k, step = live[whole], k + step, 32
    anchor = np.maximum.accumulate(np.where(follows, 0, here))
    return before, common[anchor] - (here - anchor)
