"""Suffix arrays by induced sorting and permuted common prefixes, on numpy arrays.

Suffixes are L (larger than the next one) or S (smaller); a leftmost S after an L is an
LMS suffix.  LMS substrings are sorted by inducing from unsorted ones, named, and the
string of names is sorted by recursion; then all suffixes are induced from the sorted
LMS suffixes: L suffixes bucket by bucket from the left, S suffixes from the right, each
placed in its bucket by the place of the suffix behind it.  Buckets are taken in batches,
so small ones of a large alphabet cost no loop each.  Within a bucket, suffixes that begin
with a run of its character come in order of the run's length and then of the suffix behind
the run, so runs of any length are placed at once; places that hang on others of the batch
settle in as many rounds as characters fall (or rise) in a row there, 255 at most for bytes.

PLCP[i] is the common prefix of suffix i and the one before it in order.  Where the
characters before both agree it is PLCP[i-1] - 1; only the other (irreducible) ones are
compared.
"""

from __future__ import annotations

import numpy as np


def _order(base: np.ndarray, run: np.ndarray, key: np.ndarray, n: int) -> np.ndarray:
    longest = int(run.max()) + 1
    if (int(base.max()) + 1) * longest * n < 1 << 62:
        return np.argsort((base * longest + run) * n + key)
    return np.lexsort((key, run, base))


def _settle(e: np.ndarray, base: np.ndarray, run: np.ndarray, after: np.ndarray, place: np.ndarray, guess: np.ndarray) -> None:
    """Places of suffixes ``e`` in their buckets (which begin at ``base``), by the rest of their run and the place of the suffix ``after`` it.

    ``guess`` (the begin of its bucket) stands in for a next suffix without a place yet.
    """
    key = place[after]
    open_ = np.flatnonzero(key < 0)
    key[open_] = guess[open_]
    at = np.arange(len(e))
    order = _order(base, run, key, len(place))
    b = base[order]
    bucket = np.maximum.accumulate(np.where(np.append(True, b[1:] != b[:-1]), at, 0))
    if not len(open_):
        place[e[order]] = b + at - bucket
        return
    while True:
        k, r = key[order], run[order]
        fresh = np.append(True, (k[1:] != k[:-1]) | (r[1:] != r[:-1]) | (b[1:] != b[:-1]))
        place[e[order]] = b + np.maximum.accumulate(np.where(fresh, at, 0)) - bucket
        now = place[after[open_]]
        if np.array_equal(now, key[open_]):
            return
        key[open_] = now
        order = _order(base, run, key, len(place))


def _batches(counts: np.ndarray, least: int) -> list[tuple[int, int]]:
    """Ranges of neighbouring buckets with about ``least`` suffixes or more."""
    ends = np.cumsum(counts)
    out, a = [], 0
    while a < len(counts):
        done = int(ends[a - 1]) if a else 0
        b = min(len(counts), int(np.searchsorted(ends, done + least, "left")) + 1)
        out.append((a, b))
        a = b
    return out


def _induce(s: np.ndarray, small: np.ndarray, until: np.ndarray, lms: np.ndarray, begins: np.ndarray, least: int) -> np.ndarray:
    """Places of all suffixes, from LMS suffixes in order (of their first characters at least).

    ``until`` is where each suffix's first run ends.
    """
    n, sigma = len(s), len(begins) - 1
    large_at, small_at = np.flatnonzero(~small), np.flatnonzero(small[:-1])
    large_at = large_at[np.argsort(s[large_at], kind="stable")]
    n_large = np.bincount(s[large_at], minlength=sigma)
    place = np.full(n, -1, np.int64)
    c = s[lms]
    first = np.searchsorted(c, np.arange(sigma))
    place[lms] = begins[c] + n_large[c] + np.arange(len(lms)) - first[c]
    ends = np.cumsum(n_large)
    for a, b in _batches(n_large, least):
        e = large_at[ends[a] - n_large[a] : ends[b - 1]]
        if len(e):
            _settle(e, begins[s[e]], until[e] - e, until[e] + 1, place, begins[s[until[e] + 1]])
    # From the right, in mirrored places: the last place of a bucket is its first.
    mirrored = np.where(small, -1, n - 1 - place)
    mirrored[n - 1] = n - 1
    small_at = small_at[np.argsort(s[small_at], kind="stable")]
    n_small = np.bincount(s[small_at], minlength=sigma)
    ends = np.cumsum(n_small)
    back = n - begins[1:]  # of a bucket's last place
    for a, b in [(sigma - y, sigma - x) for x, y in _batches(n_small[::-1], least)]:
        e = small_at[ends[a] - n_small[a] : ends[b - 1]]
        if len(e):
            _settle(e, back[s[e]], until[e] - e, until[e] + 1, mirrored, back[s[until[e] + 1]])
    return n - 1 - mirrored


def places(s: np.ndarray, least: int = 1024) -> np.ndarray:
    """Rank of every suffix of ``s``, whose last character is the only 0 and least of all."""
    n = len(s)
    if n == 1:
        return np.zeros(1, np.int64)
    begins = np.concatenate([[0], np.cumsum(np.bincount(s))])
    step = np.diff(s)
    at = np.where(step != 0, np.arange(n - 1), n)
    until = np.minimum.accumulate(at[::-1])[::-1]  # the next place where the character changes
    small = np.append(step[until] > 0, True)
    lms = np.flatnonzero(small[1:] & ~small[:-1]) + 1
    place = _induce(s, small, until, lms[np.argsort(s[lms], kind="stable")], begins, least)
    # LMS substrings in order; equal neighbours get one name.
    order = lms[np.argsort(place[lms])]
    following = np.empty(n, np.int64)
    following[lms] = np.append(lms[1:], n - 1)
    size = following[order] - order + 1
    same = np.zeros(len(order), bool)
    alike = np.flatnonzero(size[1:] == size[:-1]) + 1
    if len(alike):
        m = size[alike]
        ends = np.cumsum(m)
        inner = np.arange(int(ends[-1])) - np.repeat(ends - m, m)
        equal = s[np.repeat(order[alike], m) + inner] == s[np.repeat(order[alike - 1], m) + inner]
        same[alike] = np.logical_and.reduceat(equal, ends - m)
    name = np.empty(n, np.int64)
    name[order] = np.cumsum(~same) - 1
    if same.any():
        order = lms[np.argsort(places(name[lms], least))]
    return _induce(s, small, until, order, begins, least)


def permuted_common_prefixes(s: np.ndarray, place: np.ndarray) -> np.ndarray:
    """PLCP of every suffix; 0 for the least one."""
    n = len(s)
    order = np.empty(n, np.int64)
    order[place] = np.arange(n)
    before = np.full(n, -1, np.int64)
    before[order[1:]] = order[:-1]
    i = np.arange(n)
    reducible = (i > 0) & (before > 0)
    reducible[reducible] = s[i[reducible] - 1] == s[before[reducible] - 1]
    start = np.flatnonzero(~reducible)
    length = np.zeros(len(start), np.int64)
    todo = np.flatnonzero(before[start] >= 0)
    padded = np.concatenate([s, np.full(32, -1, s.dtype)])
    window = np.lib.stride_tricks.sliding_window_view(padded, 32)
    while len(todo):
        a, b = start[todo] + length[todo], before[start[todo]] + length[todo]
        unequal = window[a] != window[b]
        some = unequal.any(axis=1)
        length[todo] += np.where(some, unequal.argmax(axis=1), 32)
        todo = todo[~some]
    head = np.maximum.accumulate(np.where(~reducible, i, 0))
    index = np.searchsorted(start, head)
    return np.maximum(length[index] - (i - head), 0)


def repeated_windows(s: np.ndarray, width: int) -> np.ndarray:
    """Whether the ``width`` characters from each place also begin at another place.

    ``s`` may hold separators, smaller than all else but the last 0: windows across one count
    as any others, so callers drop them.
    """
    place = places(s)
    common = permuted_common_prefixes(s, place) >= width
    in_order = np.empty(len(s), bool)
    in_order[place] = common
    in_order[:-1] |= in_order[1:]
    return in_order[place]
