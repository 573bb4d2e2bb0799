"""Words of text that is written without spaces: a shortest path over the lattice of all cuts.

A lexicon gives words a cost, the negative logarithm of their share; a run of letters is cut
into the words of least total cost.  The lexicon is fitted without a dictionary, by
expectation maximisation: candidates are the substrings that occur most, and each round
sums, over all ways to cut all runs, how often a word is expected; words that save less than
their own spelling costs go.  A round is one scan of
the distinct runs and one sum by word; tasks add up their own counts first, so no more than
a lexicon leaves a task.  The lexicon's size is a parameter and bounds what tasks hold.

The candidates are those of exact counts over all runs, found without a shuffle of all substrings:
blocks of runs send what is heavy in them, and what a block holds back is bounded (see ``seeds``).

Words are found by a tree of characters, walked from all places of many runs at once, and the
ways are summed for many runs at once; a long run goes as stretches side by side, each first with
every way that it can be entered by, then with the one that the stretches before it give.

Defined results: a null text stays null; text outside the pattern stays as it is; of cuts of
equal cost the one of fewer words counts, then the one whose first word is longer; strings
that are not in the lexicon cost ``UNKNOWN`` and ``UNKNOWN_CHAR`` a character.
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from tallyloom.sources.scratch import cut

#: Letters and marks of Thai, which is written without spaces.
THAI = "[ก-ฺเ-๎]+"
#: Costs are in millionths of a natural logarithm.
UNIT = 1_000_000
UNKNOWN, UNKNOWN_CHAR = 15 * UNIT, 5 * UNIT
FAR = np.int64(1) << 59
#: Runs of up to so many characters are followed whole, longer ones in stretches of that many.
LONG, STRETCH = 320, 64
#: Characters that a task works on at a time, and those of a matrix.
BLOCK, MATRIX = 3_000_000, 150_000
#: Costs end at UNKNOWN, so a word's share times the exponential of half of that for each of its
#: characters keeps sums over a stretch within what doubles hold, whatever the stretch.
TILT = UNKNOWN / UNIT / 2
#: Larger trees are searched, smaller ones indexed.
DENSE = 1 << 25


def _flat(runs: list[str]) -> np.ndarray:
    """The characters of runs, one after another."""
    return np.frombuffer("".join(runs).encode("utf-32-le", "surrogatepass"), "<u4")


def _lengths(runs: list[str]) -> np.ndarray:
    return np.fromiter(map(len, runs), np.int64, len(runs))


class Lexicon:
    """Words and their costs, as a tree of characters."""

    def __init__(self, costs: dict[str, int], max_length: int = 12):
        self.words = list(costs)
        self.cost = np.fromiter(costs.values(), np.int64, len(costs))
        self.max_length = max(1, min(max_length, max(map(len, costs), default=1)))
        lengths = _lengths(self.words)
        codes = _flat(self.words).astype(np.int64)
        chars = np.unique(codes)
        self.rank = np.zeros(int(chars[-1]) + 2 if len(chars) else 1, np.int32)  # 0: no word has it
        self.rank[chars] = np.arange(1, len(chars) + 1)
        self.fan = len(chars) + 1
        starts = np.cumsum(lengths) - lengths
        node, edges, self.first = np.zeros(len(self.words), np.int64), [], [0, 1]
        self.word = [np.full(1, -1)]
        for n in range(self.max_length):
            own = np.flatnonzero(lengths > n)
            keys, inverse = np.unique(node[own] * self.fan + self.rank[codes[starts[own] + n]], return_inverse=True)
            node[own] = self.first[-1] + inverse
            ends = own[lengths[own] == n + 1]
            self.word.append(np.full(len(keys), -1))
            self.word[-1][node[ends] - self.first[-1]] = ends
            edges.append(keys)
            self.first.append(self.first[-1] + len(keys))
        self.word = np.concatenate(self.word)  # of each node, or -1
        self.edges = np.concatenate(edges)  # nodes count up by level and key, so the keys rise
        self.bits = self.max_length.bit_length()  # of a word's length
        self.table: np.ndarray | None = None

    def __getstate__(self) -> dict:
        return self.__dict__ | {"table": None}  # tasks build their own

    def _next(self, node: np.ndarray, code: np.ndarray) -> np.ndarray:
        """The child of each node by a character, 0 for none."""
        keys = node * self.fan + code
        if len(self.word) * self.fan <= DENSE:
            if self.table is None:
                self.table = np.zeros(len(self.word) * self.fan, np.int32)
                self.table[self.edges] = np.arange(1, len(self.word))
            return np.take(self.table, keys)
        at = np.minimum(np.searchsorted(self.edges, keys), len(self.edges) - 1)
        return np.where((self.edges[at] == keys) & (code > 0), at + 1, 0)

    def ranks(self, codes: np.ndarray) -> np.ndarray:
        """Characters as the tree numbers them."""
        return self.rank[np.minimum(codes, len(self.rank) - 1)]

    def walk(self, codes: np.ndarray, width: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """For each length, places in the first ``width`` lines of a matrix of ranks that begin a path of the tree, and its node."""
        flat, rows = codes.ravel(), codes.shape[1]
        at = np.flatnonzero(flat[: width * rows])
        node = np.zeros(len(at), np.int64)
        for n in range(1, self.max_length + 1):
            if not len(at) or not len(self.edges):
                return
            node = self._next(node, flat[at + (n - 1) * rows])
            kept = np.flatnonzero(node)
            at, node = at[kept], node[kept]
            yield n, at, node

    def _matrix(self, ranks: np.ndarray, start: np.ndarray, begin: np.ndarray, end: np.ndarray, head: int, width: int) -> np.ndarray:
        """Ranks from ``head`` before to a longest word after ``width`` places from each start, a column each; 0 outside its run."""
        at = start + np.arange(-head, width + self.max_length)[:, None]
        return np.where((at >= begin) & (at < end), np.take(ranks, at, mode="clip"), 0)

    def occurrences(self, runs: list[str], counts: np.ndarray, total: np.ndarray) -> None:
        """Add how often each word stands in runs, wherever it begins."""
        lengths = _lengths(runs)
        codes = np.zeros((int((lengths + self.max_length).sum()), 1), np.int32)  # one column, runs apart
        places = np.arange(int(lengths.sum())) + np.repeat(np.arange(len(runs)) * self.max_length, lengths)
        codes[places, 0] = self.ranks(_flat(runs))
        weight = np.zeros(len(codes))
        weight[places] = np.repeat(counts, lengths)
        for n, at, node in self.walk(codes, len(codes) - self.max_length):
            here = np.bincount(node - self.first[n], weight[at], self.first[n + 1] - self.first[n])
            word = self.word[self.first[n] : self.first[n + 1]]
            total[word[word >= 0]] += here[word >= 0].astype(np.int64)

    # Sums over all ways

    def expected(self, runs: list[str], counts: np.ndarray) -> np.ndarray:
        """How often each word is expected in runs that stand ``counts`` times, over all ways to cut them."""
        total = np.zeros(len(self.word))
        codes, lengths = _flat(runs), _lengths(runs)
        if len(codes) and len(self.edges):
            ranks, starts = self.ranks(codes), np.cumsum(lengths) - lengths
            shares, rate = self._shares(), 2.5
            left = [np.flatnonzero(lengths > LONG)]
            for own in _batches(lengths, LONG):
                rate, odd = self._expected_whole(ranks, starts[own], lengths[own], counts[own], shares, rate, total)
                left.append(own[odd])
            for own in _groups(lengths, np.concatenate(left)):
                self._expected_parted(ranks, starts[own], lengths[own], counts[own], shares, total)
        out = np.zeros(len(self.words))
        hit = self.word >= 0
        out[self.word[hit]] = total[hit]
        return out

    def _shares(self) -> np.ndarray:
        """Of the nodes that are words; 0 for others."""
        return np.where(self.word >= 0, np.exp(-self.cost[self.word] / UNIT), 0.0)

    def _weights(self, codes: np.ndarray, width: int, shares: np.ndarray, tilt: float) -> tuple[np.ndarray, list]:
        """Shares of the words of each length that begin at each place, with a factor for each of their characters, and the walk."""
        weights = np.zeros((self.max_length, width, codes.shape[1]))
        walk = list(self.walk(codes, width))
        for n, at, node in walk:
            low, high = self.first[n : n + 2]
            weights[n - 1].ravel()[at] = (shares[low:high] * math.exp(tilt * n))[node - low]
        return weights, walk

    def _expected_whole(self, ranks, start, length, counts, shares, rate, total) -> tuple[float, np.ndarray]:
        """Add the expected counts of runs; the next tilt, and the runs whose sums leave what doubles hold."""
        width = int(length.max())
        codes = self._matrix(ranks, start, start, start + length, 0, width)
        weights, walk = self._weights(codes, width, shares, rate)
        weights[0][np.arange(width)[:, None] >= length] = 1.0
        most, rows = self.max_length, len(start)

        def within(v: np.ndarray) -> np.ndarray:
            return (v[: width + 1].min(0) > 1e-140) & (v[: width + 1].max(0) < 1e140)

        ahead, behind = np.zeros((width + most, rows)), np.zeros((width + most, rows))
        ahead[0] = behind[width] = 1.0
        with np.errstate(over="ignore", invalid="ignore"):
            _forward(weights, ahead)
            fine = within(ahead)
            whole = np.where(fine, ahead[width], 1.0)
            _backward(weights, behind, ahead[:width] * (counts / whole))
            fine &= within(behind)
        weights[:, :, ~fine] = 0.0
        self._add(weights, walk, total)
        sure = np.flatnonzero(fine)
        if len(sure):
            rate -= float(np.log(whole[sure]).sum() / length[sure].sum())
        return rate, np.flatnonzero(~fine)

    def _add(self, expected: np.ndarray, walk: list, total: np.ndarray) -> None:
        """Sum how often the words of each length are expected at each place, by node."""
        for n, at, node in walk:
            low, high = self.first[n : n + 2]
            total[low:high] += np.bincount(node - low, expected[n - 1].ravel()[at], high - low)

    def _stretches(self, start: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The run of each stretch, and where it begins."""
        parts = -(-length // STRETCH)
        run = np.repeat(np.arange(len(start)), parts)
        return run, start[run] + STRETCH * (np.arange(len(run)) - np.repeat(np.cumsum(parts) - parts, parts))

    def _expected_parted(self, ranks, start, length, counts, shares, total) -> None:
        """Add the expected counts of long runs."""
        most, head = self.max_length, self.max_length - 1
        run, at = self._stretches(start, length)
        width, columns = STRETCH, len(at)
        codes = self._matrix(ranks, at, start[run], (start + length)[run], head, width)
        weights, walk = self._weights(codes, head + width, shares, TILT)
        weights[0, head:][at + np.arange(width)[:, None] >= (start + length)[run]] = 1.0
        # All ways in: a unit at each of the last places before a stretch, or the first after it.
        into, out = np.zeros((columns, most, most)), np.zeros((columns, most, most))
        for k in range(most):
            v = np.zeros((head + width + most, columns))
            v[k] = 1.0
            _forward(weights, v, own=head)
            into[:, :, k] = v[width : width + most].T
            v = np.zeros((width + most, columns))
            v[width + k] = 1.0
            _backward(weights[:, head:], v)
            out[:, :, k] = v[:most].T
        ahead, behind = np.zeros((head + width + most, columns)), np.zeros((head + width + most, columns))
        first = np.diff(run, prepend=-1) > 0
        last = np.diff(run, append=len(start)) > 0
        window = np.zeros(most)
        for k in range(columns):
            if first[k]:
                window = np.zeros(most)
                window[head] = 1.0
            ahead[:most, k] = window
            window = into[k] @ window
            window /= window.max() or 1.0
        for k in range(columns - 1, -1, -1):
            if last[k]:
                window = np.zeros(most)
                window[0] = 1.0
            behind[head + width :, k] = window
            window = out[k] @ window
            window /= window.max() or 1.0
        _forward(weights, ahead, own=head)
        _backward(weights, behind)
        # All ways have one word over a stretch's first character.
        over = np.zeros(columns)
        for n in range(1, most + 1):
            over += (ahead[most - n : most] * weights[n - 1, most - n : most] * behind[most : most + n]).sum(0)
        factor = np.where(over > 0, counts[run] / np.where(over > 0, over, 1.0), 0.0)
        ahead[:head] = 0.0  # those words are counted where they begin
        _backward(weights, behind, ahead[: head + width] * factor)
        self._add(weights, walk, total)

    # Least cost

    def _costs(self, codes: np.ndarray, width: int, left: np.ndarray) -> np.ndarray:
        """Keys of the words of each length that begin at each place: cost, then 1 for the word, then a bit less for a longer one.

        ``left``: how many characters of the run there are from each place on.
        """
        most = self.max_length
        node_cost = np.where(self.word >= 0, self.cost[self.word], 0) if len(self.cost) else np.zeros(1, np.int64)
        length = np.repeat(np.arange(most + 1), np.diff(self.first)) if len(self.cost) else np.zeros(1, np.int64)
        node_cost = np.where(self.word >= 0, node_cost, UNKNOWN + length * UNKNOWN_CHAR)
        keys = np.empty((most, width, codes.shape[1]), np.int64)
        for n in range(1, most + 1):
            keys[n - 1] = (((UNKNOWN + n * UNKNOWN_CHAR << 17) + 1) << self.bits) + most - n
        for n, at, node in self.walk(codes, width):
            keys[n - 1].ravel()[at] = (((node_cost[node] << 17) + 1) << self.bits) + most - n
        for n in range(1, most + 1):
            keys[n - 1][left < n] = FAR
        keys[0][left <= 0] = 0
        return keys

    def _least(self, keys: np.ndarray, best: np.ndarray) -> np.ndarray:
        """Fill ``best`` from its end; how long the word is that begins at each place."""
        most, width = keys.shape[:2]
        step, mask = np.empty((width, *best.shape[1:]), np.int16), (1 << self.bits) - 1
        now = np.empty(best.shape[1:], np.int64)
        each = np.empty((most, *best.shape[1:]), np.int64)
        for i in range(width - 1, -1, -1):
            np.add(keys[:, i], best[i + 1 : i + most + 1], out=each)
            np.min(each, axis=0, out=now)
            step[i] = most - (now & mask)
            np.bitwise_and(now, ~mask, out=best[i])
        return step

    def steps(self, codes: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """How long the word is that begins at each place of runs that stand one after another."""
        out = np.zeros(len(codes), np.int16)
        ranks, starts, most = self.ranks(codes), np.cumsum(lengths) - lengths, self.max_length
        for own in _batches(lengths, LONG):
            start, length = starts[own], lengths[own]
            width = int(length.max())
            places = np.arange(width)[:, None]
            matrix = self._matrix(ranks, start, start, start + length, 0, width)
            best = np.zeros((width + most, len(own)), np.int64)
            step = self._least(self._costs(matrix, width, length - places), best)
            inside = places < length
            out[(start + places)[inside]] = step[inside]
        for own in _groups(lengths, np.flatnonzero(lengths > LONG)):
            start, length = starts[own], lengths[own]
            run, at = self._stretches(start, length)
            places = at + np.arange(STRETCH)[:, None]
            end = (start + length)[run]
            keys = self._costs(self._matrix(ranks, at, start[run], end, 0, STRETCH), STRETCH, end - places)
            ways = np.zeros((len(at), most, most), np.int64)
            for k in range(most):
                best = np.full((STRETCH + most, len(at)), FAR)
                best[STRETCH + k] = 0
                self._least(keys, best)
                ways[:, :, k] = np.minimum(best[:most], FAR).T
            best = np.full((STRETCH + most, len(at)), FAR)
            last = np.diff(run, append=len(start)) > 0
            window = np.zeros(most, np.int64)
            for k in range(len(at) - 1, -1, -1):
                if last[k]:
                    window = np.zeros(most, np.int64)
                best[STRETCH:, k] = window
                window = np.minimum((ways[k] + window).min(1), FAR)
                window = np.minimum(window - window.min(), FAR)
            step = self._least(keys, best)
            inside = places < end
            out[places[inside]] = step[inside]
        return out

    def ends(self, codes: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Where the words of runs that stand one after another end."""
        steps, at, out = self.steps(codes, lengths).tolist(), 0, []
        while at < len(steps):
            at += steps[at]
            out.append(at)
        return np.array(out, np.int64)

    def segment(self, runs: list[str]) -> list[list[str]]:
        """The words of each run."""
        lengths = _lengths(runs)
        ends = self.ends(_flat(runs), lengths).tolist()
        whole, at, k, out = "".join(runs), 0, 0, []
        for n in np.cumsum(lengths).tolist():
            out.append([])
            while at < n:
                out[-1].append(whole[at : ends[k]])
                at, k = ends[k], k + 1
        return out

    def parts(self, runs: list[str]) -> np.ndarray:
        """The least costs of short runs; a run of two characters and more may not be one word."""
        codes, lengths = _flat(runs), _lengths(runs)
        ranks, starts, most = self.ranks(codes), np.cumsum(lengths) - lengths, self.max_length
        out = np.zeros(len(runs), np.int64)
        for own in _batches(lengths, int(lengths.max(initial=0))):
            start, length = starts[own], lengths[own]
            width = int(length.max())
            keys = self._costs(self._matrix(ranks, start, start, start + length, 0, width), width, length - np.arange(width)[:, None])
            whole = np.flatnonzero((length > 1) & (length <= most))
            keys[length[whole] - 1, 0, whole] = FAR
            best = np.zeros((width + most, len(own)), np.int64)
            self._least(keys, best)
            out[own] = best[0] >> 17 + self.bits
        return out


def _forward(weights: np.ndarray, v: np.ndarray, own: int = 0) -> None:
    """Sums over all ways to each place, from those to the first ``own + 1``, which are given."""
    most, width = weights.shape[:2]
    now = np.empty((most, *v.shape[1:]))
    for i in range(width):
        np.multiply(weights[:, i], v[i], out=now)
        low = max(0, own - i)  # a given sum stays
        v[i + 1 + low : i + 1 + most] += now[low:]


def _backward(weights: np.ndarray, v: np.ndarray, ahead: np.ndarray | None = None) -> None:
    """Sums over all ways from each place, from those after the last, which are given.

    With the sums to each place, ``weights`` become those of the ways through each word.
    """
    most, width = weights.shape[:2]
    now = np.empty((most, *v.shape[1:]))
    for i in range(width - 1, -1, -1):
        np.multiply(weights[:, i], v[i + 1 : i + 1 + most], out=now)
        np.sum(now, axis=0, out=v[i])
        if ahead is not None:
            np.multiply(now, ahead[i], out=weights[:, i])


def _batches(lengths: np.ndarray, longest: int) -> Iterator[np.ndarray]:
    """Places of runs of about the same length, few characters at a time; those longer than ``longest`` are left out."""
    order = np.argsort(lengths, kind="stable")
    sorted_lengths = lengths[order]
    low, high = np.searchsorted(sorted_lengths, [0, longest], "right")
    order, sorted_lengths = order[low:high], sorted_lengths[low:high]
    at = 0
    while at < len(order):
        # Runs come longest last, so the n-th costs n times its length.
        most = sorted_lengths[at : at + MATRIX]
        n = max(1, int(np.searchsorted(np.arange(1, len(most) + 1) * most, MATRIX, "right")))
        yield order[at : at + n]
        at += n


def _groups(lengths: np.ndarray, own: np.ndarray) -> Iterator[np.ndarray]:
    """Places of long runs, few characters at a time, one run at least."""
    part = (np.cumsum(lengths[own]) - lengths[own]) // MATRIX
    for k in np.unique(part):
        yield own[part == k]


def runs(texts: DataFrame, column: str, pattern: str = THAI) -> DataFrame:
    """Distinct runs of a text column, and how often they stand there."""
    found = texts.select(F.explode(F.regexp_extract_all(column, F.lit(pattern), F.lit(0))).alias("run"))
    return found.groupBy("run").agg(F.count(F.lit(1)).alias("n"))


def _blocks(batches: Iterator[pd.DataFrame], column: str, most: int = BLOCK) -> Iterator[pd.DataFrame]:
    """Batches put together until they have ``most`` characters."""
    held, size = [], 0
    for batch in batches:
        held.append(batch)
        size += int(batch[column].str.len().sum())
        if size >= most:
            yield pd.concat(held, ignore_index=True)
            held, size = [], 0
    if held:
        yield pd.concat(held, ignore_index=True)


def _counted(texts: list[str], counts: np.ndarray, max_length: int, kept: Callable[[int, np.ndarray], np.ndarray] | None = None) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Of each length, the places where the substrings of runs first stand, and how often they do, each once.

    Places count in the runs one after another with ``max_length`` empty characters after each.
    All places are sorted by what follows them, so substrings with the same beginning are neighbours.
    ``kept`` tells which of a length's counts are wanted.
    """
    lengths = _lengths(texts)
    codes = _flat([t + "\0" * max_length for t in texts])
    chars = np.unique(codes)
    bits = max(1, int(len(chars) - 1).bit_length())
    ranks = np.searchsorted(chars, codes).astype(np.uint64)
    # As many characters as leave room for a place; digits of the sort, the last first.
    room = np.uint64(max(1, int(len(codes)).bit_length()))
    per = max(1, (64 - int(room)) // bits)
    own = np.flatnonzero(codes)
    order, low_bits = None, (np.uint64(1) << room) - np.uint64(1)
    digits = []
    for low in range(0, max_length, per):
        key = np.zeros(len(codes) - max_length, np.uint64)
        for k in range(low, min(low + per, max_length)):
            key <<= np.uint64(bits)
            key |= ranks[k : len(key) + k]
        digits.append((min(per, max_length - low), key[own[own < len(key)]]))
    del codes, ranks, key
    for _, key in reversed(digits):
        placed = ((key if order is None else key[order]) << room) | np.arange(len(own), dtype=np.uint64)
        placed.sort()
        at = (placed & low_bits).astype(np.int64)
        order = at if order is None else order[at]
    del key, at
    digits = [(digits[0][0], placed >> room), *((size, key[order]) for size, key in digits[1:])]
    del placed
    sums = np.concatenate([[0], np.cumsum(np.repeat(counts, lengths)[order])])
    differ = np.zeros(len(order), bool)
    differ[:1] = True
    n = 0
    for size, key in digits:
        for k in range(1, size + 1):
            n += 1
            prefix = key >> np.uint64(bits * (size - k))
            differ[1:] |= prefix[1:] != prefix[:-1]
            first = np.flatnonzero(differ)
            ends = np.append(first[1:], len(order))
            full = (prefix[first] & np.uint64((1 << bits) - 1)) > 0
            first, held = first[full], sums[ends[full]] - sums[first[full]]
            if kept is not None:
                own_kept = kept(n, held)
                first, held = first[own_kept], held[own_kept]
            yield n, own[order[first]], held


def _heavy(max_length: int, most: int, floor: float | None):
    """Of each block of runs, single characters and the substrings of more than a bound, by characters they cover.

    The bound, ``held``, is ``floor``, or else half of the ``most``-th largest; it stands in a row of its own without a word.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for block in _blocks(batches, "run"):
            texts = block["run"].tolist()
            largest, held = np.zeros(0, np.int64), floor or 0.0

            def kept(n: int, counts: np.ndarray) -> np.ndarray:
                nonlocal largest, held
                if n == 1:
                    return np.arange(len(counts))
                if floor is None:
                    largest = np.concatenate([largest, counts * n])
                    if len(largest) > most:
                        largest = np.partition(largest, len(largest) - most)[len(largest) - most :]
                        held = float(largest[0]) / 2  # rises from length to length
                return np.flatnonzero(counts * n > held)

            found = list(_counted(texts, block["n"].to_numpy(np.int64), max_length, kept))
            whole = "".join(t + "\0" * max_length for t in texts)
            words, counts = [""], [np.zeros(1, np.int64)]
            for n, at, c in found:
                sent = np.flatnonzero(c * n > held) if n > 1 else np.arange(len(c))
                words += [whole[i : i + n] for i in at[sent].tolist()]
                counts.append(c[sent])
            yield pd.DataFrame({"word": words, "n": np.concatenate(counts), "held": held})

    return run


def seeds(rows: DataFrame, candidates: int, max_length: int, least: int) -> dict[str, float]:
    """The substrings that cover most characters, and their exact counts; single characters come first.

    A block of runs sends single characters and the substrings that are heavy in it.  A substring's
    total is then at least the sum of what was sent, and at most that and the bounds of the blocks
    that did not send it.  The ``candidates``-th largest of the lower sums bounds what can be
    among the candidates; what reaches it without having come from all blocks is counted in one more
    scan.  Where the bounds together are no lower than that, or too much is left to count, blocks send once
    more, by their part of it; as a last resort they send all.
    """
    size = rows.agg(F.sum(F.length("run"))).first()[0]
    rows = rows.coalesce(max(1, (size or 0) // BLOCK))  # small blocks would send nearly all they have
    floor = None
    for resort in range(3):
        sent = rows.mapInPandas(_heavy(max_length, candidates, floor), "word string, n long, held double").groupBy("word")
        sent = cut(sent.agg(F.sum("n").alias("n"), F.sum("held").alias("held"), F.count(F.lit(1)).alias("blocks")))
        total = sent.where("word = ''").first()
        if total is None:
            return {}
        single, cover = F.length("word") == 1, F.col("n") * F.length("word")
        sums = sent.where("word != ''").withColumn("missing", F.when(single, 0.0).otherwise(F.lit(total["held"]) - F.col("held")))
        sums = sums.withColumn("exact", single | (F.col("blocks") == total["blocks"]) | F.lit(total["held"] == 0))
        worst = sums.where(~single & (F.col("n") >= least)).orderBy(cover.desc()).limit(candidates).agg(F.min(cover).alias("c"), F.count(F.lit(1)).alias("n")).first()
        # A word that no block sent covers at most all bounds together; one that stands less than ``least`` times is no candidate.
        enough = float(worst["c"]) if worst["n"] == candidates else 0.0
        open_ = sums.where(~F.col("exact") & (cover + F.col("missing") >= enough) & (F.col("n") + F.col("missing") / F.length("word") >= least))
        if total["held"] == 0 or (total["held"] < enough and open_.count() <= 10 * candidates):
            break
        floor = 0.0 if resort or not enough else (enough - 1) / total["blocks"]
    exact = sums.where(F.col("exact")).select("word", "n")
    if total["held"] > 0:
        lexicon = Lexicon({r["word"]: 1 for r in open_.select("word").collect()}, max_length)
        if lexicon.words:
            exact = exact.unionAll(rows.mapInPandas(_occurrences(lexicon), "word string, n long").groupBy("word").agg(F.sum("n").alias("n")))
    top = exact.where(single | (F.col("n") >= least)).orderBy(F.desc(single), F.desc(cover), "word").limit(candidates)
    return {r["word"]: float(r["n"]) for r in top.collect()}


def _occurrences(lexicon: Lexicon):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(len(lexicon.words), np.int64)
        for block in _blocks(batches, "run"):
            lexicon.occurrences(block["run"].tolist(), block["n"].to_numpy(np.int64), total)
        hit = np.flatnonzero(total)
        yield pd.DataFrame({"word": [lexicon.words[i] for i in hit], "n": total[hit]})

    return run


def _expectation(lexicon: Lexicon):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(len(lexicon.words))
        for block in _blocks(batches, "run"):
            total += lexicon.expected(block["run"].tolist(), block["n"].to_numpy(np.float64))
        hit = np.flatnonzero(total)
        yield pd.DataFrame({"word": [lexicon.words[i] for i in hit], "n": total[hit]})

    return run


def _digamma(x: np.ndarray) -> np.ndarray:
    """By the recurrence up to 6, then the asymptotic series."""
    x = np.array(x, np.float64)
    out = np.zeros_like(x)
    for _ in range(6):
        low = x < 6
        out[low] -= 1 / x[low]
        x[low] += 1
    return out + np.log(x) - 1 / (2 * x) - 1 / (12 * x**2) + 1 / (120 * x**4) - 1 / (252 * x**6)


def costs_of(counts: dict[str, float]) -> dict[str, int]:
    """Costs from expected counts.

    The digamma function stands for the logarithm, the mean under a sparse Dirichlet prior, so that
    a word must stand out to be one.
    """
    words = list(counts)
    n = np.fromiter(counts.values(), np.float64, len(counts))
    cost = _digamma(np.array([max(float(n.sum()), 1e-3)]))[0] - _digamma(np.maximum(n, 1e-3))
    return dict(zip(words, np.clip(np.rint(cost * UNIT), 1, UNKNOWN).astype(np.int64).tolist()))


def paying(counts: dict[str, float], max_length: int) -> dict[str, float]:
    """Words whose use saves more than their spelling costs; what others stood for falls to their parts.

    A word saves the difference between its cost and that of its best parts as often as it
    is expected; it is spelt out once, a character at the logarithm of how many there are.
    """
    costs = costs_of(counts)
    spelling = math.log(max(2, sum(len(w) == 1 for w in counts)))
    words = [w for w in counts if len(w) > 1]
    kept = {w: n for w, n in counts.items() if len(w) == 1}
    for w, cost in zip(words, Lexicon(costs, max_length).parts(words).tolist()):
        if counts[w] * (cost - costs[w]) / UNIT > spelling * len(w):
            kept[w] = counts[w]
    return kept


def fit(found: DataFrame, most_words: int = 20_000, candidates: int = 100_000, max_length: int = 12, least: int = 2, rounds: int = 5) -> dict[str, int]:
    """Words and costs from ``(run, n)`` rows, as :func:`runs` gives them.

    ``candidates`` and ``most_words`` bound the lexicon before and after; single characters
    always stay, so that every run can be cut.
    """
    # Runs are few bytes but much work: they are dealt to all cores, however small the table.
    rows = cut(found.repartition(max(found.sparkSession.sparkContext.defaultParallelism, int(found.sparkSession.conf.get("spark.sql.shuffle.partitions"))), "run"))
    counts = seeds(rows, candidates, max_length, least)
    single = F.length("word") == 1
    for k in range(rounds):
        if not counts:
            return {}
        lexicon = Lexicon(costs_of(counts if k == 0 else paying(counts, max_length)), max_length)
        summed = rows.mapInPandas(_expectation(lexicon), "word string, n double").groupBy("word").agg(F.sum("n").alias("n"))
        fine = summed.where(single | (F.col("n") >= 0.5)).orderBy(F.desc(single), F.desc("n"), "word")
        counts = {r["word"]: r["n"] for r in fine.limit(max(most_words, int(candidates * 0.6 ** (k + 1))) if k < rounds - 1 else most_words).collect()}
    return costs_of(paying(counts, max_length))


def spaced(text: Column, costs: dict[str, int], pattern: str = THAI, max_length: int = 12) -> Column:
    """A text column with spaces between the words of its runs; other text stays."""
    held: list[Lexicon] = []

    @F.pandas_udf("string")
    def words(texts: pd.Series) -> pd.Series:
        if not held:
            held.append(Lexicon(costs, max_length))
        found: dict[str, int] = {}
        for t in texts.dropna():
            for run in re.findall(pattern, t):
                found.setdefault(run, len(found))
        cuts = [" ".join(w) for w in held[0].segment(list(found))]
        return texts.map(lambda t: None if t is None else re.sub(pattern, lambda m: f" {cuts[found[m[0]]]} ", t).strip())

    return words(text)


def compared(said: DataFrame, costs: dict[str, int], max_length: int = 12) -> DataFrame:
    """How the words of ``(doc_id, said)`` rows are found again without the spaces between them.

    For each document: its words, those found, and how many ends of words are right.
    """
    lexicon = Lexicon(costs, max_length)
    schema = f"doc_id {said.schema['doc_id'].dataType.simpleString()}, words long, found long, right long"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for block in _blocks(batches, "said"):
            codes = _flat([t + " " for t in block["said"]])
            letter = codes != ord(" ")
            said_ends = np.flatnonzero(~letter)
            said_ends -= np.arange(len(said_ends))  # among letters only
            last = np.cumsum([len(t) - t.count(" ") for t in block["said"]])
            found = lexicon.ends(codes[letter], np.diff(last, prepend=0))
            ends = {"words": said_ends, "found": found, "right": np.intersect1d(said_ends, found, assume_unique=True)}
            yield pd.DataFrame({"doc_id": block["doc_id"]} | {k: np.diff(np.searchsorted(v, last, "right"), prepend=0) for k, v in ends.items()}).groupby("doc_id", as_index=False, dropna=False).sum()

    return said.select("doc_id", "said").mapInPandas(run, schema).groupBy("doc_id").agg(*(F.sum(k).alias(k) for k in ("words", "found", "right")))
