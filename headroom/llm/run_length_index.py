"""A run-compressed Burrows-Wheeler transform of a collection, and what it says about repeats.

Rows of the transform are the sorted suffixes of all texts, each text with an end mark of its own. Only the
ends of its runs are kept, with the suffix that stands there and how far it agrees with its
neighbour across the border of the run. Inside a run the letter before two neighbouring suffixes is
the same, so the suffixes one letter further left are neighbours too and agree on one letter more. Read
along a text from left to right, the match of a position with its neighbour is therefore that of
the position before less one, unless the position is a sampled run end: matching statistics of
the collection against itself, streamed from the samples.

Repetitive collections have few runs, so few samples and few direct comparisons.
"""

from __future__ import annotations

import numpy as np

_SYMBOL_BITS, _FIRST = 9, 7  # seven symbols in the first sort key


def sorted_suffixes(data: np.ndarray, left: np.ndarray) -> np.ndarray:
    """Begins of the suffixes in order; ``left`` is how much of its text a position has before it.

    An end mark is smaller than any letter, and marks compare as their texts stand. Prefixes are
    sorted by doubling; only positions that still share their rank are sorted again. Places have 32 bits.
    """
    size = len(data)
    padded = np.concatenate([data.astype(np.int16) + 1, np.zeros(_FIRST, np.int16)])
    keys = np.zeros(size, np.int64)
    for j in range(_FIRST):
        keys = (keys << _SYMBOL_BITS) | np.where(left > j, padded[j : j + size], 0)
    order = np.argsort(keys, kind="stable").astype(np.int32)
    keys = keys[order]
    first = np.r_[True, keys[1:] != keys[:-1]]
    del keys, padded
    rank = np.empty(size, np.int32)
    rank[order] = np.maximum.accumulate(np.where(first, np.arange(size, dtype=np.int32), 0)) + 1
    step, longest = _FIRST, int(left.max(initial=0))
    while step < longest:
        # classes of one are settled; the others lie in runs of ``order``
        single = first & np.r_[first[1:], True]
        at = np.flatnonzero(~single)
        if not len(at):
            break
        open_ones = order[at]
        beyond = np.where(left[open_ones] > step, rank[np.minimum(open_ones + step, size - 1)], 0)
        keys = rank[open_ones].astype(np.int64) * (size + 1) + beyond
        again = np.argsort(keys, kind="stable")
        order[at] = open_ones[again]
        keys = keys[again]
        new = np.r_[True, keys[1:] != keys[:-1]]
        first[at] = new
        rank[order[at]] = np.maximum.accumulate(np.where(new, at, 0)) + 1
        step *= 2
    return order


def _agreement(words: np.ndarray, a: np.ndarray, b: np.ndarray, most: np.ndarray) -> np.ndarray:
    """How many letters the suffixes at ``a`` and ``b`` share, eight at a time; ``most`` bounds each."""
    shared = np.zeros(len(a), np.int64)
    going = np.flatnonzero(most > 0)
    while len(going):
        x = words[a[going] + shared[going]] ^ words[b[going] + shared[going]]
        equal = x == 0
        low = x & (~x + np.uint64(1))  # lowest bit that differs; letters stand from low to high bytes
        letters = np.where(equal, 8, np.log2(np.where(equal, 1, low).astype(np.float64)).astype(np.int64) >> 3)
        shared[going] += letters
        going = going[equal & (shared[going] < most[going])]
    return np.minimum(shared, most)


class RunLengthIndex:
    """Samples at the run ends of the transform of ``texts``."""

    def __init__(self, texts: list[bytes]):
        sizes = np.array([len(t) for t in texts], np.int64)
        self.data = np.frombuffer(b"".join(texts), np.uint8)
        self.begins = np.cumsum(sizes) - sizes
        ends = np.repeat(self.begins + sizes, sizes)
        left = (ends - np.arange(len(self.data))).astype(np.int32)
        del ends
        suffixes = sorted_suffixes(self.data, left)
        before = np.full(len(self.data), -1, np.int32)
        before[1:] = self.data[:-1]
        # the mark before a text's first letter is like no other: it never continues a run
        before[self.begins[sizes > 0]] = -1 - np.flatnonzero(sizes > 0)
        transform = before[suffixes]
        border = np.flatnonzero(transform[1:] != transform[:-1]) + 1  # rows that begin a run
        self.runs = len(border) + 1 if len(self.data) else 0
        above, below = suffixes[border - 1], suffixes[border]
        padded = np.concatenate([self.data, np.zeros(16, np.uint8)])
        words = np.zeros(len(self.data) + 8, np.uint64)
        for j in range(8):
            words |= padded[j : j + len(words)].astype(np.uint64) << np.uint64(8 * j)
        shared = _agreement(words, above, below, np.minimum(left[above], left[below]))
        #: begin of a run -> agreement with the row above; end of a run -> with the row below
        self.samples = ((below, shared), (above, shared))
        self.ends_of_table = (suffixes[:1], suffixes[-1:])

    def matching_statistics(self) -> np.ndarray:
        """For every position the longest match that begins anywhere else in the collection."""
        best = np.zeros(len(self.data), np.int64)
        place = np.arange(len(self.data))
        for (where, shared), edge in zip(self.samples, self.ends_of_table):
            at = np.full(len(self.data), -1, np.int64)
            value = np.zeros(len(self.data), np.int64)
            at[where], value[where] = where, shared
            at[edge], value[edge] = edge, 0  # first and last row have one neighbour only
            last = np.maximum.accumulate(at)
            best = np.maximum(best, value[last] - (place - last))
        return best
