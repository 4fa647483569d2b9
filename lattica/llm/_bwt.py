"""Burrows-Wheeler transforms of string collections and their merging by interleave refinement."""

from __future__ import annotations

import numpy as np

from . import _kernels as K


class Transform:
    """Transform of strings (bytes, none holding 0xFF), each with a terminator that sorts before every byte.

    ``order`` has the place of the k-th smallest suffix, compared to ``depth`` symbols, in the symbols of
    all strings with their terminators; terminators are in the order of the strings. ``last`` is the
    symbol before each suffix.
    """

    def __init__(self, data: np.ndarray, sizes: np.ndarray, depth: int) -> None:
        self.sizes = sizes
        n = int(sizes.sum()) + len(sizes)
        self.begin = np.cumsum(sizes + 1) - (sizes + 1)
        symbols = np.zeros(n, np.uint8)
        symbols[K.ranges(self.begin, sizes)] = data + np.uint8(1)
        left = np.repeat(self.begin + sizes, sizes + 1) - np.arange(n)  # symbols before the terminator
        columns = []
        padded = np.concatenate([symbols, np.zeros(depth + 8, np.uint8)])
        for at in range(0, depth, 8):
            word = np.zeros(n, np.uint64)
            for i in range(at, min(at + 8, depth)):
                word = (word << np.uint64(8)) | np.where(left > i, padded[i : i + n], 0).astype(np.uint64)
            columns.append(word)
        place = np.where(left == 0, np.arange(n), 0)  # equal but for terminators: those by string
        self.order = np.lexsort([place, *columns[::-1]])
        before = np.zeros(n, np.uint8)
        before[1:] = symbols[:-1]
        before[self.begin] = 0
        self.last = before[self.order]


def interleave(parts: list[Transform], depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Source of each rank of the merged suffixes, and the symbols, up to ``depth``, that it has in common with the rank's before.

    The first interleave has each part whole. A refinement reads all transforms in the order of the last
    interleave and deals their symbols out stably: what was in order by h symbols is then in order by
    h + 1. Neighbours that a dealt symbol, or an earlier step, has told apart start a new interval; an
    interval's place is final, so the step at which one first starts at a rank is its common prefix.
    """
    source = np.repeat(np.arange(len(parts), dtype=np.uint8), [len(p.last) for p in parts])
    ends = np.repeat(np.arange(len(parts), dtype=np.uint8), [len(p.sizes) for p in parts])
    n = len(source)
    fresh = np.zeros(n, bool)
    fresh[:1] = True
    common = np.full(n, depth, np.int32)
    common[:1] = 0
    for step in range(depth):
        symbol = np.empty(n, np.uint8)
        for i, p in enumerate(parts):
            symbol[source == i] = p.last
        interval = np.cumsum(fresh, dtype=np.int32)
        by = np.argsort(symbol, kind="stable")
        source, interval, symbol = source[by], interval[by], symbol[by]
        fresh = np.ones(n, bool)
        np.not_equal(interval[1:], interval[:-1], out=fresh[1:])
        fresh[1:] |= symbol[1:] != symbol[:-1]
        source[: len(ends)] = ends  # terminators differ from one another
        fresh[: len(ends) + 1] = True
        np.minimum(common, step, out=common, where=fresh)
    return source, common


def repeated_intervals(data: np.ndarray, sizes: np.ndarray, depth: int, parts: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """String, place in it and interval of each substring of ``depth`` symbols; equal substrings share an interval."""
    cuts = np.unique(np.linspace(0, len(sizes), parts + 1).astype(np.int64))
    ends = np.append(0, np.cumsum(sizes))
    made = [Transform(data[ends[a] : ends[b]], sizes[a:b], depth) for a, b in zip(cuts, cuts[1:], strict=False)]
    source, common = interleave(made, depth)
    interval = np.cumsum(common < depth)
    strings, places, ids = [], [], []
    for i, t in enumerate(made):
        at = t.order
        string = np.searchsorted(t.begin, at, side="right") - 1
        place = at - t.begin[string]
        whole = place + depth <= t.sizes[string]
        strings.append(string[whole] + cuts[i])
        places.append(place[whole])
        ids.append(interval[source == i][whole])
    return np.concatenate(strings), np.concatenate(places), np.concatenate(ids)
