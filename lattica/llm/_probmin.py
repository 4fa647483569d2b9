"""ProbMinHash signatures of many weighted shingle sets at once."""

from __future__ import annotations

import numpy as np

from . import _kernels as K

WORDS = 5
_STEP = np.uint64(0x9E3779B97F4A7C15)


def shingles(texts: list[bytes], width: int = WORDS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Owner, hash and count of the distinct shingles of each text, in order of owner then hash.

    A shingle is ``width`` consecutive words; a text of fewer words is one shingle of all of them, and a
    text without words has none.
    """
    data, starts, ends, first = K.words(texts, K.SPACED)
    h = K.byte_hashes(data, starts, ends)
    total = np.diff(first)
    number = np.where(total >= width, total - width + 1, np.minimum(total, 1))
    owner = np.repeat(np.arange(len(texts)), number)
    begin = K.ranges(first[:-1], number)
    end = begin + np.minimum(width, total)[owner]
    code = K.Levels(h).span(begin, end)
    order = np.lexsort((code, owner))
    owner, code = owner[order], code[order]
    new = np.ones(len(code), bool)
    new[1:] = (code[1:] != code[:-1]) | (owner[1:] != owner[:-1])
    at = np.flatnonzero(new)
    return owner[at], code[at], np.diff(np.append(at, len(code)))


def signatures(n: int, owner: np.ndarray, code: np.ndarray, weight: np.ndarray, m: int) -> np.ndarray:
    """n x m components, each the shingle whose first arrival there is the earliest of its text; 0 for a text without shingles.

    Every shingle is a Poisson process at the rate of its weight, whose arrivals fall on random components.
    A shingle stops as soon as its next arrival is later than the latest first arrival of its
    text's components, since nothing that follows can change the signature.
    """
    best = np.full(n * m, np.inf)
    sig = np.zeros(n * m, np.uint64)
    time, state = np.zeros(len(code)), code.copy()
    while len(code):
        state = K.mix(state + _STEP)
        uniform = ((state >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53
        time = time - np.log(uniform) / weight
        latest = best.reshape(n, m).max(1)
        on = time < latest[owner]
        owner, code, weight, time, state = owner[on], code[on], weight[on], time[on], state[on]
        cell = owner * m + (K.mix(state ^ _STEP) % np.uint64(m)).astype(np.int64)
        before = best[cell]
        np.minimum.at(best, cell, time)
        win = (best[cell] == time) & (time < before)
        sig[cell[win]] = code[win]
    return sig.reshape(n, m)


def probability_jaccard(x: np.ndarray, wx: np.ndarray, y: np.ndarray, wy: np.ndarray) -> float:
    """Sum over common shingles i of 1 / sum over all shingles j of max(x_j / x_i, y_j / y_i), which the signatures estimate.

    ``x`` and ``y`` are sorted and distinct. With equal weights this is the Jaccard similarity of the two sets.
    """
    merged = np.sort(np.concatenate([x, y]))
    common = int((merged[1:] == merged[:-1]).sum())
    if not common:
        return 0.0
    if (wx == 1).all() and (wy == 1).all():
        return common / (len(merged) - common)
    every = np.unique(merged)
    a, b = np.zeros(len(every)), np.zeros(len(every))
    a[np.searchsorted(every, x)], b[np.searchsorted(every, y)] = wx, wy
    both = (a > 0) & (b > 0)
    # j counts by a_j / a_i where a_j / b_j is the greater ratio, else by b_j / b_i: two running sums in the order of a / b
    ratio = np.divide(a, b, out=np.full(len(every), np.inf), where=b > 0)
    by = np.argsort(ratio, kind="stable")
    sum_b = np.append(0, np.cumsum(b[by]))
    sum_a = np.append(0, np.cumsum(a[by]))
    at = np.searchsorted(ratio[by], ratio[both])
    return float((1 / ((sum_a[-1] - sum_a[at]) / a[both] + sum_b[at] / b[both])).sum())


def exact_similarity(x: bytes, y: bytes, counted: bool, width: int = WORDS) -> float:
    """The same of two texts, from their words and not from hashes."""
    number: dict[tuple[bytes, ...], int] = {}
    sides = []
    for text in (x, y):
        words = text.split()
        grams = zip(*(words[i:] for i in range(min(width, len(words)))), strict=False) if words else ()
        code, count = np.unique(np.array([number.setdefault(g, len(number)) for g in grams], np.int64), return_counts=True)
        sides += [code, count.astype(float) if counted else np.ones(len(code))]
    return probability_jaccard(*sides)
