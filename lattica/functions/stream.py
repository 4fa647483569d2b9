"""The number stream of a C library's rand(), from any place on: an additive-feedback generator with jump-ahead.

The stream is r[n] = r[n - 3] + r[n - 31] modulo 2**32, of which the upper 31 bits count. x**n modulo x**31 - x**28 - 1 says how
r[n] and what follows come from the first 31 values, so a block of rows computes its own values, wherever it begins.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

#: Lags of the generator, values that are dropped before the first one counts, and the multiplier and modulus of its seed (fixed values).
LONG, SHORT, DROPPED = 31, 3, 310
MULTIPLIER, MODULUS = 16807, 2147483647
GREATEST = 2147483647
#: Rows whose values are made at once.
BLOCK = 1 << 13
_MASK = (1 << 32) - 1


def seeded(seed: int) -> list[int]:
    """The first 31 values that follow the recurrence; seed 0 stands for 1."""
    word = (seed or 1) & _MASK
    word -= (word >> 31) << 32
    state = [word & _MASK]
    for _ in range(LONG - 1):
        # the remainder of a division that rounds to zero, made positive
        word = MULTIPLIER * word % MODULUS if word >= 0 else -(MULTIPLIER * -word % MODULUS)
        if word < 0:
            word += MODULUS
        state.append(word)
    # the values 31 to 33 repeat 0 to 2, from which the recurrence holds
    return state[SHORT:] + state[:SHORT]


def _times(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Product of two polynomials modulo x**31 - x**28 - 1 and 2**32."""
    full = np.zeros(2 * LONG - 1, np.uint64)
    for k in range(LONG):
        full[k : k + LONG] = (full[k : k + LONG] + a[k] * b) & np.uint64(_MASK)
    for k in range(2 * LONG - 2, LONG - 1, -1):
        full[k - LONG] = (full[k - LONG] + full[k]) & np.uint64(_MASK)
        full[k - SHORT] = (full[k - SHORT] + full[k]) & np.uint64(_MASK)
    return full[:LONG]


def power(n: int) -> np.ndarray:
    """Coefficients of x**n."""
    out, base = np.zeros(LONG, np.uint64), np.zeros(LONG, np.uint64)
    out[0] = base[1] = 1
    while n:
        if n & 1:
            out = _times(out, base)
        base, n = _times(base, base), n >> 1
    return out


def _following(state: list[int], count: int) -> list[int]:
    """``state`` and the values after it, ``count`` in all."""
    out = list(state)
    while len(out) < count:
        out.append((out[-SHORT] + out[-LONG]) & _MASK)
    return out[:count]


@lru_cache(maxsize=64)
def block(seed: int, number: int, size: int = BLOCK) -> np.ndarray:
    """Values number * size, ..., of the stream as doubles from -1 to 1."""
    first = seeded(seed)
    known = np.array(_following(first, 2 * LONG), np.uint64)
    jump = power(LONG + DROPPED + number * size)
    start = [int((jump * known[k : k + LONG]).sum() & np.uint64(_MASK)) for k in range(LONG)]
    values = np.array(_following(start, size), np.uint64) >> np.uint64(1)
    return 2.0 * (values.astype(np.float64) / GREATEST) - 1.0


def with_stream(rows: DataFrame, seed: int, column: str = "i", size: int = BLOCK) -> DataFrame:
    """i, val: the value that the stream has for each row number, before any scaling."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            i = batch.column(0).to_numpy()
            of = i // size
            val = np.zeros(len(i))
            for number in np.unique(of):
                at = np.flatnonzero(of == number)
                val[at] = block(seed, int(number), size)[i[at] % size]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(val)], names=["i", "val"])

    return rows.select(rows[column].cast("long").alias("i")).mapInArrow(run, "i long, val double")
