"""Vectorised kernels over many texts at once: word bounds, hashes and equality of spans, minimisers.

All work on one ``uint8`` array that holds a block of texts, and cost a few passes over it.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Odd multiplier of the hashes.
BASE = 0x9E3779B97F4A7C15
#: Bytes from which a span is hashed and compared by itself, not with all others eight bytes at a time.
LONG = 1024
#: Bytes of text that a kernel handles at once.
BLOCK_BYTES = 2_000_000

#: Bytes of words by the class [^\x20\x09-\x0D].
SPACED = np.ones(256, bool)
SPACED[[0x20, *range(0x09, 0x0E)]] = False
#: Bytes of words by the class [^\x00-\x2F\x3A-\x60\x7B-\x7F], upper-case ASCII letters counted as their lower-case ones.
ALNUM = np.ones(256, bool)
for _low, _high in ((0x00, 0x2F), (0x3A, 0x40), (0x5B, 0x60), (0x7B, 0x7F)):
    ALNUM[_low : _high + 1] = False
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20


def blocks(texts: list[bytes], most: int = BLOCK_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about ``most`` bytes each; a longer text has a range of its own."""
    begin = size = 0
    for i, t in enumerate(texts):
        if size and size + len(t) > most:
            yield begin, i
            begin, size = i, 0
        size += len(t) + 1
    if begin < len(texts):
        yield begin, len(texts)


def as_bytes(column: pa.Array | pa.ChunkedArray) -> list[bytes]:
    """UTF-8 of a string column; null is empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every input bit (fixed public constants)."""
    x = x ^ (x >> np.uint64(33))
    x *= np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def _joined(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Hash of a pair of hashes, in order."""
    return mix(left * np.uint64(BASE) ^ (right + (right << np.uint64(31))))


def _eights(data: np.ndarray) -> np.ndarray:
    """The eight bytes that start at each place of ``data``, zeros beyond its end, as one integer each; a view, not a copy of them."""
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    return np.ndarray((len(data) + 1,), "<u8", padded, strides=(1,))


#: Masks of the first 0 to 8 of eight bytes.
_FIRST = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)


def byte_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 0) -> np.ndarray:
    """64-bit hashes of the spans [start, end) of bytes, the same for equal spans wherever they stand.

    Eight bytes at a time enter a state whose bits are all mixed in between, so no sum over positions can
    cancel. A hash only proposes: what is removed or linked is compared by bytes or words first, and
    ``seed`` gives another hash where that finds two different spans with the same one.
    """
    size = (ends - starts).astype(np.int64)
    eights = _eights(data)
    first = (size.astype(np.uint64) * np.uint64(BASE) + np.uint64(seed)) ^ (eights[starts] & _FIRST[np.minimum(size, 8)])
    out = mix(first * np.uint64(BASE))
    live, at = np.flatnonzero((size > 8) & (size <= LONG)), 8
    while len(live):
        left = size[live] - at
        out[live] = mix((out[live] ^ (eights[starts[live] + at] & _FIRST[np.minimum(left, 8)])) * np.uint64(BASE))
        live, at = live[left > 8], at + 8
    for i in np.flatnonzero(size > LONG):
        out[i] = int.from_bytes(hashlib.blake2b(data[starts[i] : ends[i]].tobytes(), digest_size=8, key=seed.to_bytes(8, "little")).digest(), "little")
    return out


def equal_spans(data: np.ndarray, a: np.ndarray, b: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Whether the ``size`` bytes at each place ``a`` are those at ``b``."""
    same = np.ones(len(a), bool)
    eights = _eights(data)
    live, at = np.flatnonzero((size > 0) & (size <= LONG)), 0
    while len(live):
        left = size[live] - at
        ok = (eights[a[live] + at] ^ eights[b[live] + at]) & _FIRST[np.minimum(left, 8)] == 0
        same[live[~ok]] = False
        live, at = live[ok & (left > 8)], at + 8
    for i in np.flatnonzero(size > LONG):
        same[i] = (data[a[i] : a[i] + size[i]] == data[b[i] : b[i] + size[i]]).all()
    return same


def variants(data: np.ndarray, start: np.ndarray, size: np.ndarray, group: np.ndarray, digest: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of the spans by group, digest and bytes, and which of them, in that order, is not the span before it.

    ``digest`` is a function of the bytes. Spans of one group and digest are compared byte by byte; those
    that differ are told apart by sorting them, so the order is the same however the spans come.
    """
    by = np.lexsort((digest, group))
    fresh = np.ones(len(by), bool)
    g, d = group[by], digest[by]
    alike = np.flatnonzero((g[1:] == g[:-1]) & (d[1:] == d[:-1]))
    fresh[alike + 1] = False
    x, y = by[alike], by[alike + 1]
    ok = size[x] == size[y]
    ok[ok] = equal_spans(data, start[x[ok]], start[y[ok]], size[x[ok]])
    if not ok.all():
        number = np.cumsum(fresh)
        for n in np.unique(number[alike[~ok] + 1]):
            low, high = np.searchsorted(number, [n, n + 1])
            body = [data[start[i] : start[i] + size[i]].tobytes() for i in by[low:high]]
            order = sorted(range(len(body)), key=body.__getitem__)
            by[low:high] = by[low:high][order]
            fresh[low + 1 : high] = [body[p] != body[q] for p, q in zip(order, order[1:], strict=False)]
    return by, fresh


class Levels:
    """Hashes of all runs of 1, 2, 4, ... symbols; a run of any length is hashed by the two of them that cover it."""

    def __init__(self, symbols: np.ndarray) -> None:
        self.of = [symbols]

    def level(self, k: int) -> np.ndarray:
        while len(self.of) <= k:
            last, step = self.of[-1], 1 << (len(self.of) - 1)
            self.of.append(_joined(last[:-step], last[step:]) if len(last) > step else last[:0])
        return self.of[k]

    def span(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """64-bit hashes of the runs [start, end), the same for equal runs wherever they stand."""
        size = end - start
        out = np.zeros(len(size), np.uint64)
        power = np.frexp(size.astype(np.float64))[1] - 1
        for k in np.unique(power[size > 0]).tolist():
            at = np.flatnonzero(power == k)
            h = self.level(k)
            out[at] = _joined(h[start[at]], h[end[at] - (1 << k)])
        return mix(out + size.astype(np.uint64))


def words(texts: list[bytes], inside: np.ndarray, lower: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Bytes of the texts joined by line feeds; starts and ends of the words; and each text's first word, with the total at the end."""
    data = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
    if lower:
        data = LOWER[data]
    flag = np.zeros(len(data) + 1, np.int8)
    flag[1:] = inside[data]
    step = np.diff(flag)
    starts, ends = np.flatnonzero(step == 1), np.flatnonzero(step == -1)
    begin = np.zeros(len(texts) + 1, np.int64)
    np.cumsum([len(t) + 1 for t in texts], out=begin[1:])
    return data, starts, ends, np.searchsorted(starts, begin)


def sliding_min(a: np.ndarray, width: int) -> np.ndarray:
    """Least value of each ``width`` neighbours, by doubling."""
    span = 1
    while span * 2 <= width:
        a = np.minimum(a[:-span], a[span:])
        span *= 2
    return np.minimum(a[: len(a) - (width - span)], a[width - span :]) if span < width else a


def byte_grams(data: np.ndarray) -> np.ndarray:
    """Hashes of all runs of 16 bytes."""
    if len(data) < 16:
        return np.zeros(0, np.uint64)
    eights = np.ascontiguousarray(_eights(data)[: len(data) - 7])
    return _joined(eights[:-8], eights[8:])


def distinct_runs(owner: np.ndarray) -> np.ndarray:
    """Where a run of equal values starts."""
    first = np.ones(len(owner), bool)
    if len(owner):
        np.not_equal(owner[1:], owner[:-1], out=first[1:])
    return np.flatnonzero(first)


def ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The concatenated ranges start, start + 1, ... of each length."""
    total = int(lengths.sum())
    out = np.ones(total, np.int64)
    keep = lengths > 0
    starts, lengths = starts[keep], lengths[keep]
    if not total:
        return out
    at = np.cumsum(lengths) - lengths
    out[0] = starts[0]
    out[at[1:]] = starts[1:] - (starts[:-1] + lengths[:-1] - 1)
    return np.cumsum(out)


def word_array(texts: list[bytes], inside: np.ndarray, lower: bool = False) -> tuple[pa.BinaryArray, np.ndarray]:
    """The words of the texts as an Arrow array, and each text's first word, with the total at the end."""
    data, starts, ends, first = words(texts, inside, lower)
    return binary_array(data[inside[data]], ends - starts), first


def binary_array(data: np.ndarray, lengths: np.ndarray) -> pa.BinaryArray:
    """Consecutive spans of ``data`` (uint8) as an Arrow array."""
    if len(data) > np.iinfo(np.int32).max:
        raise ValueError("more than 2 GB of words at once")
    offsets = np.zeros(len(lengths) + 1, np.int32)
    np.cumsum(lengths, out=offsets[1:])
    return pa.Array.from_buffers(pa.binary(), len(lengths), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data))])


def span_bytes(array: pa.BinaryArray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of an Arrow array without nulls, and the offsets of its values in them."""
    offsets = np.frombuffer(array.buffers()[1], np.int32)[array.offset : array.offset + len(array) + 1]
    data = array.buffers()[2]
    return np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8), offsets.astype(np.int64)


def joined_lines(array: pa.BinaryArray) -> bytes:
    """The values of an Arrow array, each with a line feed behind it; ``split_lines`` undoes it."""
    data, offsets = span_bytes(array)
    size = np.diff(offsets)
    out = np.full(int(size.sum()) + len(size), 10, np.uint8)
    kept = np.ones(len(out), bool)
    kept[np.cumsum(size + 1) - 1] = False
    out[kept] = data[offsets[0] : offsets[-1]]
    return out.tobytes()


def split_lines(blobs: list[bytes]) -> tuple[pa.BinaryArray, np.ndarray]:
    """The values of several results of ``joined_lines``, and how many each holds."""
    data = np.frombuffer(b"".join(blobs), np.uint8)
    ends = np.flatnonzero(data == 10)
    many = np.diff(np.searchsorted(ends, np.cumsum([0, *map(len, blobs)])))
    return binary_array(data[data != 10], np.diff(ends, prepend=-1) - 1), many
