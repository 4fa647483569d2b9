"""Media columns: chroma fingerprints of recordings, and their alignment.

A recording's frames are folded into twelve pitch classes. Over the integral image of that strip, sixteen
box filters compare areas at each frame; each comparison gives two bits in Gray code, and a frame's
sixteen make one packed 32-bit integer. Two recordings are aligned by a histogram of the offsets at
which the integers' leading bits agree; the fullest offset's share of different bits over the
overlap decides.

A search takes a set of query recordings against all, in blocks: a block's fingerprints, of a
bounded number of queries, are broadcast with their postings, and each recording meets the block within
its own row. No pair is a row, and ``STEP_BLOCKS`` blocks are one narrow step. A recording's hits in a block are
counted in one array of queries x offsets; fullest offsets are found, and bits compared there, for many recordings at once.

Cases: null and empty recordings have no frames and match nothing, nor do those shorter than the widest
filter; a trailing odd byte is dropped; silence gives equal integers and may match silence; repeated
rows are recordings of their own; a recording is no match of the query of the same id; null ids are
searched but are no queries; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field
from functools import cached_property
from itertools import batched

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import drop_stash, stash, table

RATE, FRAME, HOP = 4000, 1024, 256
LOWEST_HZ = 60.0
#: What two areas are compared by: halves or thirds of the box in pitch or time, or its quarters crosswise; then first class, classes, frames.
FILTERS = (
    *(("pitch_halves", y, h, 4) for y, h in ((0, 12), (0, 6), (3, 6), (6, 6))),
    *(("time_halves", y, 3, 8) for y in (0, 3, 6, 9)),
    *(("quarters", y, h, 8) for y, h in ((0, 12), (0, 6), (6, 6))),
    *(("time_thirds", y, 4, 9) for y in (0, 4, 8)),
    *(("pitch_thirds", y, h, 4) for y, h in ((0, 12), (3, 9))),
)
WIDEST = max(f[3] for f in FILTERS)
#: The middle of the four levels of a comparison reaches this far from 0.
LEVEL = 0.2
#: Leading bits of the integers that postings are kept by; hits at one offset that make a candidate; least overlap; most different bits.
KEY_BITS, LEAST_HITS, LEAST_OVERLAP, MOST_ERRORS = 20, 3, 0.5, 0.2
BLOCK_QUERIES = 2048
#: Frames of a block's queries (one query may have more), and blocks of a narrow step.
BLOCK_FRAMES, STEP_BLOCKS = 1 << 18, 16
#: Frames that are transformed at once, frames of strips that are packed at once, cells of an array of hits (else they are sorted), and words compared at once.
CHROMA_FRAMES, PACK_FRAMES, GRID, COMPARED = 32, 1 << 13, 1 << 22, 1 << 15
#: Recordings that meet a block together, recordings of a task, and most tasks.
TOGETHER, TASK_RECORDINGS, TASKS = 64, 256, 512
QUERY_EVERY = 50

_CLASSES = np.zeros((FRAME // 2 + 1, 12))
for _bin in range(1, FRAME // 2 + 1):
    _hz = _bin * RATE / FRAME
    if _hz >= LOWEST_HZ:
        _CLASSES[_bin, round(12 * math.log2(_hz / 440.0)) % 12] = 1.0
_TAPER = np.hanning(FRAME)


def chroma(pcm: np.ndarray) -> np.ndarray:
    """Frames x 12 shares of energy of mono samples; zeros where a frame is silent."""
    if len(pcm) < FRAME:
        return np.zeros((0, 12))
    frames = np.lib.stride_tricks.sliding_window_view(pcm, FRAME)[::HOP]
    some = [frames[i : i + CHROMA_FRAMES] for i in range(0, len(frames), CHROMA_FRAMES)]
    energy = np.concatenate([(np.abs(np.fft.rfft(x * _TAPER)) ** 2) @ _CLASSES for x in some])
    total = energy.sum(1, keepdims=True)
    return np.divide(energy, total, out=np.zeros_like(energy), where=total > 1e-9)


def pack(strip: np.ndarray) -> np.ndarray:
    """One integer for each frame that the widest filter fits at."""
    return pack_all(strip[None])[0]


def pack_all(strips: np.ndarray) -> np.ndarray:
    """``pack`` of strips of one length."""
    n = max(0, strips.shape[1] - WIDEST + 1)
    if not n:
        return np.zeros((len(strips), 0), np.uint32)
    image = np.zeros((13, len(strips), strips.shape[1] + 1))
    image[1:, :, 1:] = strips.cumsum(1).cumsum(2).transpose(2, 0, 1)

    def area(t0: int, t1: int, y0: int, y1: int) -> np.ndarray:
        return image[y1, :, t1 : t1 + n] - image[y1, :, t0 : t0 + n] - image[y0, :, t1 : t1 + n] + image[y0, :, t0 : t0 + n]

    out = np.zeros((len(strips), n), np.uint32)
    for kind, y, h, w in FILTERS:
        whole = area(0, w, y, y + h)
        if kind == "pitch_halves":
            some = area(0, w, y, y + h // 2)
        elif kind == "time_halves":
            some = area(0, w // 2, y, y + h)
        elif kind == "quarters":
            some = area(0, w // 2, y, y + h // 2) + area(w // 2, w, y + h // 2, y + h)
        elif kind == "time_thirds":
            some = 1.5 * area(w // 3, w - w // 3, y, y + h)
        else:
            some = 1.5 * area(0, w, y + h // 3, y + h - h // 3)
        balance = np.divide(2 * some - whole, whole, out=np.zeros(whole.shape), where=whole > 1e-9)
        level = (balance >= -LEVEL).astype(np.uint32) + (balance >= 0) + (balance >= LEVEL)
        out = (out << np.uint32(2)) | (level ^ (level >> 1)).astype(np.uint32)
    return out


def fingerprint_pcm(audio: bytes | None) -> np.ndarray:
    """Packed integers of 16-bit little-endian mono samples."""
    return fingerprint_all([audio])[0]


def fingerprint_all(audios: list[bytes | None]) -> list[np.ndarray]:
    """``fingerprint_pcm`` of each; recordings of one length are packed together."""
    strips = [chroma(np.frombuffer(a[: len(a) // 2 * 2], "<i2").astype(np.float64) / 32768) for a in (x or b"" for x in audios)]
    alike: dict[int, list[int]] = {}
    for i, strip in enumerate(strips):
        alike.setdefault(len(strip), []).append(i)
    out = [np.zeros(0, np.uint32)] * len(audios)
    for size, of in alike.items():
        for part in batched(of, max(1, PACK_FRAMES // max(1, size))):
            for i, marks in zip(part, pack_all(np.stack([strips[i] for i in part])), strict=True):
                out[i] = marks
    return out


def fingerprints(recordings: DataFrame, keep: list[str], audio: str = "audio", read: Callable | None = None) -> DataFrame:
    """The columns ``keep`` and ``fingerprint`` (array of int) of a binary column, or of one of which ``read`` makes samples."""
    kinds = ", ".join(f"`{c}` {recordings.schema[c].dataType.simpleString()}" for c in keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            marks: list[np.ndarray] = []
            for i in range(0, len(batch), 64):
                sound = batch.column(audio).slice(i, 64).to_pylist()
                marks += [m.view(np.int32) for m in fingerprint_all([read(x) for x in sound] if read else sound)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(marks, pa.list_(pa.int32()))], names=[*keep, "fingerprint"])

    return recordings.select(*keep, audio).mapInArrow(run, f"{kinds}, fingerprint array<int>")


@dataclass
class Block:
    """Fingerprints of some queries end to end; what a search needs besides is made where it runs."""

    ids: np.ndarray
    marks: np.ndarray
    first: np.ndarray
    _cells: dict[int, np.ndarray] = field(default_factory=dict)

    @cached_property
    def postings(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Different keys and the least one that there isn't, where each key's postings begin, and queries and places by key."""
        query = np.repeat(np.arange(len(self.ids), dtype=np.int32), self.size)
        place = (np.arange(len(self.marks)) - self.first[query]).astype(np.int32)
        key = _key(self.marks)
        by = np.argsort(key, kind="stable")
        keys, start = np.unique(key[by], return_index=True)
        return np.append(keys, np.uint32(1 << KEY_BITS)), np.append(start, [len(by)] * 2), query[by], place[by]

    @cached_property
    def size(self) -> np.ndarray:
        return np.diff(self.first)

    @cached_property
    def width(self) -> int:
        return int(self.size.max(initial=0))

    @cached_property
    def ones(self) -> np.ndarray:
        """Bits set before each place of ``marks``."""
        return _ones(self.marks)

    @cached_property
    def rows(self) -> tuple[np.ndarray, np.ndarray, dict[int, np.ndarray]]:
        """Of each query a width of its size or somewhat more and its row in the fingerprints of that width, filled with 0."""
        step = 1 << np.maximum(1, np.frexp(self.size)[1] - 3)
        wide, row, tables = -(-self.size // step) * step, np.zeros(len(self.size), np.int64), {}
        for w in np.unique(wide).tolist():
            of = np.flatnonzero(wide == w)
            row[of], tables[w] = np.arange(len(of)), np.zeros((len(of), w), np.uint32)
            for table_row, q in zip(tables[w], of, strict=True):
                table_row[: self.size[q]] = self.marks[self.first[q] : self.first[q + 1]]
        return wide, row, tables

    def cells(self, across: int) -> np.ndarray:
        """Of each posting its cell in an array of queries x ``across`` offsets, the least one -width, for the first frame of a recording."""
        if across not in self._cells:
            if len(self._cells) == 4:
                self._cells.clear()
            _, _, query, place = self.postings
            kind = np.int32 if len(self.ids) * across < 1 << 31 else np.int64
            self._cells[across] = query * kind(across) + (self.width - place)
        return self._cells[across]


def _ones(marks: np.ndarray) -> np.ndarray:
    out = np.zeros(len(marks) + 1, np.int64)
    np.bitwise_count(marks).cumsum(out=out[1:])
    return out


def _key(marks: np.ndarray) -> np.ndarray:
    return marks >> np.uint32(32 - KEY_BITS)


def make_block(ids: Sequence[int], marks: list[np.ndarray]) -> Block:
    flat = np.concatenate([*marks, np.zeros(0, np.uint32)]).astype(np.uint32)
    return Block(np.array(ids, np.int64), flat, np.append(0, np.cumsum([len(m) for m in marks], dtype=np.int64)))


def errors_at(mark: np.ndarray, other: np.ndarray, offset: int) -> float:
    """Share of different bits where ``other`` begins ``offset`` frames after ``mark``; 1 if they overlap too little."""
    a, b = max(0, offset), min(len(mark), len(other) + offset)
    if b - a < LEAST_OVERLAP * min(len(mark), len(other)) or b <= a:
        return 1.0
    return float(np.bitwise_count(mark[a:b] ^ other[a - offset : b - offset]).sum()) / (32 * (b - a))


def all_errors(block: Block, record: np.ndarray, other: Block, query: np.ndarray, offset: np.ndarray) -> np.ndarray:
    """``errors_at`` for fingerprints of ``block`` and of ``other`` (by their places there) and offsets."""
    out = np.ones(len(query))
    n, size = block.size[record], other.size[query]
    both = np.minimum(n, size + offset) - np.maximum(0, offset)
    enough = np.flatnonzero((both >= LEAST_OVERLAP * np.minimum(n, size)) & (both > 0))
    if not len(enough):
        return out
    record, query, offset, n, size, both = (x[enough] for x in (record, query, offset, n, size, both))
    wide, row, tables = other.rows
    wide, row, bits = wide[query], row[query], np.zeros(len(query), np.int64)
    for w, rows in tables.items():
        of = np.arange(len(query)) if len(tables) == 1 else np.flatnonzero(wide == w)
        if not len(of):
            continue
        # each fingerprint between w zeros
        around = np.zeros(len(block.marks) + w * (len(block.ids) + 1), np.uint32)
        around[np.arange(len(block.marks)) + w * np.repeat(np.arange(1, len(block.ids) + 1), block.size)] = block.marks
        windows = np.ndarray((len(around) - w + 1, w), np.uint32, around, strides=(4, 4))
        begin = block.first[record] + w * (record + 1) + offset
        for i in range(0, len(of), max(1, COMPARED // w)):
            at = of[i : i + max(1, COMPARED // w)]
            bits[at] = np.bitwise_count((windows[begin[at]] ^ rows[row[at]]).view(np.uint64)).sum(1, dtype=np.int64)
    # what stands outside the overlap was compared with 0
    first = other.first[query]
    bits -= other.ones[first - np.minimum(offset, 0)] - other.ones[first] + other.ones[first + size] - other.ones[first + np.minimum(n - offset, size)]
    first = block.first[record]
    bits -= block.ones[first + np.minimum(offset + wide, n)] - block.ones[first + np.minimum(offset + size, n)]
    out[enough] = bits / (32 * both)
    return out


def hit_cells(mark: np.ndarray, block: Block) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Queries (by place in ``block``, ascending) and offsets with ``LEAST_HITS`` or more, and their number."""
    keys, start, _, _ = block.postings
    key = _key(mark)
    at = np.searchsorted(keys, key)
    low, high = start[at], start[at + (keys[at] == key)]
    across = -(-(len(mark) + block.width) // 16) * 16
    cells = block.cells(across)
    code = np.concatenate([cells[i:j] for i, j in zip(low.tolist(), high.tolist(), strict=True)]) + np.repeat(np.arange(len(mark)), high - low)
    if len(block.ids) * across > max(GRID, len(code)):
        code, hits = np.unique(code, return_counts=True)
        code, hits = code[hits >= LEAST_HITS], hits[hits >= LEAST_HITS]
    else:
        grid = np.zeros(len(block.ids) * across, np.min_scalar_type(min(len(mark), block.width)))
        np.add.at(grid, code, grid.dtype.type(1))
        eight = np.flatnonzero((grid >= LEAST_HITS).view(np.uint64) != 0)
        code = (eight[:, None] * 8 + np.arange(8)).ravel()
        hits = grid[code]
        code, hits = code[hits >= LEAST_HITS], hits[hits >= LEAST_HITS].astype(np.int64)
    query = code // across
    return query, code - query * across - block.width, hits


def matches(marks: list[np.ndarray], block: Block) -> list[tuple[int, int, int, float]]:
    """Place in ``marks``, query id, offset and share of different bits of the fingerprints and queries that match, in this order."""
    some = [i for i, m in enumerate(marks) if len(m)] if len(block.marks) else []
    found = [hit_cells(marks[i], block) for i in some]
    query, offset, hits = (np.concatenate([f[k] for f in found] + [np.zeros(0, np.int64)]) for k in range(3))
    if not len(query):
        return []
    record = np.repeat(some, [len(f[0]) for f in found])
    begin = np.flatnonzero(np.append(True, (query[1:] != query[:-1]) | (record[1:] != record[:-1])))
    # the most hits, then the least distance, then the offset before
    rank = 2 * np.abs(offset) + (offset > 0)
    most = int(rank.max()) + 1
    rank = most - 1 - np.maximum.reduceat(hits * most + (most - 1 - rank), begin) % most
    record, query, offset = record[begin], query[begin], np.where(rank & 1, rank >> 1, -(rank >> 1))
    errors = all_errors(make_block(range(len(marks)), marks), record, block, query, offset)
    near = errors <= MOST_ERRORS
    return list(zip(record[near].tolist(), block.ids[query[near]].tolist(), offset[near].tolist(), errors[near].tolist(), strict=True))


def align(mark: np.ndarray, block: Block) -> list[tuple[int, int, float]]:
    """Query id, offset and share of different bits of the queries that match."""
    return [m[1:] for m in matches([mark], block)]


def query_blocks(queries: DataFrame, most: int) -> Iterator[Block]:
    ids: list[int] = []
    marks: list[np.ndarray] = []
    frames = 0
    for row in queries.toLocalIterator():
        mark = np.array(row[1], np.int32).view(np.uint32)
        if ids and (len(ids) == most or frames + len(mark) > BLOCK_FRAMES):
            yield make_block(ids, marks)
            ids, marks, frames = [], [], 0
        ids.append(row[0])
        marks.append(mark)
        frames += len(mark)
    if ids:
        yield make_block(ids, marks)


def search(marked: DataFrame, queries: DataFrame, most: int = BLOCK_QUERIES) -> DataFrame:
    """``marked`` (rec_id, fingerprint) with links (query, offset, errors) of all matching ``queries`` (the same columns), by errors."""
    out, written = marked.withColumn("links", F.array().cast("array<struct<query:bigint,offset:int,errors:double>>")), None
    kind = pa.list_(pa.struct([("query", pa.int64()), ("offset", pa.int32()), ("errors", pa.float64())]))
    context = marked.sparkSession.sparkContext
    blocks = (context.broadcast(b) for b in query_blocks(queries.select("rec_id", "fingerprint"), most))
    for done, step in enumerate(batched(blocks, STEP_BLOCKS)):

        def run(batches: Iterator[pa.RecordBatch], step=step) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                links, recs = batch.column("links").to_pylist(), batch.column("rec_id").to_pylist()
                marks = [x.values.to_numpy().view(np.uint32) for x in batch.column("fingerprint")]
                for known in step:
                    for at in range(0, len(marks), TOGETHER):
                        for i, q, o, e in matches(marks[at : at + TOGETHER], known.value):
                            if q != recs[at + i]:
                                links[at + i].append({"query": q, "offset": o, "errors": e})
                yield pa.RecordBatch.from_arrays([batch.column("rec_id"), batch.column("fingerprint"), pa.array(links, kind)], names=["rec_id", "fingerprint", "links"])

        if done:
            out, before = stash(out, "media-links"), written
            if before is not None:
                drop_stash(before)
            written = out
        out = out.select("rec_id", "fingerprint", "links").mapInArrow(run, out.schema)
    order = F.transform("links", lambda x: F.struct(x["errors"].alias("errors"), x["query"].alias("query"), x["offset"].alias("offset")))
    return out.withColumn("links", F.array_sort(order))


NOTE = 512


def render(vector: list[float] | None) -> bytes:
    """A tune of one note a value, as 16-bit samples: the test signal that stands for a recording."""
    pitch = 440.0 * 2.0 ** (24.0 * np.clip(np.nan_to_num(np.array([0.0 if v is None else v for v in vector or ()], np.float64)), -1, 1) / 12)
    phase = np.cumsum(np.repeat(2 * np.pi * pitch / RATE, NOTE))
    return (np.sin(phase) * 12000).astype("<i2").tobytes()


def op9_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All vectors as recordings; those whose vec_id is divisible by 50 are the queries."""
    vectors = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("rec_id"), "embedding")
    dealt = vectors.repartition(min(TASKS, -(-vectors.count() // TASK_RECORDINGS)) or 1)
    marked = stash(fingerprints(dealt, ["rec_id"], "embedding", render), "media-fingerprints")
    found = search(marked, marked.where(F.col("rec_id") % QUERY_EVERY == 0))
    best = F.get("links", 0)
    return found.select(
        F.col("rec_id").alias("vec_id"),
        F.size("fingerprint").cast("long").alias("n_frames"),
        F.md5(F.array_join("fingerprint", ",").cast("binary")).alias("fingerprint_md5"),
        F.size("links").cast("long").alias("n_links"),
        best["query"].alias("best_query"),
        best["offset"].cast("long").alias("best_offset"),
        F.round(best["errors"], 9).alias("best_errors"),
        F.array_sort(F.transform("links", lambda x: x["query"])).alias("links"),
    )
