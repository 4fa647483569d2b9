"""Benchmark decontamination: a prefix-filtered set join of word windows.

A window is ``width`` consecutive words of a benchmark item, or the whole item if it has fewer. Words
are ordered by their counts in all documents. A document that holds a window holds its rarest word, so
that one word is the window's prefix: only document words that are some window's prefix make
candidates. The place of the prefix in the window fixes where an occurrence would start; starts before
the text's first word or ends after its last are dropped, then a hash of the word sequence, and last
the words themselves are compared.

The windows are taken in blocks of bounded size; each block is one narrow step over the documents, so
neither the number of items nor that of documents is limited, and no document is shuffled.

Cases: null and empty texts have no words and are clean; items without words have no windows;
null item ids read 'null'; rows with the same doc_id are judged each for itself; with an empty
benchmark all documents are clean; further columns are passed on, and the added columns get underscores
where one has its name.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import _kernels as K
from ._common import free_names, named, small_batches, table

WIDTH = 10
#: Windows, each with an item, of one block, which is broadcast: about 150 bytes each.
BLOCK_WINDOWS = 200_000
_WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


@dataclass
class Block:
    """Windows by prefix word: CSR lists from sorted word hashes."""

    prefix: np.ndarray
    first: np.ndarray
    offset: np.ndarray
    length: np.ndarray
    hashes: np.ndarray
    words: list[bytes]
    items: list[list[str]]


def item_words(text: str | None) -> list[bytes]:
    return _WORD.findall((text or "").encode().lower())


def windows_of(words: list[bytes], width: int = WIDTH) -> set[bytes]:
    n = min(width, len(words))
    return {b" ".join(words[i : i + n]) for i in range(len(words) - n + 1)} if n else set()


def _hash_all(words: list[bytes]) -> np.ndarray:
    data, starts, ends, _ = K.words(words, K.ALNUM)
    return K.byte_hashes(data, starts, ends)


def count_words(docs: DataFrame, vocabulary: np.ndarray) -> np.ndarray:
    """How often each word hash of ``vocabulary`` (sorted) stands in all documents."""
    known = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(len(known.value), np.int64)
        for batch in batches:
            texts = K.as_bytes(batch.column("text"))
            for a, b in K.blocks(texts):
                data, starts, ends, _ = K.words(texts[a:b], K.ALNUM, lower=True)
                h = K.byte_hashes(data, starts, ends)
                at = np.minimum(np.searchsorted(known.value, h), len(seen) - 1)
                seen += np.bincount(at[known.value[at] == h], minlength=len(seen))
        some = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(seen[some])], names=["word", "n"])

    counts = np.zeros(len(vocabulary), np.int64)
    if len(vocabulary):
        for r in docs.select("text").mapInArrow(run, "word long, n long").groupBy("word").agg(F.sum("n").alias("n")).collect():
            counts[r["word"]] = r["n"]
    known.destroy()
    return counts


def make_block(windows: dict[bytes, list[str]], rarity) -> Block:
    texts = list(windows)
    split = [w.split(b" ") for w in texts]
    length = np.array([len(s) for s in split], np.int64)
    flat = _hash_all([w for s in split for w in s])
    vocabulary = np.unique(flat)
    order = rarity(vocabulary)[np.searchsorted(vocabulary, flat)]
    begin = np.cumsum(length) - length
    offset = np.array([int(np.lexsort((flat[b : b + n], order[b : b + n]))[0]) for b, n in zip(begin, length, strict=True)], np.int64)
    token = flat[begin + offset]
    hashes = K.Levels(flat).span(begin, begin + length)
    by = np.argsort(token, kind="stable")
    prefix, first = np.unique(token[by], return_index=True)
    return Block(prefix, np.append(first, len(by)), offset[by], length[by], hashes[by], [texts[i] for i in by], [windows[texts[i]] for i in by])


def window_blocks(benchmark: DataFrame, width: int, most: int) -> Iterator[dict[bytes, list[str]]]:
    """Windows with the items that have them, in blocks of ``most`` pairs of both; items stream through the driver.

    A long item, and a window that very many items have, go on in the next block.
    """
    held: dict[bytes, list[str]] = {}
    size = 0
    for row in benchmark.select("item_id", "text").toLocalIterator():
        for w in windows_of(item_words(row["text"]), width):
            held.setdefault(w, []).append("null" if row["item_id"] is None else str(row["item_id"]))
            size += 1
            if size >= most:
                yield held
                held, size = {}, 0
    if held:
        yield held


def occurrences(texts: list[bytes], block: Block) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """First words of the texts, and document, start (of all words) and window of each occurrence."""
    data, starts, ends, first = K.words(texts, K.ALNUM, lower=True)
    h = K.byte_hashes(data, starts, ends)
    at = np.minimum(np.searchsorted(block.prefix, h), len(block.prefix) - 1)
    here = np.flatnonzero(block.prefix[at] == h)
    lists = block.first[at[here] + 1] - block.first[at[here]]
    window = K.ranges(block.first[at[here]], lists)
    place = np.repeat(here, lists)
    doc = np.searchsorted(first, place, side="right") - 1
    start = place - block.offset[window]
    end = start + block.length[window]
    ok = (start >= first[doc]) & (end <= first[doc + 1])
    start, end, window, doc = start[ok], end[ok], window[ok], doc[ok]
    ok = K.Levels(h).span(start, end) == block.hashes[window]
    start, end, window, doc = start[ok], end[ok], window[ok], doc[ok]
    raw = data.tobytes()
    same = np.array([b" ".join(raw[a:b] for a, b in zip(starts[s:e], ends[s:e], strict=True)) == block.words[w] for s, e, w in zip(start, end, window, strict=True)], bool)
    return first, doc[same], start[same], window[same]


@named("n_words", "hit", "items")
def mark(docs: DataFrame, benchmark: DataFrame, width: int = WIDTH, most: int = BLOCK_WINDOWS) -> DataFrame:
    """``docs`` (all columns) with n_words, hit (runs of hit words: start, end, start, ...) and items (sorted ids)."""
    small_batches(docs.sparkSession)
    own = docs.columns
    out = docs.withColumns({"n_words": F.lit(None).cast("long"), "hit": F.array().cast("array<long>"), "items": F.array().cast("array<string>")})
    context = docs.sparkSession.sparkContext
    none = True
    for windows in window_blocks(benchmark, width, most):
        none = False
        block = context.broadcast(make_block(windows, lambda v: count_words(docs, v)))
        out = out.mapInArrow(_step(block, own), out.schema)
    return out.mapInArrow(_step(None, own), out.schema) if none else out


def _step(block, own: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = K.as_bytes(batch.column("text"))
            hits, items = batch.column("hit").to_pylist(), batch.column("items").to_pylist()
            count = np.zeros(len(texts), np.int64)
            for a, b in K.blocks(texts):
                if block is None:
                    count[a:b] = np.diff(K.words(texts[a:b], K.ALNUM, lower=True)[3])
                    continue
                first, doc, start, window = occurrences(texts[a:b], block.value)
                count[a:b] = np.diff(first)
                for d in np.unique(doc):
                    of = doc == d if len(doc) < 64 else slice(*np.searchsorted(doc, [d, d + 1]))
                    spans = [(int(s - first[d]), int(s - first[d] + block.value.length[w])) for s, w in zip(start[of], window[of], strict=True)]
                    old = hits[a + d]
                    hits[a + d] = merge(spans + list(zip(old[::2], old[1::2], strict=True)))
                    items[a + d] = sorted({*items[a + d], *(i for w in window[of] for i in block.value.items[w])})
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in own), pa.array(count), pa.array(hits, pa.list_(pa.int64())), pa.array(items, pa.list_(pa.string()))], names=[*own, "n_words", "hit", "items"])

    return run


def merge(spans: list[tuple[int, int]]) -> list[int]:
    """Union of half-open spans, as start, end, start, end, ..."""
    out: list[int] = []
    for s, e in sorted(spans):
        if out and s <= out[-1]:
            out[-1] = max(out[-1], e)
        else:
            out += [s, e]
    return out


def drop_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` without a hit word, all their columns."""
    names = free_names(docs, "n_words", "hit", "items")
    return mark(docs, benchmark, names=names).where(F.size(names["hit"]) == 0).select(*[F.col(f"`{c}`") for c in docs.columns])


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    marked = mark(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    n_hit = F.aggregate(F.transform("hit", lambda x, i: F.when(i % 2 == 0, -x).otherwise(x)), F.lit(0).cast("long"), lambda a, x: a + x)
    return marked.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"))


SQL = r"""
with d as (
  select row_number() over () as r, doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) as w from documents
), b as (
  select coalesce(item_id::varchar, 'null') as item, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from benchmark where text is not null
), bw as (
  select distinct item, least(10, len(w)) as n, array_to_string(w[i:i + least(10, len(w)) - 1], ' ') as win
  from b, lateral (select unnest(range(1, len(w) - least(10, len(w)) + 2)) as i) where len(w) > 0
), dw as (
  select r, i, n, array_to_string(w[i:i + n - 1], ' ') as win from d, (select distinct n from bw), lateral (select unnest(range(1, len(w) - n + 2)) as i)
), hit as (
  select r, i, n, item from dw join bw using (n, win)
), covered as (
  select r, count(distinct p) as n_hit from (select distinct r, i, n from hit), lateral (select unnest(range(i, i + n)) as p) group by r
), its as (
  select r, count(*) as n_items, string_agg(item, ',' order by item) as s from (select distinct r, item from hit) group by r
)
select doc_id, len(w)::bigint as n_words, coalesce(n_hit, 0)::bigint as n_hit, coalesce(n_items, 0)::bigint as n_items, sha256(coalesce(s, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from d left join covered using (r) left join its using (r)
"""
