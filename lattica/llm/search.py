r"""Ranked lexical search of many queries over all documents: windowed bucket scoring.

Terms are runs of ASCII letters and digits and of all other characters beyond ASCII, A-Z lower-cased. A term's weight is
floor(1000 ln((2 N + 2) / (2 df + 1))), a document's share of it (10**9 tf) div (1000 tf + 8 m) with m = 25 + (75 n N) div L, all
in 64-bit integers; a score sums weight times share over a query's terms, repeats included.

1. One pass over whole texts writes postings, of the queries' terms alone: a bitmap of ``FILTER_BITS`` bits lets
   these through and few others, whatever the number of queries. Counts of documents, words and each term follow.
2. Postings are range-partitioned and sorted by doc_id, and written: that is the index that is searched.
3. A task goes through its postings in windows of ``WINDOW`` doc_ids. In a window each query's postings are
   traversed term by term and their shares added into an array of the window's size, which a core's cache holds, with a
   bitset of the places that are occupied; these are harvested into the query's heap of the ``k`` best.
4. The heaps of all tasks meet by query: ``k`` rows a task at most.

Queries come in blocks of ``BLOCK_PAIRS`` pairs of query and term, each one broadcast and one narrow step over the index, so
neither queries nor documents are limited; no document meets another, and no pair of query and document is a row
unless it is in a heap. A window is a range of doc_ids, and ends at ``WINDOW`` documents where ids repeat.

Cases: null and empty texts, and those without terms, are in no count and found by nothing; queries without terms, or
without a document that has one, give no rows; repeated queries are queries of their own, and repeated documents have ranks of
their own; null doc_id is found like any other and comes last among equal scores; an empty table gives no rows; columns
besides doc_id and text are ignored; a query of more terms than a block has is a block.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import _kernels as K
from ._common import drop_stash, small_batches, stash, table

TOP = 10
#: Documents of a window: 128 KB of scores.
WINDOW = 1 << 14
#: Pairs of query and term of one block, which is broadcast: about 100 bytes each.
BLOCK_PAIRS = 200_000
#: Bits of the filter of terms: 1 MB.
FILTER_BITS = 1 << 23
_TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def terms_of(text: Column) -> Column:
    return F.regexp_extract_all(F.translate(text, _UPPER, _LOWER), F.lit(_TERM), F.lit(0))


def _slots(strings: pa.BinaryArray, bits: int) -> np.ndarray:
    data, offsets = K.span_bytes(strings)
    return (K.byte_hashes(data, offsets[:-1], offsets[1:]) % np.uint64(bits)).astype(np.int64)


def term_filter(terms: DataFrame, bits: int = FILTER_BITS) -> np.ndarray:
    """Whether a term may be one of ``terms`` (term), by slot: ``bits`` booleans, built by the tasks and joined in Spark."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            slot = _slots(batch.column("term").cast(pa.binary()), bits)
            yield pa.RecordBatch.from_arrays([pa.array(slot >> 5), pa.array(np.int64(1) << (slot & 31))], names=["word", "mask"])

    out = np.zeros(bits, bool)
    for word, mask in terms.mapInArrow(run, "word long, mask long").groupBy("word").agg(F.bit_or("mask").alias("mask")).collect():
        out[word * 32 : word * 32 + 32] = np.unpackbits(np.array([mask], "<u4").view(np.uint8), bitorder="little")
    return out


def postings(docs: DataFrame, allowed: np.ndarray) -> DataFrame:
    """doc_id, n (terms of the document), terms (distinct ones that the filter lets through, by lines) and tf."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    passes = docs.sparkSession.sparkContext.broadcast(np.packbits(allowed))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        may = np.unpackbits(passes.value).view(bool)
        for batch in batches:
            texts = K.as_bytes(batch.column("text"))
            for a, b in K.blocks(texts):
                words, first = K.word_array(texts[a:b], K.ALNUM, lower=True)
                encoded = words.dictionary_encode()
                strings, word = encoded.dictionary, encoded.indices.to_numpy()
                kept = np.flatnonzero(may[_slots(strings, len(may))][word])
                n = np.diff(first)
                doc = np.repeat(np.arange(b - a), n)[kept]
                key = np.sort(doc * np.int64(max(len(strings), 1)) + word[kept])
                runs = K.distinct_runs(key)
                doc, term = np.divmod(key[runs], max(len(strings), 1))
                tf = np.diff(runs, append=len(key))
                held = strings.take(pa.array(term))
                cut = np.searchsorted(doc, np.arange(b - a + 1))
                size = np.concatenate([[0], np.cumsum(np.diff(K.span_bytes(held)[1]) + 1)]) if len(held) else np.zeros(1, np.int64)
                lines = pa.Array.from_buffers(pa.binary(), b - a, [None, pa.py_buffer(size[cut].astype(np.int32)), pa.py_buffer(K.joined_lines(held))])
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(a, b - a), pa.array(n), lines, pa.ListArray.from_arrays(pa.array(cut.astype(np.int32)), pa.array(tf.astype(np.int32)))], names=["doc_id", "n", "terms", "tf"])

    small_batches(docs.sparkSession)
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n long, terms binary, tf array<int>")


def document_counts(held: DataFrame) -> DataFrame:
    """term, df of ``postings``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = K.split_lines(batch.column("terms").to_pylist())[0].value_counts()
            yield pa.RecordBatch.from_arrays([found.field("values").cast(pa.string()), found.field("counts")], names=["term", "df"])

    return held.select("terms").mapInArrow(run, "term string, df long").groupBy("term").agg(F.sum("df").alias("df"))


@dataclass
class Block:
    """Queries with their terms, as numbers into ``terms``, and what each adds: weight times repeats."""

    number: list[int]
    terms: pa.Array
    of: list[np.ndarray]
    weight: list[np.ndarray]


def blocks_of(queries: DataFrame, most: int) -> Iterator[Block]:
    """Blocks of ``queries`` (number, t: array of term and weight), which stream through the driver."""
    known: dict[str, int] = {}
    number, of, weight, size = [], [], [], 0
    for row in queries.toLocalIterator(prefetchPartitions=False):
        if number and size + len(row["t"]) > most:
            yield Block(number, pa.array(known, pa.string()).cast(pa.binary()), of, weight)
            known, number, of, weight, size = {}, [], [], [], 0
        number.append(row["number"])
        of.append(np.array([known.setdefault(x["term"], len(known)) for x in row["t"]], np.int64))
        weight.append(np.array([x["weight"] for x in row["t"]], np.int64))
        size += len(row["t"])
    if number:
        yield Block(number, pa.array(known, pa.string()).cast(pa.binary()), of, weight)


class Scorer:
    """The heaps of a block's queries while windows of postings, in any order, go by; place is the order of doc_id."""

    def __init__(self, block: Block, all_docs: int, all_words: int, top: int, window: int) -> None:
        self.block, self.all_docs, self.all_words, self.top = block, all_docs, all_words, top
        self.scores = np.zeros(window, np.int64)
        self.occupied = np.zeros(-(-window // 8), np.uint8)
        self.heaps: list[list[tuple]] = [[] for _ in block.number]

    def window(self, rows: pa.Table) -> None:
        """Documents of one window (doc_id, n, terms, tf, place), as many as there are scores at most."""
        strings, many = K.split_lines(rows.column("terms").to_pylist())
        term = pc.index_in(strings, value_set=self.block.terms)
        hit = np.flatnonzero(term.is_valid().to_numpy(zero_copy_only=False))
        term = term.fill_null(0).to_numpy()[hit]
        doc = np.repeat(np.arange(rows.num_rows), many)[hit]
        tf = rows.column("tf").combine_chunks().flatten().to_numpy().astype(np.int64)[hit]
        n = rows.column("n").to_numpy()
        share = 1_000_000_000 * tf // (1000 * tf + 8 * (25 + 75 * n * self.all_docs // max(self.all_words, 1))[doc])
        by = np.argsort(term, kind="stable")
        doc, share = doc[by], share[by]
        begin = np.searchsorted(term[by], np.arange(len(self.block.terms) + 1))
        byte, bit = doc >> 3, (128 >> (doc & 7)).astype(np.uint8)
        ids, place = rows.column("doc_id"), rows.column("place").to_numpy()
        for query, (terms, weights) in enumerate(zip(self.block.of, self.block.weight, strict=True)):
            some = begin[terms] < begin[terms + 1]
            for t, w in zip(terms[some].tolist(), weights[some].tolist(), strict=True):
                a, b = begin[t], begin[t + 1]
                self.scores[doc[a:b]] += w * share[a:b]
                np.bitwise_or.at(self.occupied, byte[a:b], bit[a:b])
            if some.any():
                self._harvest(self.heaps[query], ids, place)

    def _harvest(self, heap: list[tuple], ids: pa.ChunkedArray, place: np.ndarray) -> None:
        at = np.flatnonzero(np.unpackbits(self.occupied))
        score = self.scores[at]
        self.scores[at] = 0
        self.occupied[:] = 0
        better = np.flatnonzero(score >= (heap[0][0] if len(heap) == self.top else 1))
        if len(better) > self.top:
            least = np.partition(score[better], len(better) - self.top)[len(better) - self.top]
            better = better[score[better] >= least]
        for i in better[np.lexsort((place[at[better]], -score[better]))][: self.top].tolist():
            entry = (int(score[i]), -int(place[at[i]]), ids[int(at[i])].as_py())
            if len(heap) < self.top:
                heapq.heappush(heap, entry)
            elif entry[:2] > heap[0][:2]:
                heapq.heapreplace(heap, entry)


def _windows(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.Table]:
    """Rows in ranges of ``width`` doc_ids and of as many rows at most; sorted rows make the fewest."""
    held: list[pa.RecordBatch] = []
    size, now = 0, None
    for batch in batches:
        ids = batch.column("doc_id")
        of = [None if i is None else i // width for i in ids.to_pylist()] if pa.types.is_integer(ids.type) else [None] * len(ids)
        start = 0
        for i in range(len(ids) + 1):
            if i == len(ids):
                held.append(batch.slice(start))
                break
            if size and (of[i] != now or size == width):
                held.append(batch.slice(start, i - start))
                yield pa.Table.from_batches(held)
                held, size, start = [], 0, i
            now = of[i]
            size += 1
    if size:
        yield pa.Table.from_batches(held)


def search(docs: DataFrame, queries: DataFrame, top: int = TOP, window: int = WINDOW, block_pairs: int = BLOCK_PAIRS, filter_bits: int = FILTER_BITS) -> DataFrame:
    """item_id, rank (from 1), doc_id, score: the ``top`` documents (doc_id, text) with a score above 0 of each row of ``queries`` (item_id, text)."""
    if min(top, window, block_pairs, filter_bits // 32) < 1 or filter_bits % 32:
        raise ValueError("top, window, block_pairs and filter_bits are positive, the last a multiple of 32")
    spark = docs.sparkSession
    context = spark.sparkContext
    items = stash(queries.select("item_id", terms_of(F.col("text")).alias("terms")).withColumn("number", F.monotonically_increasing_id()), "search-items", free=False)
    wanted = items.select("number", F.explode("terms").alias("term")).groupBy("number", "term").agg(F.count("*").alias("times"))
    held = stash(postings(docs, term_filter(wanted.select("term").distinct(), filter_bits)), "search-postings")
    all_docs, all_words = held.agg(F.count_if(F.col("n") > 0), F.coalesce(F.sum("n"), F.lit(0))).first()
    weight = F.floor(1000 * F.log(F.lit(2.0 * all_docs + 2) / (2 * F.col("df") + 1))).cast("long")
    weighed = wanted.join(document_counts(held), "term").withColumn("weight", weight).where("weight > 0")
    asked = stash(weighed.groupBy("number").agg(F.collect_list(F.struct("term", (F.col("weight") * F.col("times")).alias("weight"))).alias("t")), "search-queries", free=False)

    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    order = [F.col("doc_id").asc_nulls_last(), F.col("tie")]
    tied = held.withColumn("tie", F.monotonically_increasing_id())
    index = stash(tied.repartitionByRange(tasks, *order).sortWithinPartitions(*order).withColumn("place", F.monotonically_increasing_id()).drop("tie"), "search-index")
    drop_stash(held)
    kind = index.schema["doc_id"].dataType.simpleString()
    found = spark.createDataFrame([], f"number long, doc_id {kind}, score long")
    for block in blocks_of(asked, block_pairs):
        found = found.unionByName(index.mapInArrow(_step(context.broadcast(block), all_docs, all_words, top, window), found.schema))
    best = Window.partitionBy("number").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last())
    ranked = found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= top)
    return ranked.join(items.select("number", "item_id"), "number").select("item_id", "rank", "doc_id", "score")


def _step(block, all_docs: int, all_words: int, top: int, window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer, kind = Scorer(block.value, all_docs, all_words, top, window), None
        for rows in _windows(batches, window):
            kind = rows.schema.field("doc_id").type
            scorer.window(rows)
        if kind is not None:
            rows = [(n, doc, score) for n, heap in zip(block.value.number, scorer.heaps, strict=True) for score, _, doc in heap]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], kind), pa.array([r[2] for r in rows], pa.int64())], names=["number", "doc_id", "score"])

    return run


def op12_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


SQL = r"""
with d as (
  select row_number() over () as r, doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') as w from documents where text is not null
), b as (
  select row_number() over () as q, item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') as w from benchmark where text is not null
), total as (
  select count(*)::bigint as n, sum(len(w))::bigint as l from d where len(w) > 0
), asked as (
  select q, item_id, t, count(*)::bigint as times from (select q, item_id, unnest(w) as t from b) group by all
), post as (
  select r, doc_id, len(w)::bigint as n, t, count(*)::bigint as tf from (select r, doc_id, w, unnest(w) as t from d) where t in (select t from asked) group by all
), weight as (
  select t, floor(1000 * ln((2 * (select n from total) + 2)::double / (2 * count(*) + 1)::double))::bigint as w from post group by t
), scored as (
  select q, item_id, r, doc_id, sum(times * w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 75 + ((75 * p.n * total.n) // total.l)))))::bigint as score
  from asked join weight using (t) join post p using (t), total group by q, item_id, r, doc_id
)
select item_id, (row_number() over (partition by q order by score desc, doc_id nulls last, r))::int as rank, doc_id, score from scored where score > 0
qualify rank <= 10
"""
