"""Importance resampling towards a target distribution, by a dictionary of distinct n-gram strings.

Features are all runs of 1 to ``grams`` (1 or 2) consecutive words, joined by one space, repeats counted. A
feature's bucket is the crc32 of its bytes modulo ``buckets``. A bucket's gain is
floor(1000 ln((t + 1)(S + buckets) / ((s + 1)(T + buckets)))), from the features s of all S of the documents and t of all
T of the target that it holds. A document's weight is the floored mean gain of its features, its score the
weight plus Gumbel noise from a hash of its doc_id, so that the highest scores are a draw without replacement.

1. Chunks of documents are dictionary-encoded (exactly, by Arrow): each chunk's distinct strings with their
   counts, in messages by hash shard, and the documents as (string number, count) lists.
2. A shard gathers the strings of all chunks, counts each distinct one over all documents, hashes it once, and
   answers each message by its strings' buckets. Spark sums the counts of buckets over the shards.
3. Chunks meet their answers: gains, one number a bucket and so of a size that a parameter bounds, are
   looked up by string number and summed over each document's counts.
4. Ranks come from range partitions and their counts.

A message stands for at least one distinct string of its chunk, so there are never more messages than a
count by rows would shuffle. A string that every document holds is one entry for each chunk. Chunks are of
bounded bytes, but a longer text is a chunk of its own; nothing is cut.

Cases: null and empty texts, and those without words, have no features and weight 0; null doc_id reads 'null' in the
hash and comes last among ties; repeated rows are documents of their own, with the same score, one drawn before the other;
an empty target has t = T = 0; an empty table gives no rows; all columns but text are passed on, and the added
columns get underscores where one has its name.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.ranking import with_rank
from . import _kernels as K
from ._common import drop_stash, free_name, free_names, small_batches, stash, table

GRAMS, BUCKETS = 2, 10_000
LEAST_WORDS, PERCENT, SEED = 20, 25, 7
#: Bytes of text of one chunk, and of text for each shard of strings.
CHUNK_BYTES, SHARD_BYTES = 6 << 20, 12 << 20
#: Rows of an Arrow batch: enough short texts for a chunk.
BATCH_ROWS = 4096
_CODEC = "zstd"
#: Level for strings, which are most of what is shuffled.
_LEVEL = 6


def _packed(numbers: np.ndarray) -> bytes:
    """Numbers below 2**32, byte plane by byte plane, compressed; ``_unpacked`` undoes it."""
    planes = np.ascontiguousarray(numbers.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes()
    return len(numbers).to_bytes(8, "little") + pa.compress(planes, _CODEC, asbytes=True)


def _unpacked(data: bytes) -> np.ndarray:
    n = int.from_bytes(data[:8], "little")
    planes = np.frombuffer(pa.decompress(data[8:], 4 * n, _CODEC, asbytes=True), np.uint8).reshape(4, n)
    return np.ascontiguousarray(planes.T).view("<u4").ravel().astype(np.int64)


def _squeezed(data: bytes) -> bytes:
    return len(data).to_bytes(8, "little") + pa.Codec(_CODEC, compression_level=_LEVEL).compress(data, asbytes=True)


def _expanded(data: bytes) -> bytes:
    return pa.decompress(data[8:], int.from_bytes(data[:8], "little"), _CODEC, asbytes=True)


def _renumbered(by: np.ndarray, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An order of some values, and references to the values as places in that order."""
    place = np.empty(len(by), np.int64)
    place[by] = np.arange(len(by))
    return by, place[numbers]


class Chunk:
    """Documents as counts of the distinct features of all of them, which are ordered by shard."""

    def __init__(self, texts: list[bytes], grams: int, shards: int) -> None:
        words, first = K.word_array(texts, K.ALNUM, lower=True)
        self.n_words = np.diff(first)
        encoded = words.dictionary_encode()
        # in the order of the strings, of which neighbours then share bytes
        by, word = _renumbered(pc.sort_indices(encoded.dictionary).to_numpy(), encoded.indices.to_numpy())
        strings = encoded.dictionary.take(pa.array(by))
        doc = np.repeat(np.arange(len(texts)), self.n_words)
        feature = word
        if grams == 2 and len(word) > 1:
            at = np.flatnonzero(doc[1:] == doc[:-1])
            encoded = pa.array(word[at] * len(strings) + word[at + 1]).dictionary_encode()
            by, pair = _renumbered(np.argsort(encoded.dictionary.to_numpy()), encoded.indices.to_numpy())
            of = encoded.dictionary.to_numpy()[by]
            joined = pc.binary_join_element_wise(strings.take(pa.array(of // len(strings))), strings.take(pa.array(of % len(strings))), pa.scalar(b" ", pa.binary()))
            feature = np.concatenate([word, pair + len(strings)])
            doc = np.concatenate([doc, doc[at]])
            strings = pa.concat_arrays([strings, joined])
        data, offsets = K.span_bytes(strings)
        shard = (K.byte_hashes(data, offsets[:-1], offsets[1:]) % np.uint64(shards)).astype(np.int32)
        order, number = _renumbered(np.argsort(shard, kind="stable"), feature)
        self.strings, self.shard = strings.take(pa.array(order)), shard[order]
        self.total = np.bincount(number, minlength=len(order))
        key = np.sort(doc * np.int64(max(len(order), 1)) + number)
        runs = K.distinct_runs(key)
        self.count = np.diff(runs, append=len(key))
        self.doc, self.number = np.divmod(key[runs], max(len(order), 1))
        self.n_features = np.bincount(doc, minlength=len(texts))

    def messages(self) -> Iterator[tuple[int, bytes, bytes]]:
        """shard, strings and counts."""
        begin = K.distinct_runs(self.shard)
        for a, b in zip(begin, [*begin[1:], len(self.shard)], strict=True):
            yield int(self.shard[a]), _squeezed(K.joined_lines(self.strings.slice(a, b - a))), _packed(self.total[a:b])

    def numbers(self) -> bytes:
        """Each document's string numbers, as steps from the one before."""
        first = np.diff(self.doc, prepend=-1) != 0
        return _packed(np.where(first, self.number, np.diff(self.number, prepend=0)))


def _steps_undone(steps: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    total = np.cumsum(steps)
    begin = (np.cumsum(sizes) - sizes)[sizes > 0]
    return total - np.repeat(total[begin] - steps[begin], sizes[sizes > 0])


def _listed(values: pa.Array, n: int) -> pa.ListArray:
    """``values`` as the last of ``n`` lists, the others empty."""
    return pa.ListArray.from_arrays(pa.array([0] * n + [len(values)], pa.int32()), values)


def _read(docs: DataFrame, grams: int, shards: int, chunk_bytes: int) -> DataFrame:
    """Messages (chunk, key: shard, strings, counts) and the chunks themselves (key: below 0, counts, rows, n_words, n_features, sizes, numbers)."""
    own = [c for c in docs.columns if c != "text"]
    fields = ", ".join(f"`{c}`: {docs.schema[c].dataType.simpleString()}" for c in own)
    schema = f"chunk long, key long, strings binary, counts binary, rows array<struct<{fields}>>, n_words array<long>, n_features array<long>, sizes binary, numbers binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk = TaskContext.get().partitionId() << 33
        for batch in batches:
            texts = K.as_bytes(batch.column("text"))
            rows = pa.StructArray.from_arrays([batch.column(c) for c in own], names=own)
            for a, b in K.blocks(texts, chunk_bytes):
                c = Chunk(texts[a:b], grams, shards)
                shard, strings, counts = (list(x) for x in zip(*c.messages(), strict=True)) if len(c.strings) else ([], [], [])
                n = len(shard) + 1
                last = lambda value: pa.array([None] * (n - 1) + [value], pa.binary())  # noqa: E731, B023
                yield pa.RecordBatch.from_arrays(
                    [pa.array([chunk] * n), pa.array([*shard, -1 - chunk], pa.int64()), pa.array([*strings, None], pa.binary()), pa.array([*counts, _packed(c.count)], pa.binary()), _listed(rows.slice(a, b - a), n), _listed(pa.array(c.n_words), n), _listed(pa.array(c.n_features), n), last(_packed(np.bincount(c.doc, minlength=b - a))), last(c.numbers())],
                    names=["chunk", "key", "strings", "counts", "rows", "n_words", "n_features", "sizes", "numbers"],
                )
                chunk += 1

    small_batches(docs.sparkSession, BATCH_ROWS)
    return docs.mapInArrow(run, schema)


def _merge(buckets: int):
    """Of the messages of one shard: the answer to each (chunk, key, answer), and what buckets hold (bucket, n). Chunks go on as they are."""

    def run(group: pa.Table) -> pa.Table:
        nothing = pa.nulls(group.num_rows, pa.binary())
        empty = pa.array([[]] * group.num_rows, pa.list_(pa.int64()))
        if group.column("key")[0].as_py() < 0:
            return group.drop_columns("strings").append_column("answer", nothing).append_column("bucket", empty).append_column("n", empty)
        strings, many = K.split_lines([_expanded(x) for x in group.column("strings").to_pylist()])
        counts = np.concatenate([_unpacked(x) for x in group.column("counts").to_pylist()])
        encoded = strings.dictionary_encode()
        at = encoded.indices.to_numpy()
        times = np.zeros(len(encoded.dictionary), np.int64)
        np.add.at(times, at, counts)
        bucket = np.fromiter((zlib.crc32(s) % buckets for s in encoded.dictionary.to_pylist()), np.int64, len(times))
        held = np.zeros(buckets, np.int64)
        np.add.at(held, bucket, times)
        some = np.flatnonzero(held)
        answers = pa.array([_packed(x) for x in np.split(bucket[at], np.cumsum(many)[:-1])], pa.binary())
        out = group.drop_columns("strings").set_column(2, "counts", nothing).append_column("answer", answers)
        return out.append_column("bucket", _listed(pa.array(some), group.num_rows)).append_column("n", _listed(pa.array(held[some]), group.num_rows))

    return run


def dictionary(docs: DataFrame, grams: int = GRAMS, buckets: int = BUCKETS, chunk_bytes: int = CHUNK_BYTES, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """The chunks of ``docs`` (key below 0) and the answers to them (key, answer: the buckets of its strings in a shard; bucket, n: what the shard holds); written."""
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    read = _read(docs, grams, -(-size // shard_bytes) or 1, chunk_bytes)
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in read.schema if f.name != "strings")
    return stash(read.groupBy("key").applyInArrow(_merge(buckets), f"{schema}, answer binary, bucket array<long>, n array<long>"), "feature-answers")


def held(merged: DataFrame) -> DataFrame:
    """bucket, n: the features of all documents by bucket."""
    return merged.where("key >= 0").select(F.explode(F.arrays_zip("bucket", "n")).alias("b")).groupBy("b.bucket").agg(F.sum("b.n").alias("n"))


def gains(documents: DataFrame, target: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """The gain of each bucket, from (bucket, n) of the documents and of the target: ``buckets`` numbers."""
    of = np.zeros((2, buckets), np.int64)
    for side, counts in enumerate((documents, target)):
        for bucket, n in counts.collect():
            of[side, bucket] = n
    (s, t), (all_s, all_t) = of + 1.0, of.sum(1) + float(buckets)
    return np.floor(1000 * np.log(t * all_s / (s * all_t))).astype(np.int64)


def _weigh(gain):
    def run(chunk: pa.Table, answers: pa.Table) -> pa.Table:
        by = np.argsort(answers.column("key").to_numpy(), kind="stable")
        parts = answers.column("answer").to_pylist()
        bucket = np.concatenate([np.zeros(0, np.int64), *(_unpacked(parts[i]) for i in by)])
        column = lambda name: chunk.column(name)[0].as_py()
        sizes, counts = _unpacked(column("sizes")), _unpacked(column("counts"))
        number = _steps_undone(_unpacked(column("numbers")), sizes)
        total = np.zeros(len(sizes), np.int64)
        np.add.at(total, np.repeat(np.arange(len(sizes)), sizes), gain.value[bucket[number]] * counts)
        rows, features = chunk.column("rows").chunk(0).flatten(), chunk.column("n_features").chunk(0).flatten()
        weight = np.floor_divide(total, np.maximum(features.to_numpy(), 1))
        return pa.table([rows, chunk.column("n_words").chunk(0).flatten(), features, pa.array(weight)], names=["row", "n_words", "n_features", "weight"])

    return run


def weighed(docs: DataFrame, target: DataFrame, grams: int = GRAMS, buckets: int = BUCKETS, chunk_bytes: int = CHUNK_BYTES, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """row (a struct of all columns of ``docs`` but text), n_words, n_features and weight of every row of ``docs``; written."""
    if grams not in (1, 2):
        raise ValueError("grams is 1 or 2")
    spark = docs.sparkSession
    options = (grams, buckets, chunk_bytes, shard_bytes)
    wanted, merged = dictionary(target.select(F.lit(0).alias("doc_id"), "text"), *options), dictionary(docs, *options)
    gain = spark.sparkContext.broadcast(gains(held(merged), held(wanted), buckets))
    chunks = merged.where("key < 0").select("chunk", "rows", "n_words", "n_features", "sizes", "numbers", "counts")
    met = chunks.groupBy("chunk").cogroup(merged.where("key >= 0").select("chunk", "key", "answer").groupBy("chunk"))
    kind = merged.schema["rows"].dataType.elementType.simpleString()
    out = stash(met.applyInArrow(_weigh(gain), f"row {kind}, n_words long, n_features long, weight long"), "feature-weights")
    gain.destroy()
    drop_stash(wanted)
    drop_stash(merged)
    return out


def resample(docs: DataFrame, target: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS, seed: int = SEED, names: dict[str, str] | None = None, **options) -> DataFrame:
    """All columns of ``docs`` (doc_id, text and more) but text, with n_words, n_features, weight, score and rank.

    Of the N documents with ``least_words`` words at least, floor(percent N / 100) with the highest scores are drawn and have ranks
    from 1, the others have none. ``options`` are those of ``weighed``.
    """
    own = [c for c in docs.columns if c != "text"]
    called = free_names(docs, "n_words", "n_features", "weight", "score", "rank") | (names or {})
    rows = weighed(docs, target, **options)
    hashed = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("row.doc_id").cast("string"), F.lit("null"))), 256)
    h = F.conv(F.substring(hashed, 1, 8), 16, 10).cast("double")
    rows = rows.withColumn("score", F.col("weight") + F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0))))
    able = rows.where(F.col("n_words") >= least_words)
    most = able.count() * percent // 100
    ranked = with_rank(able, "rank", [F.col("score").desc(), F.col("row.doc_id").asc_nulls_last()])
    ranked = ranked.withColumn("rank", F.when(F.col("rank") < most, F.col("rank") + 1)).unionByName(rows.where(F.col("n_words") < least_words).withColumn("rank", F.lit(None).cast("long")))
    return ranked.select(*[F.col("row").getField(c).alias(c) for c in own], *[F.col(c).alias(called[c]) for c in ("n_words", "n_features", "weight", "score", "rank")])


def draw(docs: DataFrame, target: DataFrame, **options) -> DataFrame:
    """The drawn rows of ``docs``, all columns with their texts."""
    row = free_name(docs, "row_")
    numbered = stash(docs.withColumn(row, F.monotonically_increasing_id()), "feature-rows")
    called = free_names(numbered, "rank")
    drawn = resample(numbered.select("doc_id", "text", row), target, names=called, **options).where(F.col(called["rank"]).isNotNull())
    return numbered.join(drawn.select(row), row, "left_semi").drop(row)


def op13_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = resample(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "n_features", "weight", "score", "rank")


SQL = r"""
with crc as (
  select list_transform(range(256), lambda n: list_reduce([n::bigint, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, z: case when c & 1 = 1 then xor(3988292384::bigint, c >> 1) else c >> 1 end)) as step
), words as (
  select 0 as side, row_number() over () as r, doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) as w from documents
  union all
  select 1, 0, null, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) from benchmark
), feature as (
  select side, r, unnest(w || list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) as f from words
), counted as (
  select side, r, f, count(*) as n from feature group by all
), hashed as (
  select f, hex(encode(f)) as x from (select distinct f from counted)
), bucketed as (
  select f, xor(list_reduce(list_prepend(4294967295::bigint, list_transform(range(len(x) // 2), lambda i: ('0x' || substr(x, 2 * i + 1, 2))::bigint)), lambda c, b: xor(step[(xor(c, b) & 255) + 1], c >> 8)), 4294967295::bigint) % 10000 as b from hashed, crc
), held as (
  select b, coalesce(sum(n) filter (side = 0), 0) as s, coalesce(sum(n) filter (side = 1), 0) as t from counted join bucketed using (f) group by b
), gain as (
  select b, floor(1000 * ln((t + 1)::double * ((select sum(s) from held) + 10000)::double / ((s + 1)::double * ((select sum(t) from held) + 10000)::double)))::bigint as g from held
), mean as (
  select r, floor(sum(n * g) / sum(n)::double)::bigint as weight from counted join bucketed using (f) join gain using (b) where side = 0 group by r
), scored as (
  select d.r, doc_id, len(w) as n_words, greatest(2 * len(w) - 1, 0)::bigint as n_features, coalesce(weight, 0) as weight,
    coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('7:' || coalesce(doc_id::varchar, 'null')), 1, 8))::bigint + 0.5::double) / 4294967296::double)))::bigint as score
  from words d left join mean m on d.r = m.r where d.side = 0
), ranked as (
  select r, row_number() over (order by score desc, doc_id nulls last, r) as k, count(*) over () as n from scored where n_words >= 20
)
select doc_id, n_features, weight, score, case when k <= 25 * n // 100 then k end as rank from scored left join ranked using (r)
"""
