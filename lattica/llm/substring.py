"""Byte-substring dedup by merging Burrows-Wheeler transforms of shards.

Every byte that a ``width``-byte string covers which also starts in a document with a smaller doc_id is
removed. Each string belongs to the least hash of its 16-byte grams; consecutive strings of a document with the
same one are a run, whose bytes are its segment. Equal strings have equal grams, so a segment need only
be compared with those of its gram.

1. Documents are dealt out to shards by hash, also copies of one text. A shard sends the distinct grams
   of its runs to buckets, which answer with a bit each: whether documents with different ids have it.
2. A shard sends its distinct segments of those grams with their least doc_id. A bucket merges equal segments, whose
   bytes are compared, here as in the shard; no hash decides what is removed. Where a gram has several, common prefixes of the contexts on either side bound the part that
   another segment can share; those parts, in up to ``PARTS`` collections, get a transform each, the
   transforms are merged by interleave refinement to ``width`` symbols, and the intervals of
   the merged suffixes are the repeated strings. The bucket answers with runs of least doc_ids.
3. A shard removes from each document what a smaller doc_id has.

Messages are packed per shard and bucket; a gram that very many documents share costs a row a shard and
distinct segment, never a row a document.

Cases: null and empty texts have no bytes; documents of fewer than ``width`` bytes lose nothing; null doc_id
is neither smaller nor greater than any, so such rows lose nothing and take nothing from others; rows
with the same doc_id are one document's parts and take nothing from each other; an empty table gives no
rows; columns besides doc_id and text are passed on, and the added columns get underscores where one has its name.
"""

from __future__ import annotations


import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from . import _kernels as K
from ._bwt import repeated_intervals
from ._common import free_name, named, small_batches, stash, table

WIDTH, GRAM = 50, 16
#: Text bytes and documents of a shard.
SHARD_BYTES, SHARD_DOCS = 8 << 20, 10_000
#: Text bytes that runs are computed for at once: the arrays stay in a core's cache.
RUN_BYTES = 1 << 17
#: Transforms that a bucket merges.
PARTS = 4
#: Strings of a bucket whose transforms are merged at once, by bytes; grams are never split.
MERGE_BYTES = 1 << 19


def _pack(*arrays: np.ndarray) -> bytes:
    head = np.array([len(arrays), *(a.nbytes for a in arrays)], np.int64)
    return zstandard.ZstdCompressor(level=1).compress(head.tobytes() + b"".join(a.tobytes() for a in arrays))


def _unpack(blob: bytes, *kinds) -> list[np.ndarray]:
    raw = zstandard.ZstdDecompressor().decompress(blob)
    n = int(np.frombuffer(raw, np.int64, 1)[0])
    sizes = np.frombuffer(raw, np.int64, n, 8)
    at = 8 * (n + 1) + np.append(0, np.cumsum(sizes))
    return [np.frombuffer(raw, kind, int(s) // np.dtype(kind).itemsize, int(a)) for kind, s, a in zip(kinds, sizes, at, strict=False)]


class Runs:
    """The runs of a shard's documents, the same whenever they are computed: row, start, n, gram."""

    def __init__(self, texts: list[bytes], use: np.ndarray, width: int) -> None:
        self.texts, self.width = texts, width
        parts = []
        for a, b in K.blocks(texts, RUN_BYTES):
            size = np.array([len(t) for t in texts[a:b]], np.int64)
            first = np.cumsum(size) - size
            number = np.where(use[a:b], np.maximum(size - width + 1, 0), 0)
            if not number.any():
                continue
            least = K.sliding_min(K.byte_grams(np.frombuffer(b"".join(texts[a:b]), np.uint8)), width - GRAM + 1)
            # a run ends where the least gram changes, and at both ends of a document's windows
            change = np.flatnonzero(least[1:] != least[:-1]) + 1
            edge = np.unique(np.concatenate([change, first, first + number]))
            edge = edge[edge <= len(least)]
            start, end = edge, np.append(edge[1:], len(least))
            row = np.searchsorted(first, start, side="right") - 1
            keep = (start < first[row] + number[row]) & (end > start)
            start, end, row = start[keep], end[keep], row[keep]
            parts.append((row + a, start - first[row], end - start, K.mix(least[start])))
        none = (np.int64, np.int64, np.int64, np.uint64)
        self.row, self.start, self.n, self.gram = (np.concatenate([p[i] for p in parts]) if parts else np.zeros(0, none[i]) for i in range(4))

    def take(self, index: np.ndarray) -> None:
        self.row, self.start, self.n, self.gram = (x[index] for x in (self.row, self.start, self.n, self.gram))

    def segments(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """All texts' bytes end to end, and where in them the segment of each run begins, and its size."""
        size = np.array([len(t) for t in self.texts], np.int64)
        return np.frombuffer(b"".join(self.texts), np.uint8), (np.cumsum(size) - size)[self.row] + self.start, self.n + self.width - 1


def _dealt(docs: DataFrame, shards: int, name: str) -> DataFrame:
    """``docs`` with the shard of each row, by doc_id and text."""
    return docs.withColumn(name, F.pmod(F.xxhash64("doc_id", "text"), F.lit(shards)).cast("int"))


def _ids(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """doc_ids (0 for null) and which rows have one."""
    return column.fill_null(0).to_numpy(), ~column.is_null().to_numpy()


def _bucket_edges(gram: np.ndarray, buckets: int) -> np.ndarray:
    """Where each bucket starts in grams in order; a bucket is a range of grams, whose hashes are uniform."""
    return np.searchsorted(gram, np.array([(b << 64) // buckets for b in range(buckets)], np.uint64)).tolist() + [len(gram)]


def _distinct(gram: np.ndarray) -> np.ndarray:
    gram = np.sort(gram)
    return gram[K.distinct_runs(gram)]


def _first_pass(width: int, buckets: int, shard: str):
    def run(group: pa.Table) -> pa.Table:
        doc, use = _ids(group.column("doc_id"))
        runs = Runs(K.as_bytes(group.column("text")), use, width)
        gram = _distinct(runs.gram)
        cut = _bucket_edges(gram, buckets)
        index = np.searchsorted(gram, runs.gram)
        low, high = np.full(len(gram), np.iinfo(np.int64).max), np.full(len(gram), np.iinfo(np.int64).min)
        np.minimum.at(low, index, doc[runs.row])
        np.maximum.at(high, index, doc[runs.row])
        some = [b for b in range(buckets) if cut[b] < cut[b + 1]]
        g = group.column(shard)[0].as_py()
        packed = [_pack(gram[cut[b] : cut[b + 1]], low[cut[b] : cut[b + 1]] != high[cut[b] : cut[b + 1]]) for b in some]
        return pa.table({"bucket": pa.array(some, pa.int32()), "shard": pa.array([g] * len(some), pa.int32()), "message": pa.array(packed, pa.binary())})

    return run


def _count_grams(group: pa.Table) -> pa.Table:
    """A bit for each gram that a shard has sent: whether several shards, or documents of one shard, have it."""
    sent = [_unpack(x, np.uint64, bool) for x in group.column("message").to_pylist()]
    gram = np.concatenate([x[0] for x in sent])
    _, inverse, count = np.unique(gram, return_inverse=True, return_counts=True)
    several = count > 1
    np.logical_or.at(several, inverse, np.concatenate([x[1] for x in sent]))
    answer = np.split(several[inverse], np.cumsum([len(x[0]) for x in sent])[:-1])
    return pa.table({"shard": group.column("shard"), "bucket": group.column("bucket"), "grams": pa.array([_pack(np.packbits(a)) for a in answer], pa.binary())})


def _known(runs: Runs, buckets: int, answers: dict[int, bytes]) -> None:
    """Keep the runs whose gram the buckets have marked."""
    gram = _distinct(runs.gram)
    cut = _bucket_edges(gram, buckets)
    mark = np.zeros(len(gram), bool)
    for b, blob in answers.items():
        n = cut[b + 1] - cut[b]
        mark[cut[b] : cut[b + 1]] = np.unpackbits(_unpack(blob, np.uint8)[0], count=n).astype(bool)
    good = gram[mark]
    if not len(good):
        runs.take(np.zeros(0, np.int64))
        return
    at = np.minimum(np.searchsorted(good, runs.gram), len(good) - 1)
    runs.take(np.flatnonzero(good[at] == runs.gram))


def _segments(runs: Runs) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Order of gram, digest, bytes; where a distinct segment starts in it; and the digest of each."""
    data, start, size = runs.segments()
    digest = K.byte_hashes(data, start, start + size)
    by, fresh = K.variants(data, start, size, runs.gram, digest)
    at = np.flatnonzero(fresh)
    return by, at, digest[by][at]


def _second_pass(width: int, buckets: int, shard: str):
    def run(group: pa.Table, answers: pa.Table) -> pa.Table:
        empty = pa.table({"bucket": pa.array([], pa.int32()), "shard": pa.array([], pa.int32()), "message": pa.array([], pa.binary())})
        if not len(group):
            return empty
        texts = K.as_bytes(group.column("text"))
        doc, use = _ids(group.column("doc_id"))
        runs = Runs(texts, use, width)
        _known(runs, buckets, dict(zip(answers.column("bucket").to_pylist(), answers.column("grams").to_pylist(), strict=True)))
        if not len(runs.row):
            return empty
        by, at, digest = _segments(runs)
        least = np.minimum.reduceat(doc[runs.row][by], at)
        one = by[at]
        row, start, end = runs.row[one], runs.start[one], runs.start[one] + runs.n[one] + width - 1
        cut = _bucket_edges(runs.gram[one], buckets)
        some = [b for b in range(buckets) if cut[b] < cut[b + 1]]
        g = group.column(shard)[0].as_py()
        packed = []
        for b in some:
            x = slice(cut[b], cut[b + 1])
            body = b"".join(texts[r][s:e] for r, s, e in zip(row[x].tolist(), start[x].tolist(), end[x].tolist(), strict=True))
            packed.append(_pack(runs.gram[one][x], digest[x], least[x], runs.n[one][x].astype(np.int32), np.frombuffer(body, np.uint8)))
        return pa.table({"bucket": pa.array(some, pa.int32()), "shard": pa.array([g] * len(some), pa.int32()), "message": pa.array(packed, pa.binary())})

    return run


def _common_context(gram: np.ndarray, context: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Longest prefix of each row of ``context`` (its first ``length`` bytes) that another row of the same gram has; -1 if there is no other."""
    words = np.zeros((len(context), -(-context.shape[1] // 8) * 8), np.uint8)
    words[:, : context.shape[1]] = context
    # of contexts that are equal once padded, the shorter first, as if their ends were below every byte
    by = np.lexsort([length, *words.view(">u8").astype(np.uint64).T[::-1], gram])
    sorted_context, sorted_gram, sorted_length = context[by], gram[by], length[by]
    same = sorted_context[1:] == sorted_context[:-1]
    run = np.where(same.all(1), context.shape[1], same.argmin(1))
    run = np.minimum(run, np.minimum(sorted_length[1:], sorted_length[:-1]))
    run = np.where(sorted_gram[1:] == sorted_gram[:-1], run, -1)
    out = np.full(len(context), -1, np.int64)
    out[by[1:]] = run
    out[by[:-1]] = np.maximum(out[by[:-1]], run)
    return out


def _shared_parts(gram: np.ndarray, data: np.ndarray, size: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Begin and end (in each segment) of the part that another segment of its gram may share; empty where none.

    A string holds the gram with d bytes before it and width - GRAM - d after it, so it needs that many
    bytes of context in common with another segment. Where a segment has its gram twice, nothing is bounded.
    """
    first = np.cumsum(size) - size
    h = K.mix(K.byte_grams(data))
    owner = np.repeat(np.arange(len(size)), size)[: len(h)]
    hit = np.flatnonzero(h == gram[owner])
    hit = hit[hit + GRAM <= (first + size)[owner[hit]]]
    times = np.bincount(owner[hit], minlength=len(size))
    anchor = np.zeros(len(size), np.int64)
    anchor[owner[hit][::-1]] = (hit - first[owner[hit]])[::-1]
    reach = width - GRAM
    padded = np.concatenate([np.zeros(reach, np.uint8), data, np.zeros(reach, np.uint8)])
    step = np.arange(reach)
    before, after = np.minimum(anchor, reach), np.minimum(size - anchor - GRAM, reach)
    place = (first + anchor + reach)[:, None]
    left = np.where(step < before[:, None], padded[place - 1 - step], 0)
    right = np.where(step < after[:, None], padded[place + GRAM + step], 0)
    common_left, common_right = _common_context(gram, left, before), _common_context(gram, right, after)
    begin, end = anchor - common_left, anchor + GRAM + common_right
    none = (common_left < 0) | (common_right < 0) | (end - begin < width)
    begin, end = np.where(none, 0, begin), np.where(none, 0, end)
    loops = np.unique(gram[times != 1])
    whole = np.isin(gram, loops)
    return np.where(whole, 0, begin), np.where(whole, size, end)


def _merge_segments(group: pa.Table, width: int) -> pa.Table:
    """For each segment that a shard has sent: runs (windows, least doc_id) that cover its windows in order."""
    sent = [_unpack(x, np.uint64, np.uint64, np.int64, np.int32, np.uint8) for x in group.column("message").to_pylist()]
    gram, digest, least, n = (np.concatenate([x[i] for x in sent]) for i in range(4))
    data = np.concatenate([x[4] for x in sent])
    size = n.astype(np.int64) + width - 1
    first = np.cumsum(size) - size
    by, new = K.variants(data, first, size, gram, digest)
    at = np.flatnonzero(new)
    variant = np.empty(len(by), np.int64)
    variant[by] = np.cumsum(new) - 1
    low = np.minimum.reduceat(least[by], at)
    one = by[at]

    # windows of the distinct segments, in order
    windows = n[one].astype(np.int64)
    base = np.cumsum(windows) - windows
    found = np.repeat(low, windows)
    same = np.append(0, np.cumsum(gram[one][1:] != gram[one][:-1])) if len(one) else np.zeros(0, np.int64)
    several = np.flatnonzero(np.bincount(same)[same] > 1)
    if len(several):
        s = one[several]
        picked = data[K.ranges(first[s], size[s])]
        begin, end = _shared_parts(gram[s], picked, size[s], width)
        some = np.flatnonzero(end > begin)
        source, begin, end = several[some], begin[some], end[some]
        load = np.cumsum(end - begin)
        grams = same[source]
        chunk = (load // MERGE_BYTES) if len(load) else load
        # a chunk ends only between grams
        chunk = chunk[np.searchsorted(grams, grams)] if len(grams) else chunk
        for c in np.unique(chunk):
            x = np.flatnonzero(chunk == c)
            length = (end - begin)[x]
            part = data[K.ranges(first[one[source[x]]] + begin[x], length)]
            # segments that share the same part are one string
            stop = np.cumsum(length)
            order, fresh = K.variants(part, stop - length, length, grams[x], K.byte_hashes(part, stop - length, stop))
            lead = np.flatnonzero(fresh)
            member = np.empty(len(order), np.int64)
            member[order] = np.cumsum(fresh) - 1
            chosen = order[lead]
            part_low = np.minimum.reduceat(low[source[x]][order], lead)
            part_base = np.cumsum(length[chosen] - width + 1) - (length[chosen] - width + 1)
            string, place, interval = repeated_intervals(part[K.ranges((stop - length)[chosen], length[chosen])], length[chosen], width, PARTS)
            rank = np.argsort(interval, kind="stable")
            cut = K.distinct_runs(interval[rank])
            lowest = np.minimum.reduceat(part_low[string][rank], cut)
            of_part = np.empty(len(string), np.int64)
            of_part[(part_base[string] + place)[rank]] = np.repeat(lowest, np.diff(np.append(cut, len(rank))))
            count = length - width + 1
            found[K.ranges(base[source[x]] + begin[x], count)] = of_part[K.ranges(part_base[member], count)]

    change = np.ones(len(found), bool)
    change[1:] = found[1:] != found[:-1]
    change[base] = True
    place = np.flatnonzero(change)
    length, value = np.diff(np.append(place, len(found))).astype(np.int32), found[place]
    pieces = np.diff(np.append(np.searchsorted(place, base), len(place)))
    piece_first = np.cumsum(pieces) - pieces
    answers, begin = [], 0
    for x in sent:
        v = variant[begin : begin + len(x[0])]
        begin += len(x[0])
        pick = K.ranges(piece_first[v], pieces[v])
        answers.append(_pack(pieces[v].astype(np.int32), length[pick], value[pick]))
    return pa.table({"shard": group.column("shard"), "bucket": group.column("bucket"), "segments": pa.array(answers, pa.binary())})


def _last_pass(width: int, buckets: int, own: list[str], schema: pa.Schema):
    def run(group: pa.Table, answers: pa.Table) -> pa.Table:
        if not len(group):
            return schema.empty_table()
        texts = K.as_bytes(group.column("text"))
        doc, use = _ids(group.column("doc_id"))
        runs = Runs(texts, use, width)
        bucket_of = answers.column("bucket").to_pylist()
        _known(runs, buckets, {b: x for b, x in zip(bucket_of, answers.column("grams").to_pylist(), strict=True) if x is not None})
        said = {b: x for b, x in zip(bucket_of, answers.column("segments").to_pylist(), strict=True) if x is not None}
        size = np.array([len(t) for t in texts], np.int64)
        first = np.cumsum(size) - size
        cover = np.zeros(int(size.sum()) + 1, np.int32)
        if len(runs.row):
            by, at, _ = _segments(runs)
            segment = np.empty(len(by), np.int64)
            segment[by] = np.repeat(np.arange(len(at)), np.diff(np.append(at, len(by))))
            parts = [_unpack(said[b], np.int32, np.int32, np.int64) for b in sorted(said)]
            pieces, length, value = (np.concatenate([p[i] for p in parts]) for i in range(3))
            length = length.astype(np.int64)
            piece_first = np.cumsum(pieces) - pieces
            # where each piece begins in its segment
            offset = np.cumsum(length) - length
            offset -= np.repeat(offset[piece_first], pieces)
            count = pieces[segment].astype(np.int64)
            pick = K.ranges(piece_first[segment].astype(np.int64), count)
            of = np.repeat(np.arange(len(segment)), count)
            gone = value[pick] < doc[runs.row[of]]
            pick, of = pick[gone], of[gone]
            start = first[runs.row[of]] + runs.start[of] + offset[pick]
            np.add.at(cover, start, 1)
            np.add.at(cover, start + length[pick] + width - 1, -1)
        out = np.cumsum(cover[:-1]) > 0
        data = np.frombuffer(b"".join(texts), np.uint8)
        kept = data[~out].tobytes()
        lost = np.append(0, np.cumsum(out))
        removed = lost[first + size] - lost[first]
        cut = np.append(0, np.cumsum(size - removed))
        edge = out.copy()
        edge[1:] &= ~out[:-1]
        edge[first[size > 0]] = out[first[size > 0]]
        edges = np.append(0, np.cumsum(edge))
        columns = [group.column(c) for c in own]
        columns += [pa.array([kept[a:b] for a, b in zip(cut, cut[1:], strict=False)], pa.binary()), pa.array(size), pa.array(removed), pa.array(edges[first + size] - edges[first])]
        return pa.table(columns, names=[*own, "kept", "n_bytes", "n_removed", "n_spans"])

    return run


@named("kept", "n_bytes", "n_removed", "n_spans")
def dedup_bytes(docs: DataFrame, width: int = WIDTH, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """``docs`` (doc_id long) with kept (binary), n_bytes, n_removed and n_spans."""
    small_batches(docs.sparkSession)
    size = docs.agg(F.sum(F.octet_length("text")), F.count("*")).first()
    shards = max(1, -(-int(size[0] or 0) // shard_bytes), -(-int(size[1]) // SHARD_DOCS))
    buckets = shards
    shard = free_name(docs, "shard_")
    slim = _dealt(docs.select("doc_id", "text"), shards, shard)
    message = "bucket int, shard int, message binary"
    sent = slim.groupBy(shard).applyInArrow(_first_pass(width, buckets, shard), message)
    grams = stash(sent.groupBy("bucket").applyInArrow(_count_grams, "shard int, bucket int, grams binary"), "bytes-grams")
    to_shard = grams.withColumnRenamed("shard", shard)
    sent = slim.groupBy(shard).cogroup(to_shard.groupBy(shard)).applyInArrow(_second_pass(width, buckets, shard), message)
    merged = stash(sent.groupBy("bucket").applyInArrow(lambda t: _merge_segments(t, width), "shard int, bucket int, segments binary"), "bytes-segments")

    empty = F.lit(None).cast("binary")
    answers = grams.withColumn("segments", empty).unionByName(merged.withColumn("grams", empty)).withColumnRenamed("shard", shard)
    own = docs.columns
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    kinds += ", kept binary, n_bytes long, n_removed long, n_spans long"
    schema = to_arrow_schema(StructType.fromDDL(kinds))
    return _dealt(docs, shards, shard).groupBy(shard).cogroup(answers.groupBy(shard)).applyInArrow(_last_pass(width, buckets, own, schema), kinds)


def op2_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = dedup_bytes(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


SQL = r"""
with d as (
  select row_number() over () as r, doc_id, hex(encode(coalesce(text, ''))) as h from documents
), win as materialized (
  select r, doc_id, unnest(x) as w, generate_subscripts(x, 1) as i
  from (select r, doc_id, list_transform(range(1, len(h) // 2 - 48), lambda i: md5_number(substr(h, 2 * i - 1, 100))) as x from d where len(h) >= 100)
), low as (
  select w, min(doc_id) as m from win group by w
), start as (
  select r, i, case when lag(i) over (partition by r order by i) >= i - 50 then 0 else 1 end as fresh from win join low using (w) where m < doc_id
), span as (
  select r, s, min(i) as a, max(i) + 50 as b from (select *, sum(fresh) over (partition by r order by i) as s from start) group by r, s
), spans as (
  select r, count(*) as n, sum(b - a) as gone, list(a order by a) as starts, list(b order by a) as stops from span group by r
)
select doc_id, (len(h) // 2)::bigint as n_bytes, coalesce(gone, 0)::bigint as n_removed, coalesce(n, 0)::bigint as n_spans,
  sha256(unhex(case when n is null then h else array_to_string(list_transform(range(0, n + 1), lambda k: substr(h, 2 * (case when k = 0 then 1 else stops[k] end) - 1, 2 * ((case when k = n then len(h) // 2 + 1 else starts[k + 1] end) - (case when k = 0 then 1 else stops[k] end)))), '') end)) as kept_sha256
from d left join spans using (r)
"""
