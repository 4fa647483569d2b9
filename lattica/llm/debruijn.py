"""Substring dedup of word windows by De Bruijn compaction.

A word is removed if a window of ``width`` words that covers it also starts anywhere else. Each window
belongs to the least hash of its token k-mers; consecutive windows with the same one are a run. Equal
windows have equal k-mers, so only runs whose k-mer repeats matter.

1. One pass over the texts: the runs of each text (k-mer, digest of the run's words). Texts with the
   same bytes are one node with a number of copies.
2. Edges of the graph are the token k-mers that are least in some window, a sparse De Bruijn graph; they are
   counted over all nodes. A run whose k-mer and digest repeat is a repeated edge with its context.
3. Repeated edges that always follow one another compact into nonbranching paths: each edge points
   to its only predecessor, and joins double the pointers until they reach the heads. All places of an edge
   then lie in whole places of its path, which are long repeated spans by source coordinates (node,
   start, length).
4. The texts are read again at these coordinates, each path's place once and as a whole, and the words of all
   places of a path are compared. Runs whose k-mer repeats, elsewhere or within the run, but whose digest
   doesn't are read too, one for each digest; of their windows, those whose hash repeats are compared by words.

Hashes only propose. Where places of one path, or windows of one hash, differ in a word, all is done again
under another hash.

Groups are counted by partial aggregates, so an edge that a third of all texts share is a row a task.

Cases: null and empty texts have no words; texts of fewer than ``width`` words lose nothing; rows with the
same doc_id are documents of their own, and so are repeated rows, which lose all windows; an empty
table gives no rows; columns besides doc_id and text are passed on, and the added columns get underscores
where one has its name.
"""

from __future__ import annotations

import secrets
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import _kernels as K
from ._common import drop_stash, free_name, likely_in, named, small_batches, stash, table, text_key

WIDTH, KMER = 35, 8
RUN = ("start", "n", "kmer", "digest", "loops")


def _codes(texts: list[bytes], seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of the texts, and each text's first word."""
    data, starts, ends, first = K.words(texts, K.SPACED)
    return K.byte_hashes(data, starts, ends, seed), first


def _window_starts(first: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Owner and place (of all words) of every window."""
    number = np.maximum(np.diff(first) - width + 1, 0)
    return np.repeat(np.arange(len(number)), number), K.ranges(first[:-1], number)


def _block_runs(texts: list[bytes], width: int, k: int, seed: int) -> list[tuple[np.ndarray, ...]]:
    """For each text: starts, lengths (windows), k-mers and digests of its runs, and whether one may hold equal windows."""
    h, first = _codes(texts, seed)
    owner, at = _window_starts(first, width)
    if not len(at):
        return [(np.zeros(0, np.int32), np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool))] * len(texts)
    levels = K.Levels(h)
    gram = levels.level(k.bit_length() - 1)
    least = K.sliding_min(gram, width - k + 1)[at]
    # equal windows of one run have the k-mer at two places: both in one window, or further apart than a window
    low = np.uint64((1 << 24) - 1)
    place = np.arange(len(gram), dtype=np.uint64) & low
    leftmost = K.sliding_min((gram & ~low) | place, width - k + 1)[at] & low
    rightmost = low - (K.sliding_min((gram & ~low) | (low - place), width - k + 1)[at] & low)
    two = leftmost != rightmost
    new = np.ones(len(at), bool)
    new[1:] = (least[1:] != least[:-1]) | (owner[1:] != owner[:-1])
    run = np.flatnonzero(new)
    length = np.diff(np.append(run, len(at)))
    digest = levels.span(at[run], at[run] + length + width - 1)
    start = (at[run] - first[owner[run]]).astype(np.int32)
    cut = np.searchsorted(owner[run], np.arange(len(texts) + 1))
    loops = np.logical_or.reduceat(two, run) | (length > width - k + 1)
    columns = (start, length.astype(np.int32), least[run].astype(np.int64), digest.astype(np.int64), loops)
    return [tuple(c[a:b] for c in columns) for a, b in zip(cut, cut[1:], strict=False)]


def text_runs(texts: DataFrame, width: int = WIDTH, k: int = KMER, seed: int = 0) -> DataFrame:
    """key and the runs' start, n, kmer, digest, loops of (key, text); k is a power of two."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = K.as_bytes(batch.column("text"))
            rows = [r for a, b in K.blocks(own) for r in _block_runs(own[a:b], width, k, seed)]
            kinds = (pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column("key"), *(pa.array([r[i] for r in rows], pa.list_(kind)) for i, kind in enumerate(kinds))], names=["key", *RUN])

    return texts.mapInArrow(run, "key binary, start array<int>, n array<int>, kmer array<long>, digest array<long>, loops array<boolean>")


def paths(runs: DataFrame) -> DataFrame:
    """label, path of the labels of ``runs`` (node, start, n, label): labels that always follow one another share a path.

    A label points to its predecessor if all its occurrences follow that one and all of that one's are
    followed by it. Joins double the pointers; a label that nothing precedes is its path's name.
    """
    by = Window.partitionBy("node").orderBy("start")
    end = F.col("start") + F.col("n")
    near = runs.select("label", F.when(F.lag(end).over(by) == F.col("start"), F.lag("label").over(by)).alias("before"), F.when(F.lead("start").over(by) == end, F.lead("label").over(by)).alias("after"))
    only = lambda c: F.when((F.count(c) == F.count("*")) & (F.min(c) == F.max(c)), F.min(c))
    ways = stash(near.groupBy("label").agg(only("before").alias("before"), only("after").alias("after")), "path-ways")
    ahead = ways.where("after is not null and after <> label").select(F.col("label").alias("before"), F.col("after").alias("label"))
    joined = ways.select("label", "before").join(ahead.withColumn("ok", F.lit(True)), ["label", "before"], "left")
    now = stash(joined.select("label", F.when(F.col("ok"), F.col("before")).alias("up")), "path-pointers")
    drop_stash(ways)
    # label -> up; where up is null the label is a head. A round replaces up by up's up, and stops where that is a head.
    while True:
        above = now.select(F.col("label").alias("up"), F.col("up").alias("upper"))
        new = stash(now.join(above, "up", "left").select("label", F.coalesce("upper", "up").alias("up"), F.col("upper").isNotNull().alias("moved")), "path-pointers")
        moved = new.where("moved").limit(1).count()
        drop_stash(now)
        now = new.drop("moved")
        if not moved:
            break
    return now.select("label", F.coalesce("up", "label").alias("path"))


def path_places(runs: DataFrame) -> DataFrame:
    """node, path, start, n: the places of the paths of ``runs`` (node, start, n, label); each is a whole path."""
    known = stash(paths(runs), "runs-paths")
    by = Window.partitionBy("node").orderBy("start")
    follows = F.coalesce((F.lag(F.col("start") + F.col("n")).over(by) == F.col("start")) & (F.lag("path").over(by) == F.col("path")) & (F.col("label") != F.col("path")), F.lit(False))
    numbered = runs.join(known, "label").withColumn("new", F.when(follows, 0).otherwise(1)).withColumn("part", F.sum("new").over(by.rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.groupBy("node", "part").agg(F.first("path").alias("path"), F.min("start").alias("start"), F.sum("n").cast("int").alias("n")).drop("part")


def repeated_spans(docs: DataFrame, width: int = WIDTH, k: int = KMER) -> DataFrame:
    """key, spans: the runs of windows (start, n) of each text whose windows all start elsewhere too."""
    small_batches(docs.sparkSession)
    seed = 0
    while (spans := _spans(docs, width, k, seed)) is None:
        seed = secrets.randbits(64)
    return spans


def _spans(docs: DataFrame, width: int, k: int, seed: int) -> DataFrame | None:
    """As repeated_spans; None if words differ where their hashes under ``seed`` agree."""
    keyed = docs.select(text_key(F.col("text")).alias("key"), "text")
    found = text_runs(keyed, width, k, seed).where(F.size("start") > 0)
    nodes = stash(found.groupBy("key").agg(F.count("*").alias("copies"), F.first(F.struct(*RUN)).alias("r")).select(F.monotonically_increasing_id().alias("node"), "key", "copies", "r.*"), "runs-nodes")
    runs = nodes.select("node", "copies", F.explode(F.arrays_zip(*RUN)).alias("r")).select("node", "copies", "r.*")
    variants = runs.groupBy("kmer", "digest").agg(F.sum("copies").alias("times"), F.max("loops").alias("loops"))
    of_kmer = variants.groupBy("kmer").agg(F.sum("times").alias("all_times"), F.count("*").alias("variants"), F.max("loops").alias("any_loops")).where("all_times > 1 or any_loops").select("kmer", "variants")
    known = stash(variants.join(of_kmer, "kmer"), "runs-repeated")
    repeated = stash(likely_in(runs.drop("copies", "loops"), ["kmer", "digest"], known).join(known, ["kmer", "digest"]).withColumn("label", F.xxhash64("kmer", "digest")), "runs-places")
    drop_stash(known)

    long_spans = stash(path_places(repeated.where("times > 1").select("node", "start", "n", "label")), "runs-long")
    # one source of each digest of the k-mers that have several, or whose run may hold equal windows
    sources = repeated.where("variants > 1 or loops").groupBy("kmer", "digest").agg(F.min(F.struct("node", "start", "n")).alias("s"), F.first("times").alias("times"))
    places = long_spans.groupBy("node").agg(F.collect_list(F.struct("path", "start", "n")).alias("places"))
    wanted = sources.groupBy("s.node").agg(F.collect_list(F.struct("kmer", "digest", "times", "s.start", "s.n")).alias("wanted"))
    wanted = stash(nodes.select("node", "key").join(places.join(wanted, "node", "full"), "node").drop("node"), "runs-wanted")
    texts = likely_in(keyed, ["key"], wanted).groupBy("key").agg(F.first("text").alias("text"))
    read = stash(_read(texts.join(wanted, "key"), width, seed), "runs-words")
    drop_stash(wanted)
    differs = lambda g: bool(g.agg((F.min("words") != F.max("words")).alias("differ")).where("differ").limit(1).count())
    collided = differs(read.where("path is not null").groupBy("path"))

    windows = read.where("path is null")
    one = windows.select("kmer", "digest", "times", F.posexplode("windows").alias("offset", "window"))
    twice = stash(one.groupBy("kmer", "window").agg(F.sum("times").alias("all_times")).where("all_times > 1").select("kmer", "window"), "runs-windows")
    matched = one.join(twice, ["kmer", "window"], "left_semi").groupBy("kmer", "digest").agg(F.collect_list(F.struct("offset", "window")).alias("found"))
    matched = stash(windows.select("kmer", "digest", "times", "words").join(matched, ["kmer", "digest"]).select("kmer", "digest", "times", "found", F.split(F.col("words").cast("string"), " ").alias("w")), "runs-matched")
    exact = matched.select("kmer", "w", F.explode("found").alias("f")).select("kmer", "f.window", F.array_join(F.slice("w", F.col("f.offset") + 1, width), " ").alias("words"))
    collided = collided or differs(exact.groupBy("kmer", "window"))
    if collided:
        for made in (nodes, repeated, long_spans, read, twice, matched):
            drop_stash(made)
        return None
    verified = matched.where("times = 1").select("kmer", "digest", F.col("found.offset").alias("offsets"))
    short_spans = repeated.where("times = 1").join(verified, ["kmer", "digest"]).select("node", F.explode("offsets").alias("o"), "start").select("node", (F.col("start") + F.col("o")).alias("start"), F.lit(1).alias("n"))
    by_node = long_spans.drop("path").unionByName(short_spans).groupBy("node").agg(F.collect_list(F.struct("start", "n")).alias("spans"))
    spans = stash(nodes.select("node", "key").join(by_node, "node").select("key", "spans"), "runs-spans")
    for made in (nodes, repeated, long_spans, read, twice, matched):
        drop_stash(made)
    return spans


def _read(texts: DataFrame, width: int, seed: int) -> DataFrame:
    """What stands at the source coordinates of (text, places, wanted): the words of the paths in ``places``, and the
    words and window hashes, in order, of the runs in ``wanted``; either may be null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = K.as_bytes(batch.column("text"))
            for a, b in K.blocks(own):
                data, starts, ends, first = K.words(own[a:b], K.SPACED)
                raw = data.tobytes()

                def at_source(name: str) -> tuple[pa.StructArray, np.ndarray, np.ndarray, list[bytes]]:
                    part = batch.column(name).slice(a, b - a)  # noqa: B023
                    flat, count = part.flatten(), np.array([len(x) if x.is_valid else 0 for x in part], np.int64)
                    place = first[np.repeat(np.arange(len(part)), count)] + flat.field("start").to_numpy()  # noqa: B023
                    n = flat.field("n").to_numpy().astype(np.int64)
                    body = [b" ".join(raw[s:e].split()) for s, e in zip(starts[place].tolist(), ends[place + n + width - 2].tolist(), strict=True)]  # noqa: B023
                    return flat, place, n, body

                flat, _, _, body = at_source("places")
                yield rows(len(body), path=flat.field("path"), words=pa.array(body, pa.binary()))
                flat, place, n, body = at_source("wanted")
                at = K.ranges(place, n)
                window = K.Levels(K.byte_hashes(data, starts, ends, seed)).span(at, at + width).astype(np.int64)
                lists = pa.ListArray.from_arrays(np.append(0, np.cumsum(n)).astype(np.int32), pa.array(window))
                yield rows(len(body), words=pa.array(body, pa.binary()), windows=lists, **{c: flat.field(c) for c in ("kmer", "digest", "times")})

    kinds = {"path": pa.int64(), "words": pa.binary(), "kmer": pa.int64(), "digest": pa.int64(), "times": pa.int64(), "windows": pa.list_(pa.int64())}

    def rows(n: int, **columns: pa.Array) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([columns[c] if c in columns else pa.nulls(n, kind) for c, kind in kinds.items()], names=list(kinds))

    return texts.select("text", "places", "wanted").mapInArrow(run, "path long, words binary, kmer long, digest long, times long, windows array<long>")


@named("kept", "n_words", "n_removed")
def dedup_windows(docs: DataFrame, width: int = WIDTH, k: int = KMER) -> DataFrame:
    """``docs`` with kept (the words left, joined by single spaces; binary), n_words and n_removed."""
    spans = repeated_spans(docs, width, k)
    key, marks = free_name(docs, "key_"), free_name(docs, "spans_")
    joined = docs.withColumn(key, text_key(F.col("text"))).join(spans.select(F.col("key").alias(key), F.col("spans").alias(marks)), key, "left").drop(key)
    own = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, spans = K.as_bytes(batch.column("text")), batch.column(marks)
            kept: list[bytes] = []
            total: list[int] = []
            gone: list[int] = []
            for a, b in K.blocks(texts):
                data, starts, ends, first = K.words(texts[a:b], K.SPACED)
                part = spans.slice(a, b - a)
                count = np.array([len(x) if x.is_valid else 0 for x in part], np.int64)
                flat = part.flatten()
                base = first[np.repeat(np.arange(b - a), count)]
                change = np.zeros(len(starts) + 1, np.int64)
                s, n = flat.field("start").to_numpy(), flat.field("n").to_numpy()
                np.add.at(change, base + s, 1)
                np.add.at(change, base + s + n + width - 1, -1)
                out = np.cumsum(change[:-1]) > 0
                # a word and the byte after it, which becomes the space
                stays = np.flatnonzero(~out)
                image = data.copy()
                image[ends] = 32
                picked = image[K.ranges(starts[stays], ends[stays] - starts[stays] + 1)].tobytes()
                sizes = np.append(0, np.cumsum(ends[stays] - starts[stays] + 1))
                cut = sizes[np.searchsorted(stays, first)]
                kept += [picked[x : max(x, y - 1)] for x, y in zip(cut, cut[1:], strict=False)]
                total += np.diff(first).tolist()
                lost = np.append(0, np.cumsum(out))
                gone += (lost[first[1:]] - lost[first[:-1]]).tolist()
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in own), pa.array(kept, pa.binary()), pa.array(total, pa.int64()), pa.array(gone, pa.int64())], names=[*own, "kept", "n_words", "n_removed"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    return joined.mapInArrow(run, f"{kinds}, kept binary, n_words long, n_removed long")


def op7_debruijn(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = dedup_windows(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


SQL = r"""
with d as (
  select row_number() over () as r, doc_id, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) as w from documents
), win as (
  select r, i, md5(array_to_string(w[i:i + 34], ' ')) as h from d, lateral (select unnest(range(1, len(w) - 33)) as i) where len(w) >= 35
), rep as (
  select r, i from win where h in (select h from win group by h having count(*) > 1)
), gone as (
  select distinct r, p from rep, lateral (select unnest(range(i, i + 35)) as p)
), words as (
  select r, p, w[p] as word from d, lateral (select unnest(range(1, len(w) + 1)) as p)
), kept as (
  select r, string_agg(word, ' ' order by p) as s from words anti join gone using (r, p) group by r
), lost as (
  select r, count(*) as n from gone group by r
)
select doc_id, len(w)::bigint as n_words, coalesce(n, 0)::bigint as n_removed, sha256(coalesce(s, '')) as kept_sha256 from d left join kept using (r) left join lost using (r)
"""
