"""Near-duplicate vectors by an epsilon grid order join.

Vectors are linked if their cosine, in double precision, is ``least`` or more: at length one, if they lie within
epsilon = sqrt(2 - 2 least). Projections onto principal directions, and the length of what these leave, only bring
vectors nearer, so whatever is farther than epsilon there is no link.

1. Vectors with the same numbers are one node, with a count, from here on. One pass sums their second moments,
   whose eigenvectors are the directions; they only steer the order, so results are exact with any.
2. Nodes are range-sorted by the grid cells (side epsilon) of their ``LEADING`` coordinates and cut into blocks
   of bounded bytes, each with the box of its coordinates.
3. Blocks in sequence make panels, as many as there are cores, or more where one would be larger than ``PANEL_BLOCKS``. Intervals of ``FAN``
   panels, of ``FAN`` such intervals and so on make a tree. From the whole sequence against itself downwards, each
   pair of intervals is replaced by the pairs of their parts that their boxes leave within epsilon: two equality
   joins a level, on the part's interval, so no pair of panels is looked at whose intervals are provably distant.
4. Of a pair of panels one is the host, whose task holds its blocks; the other's blocks are sent there once and pass one by one. So a block is
   sent to half of the panels at most, however many blocks it is compared with.
5. A pair of blocks goes on halving within its task and skips what is distant, down to ``LEAF`` vectors a side,
   whose cosines are one matrix product: in single precision first, which settles all that lie farther below the bound than it may err.
   It returns sums of links for its vectors and, of its links, the components as stars: never a row for a pair of vectors.
6. Components of the stars, over Spark, name the classes.

How much is skipped depends on the data: where the leading directions hold little more variance than the
others, boxes overlap and most pairs of blocks are compared, whose number then grows with the square; what is sent grows
with the number of panels times the table.

Cases: null, empty and zero vectors, and those with null or non-finite components, link with nothing; vectors of different
lengths don't link; sizes of numbers don't matter (each is scaled first); repeated rows link with each other; a null vec_id
names no component unless it has no other, and is not kept; an empty table gives no rows; columns besides vec_id and
embedding are passed on, and the added columns get underscores where one has its name.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from functools import cached_property, reduce
from operator import add

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._common import drop_stash, free_names, small_batches, stash, table
from .graph import components

LEAST = 0.9
#: Principal directions of the order, sought among so many first components of a vector.
LEADING, SPACE = 8, 256
#: Bytes of vectors of a block, children of an interval, and vectors of the least interval within a task.
BLOCK_BYTES, FAN, LEAF = 1 << 20, 16, 256
#: Most blocks of a panel, which a task holds.
PANEL_BLOCKS = 64
#: What rounding may add to a distance between boxes, and a cosine this near to the bound is computed anew with exact sums.
SLACK, NEAR = 1e-9, 1e-12


def _node_rows(vectors: DataFrame) -> DataFrame:
    """``vectors`` with key (SHA-256, 16 bytes; null where a vector links with nothing) and vec (its numbers as doubles), without embedding."""
    own = [c for c in vectors.columns if c != "embedding"]
    kept = ", ".join(f"`{c}` {vectors.schema[c].dataType.simpleString()}" for c in own)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("embedding")
            size = pc.list_value_length(lists).fill_null(0).to_numpy().astype(np.int64)
            values = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64) + 0.0
            owner, ends = np.repeat(np.arange(len(size)), size), np.cumsum(size)
            peak = np.zeros(len(size))
            np.maximum.at(peak, owner, np.abs(values))
            good = (peak > 0) & (np.bincount(owner, ~np.isfinite(values), len(size)) == 0)
            vec = [values[e - n : e].tobytes() if ok else None for e, n, ok in zip(ends, size, good, strict=True)]
            key = [None if v is None else hashlib.sha256(v).digest()[:16] for v in vec]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in own), pa.array(key, pa.binary()), pa.array(vec, pa.binary())], names=[*own, "key", "vec"])

    small_batches(vectors.sparkSession)
    return vectors.withColumn("embedding", F.col("embedding").cast("array<double>")).mapInArrow(run, f"{kept}, key binary, vec binary")


def unit(vec: list[bytes]) -> np.ndarray:
    """Vectors of one length, scaled to length one."""
    return _scaled(np.frombuffer(b"".join(vec), np.float64).reshape(len(vec), -1))


def _scaled(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def directions(nodes: DataFrame, dim: int, leading: int, space: int) -> np.ndarray:
    """Leading eigenvectors (dim x leading at most) of the covariance of the nodes of ``dim`` numbers, in their first ``space`` ones."""
    wide = min(dim, space)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((wide + 1, wide + 1))
        for batch in batches:
            x = unit(batch.column("vec").to_pylist())[:, :wide]
            x = np.column_stack([x, np.ones(len(x))])
            total += x.T @ x
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(total.size)), pa.array(total.ravel())], names=["at", "v"])

    sums = np.zeros((wide + 1) ** 2)
    for at, v in nodes.where(F.octet_length("vec") == 8 * dim).select("vec").mapInArrow(run, "at long, v double").groupBy("at").agg(F.sum("v").alias("v")).collect():
        sums[at] = v
    sums = sums.reshape(wide + 1, wide + 1)
    mean = sums[-1, :-1] / max(sums[-1, -1], 1)
    found = np.linalg.eigh(sums[:-1, :-1] / max(sums[-1, -1], 1) - np.outer(mean, mean))[1][:, ::-1][:, :leading]
    return np.vstack([found, np.zeros((dim - wide, found.shape[1]))])


def coordinates(x: np.ndarray, axes: np.ndarray | None, leading: int) -> np.ndarray:
    """``leading`` coordinates of each unit vector and the length of the rest of it."""
    p = x @ axes if axes is not None else x[:, :leading]
    rest = np.sqrt(np.maximum(0, 1 - (p * p).sum(1)))
    return np.column_stack([p, np.zeros((len(x), leading - p.shape[1])), rest])


def _by_size(vec: list[bytes]) -> Iterator[np.ndarray]:
    size = np.array([len(v) for v in vec], np.int64)
    for n in np.unique(size):
        yield np.flatnonzero(size == n)


def _placed(nodes: DataFrame, dim: int, axes: np.ndarray, epsilon: float, leading: int) -> DataFrame:
    """``nodes`` (key, vec, n) with dim, cells and at (coordinates)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vec = batch.column("vec").to_pylist()
            at = np.zeros((len(vec), leading + 1))
            size = np.array([len(v) // 8 for v in vec], np.int32)
            for of in _by_size(vec):
                at[of] = coordinates(unit([vec[i] for i in of]), axes if size[of[0]] == dim else None, leading)
            cells = np.floor(at[:, :leading] / epsilon).astype(np.int32)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(size), pa.array(list(cells), pa.list_(pa.int32())), pa.array(list(at), pa.list_(pa.float64()))], names=[*batch.schema.names, "dim", "cells", "at"])

    return nodes.mapInArrow(run, f"{', '.join(f'{f.name} {f.dataType.simpleString()}' for f in nodes.schema)}, dim int, cells array<int>, at array<double>")


def _cut(block_bytes: int, leading: int):
    """Blocks of sorted nodes of one length: dim, keys, vecs (packed, as floats where that loses nothing), counts, and the box of dim and coordinates."""

    def cut(rows: pa.Table) -> list:
        at = np.array(rows.column("at").to_pylist()).reshape(rows.num_rows, leading + 1)
        dim = rows.column("dim")[0].as_py()
        low, high = ([10.0 * dim, *f(0)] for f in (at.min, at.max))
        vecs = b"".join(rows.column("vec").to_pylist())
        with np.errstate(over="ignore", under="ignore"):
            short = np.frombuffer(vecs, np.float64).astype(np.float32)
        vecs = short.tobytes() if (short == np.frombuffer(vecs, np.float64)).all() else vecs
        return [dim, b"".join(rows.column("key").to_pylist()), vecs, rows.column("n").to_numpy().astype("<i8").tobytes(), low, high]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        dim = None
        rows = 0

        def out() -> pa.RecordBatch:
            columns = [[x] for x in cut(pa.Table.from_batches(held))]
            kinds = [pa.int32(), *[pa.binary()] * 3, *[pa.list_(pa.float64())] * 2]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["dim", "keys", "vecs", "counts", "low", "high"])

        for batch in batches:
            dims, start = batch.column("dim").to_numpy(), 0
            while start < len(dims):
                if rows and (dims[start] != dim or rows * 8 * dim >= block_bytes):
                    yield out()
                    held, rows = [], 0
                dim = int(dims[start])
                room = max(1, -(-block_bytes // (8 * dim)) - rows)
                same = np.flatnonzero(dims[start : start + room] != dim)
                n = int(same[0]) if len(same) else min(room, len(dims) - start)
                held.append(batch.slice(start, n))
                rows, start = rows + n, start + n
        if rows:
            yield out()

    return run


def _near(a: str, b: str, width: int, epsilon: float) -> F.Column:
    gap = lambda i: F.greatest(F.lit(0.0), F.col(f"{a}.low")[i] - F.col(f"{b}.high")[i], F.col(f"{b}.low")[i] - F.col(f"{a}.high")[i])
    return reduce(add, [gap(i) * gap(i) for i in range(width)]) <= epsilon * epsilon + SLACK


def _joined(boxes: DataFrame, size: int, width: int) -> DataFrame:
    """Boxes of intervals of ``size``."""
    each = lambda f, c: F.array(*[f(F.col(c)[i]) for i in range(width)]).alias(c)
    return boxes.groupBy((F.col("id") / size).cast("long").alias("id")).agg(each(F.min, "low"), each(F.max, "high"))


def block_pairs(boxes: DataFrame, epsilon: float, width: int, fan: int = FAN) -> DataFrame:
    """a, b (a <= b): all pairs of blocks (id from 0, low, high) that may hold vectors within epsilon, by descent from the whole."""
    count = boxes.count()
    levels = [boxes.select("id", "low", "high")]
    while count > 1:
        count = -(-count // fan)
        levels.append(_joined(levels[-1], fan, width))
    pairs = levels.pop().select(F.col("id").alias("a"), F.col("id").alias("b"))
    for level in reversed(levels):
        parts = level.select((F.col("id") / fan).cast("long").alias("parent"), F.struct("id", "low", "high").alias("part"))
        one, two = (parts.select(F.col("parent").alias(c), F.col("part").alias(f"part_{c}")) for c in "ab")
        below = pairs.join(one, "a").join(two, "b").where((F.col("part_a.id") <= F.col("part_b.id")) & _near("part_a", "part_b", width, epsilon))
        pairs = below.select(F.col("part_a.id").alias("a"), F.col("part_b.id").alias("b"))
    return pairs


def dealt(blocks: DataFrame, boxes: DataFrame, epsilon: float, width: int, panel: int, fan: int = FAN) -> DataFrame:
    """``blocks`` (id and more) with host: each in its own panel of ``panel`` blocks, and where its panel is guest (id, low, high of ``boxes`` may be near).

    Of two panels that is the one behind where their distance is even, else the one before, so that each is host to about half of the others. A
    partition holds hosts whole, each with its own blocks first.
    """
    count = -(-boxes.count() // panel) or 1
    pairs = block_pairs(_joined(boxes, panel, width), epsilon, width, fan)
    even = (F.col("b") - F.col("a")) % 2 == 0
    hosts = pairs.select(F.when(even, F.col("a")).otherwise(F.col("b")).alias("host"), F.when(even, F.col("b")).otherwise(F.col("a")).alias("panel"))
    # numbers that Spark's hash sends to one partition each
    slots = blocks.sparkSession.range(64 * count).groupBy(F.pmod(F.hash("id"), F.lit(count)).cast("long").alias("host")).agg(F.min("id").alias("slot"))
    hosts = hosts.join(F.broadcast(slots), "host", "left").withColumn("slot", F.coalesce("slot", "host"))
    placed = blocks.withColumn("panel", (F.col("id") / panel).cast("long")).join(F.broadcast(hosts), "panel").withColumn("guest", F.col("host") != F.col("panel"))
    return placed.repartition(count, "slot").sortWithinPartitions("host", "guest", "id").drop("panel", "slot")


class Side:
    """One block in a task."""

    def __init__(self, dim: int, keys: bytes, vecs: bytes, counts: bytes, axes: np.ndarray | None, leading: int) -> None:
        self.key = [keys[i : i + 16] for i in range(0, len(keys), 16)]
        self.short = np.frombuffer(vecs, np.float64 if len(vecs) == 8 * dim * len(self.key) else np.float32).reshape(-1, dim)
        self.n = np.frombuffer(counts, "<i8")
        x = self.x
        self.single = x.astype(np.float32)
        self.at = coordinates(x, axes, leading)
        self.boxes: dict[tuple[int, int], tuple] = {}
        del self.x  # made again where single precision leaves something open

    @cached_property
    def x(self) -> np.ndarray:
        return _scaled(self.raw)

    @property
    def raw(self) -> np.ndarray:
        return self.short.astype(np.float64)

    def box(self, i: int, j: int) -> tuple[np.ndarray, np.ndarray]:
        if (i, j) not in self.boxes:
            self.boxes[i, j] = self.at[i:j].min(0), self.at[i:j].max(0)
        return self.boxes[i, j]

    @staticmethod
    def halves(i: int, j: int, leaf: int) -> list[tuple[int, int]]:
        return [(i, j)] if j - i <= leaf else [(i, (i + j) // 2), ((i + j) // 2, j)]


def _exact_cosine(x: np.ndarray, y: np.ndarray) -> float:
    x, y = x / np.abs(x).max(), y / np.abs(y).max()
    return math.fsum(x * y) / math.sqrt(math.fsum(x * x) * math.fsum(y * y))


def linked(one: Side, two: Side, least: float, leaf: int = LEAF) -> tuple[np.ndarray, np.ndarray]:
    """Links of each vector of ``one`` and then, unless that is ``two`` itself, of ``two``, and for each the first one of its component.

    A node of n equal vectors counts n times. Links of a node with itself don't count.
    """
    same = one is two
    shift = 0 if same else len(one.key)
    links = np.zeros(shift + len(two.key), np.int64)
    label = np.arange(len(links))
    reach = 2 - 2 * least + SLACK
    # twice what rounding the numbers and their sum may add up to
    single = least - (one.single.shape[1] + 8) * 2.0**-23
    found: list[tuple[int, int, np.ndarray]] = []
    todo = [(0, len(one.key), 0, len(two.key))]
    while todo:
        i, j, k, m = todo.pop()
        (low, high), (low2, high2) = one.box(i, j), two.box(k, m)
        gap = np.maximum(0, np.maximum(low - high2, low2 - high))
        if gap @ gap > reach:
            continue
        parts = [(a, b, c, d) for a, b in Side.halves(i, j, leaf) for c, d in Side.halves(k, m, leaf) if not same or a <= c]
        if len(parts) > 1 or parts[0] != (i, j, k, m):
            todo += parts
            continue
        if (one.single[i:j] @ two.single[k:m].T).max() < single:
            continue
        cosine = one.x[i:j] @ two.x[k:m].T
        hit = cosine >= least
        for r, c in zip(*np.nonzero(np.abs(cosine - least) <= NEAR), strict=True):
            hit[r, c] = _exact_cosine(*(v.astype(np.float64) for v in (one.short[i + r], two.short[k + c]))) >= least
        if same and i == k:
            np.fill_diagonal(hit, False)
        if hit.any():
            links[i:j] += hit @ two.n[k:m]
            if not (same and i == k):
                links[shift + k : shift + m] += one.n[i:j] @ hit
            found.append((i, shift + k, hit))
    changed = True
    while changed:
        changed = False
        for i, k, hit in found:
            rows, columns = label[i : i + hit.shape[0]], label[k : k + hit.shape[1]]
            new = np.minimum(rows, np.where(hit, columns, len(links)).min(1))
            back = np.minimum(columns, np.where(hit, new[:, None], len(links)).min(0))
            changed |= bool((new < rows).any() or (back < columns).any())
            label[i : i + hit.shape[0]] = new
            label[k : k + hit.shape[1]] = np.minimum(label[k : k + hit.shape[1]], back)
    return links, label


def _link(least: float, leaf: int, dim: int, axes: np.ndarray, leading: int):
    """key and links, and stars (a, b), of the pairs of a host's blocks, and of these and its guests."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        host, own = None, []
        for batch in batches:
            for row in range(batch.num_rows):
                of, guest, size, *fields = (batch.column(c)[row].as_py() for c in range(batch.num_columns))
                if of != host:
                    host, own = of, []
                two = Side(size, *fields, axes if size == dim else None, leading)
                if not guest:
                    own.append(two)
                for one in own:
                    if one.short.shape[1] == size:
                        links, label = linked(one, two, least, leaf)
                        keys = one.key if one is two else one.key + two.key
                        some = np.flatnonzero(links)
                        if len(some):
                            yield pa.RecordBatch.from_arrays([pa.array([keys[i] for i in some], pa.binary()), pa.array(links[some]), pa.array([keys[i] for i in label[some]], pa.binary())], names=["key", "links", "star"])

    return run


def link_vectors(vectors: DataFrame, least: float = LEAST, leading: int = LEADING, block_bytes: int = BLOCK_BYTES, fan: int = FAN, leaf: int = LEAF, names: dict[str, str] | None = None) -> DataFrame:
    """All columns of ``vectors`` (vec_id, embedding and more) but embedding, with n_links (other rows linked directly), component_id (least vec_id that links reach) and kept."""
    if not 0 < least < 1:
        raise ValueError("least lies between 0 and 1")
    spark = vectors.sparkSession
    epsilon = math.sqrt(2 - 2 * least)
    own = [c for c in vectors.columns if c != "embedding"]
    aside = {c: f"own_{i}" for i, c in enumerate(own) if c != "vec_id"}
    called = free_names(vectors.drop("embedding"), "n_links", "component_id", "kept") | (names or {})
    keyed = stash(_node_rows(vectors.withColumnsRenamed(aside)), "vector-keys")
    made = keyed.where(F.col("key").isNotNull()).groupBy("key").agg(F.first("vec").alias("vec"), F.count("*").alias("n"), F.min("vec_id").alias("vec_id"))
    full = stash(made, "vector-nodes")
    rows, nodes = stash(keyed.drop("vec"), "vector-rows"), stash(full.drop("vec"), "vector-counts")
    drop_stash(keyed)
    size, dim = full.groupBy(F.octet_length("vec").alias("size")).agg(F.count("*").alias("n")).agg(F.sum(F.col("size") * F.col("n")), F.max(F.struct("n", "size"))["size"]).first()
    size, dim = size or 0, dim or 8
    axes = directions(full, dim // 8, leading, SPACE)
    placed = stash(_placed(full.select("key", "vec", "n"), dim // 8, axes, epsilon, leading), "vector-places")
    drop_stash(full)
    order = ["dim", *[F.col("cells")[i] for i in range(leading)], "key"]
    tasks = -(-size // (8 * block_bytes)) or 1
    blocks = placed.repartitionByRange(tasks, *order).sortWithinPartitions(*order).select("key", "vec", "n", "dim", "at")
    blocks = blocks.mapInArrow(_cut(block_bytes, leading), "dim int, keys binary, vecs binary, counts binary, low array<double>, high array<double>")
    blocks = stash(blocks.withColumn("place", F.monotonically_increasing_id()), "vector-blocks")
    drop_stash(placed)
    part = F.shiftright("place", 33)
    counts = blocks.groupBy(part.alias("part")).agg(F.count("*").alias("m"))
    before = counts.select("part", (F.sum("m").over(Window.orderBy("part")) - F.col("m")).alias("before"))
    boxes = blocks.select("place", "low", "high").join(before, part == F.col("part")).select("place", (F.col("before") + F.col("place").bitwiseAND((1 << 33) - 1)).alias("id"), "low", "high")
    boxes = stash(boxes, "vector-boxes", free=False)
    count = boxes.count()
    panel = max(1, min(PANEL_BLOCKS, -(-count // spark.sparkContext.defaultParallelism)))
    body = blocks.join(F.broadcast(boxes.select("place", "id")), "place").select("id", "dim", "keys", "vecs", "counts")
    sent = dealt(body, boxes.select("id", "low", "high"), epsilon, leading + 2, panel, fan).select("host", "guest", "dim", "keys", "vecs", "counts")
    met = stash(sent.mapInArrow(_link(least, leaf, dim // 8, axes, leading), "key binary, links long, star binary"), "vector-links")
    known = components(met.select(F.col("key").alias("a"), F.col("star").alias("b")))
    total = met.groupBy("key").agg(F.sum("links").alias("links"))
    joined = stash(nodes.join(total, "key", "left").join(known.withColumnRenamed("node", "key"), "key", "left"), "vector-classes")
    named_by = joined.where("root is not null").groupBy("root").agg(F.min("vec_id").alias("least_id"))
    classes = stash(joined.join(named_by, "root", "left").select("key", (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("links"), F.coalesce("least_id", "vec_id").alias("least_id")), "vector-names")
    out = rows.join(classes, "key", "left")
    least_id = F.when(F.col("links").isNull(), F.col("vec_id")).otherwise(F.col("least_id"))
    added = {"n_links": F.coalesce("links", F.lit(0).cast("long")), "component_id": least_id, "kept": F.coalesce(F.col("vec_id") == least_id, F.lit(False))}
    out = out.select(*[F.col(aside.get(c, c)).alias(c) for c in own], *[v.alias(called[c]) for c, v in added.items()])
    for gone in (nodes, blocks, boxes, met, joined, known):
        drop_stash(gone)
    return out


def op11_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link_vectors(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))


SQL = """
with recursive v as (
  select row_number() over () as r, vec_id, embedding::double[] as e from embeddings
), good as (
  select r, vec_id, list_transform(e, lambda x: x / list_max(list_transform(e, lambda y: abs(y)))) as e from v
  where len(e) > 0 and len(list_filter(e, lambda x: x is not null and isfinite(x))) = len(e) and len(list_filter(e, lambda x: x <> 0)) > 0
), link as (
  select a.r as a, b.r as b from good a join good b on a.r <> b.r and len(a.e) = len(b.e) and list_cosine_similarity(a.e, b.e) >= 0.9
), reach as (
  select r as a, r as b from v union select reach.a, link.b from reach join link on reach.b = link.a
), best as (
  select a, min(vec_id) as component_id from reach join v on v.r = reach.b group by a
), many as (
  select a, count(*) as n from link group by a
)
select vec_id, coalesce(n, 0)::bigint as n_links, component_id, coalesce(vec_id = component_id, false) as kept
from v join best on v.r = best.a left join many on v.r = many.a
"""
