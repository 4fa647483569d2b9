"""Near-duplicate classes by ProbMinHash, banding and verification.

Two texts are linked if the probability Jaccard similarity of their five-word shingles is 0.8 or more;
a class is a connected component of links, exact copies included. ``weight='count'`` weighs a shingle
by how often it stands in its text, for candidates and for verification alike. With equal weights, which
the query takes, that similarity is the Jaccard similarity of the sets of shingles.

1. One pass over the texts: signature, a byte a component as a sketch, and band hashes. Texts with the
   same bytes are one node from here on.
2. Nodes alone in all their bands are classes of their own. The others, some per cent, go on.
3. Each node is verified against the most central node of one of its bands (that with the greatest
   sum of band sizes, of those the best estimate). Verified links make components.
4. Nodes that share a band but no component are compared tile by tile by their sketches, each pair in its
   first common band only; pairs that can reach the threshold are verified against their texts,
   in large bands within the tile, which returns links alone. So no pair inside a component is ever
   made, no task holds more than two tiles, and a band of any size is many small tasks.

Hashes of shingles only propose: a pair that they put at the threshold is a link if its words do so too.

Cases: null and empty texts are copies of one another, and texts without words link to exact copies only;
a text of fewer than five words is one shingle; null doc_id: the class is named by the least doc_id
that is not null; rows with the same doc_id are documents of their own; an empty table gives no rows;
columns besides doc_id and text are passed on or ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import _kernels as K
from . import _probmin as P
from ._common import drop_stash, free_name, likely_in, small_batches, stash, table, text_key
from .graph import components

LEAST = 0.8
COMPONENTS, BAND_ROWS = 96, 4
#: Matching sketch components below which a pair at LEAST falls with probability 3e-6, as with the bands.
LEAST_MATCHES = 58
#: Nodes of a tile, and of a band whose pairs are verified by joins; larger bands take their shingles along and verify in their tiles.
TILE, SMALL_BAND = 256, 24


def signature_rows(docs: DataFrame, m: int = COMPONENTS, r: int = BAND_ROWS, weight: str = "one") -> DataFrame:
    """doc_id, key, sketch (binary, m bytes), bands (array of long; empty without shingles) of each text."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = np.arange(m // r, dtype=np.uint64)
        for batch in batches:
            texts = K.as_bytes(batch.column("text"))
            sketches: list[bytes] = []
            bands: list[np.ndarray | list] = []
            for a, b in K.blocks(texts):
                owner, code, count = P.shingles(texts[a:b])
                some = np.bincount(owner, minlength=b - a) > 0
                sig = P.signatures(b - a, owner, code, count.astype(float) if weight == "count" else np.ones(len(code)), m)
                h = np.zeros((b - a, m // r), np.uint64)
                for i in range(r):
                    h = K.mix(h + sig[:, i::r] + number)
                sketches += [x.tobytes() for x in sig.astype(np.uint8)]
                bands += [x if ok else [] for x, ok in zip(h.astype(np.int64), some, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("key"), pa.array(sketches, pa.binary()), pa.array(bands, pa.list_(pa.int64()))], names=["doc_id", "key", "sketch", "bands"])

    small_batches(docs.sparkSession)
    return docs.select("doc_id", text_key(F.col("text")).alias("key"), "text").mapInArrow(run, f"doc_id {kind}, key binary, sketch binary, bands array<long>")


class _Judge:
    """Whether texts of a batch are similar: by the hashes of their shingles, then by their words."""

    def __init__(self, texts: list[bytes], least: float, weight: str) -> None:
        self.texts, self.least, self.counted = texts, least, weight == "count"
        self.sides: list[tuple[np.ndarray, np.ndarray]] = []
        for a, b in K.blocks(texts):
            owner, code, count = P.shingles(texts[a:b])
            cut = np.searchsorted(owner, np.arange(b - a + 1))
            weights = count.astype(float) if self.counted else np.ones(len(code))
            self.sides += [(code[s:e], weights[s:e]) for s, e in zip(cut, cut[1:], strict=False)]

    def similar(self, i: int, j: int) -> bool:
        return P.probability_jaccard(*self.sides[i], *self.sides[j]) >= self.least and P.exact_similarity(self.texts[i], self.texts[j], self.counted) >= self.least


def _verified(pairs: DataFrame, texts: DataFrame, least: float, weight: str) -> DataFrame:
    """The pairs (a, b) whose texts reach the similarity."""
    with_a = pairs.join(texts.select(F.col("key").alias("a"), F.col("text").alias("text_a")), "a")
    with_b = with_a.join(texts.select(F.col("key").alias("b"), F.col("text").alias("text_b")), "b").select("a", "b", "text_a", "text_b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sides = [K.as_bytes(batch.column(i)) for i in (2, 3)]
            number: dict[bytes, int] = {}
            left, right = ([number.setdefault(t, len(number)) for t in side] for side in sides)
            judge = _Judge(list(number), least, weight)
            ok = [judge.similar(i, j) for i, j in zip(left, right, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(ok, pa.bool_()))

    return with_b.mapInArrow(run, "a binary, b binary")


def _spread(members: DataFrame) -> DataFrame:
    """``members`` (band, root, key and more) once for each pair of tiles (low, high) of its band, with its own tile.

    A band's largest component needs no pairs of its own: its tiles (below 0) meet only those of the
    band's other nodes, which meet one another too.
    """
    parts = members.groupBy("band", "root").agg(F.count("*").alias("n"))
    main = parts.groupBy("band").agg(F.max(F.struct("n", "root")).alias("m"), F.sum("n").alias("all"))
    main = main.select("band", F.col("m.root").alias("main"), F.ceil(F.col("m.n") / TILE).cast("int").alias("main_tiles"), F.ceil((F.col("all") - F.col("m.n")) / TILE).cast("int").alias("tiles"))
    main = stash(main, "near-mains")
    sized = members.join(main, "band").withColumn("is_main", F.col("root") == F.col("main"))
    number = F.pmod(F.xxhash64("key"), F.when(F.col("is_main"), F.col("main_tiles")).otherwise(F.col("tiles"))).cast("int")
    sized = sized.withColumn("tile", F.when(F.col("is_main"), -1 - number).otherwise(number))
    others = F.sequence(F.lit(0), F.col("tiles") - 1)
    mains = F.transform(F.sequence(F.lit(1), F.col("main_tiles")), lambda i: -i)
    spread = sized.withColumn("other", F.explode(F.when(F.col("is_main"), others).otherwise(F.concat(others, mains))))
    return spread.select(*members.columns, F.least("tile", "other").alias("low"), F.greatest("tile", "other").alias("high"), "tile")


def _tile_pairs(members: DataFrame, matches: int, least: float | None, weight: str) -> DataFrame:
    """Pairs (a, b) of ``members`` (band, key, sketch, root, bands) that share the band first, differ in root and whose sketches match.

    With ``least``, members also have their text, and of the pairs the tile verifies, the likeliest
    first, only links that join components: fewer than the tile has nodes.
    """

    def run(group: pa.Table) -> pa.Table:
        band = group.column("band")[0].as_py()
        tile = group.column("tile").to_numpy()
        low, high = group.column("low")[0].as_py(), group.column("high")[0].as_py()
        key = group.column("key").to_pylist()
        root = np.unique(np.array(group.column("root").to_pylist(), object), return_inverse=True)[1]
        sketch = np.frombuffer(b"".join(group.column("sketch").to_pylist()), np.uint8).reshape(len(key), -1)
        bands = np.array(group.column("bands").to_pylist(), np.int64)
        left, right = np.flatnonzero(tile == low), np.flatnonzero(tile == high)
        first, second, score = [], [], []
        for i in left:
            to = right[(root[right] != root[i]) & ((right > i) if low == high else True)]
            same = (sketch[to] == sketch[i]).sum(1)
            to, same = to[same >= matches], same[same >= matches]
            if len(to):
                mine = bands[i][(bands[to] == bands[i]).argmax(1)] == band
                first.append(np.full(int(mine.sum()), i))
                second.append(to[mine])
                score.append(same[mine])
        none = np.zeros(0, np.int64)
        first, second, score = (np.concatenate([*x, none]).astype(np.int64) for x in (first, second, score))
        if least is not None:
            used = np.zeros(len(key), bool)
            used[first] = used[second] = True
            judge = _Judge([t if u else b"" for t, u in zip(K.as_bytes(group.column("text")), used, strict=True)], least, weight)
            keep = []
            for p in np.argsort(-score, kind="stable"):
                i, j = first[p], second[p]
                if root[i] != root[j] and judge.similar(i, j):
                    keep.append(p)
                    root[root == root[j]] = root[i]
            first, second = first[keep], second[keep]
        return pa.table({"a": pa.array([key[i] for i in first], pa.binary()), "b": pa.array([key[j] for j in second], pa.binary())})

    # a group's work grows with the square of its bytes, so partitions are not merged by size
    tasks = int(members.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return _spread(members).repartition(tasks, "band", "low", "high").groupBy("band", "low", "high").applyInArrow(run, "a binary, b binary")


def near_classes(docs: DataFrame, least: float = LEAST, m: int = COMPONENTS, r: int = BAND_ROWS, matches: int = LEAST_MATCHES, weight: str = "one") -> tuple[DataFrame, DataFrame]:
    """(doc_id, key) of every row of ``docs``, and (key, root) of the texts that are linked to another text."""
    rows = stash(signature_rows(docs, m, r, weight), "near-signatures")
    nodes = rows.groupBy("key").agg(F.first("sketch").alias("sketch"), F.first("bands").alias("bands"))
    spread = rows.select("key", F.explode("bands").alias("band")).distinct()
    sizes = spread.groupBy("band").agg(F.count("*").alias("n")).where("n > 1")
    shared = stash(spread.join(sizes, "band"), "near-bands")
    central = shared.groupBy("key").agg(F.sum("n").alias("weight"))
    several = stash(nodes.join(central, "key"), "near-nodes")

    # texts without a partner and copies go before the shuffle, so that a text of very many is a row a task
    texts = likely_in(docs.select(text_key(F.col("text")).alias("key"), "text"), ["key"], several).groupBy("key").agg(F.first("text").alias("text"))
    texts = stash(texts.join(several.select("key"), "key", "left_semi"), "near-texts")

    weighed = shared.join(several.select("key", "weight"), "key")
    # written, so that Spark can split what a very large band is joined with
    centres = stash(weighed.groupBy("band").agg(F.max(F.struct("weight", "key"))["key"].alias("centre")), "near-centres")
    # of a node's centres the one that most of its bands share
    votes = shared.join(centres, "band").where("key <> centre").groupBy("key", "centre").agg(F.count("*").alias("votes"))
    stars = votes.groupBy("key").agg(F.max(F.struct("votes", "centre"))["centre"].alias("b")).select(F.col("key").alias("a"), "b")
    links = stash(_verified(stars, texts, least, weight), "near-stars")

    known = components(links)
    members = shared.select("band", "key").join(several.select("key", "sketch", "bands"), "key").join(known.withColumnRenamed("node", "key"), "key", "left").withColumn("root", F.coalesce("root", "key"))
    open_bands = members.groupBy("band").agg((F.min("root") != F.max("root")).alias("open"), F.count("*").alias("members")).where("open").select("band", "members")
    open_bands = stash(open_bands, "near-open")
    members = stash(members.join(open_bands, "band"), "near-members")
    few, many = members.where(F.col("members") <= SMALL_BAND).drop("members"), members.where(F.col("members") > SMALL_BAND).drop("members")
    pairs = stash(_tile_pairs(few, matches, None, weight).distinct(), "near-pairs")
    more = _verified(pairs, texts, least, weight).unionByName(_tile_pairs(many.join(texts, "key"), matches, least, weight))
    classes = components(links.unionByName(more).select("a", "b")).withColumnRenamed("node", "key")
    for made in (shared, several, texts, centres, links, known, open_bands, members, pairs):
        drop_stash(made)
    return rows.select("doc_id", "key"), classes


def with_class(ids: DataFrame, classes: DataFrame) -> DataFrame:
    """ids (doc_id, key) with root: what all rows of a class share."""
    return ids.join(classes, "key", "left").withColumn("root", F.coalesce("root", "key"))


def keep_one(docs: DataFrame) -> DataFrame:
    """One row of ``docs`` for each class, all columns: that with the least doc_id (null last), then the least text hash, then the least row hash."""
    ids, classes = near_classes(docs)
    best = with_class(ids, classes).groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "key")).alias("best"))
    key, flag = free_name(docs, "key_"), free_name(docs, "id_")
    chosen = best.select(F.col("best.key").alias(key), F.col("best.doc_id").alias(flag)).distinct()
    keyed = docs.withColumn(key, text_key(F.col("text")))
    own = [F.col(f"`{c}`") for c in docs.columns]
    kept = keyed.join(chosen, key).where(F.col("doc_id").eqNullSafe(F.col(flag)))
    # rows that agree in doc_id and text may differ elsewhere
    row = F.min_by(F.struct(*own), F.xxhash64(F.to_json(F.struct(*[c for c, n in zip(own, docs.columns, strict=True) if n != "text"]))))
    return kept.groupBy(key).agg(row.alias(flag)).select(f"{flag}.*")


def op6_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids, classes = near_classes(table(spark, sf_dir, "documents").select("doc_id", "text"))
    rooted = stash(with_class(ids, classes).select("doc_id", "root"), "near-roots")
    named = stash(rooted.groupBy("root").agg(F.min("doc_id").alias("class_id")), "near-names")
    return rooted.join(named, "root").select("doc_id", "class_id")
