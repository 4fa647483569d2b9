"""Balanced k-way partitions of a graph by multilevel contraction, as relations.

A graph is ``vertices`` (v, w) and ``edges`` (a, b, w, and the ends' weights wa, wb), each edge both ways. Heavy edges lead from each
vertex to its best neighbour; the trees of those contract under a bound on their weight, until few are left; those are parted greedily; and
on the way back each level's boundary is refined under a bound on the parts' weights. A level reads the edges a few times, and
trees make it several times smaller, so levels are few. Only the coarsest graph, whose size a parameter
bounds, meets the driver. What a vertex is tied to by part (``ties``: v, p, c) is kept up to date from the moved vertices
alone, and with it the edge cut and each part's ghosts and exports.
"""

from __future__ import annotations

from collections import defaultdict
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..storage import drop_stash, stash

#: Vertices a part at which contraction ends, and weight of a part over the mean.
COARSE, BALANCE = 128, 1.03
#: Rounds of refinement of a level, and classes by hash that moves of one gain are accepted in.
ROUNDS, CLASSES = 2, 64
#: Share of the cut that a round must save, else it and the next such one are a level's last.
WORTH = 0.01
#: Turns at most in which parts that are too heavy give their surplus.
EVEN = 8
#: Share of the vertices that a level may leave, near the end of contraction.
SLOW = 0.9
#: Doublings of the way to a best pair, and vertices of a tree that one deal clusters.
HOPS, TREE = 3, 1024
#: Vertices up to which their parts or names are broadcast to the edges.
BROADCAST_ROWS = 1_000_000


def _small(df: DataFrame, n: int) -> DataFrame:
    return F.broadcast(df) if n <= BROADCAST_ROWS else df


def _summed(edges: DataFrame) -> DataFrame:
    """Edges (a < b, w and the ends' weights wa, wb) summed, each both ways; those of one a lie together, so what is grouped by a later is grouped where it lies."""
    here, there = F.struct("a", "b", "w", "wa", "wb"), F.struct(F.col("b").alias("a"), F.col("a").alias("b"), "w", F.col("wb").alias("wa"), F.col("wa").alias("wb"))
    both = edges.select(F.inline(F.array(here, there))).repartition("a")
    return both.groupBy("a", "b").agg(F.sum("w").alias("w"), F.first("wa").alias("wa"), F.first("wb").alias("wb"))


def graph(coo: DataFrame, rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """vertices and edges of a matrix's pattern: self loops and columns that are no rows drop out, either triangle will do."""
    one = F.lit(1).cast("long")
    vertices = stash(rows.select(F.col("i").alias("v")).distinct().withColumn("w", one), "graph-vertices", free=False)
    known = _small(vertices.select("v"), vertices.count())
    half = coo.where("i <> j").select(F.least("i", "j").alias("a"), F.greatest("i", "j").alias("b")).repartition("a").distinct()
    inside = half.join(known.withColumnRenamed("v", "a"), "a", "left_semi").join(known.withColumnRenamed("v", "b"), "b", "left_semi")
    both = inside.select(F.inline(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b"))))).repartition("a")
    return vertices, stash(both.withColumns({"w": one, "wa": one, "wb": one}), "graph-edges", free=False)


def proposals(edges: DataFrame, most: int, seed: int) -> DataFrame:
    """a, b: each vertex's best neighbour: most edge weight for both ends' own, then a hash that both ends share. No two exceed ``most``."""
    able = edges.where(F.col("wa") + F.col("wb") <= most)
    rating = F.struct((F.col("w") / (F.col("wa") * F.col("wb"))).alias("r"), F.xxhash64(F.least("a", "b"), F.greatest("a", "b"), F.lit(seed)).alias("h"), "b")
    return able.groupBy("a").agg(F.max(rating)["b"].alias("b"))


def clusters(vertices: DataFrame, best: DataFrame, most: int) -> DataFrame:
    """v, coarse, cw: the least vertex and the weight of each vertex's cluster, none of them above ``most``.

    Best neighbours lead from vertex to vertex to two that are each other's best. The vertices on the way to such a pair, up to
    ``2 ** HOPS`` steps off, are its tree; those without neighbour are one. A tree of more than ``TREE`` vertices is dealt by hash, and each
    is cut into clusters by running weight, the pair first; a vertex across a cut stays alone.
    """
    back = best.select(F.col("b").alias("a"), F.col("a").alias("b"), F.lit(True).alias("mutual"))
    to = best.join(back, ["a", "b"], "left").select(F.col("a").alias("v"), F.when(F.col("mutual"), F.least("a", "b")).otherwise(F.col("b")).alias("r"), F.coalesce("mutual", F.lit(False)).alias("pair"))
    to = stash(to, "graph-best", free=False)
    for _ in range(HOPS):
        step = to.select(F.col("v").alias("r"), F.col("r").alias("far"))
        to = to.join(step, "r").select("v", F.col("far").alias("r"), "pair")
    trees = stash(vertices.join(to, "v", "left"), "graph-trees", free=False)
    sizes = trees.groupBy("r").agg(F.count("*").alias("n"))
    dealt = trees.join(sizes.withColumnRenamed("r", "r2"), F.col("r").eqNullSafe(F.col("r2"))).withColumn("deal", F.when(F.col("pair"), 0).otherwise(F.pmod(F.xxhash64("v"), F.ceil(F.col("n") / TREE))))
    total = F.sum("w").over(Window.partitionBy("r", "deal").orderBy(F.coalesce("pair", F.lit(False)).desc(), "w", "v").rowsBetween(Window.unboundedPreceding, 0))
    cut = dealt.withColumn("total", total).withColumn("k", F.floor((F.col("total") - F.col("w")) / most))
    cut = cut.withColumn("alone", F.when(F.col("total") > (F.col("k") + 1) * most, F.col("v")))
    one = Window.partitionBy("r", "deal", "k", "alone")
    return cut.select("v", F.min("v").over(one).alias("coarse"), F.sum("w").over(one).alias("cw"))


def contracted(vertices: DataFrame, edges: DataFrame, most: int, seed: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The next coarser vertices and edges, and v, coarse of each vertex. The edges are read twice: for proposals, and to be contracted."""
    best = stash(proposals(edges, most, seed), "graph-proposals", free=False)
    names = stash(clusters(vertices, best, most), "graph-names", free=False)
    n = names.count()
    end = lambda c: _small(names.select(F.col("v").alias(c), F.col("coarse").alias(f"coarse_{c}"), F.col("cw").alias(f"w_{c}")), n)
    joined = edges.where("a < b").select("a", "b", "w").join(end("a"), "a").join(end("b"), "b").where("coarse_a <> coarse_b")
    turned = F.col("coarse_a") > F.col("coarse_b")
    a, b = (F.struct(F.col(f"coarse_{c}").alias("v"), F.col(f"w_{c}").alias("w")) for c in "ab")
    low, high = F.when(turned, b).otherwise(a), F.when(turned, a).otherwise(b)
    half = joined.select(low["v"].alias("a"), high["v"].alias("b"), "w", low["w"].alias("wa"), high["w"].alias("wb"))
    heavier = names.select(F.col("coarse").alias("v"), F.col("cw").alias("w")).distinct()
    return stash(heavier, "graph-vertices", free=False), stash(_summed(half), "graph-edges", free=False), names.select("v", "coarse")


def grown(weights: dict[int, int], edges: dict[int, dict[int, int]], size: int) -> dict[int, int]:
    """Part of each vertex of a small graph: one part after the other takes the vertex that it is tied to most, up to its share."""
    part: dict[int, int] = {}
    left = sum(weights.values())
    for p in range(size - 1):
        share, held, ties = left / (size - p), 0, defaultdict(int)
        free = sorted(set(weights) - set(part), key=lambda v: (-weights[v], v))
        while held < share and len(part) < len(weights):
            # at least one vertex stays for each part to come
            if held and len(weights) - len(part) <= size - 1 - p:
                break
            fits = [v for v in ties if held + weights[v] <= share * BALANCE] or [v for v in free if v not in part and held + weights[v] <= share * BALANCE]
            if not fits and held:
                break
            v = max(fits or [v for v in free if v not in part], key=lambda v: (ties.get(v, 0), weights[v], -v))
            part[v] = p
            held += weights[v]
            ties.pop(v, None)
            for u, w in edges.get(v, {}).items():
                if u not in part:
                    ties[u] += w
        left -= held
    return {v: part.get(v, size - 1) for v in weights}


@dataclass
class Counts:
    """What the present parts cost: cut edges, and each part's weight, ghosts (other parts' vertices tied to it) and exports (its vertices, once for each part tied to them)."""

    cut: int = 0
    weight: dict[int, int] = field(default_factory=dict)
    ghosts: dict[int, int] = field(default_factory=dict)
    exports: dict[int, int] = field(default_factory=dict)

    def add(self, other: Counts, sign: int) -> Counts:
        total = lambda x, y: {p: n for p in {**x, **y} if (n := x.get(p, 0) + sign * y.get(p, 0))}
        return Counts(self.cut + sign * other.cut, total(self.weight, other.weight), total(self.ghosts, other.ghosts), total(self.exports, other.exports))


def ties_of(edges: DataFrame, parts: DataFrame) -> DataFrame:
    """v, p, c: edge weight of each vertex to each part that it is tied to."""
    known = _small(parts.select(F.col("v").alias("b"), F.col("part").alias("p")), parts.count())
    return edges.select("a", "b", "w").join(known, "b").groupBy(F.col("a").alias("v"), "p").agg(F.sum("w").alias("c"))


def counted(ties: DataFrame, parts: DataFrame) -> Counts:
    """Counts over all vertices of ``parts`` (v, w, part), each cut edge half at either end."""
    rows = parts.join(ties.groupBy("v").agg(F.collect_list(F.struct("p", "c")).alias("t")), "v", "left")
    away = F.filter(F.coalesce("t", F.array().cast(rows.schema["t"].dataType)), lambda x: x["p"] != F.col("part"))
    own = F.struct("part", "w", F.size(away).alias("exports"), F.aggregate(away, F.lit(0).cast("long"), lambda s, x: s + x["c"]).alias("cut"), F.lit(0).alias("ghosts"))
    theirs = F.transform(away, lambda x: F.struct(x["p"].alias("part"), F.lit(0).cast("long").alias("w"), F.lit(0).alias("exports"), F.lit(0).cast("long").alias("cut"), F.lit(1).alias("ghosts")))
    sums = rows.select(F.explode(F.concat(F.array(own), theirs)).alias("r")).groupBy("r.part").agg(*[F.sum(f"r.{c}").alias(c) for c in ("w", "exports", "cut", "ghosts")]).collect()
    by = lambda c: {r["part"]: r[c] for r in sums if r[c]}
    return Counts(sum(r["cut"] for r in sums), by("w"), by("ghosts"), by("exports"))


def _accepted(moves: DataFrame, counts: Counts, low: int, high: int, size: int) -> DataFrame:
    """Of ``moves`` (v, w, part, to, gain), those that keep every part within its bounds, greatest gains first.

    Weights are summed by gain and hash class first, so that what is put in order has a row for each class.
    """
    spark = moves.sparkSession
    room = spark.createDataFrame([(p, max(0, high - counts.weight.get(p, 0)), max(0, counts.weight.get(p, 0) - low)) for p in range(size)], "p int, room long, spare long")
    classed = moves.withColumn("class", F.struct(-F.col("gain"), F.pmod(F.xxhash64("v"), F.lit(CLASSES))))
    out = classed
    for side, bound in (("to", "room"), ("part", "spare")):
        sums = classed.groupBy(side, "class").agg(F.sum("w").alias("n"))
        total = F.sum("n").over(Window.partitionBy(side).orderBy("class").rowsBetween(Window.unboundedPreceding, 0))
        fits = sums.withColumn("total", total).join(room.select(F.col("p").alias(side), bound), side).where(F.col("total") <= F.col(bound)).select(side, "class")
        out = out.join(fits, [side, "class"], "left_semi")
    return out.select("v", "w", "part", "to", "gain")


def moved_ties(ties: DataFrame, edges: DataFrame, moved: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``ties`` after the moves (v, part, to), and the vertices whose ties or part change; only edges of moved vertices are read."""
    ends = _small(moved.select(F.col("v").alias("b"), "part", "to"), moved.count())
    step = edges.select("a", "b", "w").join(ends, "b").select(F.col("a").alias("v"), "w", F.col("part"), F.col("to"))
    change = step.select("v", F.explode(F.array(F.struct(F.col("part").alias("p"), (-F.col("w")).alias("c")), F.struct(F.col("to").alias("p"), F.col("w").alias("c")))).alias("x")).select("v", "x.p", "x.c")
    change = stash(change.groupBy("v", "p").agg(F.sum("c").alias("c")).where("c <> 0"), "graph-change", free=False)
    new = ties.unionByName(change).groupBy("v", "p").agg(F.sum("c").alias("c")).where("c <> 0")
    return stash(new, "graph-ties", free=False), change.select("v").unionByName(moved.select("v")).distinct()


def refined(parts: DataFrame, edges: DataFrame, size: int, low: int, high: int, rounds: int = ROUNDS, watch=None) -> tuple[DataFrame, Counts]:
    """``parts`` (v, w, part) after moves of boundary vertices, each round in one direction of part numbers, and their counts.

    A round that cuts more, without mending a part's weight, is taken back. ``watch`` is called with parts, ties and counts after each round.
    """
    ties = stash(ties_of(edges, parts), "graph-ties", free=False)
    counts = counted(ties, parts)
    idle = 0
    for k in range(2 * rounds):
        heavy = [p for p in range(size) if counts.weight.get(p, 0) > high]
        tied = ties.join(parts, "v")
        up = F.col("p") > F.col("part") if k % 2 == 0 else F.col("p") < F.col("part")
        best = tied.groupBy("v", "w", "part").agg(F.max(F.when(F.col("p") == F.col("part"), F.col("c"))).alias("own"), F.max(F.when(up, F.struct("c", F.col("p").alias("to")))).alias("best")).where("best is not null")
        moves = best.select("v", "w", "part", F.col("best.to").alias("to"), (F.col("best.c") - F.coalesce("own", F.lit(0))).alias("gain"))
        moves = moves.where((F.col("gain") > 0) | F.col("part").isin(heavy) if heavy else F.col("gain") > 0)
        moved = stash(_accepted(stash(moves, "graph-moves", free=False), counts, low, high, size), "graph-moved", free=False)
        if not moved.limit(1).count():
            idle += 1
            if idle == 2:
                break
            continue
        new_ties, touched = moved_ties(ties, edges, moved)
        new_parts = stash(parts.join(moved.select("v", "to"), "v", "left").select("v", "w", F.coalesce("to", "part").alias("part")), "graph-parts", free=False)
        touched = stash(touched, "graph-touched", free=False)
        of = lambda t, p: counted(t.join(touched, "v", "left_semi"), p.join(touched, "v", "left_semi"))  # noqa: E731, B023
        new = counts.add(of(ties, parts), -1).add(of(new_ties, new_parts), 1)
        if new.cut >= counts.cut and not heavy:
            drop_stash(new_ties)
            drop_stash(new_parts)
            idle += 1
            if idle == 2:
                break
            continue
        drop_stash(ties)
        idle = idle + 1 if new.cut > (1 - WORTH) * counts.cut and not heavy else 0
        parts, ties, counts = new_parts, new_ties, new
        if watch:
            watch(parts, ties, counts)
        if idle >= 2:
            break
    drop_stash(ties)
    return parts, Counts(counts.cut // 2, counts.weight, counts.ghosts, counts.exports)


def evened(parts: DataFrame, edges: DataFrame, counts: Counts, size: int, high: int) -> tuple[DataFrame, Counts]:
    """``parts`` after parts above ``high`` gave their surplus to those with room, tied to them or not (moves along edges alone can't reach these), greatest gains first."""
    spark = parts.sparkSession
    for _ in range(EVEN):
        surplus = [(p, n - high) for p, n in counts.weight.items() if n > high]
        room = [(p, high - counts.weight.get(p, 0)) for p in range(size) if counts.weight.get(p, 0) < high]
        if not surplus or not room:
            break
        given, free = spark.createDataFrame(surplus, "part int, surplus long"), spark.createDataFrame(room, "to int, room long")
        ties = stash(ties_of(edges, parts), "graph-ties", free=False)
        tied = lambda c, n: ties.select("v", F.col("p").alias(c), F.col("c").alias(n))  # noqa: E731, B023
        each = parts.join(F.broadcast(given), "part").join(tied("part", "own"), ["v", "part"], "left").crossJoin(F.broadcast(free)).join(tied("to", "there"), ["v", "to"], "left")
        gain = F.coalesce("there", F.lit(0)) - F.coalesce("own", F.lit(0))
        moves = each.groupBy("v", "w", "part", "surplus").agg(F.max(F.struct(gain.alias("gain"), F.xxhash64("v", "to").alias("h"), "to", "room")).alias("m"))
        moves = stash(moves.select("v", "w", "part", "surplus", "m.to", "m.room", F.struct(-F.col("m.gain"), F.pmod(F.xxhash64("v"), F.lit(4 * CLASSES))).alias("class")), "graph-moves", free=False)
        for side, bound, fits in (("part", "surplus", "total - n < surplus"), ("to", "room", "total <= room")):
            sums = moves.groupBy(side, bound, "class").agg(F.sum("w").alias("n"))
            total = F.sum("n").over(Window.partitionBy(side).orderBy("class").rowsBetween(Window.unboundedPreceding, 0))
            moves = moves.join(sums.withColumn("total", total).where(fits).select(side, "class"), [side, "class"], "left_semi")
        parts = stash(parts.join(moves.select("v", "to"), "v", "left").select("v", "w", F.coalesce("to", "part").alias("part")), "graph-parts", free=False)
        drop_stash(ties)
        before, counts = counts, counted(stash(ties_of(edges, parts), "graph-ties", free=False), parts)
        counts.cut //= 2
        if counts.weight == before.weight:
            break
    return parts, counts


def _bounds(vertices: DataFrame, low: int, high: int) -> tuple[int, int]:
    """Bounds of a level: coarse vertices could not move within those of the finest one."""
    slack = (vertices.agg(F.max("w")).first()[0] or 1) - 1
    return low - slack, high + slack


def kway(coo: DataFrame, rows: DataFrame, size: int, balance: float = BALANCE, coarse: int = COARSE, rounds: int = ROUNDS, watch=None) -> tuple[DataFrame, Counts]:
    """i, rank of every row, and what the parts cost: at most ``balance`` times the mean weight each, and none empty if there are rows enough."""
    if size < 1:
        raise ValueError("size is positive")
    vertices, edges = graph(coo, rows)
    total = vertices.count()
    high = max(-(-total // size), int(balance * total / size))
    low = max(min(1, total // size), 2 * total // size - high)
    levels: list[tuple[DataFrame, DataFrame, DataFrame]] = []
    left = total
    most = max(2, min(3 * total // (2 * coarse * size), total // (8 * size)))
    while left > coarse * size:
        fewer, lighter, names = contracted(vertices, edges, most, len(levels))
        if (now := fewer.count()) == left or (left < 2 * coarse * size and now > SLOW * left):
            break  # most two are too heavy together, so few are left
        left = now
        levels.append((vertices, edges, names))
        vertices, edges = fewer, lighter
    near: dict[int, dict[int, int]] = defaultdict(dict)
    for a, b, w in edges.select("a", "b", "w").collect():
        near[a][b] = w
    part = grown(dict(map(tuple, vertices.select("v", "w").collect())), near, size)
    spark = coo.sparkSession
    parts = vertices.join(spark.createDataFrame([(int(v), p) for v, p in part.items()], f"v {vertices.schema['v'].dataType.simpleString()}, part int"), "v").select("v", "w", "part")
    parts, counts = refined(stash(parts, "graph-parts", free=False), edges, size, *_bounds(vertices, low, high), rounds, watch)
    for finer, between, names in reversed(levels):
        known = names.join(parts.select(F.col("v").alias("coarse"), "part"), "coarse")
        parts = stash(finer.join(known.select("v", "part"), "v").select("v", "w", "part"), "graph-parts", free=False)
        parts, counts = refined(parts, between, size, *_bounds(finer, low, high), rounds, watch)
        edges = between
    parts, counts = evened(parts, edges, counts, size, high)
    return parts.select(F.col("v").alias("i"), F.col("part").alias("rank")), counts
