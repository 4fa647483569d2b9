"""Products over a stored partition: blocks of a matrix stay where they are, and only packed ghost values move.

A block is one row: the entries of one rank by local index, columns beyond its own rows being ghosts, in the order of
peer and column. Blocks, send lists and states are tables bucketed by rank, so joins of them need no exchange; an iteration
shuffles one row for each pair of ranks that share columns, with the values that one needs of the other. A block is
bounded by the number of its entries, so there are as many ranks as the matrix needs.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import block_owner
from ..operators import partition
from ..operators.ranking import with_rank
from ..storage import drop_stash, shared_dir, stash

#: Entries of a block, from which the number of ranks follows where no owner map is given.
BLOCK_ENTRIES = 1 << 21
_STATE = ("x", "r", "s", "t", "w")
_SCHEMA = f"rank int, {', '.join(f'{c} binary' for c in _STATE)}, rho double, delta double"


def _doubles(data: bytes | None) -> np.ndarray:
    return np.frombuffer(data or b"", np.float64)


def _numbers(data: bytes | None) -> np.ndarray:
    return np.frombuffer(data or b"", np.int64)


def _places(data: bytes | None) -> np.ndarray:
    return np.frombuffer(data or b"", np.int32)


class Table:
    """A table bucketed by rank in the shared folder, until it is dropped."""

    def __init__(self, df: DataFrame, label: str, buckets: int, watched: dict | None = None) -> None:
        self.spark, self.name = df.sparkSession, f"{label}_{uuid.uuid4().hex}"
        self.path = f"{shared_dir(self.spark)}/{self.name}"
        seen = Observation() if watched else None
        out = df.observe(seen, *[v.alias(k) for k, v in watched.items()]) if watched else df
        out.write.format("parquet").bucketBy(buckets, "rank").sortBy("rank").option("path", self.path).saveAsTable(self.name)
        self.seen = seen.get if watched else {}

    def read(self) -> DataFrame:
        return self.spark.table(self.name)

    def drop(self) -> None:
        self.spark.sql(f"drop table if exists {self.name}")
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.path)
        path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def _packed(group: pa.Table) -> pa.Table:
    """The values of a rank in the order of i, as one row."""
    by = np.argsort(group.column("i").to_numpy(), kind="stable")
    return pa.table({"rank": pa.array([group.column("rank")[0].as_py()], pa.int32()), "r": pa.array([group.column("r").to_numpy()[by].tobytes()], pa.binary())})


def _block(owned: pa.Table, entries: pa.Table) -> pa.Table:
    """A rank's rows (i), its entries (row, col, v) by local index, and by peer the columns (j) that are its ghosts."""
    rank = owned.column("rank")[0].as_py()
    i = np.sort(owned.column("i").to_numpy())
    row, j, peer = (entries.column(c).to_numpy() for c in ("i", "j", "col_rank"))
    far = peer != rank
    wanted, at, which = np.unique(j[far], return_index=True, return_inverse=True)
    peers = peer[far][at].astype(np.int64)
    by = np.lexsort((wanted, peers))
    place = np.empty(len(by), np.int64)
    place[by] = np.arange(len(by))
    wanted, peers = wanted[by], peers[by]
    col = np.searchsorted(i, j)
    col[far] = len(i) + place[which]
    packed = lambda x: pa.array([np.ascontiguousarray(x).tobytes()], pa.binary())
    imports = [{"peer": int(p), "j": np.ascontiguousarray(wanted[peers == p]).tobytes()} for p in np.unique(peers)]
    kind = pa.list_(pa.struct([("peer", pa.int32()), ("j", pa.binary())]))
    return pa.table({"rank": pa.array([rank], pa.int32()), "i": packed(i), "row": packed(np.searchsorted(i, row).astype(np.int32)), "col": packed(col.astype(np.int32)), "v": packed(entries.column("v").to_numpy()), "imports": pa.array([imports], kind)})


_SENDS = "rank int, to array<int>, sizes array<long>, local binary"


def _send_lists(own: pa.Table, wanted: pa.Table) -> pa.Table:
    """A rank's send lists, as one row: the ranks that want some of its rows, how many each, and their places one after the other."""
    rank, i = own.column("rank")[0].as_py(), _numbers(own.column("i")[0].as_py())
    local = [np.searchsorted(i, _numbers(j)) for j in wanted.column("j").to_pylist()]
    data = np.concatenate([np.zeros(0, np.int64), *local]).astype(np.int64).tobytes()
    return pa.table({"rank": pa.array([rank], pa.int32()), "to": pa.array([wanted.column("to").to_pylist()], pa.list_(pa.int32())), "sizes": pa.array([[len(x) for x in local]], pa.list_(pa.int64())), "local": pa.array([data], pa.binary())})


def _lists(row: dict) -> Iterator[tuple[int, np.ndarray]]:
    """A rank's send lists: to whom, and which places."""
    places = np.split(_numbers(row["local"]), np.cumsum(row["sizes"])[:-1]) if row["sizes"] else []
    yield from zip(row["to"], places, strict=True)


class Layout:
    """A matrix (i, j, v) over its owner map (i, rank), stored by rank. A rank's rows and entries fit a task's memory.

    ``rank_of`` is the map in closed form, where there is one: then no entry is shuffled to find its ranks.
    """

    def __init__(self, coo: DataFrame, owner: DataFrame, buckets: int | None = None, rank_of: Callable[[Column], Column] | None = None) -> None:
        spark: SparkSession = coo.sparkSession
        self.owner = stash(owner.select(F.col("i").cast("long").alias("i"), F.col("rank").cast("int").alias("rank")), "ghost-owner", free=False)
        ranks = self.owner.agg(F.count_distinct("rank")).first()[0]
        self.buckets = buckets or max(1, min(ranks, int(spark.conf.get("spark.sql.shuffle.partitions"))))
        typed = coo.select(F.col("i").cast("long").alias("i"), F.col("j").cast("long").alias("j"), F.col("v").cast("double").alias("v"))
        ranked = typed.select("i", "j", "v", rank_of(F.col("i")).alias("row_rank"), rank_of(F.col("j")).alias("col_rank")) if rank_of else partition.with_owners(typed, self.owner)
        owned = ranked.where("row_rank is not null and col_rank is not null").select(F.col("row_rank").alias("rank"), "i", "j", "v", "col_rank")
        blocks = self.owner.groupBy("rank").cogroup(owned.groupBy("rank")).applyInArrow(_block, "rank int, i binary, row binary, col binary, v binary, imports array<struct<peer: int, j: binary>>")
        self.blocks = Table(blocks, "ghost_blocks", self.buckets)
        wanted = self.blocks.read().select(F.col("rank").alias("to"), F.explode("imports").alias("m")).select(F.col("m.peer").alias("rank"), "to", "m.j")
        lists = self.blocks.read().select("rank", "i").groupBy("rank").cogroup(wanted.groupBy("rank")).applyInArrow(_send_lists, _SENDS)
        self.sends = Table(lists, "ghost_sends", self.buckets)

    def states(self, b: DataFrame) -> Table:
        """The first state: x = 0 and r = b (i, val), before any product."""
        values = self.owner.join(b.select("i", "val"), "i", "left").select("rank", "i", F.coalesce("val", F.lit(0.0)).cast("double").alias("r"))
        none = {c: F.lit(None).cast("binary") for c in _STATE if c != "r"}
        first = values.groupBy("rank").applyInArrow(_packed, "rank int, r binary").withColumns(none)
        return Table(first.select("rank", *_STATE, F.lit(0.0).alias("rho"), F.lit(0.0).alias("delta")), "ghost_state", self.buckets)

    def stepped(self, state: Table, alpha: float, beta: float) -> DataFrame:
        """The next state: s = r + beta s, t = w + beta t, x + alpha s, r - alpha t, and w = A r with the ghosts of r."""

        def moved(c: dict) -> dict:
            r = _doubles(c["r"])
            old = {k: _doubles(c[k]) if c[k] else np.zeros(len(r)) for k in _STATE}
            s, t = r + beta * old["s"], old["w"] + beta * old["t"]
            return {"x": old["x"] + alpha * s, "r": r - alpha * t, "s": s, "t": t}

        def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for row in batch.to_pylist():
                    value = moved(row)["r"]
                    sent = [{"rank": to, "from": row["rank"], "value": value[local].tobytes()} for to, local in _lists(row)]
                    yield pa.RecordBatch.from_pylist(sent, pa.schema([("rank", pa.int32()), ("from", pa.int32()), ("value", pa.binary())]))

        def multiply(own: pa.Table, ghosts: pa.Table) -> pa.Table:
            out = []
            for row in own.to_pylist():
                new = moved(row)
                sent = sorted(ghosts.to_pylist(), key=lambda g: g["from"])
                near = np.concatenate([new["r"], *[_doubles(g["value"]) for g in sent]])
                w = np.bincount(_places(row["row"]), _doubles(row["v"]) * near[_places(row["col"])], len(new["r"])) if row["row"] else np.zeros(len(new["r"]))
                out.append({"rank": row["rank"], **{k: v.tobytes() for k, v in new.items()}, "w": w.tobytes(), "rho": float(new["r"] @ new["r"]), "delta": float(new["r"] @ w)})
            kinds = [("rank", pa.int32()), *[(c, pa.binary()) for c in _STATE], ("rho", pa.float64()), ("delta", pa.float64())]
            return pa.Table.from_pylist(out, pa.schema(kinds))

        now = state.read().select("rank", *_STATE)
        ghosts = self.sends.read().hint("merge").join(now.hint("merge"), "rank").mapInArrow(send, "rank int, from int, value binary")
        own = self.blocks.read().select("rank", "row", "col", "v").hint("merge").join(now, "rank")
        return own.groupBy("rank").cogroup(ghosts.groupBy("rank")).applyInArrow(multiply, _SCHEMA)

    def step(self, state: Table, alpha: float, beta: float) -> tuple[Table, float, float]:
        """The next state, written, with (r, r) and (r, A r), which the write observes."""
        new = Table(self.stepped(state, alpha, beta), "ghost_state", self.buckets, {"rho": F.sum("rho"), "delta": F.sum("delta")})
        return new, new.seen["rho"] or 0.0, new.seen["delta"] or 0.0

    def vector(self, state: Table, column: str = "x") -> DataFrame:
        """i, val of a state's column, written."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for i, value in zip(batch.column("i").to_pylist(), batch.column("value").to_pylist(), strict=True):
                    yield pa.RecordBatch.from_arrays([pa.array(_numbers(i)), pa.array(_doubles(value))], names=["i", "val"])

        rows = self.blocks.read().select("rank", "i").join(state.read().select("rank", F.col(column).alias("value")), "rank")
        return stash(rows.mapInArrow(run, "i long, val double"), "ghost-vector", free=False)

    def product(self, x: DataFrame) -> DataFrame:
        """i, val of A x for x (i, val), by one exchange of ghosts."""
        first = self.states(x)
        state, _, _ = self.step(first, 0.0, 0.0)
        first.drop()
        out = self.vector(state, "w")
        state.drop()
        return out

    def traffic(self, homes: DataFrame) -> DataFrame:
        """rank, to, n: values that go from one rank of an outer map to another, once each, by the send lists of blocks.

        ``homes`` (rank, home) says which outer rank a block is part of; blocks of one such rank may want the same value.
        """

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for row in batch.to_pylist():
                    for to, local in _lists(row):
                        alike = lambda k: pa.array(np.full(len(local), k, np.int32))  # noqa: E731, B023
                        yield pa.RecordBatch.from_arrays([alike(row["rank"]), alike(to), pa.array(local)], names=["block", "other", "local"])

        sent = self.sends.read().mapInArrow(run, "block int, other int, local long")
        home = lambda b, c: homes.select(F.col("rank").alias(b), F.col("home").alias(c))
        sent = sent.join(F.broadcast(home("block", "from")), "block").join(F.broadcast(home("other", "to")), "other").where("`from` <> `to`").select("block", "from", "to", "local")
        return sent.distinct().groupBy(F.col("from").alias("rank"), "to").agg(F.count("*").alias("n"))

    def drop(self) -> None:
        self.blocks.drop()
        self.sends.drop()
        drop_stash(self.owner)


def split_ranks(coo: DataFrame, owner: DataFrame, entries: int | None = None) -> tuple[DataFrame, DataFrame]:
    """An owner map (i, rank) of blocks, and the rank (rank, home) of ``owner`` that each is part of.

    A rank of more than ``entries`` entries (``BLOCK_ENTRIES``) becomes as many blocks of its rows, in order, as these need, so a
    block's memory does not grow with the matrix. One row for each rank meets the driver.
    """
    entries = entries or BLOCK_ENTRIES
    held = stash(owner.select("i", F.col("rank").cast("int").alias("rank")), "ghost-given", free=False)
    sizes = held.join(coo.groupBy("i").agg(F.count("*").alias("n")), "i", "left").groupBy("rank").agg(F.count("*").alias("rows"), F.coalesce(F.sum("n"), F.lit(0)).alias("n")).orderBy("rank").collect()
    plan, first = [], 0
    for r in sizes:
        pieces = max(1, min(r["rows"], -(-r["n"] // entries)))
        plan.append((r["rank"], first, pieces, r["rows"]))
        first += pieces
    spark = coo.sparkSession
    homes = spark.createDataFrame([(f + k, r) for r, f, pieces, _ in plan for k in range(pieces)], "rank int, home int")
    of = spark.createDataFrame(plan, "rank int, _first int, _pieces int, _rows long")
    placed = with_rank(held, "k", [F.col("i").asc()], ["rank"]).join(F.broadcast(of), "rank")
    return placed.select("i", (F.col("_first") + F.floor(F.col("k") * F.col("_pieces") / F.col("_rows"))).cast("int").alias("rank")), homes


def row_layout(coo: DataFrame, rows: DataFrame, nnz: int) -> Layout:
    """The layout by blocks of rows in order; in closed form if the rows are 0 to n - 1."""
    n, least, most = rows.agg(F.count("*"), F.min("i"), F.max("i")).first()
    owner = row_blocks(rows, nnz, BLOCK_ENTRIES)
    if not n or least != 0 or most != n - 1:
        return Layout(coo, owner)
    parts = max(1, min(n, -(-nnz // BLOCK_ENTRIES)))
    return Layout(coo, owner, rank_of=lambda c: F.when(c.between(0, n - 1), block_owner(c, n, parts)))


def row_blocks(rows: DataFrame, nnz: int, entries: int = BLOCK_ENTRIES) -> DataFrame:
    """i, rank of rows in order, in as many equal blocks as ``nnz`` entries need; row numbers may have gaps."""
    n, least, most = rows.agg(F.count("*"), F.min("i"), F.max("i")).first()
    parts = max(1, min(n, -(-nnz // entries)))
    if n and least == 0 and most == n - 1:
        return partition.row_block(rows, n, parts)
    held = stash(rows.select("i"), "ghost-rows", free=False)
    return with_rank(held, "k", [F.col("i").asc()]).select("i", F.floor(F.col("k") * parts / max(n, 1)).cast("int").alias("rank"))
