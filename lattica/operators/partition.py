"""Row partitions of a sparse matrix as relations: owners, interior and halo entries, ghosts, exchanges.

A matrix is ``coo`` (i, j, v), an owner map ``owner`` (i, rank); a matrix may hold an entry twice.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import block_owner
from ..storage import stash
from .multilevel import kway
from .ranking import with_rank
from .windows import exclusive_prefix_sum


def row_ptr(coo: DataFrame, rows: DataFrame) -> DataFrame:
    """i, row_ptr, n of every row: entries before it and its own."""
    counts = rows.select("i").join(coo.groupBy("i").agg(F.count("*").alias("n")), "i", "left").fillna(0, ["n"])
    return exclusive_prefix_sum(counts, "i", "n", "row_ptr")


def to_csr(coo: DataFrame) -> DataFrame:
    """i, cols, vals: each row's entries by column."""
    row = F.array_sort(F.collect_list(F.struct("j", "v")))
    return coo.groupBy("i").agg(row.alias("e")).select("i", F.col("e.j").alias("cols"), F.col("e.v").alias("vals"))


def row_block(rows: DataFrame, n: int, size: int) -> DataFrame:
    return rows.select("i", block_owner(F.col("i"), n, size).alias("rank"))


def with_block_owners(coo: DataFrame, n: int, size: int) -> DataFrame:
    """As ``with_owners`` for row blocks, in closed form: no join, no shuffle."""
    ranked = coo.withColumns({"row_rank": block_owner(F.col("i"), n, size), "col_rank": block_owner(F.col("j"), n, size)})
    return ranked.withColumn("kind", F.when(F.col("row_rank") == F.col("col_rank"), "interior").otherwise("halo"))


def with_owners(coo: DataFrame, owner: DataFrame) -> DataFrame:
    """coo with the ranks of its row and column by a given map, and kind: interior or halo."""
    by_row = owner.select("i", F.col("rank").alias("row_rank"))
    by_col = owner.select(F.col("i").alias("j"), F.col("rank").alias("col_rank"))
    return coo.join(by_row, "i").join(by_col, "j").withColumn("kind", F.when(F.col("row_rank") == F.col("col_rank"), "interior").otherwise("halo"))


def local_index(owner: DataFrame) -> DataFrame:
    """i, rank, local: place among the rank's rows, ascending; a rank of any size is as many tasks as all rows are."""
    return with_rank(stash(owner.select("i", "rank"), "local-rows", free=False), "local", [F.col("i").asc()], ["rank"]).select("i", "rank", "local")


def halo_imports(owned: DataFrame) -> DataFrame:
    """rank, peer, j: remote columns a rank needs, once each. The same rows are peer's exports to rank."""
    return owned.where("kind = 'halo'").select(F.col("row_rank").alias("rank"), F.col("col_rank").alias("peer"), "j").distinct()


def halo_exports(owned: DataFrame) -> DataFrame:
    """rank, peer, j: what a rank sends: the transpose of the imports."""
    return halo_imports(owned).select(F.col("peer").alias("rank"), F.col("rank").alias("peer"), "j")


def ghost_index(imports: DataFrame) -> DataFrame:
    """imports with ghost (place by peer, then column, within the rank) and ghost_offset (its peer's first)."""
    placed = stash(with_rank(stash(imports, "ghost-columns", free=False), "ghost", [F.col("peer").asc(), F.col("j").asc()], ["rank"]), "ghost-places", free=False)
    return placed.join(placed.groupBy("rank", "peer").agg(F.min("ghost").alias("ghost_offset")), ["rank", "peer"])


def local_entries(owned: DataFrame, local: DataFrame, ghosts: DataFrame) -> DataFrame:
    """rank, kind, row (local index), col (local or ghost index), v. A halo entry without ghost is an error.

    Own columns and ghosts are one lookup by rank and column, so entries are dealt by column once.
    """
    rows = local.select("i", F.col("local").alias("row"))
    places = local.select(F.col("rank").alias("row_rank"), F.col("i").alias("j"), F.lit(False).alias("far"), F.col("local").alias("col"))
    places = places.unionByName(ghosts.select(F.col("rank").alias("row_rank"), "j", F.lit(True).alias("far"), F.col("ghost").alias("col")))
    placed = owned.join(rows, "i").select("row_rank", "j", (F.col("kind") == "halo").alias("far"), "row", "v")
    joined = placed.join(places, ["row_rank", "j", "far"], "left").where("far or col is not null")
    col = F.coalesce("col", F.raise_error(F.lit("column without ghost")).cast("long"))
    return joined.select(F.col("row_rank").alias("rank"), F.when(F.col("far"), "halo").otherwise("interior").alias("kind"), "row", col.alias("col"), "v")


def active_halo_rows(owned: DataFrame) -> DataFrame:
    """rank, i of rows that have halo entries."""
    return owned.where("kind = 'halo'").select(F.col("row_rank").alias("rank"), "i").distinct()


def adjacency(coo: DataFrame, n: int) -> DataFrame:
    """i, j: the pattern without self loops and columns out of range, once each."""
    return coo.where((F.col("i") != F.col("j")) & F.col("j").between(0, n - 1)).select("i", "j").distinct()


def pack(exports: DataFrame, local: DataFrame, vec: DataFrame) -> DataFrame:
    """exports with the local index and the value that is sent."""
    values = vec.select(F.col("i").alias("j"), "val")
    places = local.select(F.col("i").alias("j"), "local")
    return exports.join(places, "j").join(values, "j").select("rank", "peer", "j", "local", "val")


def stats(owner: DataFrame, owned: DataFrame) -> DataFrame:
    """rank, local_rows, local_nnz, interior_nnz, halo_nnz, ghosts, imports (columns received, as ghosts), exports (columns sent).

    The entries are read once: those of a halo column count together, and so do a rank's interior ones; all that
    follows has a row for each pair of ranks.
    """
    rows = owner.groupBy("rank").agg(F.count("*").alias("local_rows"))
    far = F.col("kind") == "halo"
    columns = owned.groupBy(F.col("row_rank").alias("rank"), F.when(far, F.col("col_rank")).alias("peer"), F.when(far, F.col("j")).alias("j")).agg(F.count("*").alias("n"))
    by_pair = columns.groupBy("rank", "peer").agg(F.sum("n").alias("n"), F.count("*").alias("columns"))
    near, zero = F.col("peer").isNull(), F.lit(0).cast("long")
    own = F.struct("rank", F.col("n").alias("local_nnz"), F.when(near, F.col("n")).otherwise(zero).alias("interior_nnz"), F.when(near, zero).otherwise(F.col("n")).alias("halo_nnz"), F.when(near, zero).otherwise(F.col("columns")).alias("ghosts"), zero.alias("exports"))
    sent = F.struct(F.col("peer").alias("rank"), *[zero.alias(c) for c in ("local_nnz", "interior_nnz", "halo_nnz", "ghosts")], F.col("columns").alias("exports"))
    sums = by_pair.select(F.inline(F.when(near, F.array(own)).otherwise(F.array(own, sent)))).groupBy("rank").agg(*[F.sum(c).alias(c) for c in ("local_nnz", "interior_nnz", "halo_nnz", "ghosts", "exports")])
    return rows.join(sums, "rank", "left").fillna(0).select("rank", "local_rows", "local_nnz", "interior_nnz", "halo_nnz", "ghosts", F.col("ghosts").alias("imports"), "exports")


def imbalance(values: DataFrame, columns: list[str], group: list[str]) -> DataFrame:
    """Greatest over least of each column, null unless the least is positive."""
    return values.groupBy(*group).agg(*[F.when(F.min(c) > 0, F.max(c) / F.min(c)).alias(f"{c}_imbalance") for c in columns])


def verify(owner: DataFrame, rows: int, parts: int) -> DataFrame:
    """One row: rows, least and greatest part, distinct parts, and whether the file declares what it holds (parts from 1)."""
    found = owner.agg(F.count("*").alias("n"), F.min("part").alias("least"), F.max("part").alias("most"), F.count_distinct("part").alias("used"))
    return found.withColumn("ok", (F.col("n") == rows) & (F.col("least") >= 1) & (F.col("most") <= parts) & (F.col("used") == parts))


def edge_cut(owned: DataFrame) -> Column | DataFrame:
    """One row: halves of the entries between ranks, on a symmetric pattern without doubles."""
    return owned.where("kind = 'halo'").select("i", "j").distinct().agg((F.count("*") / 2).cast("long").alias("edge_cut"))


def build(coo: DataFrame, rows: DataFrame, size: int, method: str = "row-block", given: DataFrame | None = None) -> DataFrame:
    """The owner map of a method; a given map needs method 'file' or the default, and one rank takes row blocks always.

    'metis' parts the graph of the matrix's pattern by multilevel contraction (``multilevel.kway``).
    """
    if given is not None and method == "metis":
        raise ValueError("a partition file and another method were asked for")
    n = rows.count()
    if size == 1 or (given is None and method == "row-block"):
        owner = row_block(rows, n, size)
    elif given is not None:
        owner = given.select("i", "rank")
    elif method == "file":
        raise ValueError("method 'file' needs a partition")
    elif method == "metis":
        owner, _ = kway(coo, rows, size)
    else:
        raise ValueError(f"unknown method {method!r}")
    used = owner.agg(F.count_distinct("rank")).first()[0]
    if used < size:
        raise ValueError(f"{size - used} of {size} ranks have no rows")
    return owner
