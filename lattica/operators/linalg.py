"""Sparse products, dot products, norms and updates on DataFrames: matrices (i, j, v), vectors (i, val)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rows up to which a vector is broadcast to the entries: at most 16 bytes a row and Spark's hash table.
BROADCAST_ROWS = 1_000_000


def is_broadcast(n: int | None) -> bool:
    """Whether a vector of ``n`` rows (None: not known) is broadcast to the entries."""
    return n is not None and n <= BROADCAST_ROWS


def _products(coo: DataFrame, x: DataFrame, n: int | None, tasks: int | None, dealt: bool) -> DataFrame:
    """Entries with _x, their column's value; ``tasks`` deals by column those that no broadcast serves, unless they are ``dealt`` so."""
    values = x.select(F.col("i").alias("j"), F.col("val").alias("_x"))
    if is_broadcast(n):
        return coo.join(F.broadcast(values), "j")
    if tasks is None:
        return coo.join(values, "j")
    return (coo if dealt else coo.repartition(tasks, "j")).join(values.repartition(tasks, "j"), "j")


def spmv(coo: DataFrame, x: DataFrame, rows: DataFrame, n: int | None = None, tasks: int | None = None, dealt: bool = False) -> DataFrame:
    """i, val of A x for every row; rows without entries are 0. ``n``: the vector's size, if known, to broadcast a small one.

    ``dealt``: the entries are in ``tasks`` partitions by j already, and only their products move.
    """
    product = _products(coo, x, n, tasks, dealt).groupBy("i").agg(F.sum(F.col("v") * F.col("_x")).alias("val"))
    return rows.select("i").join(product, "i", "left").fillna(0.0, ["val"])


def split_spmv(owned: DataFrame, x: DataFrame, rows: DataFrame, n: int | None = None, tasks: int | None = None, dealt: bool = False) -> DataFrame:
    """As ``spmv``, interior entries and halo entries each by themselves and then added, from one reading of the entries."""
    near, far = (F.sum(F.when(F.col("kind") == k, F.col("v") * F.col("_x"))) for k in ("interior", "halo"))
    product = _products(owned, x, n, tasks, dealt).groupBy("i").agg((F.coalesce(near, F.lit(0.0)) + F.coalesce(far, F.lit(0.0))).alias("val"))
    return rows.select("i").join(product, "i", "left").fillna(0.0, ["val"])


def dot(x: Column, y: Column) -> Column:
    return F.sum(x * y)


def norm(x: Column) -> Column:
    return F.sqrt(F.sum(x * x))


def solution_error(x: DataFrame, exact: DataFrame) -> DataFrame:
    """One row: the 2-norm of x - x* over that of x*, 0 where x* is 0; rows that one of them lacks are 0 there."""
    both = x.select("i", F.col("val").alias("x")).join(exact.select("i", F.col("val").alias("e")), "i", "full").fillna(0.0, ["x", "e"])
    sums = both.agg(F.sum((F.col("x") - F.col("e")) ** 2).alias("d"), F.sum(F.col("e") ** 2).alias("e"))
    return sums.select(F.when(F.col("e") == 0, 0.0).otherwise(F.sqrt(F.try_divide("d", "e"))).alias("error"))


def residual(coo: DataFrame, x: DataFrame, b: DataFrame, rows: DataFrame, n: int | None = None, tasks: int | None = None, dealt: bool = False) -> DataFrame:
    """One row: norms of b - A x and of b, from the unpartitioned matrix, and their ratio (0 where b is 0).

    Entries of b or A x that the other lacks count against 0.
    """
    ax = spmv(coo, x, rows, n, tasks, dealt).select("i", F.col("val").alias("ax"))
    r = b.select("i", F.col("val").alias("b")).join(ax, "i", "full").fillna(0.0, ["b", "ax"]).agg(norm(F.col("b") - F.col("ax")).alias("residual_norm"), norm(F.col("b")).alias("rhs_norm"))
    return r.withColumn("true_rel_residual", F.coalesce(F.try_divide("residual_norm", "rhs_norm"), F.lit(0.0)))


def cg_update(state: DataFrame, alpha: float) -> DataFrame:
    """x += alpha s, r -= alpha t of (i, x, r, s, t)."""
    return state.withColumns({"x": F.col("x") + alpha * F.col("s"), "r": F.col("r") - alpha * F.col("t")})


def cg_direction(state: DataFrame, beta: float) -> DataFrame:
    """s = beta s + r."""
    return state.withColumn("s", beta * F.col("s") + F.col("r"))


def total_flops(rows: Column, nnz: Column, iterations: Column) -> Column:
    """Aggregate over ranks: 2n + iterations (2 nnz + 11 n)."""
    return F.sum(2 * rows + iterations * (2 * nnz + 11 * rows))


def gflops(flops: Column, seconds: Column) -> Column:
    return F.when(seconds == 0, 0.0).otherwise(F.try_divide(flops, seconds) / 1e9)
