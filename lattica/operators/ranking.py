"""Ranks over any number of rows, within groups of any size: range partitions and their counts, no window over a group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..storage import stash

#: Bits of monotonically_increasing_id() that number the rows of one partition (fixed by Spark).
ROW_BITS = 33


def _free(df: DataFrame, name: str) -> str:
    while name in df.columns:
        name += "_"
    return name


def with_rank(df: DataFrame, name: str, order: list[Column], group: list[str] | None = None, partitions: int | None = None) -> DataFrame:
    """``df`` with ``name``: 0, 1, 2, ... in the order of ``order``, within each group of equal ``group`` columns.

    ``df`` must be the same whenever it is read (a table or a stash). Rows are sorted over range partitions;
    a row's rank is its place in its partition plus the rows of those before it, and within a group less the
    rank of the group's first row. So a group of any size, or a hot one, is as many tasks as all rows are. Rows
    that ``order`` does not tell apart are numbered in the order in which they are read. One small row for each
    partition meets in one task. Nulls come first in ``group`` and are a group; ``order`` says where they stand.
    """
    group = group or []
    spark = df.sparkSession
    tasks = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    tie, at = _free(df, "_tie"), _free(df, "_at")
    # explicit number: adaptive execution leaves the ranges as they are; the tie spreads rows that are equal in all else
    keys = [*[F.col(f"`{c}`").asc_nulls_first() for c in group], *order, F.col(tie)]
    tied = df.withColumn(tie, F.monotonically_increasing_id())
    placed = stash(tied.repartitionByRange(tasks, *keys).sortWithinPartitions(*keys).drop(tie).withColumn(at, F.monotonically_increasing_id()), "ranked")
    part = F.shiftright(F.col(at), ROW_BITS)
    sizes = placed.groupBy(part.alias("_part")).agg(F.count("*").alias("_n"))
    before = sizes.select("_part", (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_before"))
    ranked = placed.join(before, part == F.col("_part")).withColumn(name, F.col("_before") + F.col(at).bitwiseAND((1 << ROW_BITS) - 1)).drop("_part", "_before", at)
    if not group:
        return ranked
    first, *aside = _free(ranked, "_first"), *[_free(ranked, f"_group{i}") for i in range(len(group))]
    firsts = ranked.groupBy(*[F.col(f"`{c}`").alias(a) for c, a in zip(group, aside, strict=True)]).agg(F.min(name).alias(first))
    same = [F.col(f"`{c}`").eqNullSafe(F.col(a)) for c, a in zip(group, aside, strict=True)]
    return ranked.join(firsts, same).withColumn(name, F.col(name) - F.col(first)).drop(first, *aside)
