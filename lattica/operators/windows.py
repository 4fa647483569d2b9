"""Window-like operators: prefix sums, top-1, writers, sections, pending values, run order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Keys of one block of a prefix sum.
BLOCK = 1 << 16
#: Lines of a split of a file.
SPLIT = 1 << 16


def exclusive_prefix_sum(df: DataFrame, key: str, value: str, out: str, block: int = BLOCK) -> DataFrame:
    """``df`` with the sum of ``value`` over all smaller keys (integers).

    Two levels: blocks of keys are summed and accumulated, and each block accumulates its own rows, so no
    task holds more than a block of keys or the blocks' sums.
    """
    of = F.floor(F.col(key) / block)
    blocks = df.groupBy(of.alias("_block")).agg(F.sum(value).alias("_sum"))
    before = Window.orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.select("_block", F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_before"))
    inside = Window.partitionBy("_block").orderBy(key).rowsBetween(Window.unboundedPreceding, -1)
    joined = df.withColumn("_block", of).withColumn("_in", F.coalesce(F.sum(value).over(inside), F.lit(0))).join(blocks, "_block")
    return joined.withColumn(out, F.col("_before") + F.col("_in")).drop("_block", "_before", "_in")


def top_one(df: DataFrame, groups: list[str], *order) -> DataFrame:
    """The first row of each group in a total order."""
    return df.withColumn("_place", F.row_number().over(Window.partitionBy(*groups).orderBy(*order))).where("_place = 1").drop("_place")


def last_writer(value: Column, pos: Column) -> Column:
    """Aggregate: the value of the last row where it is not null."""
    return F.max_by(value, F.when(value.isNotNull(), pos))


def first_writer(value: Column, pos: Column) -> Column:
    return F.min_by(value, F.when(value.isNotNull(), pos))


def _carried(lines: DataFrame, group: str, split: int, carry: dict[str, Column]) -> tuple[DataFrame, DataFrame]:
    """``lines`` with _split, the number of their split of the file, and a row of aggregates for each split."""
    marked = lines.withColumn("_split", F.floor(F.col("pos") / split).cast("long"))
    return marked, marked.groupBy(group, "_split").agg(*[v.alias(k) for k, v in carry.items()])


def _with_carry(marked: DataFrame, carries: DataFrame, group: str) -> DataFrame:
    """``marked`` with the columns of ``carries``, by file (null is a file) and split.

    A join by sorting: carries have a row for each file, which compress so well that Spark would take very many for few enough to broadcast.
    """
    there = carries.withColumnsRenamed({group: "_file", "_split": "_of"}).hint("merge")
    return marked.join(there, F.col(group).eqNullSafe(F.col("_file")) & (F.col("_split") == F.col("_of"))).drop("_file", "_of")


def sections(lines: DataFrame, headers: dict[str, str], group: str = "file", split: int = SPLIT) -> DataFrame:
    """``lines`` (group, pos from 0, line) with the section they are in, null outside, and without the header lines.

    A header opens its section; any other line that starts with no space closes it, an empty line does not.
    Splits of ``split`` lines are scanned each by itself: a split's last mark is its carry-out, carries are
    folded over the splits of a file, and each split starts with what it is given. So a file of any length is many tasks.
    """
    mark = F.when(F.col("line").rlike(r"^\S"), F.lit(""))
    for line, name in reversed(headers.items()):
        mark = F.when(F.col("line") == line, F.lit(name)).otherwise(mark)
    marked, carries = _carried(lines.withColumn("_mark", mark), group, split, {"_out": F.max_by("_mark", F.when(F.col("_mark").isNotNull(), F.col("pos")))})
    before = Window.partitionBy(group).orderBy("_split").rowsBetween(Window.unboundedPreceding, -1)
    carries = carries.select(group, "_split", F.last("_out", ignorenulls=True).over(before).alias("_in"))
    inside = Window.partitionBy(group, "_split").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    known = _with_carry(marked, carries, group).withColumn("section", F.nullif(F.coalesce(F.last("_mark", ignorenulls=True).over(inside), "_in"), F.lit("")))
    return known.where(~F.col("line").isin(*headers)).drop("_mark", "_split", "_in")


def pending_value(lines: DataFrame, opener: Column, bare: Column, value: Column, out: str, group: str = "file", split: int = SPLIT) -> DataFrame:
    """``lines`` with, on its own line, the value that a bare opener waits for: the first one after it, up to the next opener.

    Split by split as in ``sections``: a split's carry-out is whether it has an opener, and whether since its last one a bare one
    stood and a value came.
    """
    rows = lines.withColumns({"_opens": F.coalesce(opener, F.lit(False)), "_bare": F.coalesce(bare, F.lit(False)), "_value": value})
    rows = rows.withColumns({"_comes": F.col("_value").isNotNull() & ~F.col("_opens")})
    last = F.max(F.when(F.col("_opens"), F.col("pos")))
    marked, carries = _carried(rows, group, split, {"_last": last, "_last_bare": F.max(F.when(F.col("_bare"), F.col("pos"))), "_last_value": F.max(F.when(F.col("_comes"), F.col("pos")))})
    since = lambda c: F.coalesce(F.col(c) >= F.col("_last"), F.col(c).isNotNull())
    carries = carries.select(group, "_split", F.col("_last").isNotNull().alias("_any"), since("_last_bare").alias("_b"), since("_last_value").alias("_v"))
    # splits from one with an opener up to the next such one share its state
    upto = Window.partitionBy(group).orderBy("_split").rowsBetween(Window.unboundedPreceding, 0)
    carries = carries.withColumn("_run", F.sum(F.col("_any").cast("int")).over(upto))
    run = Window.partitionBy(group, "_run").orderBy("_split").rowsBetween(Window.unboundedPreceding, 0)
    folded = carries.withColumns({"_b": F.max("_b").over(run), "_v": F.max("_v").over(run)})
    order = Window.partitionBy(group).orderBy("_split")
    folded = folded.select(group, "_split", *[F.coalesce(F.lag(c).over(order), F.lit(False)).alias(f"{c}_in") for c in ("_b", "_v")])
    known = _with_carry(marked, folded, group)
    inside = Window.partitionBy(group, "_split").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    known = known.withColumn("_open", F.sum(F.col("_opens").cast("int")).over(inside))
    since_open = Window.partitionBy(group, "_split", "_open").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    waits = F.max("_bare").over(since_open) | ((F.col("_open") == 0) & F.col("_b_in"))
    seen = F.sum(F.col("_comes").cast("int")).over(since_open) + F.when((F.col("_open") == 0) & F.col("_v_in"), 1).otherwise(0)
    known = known.withColumn(out, F.when(waits & F.col("_comes") & (seen == 1), F.col("_value")))
    return known.drop("_opens", "_bare", "_value", "_comes", "_split", "_open", "_b_in", "_v_in")


def run_order(keys: DataFrame, rounds: int, job: Column) -> DataFrame:
    """job, round, place, key of (job, pos, key): rounds alternate forwards and backwards, odd jobs start backwards."""
    by = Window.partitionBy("job", "round")
    every = keys.withColumn("round", F.explode(F.sequence(F.lit(1), F.lit(rounds))))
    forward, backward = F.row_number().over(by.orderBy("pos")), F.row_number().over(by.orderBy(F.col("pos").desc()))
    return every.withColumn("place", F.when((F.col("round") + job % 2) % 2 == 0, backward).otherwise(forward)).select("job", "round", "place", "key")
