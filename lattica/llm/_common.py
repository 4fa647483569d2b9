"""Tables, shared storage and hashing that the training-data operators have in common."""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import drop_stash, shared_dir, stash

__all__ = ["drop_stash", "free_name", "free_names", "likely_in", "named", "shared_dir", "small_batches", "stash", "table", "text_key"]

#: Rows and bytes of one Arrow batch. Texts may be long, so few rows; a row is never split.
ARROW_ROWS, ARROW_BYTES = 1024, 16 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the driver tables, as Spark's own reader sees it."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession, rows: int = ARROW_ROWS) -> None:
    """Bound the memory of one Arrow batch for kernels over whole texts."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(ARROW_BYTES))


def free_name(df: DataFrame, wanted: str) -> str:
    """``wanted``, with underscores until no column of ``df`` has the name in any case."""
    taken = {c.lower() for c in df.columns}
    while wanted.lower() in taken:
        wanted += "_"
    return wanted


def named(*added: str) -> Callable:
    """Of an operator that adds the columns ``added`` at the end, whatever columns its input has.

    Callers may name the added columns by ``names``; one that they don't name gets underscores where the
    input has a column of its name, in any case. The operator itself sees none of these clashes.
    """

    def wrap(operator: Callable) -> Callable:
        @functools.wraps(operator)
        def run(docs: DataFrame, *args, names: dict[str, str] | None = None, **options) -> DataFrame:
            called = free_names(docs, *added) | (names or {})
            if clash := {c.lower() for c in docs.columns} & {c.lower() for c in called.values()}:
                raise ValueError(f"columns {sorted(clash)} would be hidden")
            aside = {c: free_name(docs, f"own_{i}_") for i, c in enumerate(docs.columns) if c.lower() in added}
            out = operator(docs.withColumnsRenamed(aside), *args, **options)
            return out.select(*[F.col(f"`{aside.get(c, c)}`").alias(c) for c in docs.columns], *[F.col(c).alias(called[c]) for c in added])

        return run

    return wrap


def free_names(docs: DataFrame, *added: str) -> dict[str, str]:
    """Names for added columns that no column of ``docs`` has, as ``names`` takes them."""
    return {c: free_name(docs, c) for c in added}


#: Bits of the filter of ``likely_in``, 64 a row of what is broadcast: 2**18 rows at most, whatever the number of keys.
FILTER_BITS = 1 << 24


def likely_in(rows: DataFrame, keys: list[str], wanted: DataFrame, bits: int = FILTER_BITS) -> DataFrame:
    """Rows of ``rows`` whose ``keys`` may be among those of ``wanted``: all that are, and of the others about a share of (wanted keys / bits).

    A bitmap of bounded size is broadcast, so that what a later join drops is not shuffled first. That join settles it.
    """
    slot = F.pmod(F.xxhash64(*keys), F.lit(bits).cast("long"))
    mask = F.expr("shiftleft(1L, cast(_slot & 63 as int))")
    word = F.shiftright("_slot", 6)
    held = wanted.select(slot.alias("_slot")).groupBy(word.alias("_word")).agg(F.bit_or(mask).alias("_mask"))
    tried = rows.withColumn("_slot", slot).withColumn("_word", word).join(F.broadcast(held), "_word")
    return tried.where(F.col("_mask").bitwiseAND(mask) != 0).select(*rows.columns)


def text_key(text: Column) -> Column:
    """Sixteen bytes of SHA-256 that stand for a whole text; null and empty texts have the same."""
    return F.substring(F.unhex(F.sha2(F.coalesce(text, F.lit("")).cast("binary"), 256)), 1, 16)
