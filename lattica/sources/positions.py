"""Numbering of lines by their place in a file, block by block."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.windows import exclusive_prefix_sum


def number_by_position(lines: DataFrame) -> DataFrame:
    """``lines`` with i: how many of them stand before."""
    return exclusive_prefix_sum(lines.withColumn("_one", F.lit(1).cast("long")), "pos", "_one", "i").drop("_one")

