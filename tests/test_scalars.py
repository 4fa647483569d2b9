"""Scalar rules against plain Python."""

import pytest
from pyspark.sql import functions as F

from lattica.functions import scalars as S
from lattica.plans import report


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()[0]


@pytest.mark.parametrize(("text", "seconds"), [("0:12.50", 12.5), ("1:02:03", 3723.0), ("10:00", 600.0), (None, None)])
def test_wall_clock(spark, text, seconds):
    assert one(spark, S.wall_clock(F.lit(text).cast("string"))) == seconds


def test_wall_clock_junk(spark):
    with pytest.raises(Exception, match="not a wall clock"):
        one(spark, S.wall_clock(F.lit("12")))


@pytest.mark.parametrize(("value", "shown"), [(None, "N/A"), (0.0, "0"), (1.5, "1.500"), (123456.0, "1.235e+05"), (0.00012, "1.200e-04"), (-2.0, "-2.000")])
def test_number_text(spark, value, shown):
    assert one(spark, S.number_text(F.lit(value).cast("double"))) == shown
    assert report.text(value) == shown


@pytest.mark.parametrize(("name", "kind"), [(None, "unknown"), ("", "unknown"), ("HOST", "none"), ("gpu-aware", "mpi"), ("oneCCL", "nccl"), ("nvshmem", "nvshmem"), ("odd", "unknown")])
def test_backend(spark, name, kind):
    assert one(spark, S.backend(F.lit(name).cast("string"))) == kind


def test_comm_takes_the_command_unless_empty(spark):
    assert one(spark, S.comm(F.lit(""), F.lit("oneccl"))) == "nccl"
    assert one(spark, S.comm(F.lit("mpi"), F.lit("oneccl"))) == "mpi"


def test_missing_and_zero(spark):
    null = F.lit(None).cast("double")
    assert one(spark, S.sum_values(null, null)) is None
    assert one(spark, S.sum_values(null, F.lit(2.0))) == 2.0
    assert one(spark, S.first_true(F.lit(0.0), F.lit(3.0))) == 3.0
    assert one(spark, S.ratio(F.lit(1.0), F.lit(0.0))) is None
    assert one(spark, S.ms_per_iter(F.lit(12.0), F.lit(120))) == 100.0
    assert one(spark, S.ms_per_iter(F.lit(0.0), F.lit(120))) is None


def test_blocks(spark):
    got = [r[0] for r in spark.range(10).select(S.block_owner(F.col("id"), 10, 4)).collect()]
    assert got == [0, 0, 0, 1, 1, 1, 2, 2, 3, 3]
    assert [r[0] for r in spark.range(4).select(S.block_first(F.col("id"), 10, 4)).collect()] == [0, 3, 6, 8]
    assert [r[0] for r in spark.range(2).select(S.block_owner(F.col("id"), 2, 4)).collect()] == [0, 1]


@pytest.mark.parametrize(("text", "ranks"), [("2n4g", 8), ("1n5g", None), ("0n1g", None), ("n", None)])
def test_topology(spark, text, ranks):
    assert one(spark, S.topology(F.lit(text))[2]) == ranks


@pytest.mark.parametrize(("nodes", "runs", "time"), [(1, 0, "00:15:00"), (1, 8, "00:30:00"), (8, 20, "01:00:00"), (16, 100, "05:00:00")])
def test_walltime(spark, nodes, runs, time):
    assert one(spark, S.walltime(F.lit(nodes), F.lit(runs))) == time


@pytest.mark.parametrize(("text", "size"), [("4k", 4096), ("1.5KB", 1536), ("2M", 2 << 20), ("7", 7), ("1gb", 1 << 30)])
def test_sizes(spark, text, size):
    assert one(spark, S.parse_size(F.lit(text))) == size


def test_size_junk(spark):
    with pytest.raises(Exception, match="not a size"):
        one(spark, S.parse_size(F.lit("4q")))


def test_bandwidth_of_a_published_row(spark):
    assert one(spark, S.algorithm_bandwidth(F.lit(4096), F.lit(32.0419))) == pytest.approx(0.127833, rel=1e-5)
    assert one(spark, S.bus_bandwidth(F.lit(4096), F.lit(32.0419), 8)) == pytest.approx(0.223707, rel=1e-5)


def test_key_values_last_wins(spark):
    assert one(spark, S.value_of(F.lit("solver: a=1 b=x=y a=2"), "a")) == "2"
    assert one(spark, S.value_of(F.lit("solver: a=1 b=x=y a=2"), "b")) == "x=y"
    assert one(spark, S.value_of(F.lit("solver: a=1"), "c")) is None


def test_patterns_and_flags(spark):
    assert one(spark, S.matches_any(F.lit("2n4g"), ["1n*", "?n4g"])) and not one(spark, S.matches_any(F.lit("12n4g"), ["?n4g"]))
    assert one(spark, S.matches_any(F.lit("x"), []))
    assert [S.positive_flag(v) for v in (None, "", "0", "7", "-3", "x")] == [0, 0, 0, 7, 0, 0]
