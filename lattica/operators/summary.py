"""Summaries of repeated runs: exact medians and their companions, and the best configurations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as S
from .quantiles import order_statistics
from .windows import top_one

#: Summary column to run column, in six groups.
METRICS = {
    "runtime": {"solver_s": "solver_time_s", "running_solver_s": "running_solver_s", "wall_s": "wall_s", "iterations": "iterations", "gflops": "gflops"},
    "correctness": {c: c for c in ("residual_norm", "rel_residual_r0", "rel_residual_rhs", "error_norm")},
    "operations": {c: c for c in ("gemv_s", "spmv_s", "dot_s", "nrm2_s", "axpy_s", "copy_s", "allreduce_s", "allreduce_us", "allreduce_calls", "halo_s", "halo_us")},
    "overheads": {c: c for c in ("pack_s", "p2p_s", "host_sync_s", "other_s")},
    "skew": {c: f"{c.removesuffix('_s')}_skew_s" for c in ("spmv_s", "allreduce_s", "p2p_s", "halo_spmv_s", "pack_s", "host_sync_s")},
    "partition": {c: f"{c}_imbalance" for c in ("local_nnz", "halo_nnz", "ghosts", "imports", "exports")},
}
KEYS = ("dataset", "scale", "variant", "comm", "ranks")
ORDER = ("dataset", "scale", "comm", "variant", "ranks")


def sample(column: Column | str) -> dict[str, Column]:
    """count, median, min, max and total of the values that are not null; null but for the count if there are none."""
    column = F.col(column) if isinstance(column, str) else column
    v = column.cast("double")
    return {"count": F.count(v), "median": F.median(v), "min": F.min(v), "max": F.max(v), "total": F.sum(v)}


def summarize(runs: DataFrame, by_matrix: bool = False) -> DataFrame:
    """One row for each (dataset, scale, variant, comm, ranks), nulls being equal: repeats, converged_repeats and <group>_<metric>_<statistic>.

    Matrices of one cell are pooled unless ``by_matrix``.
    """
    keys = [*KEYS, *(["matrix"] if by_matrix else [])]
    columns = [stat.alias(f"{group}_{name}_{s}") for group, names in METRICS.items() for name, source in names.items() for s, stat in sample(source).items()]
    out = runs.groupBy(*keys).agg(F.count("*").alias("repeats"), F.count_if(F.col("converged")).alias("converged_repeats"), *columns)
    return out.withColumn("runtime_ms_per_iter", S.ms_per_iter(F.col("runtime_solver_s_median"), F.col("runtime_iterations_median")))


def ordered(summaries: DataFrame) -> DataFrame:
    return summaries.orderBy(*ORDER)


def best_by_scale(summaries: DataFrame, solver: str = "runtime_solver_s_median") -> DataFrame:
    """The summary with the least median solver time of each dataset and scale; the first in summary order wins ties.

    A time of 0 is beaten by any other: it stands for a missing one.
    """
    known = summaries.where(F.col(solver).isNotNull())
    return top_one(known, ["dataset", "scale"], F.coalesce(F.nullif(F.col(solver), F.lit(0.0)), F.lit(float("inf"))), "comm", "variant", "ranks")


def nearest_rank(values: Column, q: float) -> Column:
    """Aggregate: the element at floor(q (n - 1)) of the sorted sample, of groups that fit a task; ``order_statistics`` takes any."""
    return F.element_at(F.array_sort(F.collect_list(values)), (F.floor(q * (F.count(values) - 1)) + 1).cast("int"))


def latency_percentiles(samples: DataFrame, value: str, groups: list[str]) -> DataFrame:
    """Exact, for groups of any size; groups without values have no row."""
    return order_statistics(samples, groups, value, {"min_us": 0.0, "p50_us": 0.5, "p99_us": 0.99, "max_us": 1.0}).drop("n")


def probe_summary(ranks: DataFrame) -> DataFrame:
    """One row over ranks (p50_us, ok): the greatest p50, the spread of p50, and whether all are right."""
    return ranks.agg(F.max("p50_us").alias("p50_max_us"), (F.max("p50_us") - F.min("p50_us")).alias("p50_spread_us"), F.bool_and("ok").alias("all_ok"))


def mean_latency(ranks: DataFrame, groups: list[str]) -> DataFrame:
    """The slowest rank's mean latency, and whether all ranks are right, with bandwidths."""
    out = ranks.groupBy(*groups).agg(F.max("mean_us").alias("us"), (F.min(F.col("ok").cast("int")) == 1).alias("all_ok"))
    return out


def rank_spread(timers: DataFrame, columns: list[str], groups: list[str]) -> DataFrame:
    """Unpivoted: groups, timer, min_s, avg_s, max_s, skew_s (max - min) over ranks."""
    long = timers.unpivot([F.col(g) for g in groups], columns, "timer", "seconds")
    return long.groupBy(*groups, "timer").agg(F.min("seconds").alias("min_s"), F.avg("seconds").alias("avg_s"), F.max("seconds").alias("max_s"), (F.max("seconds") - F.min("seconds")).alias("skew_s"))
