"""Comparisons of summaries: across datasets, with a reference report, and paired runs."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..storage import stash
from .windows import top_one

SOLVER, ITERATIONS, MS = "runtime_solver_s_median", "runtime_iterations_median", "runtime_ms_per_iter"




def cross_dataset(summaries: DataFrame) -> DataFrame:
    """scale, comm, ranks, baseline, its solver time, compared, its solver time, and baseline over compared.

    The baseline is the alphabetically first dataset. Of several variants of a cell the last in summary
    order counts; times of 0 or null make no row.
    """
    cells = top_one(summaries.select("dataset", "scale", "comm", "ranks", "variant", SOLVER), ["dataset", "scale", "comm", "ranks"], F.col("variant").desc())
    cells = cells.select("dataset", "scale", "comm", "ranks", F.nullif(F.col(SOLVER), F.lit(0.0)).alias("solver")).where("solver is not null")
    # the first dataset of all, also one without solver times
    first = summaries.agg(F.min("dataset").alias("first"))
    base = cells.join(F.broadcast(first), cells["dataset"] == first["first"]).drop("first").alias("b")
    other = cells.join(F.broadcast(first), cells["dataset"] != first["first"]).drop("first").alias("o")
    same = F.expr("b.scale <=> o.scale and b.comm <=> o.comm and b.ranks <=> o.ranks")
    return base.join(other, same).select("b.scale", "b.comm", "b.ranks", F.col("b.dataset").alias("baseline"), F.col("b.solver").alias("baseline_solver_s"), F.col("o.dataset").alias("compared"), F.col("o.solver").alias("compared_solver_s"), (F.col("b.solver") / F.col("o.solver")).alias("baseline_over_compared"))


def reference_best(reference: DataFrame) -> DataFrame:
    """scale, best_solver: the least solver time of each scale, the first row winning ties."""
    return top_one(reference.where("solver is not null"), ["scale"], "solver", "pos").select("scale", F.col("solver").alias("best_solver"))


def exclude_reference(summaries: DataFrame, reference: DataFrame) -> DataFrame:
    """Summaries of datasets that the reference doesn't have."""
    return summaries.join(reference.select("dataset").distinct(), "dataset", "left_anti")


def with_reference(summaries: DataFrame, reference: DataFrame) -> DataFrame:
    """Summaries beside the reference's row of the same scale, comm and ranks (the last of several) and its best of the scale."""
    direct = top_one(reference, ["scale", "comm", "ranks"], F.col("pos").desc()).select("scale", "comm", "ranks", F.col("solver").alias("direct_solver"), F.col("iterations").alias("direct_iterations"), F.lit(True).alias("has_direct")).alias("d")
    best = reference_best(reference)
    own = exclude_reference(summaries, reference).where(F.col(SOLVER).isNotNull()).alias("s")
    joined = own.join(direct, F.expr("s.scale <=> d.scale and s.comm <=> d.comm and s.ranks <=> d.ranks"), "left").join(best.alias("e"), F.expr("s.scale = e.scale"), "left").where("has_direct or e.best_solver is not null")
    direct_ms = S.ms_per_iter(F.col("direct_solver"), F.col("direct_iterations"))
    return joined.select(
        *[F.col(f"s.{c}") for c in ("dataset", "scale", "comm", "ranks", "variant")],
        F.col(SOLVER).alias("solver"),
        F.col(ITERATIONS).alias("iterations"),
        F.col(MS).alias("ms_per_iter"),
        "direct_solver",
        "direct_iterations",
        direct_ms.alias("direct_ms_per_iter"),
        "best_solver",
        S.ratio(F.col(SOLVER), F.col("direct_solver")).alias("slowdown_direct"),
        S.ratio(F.col(SOLVER), F.col("best_solver")).alias("slowdown_best"),
        S.ratio(F.col(ITERATIONS), F.col("direct_iterations"), both=True).alias("iteration_ratio"),
        S.ratio(F.col(MS), direct_ms, both=True).alias("ms_per_iter_ratio"),
    )


_JOB = ["matrix", "topology", "job"]


def _labelled(runs: DataFrame, labels: DataFrame, side: str) -> DataFrame:
    return runs.join(F.broadcast(labels.select(F.col(side).alias("label"), "pair")), "label").select(*_JOB, "pair", "trial", "seconds", "iterations")


def pair_table(runs: DataFrame, pairs: dict[str, str]) -> DataFrame:
    rows = ", ".join(f"('{p}', '{n}')" for p, n in pairs.items())
    return runs.sparkSession.sql(f"select col1 as pair, col1 as portable, col2 as native from values {rows}")


def common_rounds(runs: DataFrame, pairs: dict[str, str]) -> DataFrame:
    """matrix, topology, job, pair, trial of the trials that both sides of a pair have, with the ratio of their seconds."""
    labels = pair_table(runs, pairs)
    a, b = _labelled(runs, labels, "portable"), _labelled(runs, labels, "native")
    keys = [*_JOB, "pair", "trial"]
    return a.withColumnRenamed("seconds", "a").join(b.select(*keys, F.col("seconds").alias("b")), keys).select(*keys, (F.col("a") / F.col("b")).alias("ratio"))


def job_pairs(runs: DataFrame, pairs: dict[str, str]) -> DataFrame:
    """A row for each job and pair that both sides have runs of: medians, ratio of medians, per-iteration ratio, and the span over common trials (null without any)."""
    # parsed once, read by both sides and the rounds
    runs = stash(runs, "paired-runs", free=False)
    labels = pair_table(runs, pairs)
    keys = [*_JOB, "pair"]

    def side(name: str) -> DataFrame:
        return _labelled(runs, labels, name).groupBy(*keys).agg(F.median("seconds").alias(f"{name}_s"), F.median(F.col("seconds") / F.col("iterations")).alias(f"{name}_s_per_iter"), F.median("iterations").cast("long").alias(f"{name}_iterations"))

    rounds = common_rounds(runs, pairs).groupBy(*keys).agg(F.count("*").alias("rounds"), F.min("ratio").alias("least_ratio"), F.max("ratio").alias("most_ratio"))
    out = side("portable").join(side("native"), keys).join(rounds, keys, "left").fillna(0, ["rounds"])
    return out.withColumns({"ratio": F.col("portable_s") / F.col("native_s"), "per_iter_ratio": F.col("portable_s_per_iter") / F.col("native_s_per_iter")})


def pair_cells(jobs: DataFrame) -> DataFrame:
    """Per matrix, topology and pair over jobs: allocations, median, least and greatest ratio, median per-iteration ratio."""
    return jobs.groupBy("matrix", "topology", "pair").agg(
        F.count("*").alias("allocations"), F.median("ratio").alias("ratio"), F.min("ratio").alias("least_ratio"), F.max("ratio").alias("most_ratio"), F.median("per_iter_ratio").alias("per_iter_ratio")
    )


def labels_of(pairs: dict[str, str]) -> list[str]:
    return sorted({*pairs, *pairs.values()})


def with_places(df: DataFrame, *order) -> DataFrame:
    """``df`` with pos, its place in an order: for small tables that come without one."""
    return df.withColumn("pos", F.row_number().over(Window.orderBy(*order)))
