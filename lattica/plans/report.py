"""Reports: the summary tables as DataFrames, and their Markdown.

Each table is a DataFrame of numbers; text is made from the few rows that a report shows, after the
groupings have run on the cluster.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import compare, summary
from ..sources import logs
from ..storage import write_text

M = "_median"


def _median(name: str):
    return F.col(name + M)


def solver_summary(summaries: DataFrame, analyzer: str = "base") -> DataFrame:
    """The 18 columns of the solver table; where communication isn't decomposed, its columns are null."""
    solver = _median("runtime_solver_s")
    own = S.decomposed(analyzer, F.col("dataset"), F.col("comm"))
    masked = lambda c: F.when(own, c)
    return summaries.select(
        "dataset",
        "scale",
        "comm",
        "ranks",
        "repeats",
        solver.alias("solver_s"),
        F.concat_ws("-", S.number_text(F.col("runtime_solver_s_min")), S.number_text(F.col("runtime_solver_s_max"))).alias("solver_min_max"),
        _median("runtime_running_solver_s").alias("running_s"),
        masked(_median("operations_allreduce_s")).alias("allreduce_s"),
        masked(_median("operations_allreduce_us")).alias("allreduce_us"),
        masked(_median("operations_allreduce_calls")).alias("allreduce_calls"),
        masked(_median("operations_halo_s")).alias("halo_s"),
        masked(_median("operations_halo_us")).alias("halo_us"),
        _median("runtime_iterations").alias("iterations"),
        F.nullif(_median("runtime_gflops"), F.lit(0.0)).alias("gflops"),
        _median("runtime_wall_s").alias("wall_s"),
        S.comm_share(_median("operations_allreduce_s"), solver, own).alias("allreduce_percent"),
        S.comm_share(_median("operations_halo_s"), solver, own).alias("halo_percent"),
        "variant",
    )


def correctness(summaries: DataFrame) -> DataFrame:
    return summaries.select(
        "dataset", "scale", "comm", "ranks", F.concat_ws("/", "converged_repeats", "repeats").alias("converged"), _median("runtime_iterations").alias("iterations"), _median("correctness_residual_norm").alias("residual"), _median("correctness_rel_residual_r0").alias("rel_residual_r0"), _median("correctness_rel_residual_rhs").alias("rel_residual_rhs"), _median("correctness_error_norm").alias("error_norm"), _median("runtime_solver_s").alias("solver_s"), F.col("runtime_ms_per_iter").alias("ms_per_iter"), _median("runtime_gflops").alias("gflops"), "variant"
    )


def operation_breakdown(summaries: DataFrame) -> DataFrame:
    """Shares of the solver time; summaries without solver time, or without any operation, are left out."""
    solver = _median("runtime_solver_s")
    spmv = S.first_true(_median("operations_spmv_s"), _median("operations_gemv_s"))
    dot, nrm2, allreduce, halo = (_median(f"operations_{c}_s") for c in ("dot", "nrm2", "allreduce", "halo"))
    pack, sync, other = (_median(f"overheads_{c}_s") for c in ("pack", "host_sync", "other"))
    known = summaries.where(F.nullif(solver, F.lit(0.0)).isNotNull() & F.coalesce(spmv, dot, nrm2, allreduce, halo, pack, sync, other).isNotNull())
    share = lambda v, n: S.percent(v, solver).alias(n)
    return known.select(
        "dataset", "scale", "comm", solver.alias("solver_s"), share(spmv, "spmv_percent"), share(S.sum_values(dot, nrm2), "dot_nrm2_percent"), share(allreduce, "allreduce_percent"), share(S.first_true(halo, _median("overheads_p2p_s")), "halo_percent"), share(S.sum_values(pack, sync), "pack_sync_percent"), share(other, "other_percent"), "variant", "ranks"
    )


def rank_skew(summaries: DataFrame) -> DataFrame:
    """One row for each skew that is known: operation in the fixed order ``place``."""
    names = [c.removesuffix("_s") for c in summary.METRICS["skew"]]
    wide = summaries.select("dataset", "scale", "comm", "ranks", "variant", *[_median(f"skew_{c}_s").alias(c) for c in names])
    long = wide.unpivot(["dataset", "scale", "comm", "ranks", "variant"], names, "operation", "skew_s").where("skew_s is not null")
    return long.withColumn("place", F.array_position(F.array(*map(F.lit, names)), F.col("operation")))


def partition_imbalance(summaries: DataFrame) -> DataFrame:
    names = list(summary.METRICS["partition"])
    return summaries.where(F.coalesce(*[_median(f"partition_{c}") for c in names]).isNotNull()).select("dataset", "scale", "comm", "ranks", *[_median(f"partition_{c}").alias(c) for c in names], "variant")


def best_table(summaries: DataFrame) -> DataFrame:
    best = summary.best_by_scale(summaries)
    return best.select("dataset", "scale", "comm", "ranks", _median("runtime_solver_s").alias("solver_s"), _median("runtime_running_solver_s").alias("running_s"), _median("runtime_iterations").alias("iterations"), _median("runtime_gflops").alias("gflops"))


def text(value, digits: int = 3) -> str:
    """A cell: N/A for null, integers as they are, floats as ``scalars.number_text``."""
    if value is None:
        return "N/A"
    if isinstance(value, str | bool | int):
        return str(value)
    if value == 0:
        return "0"
    return f"{value:.3e}" if abs(value) >= 1e5 or abs(value) < 1e-3 else f"{value:.{digits}f}"


def markdown_table(headers: list[str], rows: list[list[str]]) -> str:
    line = lambda cells: "| " + " | ".join(cells) + " |"
    return "\n".join([line(headers), line(["---"] * len(headers)), *map(line, rows)])


@dataclass(frozen=True)
class Table:
    title: str
    headers: dict[str, str]
    whole: tuple[str, ...] = ()


# Sections and column titles, which report readers look for.
TABLES = {
    "solver": Table("Solver And Communication Summary", {"dataset": "Dataset", "scale": "Scale", "comm": "Comm", "ranks": "Ranks", "repeats": "Repeats", "solver_s": "Solver s", "solver_min_max": "Solver min-max s", "running_s": "Running s", "allreduce_s": "Allreduce s", "allreduce_us": "Allreduce us/op", "allreduce_calls": "Allreduce calls", "halo_s": "Halo s", "halo_us": "Halo us/msg", "iterations": "Iters", "gflops": "GF/s", "wall_s": "Wall s", "allreduce_percent": "Allreduce %", "halo_percent": "Halo %"}, ("allreduce_calls", "iterations")),
    "correctness": Table("Correctness And Runtime", {"dataset": "Dataset", "scale": "Scale", "comm": "Comm", "ranks": "Ranks", "converged": "Converged", "iterations": "Iters", "residual": "Residual", "rel_residual_r0": "Rel residual r0", "rel_residual_rhs": "Rel residual rhs", "error_norm": "Error norm", "solver_s": "Solver s", "ms_per_iter": "ms/iter", "gflops": "GF/s"}, ("iterations",)),
    "best": Table("Best Solver Time By Scale", {"dataset": "Dataset", "scale": "Scale", "comm": "Best comm", "ranks": "Ranks", "solver_s": "Solver s", "running_s": "Running s", "iterations": "Iters", "gflops": "GF/s"}, ("iterations",)),
    "breakdown": Table("Operation Breakdown", {"dataset": "Dataset", "scale": "Scale", "comm": "Comm", "solver_s": "Solver s", "spmv_percent": "SpMV/GEMV %", "dot_nrm2_percent": "Dot+nrm2 %", "allreduce_percent": "Allreduce %", "halo_percent": "Halo/P2P %", "pack_sync_percent": "Pack+host sync %", "other_percent": "Other %"}),
    "skew": Table("Rank Skew", {"dataset": "Dataset", "scale": "Scale", "comm": "Comm", "ranks": "Ranks", "operation": "Operation", "skew_s": "Skew s"}),
    "imbalance": Table("Partition Imbalance", {"dataset": "Dataset", "scale": "Scale", "comm": "Comm", "ranks": "Ranks", "local_nnz": "Local nnz max/min", "halo_nnz": "Halo nnz max/min", "ghosts": "Ghosts max/min", "imports": "Imports max/min", "exports": "Exports max/min"}),
    "reference": Table("CUDA Reference Comparison", {"scale": "Scale", "comm": "SYCL comm", "ranks": "Ranks", "solver": "SYCL solver s", "iterations": "SYCL iters", "ms_per_iter": "SYCL ms/iter", "direct_solver": "CUDA MPI s", "direct_iterations": "CUDA MPI iters", "direct_ms_per_iter": "CUDA MPI ms/iter", "best_solver": "CUDA best s", "slowdown_direct": "Solver slowdown vs MPI", "slowdown_best": "Solver slowdown vs best", "iteration_ratio": "Iter ratio vs MPI", "ms_per_iter_ratio": "ms/iter ratio vs MPI"}, ("iterations", "direct_iterations")),
    "cross": Table("Cross-Dataset Comparison", {"scale": "Scale", "comm": "Comm", "ranks": "Ranks", "baseline": "Baseline", "baseline_solver_s": "Baseline solver s", "compared": "Compared", "compared_solver_s": "Compared solver s", "baseline_over_compared": "Baseline/Compared"}),
}
NVSHMEM_NOTE = "- NVSHMEM runs fuse communication into kernels; their allreduce and halo times are not comparable."


def _rows(df: DataFrame, table: Table, order: tuple[str, ...]) -> list[list[str]]:
    return [[text(r[c], 0 if c in table.whole else 3) for c in table.headers] for r in df.orderBy(*order).collect()]


def render(runs: DataFrame, roots: dict[str, str], analyzer: str = "base", reference: DataFrame | None = None) -> str:
    """The Markdown report of runs: fixed sections, those after the third only where they have rows."""
    summaries = summary.summarize(runs)
    by = summary.ORDER
    tables = [("solver", solver_summary(summaries, analyzer), by), ("correctness", correctness(summaries), by), ("best", best_table(summaries), ("dataset", "scale")), ("breakdown", operation_breakdown(summaries), by), ("skew", rank_skew(summaries), (*by, "place")), ("imbalance", partition_imbalance(summaries), by)]
    if reference is not None:
        tables.append(("reference", compare.with_reference(summaries, reference), by))
    tables.append(("cross", compare.cross_dataset(summaries), ("scale", "comm", "ranks", "compared")))
    facts = runs.agg(F.array_join(F.array_sort(F.collect_set("matrix")), ", "), F.coalesce(F.bool_or(F.col("comm") == "nvshmem"), F.lit(False))).first()
    listed = ", ".join(f"{k}={v}" for k, v in sorted(roots.items()))
    out = ["# Results Summary", "", "Values are medians across repeats.", "", f"Input roots: `{listed}`", f"Matrices: `{facts[0]}`"]
    for i, (name, df, order) in enumerate(tables):
        rows = _rows(df, TABLES[name], order)
        if rows or i < 3:
            out += ["", f"## {TABLES[name].title}", "", markdown_table(list(TABLES[name].headers.values()), rows)]
    if facts[1]:
        out += ["", "## Notes", "", NVSHMEM_NOTE]
    return "\n".join(out) + "\n"


def analyze(spark: SparkSession, datasets: dict[str, str], backend: str = "native", reference: DataFrame | None = None, output: str | None = None) -> str:
    """The report of logs below the roots of labelled datasets, also written to ``output``."""
    runs = logs.collect_runs(spark, datasets, backend)
    if not runs.take(1):
        raise ValueError("no logs found")
    made = render(runs, datasets, backend, reference)
    if output:
        write_text(spark, made, output)
    return made


def paired_lines(jobs: DataFrame, cells: DataFrame) -> list[str]:
    """The console table of paired runs; ValueError if nothing is paired."""
    rows = jobs.orderBy("matrix", "topology", "job", "pair").collect()
    if not rows:
        raise ValueError("no paired results")
    out = [f"{'matrix':<11}{'topo':<6}{'pair':<22}{'job':>9} n  {'portable':>8} {'native_s':>8}  {'ratio':>5} {'rounds':>11}  {'per-it':>6}"]
    for r in rows:
        span = f"{r['least_ratio']:.2f}..{r['most_ratio']:.2f}" if r["rounds"] else "-"
        out.append(f"{r['matrix']:<11}{r['topology']:<6}{r['pair']:<22}{r['job']:>9} {r['rounds']}  {r['portable_s']:8.2f} {r['native_s']:8.2f}  {r['ratio']:5.2f} {span:>11}  {r['per_iter_ratio']:6.2f}")
    out += ["", "per cell, median over allocations (portable / native; above 1.00 the portable side is slower):"]
    for r in cells.orderBy("matrix", "topology", "pair").collect():
        out.append(f"  {r['matrix']:<11}{r['topology']:<6}{r['pair']:<14} allocations={r['allocations']}  time {r['ratio']:.2f} [{r['least_ratio']:.2f}..{r['most_ratio']:.2f}]  per-iteration {r['per_iter_ratio']:.2f}")
    return out


def rank_lines(stats: DataFrame) -> DataFrame:
    """rank, line: the partition diagnostics that a solve prints for each rank, as ``logs`` reads them."""
    columns = ("rank", "local_rows", "local_nnz", "interior_nnz", "halo_nnz", "ghosts", "imports", "exports")
    return stats.select("rank", F.concat(F.lit("solver_diag_partition: "), F.concat_ws(" ", *columns)).alias("line"))


def timer_lines(spread: DataFrame) -> DataFrame:
    """timer, line: the timer diagnostics over ranks, of (timer, min_s, avg_s, max_s, skew_s)."""
    return spread.select("timer", F.format_string("solver_diag_perf: %s min_s=%.6f avg_s=%.6f max_s=%.6f skew_s=%.6f", "timer", "min_s", "avg_s", "max_s", "skew_s").alias("line"))
