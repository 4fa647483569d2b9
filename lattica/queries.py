"""The registered queries of the reference operators over the driver's tables, each with its SQL for DuckDB."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import fixtures as X
from .functions import scalars as S
from .functions import stream
from .operators import compare, linalg, multilevel, partition, quantiles, summary, windows
from .operators.ranking import with_rank
from .plans import cg, ghosts, report
from .sources import campaign, logs, matrix_market
from .storage import shared_dir, stash, write_text
from .streaming import events

_QUERIES: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str | None]] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        _QUERIES[name] = (f, sql)
        return f

    return add


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: f for k, (f, _) in _QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: s for k, (_, s) in _QUERIES.items() if s}


def _owned(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """rows, owner, owned entries."""
    rows = X.rows(spark, sf)
    n = rows.count()
    return rows, partition.row_block(rows, n, X.SIZE), partition.with_block_owners(X.coo(spark, sf), n, X.SIZE)


# ---- summaries and comparisons (the flagship comes first)

_SUMMARY = f"""with {X.RUNS_CTE}, s as (
  select dataset, scale, variant, comm, ranks, count(*) as repeats, count(*) filter (where converged) as converged_repeats,
    median(solver_time_s) as solver, min(solver_time_s) as solver_min, max(solver_time_s) as solver_max, sum(solver_time_s) as solver_total, count(solver_time_s) as solver_count, median(iterations) as iters,
    1000 * nullif(median(solver_time_s), 0) / nullif(median(iterations), 0) as ms_per_iter
  from runs group by all
)"""


def _summary(spark: SparkSession, sf: str) -> DataFrame:
    return summary.summarize(X.runs(spark, sf))


@query("a8_summarize_runs", _SUMMARY + " select dataset, scale, variant, comm, ranks, repeats, converged_repeats, solver_count, solver as solver_median, solver_min, solver_max, solver_total, iters as iterations_median from s")
def _(spark, sf):
    s = _summary(spark, sf)
    return s.select(*summary.KEYS, "repeats", "converged_repeats", *[F.col(f"runtime_solver_s_{k}").alias(f"solver_{k}") for k in ("count", "median", "min", "max", "total")], F.col("runtime_iterations_median").alias("iterations_median"))


_ALL = [(f"{g}_{n}", src) for g, names in summary.METRICS.items() for n, src in names.items()]


@query("a8_all_statistics", f"with {X.RUNS_CTE} " + " union all ".join(f"select dataset, scale, variant, comm, ranks, '{n}' as metric, count({c}) as n, median({c})::double as mid, min({c})::double as low, max({c})::double as high, sum({c})::double as total from runs group by all" for n, c in _ALL))
def _(spark, sf):
    s = _summary(spark, sf)
    each = F.array(*[F.struct(F.lit(n).alias("metric"), *[F.col(f"{n}_{k}").alias(a) for k, a in (("count", "n"), ("median", "mid"), ("min", "low"), ("max", "high"), ("total", "total"))]) for n, _ in _ALL])
    return s.select(*summary.KEYS, F.explode(each).alias("m")).select(*summary.KEYS, "m.*")


@query("a8_by_matrix", f"with {X.RUNS_CTE} select dataset, scale, variant, comm, ranks, matrix, count(*) as repeats, median(wall_s) as wall from runs group by all")
def _(spark, sf):
    s = summary.summarize(X.runs(spark, sf), by_matrix=True)
    return s.select(*summary.KEYS, "matrix", "repeats", F.col("runtime_wall_s_median").alias("wall"))


@query("a9_best_by_scale", _SUMMARY + " select dataset, scale, comm, variant, ranks, solver from (select *, row_number() over (partition by dataset, scale order by coalesce(nullif(solver, 0), 'inf'::double), comm, variant, ranks nulls first) as place from s where solver is not null) where place = 1")
def _(spark, sf):
    return summary.best_by_scale(_summary(spark, sf)).select("dataset", "scale", "comm", "variant", "ranks", F.col("runtime_solver_s_median").alias("solver"))


@query("a11_median", "select event_type, median(value) as mid, round(avg(value), 6) as mean, min(value) as low, max(value) as high, count(*) as n from events group by all")
def _(spark, sf):
    s = summary.sample("value")
    return X.table(spark, sf, "events").groupBy("event_type").agg(s["median"].alias("mid"), F.round(F.avg("value"), 6).alias("mean"), s["min"].alias("low"), s["max"].alias("high"), s["count"].alias("n"))


@query("o2_summary_order", _SUMMARY + " select row_number() over (order by dataset, scale, comm, variant, ranks nulls first) as place, dataset, scale, comm, variant, ranks from s")
def _(spark, sf):
    from pyspark.sql import Window

    return _summary(spark, sf).select(F.row_number().over(Window.orderBy(*summary.ORDER)).cast("long").alias("place"), "dataset", "scale", "comm", "variant", "ranks")


_CROSS = (
    _SUMMARY
    + """, cell as (select * from (select *, row_number() over (partition by dataset, scale, comm, ranks order by variant desc) as place from s) where place = 1 and nullif(solver, 0) is not null)
select b.scale, b.comm, b.ranks, b.dataset as baseline, b.solver as baseline_solver_s, o.dataset as compared, o.solver as compared_solver_s, b.solver / o.solver as baseline_over_compared
from cell b join cell o on b.dataset = (select min(dataset) from s) and o.dataset <> b.dataset and b.scale is not distinct from o.scale and b.comm is not distinct from o.comm and b.ranks is not distinct from o.ranks"""
)


@query("j7_cross_dataset", _CROSS)
def _(spark, sf):
    return compare.cross_dataset(_summary(spark, sf))


#: A reference report for the runs: some cells of dataset 'gamma', of which one scale is missing.
_REF = """select row_number() over (order by scale, comm, ranks) as pos, 'gamma' as dataset, scale, comm, ranks, solver, iters as iterations
  from (select scale, comm, ranks, min(solver) as solver, max(iters) as iters from s where dataset = 'gamma' and scale <> '16n4g' and ranks is not null group by scale, comm, ranks) r where solver is not null"""


def _reference(s: DataFrame) -> DataFrame:
    cells = s.where("dataset = 'gamma' and scale <> '16n4g' and ranks is not null").groupBy("scale", "comm", "ranks").agg(F.min("runtime_solver_s_median").alias("solver"), F.max("runtime_iterations_median").alias("iterations")).where("solver is not null")
    return compare.with_places(cells.withColumn("dataset", F.lit("gamma")), "scale", "comm", "ranks")


@query("a10_reference_best", _SUMMARY + f", ref as ({_REF}) select scale, solver as best_solver from (select *, row_number() over (partition by scale order by solver, pos) as place from ref) where place = 1")
def _(spark, sf):
    return compare.reference_best(_reference(_summary(spark, sf)))


@query("j10_exclude_reference", _SUMMARY + f", ref as ({_REF}) select dataset, scale, variant, comm, ranks from s anti join ref using (dataset)")
def _(spark, sf):
    s = _summary(spark, sf)
    return compare.exclude_reference(s, _reference(s)).select("dataset", "scale", "variant", "comm", "ranks")


@query(
    "j8_j9_reference_compare",
    _SUMMARY
    + f""", ref as ({_REF}), best as (select scale, min(solver) as best_solver from ref group by scale),
j as (select s.*, d.solver as direct_solver, d.iterations as direct_iterations, 1000 * nullif(d.solver, 0) / nullif(d.iterations, 0) as direct_ms, best_solver
  from s left join ref d on s.scale = d.scale and s.comm = d.comm and s.ranks is not distinct from d.ranks left join best on s.scale = best.scale where s.dataset <> 'gamma' and s.solver is not null and (d.pos is not null or best_solver is not null))
select dataset, scale, comm, ranks, variant, solver, iters as iterations, ms_per_iter, direct_solver, direct_iterations, direct_ms as direct_ms_per_iter, best_solver,
  solver / nullif(direct_solver, 0) as slowdown_direct, solver / nullif(best_solver, 0) as slowdown_best, nullif(iters, 0) / nullif(direct_iterations, 0) as iteration_ratio, nullif(ms_per_iter, 0) / nullif(direct_ms, 0) as ms_per_iter_ratio from j""",
)
def _(spark, sf):
    s = _summary(spark, sf)
    return compare.with_reference(s, _reference(s))


# ---- report projections

_WIDE = f"with {X.RUNS_CTE}, w as (select dataset, scale, variant, comm, ranks, count(*) as repeats, count(*) filter (where converged) as good, min(solver_time_s) as lo, max(solver_time_s) as hi, {', '.join(f'median({c}) as m_{c}' for _, c in _ALL)} from runs group by all)"


@query("p14_operation_breakdown", _WIDE + """ select dataset, scale, comm, variant, ranks, m_solver_time_s as solver_s, 100 * coalesce(nullif(m_spmv_s, 0), m_gemv_s) / m_solver_time_s as spmv_percent, 100 * (m_dot_s + m_nrm2_s) / m_solver_time_s as dot_nrm2_percent,
 100 * m_allreduce_s / m_solver_time_s as allreduce_percent, 100 * coalesce(nullif(m_halo_s, 0), m_p2p_s) / m_solver_time_s as halo_percent, 100 * (m_pack_s + m_host_sync_s) / m_solver_time_s as pack_sync_percent, 100 * m_other_s / m_solver_time_s as other_percent from w where nullif(m_solver_time_s, 0) is not null""")
def _(spark, sf):
    return report.operation_breakdown(_summary(spark, sf))


@query("p13_rank_skew", _WIDE + " " + " union all ".join(f"select dataset, scale, comm, ranks, variant, '{c.removesuffix('_s')}' as operation, m_{src} as skew_s, {i + 1} as place from w where m_{src} is not null" for i, (c, src) in enumerate(summary.METRICS["skew"].items())))
def _(spark, sf):
    return report.rank_skew(_summary(spark, sf))


@query("p8_partition_imbalance", _WIDE + " select dataset, scale, comm, ranks, variant, " + ", ".join(f"m_{c}_imbalance as {c}" for c in summary.METRICS["partition"]) + " from w where coalesce(" + ", ".join(f"m_{c}_imbalance" for c in summary.METRICS["partition"]) + ") is not null")
def _(spark, sf):
    return report.partition_imbalance(_summary(spark, sf))


_TEXT3 = "case when {0} is null then 'N/A' when {0} = 0 then '0' when abs({0}) >= 1e5 or abs({0}) < 1e-3 then printf('%.3e', {0}) else printf('%.3f', {0}) end"


@query(
    "p15_solver_summary",
    _WIDE
    + """ select dataset, scale, comm, ranks, variant, repeats, m_solver_time_s as solver_s, m_running_solver_s as running_s, case when own then m_allreduce_s end as allreduce_s, case when own then m_allreduce_us end as allreduce_us, case when own then m_allreduce_calls end as allreduce_calls,
 case when own then m_halo_s end as halo_s, case when own then m_halo_us end as halo_us, m_iterations as iterations, nullif(m_gflops, 0) as gflops, m_wall_s as wall_s, case when own then 100 * m_allreduce_s / nullif(m_solver_time_s, 0) end as allreduce_percent, case when own then 100 * m_halo_s / nullif(m_solver_time_s, 0) end as halo_percent from (select *, comm <> 'nvshmem' as own from w)""",
)
def _(spark, sf):
    return report.solver_summary(_summary(spark, sf), "native").drop("solver_min_max")


@query("p16_correctness", _WIDE + " select dataset, scale, comm, ranks, variant, good || '/' || repeats as converged, m_iterations as iterations, m_residual_norm as residual, m_rel_residual_r0 as rel_residual_r0, m_rel_residual_rhs as rel_residual_rhs, m_error_norm as error_norm, m_solver_time_s as solver_s, 1000 * nullif(m_solver_time_s, 0) / nullif(m_iterations, 0) as ms_per_iter, m_gflops as gflops from w")
def _(spark, sf):
    return report.correctness(_summary(spark, sf))


@query("k3_best_table", _WIDE + " select dataset, scale, comm, ranks, m_solver_time_s as solver_s, m_running_solver_s as running_s, m_iterations as iterations, m_gflops as gflops from (select *, row_number() over (partition by dataset, scale order by coalesce(nullif(m_solver_time_s, 0), 'inf'::double), comm, variant, ranks nulls first) as place from w where m_solver_time_s is not null) where place = 1")
def _(spark, sf):
    return report.best_table(_summary(spark, sf))


_HEADS = {
    "Solver And Communication Summary": "select count(*) from w",
    "Correctness And Runtime": "select count(*) from w",
    "Best Solver Time By Scale": "select count(distinct (dataset, scale)) from w where m_solver_time_s is not null",
    "Operation Breakdown": "select count(*) from w where nullif(m_solver_time_s, 0) is not null",
    "Rank Skew": "select " + " + ".join(f"count(m_{c})" for c in summary.METRICS["skew"].values()) + " from w",
    "Partition Imbalance": "select count(*) from w where coalesce(" + ", ".join(f"m_{c}_imbalance" for c in summary.METRICS["partition"]) + ") is not null",
    "Cross-Dataset Comparison": "select count(*) from cell b join cell o on b.dataset = (select min(dataset) from w) and o.dataset <> b.dataset and b.scale is not distinct from o.scale and b.comm is not distinct from o.comm and b.ranks is not distinct from o.ranks",
}


@query(
    "k3_report_sections",
    _WIDE
    + ", cell as (select * from (select *, row_number() over (partition by dataset, scale, comm, ranks order by variant desc) as place from w) where place = 1 and nullif(m_solver_time_s, 0) is not null) "
    + " union all ".join(f"select '## {h}' as section, ({n})::bigint as n_rows" for h, n in _HEADS.items())
    + " union all select '## Notes', 0 from runs where comm = 'nvshmem' having count(*) > 0",
)
def _(spark, sf):
    """The sections of the rendered report, with the rows of their tables."""
    sections: dict[str, int] = {}
    for line in report.render(X.runs(spark, sf), {"tables": sf}).split("\n"):
        if line.startswith("## "):
            sections[line] = -2 if line != "## Notes" else 0
        elif line.startswith("| "):
            sections[next(reversed(sections))] += 1
    return spark.createDataFrame(list(sections.items()), "section string, n_rows long")


def _cells(*columns: str) -> str:
    return "'| ' || concat_ws(' | ', " + ", ".join(columns) + ") || ' |'"


@query(
    "k3_f3_best_lines",
    _WIDE
    + " select "
    + _cells("dataset", "scale", "comm", "coalesce(ranks::varchar, 'N/A')", _TEXT3.format("m_solver_time_s"), _TEXT3.format("m_running_solver_s"), _TEXT3.replace("%.3f", "%.0f").format("m_iterations"), _TEXT3.format("m_gflops"))
    + " as line from (select *, row_number() over (partition by dataset, scale order by coalesce(nullif(m_solver_time_s, 0), 'inf'::double), comm, variant, ranks nulls first) as place from w where m_solver_time_s is not null) where place = 1"
    + " union all values ('| Dataset | Scale | Best comm | Ranks | Solver s | Running s | Iters | GF/s |'), ('| --- | --- | --- | --- | --- | --- | --- | --- |')",
)
def _(spark, sf):
    """The table of best times as the report shows it."""
    made = report.render(X.runs(spark, sf), {"tables": sf}).split("\n")
    at = made.index("## Best Solver Time By Scale") + 2
    return spark.createDataFrame([(x,) for x in made[at : made.index("", at)]], "line string")


@query("a22_matrix_list", f"with {X.RUNS_CTE} select dataset, string_agg(distinct matrix, ', ' order by matrix) as matrices, bool_or(comm = 'nvshmem') as any_nvshmem, count(distinct scale) as scales from runs group by dataset")
def _(spark, sf):
    return X.runs(spark, sf).groupBy("dataset").agg(F.array_join(F.array_sort(F.collect_set("matrix")), ", ").alias("matrices"), F.bool_or(F.col("comm") == "nvshmem").alias("any_nvshmem"), F.count_distinct("scale").alias("scales"))


# ---- paired runs

_PAIRS = {"portable-mpi": "native-mpi", "portable-nccl": "native-nccl", "portable-single": "native-single"}
_CAMPAIGN = """select event_id, case user_id % 2 when 0 then 'Bump' else 'Queen' end as matrix, case user_id % 3 when 0 then 1 else 2 end as nodes, case user_id % 3 when 0 then 4 else 8 end as procs, user_id % 10 as job,
  case event_id % 6 when 0 then 'portable-mpi' when 1 then 'native-mpi' when 2 then 'portable-nccl' when 3 then 'native-nccl' when 4 then 'portable-single' else 'native-single' end as label,
  cast(floor(event_id / 6) as bigint) % 8 as trial, cast(floor(value * 100) as bigint) % 900 + 100 as seconds, cast(floor(value * 100) as bigint) % 50 as iterations from {events}"""
_CAMPAIGN_CTE = f"""files as ({_CAMPAIGN.replace("{events}", "events")}),
campaign as (select * exclude place from (select matrix, nodes || 'n' || (procs // nodes) || 'g' as topology, job, label, trial, seconds + 0.5::double as seconds, iterations, row_number() over (partition by matrix, nodes, procs, job, label, trial order by file desc) as place
  from (select *, label || '/suitesparse/' || matrix || '/run' || lpad(event_id::varchar, 7, '0') || '-' as file from files where iterations > 0)) where place = 1),
pair as (select * from (values ('portable-mpi', 'native-mpi'), ('portable-nccl', 'native-nccl'), ('portable-single', 'native-single')) t(p, n)),
a as (select c.*, p as pair from campaign c join pair on label = p), b as (select c.*, p as pair from campaign c join pair on label = n)"""


def _campaign_files(spark: SparkSession, sf: str) -> DataFrame:
    rows = spark.sql(_CAMPAIGN, events=X.table(spark, sf, "events"))
    portable = F.col("label").startswith("portable")
    file = F.concat(F.col("label"), F.lit("/suitesparse/"), F.col("matrix"), F.format_string("/run%07d-%03d-nodes-%04d-procs-%d-%d-", "event_id", "nodes", "procs", "job", "trial"), F.when(portable, "stdout.txt").otherwise("stderr.txt"))
    own = F.concat(F.lit("ranks: 4\nsolver: converged=true iterations="), F.col("iterations"), F.lit(" residual=1e-6\ntiming: schema=3 solver_s=1.0 solver_max_s="), F.col("seconds"), F.lit(".5 solver_min_s=0.5\n"))
    native = F.concat(F.lit("4 MPI processes\n  total iterations: "), F.col("iterations"), F.lit("\n  total solver time: "), F.col("seconds"), F.lit(".5 seconds\n"))
    return rows.select(file.alias("file"), F.when(portable, own).otherwise(native).alias("text"))


def _campaign(spark: SparkSession, sf: str) -> DataFrame:
    return logs.campaign_runs(_campaign_files(spark, sf), _PAIRS)


@query("s8_campaign_runs", f"with {_CAMPAIGN_CTE} select matrix, topology, job, label, trial, seconds, iterations from campaign")
def _(spark, sf):
    return _campaign(spark, sf)


@query("j12_u3_common_rounds", f"with {_CAMPAIGN_CTE} select a.matrix, a.topology, a.job, a.pair, a.trial, a.seconds / b.seconds as ratio from a join b using (matrix, topology, job, pair, trial)")
def _(spark, sf):
    return compare.common_rounds(_campaign(spark, sf), _PAIRS)


_JOBS = f"""with {_CAMPAIGN_CTE}, k as (
 select * from (select matrix, topology, job, pair, median(seconds) as portable_s, median(seconds / iterations) as portable_s_per_iter, median(iterations) as pi from a group by all) join
 (select matrix, topology, job, pair, median(seconds) as native_s, median(seconds / iterations) as native_s_per_iter, median(iterations) as ni from b group by all) using (matrix, topology, job, pair) left join
 (select a.matrix, a.topology, a.job, a.pair, count(*) as rounds, min(a.seconds / b.seconds) as least_ratio, max(a.seconds / b.seconds) as most_ratio from a join b using (matrix, topology, job, pair, trial) group by all) using (matrix, topology, job, pair)),
jobs as (select matrix, topology, job, pair, portable_s, portable_s_per_iter, trunc(pi)::bigint as portable_iterations, native_s, native_s_per_iter, trunc(ni)::bigint as native_iterations, coalesce(rounds, 0) as rounds, least_ratio, most_ratio, portable_s / native_s as ratio, portable_s_per_iter / native_s_per_iter as per_iter_ratio from k)"""


@query("a14_job_pairs", _JOBS + " select * from jobs")
def _(spark, sf):
    return compare.job_pairs(_campaign(spark, sf), _PAIRS)


@query("a15_pair_cells", _JOBS + " select matrix, topology, pair, count(*) as allocations, median(ratio) as ratio, min(ratio) as least_ratio, max(ratio) as most_ratio, median(per_iter_ratio) as per_iter_ratio from jobs group by all")
def _(spark, sf):
    return compare.pair_cells(compare.job_pairs(_campaign(spark, sf), _PAIRS))


_PAIRED_HEAD = ("matrix     topo  pair                        job n  portable native_s  ratio      rounds  per-it", "", "per cell, median over allocations (portable / native; above 1.00 the portable side is slower):")


@query(
    "k4_paired_table",
    _JOBS
    + """ select printf('%-11s%-6s%-22s%9d %d  %8.2f %8.2f  %5.2f %11s  %6.2f', matrix, topology, pair, job, rounds, portable_s, native_s, ratio, case when rounds > 0 then printf('%.2f..%.2f', least_ratio, most_ratio) else '-' end, per_iter_ratio) as line from jobs
 union all select printf('  %-11s%-6s%-14s allocations=%d  time %.2f [%.2f..%.2f]  per-iteration %.2f', matrix, topology, pair, count(*), median(ratio), min(ratio), max(ratio), median(per_iter_ratio)) from jobs group by matrix, topology, pair
 union all values """
    + ", ".join(f"('{x}')" for x in _PAIRED_HEAD),
)
def _(spark, sf):
    jobs = compare.job_pairs(_campaign(spark, sf), _PAIRS)
    return spark.createDataFrame([(x,) for x in report.paired_lines(jobs, compare.pair_cells(jobs))], "line string")


@query("u2_label_set", f"with {_CAMPAIGN_CTE} select pair as pair, string_agg(distinct label, ',' order by label) as labels from (select pair, label from a union select pair, label from b) group by pair")
def _(spark, sf):
    """Of each pair, the labels that either side has runs of."""
    runs, pairs = _campaign(spark, sf), compare.pair_table(X.table(spark, sf, "region"), _PAIRS)
    sides = [runs.join(pairs.select("pair", F.col(side).alias("label")), "label").select("pair", "label") for side in ("portable", "native")]
    return sides[0].union(sides[1]).distinct().groupBy("pair").agg(F.array_join(F.array_sort(F.collect_list("label")), ",").alias("labels"))


# ---- log parsing

_LOGGED = """select event_id, cast(floor(value * 100) as bigint) as c from {events}"""


def _logged(spark: SparkSession, sf: str) -> DataFrame:
    return spark.sql(_LOGGED, events=X.table(spark, sf, "events"))


def _to_lines(rows: DataFrame, text) -> DataFrame:
    return matrix_market.lines_of(rows.select(F.format_string("%dn4g/v/suitesparse/M/e%d-stderr.txt", F.col("event_id") % 3 + 1, "event_id").alias("file"), text.alias("text")))


@query(
    "s5_parse_native",
    f"""select (event_id % 3 + 1) || 'n4g/v/suitesparse/M/e' || event_id || '-stderr.txt' as file, (event_id % 3 + 1) || 'n4g' as scale, 'v' as variant, 'M' as matrix, (event_id % 9 + 1)::int as ranks, 'mpi' as comm, c + 0.5::double as running_solver_s, (1000 + c)::int as iterations, (c + 1)::double + 0.25 as solver_time_s,
 2.5::double as allreduce_s, c as allreduce_calls, 8 * c as allreduce_bytes, 1.5::double as allreduce_us, 7::bigint as halo_calls, 4.5::double as halo_us, c * 1e8::double as residual_norm, 37.0::double as wall_s, case when event_id % 2 = 0 then 'mpi' end as command_communicator from ({_LOGGED.replace("{events}", "events")})""",
)
def _(spark, sf):
    rows = _logged(spark, sf)
    bare = F.when(F.col("event_id") % 4 == 0, F.concat(F.lit("running solver:\n 1.0 seconds\n"), F.col("c"), F.lit(".5 seconds\n77.5 seconds\n"))).otherwise(F.concat(F.lit("running solver: 3.0 seconds\nrunning solver: "), F.col("c"), F.lit(".5 seconds\n88.0 seconds\n")))
    thousand = F.concat(F.lit("  total iterations: "), F.format_number(F.col("c") + 1000, 0), F.lit("\n"))
    text = F.concat(
        F.col("event_id") % 9 + 1, F.lit(" MPI processes\nUsing MPI for communication\n"), bare, F.lit("  total iterations: 3\n"), thousand, F.lit("  total solver time: "), F.col("c") + 1, F.lit(".25 seconds\n  residual 2-norm: "), F.col("c"), F.lit("e+08\n  allreduce: 2.5 seconds/proc "), F.col("c"), F.lit(" times/proc "), F.col("c") * 8,
        F.lit(" B/proc  0.1 GB/s/proc 1.5 us/op/proc\n  haloexchange: 3.5 seconds/proc 7 times/proc 9 B/proc  0.1 GB/s/proc 2.0 msg/proc 4.5 us/msg/proc\n\tElapsed (wall clock) time (h:mm:ss or m:ss): 0:37.00\n"), F.when(F.col("event_id") % 2 == 0, '\tCommand being timed: "run --comm mpi x"\n').otherwise(""),
    )
    runs = logs.parse_native(_to_lines(rows, text), "native")
    return runs.select("file", "scale", "variant", "matrix", "ranks", "comm", "running_solver_s", "iterations", "solver_time_s", "allreduce_s", "allreduce_calls", "allreduce_bytes", "allreduce_us", "halo_calls", "halo_us", "residual_norm", "wall_s", "command_communicator")


@query(
    "s6_parse_portable",
    f"""select (event_id % 3 + 1) || 'n4g/v/suitesparse/M/e' || event_id || '-stderr.txt' as file, case when event_id % 5 = 0 then null else 8 end::int as ranks, case when event_id % 5 = 0 then 'unknown' else 'nccl' end as comm, case when event_id % 5 = 0 then null else event_id % 2 = 0 end as converged, case when event_id % 5 = 0 then null else c end::int as iterations,
 case when event_id % 5 = 0 then null when event_id % 3 = 0 then c + 9.5::double else c + 2.25::double end as solver_time_s, case when event_id % 5 = 0 then null else c + 1.5::double end as running_solver_s, case when event_id % 5 = 0 then null else 0.25::double end as p2p_s, case when event_id % 5 = 0 then null else 3 end::int as timing_schema,
 case when event_id % 5 = 0 then null else 4.0::double end as gemv_s, case when event_id % 5 = 0 then null else 2.0::double end as spmv_skew_s, case when event_id % 5 = 0 then null else (c + 10)::double / (c + 5) end as local_nnz_imbalance, null::double as ghosts_imbalance, 62.5::double as wall_s from ({_LOGGED.replace("{events}", "events")})""",
)
def _(spark, sf):
    rows = _logged(spark, sf)
    c = F.col("c")
    err = _to_lines(rows, F.lit("\tElapsed (wall clock) time (h:mm:ss or m:ss): 1:02.50\n"))
    section = F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("  solver_time: "), c + 9, F.lit(".5 seconds\n"))).otherwise("")
    text = F.concat(
        F.lit("ranks: 8\nsolver-collectives: oneccl\nsolver: converged="), F.when(F.col("event_id") % 2 == 0, "true").otherwise("false"), F.lit(" iterations="), c, F.lit(" residual=1e-6 solve_time="), c + 1, F.lit(".5s\ntiming: schema=3 setup_s=0.4 solver_max_s="), c + 2, F.lit(".25 solver_min_s=1.0\nwaits: pack_s=0.1 halo_s=0.25\nperformance_cuda_compatible:\n\n"),
        section, F.lit("  gemv: 4.0 seconds/proc 3 times/proc 8 B/proc  0.5 GB/s/proc\nother line\n  gemv: 9.0 seconds/proc 3 times/proc 8 B/proc  0.5 GB/s/proc\nsolver_diag_perf: spmv min_s=1.0 avg_s=2.0 max_s=3.0 skew_s=2.0\nsolver_diag_perf: solver min_s=1.0 avg_s=2.0 max_s=3.0 skew_s=9.0\nsolver_diag_partition: rank rows\nsolver_diag_partition: 0 10 "),
        c + 5, F.lit(" 77 12 7 6 9\nsolver_diag_partition: 1 10 "), c + 10, F.lit(" 151 18 0 11 14\n"),
    )
    some = rows.where("event_id % 5 <> 0")
    out = _to_lines(some, text).withColumn("file", F.regexp_replace("file", "stderr", "stdout"))
    runs = logs.parse_portable(err, out, "portable")
    return runs.select("file", "ranks", "comm", "converged", "iterations", "solver_time_s", "running_solver_s", "p2p_s", "timing_schema", "gemv_s", "spmv_skew_s", "local_nnz_imbalance", "ghosts_imbalance", "wall_s")


@query("s7_path_metadata", "select event_id, case event_id % 4 when 0 then '2n4g' when 1 then 'only.txt' when 2 then 'a' else 's' end as scale, case event_id % 4 when 0 then 'v' when 1 then 'unknown' when 2 then 'suitesparse' else 'b' end as variant, case event_id % 4 when 0 then 'M' when 1 then 'unknown' when 2 then 'unknown' else 'unknown' end as matrix from events")
def _(spark, sf):
    path = F.element_at(F.array(*map(F.lit, ("2n4g/v/suitesparse/M/x.txt", "only.txt", "a/suitesparse", "s/b/c/x.txt"))), (F.col("event_id") % 4 + 1).cast("int"))
    return X.table(spark, sf, "events").select("event_id", *[c.alias(n) for n, c in logs.path_metadata(path).items()])


@query("s4_discover_logs", "select 'd/run' || n_nationkey || '-stderr.txt' as file from nation where n_nationkey % 3 = 0")
def _(spark, sf):
    """Files of three kinds, written and found again."""
    root = f"{shared_dir(spark)}/discover-{uuid.uuid4().hex}"
    kinds = ("-stderr.txt", "-stderr.txt.tmp", "-stdout.txt")
    for r in X.table(spark, sf, "nation").select("n_nationkey").collect():
        write_text(spark, "x\n" if r[0] % 2 else "", f"{root}/d/run{r[0]}{kinds[r[0] % 3]}")
    return logs.discover(spark, root)


@query("f15_key_values", f"select event_id, c as iterations, 'b' as word, c + 1 as last from ({_LOGGED.replace('{events}', 'events')})")
def _(spark, sf):
    line = F.concat(F.lit("solver: iterations="), F.col("c"), F.lit(" word=b last=7 last="), F.col("c") + 1)
    return _logged(spark, sf).select("event_id", S.value_of(line, "iterations").cast("long").alias("iterations"), S.value_of(line, "word").alias("word"), S.value_of(line, "last").cast("long").alias("last"))


_PER_USER = "select user_id, event_id, row_number() over (partition by user_id order by event_id) - 1 as pos, event_type, value from {events}"


def _user_lines(spark: SparkSession, sf: str) -> DataFrame:
    """Events of a user as the lines of a file: errors head a section, views are indented, purchases are empty."""
    rows = spark.sql(_PER_USER, events=X.table(spark, sf, "events"))
    line = F.expr("case event_type when 'error' then 'alpha:' when 'signup' then 'beta:' when 'view' then concat('  v ', event_id) when 'purchase' then '' else concat('plain ', event_id) end")
    return rows.select(F.col("user_id").alias("file"), "pos", line.alias("line"), "event_id", "event_type", "value")


@query("w6_sections", f"select user_id as file, event_id, nullif(last_value(case event_type when 'error' then 'a' when 'signup' then 'b' when 'click' then '' end ignore nulls) over (partition by user_id order by event_id rows unbounded preceding), '') as section from ({_PER_USER.replace('{events}', 'events')}) qualify event_type not in ('error', 'signup')")
def _(spark, sf):
    return windows.sections(_user_lines(spark, sf), {"alpha:": "a", "beta:": "b"}).select("file", "event_id", "section")


@query(
    "w7_pending_value",
    f"""with l as (select *, sum(case when event_type in ('error', 'signup') then 1 else 0 end) over (partition by user_id order by event_id rows unbounded preceding) as g from ({_PER_USER.replace('{events}', 'events')})),
 o as (select user_id, g, max(case when event_type = 'error' then 1 else 0 end) as bare from l group by all), f as (select l.user_id, l.g, min(event_id) as event_id from l where event_type = 'view' group by all)
 select f.user_id as file, f.event_id, f.event_id as pending from f join o using (user_id, g) where bare = 1 and g > 0""",
)
def _(spark, sf):
    lines = _user_lines(spark, sf)
    value = F.when(F.col("event_type") == "view", F.col("event_id"))
    out = windows.pending_value(lines, F.col("line").isin("alpha:", "beta:"), F.col("line") == "alpha:", value, "pending")
    return out.where("pending is not null").select("file", "event_id", "pending")


def _one_file(spark: SparkSession, sf: str) -> DataFrame:
    """All events as the lines of one file."""
    line = F.expr("case event_type when 'error' then 'alpha:' when 'signup' then 'beta:' when 'view' then concat('  v ', event_id) when 'purchase' then '' else concat('plain ', event_id) end")
    return X.table(spark, sf, "events").select(F.lit("f").alias("file"), F.col("event_id").alias("pos"), line.alias("line"), "event_id", "event_type")


@query("w6_split_sections", "select event_id, nullif(last_value(case event_type when 'error' then 'a' when 'signup' then 'b' when 'click' then '' end ignore nulls) over (order by event_id rows unbounded preceding), '') as section from events qualify event_type not in ('error', 'signup')")
def _(spark, sf):
    """One file of all events, scanned in splits."""
    return windows.sections(_one_file(spark, sf), {"alpha:": "a", "beta:": "b"}, split=512).select("event_id", "section")


@query(
    "w7_split_pending",
    """with l as (select *, sum(case when event_type in ('error', 'signup') then 1 else 0 end) over (order by event_id rows unbounded preceding) as g from events),
 o as (select g, max(case when event_type = 'error' then 1 else 0 end) as bare from l group by g), f as (select g, min(event_id) as event_id from l where event_type = 'purchase' group by g)
 select event_id, event_id as pending from f join o using (g) where bare = 1 and g > 0""",
)
def _(spark, sf):
    """One file of all events; a purchase is rare enough that what waits for it often stands splits before."""
    value = F.when(F.col("event_type") == "purchase", F.col("event_id"))
    out = windows.pending_value(_one_file(spark, sf), F.col("line").isin("alpha:", "beta:"), F.col("line") == "alpha:", value, "pending", split=16)
    return out.where("pending is not null").select("event_id", "pending")


@query("w5_last_writer", "select user_id, arg_max(value, event_id) filter (where event_type = 'view') as last_view, arg_min(value, event_id) filter (where event_type = 'view') as first_view from events group by user_id")
def _(spark, sf):
    seen = F.when(F.col("event_type") == "view", F.col("value"))
    return X.table(spark, sf, "events").groupBy("user_id").agg(windows.last_writer(seen, F.col("event_id")).alias("last_view"), windows.first_writer(seen, F.col("event_id")).alias("first_view"))


@query("w8_run_order", "with k as (select o_orderkey as job, unnest([1, 2, 3]) as pos, unnest(['a', 'b', 'c']) as key from orders) select job, r as round, key, case when (r + job % 2) % 2 = 0 then 4 - pos else pos end as place from k, (select unnest([1, 2, 3, 4]) as r)")
def _(spark, sf):
    keys = X.table(spark, sf, "orders").select(F.col("o_orderkey").alias("job"), F.posexplode(F.array(F.lit("a"), F.lit("b"), F.lit("c"))).alias("pos", "key"))
    return windows.run_order(keys, 4, F.col("job"))


@query("s9_reference_report", "select n_nationkey + 4 as pos, n_name as dataset, '1n4g' as scale, 'mpi' as comm, n_nationkey as ranks, n_regionkey + 0.5::double as solver, case when n_nationkey % 2 = 0 then n_nationkey::double end as iterations from nation where n_nationkey % 5 <> 0")
def _(spark, sf):
    n = X.table(spark, sf, "nation")
    body = F.concat_ws(" | ", F.lit("|"), F.col("n_name"), F.lit("1n4g"), F.lit("mpi"), F.col("n_nationkey"), F.when(F.col("n_nationkey") % 5 == 0, "N/A").otherwise(F.concat(F.col("n_regionkey"), F.lit(".5"))), F.when(F.col("n_nationkey") % 2 == 0, F.col("n_nationkey").cast("string")).otherwise("N/A"), F.lit("|"))
    head = spark.createDataFrame([(0, "| Dataset | x |"), (1, "## Solver And Communication Summary"), (2, "| Dataset | Scale | Comm | Ranks | Solver s | Iters |"), (3, "| --- | --- | --- | --- | --- | --- |"), (1000, "## Other"), (1001, "| late | 1n1g | mpi | 1 | 2.0 | 3 |")], "pos int, line string")
    body = F.regexp_replace(F.regexp_replace(body, r"^\| \| ", "| "), r" \| \|$", " |")
    lines = head.unionByName(n.select((F.col("n_nationkey") + 4).cast("int").alias("pos"), body.alias("line"))).withColumn("file", F.lit("report"))
    return campaign.reference_table(lines)




@query("s10_event_log", "select date_trunc('second', ts) as time, event_id as job, '1n4g' as topology, (user_id % 5)::int as trial, case event_id % 3 when 0 then 'started' when 1 then 'ok' else 'failed' end as status, case event_id % 3 when 0 then null when 1 then 0 else 1 end::int as exit from events")
def _(spark, sf):
    e = X.table(spark, sf, "events")
    status = F.element_at(F.array(F.lit("started"), F.lit("ok"), F.lit("failed")), (F.col("event_id") % 3 + 1).cast("int"))
    exit_ = F.element_at(F.array(F.lit("-"), F.lit("0"), F.lit("1")), (F.col("event_id") % 3 + 1).cast("int"))
    raw = e.select(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("time"), F.col("event_id").cast("string").alias("job"), F.lit("1n4g").alias("topology"), F.lit("M").alias("matrix"), F.lit("l").alias("label"), (F.col("user_id") % 5).cast("string").alias("trial"), status.alias("status"), exit_.alias("exit"), F.lit("s").alias("stem"))
    return campaign.typed_events(raw).select("time", "job", "topology", "trial", "status", "exit")


@query("s10_run_states", "with e as (select user_id as job, min(event_id) as first_id, max(event_id) filter (where event_type in ('view', 'click')) as ended from events group by user_id) select e.job, case when ended is null then 'killed' when t.event_type = 'view' then 'ok' else 'failed' end as state from e left join events t on t.event_id = e.ended")
def _(spark, sf):
    e = X.table(spark, sf, "events")
    status = F.when(F.col("event_type") == "view", "ok").when(F.col("event_type") == "click", "failed").otherwise("started")
    events = e.select(F.col("event_id").alias("time"), F.col("user_id").alias("job"), F.lit("t").alias("topology"), F.lit("m").alias("matrix"), F.lit("l").alias("label"), F.lit(1).alias("trial"), status.alias("status"), F.lit(0).alias("exit"))
    return campaign.run_states(events).select("job", "state")


@query("s12_shared_objects", "select distinct '/lib/lib' || (event_id % 37) || '.so.' || (event_id % 3) as path from events where event_id % 2 = 0")
def _(spark, sf):
    e = X.table(spark, sf, "events")
    line = F.when(F.col("event_id") % 2 == 0, F.concat(F.lit("7f00-7f01 r-xp 0 08:01 12   /lib/lib"), F.col("event_id") % 37, F.lit(".so."), F.col("event_id") % 3)).otherwise("7f00-7f01 rw-p 0 00:00 0 [heap]")
    return campaign.shared_objects(e.select(line.alias("line")))


# ---- scalar rules

_CENTS = "(select *, cast(floor(value * 100) as bigint) as c from events)"


@query("f1_wall_clock", f"select event_id, case when event_id % 2 = 0 then (c % 60) * 60 + (event_id % 60) + 0.5::double else 3600 * (c % 24) + 60 * (event_id % 60) + 7.25::double end as seconds from {_CENTS}")
def _(spark, sf):
    text = F.when(F.col("event_id") % 2 == 0, F.concat(F.col("c") % 60, F.lit(":"), F.lpad((F.col("event_id") % 60).cast("string"), 2, "0"), F.lit(".50"))).otherwise(F.concat(F.col("c") % 24, F.lit(":"), F.lpad((F.col("event_id") % 60).cast("string"), 2, "0"), F.lit(":07.25")))
    return _logged(spark, sf).select("event_id", S.wall_clock(text).alias("seconds"))


@query("f2_number_text", f"select event_id, {_TEXT3.format('x')} as shown from (select event_id, case event_id % 4 when 0 then null when 1 then value * 123456.789 when 2 then value / 1234567.8 else value / 7 end as x from events)")
def _(spark, sf):
    x = F.expr("case event_id % 4 when 0 then null when 1 then value * cast(123456.789 as double) when 2 then value / cast(1234567.8 as double) else value / 7 end")
    return X.table(spark, sf, "events").select("event_id", S.number_text(x).alias("shown"))


@query("f4_f5_backend", f"with {X.RUNS_CTE} select event_id, comm from runs")
def _(spark, sf):
    return X.runs(spark, sf).select("event_id", "comm")


@query("f6_parse_number", f"select event_id, case when event_id % 3 = 0 then null else c + 0.25::double end as x from {_CENTS}")
def _(spark, sf):
    return _logged(spark, sf).select("event_id", S.parse_number(F.when(F.col("event_id") % 3 == 0, "N/A").otherwise(F.concat(F.col("c"), F.lit(".25")))).alias("x"))


@query("f7_f11_ratios", f"with {X.RUNS_CTE} select event_id, 100 * halo_s / nullif(wall_s, 0) as share, case when coalesce(error_norm, solver_time_s) is not null then coalesce(error_norm, 0) + coalesce(solver_time_s, 0) end as total, coalesce(nullif(spmv_s, 0), gemv_s) as first_true, 1000 * nullif(solver_time_s, 0) / nullif(iterations, 0) as ms_per_iter, wall_s / nullif(solver_time_s, 0) as ratio, nullif(wall_s, 0) / nullif(solver_time_s, 0) as ratio_both, case when comm <> 'nvshmem' then 100 * allreduce_s / nullif(solver_time_s, 0) end as share_own from runs")
def _(spark, sf):
    r = X.runs(spark, sf)
    c = F.col
    return r.select("event_id", S.percent(c("halo_s"), F.nullif(c("wall_s"), F.lit(0.0))).alias("share"), S.sum_values(c("error_norm"), c("solver_time_s")).alias("total"), S.first_true(c("spmv_s"), c("gemv_s")).alias("first_true"), S.ms_per_iter(c("solver_time_s"), c("iterations")).alias("ms_per_iter"), S.ratio(c("wall_s"), c("solver_time_s")).alias("ratio"), S.ratio(c("wall_s"), c("solver_time_s"), both=True).alias("ratio_both"), S.comm_share(c("allreduce_s"), c("solver_time_s"), S.decomposed("native", c("dataset"), c("comm"))).alias("share_own"))


@query("f14_first_number", f"select event_id, 1000 + c + 0.5::double as x, null::double as absent from {_CENTS}")
def _(spark, sf):
    text = F.concat(F.lit("a\n  total: "), F.format_number(F.col("c") + 1000, 0), F.lit(".5 seconds\n  total: 9 seconds"))
    return _logged(spark, sf).select("event_id", S.first_number(text, r"^\s*total: ([\d.,]+) seconds").alias("x"), S.first_number(text, r"^none: (\d+)").alias("absent"))


@query("f16_block_owner", f"with {X.OWNER_CTE} select i, rank, rank * base + least(rank, rest) as first_row from owner, dims")
def _(spark, sf):
    rows = X.rows(spark, sf)
    n = rows.count()
    return partition.row_block(rows, n, X.SIZE).select("i", "rank", S.block_first(F.col("rank"), n, X.SIZE).alias("first_row"))


@query("f17_fits_int32", "select o_orderkey, o_orderkey * 1000000 between 0 and 2147483647 as fits from orders")
def _(spark, sf):
    return X.table(spark, sf, "orders").select("o_orderkey", S.fits_int32(F.col("o_orderkey") * 1000000).alias("fits"))




@query("f18_topology", f"select event_id, case when ok then n end as nodes, case when ok then g end as gpus, case when ok then n * g end as ranks from (select event_id, (user_id % 12)::int as n, (event_id % 6)::int as g, event_id % 6 between 1 and 4 and user_id % 12 > 0 as ok from events)")
def _(spark, sf):
    e = X.table(spark, sf, "events")
    text = F.concat(F.col("user_id") % 12, F.lit("n"), F.col("event_id") % 6, F.lit("g"))
    nodes, gpus, ranks = S.topology(F.when(F.col("event_id") % 6 < 5, text).otherwise("bad"))
    return e.select("event_id", nodes.alias("nodes"), gpus.alias("gpus"), ranks.alias("ranks"))


@query("p9_topology_filter", "select event_id from events where event_id % 6 = 4 or user_id % 12 = 2")
def _(spark, sf):
    text = F.concat(F.col("user_id") % 12, F.lit("n"), F.col("event_id") % 6, F.lit("g"))
    return X.table(spark, sf, "events").where(S.matches_any(text, ["*n4g", "2n?g"])).select("event_id")


@query("f19_backend_keys", "select event_id, case event_id % 3 when 0 then 'none,native-none' when 1 then 'mpi,native-mpi,nccl' else 'mpi,native-mpi,nccl' end as keys from events")
def _(spark, sf):
    keys = F.array(*map(F.lit, ("mpi", "none", "native-mpi", "mpi", "native-none", "nccl")))
    ranks = F.element_at(F.array(F.lit(1), F.lit(4), F.lit(8)), (F.col("event_id") % 3 + 1).cast("int"))
    return X.table(spark, sf, "events").select("event_id", F.array_join(S.backend_keys(keys, ranks), ",").alias("keys"))


@query("f20_walltime", "select event_id, case when user_id % 5 = 0 and t > '00:30:00' then '00:30:00' else t end as walltime from (select *, printf('%02d:%02d:00', (q // 4)::int, ((q % 4) * 15)::int) as t from (select *, greatest(1, ceil((event_id % 100) * case when user_id % 16 >= 8 then 3 else 2 end / 15.0))::bigint as q from events))")
def _(spark, sf):
    e = X.table(spark, sf, "events")
    return e.select("event_id", S.clamp_debug(S.walltime(F.col("user_id") % 16, F.col("event_id") % 100), F.col("user_id") % 5 == 0).alias("walltime"))


@query("f21_parse_size", "select event_id, (user_id * case event_id % 4 when 0 then 1 when 1 then 1024 when 2 then 1048576 else 1073741824 end)::bigint as bytes, 3 as n_sizes, (user_id + 1536)::bigint as total from events")
def _(spark, sf):
    unit = F.element_at(F.array(F.lit(""), F.lit("kB"), F.lit("M"), F.lit("gb")), (F.col("event_id") % 4 + 1).cast("int"))
    sizes = S.parse_sizes(F.concat(F.col("user_id"), F.lit(",,1k,0.5K")))
    return X.table(spark, sf, "events").select("event_id", S.parse_size(F.concat(F.col("user_id"), unit)).alias("bytes"), F.size(sizes).alias("n_sizes"), F.aggregate(sizes, F.lit(0).cast("long"), lambda a, x: a + x).alias("total"))


@query("f22_bandwidth", f"select event_id, c::double / (event_id + 1) / 1000 as algbw, c::double / (event_id + 1) / 1000 * 2 * 7 / 8 as busbw, coalesce(1e6 * c / nullif(event_id % 5, 0), 0.0)::double as per_iter_us from {_CENTS}")
def _(spark, sf):
    c, us = F.col("c"), F.col("event_id") + 1
    return _logged(spark, sf).select("event_id", S.algorithm_bandwidth(c, us).alias("algbw"), S.bus_bandwidth(c, us, 8).alias("busbw"), S.per_iter_us(c, F.col("event_id") % 5).alias("per_iter_us"))


@query("f26_manufactured", "select p_partkey as i, ((p_partkey * 48271 + 3 * 69621) % 2147483647) / 2147483647.0::double * 2 - 1 as val from part")
def _(spark, sf):
    return X.rows(spark, sf).select("i", S.manufactured(F.col("i"), 3).alias("val"))


_STREAM = f"""with recursive first(k, w) as (select 0, 101::bigint union all select k + 1, case when x < 0 then x + {stream.MODULUS} else x end from (select k, {stream.MULTIPLIER} * w % {stream.MODULUS} as x from first) where k < 30),
state(n, l) as (select 31, (select list(w order by k) from first) union all
 select n + 1, list_append(l[2:31], case when n < 34 then l[1] else (l[1] + l[29]) % 4294967296 end) from state where n < (select count(*) from part) + 344),
raw as (select n - 345 as i, 2 * ((l[31] >> 1) / {stream.GREATEST}::double) - 1 as val from state where n > 344)
select i, round(val / sqrt((select sum(val * val) from raw)), 9) as val from raw"""


@query("f26_stream", _STREAM)
def _(spark, sf):
    """A solution from the stream of a C library, one value a row of the matrix."""
    return cg.exact_solution(X.rows(spark, sf), 101).select("i", F.round("val", 9).alias("val"))


# ---- metrics

@query("a6_rank_spread", " union all ".join(f"select l_linestatus, '{c}' as timer, min({c}) as min_s, round(avg({c}), 6) as avg_s, max({c}) as max_s, round(max({c}) - min({c}), 6) as skew_s from lineitem group by l_linestatus" for c in ("l_quantity", "l_discount", "l_tax")))
def _(spark, sf):
    out = summary.rank_spread(X.table(spark, sf, "lineitem"), ["l_quantity", "l_discount", "l_tax"], ["l_linestatus"])
    return out.withColumns({"avg_s": F.round("avg_s", 6), "skew_s": F.round("skew_s", 6)})


@query("k2_timer_lines", "select 'l_tax' as timer, 'solver_diag_perf: l_tax min_s=' || printf('%.6f', min(l_tax)) || ' avg_s=' || printf('%.6f', round(avg(l_tax), 4)) || ' max_s=' || printf('%.6f', max(l_tax)) || ' skew_s=' || printf('%.6f', max(l_tax) - min(l_tax)) as line from lineitem")
def _(spark, sf):
    out = summary.rank_spread(X.table(spark, sf, "lineitem"), ["l_tax"], [])
    return report.timer_lines(out.withColumn("avg_s", F.round("avg_s", 4)))


@query("a12_latency_percentiles", "select user_id, l[1] as min_us, l[(floor(0.5 * (n - 1)) + 1)::int] as p50_us, l[(floor(0.99 * (n - 1)) + 1)::int] as p99_us, l[n] as max_us from (select user_id, list_sort(list(value)) as l, count(*) as n from events group by user_id)")
def _(spark, sf):
    return summary.latency_percentiles(X.table(spark, sf, "events"), "value", ["user_id"])


@query("a12_whole_table", "select l[1] as least, l[(floor(0.5 * (n - 1)) + 1)::int] as mid, l[(floor(0.99 * (n - 1)) + 1)::int] as high, l[n] as most, n from (select list_sort(list(l_extendedprice)) as l, count(*) as n from lineitem)")
def _(spark, sf):
    """All rows as one group."""
    return quantiles.order_statistics(X.table(spark, sf, "lineitem"), [], "l_extendedprice", {"least": 0.0, "mid": 0.5, "high": 0.99, "most": 1.0})


@query("a13_probe_summary", "select max(p) as p50_max_us, max(p) - min(p) as p50_spread_us, bool_and(ok) as all_ok from (select list_sort(list(value))[(floor(0.5 * (count(*) - 1)) + 1)::int] as p, bool_and(value > 0) as ok from events group by user_id)")
def _(spark, sf):
    ranks = X.table(spark, sf, "events").groupBy("user_id").agg(summary.nearest_rank(F.col("value"), 0.5).alias("p50_us"), F.bool_and(F.col("value") > 0).alias("ok"))
    return summary.probe_summary(ranks)


@query("a18_mean_latency", "select event_type, max(m) as us, min(ok::int) = 1 as all_ok from (select event_type, user_id, round(avg(value), 6) as m, bool_and(value > 0.05) as ok from events group by all) group by event_type")
def _(spark, sf):
    ranks = X.table(spark, sf, "events").groupBy("event_type", "user_id").agg(F.round(F.avg("value"), 6).alias("mean_us"), F.bool_and(F.col("value") > 0.05).alias("ok"))
    return summary.mean_latency(ranks, ["event_type"])


# ---- sparse relations

@query("s2_u1_symmetric_expand", f"with {X.COO_CTE} select i, j, v from coo")
def _(spark, sf):
    return matrix_market.expand_symmetric(X.coo(spark, sf).where("i >= j"))


def _mm_lines(spark: SparkSession, sf: str) -> DataFrame:
    """The lower triangle as a Matrix Market file's lines, with a comment, an empty line and a tail that counts for nothing."""
    low = stash(X.coo(spark, sf).where("i >= j"), "mm-entries", free=False)
    n, nnz = X.rows(spark, sf).count(), low.count()
    placed = with_rank(low, "k", [F.col("i").asc(), F.col("j").asc()], partitions=X.tasks(spark, sf))
    body = placed.select((F.col("k") + 4).alias("pos"), F.concat_ws(" ", F.col("i") + 1, F.col("j") + 1, F.col("v")).alias("line"))
    head = spark.createDataFrame([(0, "%%MatrixMarket matrix coordinate real symmetric"), (1, "% made"), (2, ""), (3, f"{n} {n} {nnz}"), (nnz + 4, "left over"), (nnz + 5, "1 1 1")], "pos long, line string")
    return head.unionByName(body).withColumn("file", F.lit("m"))


@query("s1_p1_matrix_market", f"with {X.COO_CTE} select i, j, v from coo")
def _(spark, sf):
    lines = stash(_mm_lines(spark, sf), "mm-lines", free=False)
    head = matrix_market.header(lines)
    return matrix_market.expand_symmetric(matrix_market.entries(lines, head).select("i", "j", "v"))


@query("s3_partition_vector", "select p_partkey as i, (p_partkey * 7 % 4)::int as rank from part")
def _(spark, sf):
    rows = X.rows(spark, sf)
    n = rows.count()
    body = rows.select((F.col("i") + 3).cast("int").alias("pos"), (F.col("i") * 7 % 4 + 1).cast("string").alias("line"))
    head = spark.createDataFrame([(0, "%%MatrixMarket vector array integer general"), (1, "% comment"), (2, str(n))], "pos int, line string")
    return matrix_market.partition_vector(head.unionByName(body).withColumn("file", F.lit("p")), n, 4)


@query("a3_w1_row_ptr", f"with {X.COO_CTE} select p_partkey as i, coalesce(n, 0) as n, coalesce(sum(n) over (order by p_partkey rows between unbounded preceding and 1 preceding), 0)::bigint as row_ptr from part left join (select i, count(*) as n from coo group by i) on i = p_partkey")
def _(spark, sf):
    return partition.row_ptr(X.coo(spark, sf), X.rows(spark, sf))


@query("o1_csr", f"with {X.COO_CTE} select i, string_agg(j || ':' || v::bigint, ',' order by j) as row from coo group by i")
def _(spark, sf):
    return partition.to_csr(X.coo(spark, sf)).select("i", F.array_join(F.zip_with("cols", "vals", lambda j, v: F.concat_ws(":", j, v.cast("long"))), ",").alias("row"))


@query("j3_p2_interior_halo", f"with {X.OWNED_CTE} select i, j, v, row_rank, col_rank, kind from owned")
def _(spark, sf):
    return _owned(spark, sf)[2].select("i", "j", "v", "row_rank", "col_rank", "kind")


@query("j3_given_owners", f"with {X.COO_CTE}, own as (select p_partkey as i, (p_partkey * 7 % 4)::int as rank from part) select c.i, c.j, r.rank as row_rank, k.rank as col_rank, case when r.rank = k.rank then 'interior' else 'halo' end as kind from coo c join own r on c.i = r.i join own k on c.j = k.i")
def _(spark, sf):
    owner = X.rows(spark, sf).select("i", (F.col("i") * 7 % 4).cast("int").alias("rank"))
    return partition.with_owners(X.coo(spark, sf), owner).select("i", "j", "row_rank", "col_rank", "kind")


@query("w2_j4_local_index", f"with {X.OWNER_CTE} select i, rank, row_number() over (partition by rank order by i) - 1 as local from owner")
def _(spark, sf):
    return partition.local_index(_owned(spark, sf)[1])


@query("a4_halo_imports", f"with {X.OWNED_CTE} select rank, peer, j from imports")
def _(spark, sf):
    return partition.halo_imports(_owned(spark, sf)[2])


@query("a4_halo_exports", f"with {X.OWNED_CTE} select peer as rank, rank as peer, j from imports")
def _(spark, sf):
    return partition.halo_exports(_owned(spark, sf)[2])


_GHOST = "g as (select *, row_number() over (partition by rank order by peer, j) - 1 as ghost from imports)"


@query("w3_ghost_index", f"with {X.OWNED_CTE}, {_GHOST} select *, min(ghost) over (partition by rank, peer) as ghost_offset from g")
def _(spark, sf):
    return partition.ghost_index(partition.halo_imports(_owned(spark, sf)[2]))


@query("j5_local_entries", f"with {X.OWNED_CTE}, {_GHOST}, l as (select i, rank, row_number() over (partition by rank order by i) - 1 as local from owner) select row_rank as rank, kind, a.local as row, case when kind = 'interior' then b.local else ghost end as col, v from owned o join l a on o.i = a.i join l b on o.j = b.i left join g on g.rank = row_rank and g.j = o.j")
def _(spark, sf):
    _, owner, owned = _owned(spark, sf)
    return partition.local_entries(owned, partition.local_index(owner), partition.ghost_index(partition.halo_imports(owned)))


@query("p3_active_halo_rows", f"with {X.OWNED_CTE} select distinct row_rank as rank, i from owned where kind = 'halo'")
def _(spark, sf):
    return partition.active_halo_rows(_owned(spark, sf)[2])


@query("p4_adjacency", f"with {X.COO_CTE} select distinct i, j from coo where i <> j")
def _(spark, sf):
    rows = X.rows(spark, sf)
    return partition.adjacency(X.coo(spark, sf), rows.count())


@query("p5_pack", f"with {X.OWNED_CTE}, l as (select i, row_number() over (partition by rank order by i) - 1 as local from owner) select m.peer as rank, m.rank as peer, m.j, local, (m.j % 7 - 3)::double as val from imports m join l on l.i = m.j")
def _(spark, sf):
    rows, owner, owned = _owned(spark, sf)
    return partition.pack(partition.halo_exports(owned), partition.local_index(owner), X.vector(rows))


_STATS = f"""with {X.OWNED_CTE}, st as (select * from (select rank, count(*) as local_rows from owner group by rank) left join (select row_rank as rank, count(*) as local_nnz, count(*) filter (where kind = 'interior') as interior_nnz, count(*) filter (where kind = 'halo') as halo_nnz from owned group by all) using (rank)
 left join (select rank, count(*) as ghosts, count(*) as imports from imports group by all) using (rank) left join (select peer as rank, count(*) as exports from imports group by all) using (rank))"""


@query("a5_partition_stats", _STATS + " select * from st")
def _(spark, sf):
    _, owner, owned = _owned(spark, sf)
    return partition.stats(owner, owned)


@query("k2_rank_lines", _STATS + " select rank, 'solver_diag_partition: ' || concat_ws(' ', rank, local_rows, local_nnz, interior_nnz, halo_nnz, ghosts, imports, exports) as line from st")
def _(spark, sf):
    _, owner, owned = _owned(spark, sf)
    return report.rank_lines(partition.stats(owner, owned))


@query("a7_imbalance", _STATS + " select " + ", ".join(f"case when min({c}) > 0 then max({c}) / min({c}) end as {c}_imbalance" for c in ("local_nnz", "halo_nnz", "ghosts", "imports", "exports")) + " from st")
def _(spark, sf):
    _, owner, owned = _owned(spark, sf)
    return partition.imbalance(partition.stats(owner, owned), ["local_nnz", "halo_nnz", "ghosts", "imports", "exports"], [])


@query("a16_partition_verify", "select count(*) as n, min(p) as least, max(p) as most, count(distinct p) as used, min(p) >= 1 and max(p) <= 4 and count(distinct p) = 4 as ok from (select (p_partkey * 7 % 4 + 1)::int as p from part)")
def _(spark, sf):
    rows = X.rows(spark, sf)
    return partition.verify(rows.select("i", (F.col("i") * 7 % 4 + 1).cast("int").alias("part")), rows.count(), 4)


@query("a17_flops", _STATS + " select sum(2 * local_rows + 18 * (2 * local_nnz + 11 * local_rows))::bigint as flops from st")
def _(spark, sf):
    _, owner, owned = _owned(spark, sf)
    return partition.stats(owner, owned).agg(linalg.total_flops(F.col("local_rows"), F.col("local_nnz"), F.lit(18)).alias("flops"))


@query("a20_edge_cut", f"with {X.OWNED_CTE} select (count(*) filter (where kind = 'halo') // 2)::bigint as edge_cut from owned")
def _(spark, sf):
    return partition.edge_cut(_owned(spark, sf)[2])


@query("a19_distinct_parts", f"with {X.OWNER_CTE} select distinct rank from owner")
def _(spark, sf):
    return _owned(spark, sf)[1].select("rank").distinct()


# ---- linear algebra


def _by_column(spark: SparkSession, sf: str, n: int) -> DataFrame:
    """The matrix dealt for products with a vector of ``n`` rows: by column where that is not broadcast, so that entries move once."""
    return X.coo(spark, sf, "i" if linalg.is_broadcast(n) else "j")


_SPMV = f"with {X.COO_CTE} select i, sum(v * (j % 7 - 3)::double) as val from coo group by i"


@query("j1_spmv", _SPMV)
def _(spark, sf):
    rows = X.rows(spark, sf)
    n = rows.count()
    return linalg.spmv(_by_column(spark, sf, n), X.vector(rows), rows, n, X.tasks(spark, sf), dealt=True)


@query("j2_split_spmv", _SPMV)
def _(spark, sf):
    rows = X.rows(spark, sf)
    n = rows.count()
    owned = partition.with_block_owners(_by_column(spark, sf, n), n, X.SIZE)
    return linalg.split_spmv(owned, X.vector(rows), rows, n, X.tasks(spark, sf), dealt=True)


@query("a1_a2_dot_norm", "select round(sum(c_acctbal * c_nationkey), 4) as dot, round(sqrt(sum(c_acctbal * c_acctbal)), 4) as norm from customer")
def _(spark, sf):
    return X.table(spark, sf, "customer").agg(F.round(linalg.dot(F.col("c_acctbal"), F.col("c_nationkey")), 4).alias("dot"), F.round(linalg.norm(F.col("c_acctbal")), 4).alias("norm"))


@query("j13_solution_error", "select round(sqrt(sum((c_acctbal - c_nationkey) ** 2) / sum(c_nationkey ** 2)), 6) as error from customer")
def _(spark, sf):
    c = X.table(spark, sf, "customer")
    got = linalg.solution_error(c.select(F.col("c_custkey").alias("i"), F.col("c_acctbal").alias("val")), c.select(F.col("c_custkey").alias("i"), F.col("c_nationkey").cast("double").alias("val")))
    return got.select(F.round("error", 6).alias("error"))


@query("j14_true_residual", f"with {X.COO_CTE}, ax as (select i, sum(v * (j % 7 - 3)::double) as y from coo group by i) select round(sqrt(sum((1 - y) ** 2)), 6) as residual_norm, round(sqrt(count(*)), 6) as rhs_norm, round(sqrt(sum((1 - y) ** 2)) / sqrt(count(*)), 6) as true_rel_residual from ax")
def _(spark, sf):
    rows = X.rows(spark, sf)
    n = rows.count()
    out = linalg.residual(_by_column(spark, sf, n), X.vector(rows), rows.select("i", F.lit(1.0).alias("val")), rows, n, X.tasks(spark, sf), dealt=True)
    return out.select(*[F.round(c, 6).alias(c) for c in out.columns])


def _cg_sql(steps: int) -> str:
    ctes = [X.COO_CTE, "x0 as materialized (select i, 0.0::double as x, y as r, y as s from (select i, sum(v * (j % 7 - 3)::double) as y from coo group by i))", "rho0 as (select sum(r * r) as rho from x0)"]
    for k in range(steps):
        ctes += [
            f"t{k} as materialized (select c.i, sum(c.v * s) as t from coo c join x{k} on c.j = x{k}.i group by c.i)",
            f"al{k} as (select rho / (select sum(s * t) from x{k} join t{k} using (i)) as alpha from rho{k})",
            f"m{k} as materialized (select i, x + alpha * s as x, r - alpha * t as r, s from x{k} join t{k} using (i), al{k})",
            f"rho{k + 1} as (select sum(r * r) as rho from m{k})",
            f"x{k + 1} as materialized (select i, x, r, (select rho from rho{k + 1}) / (select rho from rho{k}) * s + r as s from m{k})",
        ]
    return "with " + ",\n".join(ctes) + f" select i, round(x, 6) as x from x{steps}"


@query("f23_i1_cg_three_steps", _cg_sql(3))
def _(spark, sf):
    rows = X.rows(spark, sf)
    x, _ = cg.solve(X.coo(spark, sf), rows, solution=X.vector(rows), max_iters=3)
    return x.select("i", F.round("val", 6).alias("x"))


def _given(rows: DataFrame) -> DataFrame:
    return rows.select("i", (F.col("i") * 7 % 4).cast("int").alias("rank"))


@query("i1_ghost_steps", _cg_sql(3))
def _(spark, sf):
    """Three steps over an owner map that scatters the rows, by exchanging ghosts."""
    rows, coo = X.rows(spark, sf), X.coo(spark, sf)
    x, _ = cg.solve(coo, rows, solution=X.vector(rows), max_iters=3, owner=_given(rows))
    return x.select("i", F.round("val", 6).alias("x"))


@query("i1_ghost_traffic", f"with {X.COO_CTE}, own as (select p_partkey as i, (p_partkey * 7 % 4)::int as rank from part) select k.rank, r.rank as \"to\", count(distinct j) as n from coo c join own r on c.i = r.i join own k on c.j = k.i where r.rank <> k.rank group by all")
def _(spark, sf):
    """Values that an iteration sends from rank to rank: the ghosts, once each."""
    coo = stash(X.coo(spark, sf), "query-coo", free=False)
    owner, homes = ghosts.split_ranks(coo, _given(X.rows(spark, sf)))
    return ghosts.Layout(coo, owner).traffic(homes)


@query("i3_multilevel", f"with {X.COO_CTE}, {X.OWNER_CTE}, cut as (select count(*) // 2 as block_cut from coo c join owner r on c.i = r.i join owner k on c.j = k.i where r.rank <> k.rank) select count(*) as n, {X.SIZE} as parts, block_cut, true as balanced, true as cuts_less from part, cut group by block_cut")
def _(spark, sf):
    """The matrix's graph in four parts: whether they are within the balance bound, and cut fewer edges than blocks of rows."""
    rows, coo = X.rows(spark, sf), stash(X.coo(spark, sf), "query-coo")
    owner = stash(partition.build(coo, rows, X.SIZE, "metis"), "query-owner")
    n = rows.count()
    weights = owner.groupBy("rank").count().agg(F.max("count").alias("most"), F.count("*").alias("parts"), F.sum("count").alias("n"))
    near = F.broadcast(owner) if n <= multilevel.BROADCAST_ROWS else owner
    cut = partition.edge_cut(partition.with_owners(coo, near)).select(F.col("edge_cut").alias("cut"))
    block = partition.edge_cut(partition.with_block_owners(coo, n, X.SIZE)).select(F.col("edge_cut").alias("block_cut"))
    row = weights.join(cut).join(block)
    bound = max(-(-n // X.SIZE), int(multilevel.BALANCE * n / X.SIZE))
    return row.select("n", "parts", "block_cut", (F.col("most") <= bound).alias("balanced"), (F.col("cut") < F.col("block_cut")).alias("cuts_less"))


@query("i1_cg_solve", "select p_partkey as i, (p_partkey % 7 - 3)::double as x from part")
def _(spark, sf):
    """The solution of A x = A x*, to two places, which is x*."""
    rows = X.rows(spark, sf)
    x, _ = cg.solve(X.coo(spark, sf), rows, solution=X.vector(rows), rtol=1e-6, max_iters=200)
    return x.select("i", (F.round("val", 2) + 0.0).alias("x"))


def _chain(spark: SparkSession) -> tuple[DataFrame, DataFrame]:
    """A small matrix for the rules of the solver, 4 on the diagonal and -1 beside it, and its rows."""
    rows = spark.range(8).select(F.col("id").alias("i"))
    near = rows.select("i", F.explode(F.array(F.col("i") - 1, F.col("i"), F.col("i") + 1)).alias("j")).where("j between 0 and 7")
    return near.select("i", "j", F.when(F.col("i") == F.col("j"), 4.0).otherwise(-1.0).alias("v")), rows


@query("i2_p11_warmup_and_log", "select unnest([2, 4]) as k, 0.0::double as difference")
def _(spark, sf):
    """Residuals that are logged every second iteration, with and without warm-up iterations before."""
    coo, rows = _chain(spark)
    plain, warm = (dict(cg.solve(coo, rows, rtol=0.0, max_iters=5, log_every=2, warmup=w)[1].history) for w in (0, 3))
    return spark.createDataFrame([(k, round(abs(plain[k] - warm.get(k, -1.0)), 9)) for k in plain], "k int, difference double")


@query("f25_i4_errors", "select unnest(['empty partition', 'indefinite', 'not finite']) as fault, true as raised")
def _(spark, sf):
    """What must raise: a rank without rows, a negative definite matrix, an entry that is not finite."""
    coo, rows = _chain(spark)

    def raises(kind: type[Exception], run: Callable) -> bool:
        try:
            run()
        except kind:
            return True
        return False

    faults = {
        "empty partition": raises(ValueError, lambda: partition.build(coo, rows, 9)),
        "indefinite": raises(cg.Breakdown, lambda: cg.solve(coo.withColumn("v", -F.col("v")), rows, rtol=1e-6)),
        "not finite": raises(cg.Breakdown, lambda: cg.solve(coo.withColumn("v", F.when(F.col("i") == 0, float("nan")).otherwise(F.col("v"))), rows, rtol=1e-6)),
    }
    return spark.createDataFrame(list(faults.items()), "fault string, raised boolean")


@query("k1_report_lines", "select 8 as ranks, true as converged, 3 as timing_schema, true as small")
def _(spark, sf):
    """A solve's printed lines, read back by the log parser."""
    coo, rows = _chain(spark)
    _, result = cg.solve(coo, rows, rtol=1e-8)
    out = spark.createDataFrame([("1n8g/v/suitesparse/M/a-stdout.txt", p, x) for p, x in enumerate(["ranks: 8", *cg.report_lines(result)])], "file string, pos int, line string")
    err = spark.createDataFrame([("1n8g/v/suitesparse/M/a-stderr.txt", 0, "")], "file string, pos int, line string")
    read = logs.parse_portable(err, out, "own")
    return read.select("ranks", "converged", "timing_schema", ((F.col("iterations") == result.iterations) & (F.col("true_rel_residual") < 1e-6) & (F.col("solver_time_s") > 0)).alias("small"))


@query("i3_build", "select p_partkey as i, (p_partkey * 7 % 4)::int as rank from part")
def _(spark, sf):
    rows = X.rows(spark, sf)
    return partition.build(X.coo(spark, sf), rows, 4, "file", rows.select("i", (F.col("i") * 7 % 4).cast("int").alias("rank")))


@query("p12_positive_flag", "select unnest(['', '-1', '0', '12', 'x', ' 7 ']) as text, unnest([0, 0, 0, 12, 0, 7]) as flag")
def _(spark, sf):
    return spark.createDataFrame([(t, S.positive_flag(t)) for t in ("", "-1", "0", "12", "x", " 7 ")], "text string, flag int")


# ---- campaign files


def _folder(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


def _event_rows(spark: SparkSession, sf: str) -> DataFrame:
    e = X.table(spark, sf, "events")
    status = F.element_at(F.array(F.lit("started"), F.lit("ok"), F.lit("failed")), (F.col("event_id") % 3 + 1).cast("int"))
    return e.select(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("time"), F.col("user_id").alias("job"), F.lit("1n4g").alias("topology"), F.lit("M").alias("matrix"), F.lit("l").alias("label"), F.col("event_id").cast("int").alias("trial"), status.alias("status"), F.when(status != "started", F.lit(0)).alias("exit"), F.lit("s").alias("stem"))


_EVENTS_SQL = "select user_id as job, event_id::int as trial, case event_id % 3 when 0 then 'started' when 1 then 'ok' else 'failed' end as status, case when event_id % 3 <> 0 then 0 end::int as exit from events"


@query("k5_event_append", _EVENTS_SQL)
def _(spark, sf):
    """Events appended in two writes and read back."""
    path, rows = _folder(spark, "events"), _event_rows(spark, sf)
    for k in (0, 1):
        campaign.append_events(rows.where(F.col("trial") % 2 == k), path)
    return campaign.read_events(spark, path).select("job", "trial", "status", "exit")


@query("s10_event_stream", "select date_trunc('hour', ts) as start, status, count(*) as n from (select ts, case event_id % 3 when 0 then 'started' when 1 then 'ok' else 'failed' end as status from events) group by all")
def _(spark, sf):
    """The appended events as a stream, all that is there in one run, counted by hour and status."""
    path = _folder(spark, "stream")
    campaign.append_events(_event_rows(spark, sf).coalesce(1), f"{path}/in")
    counts = events.status_counts(events.stream_events(spark, f"{path}/in"), late="36500 days")
    name = f"counts_{uuid.uuid4().hex}"
    counts.writeStream.outputMode("complete").format("memory").queryName(name).trigger(availableNow=True).option("checkpointLocation", f"{path}/state").start().awaitTermination()
    return spark.table(name).select("start", "status", "n")


@query("s11_resolve", "select unnest(['explicit', 'first there', 'explicit missing', 'none there']) as asked, unnest(['b', 'a', 'error', 'error']) as found")
def _(spark, sf):
    root = _folder(spark, "resolve")
    for name in ("a", "b"):
        write_text(spark, name, f"{root}/{name}")

    def found(explicit: str | None, candidates: list[str]) -> str:
        try:
            return campaign.resolve(spark, explicit and f"{root}/{explicit}", [f"{root}/{c}" for c in candidates]).rsplit("/", 1)[1]
        except FileNotFoundError:
            return "error"

    rows = [("explicit", found("b", ["a"])), ("first there", found(None, ["none", "a", "b"])), ("explicit missing", found("none", ["a"])), ("none there", found(None, ["none"]))]
    return spark.createDataFrame(rows, "asked string, found string")


@query("k6_provenance", "select unnest(['a=1', 'my.password=***', 'nodes=2']) as line")
def _(spark, sf):
    path = _folder(spark, "provenance")
    campaign.provenance(spark, {"nodes": "2", "a": "1", "my.password": "open"}, path)
    return spark.read.text(path).where("not startswith(value, 'spark:')").select(F.col("value").alias("line"))


@query("k7_promote", "select unnest(['kept', 'moved']) as run, unnest(['kept.tmp', 'moved']) as name")
def _(spark, sf):
    root = _folder(spark, "promote")
    for run, succeeded in (("kept", False), ("moved", True)):
        write_text(spark, run, f"{root}/{run}.tmp")
        campaign.promote(spark, f"{root}/{run}.tmp", f"{root}/{run}", succeeded)
    return matrix_market.read_texts(spark, root).select(F.col("text").alias("run"), F.substring_index("file", "/", -1).alias("name"))


@query("j16_placement", "select unnest(range(4)) as rank, true as placed")
def _(spark, sf):
    """Rank and line of four tasks; hosts differ from run to run, so only the line's form is returned."""
    return campaign.placement(spark, 4).select("rank", F.expr("line rlike concat('^rank ', rank, ': host=[^ ]+ gpu=', rank, ' device=.+$')").alias("placed"))
