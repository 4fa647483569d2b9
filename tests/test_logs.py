"""Log parsers, summaries, comparisons and reports over files."""

import pytest
from pyspark.sql import functions as F

from lattica.operators import compare, summary
from lattica.plans import report
from lattica.sources import campaign, logs, matrix_market

NATIVE = """6 MPI processes
Using MPI for communication
running solver: 3.25 seconds
  total iterations: 1,208
  total solver time: 2.75 seconds
  residual 2-norm: 7.5e-03
  allreduce: 0.5 seconds/proc 17 times/proc 136 B/proc 0.0 GB/s/proc 21.0 us/op/proc
Elapsed (wall clock) time (h:mm:ss or m:ss): 1:04.00
"""
CURRENT = """ranks: 12
solver-collectives: oneccl
solver: converged=true iterations=77 residual=4e-5 solve_time=1.75s
timing: schema=3 setup_s=0.125 warmup_s=0.0625 solver_s=1.5 solver_max_s=1.625 solver_min_s=1.375 per_iter_us=21104.0 validation_s=0.75
waits: pack_s=0.03125 halo_s=0.5 allreduce_s=0.25 readback_s=0.375
validation: true_residual=2.0e-02 true_rel_residual=6.25e-05 recurrence_rel_residual=6.0e-05
"""
LEGACY = """ranks: 2
mpi-mode: gpu-aware
solver_diag_perf: spmv min_s=2.5 avg_s=3.0 max_s=4.0 skew_s=1.5
solver_diag_perf: halo_spmv min_s=0.25 avg_s=0.5 max_s=0.875 skew_s=0.625
solver_diag_perf: solver min_s=2.5 avg_s=3.0 max_s=4.0 skew_s=1.5
solver_diag_partition: rank local_rows local_nnz interior_nnz halo_nnz ghosts imports exports
solver_diag_partition: 0 31 64 60 4 8 3 5
solver_diag_partition: 1 31 96 84 12 10 12 15
solver: converged=true iterations=54 residual=3.5e-4 rel_residual_r0=1.25e-6 rel_residual_rhs=2.5e-6 relative_error=0.375 gflops=11.5 solve_time=6.5s
performance_cuda_compatible:
  flop_rate: 13.0 Gflop/s
  solver_time: 6.75 seconds
  gemv: 1.25 seconds/proc 54 times/proc 32 B/proc 2.0 GB/s/proc
  allreduce: 0.625 seconds/proc 108 times/proc 864 B/proc 0.2 GB/s/proc 5.75 us/op/proc

performance_sycl_overheads:
  pack: 0.0625 seconds/proc 54 times/proc 32 B/proc 2.0 GB/s/proc
  other: 0.21875 seconds
performance_sycl_native:
  spmv: 1.375 seconds/proc 54 times/proc 32 B/proc 2.0 GB/s/proc
"""


def write(root, name, text):
    path = root / name
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(text)


def test_native_file(spark, tmp_path):
    write(tmp_path, "1n4g/cg-mpi/suitesparse/Bump/run-1-stderr.txt", NATIVE)
    write(tmp_path, "1n4g/cg-mpi/suitesparse/Bump/run-2-stderr.txt.tmp", NATIVE)
    assert [r[0] for r in logs.discover(spark, str(tmp_path)).collect()] == ["1n4g/cg-mpi/suitesparse/Bump/run-1-stderr.txt"]
    r = logs.read_runs(spark, str(tmp_path), "CUDA").first()
    assert (r["dataset"], r["scale"], r["variant"], r["matrix"], r["comm"], r["ranks"]) == ("CUDA", "1n4g", "cg-mpi", "Bump", "mpi", 6)
    assert (r["iterations"], r["solver_time_s"], r["running_solver_s"], r["allreduce_calls"], r["residual_norm"], r["wall_s"]) == (1208, 2.75, 3.25, 17, 7.5e-3, 64.0)


def test_portable_files(spark, tmp_path):
    write(tmp_path, "2n4g/v/suitesparse/M/a-stderr.txt", "")
    write(tmp_path, "2n4g/v/suitesparse/M/a-stdout.txt", CURRENT)
    write(tmp_path, "1n4g/w/suitesparse/M/b-stderr.txt", '\tCommand being timed: "x --mpi-mode gpu-aware"\n\tElapsed (wall clock) time (h:mm:ss or m:ss): 0:18.25\n')
    write(tmp_path, "1n4g/w/suitesparse/M/b-stdout.txt", LEGACY)
    write(tmp_path, "1n1g/s/suitesparse/M/c-stderr.txt", "x\n")
    write(tmp_path, "1n1g/s/suitesparse/M/c-stdout.txt", "ranks: 1\nsolver-collectives: mpi\n")
    write(tmp_path, "4n4g/x/other/d-stderr.txt", "x\n")
    rows = {r["scale"]: r for r in logs.read_runs(spark, str(tmp_path), "SYCL", "portable").collect()}
    a, b, c, d = (rows[k] for k in ("2n4g", "1n4g", "1n1g", "4n4g"))
    assert (a["comm"], a["timing_schema"], a["setup_s"], a["warmup_s"], a["loop_s"], a["loop_max_s"], a["solver_time_s"]) == ("nccl", 3, 0.125, 0.0625, 1.5, 1.625, 1.625)
    assert (a["pack_s"], a["p2p_s"], a["allreduce_s"], a["host_sync_s"], a["true_rel_residual"]) == (0.03125, 0.5, 0.25, 0.375, 6.25e-5)
    assert (b["comm"], b["wall_s"], b["converged"], b["iterations"], b["error_norm"], b["running_solver_s"], b["solver_time_s"], b["gflops"]) == ("mpi", 18.25, True, 54, 0.375, 6.5, 6.75, 13.0)
    assert (b["gemv_s"], b["allreduce_us"], b["pack_s"], b["other_s"], b["spmv_s"], b["spmv_skew_s"], b["halo_spmv_skew_s"]) == (1.25, 5.75, 0.0625, 0.21875, 1.375, 1.5, 0.625)
    assert (b["local_nnz_imbalance"], b["halo_nnz_imbalance"], b["ghosts_imbalance"], b["imports_imbalance"], b["exports_imbalance"]) == (1.5, 3.0, 1.25, 4.0, 3.0)
    assert c["comm"] == "none"
    assert (d["matrix"], d["ranks"], d["comm"]) == ("unknown", None, "unknown")


def runs_of(spark, rows):
    schema = logs.RUN_SCHEMA
    base = {f.name: None for f in schema} | {"dataset": "SYCL", "file": "run-stderr.txt", "scale": "1n4g", "variant": "v", "matrix": "M", "ranks": 4, "communicator": "gpu-aware"}
    df = spark.createDataFrame([tuple((base | r)[f.name] for f in schema) for r in rows], schema)
    from lattica.functions.scalars import comm

    return df.withColumn("comm", comm(F.col("command_communicator"), F.col("communicator")))


def test_summary_of_two_runs(spark):
    runs = runs_of(spark, [{"converged": True, "solver_time_s": 10.0, "iterations": 100, "allreduce_calls": 200}, {"converged": False, "solver_time_s": 14.0, "iterations": 140, "allreduce_calls": 400}])
    r = summary.summarize(runs).first()
    assert (r["comm"], r["repeats"], r["converged_repeats"], r["runtime_solver_s_median"], r["runtime_solver_s_min"], r["runtime_solver_s_max"], r["runtime_ms_per_iter"], r["operations_allreduce_calls_median"]) == ("mpi", 2, 1, 12.0, 10.0, 14.0, 100.0, 300.0)
    assert r["operations_halo_s_count"] == 0 and r["operations_halo_s_median"] is None


def test_summary_groups_and_null_ranks(spark):
    runs = runs_of(spark, [{"ranks": None}, {"ranks": None}, {"scale": "2n4g", "ranks": 8}, {"communicator": "host"}])
    got = {(r["scale"], r["comm"], r["ranks"]): r["repeats"] for r in summary.summarize(runs).collect()}
    assert got == {("1n4g", "mpi", None): 2, ("2n4g", "mpi", 8): 1, ("1n4g", "none", 4): 1}


def test_best_treats_zero_as_missing(spark):
    runs = runs_of(spark, [{"solver_time_s": 0.0}, {"variant": "w", "communicator": "oneccl", "solver_time_s": 5.0}])
    assert summary.best_by_scale(summary.summarize(runs)).first()["comm"] == "nccl"


def test_cross_dataset_null_ranks_and_last_variant(spark):
    runs = runs_of(spark, [{"dataset": "A", "ranks": None, "solver_time_s": 6.0}, {"dataset": "B", "ranks": None, "variant": "v", "solver_time_s": 2.0}, {"dataset": "B", "ranks": None, "variant": "w", "solver_time_s": 3.0}])
    rows = compare.cross_dataset(summary.summarize(runs)).collect()
    assert [(r["baseline"], r["compared"], r["baseline_over_compared"]) for r in rows] == [("A", "B", 2.0)]


REPORT = """# x

## Solver And Communication Summary

| Dataset | Scale | Comm | Ranks | Repeats | Solver s | Iters |
| --- | --- | --- | --- | --- | --- | --- |
| CUDA | 1n1g | none | 1 | 3 | 41.125 | 20480 |
| CUDA | bad | mpi | 4 | 3 | N/A | N/A |

## Other

| CUDA | 9n9g | mpi | 4 | 3 | 1.0 | 2 |
"""


def test_reference_report(spark, tmp_path):
    write(tmp_path, "r.md", REPORT)
    rows = campaign.reference_table(matrix_market.lines_of(matrix_market.read_texts(spark, str(tmp_path / "r.md")))).collect()
    assert [tuple(r)[1:] for r in rows] == [("CUDA", "1n1g", "none", 1, 41.125, 20480.0)]


def test_report_reads_back_and_compares(spark, tmp_path):
    write(tmp_path, "in/1n4g/v/suitesparse/M/a-stderr.txt", NATIVE)
    made = report.analyze(spark, {"mine": str(tmp_path / "in")}, output=str(tmp_path / "out.md"))
    assert "| mine | 1n4g | mpi | 6 | 1 | 2.750 | 2.750-2.750 |" in made
    assert (tmp_path / "out.md").read_text() == made
    rows = campaign.reference_table(matrix_market.lines_of(matrix_market.read_texts(spark, str(tmp_path / "out.md"))))
    assert rows.first()["solver"] == 2.75
    with pytest.raises(Exception, match="no logs|PATH_NOT_FOUND|Unable to infer|does not exist"):
        report.analyze(spark, {"none": str(tmp_path / "empty")})


PAIRS = {"portable-mpi": "native-mpi"}


def test_paired_campaign(spark, tmp_path):
    for trial, seconds in ((1, 12), (2, 15), (3, 18)):
        write(tmp_path, f"portable-mpi/suitesparse/Bump/p-001-nodes-0004-procs-77-{trial}-stdout.txt", f"solver: iterations=100\ntiming: schema=3 solver_max_s={seconds}\n")
    for trial in (1, 2):
        write(tmp_path, f"native-mpi/suitesparse/Bump/n-001-nodes-0004-procs-77-{trial}-stderr.txt", "  total iterations: 1,00\n  total solver time: 10.0 seconds\n")
    write(tmp_path, "native-mpi/suitesparse/Bump/n-001-nodes-0004-procs-77-9-stderr.txt", "  total iterations: 0\n  total solver time: 10.0 seconds\n")
    runs = logs.campaign_runs(matrix_market.read_texts(spark, str(tmp_path), "*.txt"), PAIRS)
    jobs = compare.job_pairs(runs, PAIRS)
    r = jobs.first()
    assert (r["topology"], r["rounds"]) == ("1n4g", 2)
    assert [r[c] for c in ("portable_s", "native_s", "ratio", "per_iter_ratio", "least_ratio", "most_ratio")] == pytest.approx([15.0, 10.0, 1.5, 1.5, 1.2, 1.5])
    lines = report.paired_lines(jobs, compare.pair_cells(jobs))
    assert "1.20..1.50" in lines[1] and "allocations=1" in lines[-1]
    with pytest.raises(ValueError, match="no paired"):
        report.paired_lines(jobs.limit(0), compare.pair_cells(jobs.limit(0)))


def test_event_log_batch_and_stream(spark, tmp_path):
    from lattica.streaming.events import status_counts, stream_events

    head = "\t".join(f.name for f in campaign.EVENT_SCHEMA)
    rows = [campaign.event_row("2025-01-01T00:00:00Z", 1, "1n4g", "M", "l", t, "started", None, "s") for t in (1, 2, 3)]
    rows += [campaign.event_row("2025-01-01T00:05:00Z", 1, "1n4g", "M", "l", 1, "ok", 0, "s"), campaign.event_row("2025-01-01T00:06:00Z", 1, "1n4g", "M", "l", 2, "failed", 1, "s")]
    write(tmp_path, "log/runs.tsv", "\n".join([head, *rows]) + "\n")
    states = {r["trial"]: (r["state"], r["exit"]) for r in campaign.run_states(campaign.read_events(spark, str(tmp_path / "log"))).collect()}
    assert states == {1: ("ok", 0), 2: ("failed", 1), 3: ("killed", None)}
    query = status_counts(stream_events(spark, str(tmp_path / "log"))).writeStream.outputMode("complete").format("memory").queryName("statuses").start()
    query.processAllAvailable()
    query.stop()
    assert {r["status"]: r["n"] for r in spark.table("statuses").collect()} == {"started": 3, "ok": 1, "failed": 1}
    with pytest.raises(ValueError, match="unknown status"):
        campaign.event_row("t", 1, "1n1g", "m", "l", 1, "odd", None, "s")


def test_resolve(spark, tmp_path):
    write(tmp_path, "b.mtx", "x")
    assert campaign.resolve(spark, None, [str(tmp_path / "a.mtx"), str(tmp_path / "b.mtx")]).endswith("b.mtx")
    with pytest.raises(FileNotFoundError):
        campaign.resolve(spark, str(tmp_path / "a.mtx"), [str(tmp_path / "b.mtx")])


def test_sinks(spark, tmp_path):
    rows = spark.createDataFrame([("2025-01-01T00:00:00Z", "1", "1n4g", "M", "l", "1", "started", None, "s")], campaign.EVENT_SCHEMA)
    campaign.append_events(rows, str(tmp_path / "log"))
    campaign.append_events(rows.withColumns({"status": F.lit("ok"), "exit": F.lit("0"), "time": F.lit("2025-01-01T00:01:00Z")}), str(tmp_path / "log"))
    assert campaign.run_states(campaign.read_events(spark, str(tmp_path / "log"))).first()["state"] == "ok"
    write(tmp_path, "a.tmp", "x")
    assert not campaign.promote(spark, str(tmp_path / "a.tmp"), str(tmp_path / "a.txt"), False) and (tmp_path / "a.tmp").exists()
    assert campaign.promote(spark, str(tmp_path / "a.tmp"), str(tmp_path / "a.txt"), True) and (tmp_path / "a.txt").read_text() == "x"
    with pytest.raises(OSError):
        campaign.promote(spark, str(tmp_path / "none"), str(tmp_path / "b.txt"), True)
    campaign.provenance(spark, {"commit": "abc"}, str(tmp_path / "facts"))
    assert "commit=abc" in "".join(r[0] + "\n" for r in spark.read.text(str(tmp_path / "facts")).collect())


def test_printed_diagnostics_read_back(spark, tmp_path):
    stats = spark.createDataFrame([(0, 10, 100, 90, 10, 5, 5, 4), (1, 10, 200, 170, 30, 10, 15, 8)], "rank int, local_rows long, local_nnz long, interior_nnz long, halo_nnz long, ghosts long, imports long, exports long")
    spread = spark.createDataFrame([("spmv", 1.0, 2.0, 3.0, 2.0)], "timer string, min_s double, avg_s double, max_s double, skew_s double")
    text = "\n".join([r["line"] for r in report.rank_lines(stats).orderBy("rank").collect()] + [r["line"] for r in report.timer_lines(spread).collect()])
    write(tmp_path, "1n4g/v/suitesparse/M/a-stderr.txt", "")
    write(tmp_path, "1n4g/v/suitesparse/M/a-stdout.txt", text + "\n")
    r = logs.read_runs(spark, str(tmp_path), "x", "portable").first()
    assert (r["local_nnz_imbalance"], r["imports_imbalance"], r["spmv_skew_s"]) == (2.0, 3.0, 2.0)


def test_plain_parts_stand_in_their_patterns():
    assert [logs.plain_part(p) for p in (logs.WALL, logs.PARTITION, rf"^{logs.NUMBER} seconds$")] == ["wall clock", "solver_diag_partition", " seconds"]
    for p in [p for _, p, _ in logs.NATIVE] + [p for _, _, p, _ in logs.PORTABLE] + [logs.TIMED, logs.WALL]:
        part = logs.plain_part(p)
        assert len(part) > 2 and part in p and f"{part}?" not in p and f"{part}*" not in p and "|" not in p


def test_key_parts_stand_in_their_patterns():
    assert [logs.key_part(p) for p in (logs.WALL, logs.PARTITION, rf"^{logs.NUMBER} seconds$")] == ["h:mm:ss or m:ss", "solver_diag_partition: ", " seconds"]
    for p in [p for _, p, _ in logs.NATIVE] + [p for _, _, p, _ in logs.PORTABLE] + [logs.TIMED, logs.WALL]:
        part = logs.key_part(p)
        assert len(part) > 2 and part in p and f"{part}?" not in p and f"{part}*" not in p and "|" not in p


@pytest.mark.parametrize("backend", ["native", "portable"])
def test_files_are_not_broadcast(spark, backend):
    """Rows of files compress well: a join that broadcasts a small shuffle of them holds them all in the driver."""
    names = spark.range(300).select(F.format_string("2n4g/v/suitesparse/M/e%d-stderr.txt", "id").alias("file"), F.posexplode(F.array(F.lit("4 MPI processes"), F.lit("ranks: 4"), F.lit("running solver:"), F.lit("2.5 seconds"))).alias("pos", "line"))
    out = names.withColumn("file", F.regexp_replace("file", "stderr", "stdout"))
    runs = logs.parse_native(names, "d") if backend == "native" else logs.parse_portable(names, out, "d")
    assert {(r["ranks"], r["running_solver_s"]) for r in runs.collect()} == {(4, 2.5 if backend == "native" else None)}
    plan = runs._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" not in plan and "SortMergeJoin" in plan
