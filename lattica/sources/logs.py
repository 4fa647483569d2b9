"""Solver logs to typed run rows.

Logs are lines (file, pos, line). Each line yields (field, value) pairs by the grammar below; a file's run
takes the last value of a field, or the first where the grammar says so.
"""

from __future__ import annotations

import functools
import operator
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import scalars as S
from ..operators.windows import first_writer, last_writer, pending_value, sections
from .matrix_market import lines_of, list_files, read_texts

# The grammar of the two log formats, as prefixes of a line.
NUMBER = r"([0-9]+(?:\.[0-9]+)?)"
EXPONENT = r"([0-9]+(?:\.[0-9]+)?(?:[eE][+-]?\d+)?)"
TIMED = r'^\s*Command being timed: "(.+)"'
WALL = r"^\s*Elapsed \(wall clock\) time \(h:mm:ss or m:ss\): (.+)$"


def _per_proc(number: str, name: str) -> str:
    return rf"^\s*{name}: {number} seconds/proc (\d+) times/proc (\d+) B/proc\s+{number} GB/s/proc"


_ALLREDUCE, _HALO = _per_proc(NUMBER, "allreduce") + rf" {NUMBER} us/op/proc", _per_proc(NUMBER, "haloexchange") + rf" {NUMBER} msg/proc {NUMBER} us/msg/proc"
#: field, pattern, group; iteration counts may have thousands separators.
NATIVE = (
    ("ranks", r"^(\d+) MPI processes", 1),
    ("omp_threads", r"^(\d+) OpenMP threads", 1),
    ("solver_kind", r"^using (.+)$", 1),
    ("communicator", r"^Using (.+?) for communication", 1),
    ("running_solver_s", rf"^running solver:\s*{NUMBER} seconds", 1),
    ("iterations", r"^\s*total iterations: ([\d,]+)", 1),
    ("gflops", rf"^\s*total flop rate: {NUMBER} Gflop/s", 1),
    ("solver_time_s", rf"^\s*total solver time: {NUMBER} seconds", 1),
    ("allreduce_s", _ALLREDUCE, 1),
    ("allreduce_calls", _ALLREDUCE, 2),
    ("allreduce_bytes", _ALLREDUCE, 3),
    ("allreduce_us", _ALLREDUCE, 5),
    ("halo_s", _HALO, 1),
    ("halo_calls", _HALO, 2),
    ("halo_bytes", _HALO, 3),
    ("halo_us", _HALO, 6),
    ("residual_norm", r"^\s*residual 2-norm: ([0-9.eE+-]+)", 1),
    ("error_norm", r"^error 2-norm: ([0-9.eE+-]+)", 1),
)
SECTIONS = {"performance_cuda_compatible:": "compatible", "performance_sycl_overheads:": "overheads", "performance_sycl_native:": "native"}
_OWN = {name: _per_proc(EXPONENT, name) for name in ("gemv", "dot", "nrm2", "axpy", "copy", "haloexchange", "pack", "host_sync", "spmv", "p2p")}
_OWN_ALLREDUCE = _per_proc(EXPONENT, "allreduce") + rf" {EXPONENT} us/op/proc"
#: section (None: any line), field, pattern, group.
PORTABLE = (
    (None, "ranks", r"^ranks: (\d+)$", 1),
    (None, "mpi_mode", r"^mpi-mode: (\S+)$", 1),
    (None, "collectives", r"^solver-collectives: (\S+)$", 1),
    (None, "optimizations", r"^optimizations: (\S+)$", 1),
    ("compatible", "gflops", rf"^\s*flop_rate: {EXPONENT} Gflop/s", 1),
    ("compatible", "solver_time_s", rf"^\s*solver_time: {EXPONENT} seconds", 1),
    *(("compatible", f"{n}_s", _OWN[n], 1) for n in ("gemv", "dot", "nrm2", "axpy", "copy")),
    ("compatible", "allreduce_s", _OWN_ALLREDUCE, 1),
    ("compatible", "allreduce_calls", _OWN_ALLREDUCE, 2),
    ("compatible", "allreduce_bytes", _OWN_ALLREDUCE, 3),
    ("compatible", "allreduce_us", _OWN_ALLREDUCE, 5),
    ("compatible", "halo_s", _OWN["haloexchange"], 1),
    ("compatible", "halo_calls", _OWN["haloexchange"], 2),
    ("compatible", "halo_bytes", _OWN["haloexchange"], 3),
    *(("overheads", f"{n}_s", _OWN[n], 1) for n in ("pack", "host_sync")),
    ("overheads", "other_s", rf"^\s*other: {EXPONENT} seconds", 1),
    *(("native", f"{n}_s", _OWN[n], 1) for n in ("spmv", "p2p")),
)
SKEWS = ("spmv", "allreduce", "p2p", "halo_spmv", "pack", "host_sync")
_SKEW = rf"min_s={EXPONENT} avg_s={EXPONENT} max_s={EXPONENT} skew_s={EXPONENT}"
#: line's first word, key, field.
KEYED = (
    *(("timing:", k, f) for k, f in (("schema", "timing_schema"), ("setup_s", "setup_s"), ("warmup_s", "warmup_s"), ("solver_s", "loop_s"), ("loop_s", "loop_s"), ("solver_max_s", "loop_max_s"), ("loop_max_s", "loop_max_s"), ("solver_min_s", "loop_min_s"), ("loop_min_s", "loop_min_s"), ("validation_s", "validation_s"))),
    *(("waits:", k, f) for k, f in (("pack_s", "pack_s"), ("halo_s", "p2p_s"), ("allreduce_s", "allreduce_s"), ("readback_s", "host_sync_s"))),
    ("validation:", "true_rel_residual", "true_rel_residual"),
    *(("solver:", k, f) for k, f in (("converged", "converged"), ("iterations", "iterations"), ("residual", "residual_norm"), ("rel_residual_r0", "rel_residual_r0"), ("rel_residual_rhs", "rel_residual_rhs"), ("relative_error", "error_norm"), ("gflops", "gflops"), ("solve_time", "running_solver_s"))),
)
PARTITION = r"^solver_diag_partition: (\d+) (\d+) (\d+) (\d+) (\d+) (\d+) (\d+) (\d+)$"
IMBALANCES = {"local_nnz": 3, "halo_nnz": 5, "ghosts": 6, "imports": 7, "exports": 8}

_INT, _LONG = ("ranks", "omp_threads", "timing_schema", "iterations"), ("allreduce_calls", "allreduce_bytes", "halo_calls", "halo_bytes")
_TEXT = ("dataset", "file", "scale", "variant", "matrix", "solver_kind", "communicator", "command_communicator", "optimizations")
#: The columns of a run, in order; ``comm`` follows them.
RUN_COLUMNS = (
    *("dataset", "file", "scale", "variant", "matrix", "ranks", "omp_threads", "solver_kind", "communicator", "command_communicator", "optimizations", "timing_schema"),
    *("converged", "iterations", "residual_norm", "rel_residual_r0", "rel_residual_rhs", "error_norm", "true_rel_residual"),
    *("running_solver_s", "solver_time_s", "wall_s", "gflops", "setup_s", "warmup_s", "loop_s", "loop_max_s", "loop_min_s", "validation_s"),
    *("gemv_s", "spmv_s", "dot_s", "nrm2_s", "axpy_s", "copy_s", "allreduce_s", "allreduce_us", "halo_s", "halo_us", "allreduce_calls", "allreduce_bytes", "halo_calls", "halo_bytes"),
    *("pack_s", "p2p_s", "host_sync_s", "other_s"),
    *(f"{s}_skew_s" for s in SKEWS),
    *(f"{s}_imbalance" for s in IMBALANCES),
)


def kind_of(field: str) -> T.DataType:
    return T.StringType() if field in _TEXT else T.IntegerType() if field in _INT else T.LongType() if field in _LONG else T.BooleanType() if field == "converged" else T.DoubleType()


RUN_SCHEMA = T.StructType([*(T.StructField(c, kind_of(c)) for c in RUN_COLUMNS), T.StructField("comm", T.StringType())])


def path_metadata(file: Column) -> dict[str, Column]:
    """scale, variant and matrix of a path relative to its dataset's root."""
    parts = F.split(file, "/")
    at = F.array_position(parts, "suitesparse")
    part = lambda i: F.coalesce(F.get(parts, i), F.lit("unknown"))
    return {"scale": part(F.lit(0)), "variant": part(F.lit(1)), "matrix": F.when(at > 0, part(at.cast("int"))).otherwise("unknown")}


def _plain_runs(pattern: str, plain: str) -> list[str]:
    """Runs of three or more ``plain`` characters that every match of a pattern of this grammar holds."""
    return re.findall(rf"[{plain}]{{3,}}", re.sub(r"\\.|\[[^]]*\]|\(\?:[^()]*\)[?*]", "\n", pattern))


def plain_part(pattern: str) -> str:
    """The longest run of letters and spaces that every match of a pattern of this grammar holds."""
    return max(_plain_runs(pattern, "A-Za-z_ "), key=len, default="")


def key_part(pattern: str) -> str:
    """The part of a pattern that fewest lines hold: the longest plain run with a colon, as keys have; else as ``plain_part``."""
    return max((x for x in _plain_runs(pattern, "A-Za-z0-9_: -") if ":" in x), key=len, default=plain_part(pattern))


def _match(line: Column, pattern: str, group: int) -> Column:
    """The group of a match; most lines fail the search for the key part, which is far cheaper than the pattern."""
    return F.when(line.contains(key_part(pattern)) & line.rlike(pattern), F.regexp_extract(line, pattern, group))


def _runs(files: DataFrame, pairs: DataFrame, dataset: str | Column) -> DataFrame:
    """Run rows of ``files`` (file) from single values (file and columns of their own in ``pairs``).

    The join is by sorting: values of runs compress so well that a shuffle of few megabytes, which Spark would
    broadcast through the driver, holds many times as much.
    """
    joined = files.select("file").distinct().hint("merge").join(pairs, "file", "left")
    meta = path_metadata(F.col("file"))
    columns = []
    for f in RUN_COLUMNS:
        if f == "dataset":
            c = F.lit(dataset) if isinstance(dataset, str) else dataset
        elif f in meta:
            c = meta[f]
        elif f == "file" or f in joined.columns:
            c = F.col(f)
        else:
            c = F.lit(None)
        columns.append(c.cast(kind_of(f)).alias(f))
    return joined.select(*columns).withColumn("comm", S.comm(F.col("command_communicator"), F.col("communicator")))


def _holds(line: Column, patterns) -> Column:
    """Whether a line has the key part of any pattern: few lines of a log do, and only these go on."""
    return functools.reduce(operator.or_, [line.contains(x) for x in dict.fromkeys(map(key_part, patterns))])


def _typed(field: str, text: Column) -> Column:
    text = F.replace(text, F.lit(","), F.lit("")) if field == "iterations" else text
    if field == "converged":
        return F.lower(text) == "true"
    return text.try_cast(kind_of(field))


def _head_values(lines: DataFrame, option: str) -> DataFrame:
    """wall_s and command_communicator of each file."""
    wall, command = _match(F.col("line"), WALL, 1), _match(F.col("line"), TIMED, 1)
    chosen = F.nullif(F.regexp_extract(command, option + r"\s+(\S+)", 1), F.lit(""))
    by = lines.where(_holds(F.col("line"), [WALL, TIMED])).groupBy("file").agg(last_writer(wall, F.col("pos")).alias("wall"), last_writer(chosen, F.col("pos")).alias("command_communicator"))
    return by.select("file", S.wall_clock(F.col("wall")).alias("wall_s"), "command_communicator")


def parse_native(lines: DataFrame, dataset: str | Column) -> DataFrame:
    """Runs of native solver logs (their standard error)."""
    line, pos = F.col("line"), F.col("pos")
    opener = line.startswith("running solver:")
    # a pending value is a number of seconds on a line of its own
    lines_known = lines.where(_holds(line, [p for _, p, _ in NATIVE]) | line.endswith(" seconds"))
    waiting = pending_value(lines_known, opener, opener & ~line.rlike(rf"^running solver:\s*{NUMBER} seconds"), _match(line, rf"^{NUMBER} seconds$", 1), "_pending")
    values = {f: _match(line, p, g) for f, p, g in NATIVE}
    values["running_solver_s"] = F.coalesce(values["running_solver_s"], F.col("_pending"))
    found = waiting.select("file", "pos", *[v.alias(f) for f, v in values.items()])
    by = found.groupBy("file").agg(*[last_writer(F.col(f), pos).alias(f) for f in values])
    typed = by.select("file", *[_typed(f, F.col(f)).alias(f) for f in values])
    return _runs(lines, typed.join(_head_values(lines, "--comm"), "file", "full"), dataset)


def parse_portable(stderr: DataFrame, stdout: DataFrame, dataset: str | Column) -> DataFrame:
    """Runs of portable solver logs: standard error, and standard output where the sibling file is there."""
    line, pos = F.col("line"), F.col("pos")
    out = stdout.withColumn("file", F.regexp_replace("file", r"-stdout\.txt$", "-stderr.txt"))
    # lines that neither hold a value nor open or close a section are not needed to know the section
    known = _holds(line, [*(p for _, _, p, _ in PORTABLE), *(f"solver_diag_perf: {n}" for n in SKEWS)]) | functools.reduce(operator.or_, [line.startswith(h + " ") for h in dict.fromkeys(h for h, _, _ in KEYED)])
    marked = sections(out.where(known | line.rlike(r"^\S")), SECTIONS).where(known)
    values: dict[str, list[Column]] = {}
    for section, field, pattern, group in PORTABLE:
        found = _match(line, pattern, group)
        values.setdefault(field, []).append(found if section is None else F.when(F.col("section") == section, found))
    for head, key, field in KEYED:
        found = F.when(line.startswith(head + " "), S.value_of(line, key))
        values.setdefault(field, []).append(F.regexp_replace(found, "s+$", "") if key == "solve_time" else found)
    for name in SKEWS:
        values[f"{name}_skew_s"] = [_match(line, rf"^solver_diag_perf: {name} {_SKEW}", 4)]
    schema3 = line.startswith("timing: ") & (F.coalesce(S.value_of(line, "schema").try_cast("int"), F.lit(0)) >= 3)
    values["solver_time_s"].append(F.when(schema3, F.coalesce(S.value_of(line, "solver_max_s"), S.value_of(line, "loop_max_s"))))
    first = {"collectives": "collectives", "running_solver_s": "first_running"}
    found = marked.select("file", "pos", *[F.coalesce(*v).alias(f) for f, v in values.items()])
    aggregates = [last_writer(F.col(f), pos).alias(f) for f in values]
    aggregates += [first_writer(F.col(f), pos).alias(f"_first_{a}") for f, a in first.items()]
    by = found.groupBy("file").agg(*aggregates)
    typed = by.select("file", *[_typed(f, F.col(f)).alias(f) for f in values if f not in ("mpi_mode", "collectives")], F.coalesce("mpi_mode", "_first_collectives").alias("communicator"), F.col("_first_first_running").try_cast("double").alias("_solve"))
    typed = typed.withColumn("solver_time_s", F.coalesce("solver_time_s", "_solve")).drop("_solve")

    ranked = out.where(line.startswith("solver_diag_partition: ") & line.rlike(PARTITION)).select("file", *[F.regexp_extract(line, PARTITION, g).cast("double").alias(c) for c, g in IMBALANCES.items()])
    uneven = ranked.groupBy("file").agg(*[F.when(F.min(c) > 0, F.max(c) / F.min(c)).alias(f"{c}_imbalance") for c in IMBALANCES])
    joined = _head_values(stderr, "--mpi-mode").join(typed, "file", "full").join(uneven, "file", "full")
    alone = F.coalesce((F.col("ranks") == 1) & (F.coalesce("command_communicator", F.lit("")) == ""), F.lit(False))
    return _runs(stderr, joined.withColumn("communicator", F.when(alone, "none").otherwise(F.col("communicator"))), dataset)


def _relative(texts: DataFrame, root: str) -> DataFrame:
    """file paths relative to the root."""
    tail = root.rstrip("/").split("://")[-1].removeprefix("file:")
    at = F.locate(tail + "/", F.col("file"))
    return texts.where(at > 0).withColumn("file", F.substr("file", at + len(tail) + 1))


LOG_SUFFIX = "-stderr.txt"


def discover(spark: SparkSession, root: str) -> DataFrame:
    """Relative paths of all logs below a root, in order; files still under a temporary name are none."""
    return _relative(list_files(spark, root, LOG_SUFFIX), root).orderBy("file")


def read_runs(spark: SparkSession, root: str, label: str, backend: str = "native") -> DataFrame:
    """Runs of one dataset; a portable backend reads datasets labelled CUDA as native ones."""
    names = discover(spark, root)
    lines = lines_of(_relative(read_texts(spark, root, "*" + LOG_SUFFIX), root))
    # an empty log is a run too: one empty line stands for it
    blank = names.join(lines.select("file").distinct(), "file", "left_anti").select("file", F.lit(0).alias("pos"), F.lit("").alias("line"))
    err = lines.select("file", "pos", "line").unionByName(blank)
    if backend == "native" or label.upper() == "CUDA":
        return parse_native(err, label)
    return parse_portable(err, lines_of(_relative(read_texts(spark, root, "*-stdout.txt"), root)), label)


def collect_runs(spark: SparkSession, datasets: dict[str, str], backend: str = "native") -> DataFrame:
    """Runs of several datasets (label to root), one after the other."""
    out = None
    for label, root in datasets.items():
        runs = read_runs(spark, root, label, backend)
        out = runs if out is None else out.unionAll(runs)
    if out is None:
        raise ValueError("no dataset")
    return out


#: A paired campaign's file name: nodes, processes, job, trial.
CAMPAIGN_NAME = r"-(\d{3})-nodes-(\d{4})-procs-(\d+)-(\d+)-(?:stdout|stderr)\.txt$"


def campaign_runs(texts: DataFrame, pairs: dict[str, str]) -> DataFrame:
    """matrix, topology, job, label, trial, seconds, iterations of (file, text); ``pairs``: portable label to native label.

    Files without seconds or positive iterations are dropped; of two files with one key the later path counts.
    """
    parts = F.split("file", "/")
    name = lambda g: F.nullif(F.regexp_extract("file", CAMPAIGN_NAME, g), F.lit("")).cast("long")
    rows = texts.select("file", "text", F.get(parts, F.size(parts) - 4).alias("label"), F.get(parts, F.size(parts) - 2).alias("matrix"), F.get(parts, F.size(parts) - 3).alias("_set"), name(1).alias("nodes"), name(2).alias("procs"), name(3).alias("job"), name(4).alias("trial"))
    portable = F.col("label").isin(*pairs)
    rows = rows.where((F.col("_set") == "suitesparse") & F.col("nodes").isNotNull() & F.when(portable, F.col("file").endswith("-stdout.txt")).otherwise(F.col("label").isin(*pairs.values()) & F.col("file").endswith("-stderr.txt")))
    text = F.col("text")
    seconds = F.when(portable, S.first_number(text, r"^timing: .*?\bsolver_max_s=(\S+)")).otherwise(S.first_number(text, r"^\s*total solver time: ([\d.,]+) seconds"))
    iterations = F.when(portable, S.first_number(text, r"^solver: .*?\biterations=(\d+)")).otherwise(S.first_number(text, r"^\s*total iterations: ([\d,]+)"))
    topology = F.concat(F.col("nodes"), F.lit("n"), F.floor(F.try_divide("procs", "nodes")).cast("long"), F.lit("g"))
    parsed = rows.select("file", "matrix", topology.alias("topology"), "job", "label", "trial", seconds.alias("seconds"), iterations.cast("long").alias("iterations"))
    parsed = parsed.where("iterations > 0 and seconds is not null")
    keys = ["matrix", "topology", "job", "label", "trial"]
    return parsed.groupBy(*keys).agg(F.max_by(F.struct("seconds", "iterations"), "file").alias("r")).select(*keys, "r.seconds", "r.iterations")
