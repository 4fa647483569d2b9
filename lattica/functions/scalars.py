"""Scalar rules of solver logs, reports and campaigns, as Column functions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# The names a communicator goes by, and the kinds they stand for.
BACKENDS = ("none", "mpi", "nccl", "nvshmem", "unknown")
BACKEND_ALIASES = {"host": "none", "none": "none", "gpu-aware": "mpi", "gpu_aware": "mpi", "gpuaware": "mpi", "mpi": "mpi", "oneccl": "nccl"}
TOPOLOGY = r"^([1-9][0-9]*)n([1-9][0-9]*)g$"
KEY_VALUE = r"(\w+)=([^\s]+)"
MOST_GPUS = 4


def wall_clock(text: Column) -> Column:
    """Seconds of ``m:ss`` or ``h:mm:ss``; anything else is an error."""
    p = F.split(text, ":")
    at = lambda i: F.get(p, F.lit(i)).cast("double")
    return F.when(F.size(p) == 2, at(0) * 60 + at(1)).when(F.size(p) == 3, at(0) * 3600 + at(1) * 60 + at(2)).when(text.isNotNull(), F.raise_error(F.concat(F.lit("not a wall clock: "), text)).cast("double"))


def number_text(value: Column, digits: int = 3) -> Column:
    """A float as reports show it: N/A, 0, or fixed digits, or exponents outside [1e-3, 1e5)."""
    far = (F.abs(value) >= 1e5) | (F.abs(value) < 1e-3)
    return F.when(value.isNull(), "N/A").when(value == 0, "0").when(far, F.format_string("%.3e", value)).otherwise(F.format_string(f"%.{digits}f", value))


def whole_text(value: Column) -> Column:
    return F.coalesce(value.cast("string"), F.lit("N/A"))


def backend(name: Column) -> Column:
    low = F.lower(name)
    out = F.when(F.coalesce(name, F.lit("")) == "", "unknown")
    for alias, kind in BACKEND_ALIASES.items():
        out = out.when(low == alias, kind)
    return out.when(low.isin(*BACKENDS), low).otherwise("unknown")


def comm(command: Column, communicator: Column) -> Column:
    """The command's communicator, else the log's, as a backend; empty text counts as missing."""
    return backend(F.coalesce(F.nullif(command, F.lit("")), F.nullif(communicator, F.lit(""))))


def parse_number(text: Column) -> Column:
    """N/A is null, junk an error."""
    given = F.nullif(text, F.lit("N/A"))
    value = given.try_cast("double")
    return F.when(given.isNull(), None).when(value.isNull(), F.raise_error(F.concat(F.lit("not a number: "), text)).cast("double")).otherwise(value)


def percent(value: Column, total: Column) -> Column:
    return 100 * value / total


def sum_values(*values: Column) -> Column:
    """Sum of those that are not null; null if none is."""
    total = F.lit(0.0)
    for v in values:
        total = total + F.coalesce(v, F.lit(0.0))
    return F.when(F.coalesce(*values).isNotNull(), total)


def first_true(first: Column, second: Column) -> Column:
    """``first`` unless it is null or 0, else ``second``."""
    return F.coalesce(F.nullif(first, F.lit(0)), second)


def ratio(top: Column, bottom: Column, both: bool = False) -> Column:
    """Null where the denominator is 0 or null, or with ``both`` where either side is."""
    return F.try_divide(F.nullif(top, F.lit(0)) if both else top, F.nullif(bottom, F.lit(0)))


def ms_per_iter(seconds: Column, iterations: Column) -> Column:
    return 1000 * ratio(seconds, iterations, both=True)


def decomposed(analyzer: str, dataset: Column, comm_: Column) -> Column:
    """Whether allreduce and halo times are of their own; analyzer is 'native', 'portable' or 'base'."""
    if analyzer == "native":
        return comm_ != "nvshmem"
    if analyzer == "portable":
        return ~((F.upper(dataset) == "CUDA") & (comm_ == "nvshmem"))
    return F.lit(True)


def comm_share(part: Column, solver: Column, is_decomposed: Column) -> Column:
    return F.when(is_decomposed & (F.coalesce(solver, F.lit(0.0)) != 0) & part.isNotNull(), F.try_divide(100 * part, solver))


def first_number(text: Column, pattern: str) -> Column:
    """The first match of a multi-line pattern's group, commas dropped."""
    found = F.regexp_extract(text, "(?m)" + pattern, 1)
    return F.nullif(F.replace(found, F.lit(","), F.lit("")), F.lit("")).try_cast("double")


def key_values(line: Column) -> tuple[Column, Column]:
    return F.regexp_extract_all(line, F.lit(KEY_VALUE), F.lit(1)), F.regexp_extract_all(line, F.lit(KEY_VALUE), F.lit(2))


def value_of(line: Column, key: str) -> Column:
    """The value of ``key=value`` in a line, the last one where the key repeats."""
    keys, values = key_values(line)
    back = F.array_position(F.reverse(keys), key)
    return F.when(back > 0, F.get(values, (F.size(values) - back).cast("int")))


def block_first(rank: Column, rows: Column | int, size: Column | int) -> Column:
    """First row of a rank's balanced block; the next rank's first row ends it."""
    rows, size = F.lit(rows), F.lit(size)
    return ((rows - rows % size) / size).cast("long") * rank + F.least(rank, rows % size)


def block_owner(row: Column, rows: Column | int, size: Column | int) -> Column:
    """The rank whose balanced block holds a row: the first ``rows % size`` blocks have one row more."""
    rows, size = F.lit(rows).cast("long"), F.lit(size).cast("long")
    rest = rows % size
    base = ((rows - rest) / size).cast("long")
    long_rows = rest * (base + 1)
    return F.when(row < long_rows, F.floor(row / (base + 1))).otherwise(rest + F.floor((row - long_rows) / F.greatest(base, F.lit(1)))).cast("int")


def fits_int32(*sizes: Column) -> Column:
    out = F.lit(True)
    for s in sizes:
        out = out & (s >= 0) & (s <= 2**31 - 1)
    return out


def topology(text: Column) -> tuple[Column, Column, Column]:
    """Nodes, GPUs a node and ranks; null where the text is malformed or wants more GPUs than a node has."""
    part = lambda i: F.nullif(F.regexp_extract(text, TOPOLOGY, i), F.lit("")).cast("int")
    nodes, gpus = part(1), part(2)
    ok = gpus <= MOST_GPUS
    return F.when(ok, nodes), F.when(ok, gpus), F.when(ok, nodes * gpus)


def matches_any(text: Column, globs: list[str]) -> Column:
    """Whether a text matches one of some shell patterns (``*``, ``?``); no pattern lets all pass."""
    if not globs:
        return F.lit(True)
    out = F.lit(False)
    for g in globs:
        shape = "".join(".*" if c == "*" else "." if c == "?" else re.escape(c) for c in g)
        out = out | text.rlike(f"^{shape}$")
    return out


def positive_flag(value: str | None) -> int:
    """A positive integer setting, else 0."""
    value = (value or "").strip()
    return int(value) if value.isdigit() else 0


def backend_keys(keys: Column, ranks: Column) -> Column:
    """One rank has no communicator, several have no single-rank key; doubles go, order stays."""
    alone = F.transform(keys, lambda k: F.when(k.startswith("native-"), "native-none").otherwise("none"))
    several = F.filter(keys, lambda k: ~k.isin("none", "native-none"))
    return F.array_distinct(F.when(ranks == 1, alone).otherwise(several))


def walltime(nodes: Column, runs: Column, minutes: int | None = None) -> Column:
    """HH:MM:00, in quarters of an hour, one at least; a run takes 3 minutes from 8 nodes on, else 2."""
    each = F.lit(minutes) if minutes else F.when(nodes >= 8, 3).otherwise(2)
    quarters = F.greatest(F.ceil(runs * each / 15), F.lit(1)).cast("int")
    return F.format_string("%02d:%02d:00", F.floor(quarters / 4).cast("int"), quarters % 4 * 15)


def clamp_debug(time: Column, debug: Column) -> Column:
    return F.when(debug & (time > "00:30:00"), "00:30:00").otherwise(time)


def parse_size(text: Column) -> Column:
    """Bytes of a number with k, m or g (1024-based, b optional); anything else is an error."""
    shape = r"^([+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?)([A-Za-z]*)$"
    value = F.nullif(F.regexp_extract(text, shape, 1), F.lit("")).try_cast("double")
    unit = F.lower(F.regexp_extract(text, shape, 2))
    times = F.when(unit == "", 1).when(unit.isin("k", "kb"), 1 << 10).when(unit.isin("m", "mb"), 1 << 20).when(unit.isin("g", "gb"), 1 << 30)
    out = F.floor(value * times).cast("long")
    return F.when(text.isNotNull() & out.isNull(), F.raise_error(F.concat(F.lit("not a size: "), text)).cast("long")).otherwise(out)


def parse_sizes(text: Column) -> Column:
    return F.transform(F.filter(F.split(text, ","), lambda s: s != ""), parse_size)


def algorithm_bandwidth(size: Column, micros: Column) -> Column:
    """GB/s."""
    return F.try_divide(size, micros) / 1000


def bus_bandwidth(size: Column, micros: Column, ranks: Column | int) -> Column:
    ranks = F.lit(ranks)
    return algorithm_bandwidth(size, micros) * 2 * (ranks - 1) / ranks


def manufactured(row: Column, seed: int = 0) -> Column:
    """A value in [-1, 1) from an integer hash of the row: the documented stand-in for a random stream."""
    return (row * 48271 + (seed or 1) * 69621) % 2147483647 / 2147483647.0 * 2 - 1


def per_iter_us(seconds: Column, iterations: Column) -> Column:
    return F.coalesce(1e6 * F.try_divide(seconds, F.nullif(iterations, F.lit(0))), F.lit(0.0))
