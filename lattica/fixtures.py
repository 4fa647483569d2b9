"""Inputs for the registered queries, derived from the driver's tables: run rows, log lines, matrices.

``*_SQL`` texts run unchanged on Spark and on DuckDB; numbers are binary fractions, so sums are exact.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .sources.logs import RUN_COLUMNS, SKEWS, kind_of


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _part(k: int) -> str:
    return f"cast((c * {k} + event_id) % 4096 as double) / 64"


_MISSING = "case when event_id % 13 = 0 then null when event_id % 17 = 0 then cast(0 as double) else {} end"
_NUMBERS = {
    "residual_norm": _part(3),
    "rel_residual_r0": _part(5),
    "rel_residual_rhs": _part(5),
    "error_norm": f"case when event_id % 3 = 0 then null else {_part(7)} end",
    "running_solver_s": _part(11),
    "solver_time_s": _MISSING.format(_part(1)),
    "wall_s": _part(13),
    "gflops": _MISSING.format(_part(17)),
    **{f"{c}_s": (f"case when event_id % 5 = 0 then cast(0 as double) else {_part(19 + i)} end" if c == "spmv" else _part(19 + i)) for i, c in enumerate(("gemv", "spmv", "dot", "nrm2", "axpy", "copy", "allreduce", "halo", "pack", "p2p", "host_sync", "other"))},
    "allreduce_us": _part(41),
    "halo_us": _part(43),
    **{f"{s}_skew_s": f"case when event_id % {i + 2} = 0 then null else {_part(47 + i)} end" for i, s in enumerate(SKEWS)},
    **{f"{s}_imbalance": f"case when user_id % 4 = 0 then null else {_part(59 + i)} end" for i, s in enumerate(("local_nnz", "halo_nnz", "ghosts", "imports", "exports"))},
}
RUNS_SQL = f"""
select event_id,
  case user_id % 3 when 0 then 'alpha' when 1 then 'beta' else 'gamma' end as dataset,
  case event_id % 4 when 0 then '1n1g' when 1 then '1n4g' when 2 then '2n4g' else '16n4g' end as scale,
  event_type as variant,
  case event_id % 2 when 0 then 'Bump' else 'Queen' end as matrix,
  case event_id % 5 when 0 then null when 1 then 4 when 2 then 8 else 16 end as ranks,
  case event_id % 6 when 0 then 'host' when 1 then 'gpu-aware' when 2 then 'oneccl' when 3 then 'nvshmem' when 4 then null else 'weird' end as communicator,
  case event_id % 10 when 0 then 'mpi' when 1 then '' else null end as command_communicator,
  event_id % 7 <> 0 as converged,
  case when event_id % 11 = 0 then null else cast(c % 500 as int) end as iterations,
  cast(c % 300 as bigint) as allreduce_calls,
  {", ".join(f"{e} as {n}" for n, e in _NUMBERS.items())}
from (select *, cast(floor(value * 100) as bigint) as c from {{events}}) e
"""

#: The backend of a run by SQL.
COMM_SQL = """case when k is null then 'unknown' when k in ('host', 'none') then 'none' when k in ('gpu-aware', 'gpu_aware', 'gpuaware', 'mpi') then 'mpi'
  when k in ('oneccl', 'nccl') then 'nccl' when k = 'nvshmem' then 'nvshmem' else 'unknown' end"""
#: Run rows with comm for DuckDB, as the relation ``runs``.
RUNS_CTE = f"""runs as (select *, {COMM_SQL} as comm from (select *, lower(coalesce(nullif(command_communicator, ''), nullif(communicator, ''))) as k from ({RUNS_SQL.replace("{events}", "events")})))"""


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .functions.scalars import comm

    rows = spark.sql(RUNS_SQL, events=table(spark, sf_dir, "events"))
    missing = {c: F.lit(None).cast(kind_of(c)) for c in RUN_COLUMNS if c not in rows.columns}
    return rows.withColumns(missing).withColumn("comm", comm(F.col("command_communicator"), F.col("communicator")))


SIZE = 4


def rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("i"))


#: Order lines to a task of the matrix: they join to about four entries each.
LINES_A_TASK = 1 << 18


def tasks(spark: SparkSession, sf_dir: str) -> int:
    """Tasks among which the matrix's entries are dealt, so that a task's share stays the same on larger tables."""
    return max(1, -(-table(spark, sf_dir, "lineitem").count() // LINES_A_TASK))


def coo(spark: SparkSession, sf_dir: str, by: str = "i") -> DataFrame:
    """Co-purchase Laplacian plus identity: parts that share orders, minus the number of those; rows sum to 1.

    An order adds -1 for each pair of its parts and, to each part's diagonal, how many others it holds. Entries are
    summed where their row lies, in ``tasks`` partitions by i, which row sums and distinct entries need no other shuffle after;
    ``by`` = 'j' deals them by column instead, where a vector's values join them.
    """
    n = tasks(spark, sf_dir)
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o"), F.col("l_partkey").alias("p"))
    bought = lines.where("o is not null and p is not null").repartition(n, "o").distinct()
    sized = bought.select("o", F.col("p").alias("i"), (F.count("*").over(Window.partitionBy("o")) - 1).alias("others"))
    pairs = sized.join(bought.select("o", F.col("p").alias("j")), "o").select("i", "j", F.when(F.col("i") == F.col("j"), F.col("others")).otherwise(-1).alias("c"), F.lit(False).alias("own"))
    own = rows(spark, sf_dir).select("i", F.col("i").alias("j"), F.lit(1).cast("long").alias("c"), F.lit(True).alias("own"))
    summed = pairs.unionByName(own).repartition(n, by).groupBy("i", "j").agg(F.sum("c").cast("double").alias("v"), F.bool_or("own").alias("own"))
    return summed.where("i <> j or own").select("i", "j", "v")


COO_CTE = """bought as (select distinct l_orderkey as o, l_partkey as p from lineitem),
off as materialized (select a.p as i, b.p as j, -count(*)::double as v from bought a join bought b using (o) where a.p <> b.p group by all),
coo as materialized (select * from off union all select p_partkey, p_partkey, coalesce(d, 0) + 1 from part left join (select i, -sum(v) as d from off group by i) on i = p_partkey)"""
_OWNER = "case when {i} < rest * (base + 1) then {i} // (base + 1) else rest + ({i} - rest * (base + 1)) // greatest(base, 1) end::int"
OWNER_CTE = f"""dims as (select count(*) as n, count(*) // {SIZE} as base, count(*) % {SIZE} as rest from part),
owner as (select p_partkey as i, {_OWNER.format(i="p_partkey")} as rank from part, dims)"""
OWNED_CTE = f"""{COO_CTE}, {OWNER_CTE},
owned as materialized (select c.i, c.j, c.v, r.rank as row_rank, k.rank as col_rank, case when r.rank = k.rank then 'interior' else 'halo' end as kind from coo c join owner r on c.i = r.i join owner k on c.j = k.i),
imports as (select distinct row_rank as rank, col_rank as peer, j from owned where kind = 'halo')"""


def vector(rows_: DataFrame) -> DataFrame:
    """Small integers, so that products are exact."""
    return rows_.select("i", (F.col("i") % 7 - 3).cast("double").alias("val"))
