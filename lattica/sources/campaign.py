"""Report tables, event logs, candidate paths and library maps."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.scalars import parse_number
from ..operators.windows import last_writer
from ..storage import write_text

SECTION = "## Solver And Communication Summary"
EVENT_SCHEMA = T.StructType([T.StructField(c, T.StringType()) for c in ("time", "job", "topology", "matrix", "label", "trial", "status", "exit", "stem")])


def reference_table(lines: DataFrame) -> DataFrame:
    """pos, dataset, scale, comm, ranks, solver, iterations of a report's lines (file, pos, line).

    Only the summary section counts, up to the next heading; its row that starts with Dataset names the
    columns; rows without a solver time are dropped; a rank count that is no integer is an error.
    """
    by = Window.partitionBy("file").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    heading = F.when(F.col("line").startswith("## "), F.col("line") == SECTION)
    inside = lines.withColumn("_in", F.coalesce(F.last(heading, ignorenulls=True).over(by), F.lit(False))).where(F.col("_in") & F.col("line").startswith("|"))
    cells = F.transform(F.split(F.regexp_replace(F.trim("line"), r"^\||\|$", ""), r"\|"), lambda c: F.trim(c))
    rows = inside.select("file", "pos", cells.alias("cells")).where(~F.get("cells", F.lit(0)).startswith("---"))
    names = rows.withColumn("names", F.last(F.when(F.get("cells", F.lit(0)) == "Dataset", F.col("cells")), ignorenulls=True).over(by)).where((F.get("cells", F.lit(0)) != "Dataset") & F.col("names").isNotNull())
    cell = lambda name: F.get("cells", (F.array_position("names", name) - 1).cast("int"))
    out = names.select("pos", cell("Dataset").alias("dataset"), cell("Scale").alias("scale"), cell("Comm").alias("comm"), cell("Ranks").cast("int").alias("ranks"), parse_number(cell("Solver s")).alias("solver"), parse_number(cell("Iters")).alias("iterations"))
    return out.where("solver is not null")


def read_events(spark: SparkSession, path: str) -> DataFrame:
    """The campaign's event log, typed; exit is null while a run has only started."""
    return typed_events(spark.read.option("sep", "\t").option("header", True).schema(EVENT_SCHEMA).csv(path))


def typed_events(raw: DataFrame) -> DataFrame:
    return raw.select(
        F.to_timestamp("time").alias("time"), F.col("job").cast("long").alias("job"), "topology", "matrix", "label", F.col("trial").cast("int").alias("trial"), "status", F.nullif("exit", F.lit("-")).try_cast("int").alias("exit"), "stem"
    )


def event_row(time: str, job: int, topology: str, matrix: str, label: str, trial: int, status: str, exit_code: int | None, stem: str) -> str:
    """One line of the event log; append it to the file."""
    if status not in ("started", "ok", "failed"):
        raise ValueError(f"unknown status {status!r}")
    return "\t".join(map(str, (time, job, topology, matrix, label, trial, status, "-" if exit_code is None else exit_code, stem)))


def append_events(rows: DataFrame, path: str) -> None:
    """Append rows with the event log's columns, as text, to a folder that ``read_events`` and the stream read."""
    text = rows.select(*[F.coalesce(F.col(f.name).cast("string"), F.lit("-")).alias(f.name) for f in EVENT_SCHEMA])
    text.write.mode("append").option("sep", "\t").option("header", True).csv(path)


def promote(spark: SparkSession, temporary: str, final: str, succeeded: bool) -> bool:
    """Give a run's output its final name, in one rename, if the run succeeded; else leave it under its temporary one."""
    if not succeeded:
        return False
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    fs = path(temporary).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(path(temporary)) or not fs.rename(path(temporary), path(final)):
        raise OSError(f"cannot rename {temporary} to {final}")
    return True


#: Settings that a provenance file states; others may hold keys of stores, passwords or tokens.
STATED = ("spark.master", "spark.app.name", "spark.executor.instances", "spark.executor.cores", "spark.executor.memory", "spark.driver.memory", "spark.default.parallelism", "spark.sql.shuffle.partitions", "spark.sql.adaptive.enabled", "spark.sql.files.maxPartitionBytes", "spark.sql.session.timeZone")


def provenance_lines(spark: SparkSession, facts: dict[str, str]) -> list[str]:
    """name=value lines of what a campaign ran with and the stated Spark settings; facts whose names look secret are masked."""
    secret = re.compile(spark.conf.get("spark.redaction.regex", "(?i)secret|password|token|access[.]?key"))
    known = dict(spark.sparkContext.getConf().getAll())
    out = {f"spark:{k}": known[k] for k in STATED if k in known}
    out |= {k: "***" if secret.search(k) else v for k, v in facts.items()}
    return [f"{k}={v}" for k, v in sorted(out.items())]


def provenance(spark: SparkSession, facts: dict[str, str], path: str) -> None:
    """Write ``provenance_lines`` as one text file."""
    write_text(spark, "\n".join(provenance_lines(spark, facts)) + "\n", path)


def placement(spark: SparkSession, size: int) -> DataFrame:
    """rank, line: where each of ``size`` tasks that run at once stands, as host, process and device."""

    def place(batches):
        import os
        import socket

        import pyarrow as pa

        for batch in batches:
            ranks = batch.column(0).to_pylist()
            lines = [f"rank {r}: host={socket.gethostname()} gpu={r} device=executor-{os.getppid()}" for r in ranks]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(lines)], names=["rank", "line"])

    return spark.range(0, size, 1, size).withColumnRenamed("id", "rank").mapInArrow(place, "rank long, line string").orderBy("rank")


def run_states(events: DataFrame) -> DataFrame:
    """job, topology, matrix, label, trial and state: ok, failed, or killed for a run that only started."""
    keys = ["job", "topology", "matrix", "label", "trial"]
    ended = F.when(F.col("status") != "started", F.struct("status", "exit"))
    by = events.groupBy(*keys).agg(F.min("time").alias("began"), last_writer(ended, F.col("time")).alias("e"))
    return by.select(*keys, "began", F.coalesce("e.status", F.lit("killed")).alias("state"), F.col("e.exit").alias("exit"))


def resolve(spark: SparkSession, explicit: str | None, candidates: list[str]) -> str:
    """An explicit path, which must exist, or the first candidate that does."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()

    def there(path: str) -> bool:
        p = jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(conf).exists(p)

    for path in [explicit] if explicit else candidates:
        if there(path):
            return path
    raise FileNotFoundError(explicit or f"none of {candidates}")


def shared_objects(lines: DataFrame) -> DataFrame:
    """path: the distinct shared objects of a process map's lines, in order."""
    path = F.regexp_extract("line", r"\s(/\S*\.so(?:\.\S*)?)$", 1)
    return lines.select(path.alias("path")).where("path <> ''").distinct().orderBy("path")
