"""Results that are cut off from their lineage by a table in the shared folder."""

from __future__ import annotations

import contextlib
import gc
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Spark's setting by which an execution deletes its shuffle files when it ends.
CLEAN_UP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share: spark.checkpoint.dir.

    Where that is unset, a session within one process (master local) gets a new temporary one; on a cluster, whose
    executors don't see the driver's disk, it is an error.
    """
    context = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not found:
        if not re.fullmatch(r"local(\[.*\])?", context.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="lattica-"))
        found = context.getCheckpointDir()
    return found.rstrip("/")


def write_text(spark: SparkSession, text: str, path: str) -> None:
    """One file of UTF-8 text, wherever Spark's file systems reach; what was there is replaced."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    out = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(target, True)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()


def stash(df: DataFrame, label: str, free: bool = True) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back.

    Lineage ends there, so a lost executor costs a re-read, never a recomputation, and what
    several later branches read is computed once. The shuffle files of the write go with it, since
    nothing reads them again: disk use is that of the greatest step, not the sum. With ``free``, Spark's
    cleaner is also shown what else has become garbage, which is not worth its time for small steps.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    before = spark.conf.get(CLEAN_UP, "false")
    spark.conf.set(CLEAN_UP, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(CLEAN_UP, before)
    if free:
        gc.collect()
        spark.sparkContext._jvm.System.gc()
    return spark.read.schema(df.schema).parquet(path)


def drop_stash(df: DataFrame) -> None:
    """Delete the files of a stash that no later plan reads."""
    spark = df.sparkSession
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
        with contextlib.suppress(Exception):
            path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
