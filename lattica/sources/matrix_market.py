"""Matrix Market coordinate files and partition vectors, read as text.

A file's line order matters only for its header, its size line and its end. ``read_lines`` reads a file of any size in
splits and numbers its lines by counts of the splits; entries are then rows like any others, and each step
over them is narrow. ``read_texts`` and ``lines_of`` read many small files, one row each.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..storage import stash
from .positions import number_by_position

INT32_MAX = 2**31 - 1
#: What the banner may declare.
FIELDS, SYMMETRIES = ("real", "integer"), ("general", "symmetric")
#: Lines among which the size line mostly stands.
TOP_LINES = 1000
_INTEGER = r"^[+-]?[0-9]+$"


class FormatError(ValueError):
    """A file that breaks the format."""


def list_files(spark: SparkSession, path: str, suffix: str) -> DataFrame:
    """file: the files below a path with a suffix, empty ones too (which Spark's sources leave out)."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    root = jvm.org.apache.hadoop.fs.Path(path)
    fs = root.getFileSystem(conf)
    found = []
    walk = fs.listFiles(root, True) if fs.exists(root) else None
    while walk is not None and walk.hasNext():
        name = walk.next().getPath().toString()
        if name.endswith(suffix):
            found.append((name,))
    return spark.createDataFrame(found, "file string")


def read_texts(spark: SparkSession, path: str, glob: str | None = None) -> DataFrame:
    """file, text of the files below a path that are not empty."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", True)
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    return reader.load(path).select(F.col("path").alias("file"), F.col("content").cast("string").alias("text"))


def lines_of(texts: DataFrame) -> DataFrame:
    """file, pos (from 0), line, without line ends."""
    lines = texts.select("file", F.posexplode(F.split("text", "\r?\n")).alias("pos", "line"), F.size(F.split("text", "\r?\n")).alias("_n"))
    return lines.where((F.col("pos") < F.col("_n") - 1) | (F.col("line") != "")).drop("_n")


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """file, pos (from 0), line of text files of any size, which tasks read in splits.

    A split's lines are numbered as they are read and written once; how many lines the splits before it have is a
    sum over splits, of which there is one for some hundred megabytes.
    """
    raw = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"), F.col("value").alias("line"))
    kept = stash(raw, "matrix-lines", free=False)
    splits = kept.groupBy("file", "block").agg(F.min("at").alias("first"), F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = kept.join(F.broadcast(splits.withColumn("before", before).select("file", "block", "first", "before")), ["file", "block"])
    return placed.select("file", (F.col("before") + F.col("at") - F.col("first")).alias("pos"), "line")


def _tokens(line: Column) -> Column:
    return F.filter(F.split(line, r"\s+"), lambda t: t != "")


def header(lines: DataFrame) -> dict:
    """Symmetry, rows, cols, nnz and the size line's place of one file's lines; FormatError if it has none such."""
    solid = lines.where((F.col("pos") == 0) | ~F.col("line").startswith("%") & (F.col("line") != ""))
    top = solid.where(F.col("pos") < TOP_LINES).orderBy("pos").limit(2).collect()
    if len(top) < 2:
        top = solid.orderBy("pos").limit(2).collect()
    if not top or top[0]["pos"] != 0:
        raise FormatError("no header")
    banner = top[0]["line"].split()
    if len(banner) != 5 or banner[0] != "%%MatrixMarket" or banner[1] != "matrix" or banner[2] != "coordinate":
        raise FormatError(f"not a coordinate matrix: {top[0]['line']!r}")
    if banner[3] not in FIELDS or banner[4] not in SYMMETRIES:
        raise FormatError(f"unsupported field or symmetry: {banner[3]} {banner[4]}")
    if len(top) < 2:
        raise FormatError("no size line")
    try:
        rows, cols, nnz = map(int, top[1]["line"].split())
    except ValueError:
        raise FormatError(f"bad size line: {top[1]['line']!r}") from None
    if min(rows, cols, nnz) < 0 or cols > INT32_MAX:
        raise FormatError(f"size out of range: {top[1]['line']!r}")
    return {"symmetry": banner[4], "rows": rows, "cols": cols, "nnz": nnz, "pos": top[1]["pos"]}


def entries(lines: DataFrame, head: dict) -> DataFrame:
    """pos, i, j, v (0-based) of the nnz entry lines after the size line; what follows them is ignored.

    Checked in one aggregate: enough entries, three numbers on each line, indices in range. All steps are filters and
    projections of ``lines``, which is read several times: pass written lines, as ``read_lines`` returns.
    """
    after = F.col("pos") > head["pos"]
    solid = (F.col("line") != "") & ~F.col("line").startswith("%")
    if head["nnz"] == 0:
        return lines.limit(0).select("pos", F.lit(0).cast("long").alias("i"), F.lit(0).cast("long").alias("j"), F.lit(0.0).alias("v"))
    # entries stand on consecutive lines but for comments and empty lines: count those up to the last entry's place until it stays
    end, reached = head["pos"] + head["nnz"], None
    while end != reached:
        reached = end
        end = head["pos"] + head["nnz"] + lines.where(after & (F.col("pos") <= reached) & ~solid).count()
    used = lines.where(after & (F.col("pos") <= end) & solid)
    t = _tokens(F.col("line"))
    number = lambda k: F.when(F.get(t, F.lit(k)).rlike(_INTEGER), F.get(t, F.lit(k))).try_cast("long")
    parsed = used.select("pos", number(0).alias("i"), number(1).alias("j"), F.get(t, F.lit(2)).try_cast("double").alias("v"), F.size(t).alias("n"))
    bad = (F.col("n") != 3) | F.col("i").isNull() | F.col("j").isNull() | F.col("v").isNull() | F.col("v").isin(float("inf"), float("-inf"))
    outside = ~F.col("i").between(1, head["rows"]) | ~F.col("j").between(1, head["cols"])
    found = parsed.agg(F.count("*").alias("n"), F.count_if(bad).alias("bad"), F.count_if(~bad & outside).alias("outside")).first()
    if found["bad"]:
        raise FormatError(f"{found['bad']} malformed entries")
    if found["n"] < head["nnz"]:
        raise FormatError(f"{found['n']} entries of {head['nnz']}")
    if found["outside"]:
        raise FormatError(f"{found['outside']} indices out of range")
    return parsed.select("pos", (F.col("i") - 1).alias("i"), (F.col("j") - 1).alias("j"), "v")


def expand_symmetric(coo: DataFrame) -> DataFrame:
    """A bag union with the mirror of every off-diagonal entry; doubles stay."""
    here, there = F.struct("i", "j", "v"), F.struct(F.col("j").alias("i"), F.col("i").alias("j"), "v")
    return coo.select(F.inline(F.when(F.col("i") != F.col("j"), F.array(here, there)).otherwise(F.array(here))))


def read_matrix(spark: SparkSession, path: str) -> tuple[DataFrame, int, int]:
    """coo (i, j, v), rows and columns of one file."""
    lines = read_lines(spark, path)
    head = header(lines)
    coo = entries(lines, head).select("i", "j", "v")
    return (expand_symmetric(coo) if head["symmetry"] == "symmetric" else coo), head["rows"], head["cols"]


def partition_vector(lines: DataFrame, rows: int, parts: int) -> DataFrame:
    """owner (i, rank) of a partition vector's lines; parts are 1-based in the file and all must be used."""
    solid = lines.where((F.trim("line") != "") & ((F.col("pos") == 0) | ~F.col("line").startswith("%")))
    top = solid.orderBy("pos").limit(2).collect()
    banner = top[0]["line"].split() if top else []
    if len(banner) != 5 or banner[0] != "%%MatrixMarket" or banner[1] not in ("vector", "matrix") or banner[2] != "array" or banner[4] != "general":
        raise FormatError("not a general array vector")
    size = top[1]["line"].split() if len(top) > 1 else []
    if not size or not all(s.isdigit() for s in size) or int(size[0]) != rows or (banner[1] == "matrix" and size[1:] != ["1"]):
        raise FormatError(f"wants {rows} rows, one column: {size}")
    values = number_by_position(solid.where(F.col("pos") > top[1]["pos"])).select("i", F.trim("line").try_cast("int").alias("part"))
    found = values.agg(F.count("*").alias("n"), F.count("part").alias("whole"), F.min("part").alias("least"), F.max("part").alias("most"), F.count_distinct("part").alias("used")).first()
    if found["n"] != rows or found["whole"] != rows:
        raise FormatError(f"{found['whole']} parts for {rows} rows")
    if rows and (found["least"] < 1 or found["most"] > parts or found["used"] != parts):
        raise FormatError(f"parts {found['least']} to {found['most']}, {found['used']} used, of {parts}")
    return values.select("i", (F.col("part") - 1).alias("rank"))
