"""Matrix files, partitions and the solver."""

import math

import pytest
from pyspark.sql import functions as F

from lattica.operators import linalg, partition, summary, windows
from lattica.plans import cg
from lattica.sources import matrix_market as M


def coo_of(spark, entries):
    return spark.createDataFrame(entries, "i long, j long, v double")


def lines(spark, text):
    return spark.createDataFrame([(p, x, "f") for p, x in enumerate(text.split("\n"))], "pos int, line string, file string")


GOOD = "%%MatrixMarket matrix coordinate real symmetric\n% c\n\n3 3 4\n1 1 4.0\n2 1 -1e0\n2 2 4\n3 3 4.0\nleft over"


def test_symmetric_file(spark, tmp_path):
    (tmp_path / "m.mtx").write_text(GOOD + "\n")
    coo, rows, cols = M.read_matrix(spark, str(tmp_path / "m.mtx"))
    assert (rows, cols) == (3, 3)
    assert sorted(map(tuple, coo.collect())) == [(0, 0, 4.0), (0, 1, -1.0), (1, 0, -1.0), (1, 1, 4.0), (2, 2, 4.0)]


@pytest.mark.parametrize(
    ("old", "new"),
    [("real", "pattern"), ("coordinate", "array"), ("%%MatrixMarket", "%%matrixmarket"), ("3 3 4", "3 3 9"), ("3 3 4", "-3 3 4"), ("3 3 4", "3 2147483648 4"), ("2 2 4", "2 2 4 5"), ("2 2 4", "0 2 4"), ("2 2 4", "4 2 4"), ("2 2 4", "2 2 x"), ("2 2 4", "  "), ("2 2 4", "2 2 1e999")],
)
def test_broken_files(spark, old, new):
    bad = lines(spark, GOOD.replace("\nleft over", "").replace(old, new, 1))
    with pytest.raises(M.FormatError):
        M.entries(bad, M.header(bad))


def test_partition_vector(spark):
    text = "%%MatrixMarket vector array integer general\n% comment\n4\n1\n2\n\n2\n1"
    assert sorted(map(tuple, M.partition_vector(lines(spark, text), 4, 2).collect())) == [(0, 0), (1, 1), (2, 1), (3, 0)]
    for bad in (text.replace("2\n1", "3\n1"), text.replace("2", "1"), text.replace("vector", "matrix"), text.replace("integer general", "integer symmetric")):
        with pytest.raises(M.FormatError):
            M.partition_vector(lines(spark, bad), 4, 2)
    with pytest.raises(M.FormatError):
        M.partition_vector(lines(spark, text), 5, 2)


def test_duplicates_add_and_empty_rows_are_zero(spark):
    coo = coo_of(spark, [(0, 0, 1.0), (0, 0, 2.0), (2, 1, 5.0)])
    rows = spark.range(3).select(F.col("id").alias("i"))
    x = rows.select("i", F.lit(2.0).alias("val"))
    assert sorted(map(tuple, linalg.spmv(coo, x, rows, 3).collect())) == [(0, 6.0), (1, 0.0), (2, 10.0)]


def test_unsymmetric_exports_are_the_transpose(spark):
    coo = coo_of(spark, [(0, 3, 1.0), (1, 1, 1.0), (2, 2, 1.0), (3, 3, 1.0), (0, 2, 1.0), (1, 2, 1.0)])
    rows = spark.range(4).select(F.col("id").alias("i"))
    owner = partition.build(coo, rows, 2)
    owned = partition.with_owners(coo, owner)
    assert sorted(map(tuple, partition.halo_imports(owned).collect())) == [(0, 1, 2), (0, 1, 3)]
    assert sorted(map(tuple, partition.halo_exports(owned).collect())) == [(1, 0, 2), (1, 0, 3)]
    stats = {r["rank"]: r for r in partition.stats(owner, owned).collect()}
    assert (stats[0]["halo_nnz"], stats[0]["ghosts"], stats[0]["exports"], stats[1]["ghosts"], stats[1]["exports"]) == (3, 2, 0, 0, 2)


def test_build_rules(spark):
    coo = coo_of(spark, [(0, 0, 1.0)])
    rows = spark.range(3).select(F.col("id").alias("i"))
    given = rows.select("i", F.lit(0).alias("rank"))
    for kwargs in ({"method": "file"}, {"method": "odd"}, {"method": "metis", "given": given}, {"given": given}):
        with pytest.raises(ValueError):
            partition.build(coo, rows, 2, **kwargs)
    with pytest.raises(ValueError):
        partition.build(coo, rows, 4)
    assert partition.build(coo, rows, 1, "metis").count() == 3


def laplacian(spark, n):
    entries = [(i, i, 3.0) for i in range(n)] + [(i, i + 1, -1.0) for i in range(n - 1)] + [(i + 1, i, -1.0) for i in range(n - 1)]
    return coo_of(spark, entries), spark.range(n).select(F.col("id").alias("i"))


def test_solve_manufactured(spark):
    coo, rows = laplacian(spark, 12)
    x, r = cg.solve(coo, rows, rtol=1e-8, manufactured_solution=True, seed=101, warmup=1, log_every=2)
    assert r.converged and r.iterations <= 12 and r.relative_error < 1e-7 and r.true_rel_residual < 1e-7
    assert [k for k, _ in r.history] == [k for k in range(2, r.iterations + 1, 2)]
    assert x.agg(linalg.norm(F.col("val"))).first()[0] == pytest.approx(1.0, rel=1e-6)
    text = cg.report_lines(r)
    assert text[0].startswith("solver: converged=true") and "schema=3" in text[1]


def test_solve_stops_and_breaks(spark):
    coo, rows = laplacian(spark, 8)
    _, r = cg.solve(coo, rows, rtol=1e-12, max_iters=1)
    assert not r.converged and r.iterations == 1
    zero = rows.select("i", F.lit(0.0).alias("val"))
    _, r = cg.solve(coo, rows, zero, rtol=1e-6)
    assert r.converged and r.iterations == 0
    with pytest.raises(cg.Breakdown):
        cg.solve(coo.withColumn("v", -F.col("v")), rows, rtol=1e-6)
    assert cg.converged(0.0, 1.0, 0.0, 0.0) and not cg.converged(1e-6, 1.0, 1e-6, 0.0) and cg.converged(0.5, 1.0, 0.0, 0.6)


def test_prefix_sum_over_blocks(spark):
    df = spark.range(1000).select(F.col("id").alias("i"), (F.col("id") % 7).alias("n"))
    got = windows.exclusive_prefix_sum(df, "i", "n", "s", block=64).orderBy("i").collect()
    total = 0
    for r in got:
        assert r["s"] == total
        total += r["n"]


def test_percentiles_and_medians(spark):
    df = spark.range(1, 51).select(F.col("id").cast("double").alias("v"), F.lit(1).alias("g"))
    r = summary.latency_percentiles(df, "v", ["g"]).first()
    assert (r["min_us"], r["p50_us"], r["p99_us"], r["max_us"]) == (1.0, 25.0, 49.0, 50.0)
    four = spark.createDataFrame([(10.0,), (2.0,), (4.0,), (8.0,), (None,)], "v double")
    assert four.agg(*[c.alias(k) for k, c in summary.sample("v").items()]).first().asDict() == {"count": 4, "median": 6.0, "min": 2.0, "max": 10.0, "total": 24.0}
    assert math.isclose(four.agg(linalg.norm(F.col("v"))).first()[0], math.sqrt(184))


def test_a_file_in_several_splits(spark, tmp_path):
    """Lines keep their places across splits, with comments and empty lines between entries and a tail that counts for nothing."""
    n = 3000
    body = []
    for i in range(1, n + 1):
        body += [f"{i} {i} {i}.5"] + (["% note", ""] if i % 7 == 0 else [])
    (tmp_path / "m.mtx").write_text("\n".join(["%%MatrixMarket matrix coordinate real general", "% c", f"{n} {n} {n}", *body, "1 1 9", "tail"]) + "\n")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        lines = M.read_lines(spark, str(tmp_path / "m.mtx"))
        assert [tuple(r) for r in lines.select("pos", "line").orderBy("pos").limit(4).collect()][2] == (2, f"{n} {n} {n}")
        assert lines.count() == lines.select("pos").distinct().count() == 3 + len(body) + 2
        coo, rows, cols = M.read_matrix(spark, str(tmp_path / "m.mtx"))
        assert (rows, cols) == (n, n) and sorted(map(tuple, coo.collect())) == [(i, i, i + 1.5) for i in range(n)]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_block_owners_equal_the_given_map(spark):
    coo = coo_of(spark, [(i, j, 1.0) for i in range(11) for j in (0, i, 10)])
    rows = spark.range(11).select(F.col("id").alias("i"))
    given = partition.with_owners(coo, partition.row_block(rows, 11, 4))
    columns = ["i", "j", "v", "row_rank", "col_rank", "kind"]
    assert sorted(map(tuple, given.select(columns).collect())) == sorted(map(tuple, partition.with_block_owners(coo, 11, 4).select(columns).collect()))


def test_rows_that_one_vector_lacks(spark):
    vec = lambda rows: spark.createDataFrame(rows, "i long, val double")
    assert linalg.solution_error(vec([(0, 3.0), (2, 4.0)]), vec([(0, 3.0), (1, 3.0)])).first()[0] == pytest.approx(5 / math.sqrt(18))
    r = linalg.residual(coo_of(spark, [(0, 0, 1.0), (1, 1, 2.0)]), vec([(0, 3.0), (1, 2.0)]), vec([(0, 3.0)]), vec([(0, 0.0), (1, 0.0)])).first()
    assert r["residual_norm"] == 4.0 and r["rhs_norm"] == 3.0


def test_no_local_fallback_on_a_cluster(spark):
    from lattica import storage

    class Context:
        master = "spark://host:7077"
        getCheckpointDir = staticmethod(lambda: None)

    class Session:
        conf = spark.conf
        sparkContext = Context

    if not spark.conf.get("spark.checkpoint.dir", None):
        with pytest.raises(ValueError, match="checkpoint"):
            storage.shared_dir(Session)


def test_command_lines(spark, tmp_path, capsys):
    from lattica.__main__ import main

    (tmp_path / "m.mtx").write_text(GOOD + "\n")
    (tmp_path / "p.mtx").write_text("%%MatrixMarket vector array integer general\n3\n1\n2\n1\n")
    assert main(["solve", "--matrix", f"{tmp_path}/m.mtx", "--residual-rtol", "1e-8", "--warmup", "0", "--partition", f"{tmp_path}/p.mtx", "--ranks", "2", "--output", f"{tmp_path}/x"], spark) == 0
    out = capsys.readouterr().out
    assert "solver: converged=true" in out and "solver_diag_partition: 1 1 2 1 1 1 1 1" in out
    assert sorted(r["i"] for r in spark.read.parquet(f"{tmp_path}/x").collect()) == [0, 1, 2]
    assert main(["solve", "--matrix", f"{tmp_path}/p.mtx", "--residual-rtol", "1e-8"], spark) == 1
    for bad in (["solve", "--matrix", "m"], ["solve", "--odd"], ["analyze"], ["analyze", "--dataset", "x"]):
        with pytest.raises(SystemExit):
            main(bad, spark)
    log = "4 MPI processes\nUsing MPI for communication\n  total iterations: 30\n  total solver time: 2.5 seconds\n"
    (tmp_path / "logs/1n4g/v/suitesparse/M").mkdir(parents=True)
    (tmp_path / "logs/1n4g/v/suitesparse/M/a-stderr.txt").write_text(log)
    assert main(["analyze", "--dataset", f"CUDA={tmp_path}/logs", "--output", f"{tmp_path}/out/r.md"], spark) == 0
    assert "| CUDA | 1n4g | mpi | 4 | 1 | 2.500 |" in (tmp_path / "out/r.md").read_text()
    assert main(["compare", f"{tmp_path}/logs", "--pair", "ported=tuned"], spark) == 1
    with pytest.raises(SystemExit):
        main(["compare", f"{tmp_path}/logs"], spark)
    for label, name, text in (("tuned", "stderr", log), ("ported", "stdout", "solver: iterations=40\ntiming: solver_max_s=5.0\n")):
        (tmp_path / f"runs/{label}/suitesparse/M").mkdir(parents=True)
        (tmp_path / f"runs/{label}/suitesparse/M/x-001-nodes-0004-procs-77-1-{name}.txt").write_text(text)
    assert main(["compare", f"{tmp_path}/runs", "--pair", "ported=tuned", "--pair", "other=tuned"], spark) == 0
    assert " 2.00" in capsys.readouterr().out
