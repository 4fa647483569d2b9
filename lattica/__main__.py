"""Command lines: ``python -m lattica solve | analyze | compare``.

Each runs on the session that spark-submit or the environment gives, and prints what the library returns.
"""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .operators import compare, partition
from .plans import cg, report
from .sources import campaign, logs, matrix_market


def _two(text: str) -> tuple[str, str]:
    left, _, right = text.partition("=")
    if not left or not right:
        raise argparse.ArgumentTypeError(f"wants two parts with = between them: {text!r}")
    return left, right


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="lattica", description=__doc__.split("\n")[0])
    commands = top.add_subparsers(dest="command", required=True)

    solve = commands.add_parser("solve", help="conjugate gradients on a Matrix Market file")
    solve.add_argument("--matrix", required=True)
    solve.add_argument("--residual-rtol", type=float, required=True)
    solve.add_argument("--residual-atol", type=float, default=0.0)
    solve.add_argument("--max-iters", type=int, default=1000)
    solve.add_argument("--warmup", type=int, default=10)
    solve.add_argument("--log-every", type=int, default=0)
    solve.add_argument("--manufactured-solution", action="store_true")
    solve.add_argument("--seed", type=int, default=0)
    solve.add_argument("--partition", help="a partition vector; its diagnostics are printed")
    solve.add_argument("--ranks", type=int, default=1, help="parts of the printed diagnostics")
    solve.add_argument("--output", help="folder that x is written to, as Parquet")

    analyze = commands.add_parser("analyze", help="a Markdown report of solver logs")
    analyze.add_argument("--backend", choices=("cuda", "sycl"), default="cuda")
    analyze.add_argument("--dataset", action="append", type=_two, required=True, metavar="LABEL=PATH")
    analyze.add_argument("--output", default="reports/results_summary.md")
    analyze.add_argument("--reference-report")

    paired = commands.add_parser("compare", help="paired portable and native runs of a campaign")
    paired.add_argument("root", help="folder of the campaign's runs, one folder a label")
    paired.add_argument("--pair", action="append", type=_two, required=True, metavar="PORTABLE=NATIVE", help="labels of the runs that are compared")
    return top


def run_solve(spark: SparkSession, args: argparse.Namespace) -> list[str]:
    coo, n, cols = matrix_market.read_matrix(spark, args.matrix)
    if n != cols:
        raise ValueError(f"a square matrix is wanted: {n} rows, {cols} columns")
    rows = spark.range(n).withColumnRenamed("id", "i")
    given = matrix_market.partition_vector(matrix_market.read_lines(spark, args.partition), n, args.ranks) if args.partition else None
    owner = partition.build(coo, rows, args.ranks, "file" if given is not None else "row-block", given)
    owned = partition.with_block_owners(coo, n, args.ranks) if given is None else partition.with_owners(coo, owner)
    x, result = cg.solve(coo, rows, rtol=args.residual_rtol, atol=args.residual_atol, max_iters=args.max_iters, warmup=args.warmup, log_every=args.log_every, manufactured_solution=args.manufactured_solution, seed=args.seed)
    if args.output:
        x.write.mode("overwrite").parquet(args.output)
    lines = [f"ranks: {args.ranks}", *(f"iteration {k} residual {r:.6e}" for k, r in result.history)]
    lines += [r["line"] for r in report.rank_lines(partition.stats(owner, owned)).orderBy("rank").collect()]
    return lines + cg.report_lines(result)


def run_analyze(spark: SparkSession, args: argparse.Namespace) -> list[str]:
    reference = None
    if args.reference_report:
        reference = campaign.reference_table(matrix_market.read_lines(spark, args.reference_report))
    report.analyze(spark, dict(args.dataset), "native" if args.backend == "cuda" else "portable", reference, args.output)
    return [f"wrote {args.output}"]


def run_compare(spark: SparkSession, args: argparse.Namespace) -> list[str]:
    texts, pairs = matrix_market.read_texts(spark, args.root), dict(args.pair)
    jobs = compare.job_pairs(logs.campaign_runs(texts.where(F.col("file").rlike(logs.CAMPAIGN_NAME)), pairs), pairs)
    return report.paired_lines(jobs, compare.pair_cells(jobs))


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    args = parser().parse_args(argv)
    spark = spark or SparkSession.builder.appName("lattica").getOrCreate()
    try:
        lines = {"solve": run_solve, "analyze": run_analyze, "compare": run_compare}[args.command](spark, args)
    except (ValueError, ArithmeticError) as fault:
        print(fault, file=sys.stderr)
        return 1
    print("\n".join(lines))
    return 0


if __name__ == "__main__":
    sys.exit(main())
