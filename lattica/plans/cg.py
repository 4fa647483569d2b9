"""Conjugate gradients as a driver loop over DataFrames.

The matrix lies in blocks by rank (``ghosts``); an iteration moves ghost values alone and writes its state once to
the shared folder, which ends its lineage and survives lost executors. With w = A r beside t = A s, both dot products that the
next step needs, (r, r) and (r, w), are observed by that one write, so an iteration is one job, and they are
the only values that reach the driver: (s, t) = (r, w) - beta (r, r) / alpha, of the step before.
"""

from __future__ import annotations

import math
import time
from collections.abc import Iterator
from dataclasses import asdict, dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.stream import with_stream
from ..operators import linalg
from ..storage import stash
from . import ghosts


#: Entries to a task of the residual check.
ENTRIES_A_TASK = 1 << 20


class Breakdown(ArithmeticError):
    """A dot product that is not finite, or a matrix that is not positive definite."""


@dataclass
class SolverResult:
    converged: bool
    iterations: int
    initial_residual: float
    residual: float
    solve_s: float
    true_residual: float
    true_rel_residual: float
    relative_error: float | None
    gflops: float
    history: list[tuple[int, float]] = field(default_factory=list)


def exact_solution(rows: DataFrame, seed: int = 0) -> DataFrame:
    """i, val: the values of a C library's stream for ``seed`` at each row number, scaled to unit 2-norm."""
    raw = stash(with_stream(rows, seed), "cg-stream", free=False)
    scale = raw.agg(linalg.norm(F.col("val"))).first()[0] or 1.0
    return raw.select("i", (F.col("val") / scale).alias("val"))


def converged(residual: float, first: float, rtol: float, atol: float) -> bool:
    return residual == 0 or (atol > 0 and residual < atol) or (rtol > 0 and residual < rtol * first)


def _check(gamma: float, rho: float) -> None:
    if not math.isfinite(gamma) or not math.isfinite(rho):
        raise Breakdown("a dot product is not finite")
    if gamma <= 0:
        raise Breakdown("the matrix is not positive definite")


def solve(
    coo: DataFrame, rows: DataFrame, b: DataFrame | None = None, *, rtol: float = 0.0, atol: float = 0.0, max_iters: int = 1000, warmup: int = 0, log_every: int = 0, manufactured_solution: bool = False, seed: int = 0, owner: DataFrame | None = None, solution: DataFrame | None = None
) -> tuple[DataFrame, SolverResult]:
    """x (i, val) and what happened. Without ``b``, b is all ones, or A x* for a manufactured solution.

    ``solution`` (i, val) is an x* given: b is A x*. ``owner`` (i, rank) parts the matrix, a rank of more than about
    ``ghosts.BLOCK_ENTRIES`` entries in blocks; without it, blocks of rows do.
    """
    coo = stash(coo.select("i", "j", "v"), "cg-matrix")
    rows = stash(rows.select("i"), "cg-rows")
    n, nnz = rows.count(), coo.count()
    exact = stash(exact_solution(rows, seed), "cg-exact") if manufactured_solution else None
    layout = ghosts.Layout(coo, ghosts.split_ranks(coo, owner)[0]) if owner is not None else ghosts.row_layout(coo, rows, nnz)
    x_star = exact if exact is not None else solution
    if b is None:
        b = layout.product(x_star) if x_star is not None else rows.select("i", F.lit(1.0).alias("val"))
    b = stash(b.select("i", "val"), "cg-rhs")

    def start() -> tuple[ghosts.Table, float, float]:
        first = layout.states(b)
        state, rho, delta = layout.step(first, 0.0, 0.0)
        first.drop()
        return state, rho, delta

    def iterations(check: bool) -> Iterator[tuple[ghosts.Table, float]]:
        """The state at each step and its (r, r), from the first one."""
        state, rho, delta = start()
        alpha, beta = 0.0, 0.0
        while True:
            yield state, rho
            gamma = delta - (beta * rho / alpha if alpha else 0.0)
            if check:
                _check(gamma, rho)
            alpha = rho / gamma if gamma else 0.0
            moved, following, delta = layout.step(state, alpha, beta)
            if check:
                _check(gamma, following)
            state.drop()
            beta = following / rho if rho else 0.0
            state, rho = moved, following

    if warmup:
        for k, (state, _) in enumerate(iterations(False)):
            if k == warmup:
                state.drop()
                break

    began = time.perf_counter()
    steps = iterations(True)
    state, rho = next(steps)
    first = residual = math.sqrt(rho)
    done, k, history = converged(residual, first, 0.0, atol), 0, []
    while not done and k < max_iters:
        state, rho = next(steps)
        k, residual = k + 1, math.sqrt(rho)
        if log_every and k % log_every == 0:
            history.append((k, residual))
        done = converged(residual, first, rtol, atol)
    took = time.perf_counter() - began
    x = layout.vector(state)
    state.drop()
    layout.drop()
    true = linalg.residual(coo, x, b, rows, n, max(1, nnz // ENTRIES_A_TASK)).first()
    error = linalg.solution_error(x, exact).first()[0] if exact is not None else None
    flops = 2 * n + k * (2 * nnz + 11 * n)
    return x, SolverResult(done, k, first, residual, took, true["residual_norm"], true["true_rel_residual"], error, flops / took / 1e9 if took else 0.0, history)


def report_lines(result: SolverResult) -> list[str]:
    """The lines that a solve prints; log parsers read them back."""
    r = asdict(result)
    error = "" if result.relative_error is None else f" relative_error={result.relative_error:.6e}"
    us = 1e6 * result.solve_s / result.iterations if result.iterations else 0.0
    ratio = result.residual / result.initial_residual if result.initial_residual else 0.0
    return [
        f"solver: converged={str(result.converged).lower()} iterations={result.iterations} residual={r['residual']:.6e} rel_residual_r0={ratio:.6e} rel_residual_rhs={ratio:.6e}{error} gflops={result.gflops:.6f} solve_time={result.solve_s:.6f}s",
        f"timing: schema=3 solver_s={result.solve_s:.6f} solver_max_s={result.solve_s:.6f} solver_min_s={result.solve_s:.6f} per_iter_us={us:.6f}",
        f"validation: true_residual={result.true_residual:.6e} true_rel_residual={result.true_rel_residual:.6e}",
    ]
