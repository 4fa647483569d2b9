"""Exact order statistics of groups of any size, by histograms over a narrowing range of values."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import drop_stash, stash

#: Values of a group, or of a range, that are sorted in one task, and buckets of a histogram.
SORTED, BUCKETS = 4096, 1024
#: More than minus the logarithm of the least double above 0.
LEAST_LOG = 745.0


def order_statistics(values: DataFrame, group: list[str], value: str, quantiles: dict[str, float], most: int = SORTED, buckets: int = BUCKETS) -> DataFrame:
    """``group`` columns, n, and of the n values (doubles, not null) sorted from 0 the one at floor(q (n - 1)), by name of q.

    Groups of ``most`` values at most are sorted. For the others, of which there are few for as many values, each
    round counts the values of the range that holds the rank by bucket, and goes on with the one bucket that has it, until that
    has ``most`` values or only equal ones: no task holds more than a histogram or ``most`` values. NaN is the greatest value;
    nulls in ``group`` are equal; groups without values have no row.
    """
    names = list(quantiles)
    aside = {c: f"_g{i}" for i, c in enumerate(group)}
    keys = list(aside.values())
    rows = values.select(*[F.col(f"`{c}`").alias(a) for c, a in aside.items()], F.col(value).cast("double").alias("_v")).where("_v is not null")
    total = stash(rows.groupBy(*keys).agg(F.count("*").alias("n"), F.min("_v").alias("lo"), F.max("_v").alias("hi")), "order-groups", free=False)
    rank = lambda q: F.floor(F.lit(float(q)) * (F.col("n") - 1)).cast("long")

    def kept(left: DataFrame, right: DataFrame) -> DataFrame:
        other = right.select(*[F.col(k).alias(f"r{k}") for k in keys], *[c for c in right.columns if c not in keys])
        on = [F.col(k).eqNullSafe(F.col(f"r{k}")) for k in keys] or F.lit(True)
        return left.join(other, on).drop(*[f"r{k}" for k in keys])

    few = total.where(F.col("n") <= most).select(*keys, "n")
    listed = kept(rows, few).groupBy(*keys).agg(F.array_sort(F.collect_list("_v")).alias("_s"), F.count("*").alias("n"))
    done = listed.select(*keys, "n", *[F.get("_s", rank(quantiles[c]).cast("int")).alias(c) for c in names])

    # one row for each group and quantile that is open: rank within [lo, hi]
    named = F.explode(F.array(*[F.struct(F.lit(c).alias("q"), rank(quantiles[c]).alias("k")) for c in names]))
    open_ranges = stash(total.where(F.col("n") > most).select(*keys, "n", "lo", "hi", F.col("n").alias("inside"), named.alias("_q")).select(*keys, "n", "lo", "hi", "inside", "_q.q", "_q.k"), "order-open", free=False)
    found = []
    while open_ranges.limit(1).count():
        at_end = stash(open_ranges.where((F.col("lo") == F.col("hi")) | (F.col("inside") <= most)), "order-end", free=False)
        ties = at_end.where("lo = hi").select(*keys, "n", "q", F.col("lo").alias("v"))
        short = at_end.where("lo <> hi")
        inside = kept(rows, short).where(F.col("_v").between(F.col("lo"), F.col("hi")))
        sorted_ = inside.groupBy(*keys, "n", "q", "k").agg(F.array_sort(F.collect_list("_v")).alias("_s")).select(*keys, "n", "q", F.get("_s", F.col("k").cast("int")).alias("v"))
        found.append(stash(ties.unionByName(sorted_), "order-found", free=False))
        wide = open_ranges.where((F.col("lo") < F.col("hi")) & (F.col("inside") > most))
        # by value and by magnitude in turn, so that values that lie however unevenly take few rounds
        scale = (lambda c: F.col(c) / 2) if len(found) % 2 == 0 else (lambda c: F.signum(c) * (F.coalesce(F.log(F.abs(F.nullif(F.col(c), F.lit(0.0)))), F.lit(0.0)) + LEAST_LOG))
        # at the ends, and where NaN or an infinity is an end, the share is no number
        share = (scale("_v") - scale("lo")) / F.nullif(scale("hi") - scale("lo"), F.lit(0.0))
        bucket = F.when(F.col("_v") == F.col("hi"), buckets).when(F.col("_v") == F.col("lo"), -1).otherwise(F.coalesce(F.greatest(F.lit(0), F.least(F.lit(buckets - 1), F.floor(F.nanvl(share, F.lit(0.5)) * buckets).cast("int"))), F.lit(0)))
        placed = kept(rows, wide).where(F.col("_v").between(F.col("lo"), F.col("hi")))
        counts = placed.groupBy(*keys, "n", "q", "k", bucket.alias("_b")).agg(F.count("*").alias("m"), F.min("_v").alias("lo"), F.max("_v").alias("hi"))
        steps = counts.groupBy(*keys, "n", "q", "k").agg(F.array_sort(F.collect_list(F.struct("_b", "m", "lo", "hi"))).alias("h"))
        start = F.struct(F.col("k").alias("k"), F.lit(None).cast("struct<_b:int,m:bigint,lo:double,hi:double>").alias("at"))
        walk = F.aggregate("h", start, lambda a, x: F.when(a["at"].isNotNull(), a).when(a["k"] < x["m"], F.struct(a["k"].alias("k"), x.alias("at"))).otherwise(F.struct((a["k"] - x["m"]).alias("k"), a["at"].alias("at"))))
        narrower = steps.select(*keys, "n", "q", walk.alias("w")).select(*keys, "n", F.col("w.at.lo").alias("lo"), F.col("w.at.hi").alias("hi"), F.col("w.at.m").alias("inside"), "q", F.col("w.k").alias("k"))
        following = stash(narrower, "order-open", free=False)
        drop_stash(open_ranges)
        open_ranges = following
    if found:
        every = found[0]
        for part in found[1:]:
            every = every.unionByName(part)
        large = every.groupBy(*keys, "n").agg(*[F.max(F.when(F.col("q") == c, F.col("v"))).alias(c) for c in names])
        done = done.unionByName(large)
    return done.where("n > 0").select(*[F.col(a).alias(c) for c, a in aside.items()], "n", *names)
