"""Operators that part, rank, scan or select without gathering a group: against their plain forms on small inputs."""

import ctypes
import math
import random

import pytest
from pyspark.sql import functions as F

from lattica import fixtures, queries
from lattica.functions import stream
from lattica.operators import linalg, multilevel, partition, quantiles, ranking, windows
from lattica.plans import cg, ghosts

DATA = "/root/testdata/sf0.001"


def clusters(groups, each, inside, between, seed=3):
    """Edges of a graph of dense groups and few edges between them, its vertices shuffled."""
    rng = random.Random(seed)
    name = list(range(groups * each))
    rng.shuffle(name)
    edges = set()
    for g in range(groups):
        for _ in range(inside):
            a, b = rng.sample(range(g * each, g * each + each), 2)
            edges.add((min(name[a], name[b]), max(name[a], name[b])))
    planted = set()
    for _ in range(between):
        g, h = rng.sample(range(groups), 2)
        a, b = name[g * each + rng.randrange(each)], name[h * each + rng.randrange(each)]
        planted.add((min(a, b), max(a, b)))
    return edges | planted, len(planted - edges)


def test_multilevel_finds_clusters_and_keeps_counts(spark):
    edges, planted = clusters(3, 40, 300, 20)
    coo = spark.createDataFrame([(a, b, 1.0) for a, b in edges] + [(5, 5, 2.0), (3, 999, 1.0)], "i long, j long, v double")
    rows = spark.range(120).withColumnRenamed("id", "i")
    rounds = []

    def watch(parts, ties, counts):
        rounds.append(counts)
        assert multilevel.counted(ties, parts) == counts

    owner, counts = multilevel.kway(coo, rows, 3, balance=1.1, coarse=20, watch=watch)
    of = {r["i"]: r["rank"] for r in owner.collect()}
    assert sorted(of) == list(range(120)) and rounds
    assert counts.cut == sum(of[a] != of[b] for a, b in edges) <= 3 * planted
    assert counts.weight == {p: list(of.values()).count(p) for p in range(3)} and max(counts.weight.values()) <= 44
    ties = {(v, of[u]) for a, b in edges for v, u in ((a, b), (b, a)) if of[u] != of[v]}
    assert counts.ghosts == {p: sum(q == p for _, q in ties) for p in range(3)}
    assert counts.exports == {p: sum(of[v] == p for v, _ in ties) for p in range(3)}


def test_multilevel_without_edges_and_small(spark):
    rows = spark.range(7).withColumnRenamed("id", "i")
    none = spark.createDataFrame([], "i long, j long, v double")
    owner = {r["i"]: r["rank"] for r in multilevel.kway(none, rows, 3, coarse=1)[0].collect()}
    assert sorted(owner) == list(range(7)) and sorted(list(owner.values()).count(p) for p in range(3)) == [2, 2, 3]
    star = spark.createDataFrame([(0, k, 1.0) for k in range(1, 7)], "i long, j long, v double")
    owner, counts = multilevel.kway(star, rows, 2, coarse=2)
    assert max(counts.weight.values()) <= 4 and counts.cut == 3 and owner.count() == 7
    with pytest.raises(ValueError):
        multilevel.kway(star, rows, 0)


def laplacian(spark, n, shift=0):
    pairs = [(i, j, -1.0) for i in range(n) for j in (i - 7, i - 1, i + 1, i + 7) if 0 <= j < n]
    return spark.createDataFrame([(i + shift, j + shift, v) for i, j, v in [*pairs, *((i, i, 5.0) for i in range(n))]], "i long, j long, v double")


def test_ghost_products_and_solutions(spark, shift=1000):
    coo = laplacian(spark, 60, shift)
    rows = spark.range(shift, shift + 60).withColumnRenamed("id", "i")
    b = rows.select("i", (F.col("i") % 7 - 3.0).alias("val"))
    plain = {r["i"]: r["val"] for r in linalg.spmv(coo, b, rows).collect()}
    for owner in (rows.select("i", (F.col("i") * 7 % 5).cast("int").alias("rank")), ghosts.row_blocks(rows, 280, 400)):
        layout = ghosts.Layout(coo, owner)
        first = layout.states(b)
        state, rho, delta = layout.step(first, 0.0, 0.0)
        product = {r["i"]: r["val"] for r in layout.vector(state, "w").collect()}
        assert product == pytest.approx(plain)
        assert rho == pytest.approx(sum(r["val"] ** 2 for r in b.collect())) and delta == pytest.approx(sum((i % 7 - 3.0) * v for i, v in plain.items()))
        ghost_values = layout.sends.read().agg(F.sum(F.octet_length("local")) / 8).first()[0] or 0
        assert ghost_values == partition.halo_imports(partition.with_owners(coo, owner)).count()
        x, result = cg.solve(coo, rows, b, rtol=1e-4, owner=owner)
        assert result.converged and result.true_rel_residual < 1e-3 and x.count() == 60


def test_only_ghosts_are_exchanged(spark):
    coo, rows = laplacian(spark, 40), spark.range(40).withColumnRenamed("id", "i")
    layout = ghosts.Layout(coo, rows.select("i", (F.col("i") % 4).cast("int").alias("rank")))
    state = layout.states(rows.select("i", F.lit(1.0).alias("val")))
    lines = layout.stepped(state, 0.5, 0.5)._jdf.queryExecution().executedPlan().toString().splitlines()
    exchanges = [k for k, line in enumerate(lines) if "Exchange " in line]
    # what moves are the packed values of mapInArrow; blocks and states are read where they lie
    assert len(exchanges) == 1 and "value" in lines[exchanges[0] + 1] and "MapInArrow" in lines[exchanges[0] + 2]


def sequential(seed, count):
    """The generator as its manual has it, value by value."""
    r = [seed or 1]
    for _ in range(30):
        word = 16807 * r[-1] % 2147483647
        r.append(word)
    r += r[:3]
    while len(r) < 344 + count:
        r.append((r[-3] + r[-31]) % 2**32)
    return [x >> 1 for x in r[344:]]


@pytest.mark.parametrize("seed", [0, 1, 101])
def test_stream_at_any_split(spark, seed):
    wanted = [2.0 * (x / 2147483647) - 1.0 for x in sequential(seed, 3000)]
    for size, parts in ((8192, 1), (100, 3), (31, 7), (1, 2)):
        count = 3000 if size > 1 else 40
        rows = spark.range(count).withColumnRenamed("id", "i").repartition(parts)
        got = {r["i"]: r["val"] for r in stream.with_stream(rows, seed, size=size).collect()}
        assert [got[i] for i in range(count)] == wanted[:count]


@pytest.mark.parametrize("seed", [1, 101, 2**31, 2**32 - 5])
def test_stream_is_that_of_the_c_library(seed):
    libc = ctypes.CDLL(None)
    libc.srand(ctypes.c_uint(seed))
    assert [round((x + 1) / 2 * 2147483647) for x in stream.block(seed, 0, 500)] == [libc.rand() for _ in range(500)]


def test_order_statistics_of_large_and_small_groups(spark):
    rng = random.Random(5)
    rows = [("big", rng.choice([rng.gauss(0, 1), 7.0, 10.0 ** rng.randrange(-300, 300)])) for _ in range(3000)]
    rows += [("ties", 2.5)] * 500 + [("two", float(k % 2)) for k in range(400)] + [(None, float(k)) for k in range(300)] + [("one", 1.0), ("none", None)]
    rows += [("odd", x) for x in (float("inf"), float("-inf"), 0.0, -0.0, float("nan"))] + [("odd", k / 3) for k in range(60)]
    frame = spark.createDataFrame(rows, "g string, v double").repartition(5)
    wanted = {}
    for g in {g for g, v in rows if v is not None}:
        s = sorted((v for h, v in rows if h == g and v is not None), key=lambda x: (math.isnan(x), x))
        wanted[g] = (len(s), *(s[math.floor(q * (len(s) - 1))] for q in (0.0, 0.5, 0.99, 1.0)))
    for most, buckets in ((4096, 1024), (50, 64)):
        got = {r["g"]: tuple(r)[1:] for r in quantiles.order_statistics(frame, ["g"], "v", {"a": 0.0, "b": 0.5, "c": 0.99, "d": 1.0}, most, buckets).collect()}
        assert {g: tuple(map(str, (x + 0.0 for x in v))) for g, v in got.items()} == {g: tuple(map(str, (x + 0.0 for x in v))) for g, v in wanted.items()}
    assert quantiles.order_statistics(frame.where("false"), ["g"], "v", {"a": 0.5}).count() == 0


def test_scans_in_splits_equal_one_scan(spark):
    rng = random.Random(2)
    kinds = ["alpha:", "beta:", "", "  in", "out", "value"]
    rows = [(f, p, rng.choices(kinds, [1, 1, 2, 4, f + 1, 2])[0]) for f in range(3) for p in range(400)] + [(None, p, k) for p, k in enumerate(["value", "alpha:", "  in", "value", "value"])]
    lines = spark.createDataFrame(rows, "file int, pos int, line string").repartition(4)

    def both(split):
        found = windows.sections(lines, {"alpha:": "a", "beta:": "b"}, split=split).collect()
        value = F.when(F.col("line") == "value", F.col("pos"))
        waits = windows.pending_value(lines, F.col("line").isin("alpha:", "beta:"), F.col("line") == "alpha:", value, "got", split=split)
        assert waits.columns == ["file", "pos", "line", "got"]
        return sorted(map(str, found)), sorted(map(str, waits.collect()))

    whole = both(1000)
    assert len(whole[0]) == sum(k not in ("alpha:", "beta:") for _, _, k in rows)
    state, wanted = {}, []
    for f, p, k in rows:
        now = state.setdefault(f, {"bare": False, "seen": False})
        if k in ("alpha:", "beta:"):
            now |= {"bare": k == "alpha:", "seen": False}
        got = p if k == "value" and now["bare"] and not now["seen"] else None
        now["seen"] |= k == "value"
        wanted.append(f"Row(file={f}, pos={p}, line={k!r}, got={got})")
    assert whole[1] == sorted(wanted)
    for split in (1, 7, 20):
        assert both(split) == whole


def test_ranks_within_groups_of_any_size(spark, tmp_path):
    rng = random.Random(4)
    rows = [(rng.choice([0, 0, 0, 0, 1, 2, None]), rng.randrange(50)) for _ in range(2000)]
    spark.createDataFrame(rows, "g int, v int").write.parquet(f"{tmp_path}/t")
    frame = spark.read.parquet(f"{tmp_path}/t")
    got = ranking.with_rank(frame, "k", [F.col("v").desc()], ["g"], partitions=9).collect()
    for g in (0, 1, 2, None):
        mine = sorted((r["k"], -r["v"]) for r in got if r["g"] == g)
        assert [k for k, _ in mine] == list(range(len(mine))) and [v for _, v in mine] == sorted(v for _, v in mine)
    alike = ranking.with_rank(spark.range(300).select(F.lit(1).alias("x")), "k", [F.col("x").asc()], partitions=4)
    assert sorted(r["k"] for r in alike.collect()) == list(range(300))


def test_matrix_is_dealt_by_its_size(spark, monkeypatch):
    """More order lines are more tasks, each of as many entries as before, and row sums need no other shuffle."""
    monkeypatch.setattr(fixtures, "LINES_A_TASK", 500)
    coo = fixtures.coo(spark, DATA)
    assert coo.rdd.getNumPartitions() == fixtures.tasks(spark, DATA) > 4
    plan = partition.to_csr(coo)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(i#") == 1


@pytest.mark.parametrize("name", ["j1_spmv", "j2_split_spmv", "j14_true_residual"])
def test_products_move_the_entries_once(spark, monkeypatch, name):
    """Where the vector is not broadcast, entries are summed where their column's value comes: one shuffle of theirs before the products."""
    small = sorted(map(tuple, queries.queries()[name](spark, DATA).collect()))
    monkeypatch.setattr(fixtures, "LINES_A_TASK", 500)
    monkeypatch.setattr(linalg, "BROADCAST_ROWS", 0)
    out = queries.queries()[name](spark, DATA)
    assert sorted(map(tuple, out.collect())) == small
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    # entries by j; values by j; beside them the order lines alone, by o, for each side of their pairs
    assert plan.count("RepartitionByExpression [j#") == 2 and plan.count("RepartitionByExpression [i#") == 0
    joined = [line for line in out._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[-1].splitlines() if "Exchange hashpartitioning(j#" in line]
    assert len(joined) == 2 and all("REPARTITION_BY_NUM" in line for line in joined)


def test_stats_read_the_entries_once(spark):
    rows = spark.range(40).select(F.col("id").alias("i"))
    coo = rows.select("i", F.explode(F.array(F.col("i"), (F.col("i") * 3 + 7) % 40, (F.col("i") * 3 + 7) % 40)).alias("j")).withColumn("v", F.lit(1.0))
    owned = partition.with_block_owners(coo, 40, 5).withColumn("read", F.lit(1))
    stats = partition.stats(partition.row_block(rows, 40, 5), owned)
    entries = [(r["i"], r["j"]) for r in coo.collect()]
    want = {}
    for p in range(5):
        mine = [(i, j) for i, j in entries if i // 8 == p]
        far = [(i, j) for i, j in mine if j // 8 != p]
        ghosts_ = len({j for _, j in far})
        want[p] = (8, len(mine), len(mine) - len(far), len(far), ghosts_, ghosts_, len({(i // 8, j) for i, j in entries if j // 8 == p != i // 8}))
    assert {r["rank"]: tuple(r)[1:] for r in stats.collect()} == want
    assert stats._jdf.queryExecution().optimizedPlan().toString().count("Generate explode") == 1


def test_matrix_lines_are_ranked_by_ranges(spark):
    """Lines of the file are numbered over range partitions, none of them in one task."""
    lines = queries._mm_lines(spark, DATA)
    assert "row_number()" not in lines._jdf.queryExecution().optimizedPlan().toString()
    found = lines.where("pos > 3").orderBy("pos").collect()
    assert [r["pos"] for r in found] == list(range(4, 4 + len(found))) and found[-2]["line"] == "left over"
    places = [tuple(map(int, r["line"].split()[:2])) for r in found[:-2]]
    assert places == sorted(places)


def test_ranks_of_any_size_are_solved_in_blocks(spark, monkeypatch):
    """A rank of many entries is several blocks; solution and traffic between ranks stay as they are."""
    entries = 60
    monkeypatch.setattr(ghosts, "BLOCK_ENTRIES", entries)
    rows = spark.range(90).select(F.col("id").alias("i"))
    near = rows.select("i", F.explode(F.array((F.col("i") + 1) % 90, (F.col("i") + 89) % 90, (F.col("i") + 45) % 90, "i")).alias("j"))
    coo = near.select("i", "j", F.when(F.col("i") == F.col("j"), 5.0).otherwise(-1.0).alias("v"))
    given = rows.select("i", (F.col("i") * 7 % 2).cast("int").alias("rank"))
    owner, homes = ghosts.split_ranks(coo, given, entries)
    assert homes.count() == 6
    layout = ghosts.Layout(coo, owner)
    most = layout.blocks.read().agg(F.max(F.octet_length("v") / 8)).first()[0]
    assert most == entries
    got = {(r["rank"], r["to"]): r["n"] for r in layout.traffic(homes).collect()}
    sent = partition.halo_imports(partition.with_owners(coo, given)).groupBy("peer", "rank").count().collect()
    assert got == {(r["peer"], r["rank"]): r["count"] for r in sent}
    wanted = {i: (i % 7) - 3.0 for i in range(90)}
    x_star = rows.select("i", (F.col("i") % 7 - 3).cast("double").alias("val"))
    for where in (given, None):
        x, result = cg.solve(coo, rows, solution=x_star, rtol=1e-5, max_iters=40, owner=where)
        assert result.converged and result.true_rel_residual < 1e-4
        assert all(abs(r["val"] - wanted[r["i"]]) < 1e-3 for r in x.collect())
    layout.drop()
