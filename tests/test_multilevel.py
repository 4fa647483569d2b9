"""Contraction: what a level leaves, under which bound, and how often it reads the edges."""

from pyspark.sql import functions as F

from lattica.operators import multilevel


def test_levels_are_few_and_clusters_bounded(spark, monkeypatch):
    """A level leaves under a third of the vertices of a ring of dense groups, no cluster above the bound, and all edge weight between clusters."""
    monkeypatch.setattr(multilevel, "TREE", 8)
    rows = spark.range(600).select(F.col("id").alias("i"))
    near = F.explode(F.array(*[F.floor(F.col("i") / 20) * 20 + (F.col("i") * k + k) % 20 for k in range(1, 7)], (F.col("i") + 20) % 600))
    coo = rows.select("i", near.alias("j"))
    vertices, edges = multilevel.graph(coo, rows)
    fewer, lighter, names = multilevel.contracted(vertices, edges, 12, 0)
    of = {r["v"]: r["coarse"] for r in names.collect()}
    weight = {r["v"]: r["w"] for r in fewer.collect()}
    assert sorted(of) == list(range(600)) and weight == {c: sum(x == c for x in of.values()) for c in set(of.values())}
    assert max(weight.values()) <= 12 and len(weight) < 200
    want = {}
    for r in edges.collect():
        if of[r["a"]] != of[r["b"]]:
            k = (of[r["a"]], of[r["b"]])
            want[k] = want.get(k, 0) + r["w"]
    assert {(r["a"], r["b"]): r["w"] for r in lighter.collect()} == want
    assert all((r["wa"], r["wb"]) == (weight[r["a"]], weight[r["b"]]) for r in lighter.collect())


def test_star_and_lonely_vertices_contract(spark):
    """Leaves that share their only neighbour, and vertices without any, go together, up to the bound."""
    rows = spark.range(300).select(F.col("id").alias("i"))
    coo = spark.range(1, 200).select(F.lit(0).cast("long").alias("i"), F.col("id").alias("j"))
    vertices, edges = multilevel.graph(coo, rows)
    fewer, _, names = multilevel.contracted(vertices, edges, 10, 0)
    sizes = [r["w"] for r in fewer.collect()]
    assert sum(sizes) == 300 and max(sizes) <= 10 and len(sizes) <= 31
    assert names.count() == 300


def test_parts_without_ties_to_room_give_their_surplus(spark):
    """Two components in parts 0 and 1, none tied to the empty part 2: refinement moves nothing, yet no part stays above the bound."""
    rows = spark.range(200).select(F.col("id").alias("i"))
    coo = rows.select("i", F.explode(F.array(F.when(F.col("i") % 100 < 99, F.col("i") + 1), F.when(F.col("i") % 100 < 93, F.col("i") + 7))).alias("j")).where("j is not null")
    vertices, edges = multilevel.graph(coo, rows)
    parts = vertices.withColumn("part", F.floor(F.col("v") / 100).cast("int"))
    parts, counts = multilevel.refined(parts, edges, 3, 64, 68)
    assert max(counts.weight.values()) == 100
    parts, counts = multilevel.evened(parts, edges, counts, 3, 68)
    of = {r["v"]: r["part"] for r in parts.collect()}
    assert max(counts.weight.values()) <= 68 and counts.weight == {p: list(of.values()).count(p) for p in range(3)}
    assert counts.cut == sum(of[r["a"]] != of[r["b"]] for r in edges.collect()) / 2
