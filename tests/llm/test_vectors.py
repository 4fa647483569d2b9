import math
import random

import pytest

from lattica.llm import vectors

KIND = "vec_id long, embedding array<double>, label int"


def cosine(x, y):
    if not x or not y or len(x) != len(y) or any(v is None or not math.isfinite(v) for v in [*x, *y]) or not any(x) or not any(y):
        return None
    x, y = ([v / max(map(abs, z)) for v in z] for z in (x, y))
    return math.fsum(a * b for a, b in zip(x, y, strict=True)) / math.sqrt(math.fsum(a * a for a in x) * math.fsum(b * b for b in y))


def brute(rows, least=0.9):
    """vec_id, n_links, component_id, kept of every row."""
    linked = [[j for j in range(len(rows)) if j != i and (c := cosine(rows[i][1], rows[j][1])) is not None and c >= least] for i in range(len(rows))]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, to in enumerate(linked):
        for j in to:
            root[find(i)] = find(j)
    least_id = {}
    for i, r in enumerate(rows):
        if r[0] is not None:
            least_id[find(i)] = min(r[0], least_id.get(find(i), r[0]))
    out = [(r[0], len(linked[i]), least_id.get(find(i))) for i, r in enumerate(rows)]
    return sorted((*x, x[0] is not None and x[0] == x[2]) for x in out if x[0] is not None), [x for x in out if x[0] is None]


def cloud(seed, groups, each, dim, spread):
    rng = random.Random(seed)
    out = []
    for _ in range(groups):
        centre = [rng.gauss(0, 1) for _ in range(dim)]
        out += [[c + rng.gauss(0, spread) for c in centre] for _ in range(each)]
    rng.shuffle(out)
    return out


@pytest.fixture(scope="module")
def odd():
    made = cloud(1, 12, 9, 6, 0.35) + cloud(2, 2, 40, 6, 0.2) + cloud(3, 5, 3, 3, 0.3)
    made += [made[0]] * 7 + [[2.5 * v for v in made[1]], [1e200 * v for v in made[1]], [1e-200 * v for v in made[1]], [-v for v in made[2]]]
    made += [None, [], [0.0] * 6, [1.0, None, 0, 0, 0, 0], [float("nan")] * 6, [float("inf"), 0, 0, 0, 0, 0], [1.0], [2.0], [-1.0], [0.0, -0.0, 0, 1, 0, 0], [-0.0, 0, 0, 1, 0, 0]]
    # exactly at the bound, and next to it
    made += [[1.0, 0.0, 0.0, 0.0], [9.0, 0.0, math.sqrt(19.0), 0.0], [9.0, 3.0, 3.0, 1.0], [8.9999999, 3.0, 3.0, 1.0]]
    made = [None if v is None else [None if x is None else float(x) for x in v] for v in made]
    rows = [(i, v, i % 3) for i, v in enumerate(made)]
    return [*rows, (3, made[3], 0), (3, made[3], 1), (None, made[4], 1), (None, [5.0, 4.0], 2)]


@pytest.mark.parametrize("options", [{}, {"block_bytes": 400, "fan": 2, "leaf": 3}, {"block_bytes": 1000, "fan": 3, "leaf": 4, "leading": 2}])
def test_links_and_components(spark, odd, options):
    found = vectors.link_vectors(spark.createDataFrame(odd, KIND).repartition(3), **options).collect()
    sure, without = brute(odd)
    assert sorted((r["vec_id"], r["n_links"], r["component_id"], r["kept"]) for r in found if r["vec_id"] is not None) == sure
    assert sorted((r["n_links"], r["component_id"] is None, r["kept"]) for r in found if r["vec_id"] is None) == sorted((n, c is None, False) for _, n, c in without)


def test_bound_is_inclusive(spark):
    rows = [(1, [1.0, 0.0, 0.0, 0.0], 0), (2, [9.0, 3.0, 3.0, 1.0], 0), (3, [8.99999999, 3.0, 3.0, 1.0], 0)]
    out = {r["vec_id"]: r["component_id"] for r in vectors.link_vectors(spark.createDataFrame(rows, KIND)).collect()}
    assert out[2] == (1 if cosine(rows[0][1], rows[1][1]) >= 0.9 else 2)
    assert out == {r[0]: r[2] for r in brute(rows)[0]}


def test_distant_blocks_are_skipped(spark):
    """Clusters along one line: only neighbouring blocks meet."""
    rows = [(i, math.floor(i / 3) * 10.0) for i in range(48)]
    boxes = spark.createDataFrame([(i, [0.0, at, 0.0], [0.0, at + 1.0, 0.0]) for i, at in rows], "id long, low array<double>, high array<double>")
    pairs = {(r["a"], r["b"]) for r in vectors.block_pairs(boxes, 2.0, 3, fan=4).collect()}
    assert pairs == {(i, j) for i, x in rows for j, y in rows if i <= j and x == y}


@pytest.mark.parametrize("count, panel", [(1, 1), (24, 1), (24, 3), (25, 4), (24, 64)])
def test_blocks_are_sent_to_panels(spark, count, panel):
    """Each pair of near blocks meets in one task, and a block is sent to half of the panels, not to each block."""
    from pyspark.sql import functions as F

    boxes = spark.range(count).select("id", *[F.array(F.lit(0.0), F.lit(0.0)).alias(c) for c in ("low", "high")])
    rows = vectors.dealt(boxes.select("id", "low"), boxes, 1.0, 2, panel, 2).withColumn("at", F.spark_partition_id()).collect()
    assert len(rows) <= count * (-(-count // panel) / 2 + 1)
    met, own, host = [], [], None
    for r in rows:
        if (r["at"], r["host"]) != host:
            host, own = (r["at"], r["host"]), []
        own += [] if r["guest"] else [r["id"]]
        met += [tuple(sorted((i, r["id"]))) for i in own]
    assert sorted(met) == [(i, j) for i in range(count) for j in range(i, count)]
    assert len({r["at"] for r in rows}) == len({r["host"] for r in rows}) == -(-count // panel)


def test_single_precision_leaves_no_link_out():
    """Cosines about the bound, nearer than single precision tells: the same links as in double precision."""
    rng = random.Random(5)
    x = [[rng.gauss(0, 1) for _ in range(40)] for _ in range(30)]
    rows = []
    for v in x:
        w = [rng.gauss(0, 1) for _ in v]
        along = sum(a * b for a, b in zip(v, w, strict=True)) / sum(a * a for a in v)
        w = [b - along * a for a, b in zip(v, w, strict=True)]
        scale = math.sqrt(sum(a * a for a in v) / sum(b * b for b in w))
        rows.append([a + (math.sqrt(1 / 0.81 - 1) + rng.uniform(-3e-7, 3e-7)) * scale * b for a, b in zip(v, w, strict=True)])
    made = [vectors.Side(40, b"".join(bytes([k, i]) * 8 for i in range(30)), vectors.np.array(y).tobytes(), vectors.np.ones(30, "<i8").tobytes(), None, 8) for k, y in enumerate((x, rows))]
    links, _ = vectors.linked(*made, 0.9)
    expected = [[cosine(a, b) >= 0.9 for b in rows] for a in x]
    assert links.tolist() == [*map(sum, expected), *map(sum, zip(*expected, strict=True))] and 5 < sum(links[:30]) < 25


def test_columns_and_empty(spark, odd):
    from pyspark.sql import functions as F

    frame = spark.createDataFrame(odd[:40], KIND)
    clashing = frame.withColumns({c: F.lit(7) for c in ("key", "vec", "n_links", "Kept", "dim", "links", "root")})
    out = vectors.link_vectors(clashing)
    assert out.columns == ["vec_id", "label", "key", "vec", "n_links", "Kept", "dim", "links", "root", "n_links_", "component_id", "kept_"]
    assert sorted((r["vec_id"], r["n_links_"], r["component_id"], r["kept_"]) for r in out.collect()) == brute(odd[:40])[0]
    assert vectors.link_vectors(frame.limit(0)).count() == 0
    only_bad = spark.createDataFrame([(1, None, 0), (2, [0.0], 0)], KIND)
    assert sorted(map(tuple, vectors.link_vectors(only_bad).drop("label").collect())) == [(1, 0, 1, True), (2, 0, 2, True)]
