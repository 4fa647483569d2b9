"""Fingerprints of recordings, and their search against brute force."""

import hashlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from lattica.llm import media


def tune(rng, n=64):
    return list(map(float, np.clip(rng.normal(0, 0.125, n), -0.6, 0.6)))


def recordings(spark, seed=0, n=60):
    rng = np.random.default_rng(seed)
    base = [tune(rng) for _ in range(n)]
    rows = [(i, media.render(v)) for i, v in enumerate(base)]
    rows += [(1000 + i, media.render(list(np.array(v) + rng.normal(0, 0.005, 64)))) for i, v in enumerate(base[:20])]
    rows += [(2000 + i, media.render(base[i][10:] + tune(rng, 10))) for i in range(5)]
    rows += [(3000, None), (3001, b""), (3002, b"\0\1\2"), (3003, b"\0\0" * 20000), (None, media.render(base[0])), (0, media.render(base[0]))]
    return spark.createDataFrame(rows, "rec_id long, audio binary").repartition(3)


def test_search_against_brute_force(spark):
    marked = media.fingerprints(recordings(spark).withColumn("links", F.lit(1)), ["rec_id"])
    queries = marked.where("rec_id < 20")
    for most in (media.BLOCK_QUERIES, 7):
        got = {(r["rec_id"], x["query"]): (x["offset"], x["errors"]) for r in media.search(marked, queries, most).collect() for x in r["links"]}
        rows = [(r["rec_id"], np.array(r["fingerprint"], np.int32).view(np.uint32)) for r in marked.collect()]
        expected = set()
        for a, x in rows:
            for b, y in rows:
                if b is not None and b < 20 and a != b and len(x) and len(y):
                    if min(media.errors_at(x, y, o) for o in range(-60, 61)) <= media.MOST_ERRORS:
                        expected.add((a, b))
        assert set(got) <= expected and len(got) >= 0.9 * len(expected) and len(expected) >= 20
    assert all((1000 + i, i) in got for i in range(20))
    assert abs(got[(2000, 0)][0]) == 10 * media.NOTE // media.HOP


def some_marks(rng, n=24):
    """Fingerprints of few different integers, and of 0 to 117 frames: copies, shifted copies, cut ones, with changed bits."""
    base = [rng.integers(0, 1 << 32, 5, np.uint32)[rng.integers(0, 5, int(rng.choice([0, 1, 2, 5, 9, 40, 117])))] for _ in range(9)]
    out = []
    for _ in range(n):
        x = base[rng.integers(len(base))]
        cut = int(rng.integers(0, len(x) // 2 + 1))
        x = [x, x[cut:], x[: len(x) - cut], np.roll(x, cut)][rng.integers(4)]
        out.append(x ^ np.where(rng.random(len(x)) < 0.4, np.uint32(1) << rng.integers(0, 32, len(x)).astype(np.uint32), np.uint32(0)))
    return out


@pytest.mark.parametrize("options", [{}, {"GRID": 0}, {"COMPARED": 100}])
def test_matches_against_brute_force(monkeypatch, options):
    """Hits counted in an array or sorted: the fullest offset, ties to the nearest and then the one before, and its errors."""
    for name, value in options.items():
        monkeypatch.setattr(media, name, value)
    rng = np.random.default_rng(6)
    n_found = 0
    for _ in range(4):
        made = some_marks(rng, 48)
        marks, queries = made[:24], made[24:]
        expected = []
        for i, x in enumerate(marks):
            for q, y in enumerate(queries):
                hits = Counter((int(a) - int(b) for a, b in np.argwhere((x >> 12)[:, None] == y >> 12)))
                o, most = min(hits.items(), key=lambda h: (-h[1], abs(h[0]), h[0]), default=(0, 0))
                if most >= media.LEAST_HITS and (e := media.errors_at(x, y, o)) <= media.MOST_ERRORS:
                    expected.append((i, 100 + q, o, e))
        assert media.matches(marks, media.make_block(range(100, 100 + len(queries)), queries)) == expected
        n_found += len(expected)
    assert n_found > 50


def test_bits_are_compared_for_many_recordings_at_once(monkeypatch):
    """One comparison for all recordings and queries, not one for each pair."""
    calls = []
    errors = media.all_errors
    monkeypatch.setattr(media, "all_errors", lambda *a: calls.append(len(a[1])) or errors(*a))
    marks = some_marks(np.random.default_rng(7), 64)
    media.matches(marks, media.make_block(range(64), marks))
    assert len(calls) == 1 and calls[0] > 100


def test_blocks_share_a_step(spark):
    """Many blocks don't chain as many Python workers in each task."""
    marked = media.fingerprints(recordings(spark), ["rec_id"]).where("rec_id < 20").localCheckpoint()
    plan = media.search(marked, marked, 2)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1


def test_odd_recordings(spark):
    marked = media.fingerprints(recordings(spark), ["rec_id"])
    size = {r["rec_id"]: len(r["fingerprint"]) for r in marked.collect()}
    assert size[3000] == size[3001] == size[3002] == 0 and size[3003] > 0
    assert media.search(marked.limit(0), marked.limit(0)).count() == 0
    out = media.search(marked, marked.limit(0)).collect()
    assert len(out) == marked.count() and not any(r["links"] for r in out)


def test_integral_areas_agree_with_sums():
    strip = np.random.default_rng(2).random((40, 12))
    packed = media.pack(strip)
    kind, y, h, w = media.FILTERS[0]
    for t in (0, 7, len(packed) - 1):
        box = strip[t : t + w, y : y + h]
        balance = (box[:, : h // 2].sum() - box[:, h // 2 :].sum()) / box.sum()
        level = int(balance >= -media.LEVEL) + int(balance >= 0) + int(balance >= media.LEVEL)
        assert packed[t] >> 30 == level ^ (level >> 1)


def test_chroma_by_its_definition():
    rng = np.random.default_rng(3)
    pcm = np.concatenate([rng.normal(0, 0.1, 3000), np.zeros(2000)])
    strip = media.chroma(pcm)
    assert len(strip) == (len(pcm) - media.FRAME) // media.HOP + 1
    n = np.arange(media.FRAME)
    taper = 0.5 - 0.5 * np.cos(2 * np.pi * n / (media.FRAME - 1))
    for t in (0, 5, 8):
        frame = pcm[t * media.HOP : t * media.HOP + media.FRAME] * taper
        shares = np.zeros(12)
        for k in range(1, media.FRAME // 2 + 1):
            hz = k * media.RATE / media.FRAME
            if hz >= media.LOWEST_HZ:
                shares[round(12 * np.log2(hz / 440)) % 12] += abs((frame * np.exp(-2j * np.pi * k * n / media.FRAME)).sum()) ** 2
        assert np.allclose(strip[t], shares / shares.sum())
    assert not strip[-1].any()


def test_every_filter_agrees_with_sums():
    strip = np.random.default_rng(4).random((30, 12))
    packed = media.pack(strip)
    assert len(media.FILTERS) == 16 and {f[0] for f in media.FILTERS} == {"pitch_halves", "time_halves", "quarters", "time_thirds", "pitch_thirds"}
    for number, (kind, y, h, w) in enumerate(media.FILTERS):
        for t in range(len(packed)):
            box = strip[t : t + w, y : y + h]
            a, b = w // 2, h // 2
            balance = {
                "pitch_halves": box[:, :b].sum() - box[:, b:].sum(),
                "time_halves": box[:a].sum() - box[a:].sum(),
                "quarters": box[:a, :b].sum() + box[a:, b:].sum() - box[:a, b:].sum() - box[a:, :b].sum(),
                "time_thirds": 3 * box[w // 3 : w - w // 3].sum() - box.sum(),
                "pitch_thirds": 3 * box[:, h // 3 : h - h // 3].sum() - box.sum(),
            }[kind] / box.sum()
            level = int(balance >= -media.LEVEL) + int(balance >= 0) + int(balance >= media.LEVEL)
            assert (int(packed[t]) >> (30 - 2 * number)) & 3 == level ^ (level >> 1), (kind, t)


def test_rendered_notes_have_their_pitch():
    assert media.render(None) == media.render([]) == b""
    for value, hz in ((0.0, 440.0), (None, 440.0), (float("nan"), 440.0), (0.5, 880.0), (-0.5, 220.0), (7.0, 1760.0)):
        pcm = np.frombuffer(media.render([value] * 8), "<i2").astype(float)
        assert len(pcm) == 8 * media.NOTE
        assert abs(np.abs(np.fft.rfft(pcm)).argmax() * media.RATE / len(pcm) - hz) < 1


def test_query_against_brute_force(spark, tmp_path):
    rng = np.random.default_rng(5)
    base = {i: tune(rng, 32) for i in range(0, 101, 10)}
    rows = [(i, v) for i, v in base.items()]
    rows += [(1000 + i + 1, [x + float(rng.normal(0, 0.004)) for x in base[i]]) for i in (0, 50, 100)]
    rows += [(2001, base[50][6:] + tune(rng, 6)), (2003, base[0]), (2003, base[0]), (2005, []), (2007, None), (None, base[100])]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>").write.parquet(str(tmp_path / "embeddings.parquet"))
    stored = spark.read.parquet(str(tmp_path / "embeddings.parquet")).collect()
    marks = [(r["vec_id"], media.fingerprint_pcm(media.render(r["embedding"]))) for r in stored]

    def best(x, y):
        hits = Counter(i - j for i, a in enumerate(x) for j, b in enumerate(y) if int(a) >> 12 == int(b) >> 12)
        hits = {o: n for o, n in hits.items() if n >= media.LEAST_HITS}
        if not hits:
            return None
        o = min(hits, key=lambda o: (-hits[o], abs(o), o))
        both = [(int(x[i]), int(y[i - o])) for i in range(len(x)) if 0 <= i - o < len(y)]
        errors = sum((a ^ b).bit_count() for a, b in both) / (32 * len(both))
        return (errors, o) if len(both) >= media.LEAST_OVERLAP * min(len(x), len(y)) and errors <= media.MOST_ERRORS else None

    expected = []
    for i, x in marks:
        found = [(*m, q) for q, y in marks if q is not None and q % 50 == 0 and q != i and (m := best(x, y))]
        first = min(found, key=lambda m: (m[0], m[2], m[1]), default=None)
        digest = hashlib.md5(",".join(str(int(v)) for v in x.view(np.int32)).encode()).hexdigest()
        expected.append((i, len(x), digest, len(found), first and first[2], first and first[1], first and round(first[0], 9), sorted(m[2] for m in found)))
    got = [tuple(r) for r in media.op9_media(spark, str(tmp_path)).collect()]
    assert sorted(got, key=repr) == sorted(expected, key=repr)
    assert sum(r[3] for r in got) >= 7
