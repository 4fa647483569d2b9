import hashlib
import math
import re
import zlib
from collections import Counter

import pytest

from lattica.llm import resample, search

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def words(text):
    return [w.translate({c: c + 32 for c in range(65, 91)}) for w in TERM.findall(text or "")]


QUERIES = "item_id long, text string"


@pytest.fixture(scope="module")
def queries(docs):
    texts = [r["text"] for r in docs.where("doc_id < 12").orderBy("doc_id").collect()]
    made = [" ".join(t.split()[:9]) for t in texts[:6]] + [None, "", " .", "nowhereatall", "w1 w1 W1 w2", "one two", "é w3é w3", "w1 w1 W1 w2"]
    return [(i, t) for i, t in enumerate(made)] + [(3, made[3]), (None, made[0]), (99, " ".join(texts[7].split() * 3))]


def ranking(rows, items, top=10):
    held = [(d, Counter(words(t))) for d, t in rows]
    sizes = [sum(c.values()) for _, c in held]
    n, total = sum(s > 0 for s in sizes), sum(sizes)
    df = Counter(t for _, c in held for t in c)
    out = []
    for item, text in items:
        scores = []
        for (doc, c), size in zip(held, sizes, strict=True):
            score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 8 * (25 + 75 * size * n // total))) for t in words(text) if c[t])
            if score > 0:
                scores.append((-score, doc is None, doc or 0, doc))
        out += [(item, k + 1, doc, -s) for k, (s, _, _, doc) in enumerate(sorted(scores)[:top])]
    return sorted(out, key=str)


@pytest.mark.parametrize("options", [{}, {"window": 7, "block_pairs": 20, "top": 4, "filter_bits": 64}, {"window": 1, "top": 1}])
def test_search_equals_brute_force(spark, docs, queries, options):
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    found = search.search(docs, spark.createDataFrame(queries, QUERIES), **options)
    assert found.columns == ["item_id", "rank", "doc_id", "score"]
    assert sorted(map(tuple, found.collect()), key=str) == ranking(rows, queries, options.get("top", 10))


def test_search_with_hot_ids_and_text_ids(spark):
    """One id with most rows, more than a window holds; ids that are no numbers; ties by id."""
    rows = [("b", "rare word") for _ in range(30)] + [("a", "rare word"), (None, "rare word"), ("c", "Rare, rare!"), ("d", None), ("e", "other word")]
    frame = spark.createDataFrame(rows, "doc_id string, text string")
    found = search.search(frame, spark.createDataFrame([(1, "rare"), (2, "rare other")], QUERIES), window=4)
    assert sorted(map(tuple, found.collect()), key=str) == ranking(rows, [(1, "rare"), (2, "rare other")])


def test_search_empty_tables(spark, docs, empty, queries):
    asked = spark.createDataFrame(queries, QUERIES)
    assert search.search(empty, asked).count() == 0
    assert search.search(docs, asked.limit(0)).count() == 0
    with pytest.raises(ValueError):
        search.search(docs, asked, top=0)


def features(text, grams=2):
    w = words(text)
    return w + ([f"{a} {b}" for a, b in zip(w, w[1:], strict=False)] if grams == 2 else [])


def drawn(rows, target, grams=2, buckets=10_000, percent=25, least=20, seed=7):
    bucket = lambda f: zlib.crc32(f.encode()) % buckets
    s, t = (Counter(bucket(f) for x in side for f in features(x, grams)) for side in ([t for _, t in rows], target))
    all_s, all_t = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (all_s + buckets) / ((s[b] + 1) * (all_t + buckets))))
    out = []
    for i, (doc, text) in enumerate(rows):
        f = features(text, grams)
        weight = sum(gain(bucket(x)) for x in f) // len(f) if f else 0
        h = int(hashlib.sha256(f"{seed}:{'null' if doc is None else doc}".encode()).hexdigest()[:8], 16)
        out.append([doc, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, i])
    able = sorted((x for x in out if len(words(rows[x[5]][1])) >= least), key=lambda x: (-x[3], x[0] is None, x[0] or 0))
    for k, x in enumerate(able[: percent * len(able) // 100]):
        x[4] = k + 1
    return sorted((tuple(x[:5]) for x in out), key=str)


@pytest.mark.parametrize("options", [{}, {"grams": 1, "buckets": 50, "percent": 60, "least_words": 3, "seed": 9}, {"chunk_bytes": 900, "shard_bytes": 700, "percent": 100, "least_words": 0}])
def test_resample_equals_brute_force(spark, docs, queries, options):
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    target = spark.createDataFrame(queries, QUERIES)
    found = resample.resample(docs, target, **options)
    assert found.columns == ["doc_id", "lang", "source", "n_chars", "n_words", "n_features", "weight", "score", "rank"]
    wanted = drawn(rows, [t for _, t in queries], options.get("grams", 2), options.get("buckets", 10_000), options.get("percent", 25), options.get("least_words", 20), options.get("seed", 7))
    found = sorted((tuple(r[c] for c in ("doc_id", "n_features", "weight", "score", "rank")) for r in found.collect()), key=str)
    assert found == wanted


def test_resample_names_empty_and_texts(spark, docs, empty, clashing):
    from pyspark.sql import functions as F

    target = spark.createDataFrame([(1, "w1 w2 w3")], QUERIES)
    assert resample.resample(empty, target).count() == 0
    plain = resample.resample(docs, target.limit(0)).select("weight", "score", "rank").collect()
    more = resample.resample(clashing.withColumns({c: F.lit(1) for c in ("rank", "Weight", "row", "chunk")}), target.limit(0))
    assert more.columns[-7:] == ["row", "chunk", "n_words", "n_features", "weight_", "score_", "rank_"]
    assert sorted(map(str, plain)) == sorted(str(r).replace("_", "") for r in more.select("weight_", "score_", "rank_").collect())
    kept = resample.draw(docs, target)
    assert kept.columns == docs.columns
    ranks = resample.resample(docs, target).where("rank is not null").select("doc_id", "n_chars").collect()
    assert sorted(map(str, kept.select("doc_id", "n_chars").collect())) == sorted(map(str, ranks))
    with pytest.raises(ValueError):
        resample.resample(docs, target, grams=3)
