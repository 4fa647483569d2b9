import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def words(rng, n, vocabulary=400):
    return [f"w{rng.randrange(vocabulary)}{'é' if rng.random() < 0.05 else ''}" for _ in range(n)]


def corpus(seed=1):
    """Documents with copies, near copies, shared passages, repeats, and every odd case."""
    rng = random.Random(seed)
    base = [" ".join(words(rng, rng.randrange(40, 200))) for _ in range(25)]
    lines = [" ".join(words(rng, 8)) + "." for _ in range(12)]
    texts = list(base)
    texts += base[:4] + base[:2]
    for t in base[:6]:
        w = t.split()
        w[rng.randrange(len(w))] = "changed"
        texts.append(" ".join(w))
    passage = " ".join(words(rng, 60))
    texts += [f"{words(rng, 20)[0]} {' '.join(words(rng, 15))} {passage} {' '.join(words(rng, 15))}" for _ in range(4)]
    texts += ["\n".join([" ".join(words(rng, 9)), *lines, " ".join(words(rng, 9))]) for _ in range(3)]
    texts += ["ab " * 300, "ba " * 400, "é" * 200, "x", "", " \t\n", None, "one two three", "a\r\nb\n\nc", "l\n" * 40]
    texts.append(" ".join(words(rng, 9000)))
    rows = [(i, t, "en", f"s{i % 4}" if i % 9 else None, len(t or "")) for i, t in enumerate(texts)]
    rows += [(None, base[0], None, None, None), (3, base[3], "en", "s3", 1), (3, base[3], "en", "s3", 1)]
    return rows


@pytest.fixture(scope="session")
def docs(spark):
    return spark.createDataFrame(corpus(), SCHEMA).repartition(3).cache()


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def clashing(docs):
    """The same documents with columns whose names the operators use inside."""
    from pyspark.sql import functions as F

    return docs.withColumns({c: F.lit(7) for c in ("key", "key_", "spans_", "shard_", "lines_", "chunks_", "kept_", "_hashes", "id_", "band", "root", "size", "score", "shard", "start")})
