"""Quality, mixing, decontamination, licences and chats, with every odd case."""

import hashlib
import json
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from lattica.llm import chat, decontaminate, licenses, mixing, quality


def counted(rows):
    return sorted(map(repr, rows))


# ---- quality


def labelled(spark, n=400, seed=4):
    rng = random.Random(seed)
    rows, labels = [], []
    for i in range(n):
        good = i % 3 > 0
        w = [rng.choice(("the", "and", "river", "stone", "walking", "of", "under", "bright")) + rng.choice(("", "", ",", ".")) for _ in range(rng.randrange(30, 120))]
        text = " ".join(w) if good else rng.choice((" ".join(x.upper() + "!!" for x in w), " | ".join(w), " ".join([w[0]] * len(w))))
        rows.append((i, text))
        labels.append((i, int(good), 0))
    return spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_quality_on_the_held_out_fold(spark):
    docs, labels = labelled(spark)
    stats = quality.with_statistics(docs, ["doc_id"])
    model = quality.train(stats, labels)
    scored = {r["doc_id"]: r["score"] for r in quality.with_score(stats, model).collect()}
    fold = [i for i in scored if zlib.crc32(str(i).encode()) % 5 == 0]
    assert fold and all((scored[i] >= 0.3) == (i % 3 > 0) for i in fold)
    marked = {r["doc_id"]: r["h"] for r in docs.select("doc_id", quality.held_out(F.col("doc_id")).alias("h")).collect()}
    assert sorted(i for i, h in marked.items() if h) == sorted(fold)
    kept = quality.reject_poor(docs.withColumn("score", F.lit(1)), labels)
    assert kept.columns == ["doc_id", "text", "score"] and {r["doc_id"] % 3 for r in kept.collect()} == {1, 2}


def test_quality_learns_nothing_from_the_held_out_fold(spark):
    docs, labels = labelled(spark)
    stats = quality.with_statistics(docs, ["doc_id"])
    flipped = labels.withColumn("quality", F.when(quality.held_out(F.col("doc_id")), 1 - F.col("quality")).otherwise(F.col("quality")))
    a, b = quality.train(stats, labels), quality.train(stats, flipped)
    assert np.allclose(a.means, b.means) and np.allclose(a.whiten, b.whiten)


def test_quality_odd_texts_and_few_labels(spark, docs, empty):
    stats = quality.with_statistics(docs, ["doc_id"])
    none = spark.createDataFrame([], "doc_id long, quality int")
    model = quality.train(stats, none)
    assert {r["score"] for r in quality.with_score(stats, model).collect()} == {0.5}
    _, labels = labelled(spark)
    model = quality.train(quality.with_statistics(labelled(spark)[0], ["doc_id"]), labels)
    scores = [r["score"] for r in quality.with_score(stats, model).collect()]
    assert len(scores) == docs.count() and all(0 <= s <= 1 for s in scores)
    assert quality.with_score(quality.with_statistics(empty, ["doc_id"]), model).count() == 0


def brute_statistics(text):
    """The twelve statistics of one text, character by character."""
    raw = text.encode()
    words = [w for w in re.split(rb"[\x20\x09-\x0D]+", raw) if w]
    n = len(words)
    kinds = Counter()
    for b in raw:
        c = chr(b) if b < 128 else ""
        kinds["solid"] += c not in tuple(" \t\n\x0b\x0c\r")
        kinds["lower"] += c != "" and c in "abcdefghijklmnopqrstuvwxyz"
        kinds["upper"] += c != "" and c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
        kinds["digit"] += c != "" and c in "0123456789"
        kinds["mark"] += c != "" and c in ".,;:?'\"-"
        kinds["high"] += b >= 128
    symbol = kinds["solid"] - sum(kinds[k] for k in ("lower", "upper", "digit", "mark", "high"))
    u, k = quality.USUAL, quality.USUAL_WORDS

    def odds(part, whole, name, more):
        share = (part + more * u[name]) / (whole + more)
        return math.log((share + quality.EPSILON) / (1 - share + quality.EPSILON))

    mean = (sum(map(len, words)) + k * u["word_length"]) / (n + k)
    spread = math.sqrt((sum((len(w) - mean) ** 2 for w in words) + k * u["word_spread"] ** 2) / (n + k))
    count = Counter(words)
    return [
        math.log1p(n),
        math.log1p(mean),
        math.log1p(spread),
        odds(kinds["upper"], kinds["upper"] + kinds["lower"], "upper", quality.USUAL_BYTES),
        odds(kinds["digit"], kinds["solid"], "digit", quality.USUAL_BYTES),
        odds(kinds["mark"], kinds["solid"], "stop_mark", quality.USUAL_BYTES),
        odds(symbol, kinds["solid"], "symbol", quality.USUAL_BYTES),
        odds(sum(len(w) <= 3 for w in words), n, "short", k),
        odds(len(count), n, "distinct", k),
        odds(sum(a == b for a, b in zip(words, words[1:], strict=False)), n, "adjacent", k),
        odds(max(count.values(), default=0), n, "top", k),
        math.log1p((n + u["line_words"]) / (raw.count(b"\n") + 2)),
    ]


def test_statistics_one_by_one(docs):
    texts = [r["text"] or "" for r in docs.collect()] + ["A b! 12 é.\n\nA A", "\x00\x0b\u3000x", "#" * 5000]
    assert np.allclose(quality.statistics([t.encode() for t in texts]), [brute_statistics(t) for t in texts])


def test_fit_against_numpy(spark):
    docs, labels = labelled(spark)
    rows = {r["doc_id"]: r["text"] for r in docs.collect()}
    known = {r["doc_id"]: r["quality"] for r in labels.collect() if zlib.crc32(str(r["doc_id"]).encode()) % 5}
    model = quality.train(quality.with_statistics(docs.withColumns({"words": F.lit(1), "statistics": F.lit(2)}), ["doc_id", "words", "statistics"]), labels)
    x = np.array([brute_statistics(rows[i]) for i in known])
    y = np.array(list(known.values()))
    of = [x[y == c] for c in (0, 1)]
    within = sum(np.cov(a.T, bias=True) * len(a) for a in of) / len(x)
    centre, scale = np.mean([a.mean(0) for a in of], 0), np.sqrt(np.maximum(np.diag(within), 1e-8))
    assert np.allclose(model.centre, centre) and np.allclose(model.scale, scale)
    z = [(a - centre) / scale for a in of]
    pooled = sum(np.cov(a.T, bias=True) * len(a) for a in z) / len(x)
    pooled = 0.98 * pooled + 0.02 * np.trace(pooled) / 12 * np.eye(12)
    tested = (np.array([brute_statistics(t) for t in rows.values()]) - centre) / scale
    density = []
    for a in z:
        covariance = 0.9 * np.cov(a.T, bias=True) + 0.1 * pooled
        away = tested - a.mean(0)
        density.append(math.log(len(a)) - 0.5 * np.linalg.slogdet(covariance)[1] - 0.5 * np.einsum("ij,jk,ik->i", away, np.linalg.inv(covariance), away))
    expected = 1 / (1 + np.exp(np.clip(density[0] - density[1], -700, 700)))
    assert np.allclose(model.score(tested * scale + centre), expected, atol=1e-6)


def test_scores_beside_columns_of_any_name(spark):
    docs, labels = labelled(spark)
    own = docs.withColumns({c: F.lit(7) for c in ("words", "upper", "Statistics", "score")})
    stats = quality.with_statistics(own, own.columns)
    scored = quality.with_score(stats, quality.train(stats, labels))
    assert scored.columns == [*own.columns, "score_"] and {r["upper"] for r in scored.collect()} == {7}
    assert quality.reject_poor(own, labels).columns == own.columns


def test_density_of_the_discriminant():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(50, 2))
    m = quality.Discriminant(np.zeros(2), np.ones(2), np.array([[0.0, 0.0], [1.0, 1.0]]), np.array([np.eye(2), np.linalg.inv(np.linalg.cholesky([[2.0, 0.5], [0.5, 1.0]]))]), np.array([0.0, -0.5 * np.log(1.75)]), 0.5)
    inverse = np.linalg.inv([[2.0, 0.5], [0.5, 1.0]])
    expected = 1 / (1 + np.exp(-0.5 * (x**2).sum(1) + 0.5 * np.einsum("ij,jk,ik->i", x - 1, inverse, x - 1) + 0.5 * np.log(1.75)))
    assert np.allclose(m.score(x), expected)


# ---- mixing


def test_mix_sums_and_bounds(docs):
    rows = [r.asDict() for r in mixing.mix(docs).collect()]
    assert len(rows) == docs.count()
    assert all(0 <= r["taken"] <= 2 * r["size"] for r in rows)
    by = {}
    for r in rows:
        by.setdefault((r["source_size"], r["target"]), []).append(r)
    assert sum(t for _, t in by) == pytest.approx(1.5 * sum(s for s, _ in by))
    for (size, target), part in by.items():
        assert sum(r["size"] for r in part) == size and target <= 2 * size + 1e-9
        assert abs(sum(r["taken"] for r in part) - target) <= 1
    assert counted(tuple(r.values()) for r in rows) == counted(tuple(r) for r in mixing.mix(docs).collect())


def test_mix_in_small_shards(docs):
    rows = mixing.mix(docs, shard_words=500).collect()
    assert all(0 <= r["taken"] <= 2 * r["size"] for r in rows)
    want = sum({r["source_size"]: r["target"] for r in rows}.values())
    assert abs(sum(r["taken"] for r in rows) - want) < 0.05 * want


@pytest.mark.parametrize("shard_words", [mixing.SHARD_WORDS, 300])
def test_mix_of_small_sources(spark, shard_words):
    """Each source's words come within a word of its target, be it of 0, 1, 10, 14 or 31 words, and no document exceeds twice its size."""
    rng = random.Random(8)
    sizes = {"a": [700] * 20, "b": [1], "c": [10], "d": [3, 11], "e": [31], "f": [0, 0], "g": [5] * 77, None: [2, 2, 2]}
    rows = [(rng.randrange(10**6), " ".join("w" * n), source) for source, all_sizes in sizes.items() for n in all_sizes]
    out = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string"), shard_words=shard_words).collect()
    assert len(out) == len(rows) and all(0 <= r["taken"] <= 2 * r["size"] for r in out)
    by = {}
    for r in out:
        by.setdefault((r["source_size"], r["target"]), []).append(r["taken"])
    assert {s for s, _ in by} == {sum(x) for x in sizes.values()}
    assert all(abs(sum(x) - target) <= 1 for (_, target), x in by.items())
    assert sum(map(sum, by.values())) == math.floor(sum(t for _, t in by) + 0.5)


def test_mixed_texts_hold_what_is_taken(spark, docs):
    own = docs.withColumns({"taken": F.lit(1), "own": F.lit(2), "tie": F.lit(3)})
    out = mixing.mixed(own, names={"taken": "mix_taken"})
    assert out.columns == [*own.columns, "size", "source_size", "target", "mix_taken", "mixed_text"]
    rows = out.collect()
    assert len(rows) == docs.count()
    for r in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", r["text"] or "")
        n = r["mix_taken"]
        assert re.findall(r"[^\x20\x09-\x0D]+", r["mixed_text"]) == (w * 2)[:n] and r["taken"] == 1
    assert counted((r["doc_id"], r["size"], r["source_size"], r["target"], r["mix_taken"]) for r in rows) == counted(tuple(r) for r in mixing.mix(docs).collect())
    with pytest.raises(ValueError):
        mixing.mixed(own)


def test_mix_odd_cases(spark, empty, docs):
    assert mixing.mix(empty).count() == 0
    only_empty = spark.createDataFrame([(1, None, None), (2, "", "a"), (2, "", "a")], "doc_id long, text string, source string")
    assert counted(tuple(r) for r in mixing.mix(only_empty).collect()) == counted([(1, 0, 0, 0.0, 0), (2, 0, 0, 0.0, 0), (2, 0, 0, 0.0, 0)])
    assert mixing.mix(docs.withColumns({"size": F.lit(1), "shard": F.lit(1), "_at": F.lit(1)})).columns == ["doc_id", "size", "source_size", "target", "taken"]


def test_sainte_lague_by_quotients(spark):
    votes = [53, 24, 23, 0, 7, 7, 1]
    for caps in ([99] * 7, [9, 99, 99, 1, 1, 99, 1]):
        df = spark.createDataFrame([(0, i, float(v), 17, c) for i, (v, c) in enumerate(zip(votes, caps, strict=True))], "g int, p int, votes double, seats long, cap long")
        got = {r["p"]: r["won"] for r in mixing.sainte_lague(df, ["g"], "votes", "seats", "cap", ["p"], "won").collect()}
        quotients = sorted(((-v / (2 * k + 1), i) for i, v in enumerate(votes) for k in range(min(17, caps[i])) if v), key=lambda q: q)[:17]
        expected = Counter(i for _, i in quotients)
        assert got == {i: expected[i] for i in range(len(votes))}


def test_targets_level(spark):
    df = spark.createDataFrame([("a", 10), ("b", 1000), (None, 1000)], "source string, source_size long")
    got = {r["source"]: r["target"] for r in mixing.targets(df).collect()}
    assert got["a"] == 20.0 and got["b"] == pytest.approx(2995 * 2 / 3) and got[None] == pytest.approx(2995 / 3)
    full = spark.createDataFrame([("a", 1000), ("b", 10), ("c", 10)], "source string, source_size long")
    assert {r["source"]: r["target"] for r in mixing.targets(full).collect()} == {"a": pytest.approx(1490.0), "b": 20.0, "c": 20.0}


# ---- decontamination


def low(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def brute_mark_rows(rows, items):
    out = []
    for doc, text in rows:
        w, hit, ids = low(text), set(), set()
        for item, body in items:
            b = low(body)
            n = min(10, len(b))
            wins = {tuple(b[i : i + n]) for i in range(len(b) - n + 1)} if n else set()
            for i in range(len(w) - n + 1 if n else 0):
                if tuple(w[i : i + n]) in wins:
                    hit.update(range(i, i + n))
                    ids.add(str(item))
        out.append((doc, len(w), len(hit), ",".join(sorted(ids))))
    return out


def brute_marks(rows, items):
    return counted(brute_mark_rows(rows, items))


@pytest.fixture(scope="module")
def bench(spark, docs):
    texts = [r["text"] for r in docs.collect() if r["text"] and len(r["text"].split()) > 60]
    items = [(i, " ".join(t.split()[5 + i : 35 + i]).upper()) for i, t in enumerate(texts[:6])]
    items += [(100, "one, TWO-three"), (101, None), (102, "!!"), (103, " ".join(texts[3].split()[-10:])), (103, items[0][1]), (10, items[1][1]), (104, "never seen words")]
    return spark.createDataFrame(items, "item_id long, text string")


@pytest.mark.parametrize("most", [decontaminate.BLOCK_WINDOWS, 25])
def test_marks(docs, bench, most):
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    items = [tuple(r) for r in bench.collect()]
    got = decontaminate.mark(docs, bench, most=most).collect()
    assert counted((r["doc_id"], r["n_words"], sum(r["hit"][1::2]) - sum(r["hit"][::2]), ",".join(r["items"])) for r in got) == brute_marks(rows, items)


def test_marks_odd_cases(spark, docs, empty, bench, clashing):
    assert decontaminate.mark(empty, bench).count() == 0
    none = decontaminate.mark(docs, bench.limit(0)).collect()
    assert len(none) == docs.count() and not any(r["hit"] for r in none) and max(r["n_words"] for r in none) > 1000
    clean = decontaminate.drop_contaminated(clashing, bench)
    assert clean.columns == clashing.columns and 0 < clean.count() < docs.count()
    assert decontaminate.mark(docs.withColumn("HIT", F.lit(1)), bench).columns == [*docs.columns, "HIT", "n_words", "hit_", "items"]
    with pytest.raises(ValueError):
        decontaminate.mark(docs, bench, names={"hit": "Text"})


# ---- licences


def test_blocks_hold_no_more_than_asked(spark):
    long = " ".join(f"w{i}" for i in range(60))
    bench = spark.createDataFrame([(i, long) for i in range(4)] + [(9, "a b c"), (10, None)], "item_id long, text string")
    blocks = list(decontaminate.window_blocks(bench, 10, 25))
    assert max(sum(map(len, b.values())) for b in blocks) == 25
    pairs = sorted((w, item) for b in blocks for w, items in b.items() for item in items)
    assert len(pairs) == 4 * 51 + 1 == len(set(pairs)) and (b"a b c", "9") in pairs



def test_licenses(spark):
    mit = licenses.TEMPLATES["MIT grant"]
    rows = [(1, "intro\nReleased under the MIT license\nend"), (2, mit.replace(" including", "\nincluding")), (3, None), (4, ""), (5, "word"), (6, "Released under the MIT"), (7, "Released under the MIT License. And so on for a long line of other words"), (8, "A\n\n" + mit.replace("sell", "lend") + "\n\nB")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("b", F.lit(1))
    got = {r["doc_id"]: {m["name"]: m["dice"] for m in sorted(r["matches"], key=lambda m: m["dice"])} for r in licenses.scan(df).collect()}
    sets = {n: set(b) for n, b in licenses.template_bigrams(licenses.TEMPLATES).items()}
    assert got[1] == {"MIT notice": 1.0} and got[2] == {"MIT grant": 1.0}
    assert got[3] == got[4] == got[5] == got[7] == {}
    assert got[6] == {"MIT notice": pytest.approx(2 * 3 / (3 + len(sets["MIT notice"])))}
    assert 0.8 <= got[8]["MIT grant"] < 1
    assert licenses.scan(df.limit(0)).count() == 0
    again = licenses.scan(df.unionByName(df).withColumn("Matches", F.lit(5)))
    assert again.columns == ["doc_id", "text", "b", "Matches", "matches_"] and {r["Matches"] for r in again.collect()} == {5}
    assert again.where(F.size("matches_") > 0).count() == 2 * sum(1 for x in got.values() if x)


def test_whole_licenses(spark, tmp_path):
    """Each whole text is found in a block of its own, on one line and wrapped, and none of them in prose."""
    import textwrap

    names = list(licenses.WHOLE)
    rows = [(i, "intro\n\n" + (t if i % 2 else "\n".join(textwrap.wrap(t))) + "\n\nrest") for i, t in enumerate(licenses.WHOLE.values())]
    spark.createDataFrame([*rows, (99, "some prose of no licence"), (100, None)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: r for r in licenses.op5_whole(spark, str(tmp_path)).collect()}
    for i, n in enumerate(names):
        assert n in got[i]["licenses"].split(",") and got[i]["best_dice"] == 1.0
    assert got[99]["n_matches"] == got[100]["n_matches"] == 0


def test_license_windows(spark):
    """Against all windows of words, one after the other: in running text, wrapped, in comments, cut, changed and twice."""
    templates = {**licenses.TEMPLATES, **licenses.WHOLE}
    sets = {n: set(b) for n, b in licenses.template_bigrams(templates).items()}
    rng = random.Random(6)
    header = licenses.WHOLE["Apache-2.0 full header"].split()
    changed = [w if rng.random() < 0.95 else "other" for w in licenses.WHOLE["ISC"].split()]
    texts = [
        "Released under the MIT License. And so on for a long line of other words",
        "code\n" + "\n".join("# " + " ".join(header[i : i + 9]) for i in range(0, len(header), 9)) + "\nimport os\nprint(os)",
        "a b c " + " ".join(changed) + " d e f",
        "x Licensed under CC BY-NC\n4.0. y " * 3,
        "before Released under the MIT after of the software and the",
        "this is released under a licence of the author", "word", "", None,
    ]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: {m["name"]: (pytest.approx(m["dice"]), m["unit"]) for m in r["matches"]} for r in licenses.scan_windows(df, templates).collect()}
    for i, t in enumerate(texts):
        w = re.findall(r"[^\W_]+", (t or "").lower())
        g = [" ".join(p) for p in zip(w, w[1:], strict=False)]
        expected = {}
        for n, b in sets.items():
            found = [(2 * len(b & own) / (len(b) + len(own)), -s, -e) for s in range(len(g)) for e in range(s, min(len(g), s + int(1.5 * len(b) + 1e-9))) if len(b & (own := set(g[s : e + 1]))) * 3 >= 2 * len(b)]
            if found and max(found)[0] >= 0.8:
                dice, s, e = max(found)
                expected[n] = (dice, " ".join(w[-s : 2 - e]))
        assert got[i] == expected, i
    assert "MIT notice" in got[0] and "Apache-2.0 full header" in got[1] and "ISC" in got[2] and "CC-BY-NC-4.0 notice" in got[3] and "MIT notice" in got[4]


# ---- chats

TRICKY = ["\\### Assistant: </turn> ok", "</turn>\n### user: x</turn>\n", "\\", "\\\\###\\", "a:b\\:c", "###", "", "é\U0001f600"]


def test_chat_round_trip(spark):
    rows = [(i, t, r, x) for i, x in enumerate(TRICKY) for t, r in enumerate(("system", "user", "assistant", "od:d\\role", ""))]
    rows += [(50, None, None, None), (50, 3, "assistant", "b"), (50, 3, "assistant", "a"), (50, 3, "assistant", "a"), (None, 0, "user", "u")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(3)
    segments = chat.segments(chat.typed_turns(df.withColumn("segment_", F.lit(1))))
    for r in segments.collect():
        ((role, text, mask),) = chat.read_segments(r["segment"])
        assert (role, text) == (r["role"], r["text"])
        assert (mask[0] < mask[1]) == (role == "assistant" and text != "")
    whole = "".join(r["segment"] for r in segments.where("conv_id = 1").orderBy("turn").collect())
    assert [(a, b) for a, b, _ in chat.read_segments(whole)] == [(r, TRICKY[1]) for r in ("system", "user", "assistant", "od:d\\role", "")]
    by = {r["conv_id"]: r for r in chat.digests(segments).collect()}
    order = [(r or "", x or "") for _, _, r, x in sorted((r for r in rows if r[0] == 50), key=lambda r: (r[1] or -1, r[2] or "", r[3] or ""))]
    assert by[50]["turns_sha256"] == hashlib.sha256("".join(f"{r}\n{x}\n" for r, x in order).encode()).hexdigest()
    assert (by[50]["n_turns"], by[50]["loss_chars"], by[50]["loss_sha256"]) == (4, 3, hashlib.sha256(b"aab").hexdigest())
    assert by[None]["n_turns"] == 1 and by[7]["loss_chars"] == 2
    assert chat.digests(chat.segments(chat.typed_turns(df.limit(0)))).count() == 0


def test_layouts(spark):
    rows = [
        {"messages": [{"role": "user", "content": "q"}, {"role": "assistant", "content": "a"}], "id": 3},
        {"conversations": [{"from": "human", "value": "q"}, {"from": "gpt", "value": "a"}]},
        {"prompt": "q", "completion": "a"},
        {"prompt": "q", "response": "a"},
        {"instruction": "q", "output": "a"},
        {"instruction": "do", "input": "it", "output": "a"},
        {"odd": 1},
    ]
    df = spark.createDataFrame([(i, json.dumps(r)) for i, r in enumerate(rows)] + [(7, "not json"), (8, None)], "conv_id long, body string")
    got = {}
    for r in chat.json_turns(df, "body").orderBy("conv_id", "turn").collect():
        got.setdefault(r["conv_id"], []).append((r["layout"], r["role"], r["text"]))
    names = ["messages", "conversations", "prompt_completion", "prompt_response", "instruction_output"]
    for i, n in enumerate(names):
        assert got[i] == [(n, "user", "q"), (n, "assistant", "a")]
    assert got[5] == [("instruction_input_output", "user", "do\n\nit"), ("instruction_input_output", "assistant", "a")]
    assert all(got[i] == [(None, None, None)] for i in (6, 7, 8))
    assert chat.segments(chat.json_turns(df, "body")).where("conv_id > 5").count() == 0
    typed = spark.createDataFrame([(1, [("user", "q"), ("assistant", "a")], 0)], "conv_id long, messages array<struct<role:string,content:string>>, extra int")
    assert [(r["turn"], r["role"], r["text"]) for r in chat.typed_turns(typed).orderBy("turn").collect()] == [(0, "user", "q"), (1, "assistant", "a")]
    with pytest.raises(ValueError, match="no mapping"):
        chat.typed_turns(df)


def test_layouts_with_fields_of_other_layouts_and_nulls(spark):
    turns = [{"role": "user", "content": "q"}, {"role": "assistant", "content": None}]
    rows = [
        {"messages": turns, "text": "q a", "prompt": "p"},
        {"messages": [{"role": None, "content": None}, {"role": "user", "content": None}]},
        {"messages": []},
        {"messages": [{"from": "human", "value": "q"}]},
        {"prompt": "q", "completion": None},
        {"prompt": "q", "completion": "a", "response": "b"},
        {"instruction": "do", "input": None, "output": "a", "text": "x"},
        {"prompt": "q"},
    ]
    df = spark.createDataFrame([(i, json.dumps(r)) for i, r in enumerate(rows)], "conv_id long, body string")
    got = {}
    for r in chat.json_turns(df, "body").orderBy("conv_id", "turn").collect():
        got.setdefault(r["conv_id"], []).append((r["layout"], r["role"], r["text"]))
    assert got[0] == [("messages", "user", "q"), ("messages", "assistant", "")]
    assert got[1] == [("messages", "", ""), ("messages", "user", "")]
    assert got[2] == [("messages", None, None)]
    assert got[3] == got[7] == [(None, None, None)]
    assert got[4] == [("prompt_completion", "user", "q"), ("prompt_completion", "assistant", "")]
    assert got[5] == [("prompt_completion", "user", "q"), ("prompt_completion", "assistant", "a")]
    assert got[6] == [("instruction_input_output", "user", "do"), ("instruction_input_output", "assistant", "a")]
    typed = spark.createDataFrame([(1, [("user", "q")], "x", "y")], "conv_id long, messages array<struct<role:string,content:string>>, text string, prompt string")
    assert [(r["role"], r["text"]) for r in chat.typed_turns(typed).collect()] == [("user", "q")]
