"""Substring, window, line and near-duplicate operators against brute force, with every odd case."""

import hashlib
import itertools
import math
import random
import time

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lattica.llm import _bwt, debruijn, graph, lines, neardup, substring
from lattica.llm import _kernels as K
from lattica.llm import _probmin as P


def split_words(text):
    return [w for w in "".join(" " if c in "\t\n\x0b\x0c\r" else c for c in text or "").split(" ") if w]


def counted(rows):
    return sorted(map(repr, rows))


# ---- bytes


def brute_bytes(rows, width):
    smallest = {}
    for doc, text in rows:
        b = (text or "").encode()
        if doc is not None:
            for s in range(len(b) - width + 1):
                smallest[b[s : s + width]] = min(doc, smallest.get(b[s : s + width], doc))
    out = []
    for doc, text in rows:
        b = (text or "").encode()
        gone = bytearray(len(b))
        for s in range(len(b) - width + 1):
            if doc is not None and smallest[b[s : s + width]] < doc:
                gone[s : s + width] = b"\1" * width
        kept = bytes(c for c, g in zip(b, gone, strict=True) if not g)
        spans = sum(1 for i, g in enumerate(gone) if g and (i == 0 or not gone[i - 1]))
        out.append((doc, len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return counted(out)


def byte_rows(df):
    return counted(tuple(r) for r in df.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256)).collect())


@pytest.mark.parametrize("shard_bytes", [substring.SHARD_BYTES, 20_000])
def test_bytes(docs, shard_bytes):
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    assert byte_rows(substring.dedup_bytes(docs, shard_bytes=shard_bytes)) == brute_bytes(rows, 50)


def test_bytes_empty_and_clashing(empty, clashing):
    assert substring.dedup_bytes(empty).count() == 0
    out = substring.dedup_bytes(clashing)
    assert out.columns[: len(clashing.columns)] == clashing.columns and out.count() == clashing.count()
    assert substring.dedup_bytes(clashing.withColumn("Kept", F.lit(1))).columns == [*clashing.columns, "Kept", "kept__", "n_bytes", "n_removed", "n_spans"]


def test_contexts_that_end_where_others_have_nul():
    context, length = np.array([[97, 0], [97, 0], [97, 0]], np.uint8), np.array([2, 1, 2])
    assert substring._common_context(np.ones(3, np.uint64), context, length).tolist() == [2, 1, 2]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text("ab", min_size=4, max_size=30), min_size=1, max_size=12), st.integers(1, 4))
def test_merged_transforms_find_the_equal_substrings(strings, parts):
    raw = [s.encode() for s in strings]
    data, sizes = np.frombuffer(b"".join(raw), np.uint8), np.array([len(s) for s in raw])
    string, place, interval = _bwt.repeated_intervals(data, sizes, 4, parts)
    found = {}
    for s, p, i in zip(string.tolist(), place.tolist(), interval.tolist(), strict=True):
        found.setdefault(i, set()).add((s, p))
    expected = {}
    for s, b in enumerate(raw):
        for p in range(len(b) - 3):
            expected.setdefault(b[p : p + 4], set()).add((s, p))
    assert sorted(map(sorted, found.values())) == sorted(map(sorted, expected.values()))


def test_merging_equals_sorting_all_suffixes():
    rng = random.Random(3)
    raw = ["".join(rng.choice("abc") for _ in range(rng.randrange(5, 40))).encode() for _ in range(30)]
    data, sizes = np.frombuffer(b"".join(raw), np.uint8), np.array([len(s) for s in raw])
    one = _bwt.Transform(data, sizes, 40)
    cut = 13
    ends = np.append(0, np.cumsum(sizes))
    parts = [_bwt.Transform(data[: ends[cut]], sizes[:cut], 40), _bwt.Transform(data[ends[cut] :], sizes[cut:], 40)]
    source, _ = _bwt.interleave(parts, 40)
    merged = np.empty(len(source), np.uint8)
    for i, p in enumerate(parts):
        merged[source == i] = p.last
    assert (merged == one.last).all()


def test_common_prefixes_come_from_the_merge():
    rng = random.Random(4)
    raw = ["".join(rng.choice("ab") for _ in range(rng.randrange(5, 30))).encode() for _ in range(20)]
    sizes = np.array([len(s) for s in raw])
    ends = np.append(0, np.cumsum(sizes))
    data = np.frombuffer(b"".join(raw), np.uint8)
    parts = [_bwt.Transform(data[ends[a] : ends[b]], sizes[a:b], 12) for a, b in ((0, 7), (7, 12), (12, 20))]
    source, common = _bwt.interleave(parts, 12)
    suffixes, seen = [], [0, 0, 0]
    for part in source.tolist():
        p = parts[part]
        place = int(p.order[seen[part]])
        seen[part] += 1
        string = int(np.searchsorted(p.begin, place, side="right")) - 1
        suffixes.append(raw[(0, 7, 12)[part] + string][place - int(p.begin[string]) :])
    for k in range(1, len(suffixes)):
        x, y = suffixes[k - 1], suffixes[k]
        shared = next((i for i, (c, d) in enumerate(zip(x, y, strict=False)) if c != d), min(len(x), len(y)))
        assert common[k] == min(shared, 12)


# ---- equal hashes of unequal texts


def thue_morse(n, letters):
    return "".join(letters[bin(i).count("1") % 2] for i in range(n))


def colliding_words():
    """Two different words of 16 letters with one hash: the second half takes back what the first has done."""
    rng = np.random.default_rng(1)
    first = rng.integers(0x61, 0x7B, (200_000, 8), np.uint8)
    state = K.mix((np.uint64(16 * K.BASE % 2**64) ^ first.view("<u8")[:, 0]) * np.uint64(K.BASE))
    second = (np.frombuffer(b"abcdefgh", "<u8")[0] ^ state[0] ^ state).view(np.uint8).reshape(-1, 8)
    good = np.flatnonzero(((second > 0x20) & (second < 0x7F)).all(1))[1]
    x, y = first[0].tobytes() + b"abcdefgh", first[good].tobytes() + second[good].tobytes()
    h = K.byte_hashes(np.frombuffer(x + y, np.uint8), np.array([0, 16]), np.array([16, 32]))
    assert x != y and h[0] == h[1]
    return x.decode(), y.decode()


PAIRS = [(thue_morse(1024, "ab"), thue_morse(1024, "ba")), (thue_morse(4096, "xy"), thue_morse(4096, "yx")), colliding_words()]


@pytest.mark.parametrize("pair", PAIRS)
def test_windows_with_colliding_words_are_not_equal(spark, pair):
    w = [f"w{i}" for i in range(39)]
    rows = [(i, " ".join([*w[:20], x, *w[21:]])) for i, x in enumerate(pair)]
    rows.append((2, " ".join([*w[:17], "other", *w[18:20], pair[0], *w[21:], *w[:36]])))
    assert window_rows(debruijn.dedup_windows(spark.createDataFrame(rows, "doc_id long, text string"))) == brute_windows(rows, 35)


@pytest.mark.parametrize("pair", PAIRS)
def test_texts_of_colliding_words_are_not_near(spark, pair):
    df = spark.createDataFrame([(i, x) for i, x in enumerate([*pair, pair[0]])], "doc_id long, text string")
    ids, classes = neardup.near_classes(df)
    roots = {r["doc_id"]: r["root"] for r in neardup.with_class(ids, classes).collect()}
    assert roots[0] == roots[2] != roots[1]


def test_bytes_that_no_string_shares_stay(spark):
    rng = random.Random(9)
    fixed = "the same 16 byte"
    fill = ["".join(rng.choice("0123456789") for _ in range(7)) for _ in range(1024)]
    rows = [(i, "".join(fixed + f + c for f, c in zip(fill, letters, strict=True))) for i, letters in enumerate((thue_morse(1024, "ab"), thue_morse(1024, "ba")))]
    assert byte_rows(substring.dedup_bytes(spark.createDataFrame(rows, "doc_id long, text string"))) == brute_bytes(rows, 50)


def test_spans_of_one_hash_are_told_apart_by_bytes():
    body = [b"one", b"two", b"one", b"six", b"two", b"tw"]
    size = np.array([len(b) for b in body])
    data, start = np.frombuffer(b"".join(body), np.uint8), np.cumsum(size) - size
    for order in itertools.permutations(range(6)):
        i = np.array(order)
        by, fresh = K.variants(data, start[i], size[i], np.zeros(6, np.uint64), np.zeros(6, np.uint64))
        assert [body[k] for k in i[by]] == sorted(body) and fresh.tolist() == [True, False, True, True, True, False]
    long = np.frombuffer(b"x" * 5000 + b"y" + b"x" * 5000, np.uint8)
    assert K.equal_spans(long, np.array([0, 0]), np.array([1, 5001]), np.array([5000, 5000])).tolist() == [False, True]


def test_segments_of_one_digest_in_a_bucket():
    gram = b"the same 16 byte"
    texts = [gram + b"a" * 34, gram + b"b" * 34, gram + b"a" * 34]
    g = K.mix(K.byte_grams(np.frombuffer(gram, np.uint8)))
    sent = [substring._pack(g, np.array([7], np.uint64), np.array([doc], np.int64), np.array([1], np.int32), np.frombuffer(t, np.uint8)) for doc, t in enumerate(texts)]
    answer = substring._merge_segments(pa.table({"shard": [0, 1, 2], "bucket": [0, 0, 0], "message": pa.array(sent, pa.binary())}), 50)
    assert [substring._unpack(x, np.int32, np.int32, np.int64)[2].tolist() for x in answer.column("segments").to_pylist()] == [[0], [1], [0]]


# ---- windows of words


def brute_windows(rows, width):
    count = {}
    for _, text in rows:
        w = split_words(text)
        for s in range(len(w) - width + 1):
            key = tuple(w[s : s + width])
            count[key] = count.get(key, 0) + 1
    out = []
    for doc, text in rows:
        w = split_words(text)
        gone = set()
        for s in range(len(w) - width + 1):
            if count[tuple(w[s : s + width])] > 1:
                gone.update(range(s, s + width))
        out.append((doc, len(w), len(gone), " ".join(x for i, x in enumerate(w) if i not in gone)))
    return counted(out)


def window_rows(df):
    return counted((r["doc_id"], r["n_words"], r["n_removed"], bytes(r["kept"]).decode()) for r in df.collect())


def test_windows(docs):
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    assert window_rows(debruijn.dedup_windows(docs)) == brute_windows(rows, 35)


def test_windows_empty_and_clashing(empty, clashing):
    assert debruijn.dedup_windows(empty).count() == 0
    assert debruijn.dedup_windows(clashing).columns == [*clashing.columns, "kept", "n_words", "n_removed"]


def test_windows_of_few_words(spark):
    rng = random.Random(5)
    rows = [(i, " ".join(rng.choice("abcd") for _ in range(rng.randrange(0, 120)))) for i in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert window_rows(debruijn.dedup_windows(df, width=12, k=4)) == brute_windows(rows, 12)


def test_paths_compact(spark):
    runs = [(n, 10 * i, 10, label) for n, labels in enumerate([(1, 2, 3, 4), (1, 2, 3, 5), (9, 1, 2, 3)]) for i, label in enumerate(labels)]
    df = spark.createDataFrame(runs, "node long, start int, n int, label long")
    got = {r["label"]: r["path"] for r in debruijn.paths(df).collect()}
    assert got[1] == got[2] == got[3] == 1 and len({got[x] for x in (1, 4, 5, 9)}) == 4


# ---- chunks of lines


def brute_line_rows(rows):
    def h(line):
        return int(hashlib.md5(line.encode()).hexdigest()[:8], 16)

    def chunks(ls):
        out, begin = [], 0
        for i, line in enumerate(ls):
            if (h(line) ^ (2 * h(ls[i - 1]) if i else 0)) % 4 == 0 or i == len(ls) - 1:
                out.append((begin, ls[begin : i + 1]))
                begin = i + 1
        return out

    keyed = []
    for doc, text in rows:
        key = hashlib.md5(f"{'null' if doc is None else doc}:{text or ''}".encode()).digest()
        keyed.append((doc, key, text))
    first = {}
    for doc, key, text in keyed:
        for begin, part in chunks((text or "").split("\n")):
            place = (doc is not None, doc or 0, key, begin)
            if len(part) > 1:
                first["\n".join(part)] = min(place, first.get("\n".join(part), place))
    out = []
    for doc, key, text in keyed:
        ls = (text or "").split("\n")
        left = [p for b, p in chunks(ls) if len(p) < 2 or first["\n".join(p)] == (doc is not None, doc or 0, key, b)]
        gone = len(ls) - sum(map(len, left))
        out.append((doc, "\n".join(x for p in left for x in p) if gone else text, len(ls), gone))
    return out


def brute_lines(rows):
    return counted(brute_line_rows(rows))


def test_lines(docs):
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    got = lines.dedup_lines(docs).collect()
    assert counted((r["doc_id"], r["text"], r["n_lines"], r["n_removed"]) for r in got) == brute_lines(rows)
    assert sum(r["n_removed"] for r in got) > 10


def test_lines_empty_and_clashing(empty, clashing):
    assert lines.dedup_lines(empty).count() == 0
    out = lines.dedup_lines(clashing)
    assert out.columns == [*clashing.columns, "n_lines", "n_removed"] and out.count() == clashing.count()


def test_shifted_blocks_are_cut_alike(spark):
    rng = random.Random(8)
    block = [f"line {rng.random()}" for _ in range(40)]
    rows = [(1, "\n".join(block)), (2, "\n".join(["new", *block])), (3, "\n".join([*block[:20], "other", *block[20:]]))]
    got = {r["doc_id"]: r["n_removed"] for r in lines.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[1] == 0 and got[2] >= 20 and got[3] >= 20


def brute_runs(rows):
    """Line by line: a pair of lines that stands earlier goes, its earliest place stays."""
    keyed = [(d, hashlib.md5(f"{'null' if d is None else d}:{t or ''}".encode()).digest(), t, (t or "").split("\n")) for d, t in rows]
    first = {}
    for d, key, _, ls in keyed:
        for i, pair in enumerate(itertools.pairwise(ls)):
            place = ((d is not None, d or 0, key), i)
            first[pair] = min(place, first.get(pair, place))
    out = []
    for d, key, t, ls in keyed:
        gone = set()
        for i, pair in enumerate(itertools.pairwise(ls)):
            owner, at = first[pair]
            if owner != (d is not None, d or 0, key) or i - at > 1:
                gone |= {i, i + 1}
        out.append((d, "\n".join(x for i, x in enumerate(ls) if i not in gone) if gone else t, len(ls), len(gone)))
    return counted(out)


def test_runs(docs, empty, clashing):
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    assert counted(tuple(r) for r in lines.dedup_runs(docs.select("doc_id", "text")).collect()) == brute_runs(rows)
    assert lines.dedup_runs(empty).count() == 0
    out = lines.dedup_runs(clashing)
    assert out.columns == [*clashing.columns, "n_lines", "n_removed"] and out.count() == clashing.count()


@pytest.mark.parametrize("n", [2, 3, 5, 8, 20])
def test_runs_leave_nothing_of_a_shared_passage(spark, n):
    rng = random.Random(n)
    line = lambda: f"line {rng.random()}"
    rows = []
    for i in range(0, 40, 2):
        passage = [line() for _ in range(n)]
        rows += [(i, "\n".join([line(), *passage, line()])), (i + 1, "\n".join([line(), line(), *passage, line()]))]
    got = {r["doc_id"]: r["n_removed"] for r in lines.dedup_runs(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {i: n * (i % 2) for i in range(40)}


# ---- near duplicates


def shingle_set(text):
    w = split_words(text)
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def brute_class_rows(rows):
    texts = sorted({t or "" for _, t in rows})
    sets = {t: shingle_set(t) for t in texts}
    root = {t: t for t in texts}

    def find(t):
        while root[t] != t:
            t = root[t]
        return t

    for a, b in itertools.combinations(texts, 2):
        if sets[a] and sets[b] and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
            root[find(a)] = find(b)
    least = {}
    for doc, t in rows:
        r = find(t or "")
        if doc is not None:
            least[r] = min(doc, least.get(r, doc))
    return [(doc, least.get(find(t or ""))) for doc, t in rows]


def brute_classes(rows):
    return counted(brute_class_rows(rows))


def classes_of(df):
    ids, classes = neardup.near_classes(df)
    rooted = neardup.with_class(ids, classes)
    return counted((r["doc_id"], r["c"]) for r in rooted.join(rooted.groupBy("root").agg(F.min("doc_id").alias("c")), "root").collect())


def test_near_classes(docs):
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    assert classes_of(docs) == brute_classes(rows)


def test_near_copies_of_copies(spark):
    """A chain whose ends differ, and copies that are near their base but not one another, in several tiles."""
    rng = random.Random(2)
    base = [f"v{rng.randrange(10**6)}" for _ in range(400)]
    rows = [(0, " ".join(base))]
    for i in range(1, 60):
        w = list(base)
        for _ in range(rng.choice((2, 4, 8, 12))):
            w[rng.randrange(400)] = f"n{i}"
        rows.append((i, " ".join(w)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    before = neardup.TILE, neardup.SMALL_BAND
    try:
        for neardup.TILE, neardup.SMALL_BAND in ((7, 3), (7, 10**6), (256, 0)):
            assert classes_of(df) == brute_classes(rows)
    finally:
        neardup.TILE, neardup.SMALL_BAND = before


def test_near_empty_and_keep_one(empty, docs, clashing):
    assert neardup.keep_one(empty).count() == 0
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    expected = {c for _, c in map(eval, brute_classes(rows))}
    kept = neardup.keep_one(clashing)
    assert kept.columns == clashing.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(expected)


def test_signatures_estimate_weighted_similarity():
    """Shares of equal components come near the probability Jaccard of weighted sets."""
    rng = np.random.default_rng(0)
    code = K.mix(np.arange(1, 121, dtype=np.uint64))
    a, b = np.arange(0, 90), np.arange(30, 120)
    wa, wb = rng.integers(1, 6, 90).astype(float), rng.integers(1, 6, 90).astype(float)
    x, y = dict(zip(a, wa, strict=True)), dict(zip(b, wb, strict=True))
    exact = sum(1 / sum(max(x.get(e, 0) / x[d], y.get(e, 0) / y[d]) for e in range(120)) for d in set(x) & set(y))
    m = 4096
    sig = P.signatures(2, np.repeat([0, 1], 90), np.concatenate([code[a], code[b]]), np.concatenate([wa, wb]), m)
    assert abs((sig[0] == sig[1]).mean() - exact) < 0.04
    assert (P.signatures(1, np.zeros(1, np.int64), code[:1], np.ones(1), 16) == code[0]).all()


def test_sketch_bound_loses_no_more_than_the_bands():
    p, m = neardup.LEAST + (1 - neardup.LEAST) / 256, neardup.COMPONENTS
    tail = sum(math.comb(m, k) * p**k * (1 - p) ** (m - k) for k in range(neardup.LEAST_MATCHES))
    assert tail <= (1 - neardup.LEAST**neardup.BAND_ROWS) ** (m // neardup.BAND_ROWS)


def test_components(spark):
    edges = [(1, 2), (2, 3), (3, 4), (10, 11), (11, 12), (12, 10), (20, 20)]
    df = spark.createDataFrame([(bytes([a]), bytes([b])) for a, b in edges], "a binary, b binary")
    got = {r["node"][0]: r["root"][0] for r in graph.components(df).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 4: 1, 10: 10, 11: 10, 12: 10}


def test_probability_jaccard_equals_its_definition():
    rng = np.random.default_rng(2)
    for _ in range(50):
        x, y = ({int(k): int(w) for k, w in zip(rng.integers(0, 12, 8), rng.integers(1, 5, 8), strict=True)} for _ in range(2))
        every = {*x, *y}
        expected = sum(1 / sum(max(x.get(j, 0) / x[i], y.get(j, 0) / y[i]) for j in every) for i in {*x} & {*y})
        sides = [(np.array(sorted(s), np.uint64), np.array([s[k] for k in sorted(s)], float)) for s in (x, y)]
        assert math.isclose(P.probability_jaccard(*sides[0], *sides[1]), expected, abs_tol=1e-12)


def test_counted_shingles_decide_links(spark):
    """Equal sets of shingles, very unequal counts: linked without weights, not linked with them."""
    cycle = " ".join(f"c{i}" for i in range(5))
    tail = " ".join(f"t{i}" for i in range(400))
    rows = [(0, f"{cycle} {cycle} {tail}"), (1, f"{' '.join([cycle] * 200)} {tail}"), (2, f"{cycle} {cycle} {tail} {cycle}")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for weight, together in (("one", {(0, 1), (0, 2), (1, 2)}), ("count", {(0, 2)})):
        ids, classes = neardup.near_classes(df, weight=weight)
        root = {r["doc_id"]: r["root"] for r in neardup.with_class(ids, classes).collect()}
        assert {(a, b) for a, b in itertools.combinations(range(3), 2) if root[a] == root[b]} == together


def test_keep_one_is_the_same_whatever_the_order(spark):
    rows = [(1, "a b c d e f", x) for x in "pqrs"] + [(2, "a b c d e f", "t")]
    kept = {tuple(neardup.keep_one(spark.createDataFrame(r, "doc_id long, text string, other string").repartition(n)).collect()) for n, r in ((1, rows), (3, rows[::-1]))}
    assert len(kept) == 1


@pytest.mark.parametrize("operator", [lines.dedup_lines, lines.dedup_runs])
def test_lines_cost_in_proportion_to_a_text(spark, operator):
    """Two near-equal texts of very many lines: four times the lines take at most five times as long."""
    taken = {}
    for n in (200, 20_000, 80_000):
        rng = random.Random(n)
        a = [f"line {rng.randrange(10**9)}" for _ in range(n)]
        b = [x if i % 100 else f"{x}!" for i, x in enumerate(a)]
        frame = spark.createDataFrame([(1, "\n".join(a)), (2, "\n".join(b))], "doc_id long, text string")
        began = time.monotonic()
        got = {r["doc_id"]: r["n_removed"] for r in operator(frame).select("doc_id", "n_removed").collect()}
        taken[n] = time.monotonic() - began
        assert got[1] == 0
        assert got[2] == n - n // 100 if operator is lines.dedup_runs else got[2] > n // 2
    assert taken[80_000] < 5 * taken[20_000]
