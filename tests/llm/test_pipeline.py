"""The pipeline against its stages done one after the other by brute force."""

import duckdb
import pyarrow as pa
from pyspark.sql import functions as F
from test_dedup import brute_class_rows, brute_line_rows, split_words
from test_text import brute_mark_rows, counted, labelled

import corpus_pipeline
from lattica.llm import debruijn, decontaminate, lines, mixing, quality, substring


def test_pipeline(spark, docs, tmp_path):
    good, labels = labelled(spark)
    own = docs.where("doc_id is not null").dropDuplicates(["doc_id"])
    prose = good.select((F.col("doc_id") + 5000).alias("doc_id"), "text", F.lit("en").alias("lang"), F.concat(F.lit("s"), F.col("doc_id") % 3).alias("source"), F.length("text").cast("long").alias("n_chars"))
    again = prose.where("doc_id % 40 = 1").withColumn("doc_id", F.col("doc_id") + 10000)
    every = own.unionByName(prose).unionByName(again)
    texts = {r["doc_id"]: r["text"] for r in every.collect()}
    items = [(0, " ".join(texts[5001].split()[3:20])), (1, " ".join(texts[5002].split()[:12])), (2, "of")]
    every.write.parquet(f"{tmp_path}/documents.parquet")
    labels.withColumn("doc_id", F.col("doc_id") + 5000).write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame(items[:2], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = corpus_pipeline.run(spark, str(tmp_path))
    assert got.columns == [*every.columns, "size", "source_size", "target", "taken"]
    corpus = {r["doc_id"]: r for r in got.collect()}
    got = got.select("doc_id", "size", "source_size", "target", "taken")

    # each document's score by itself
    stats = quality.with_statistics(spark.read.parquet(f"{tmp_path}/documents.parquet"), ["doc_id"])
    model = quality.train(stats, spark.read.parquet(f"{tmp_path}/labels.parquet"))
    left = [(d, t) for d, t in sorted(texts.items()) if model.score(quality.statistics([(t or "").encode()]))[0] >= quality.THRESHOLD]
    assert 0 < len(left) < len(texts)
    left = [(d, t) for d, t, _, _ in brute_line_rows(left)]
    kept = {c for _, c in brute_class_rows(left)}
    assert len(kept) < len(left)
    left = [(d, t) for d, t in left if d in kept]
    clean = {r[0] for r in brute_mark_rows(left, items[:2]) if not r[2]}
    assert len(clean) < len(left)
    source = {r["doc_id"]: r["source"] for r in every.select("doc_id", "source").collect()}
    rest = [(d, t, source[d]) for d, t in left if d in clean]
    con = duckdb.connect()
    con.register("documents", pa.table({"doc_id": [r[0] for r in rest], "text": pa.array([r[1] for r in rest], pa.string()), "source": pa.array([r[2] for r in rest], pa.string())}))
    expected = con.sql(mixing.SQL)
    order = [expected.columns.index(c) for c in got.columns]
    rows = [tuple(r[i] for i in order) for r in expected.fetchall()]
    shown = lambda r: (r[0], r[1], r[2], round(r[3], 6), r[4])
    assert counted(map(shown, rows)) == counted(shown(tuple(r)) for r in got.collect())
    for d, t, _ in rest:
        r, w = corpus[d], split_words(t)
        assert split_words(r["text"]) == (w * 2)[: r["taken"]] and r["n_chars"] == len(r["text"])


def test_stages_keep_the_columns_of_documents(spark, docs, tmp_path):
    docs.limit(0).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, str(tmp_path)).columns == docs.columns
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


#: Every name that an operator or stage adds, and names that they use inside.
INNER = """n_lines N_removed n_words hit items kept n_bytes n_spans own_5_ matches score statistics words upper size source_size target Taken
mixed_text own tie key key_ spans_ shard shard_ lines_ chunks_ kept_ starts_ left_ _hashes _ends id_ band bands root sketch start n kmer digest
_at _end blocks quota offset node path copies label source_rank shards names layout""".split()


def test_columns_of_any_name_pass_through_stages_and_operators(spark, docs, tmp_path):
    """Stages drop what the operators add; operators add theirs under free names, or under those that callers give."""
    docs.limit(0).write.parquet(f"{tmp_path}/documents.parquet")
    items = [(1, " ".join(next(r["text"] for r in docs.collect() if r["doc_id"] == 3).split()[:20]))]
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    _, labels = labelled(spark, 40)
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    own = docs.withColumns({c: F.lit(7) for c in INNER})
    plain = ("doc_id", "text", "lang", "source")
    for _, stage in corpus_pipeline.STAGES:
        out, slim = stage(spark, own, str(tmp_path)), stage(spark, docs, str(tmp_path))
        assert out.columns[: len(own.columns)] == own.columns
        rows = out.collect()
        assert all(r[c] == 7 for r in rows for c in INNER)
        assert counted(tuple(r[:4]) for r in rows) == counted(map(tuple, slim.select(*plain).collect()))
    benchmark = spark.read.parquet(f"{tmp_path}/benchmark.parquet")
    for operator, args, added in ((lines.dedup_lines, (), ("n_lines", "n_removed")), (lines.dedup_runs, (), ("n_lines", "n_removed")), (decontaminate.mark, (benchmark,), ("n_words", "hit", "items")), (substring.dedup_bytes, (), ("kept", "n_bytes", "n_removed", "n_spans")), (debruijn.dedup_windows, (), ("kept", "n_words", "n_removed"))):
        out = operator(own, *args)
        assert out.columns[: len(own.columns)] == own.columns and len({c.lower() for c in out.columns}) == len(out.columns)
        named = operator(own, *args, names={c: f"its_{c}" for c in added})
        assert named.columns == [*own.columns, *(f"its_{c}" for c in added)]
        expected = counted(map(tuple, operator(docs, *args).select("doc_id", *added).collect()))
        assert counted(map(tuple, named.select("doc_id", *(f"its_{c}" for c in added)).collect())) == expected
        assert counted((r["doc_id"], *r[len(own.columns) :]) for r in out.collect()) == expected
