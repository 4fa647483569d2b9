"""Line dedup by content-defined chunks of lines. DataFrame functions only.

Each line has a 32-bit hash; a rolling combination of the last ``WINDOW`` of them ends a chunk where it
is 0 modulo ``EVERY``, so the same run of lines is cut the same way wherever it stands. A chunk of two
lines or more that also stands earlier, in the order of doc_id, then text hash, then line, is removed
once the bytes of all chunks of its hash (SHA-256, 16 bytes) have been compared; the first occurrence stays.

Plan: hashes of chunks are counted without their texts; only the repeated ones go on, with their
places. Bytes are compared by the least and the greatest text of each hash, which partial aggregates
find before any shuffle, so a chunk that a third of all documents share is one row a task. What the
places are joined with is written first, so that Spark can split the places of a very common chunk. Joins
with the texts are sort-merge joins at every size, so that what a run needs grows with its input alone.

``dedup_runs`` leaves none of a repeated passage. A chunk is found only where it lies wholly inside what is
shared, so chunks propose, and their matches are extended line by line: each run of ``RUN`` lines that is not inside a
repeated chunk is looked up by itself, wherever in the text it begins, and goes if it also stands earlier, as does
every line of a longer run. Of two places in one document, the later counts as a repeat where they have no line in
common. A line's earliest place is never removed.

A text costs a few passes over its lines, however many these are: arrays are bound once and read by index.

Cases: null text stays null, empty text empty; lines end at line feeds alone, and texts of one line lose
nothing; null doc_id comes first; rows that agree in doc_id and text are one document and keep the
same; columns besides doc_id and text are passed on, and the added columns get underscores where one has
its name; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import free_name, named, stash, table

#: Lines of the rolling hash, and mean lines from one chunk's end to the next.
WINDOW, EVERY = 2, 4
#: Lines of the shortest run that dedup_runs removes; as for chunks, no line is removed by itself.
RUN = 2


def _line_hash(line: Column) -> Column:
    return F.conv(F.substring(F.md5(line.cast("binary")), 1, 8), 16, 10).cast("long")


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def with_chunks(df: DataFrame, text: str, lines: str, chunks: str, window: int = WINDOW, every: int = EVERY) -> DataFrame:
    """``df`` with the lines of a text and its chunks: array of (first line, number of lines)."""
    hashes = free_name(df, "_hashes")
    df = df.withColumn(lines, _lines(F.col(text)))
    df = df.withColumn(hashes, F.transform(lines, _line_hash))
    return _chunked(df, hashes, chunks, window, every).drop(hashes)


def _chunked(df: DataFrame, hashes: str, chunks: str, window: int, every: int) -> DataFrame:
    """``df`` with the chunks of lines of which a column has the 32-bit hashes."""
    ends = free_name(df, "_ends")

    def ends_here(all_hashes: Column, h: Column, i: Column) -> Column:
        rolled = h
        for back in range(1, window):
            rolled = rolled.bitwiseXOR(F.shiftleft(F.coalesce(F.get(all_hashes, i - back), F.lit(0).cast("long")), back))
        return F.when((rolled % every == 0) | (i == F.size(all_hashes) - 1), i)

    df = df.withColumn(ends, _let(F.col(hashes), lambda h: F.filter(F.transform(h, lambda x, i: ends_here(h, x, i)), lambda i: i.isNotNull())))

    def chunk(all_ends: Column, e: Column, j: Column) -> Column:
        start = F.when(j == 0, 0).otherwise(F.get(all_ends, j - 1) + 1)
        return F.struct(start.alias("start"), (e - start + 1).alias("n"))

    return df.withColumn(chunks, _let(F.col(ends), lambda all_ends: F.transform(all_ends, lambda e, j: chunk(all_ends, e, j)))).drop(ends)


def _let(value: Column, body) -> Column:
    """``body`` of ``value``, which is evaluated once however often a lambda in the body reads it."""
    return F.get(F.transform(F.array(value), body), 0)


def _text_of(lines: Column, start: Column, n: Column) -> Column:
    """Lines start, ..., start + n - 1; slice() inside a lambda would copy all lines for each call."""
    return F.array_join(F.transform(F.sequence(start, start + n - 1), lambda i: F.get(lines, i)), "\n")


def _span(start: Column, n: Column) -> Column:
    """One number for both, which array functions can hash."""
    return F.shiftleft(start.cast("long"), 32).bitwiseOR(n.cast("long"))


def _lines_of(span: Column) -> Column:
    """The line numbers of a span."""
    start = F.shiftright(span, 32)
    return F.sequence(start, start + span.bitwiseAND((1 << 32) - 1) - 1)


def _hash(text: Column) -> Column:
    return F.substring(F.unhex(F.sha2(text.cast("binary"), 256)), 1, 16)


def _key(docs: DataFrame) -> Column:
    """What stands for doc_id and text; texts as ids are marked, so that none reads as null."""
    own = F.concat(F.lit("="), F.col("doc_id")) if docs.schema["doc_id"].dataType.typeName() == "string" else F.col("doc_id").cast("string")
    return _hash(F.concat_ws(":", F.coalesce(own, F.lit("null")), F.coalesce(F.col("text"), F.lit(""))))


def _keyed(docs: DataFrame) -> DataFrame:
    """doc_id, text and a key that stands for both."""
    return docs.select("doc_id", "text", _key(docs).alias("key"))


def _same_bytes(keyed: DataFrame, by_doc: DataFrame) -> DataFrame:
    """hash: those whose places (key, repeats of start, n and hash) all have the same bytes."""
    joined = keyed.select("key", "text").join(by_doc.hint("merge"), "key")
    told = _let(_lines(F.col("text")), lambda lines: F.transform("repeats", lambda c: F.struct(c["hash"].alias("hash"), _text_of(lines, c["start"], c["n"]).alias("chunk"))))
    texts = joined.select(F.explode(told).alias("c")).select("c.*")
    return texts.groupBy("hash").agg((F.min("chunk") == F.max("chunk")).alias("same")).where("same").select("hash")


def repeated_chunks(docs: DataFrame, window: int = WINDOW, every: int = EVERY) -> DataFrame:
    """key, spans: each document's chunks that stand earlier elsewhere, bytes compared."""
    keyed = _keyed(docs)
    cut = with_chunks(keyed, "text", "lines", "chunks", window, every)
    chunk = lambda lines, c: F.struct(_hash(_text_of(lines, c["start"], c["n"])).alias("hash"), c["start"].alias("start"), c["n"].alias("n"))
    many = _let(F.col("lines"), lambda lines: F.transform(F.filter("chunks", lambda c: c["n"] > 1), lambda c: chunk(lines, c)))
    places = stash(cut.select("doc_id", "key", F.explode(many).alias("c")).select("doc_id", "key", "c.*").distinct(), "line-chunks")
    first = places.groupBy("hash").agg(F.min(F.struct("doc_id", "key", "start")).alias("first"), F.count("*").alias("times")).where("times > 1").select("hash", "first")
    first = stash(first, "line-first")
    again = stash(places.join(first, "hash").select("key", "start", "n", "hash", (F.struct("doc_id", "key", "start") == F.col("first")).alias("is_first")), "line-repeats")

    by_doc = again.groupBy("key").agg(F.collect_list(F.struct("start", "n", "hash")).alias("repeats"))
    same = stash(_same_bytes(keyed, by_doc), "line-same")
    return again.where(~F.col("is_first")).join(same, "hash", "left_semi").groupBy("key").agg(F.collect_set(_span(F.col("start"), F.col("n"))).alias("spans"))


def _without(docs: DataFrame, marks: DataFrame) -> DataFrame:
    """``docs`` without the lines of the spans in ``marks`` (key, spans), with n_lines and n_removed at the end."""
    key, spans, gone, short = (free_name(docs, c) for c in ("key_", "spans_", "gone_", "short_"))
    df = docs.withColumn(key, _key(docs)).join(marks.select(F.col("key").alias(key), F.col("spans").alias(spans)).hint("merge"), key, "left")
    df = df.withColumn(gone, F.array_distinct(F.flatten(F.transform(spans, _lines_of))))
    left = lambda lines: F.array_except(F.sequence(F.lit(0).cast("long"), F.size(lines).cast("long") - 1), F.col(gone))
    kept = _let(_lines(F.col("text")), lambda lines: F.struct(F.size(lines).alias("n"), F.when(F.col(gone).isNotNull(), F.array_join(F.transform(left(lines), lambda i: F.get(lines, i.cast("int"))), "\n")).alias("text")))
    df = df.withColumn(short, kept)
    text = F.when(F.col(gone).isNull(), F.col("text")).otherwise(F.col(short)["text"])
    added = {"n_lines": F.col(short)["n"].cast("long"), "n_removed": F.when(F.col(gone).isNull(), 0).otherwise(F.size(gone)).cast("long")}
    return df.select(*[text.alias("text") if c == "text" else F.col(f"`{c}`") for c in docs.columns], *[v.alias(c) for c, v in added.items()])


@named("n_lines", "n_removed")
def dedup_lines(docs: DataFrame, window: int = WINDOW, every: int = EVERY) -> DataFrame:
    """``docs``, all columns, with ``text`` shortened, and n_lines and n_removed (lines) at the end."""
    return _without(docs, stash(repeated_chunks(docs, window, every), "line-removals"))


def _first_places(places: DataFrame, label: str) -> DataFrame:
    """hash, first (doc_id, key, start) of the hashes of ``places`` that stand twice; written, so that Spark can split the places of a hot one."""
    first = places.groupBy("hash").agg(F.min(F.struct("doc_id", "key", "start")).alias("first"), F.count("*").alias("times"))
    return stash(first.where("times > 1").select("hash", "first"), label)


def repeated_runs(docs: DataFrame, least: int = RUN, window: int = WINDOW, every: int = EVERY) -> DataFrame:
    """key, spans: each document's runs of ``least`` lines or more that stand earlier, bytes compared.

    Chunks propose: those of ``least`` lines or more that repeat go whole. Line by line, the matches are then
    extended: of all runs of ``least`` lines but those inside such a repeat, each that stands earlier goes too.
    """
    keyed = _keyed(docs)
    hashed = stash(keyed.select("doc_id", "key", _let(_lines(F.col("text")), lambda lines: F.transform(lines, _hash)).alias("hashes")), "line-hashes")
    number = lambda h: F.conv(F.hex(F.substring(h, 1, 4)), 16, 10).cast("long")
    cut = _chunked(hashed.withColumn("numbers", F.transform("hashes", number)), "numbers", "chunks", window, every)
    of = lambda start, n: _hash(F.array_join(F.transform(F.sequence(start, start + n - 1), lambda i: F.hex(F.get(F.col("hashes"), i))), ""))
    many = F.transform(F.filter("chunks", lambda c: c["n"] >= least), lambda c: F.struct(of(c["start"], c["n"]).alias("hash"), c["start"].alias("start"), c["n"].alias("n")))
    chunks = stash(cut.select("doc_id", "key", F.explode(many).alias("c")).select("doc_id", "key", "c.*"), "line-chunks")
    found = chunks.join(_first_places(chunks, "line-first"), "hash").select("key", "start", "n", "hash", (F.struct("doc_id", "key", "start") == F.col("first")).alias("stays"))
    found = stash(found, "line-repeats")

    inside = found.where(~F.col("stays") & (F.col("n") >= least)).groupBy("key").agg(F.collect_set(_span(F.col("start"), F.col("n") - least + 1)).alias("spans"))
    starts = F.array_except(F.sequence(F.lit(0).cast("long"), F.size("hashes").cast("long") - least), F.coalesce(F.flatten(F.transform("spans", _lines_of)), F.array().cast("array<long>")))
    rest = hashed.where(F.size("hashes") >= least).join(inside, "key", "left").withColumn("starts", starts)
    run = lambda i: F.struct(of(i.cast("int"), F.lit(least)).alias("hash"), i.cast("int").alias("start"))
    runs = stash(rest.select("doc_id", "key", F.explode(F.transform("starts", run)).alias("c")).select("doc_id", "key", "c.*"), "line-runs")
    own = (F.col("key") == F.col("first.key")) & F.col("doc_id").eqNullSafe(F.col("first.doc_id"))
    more = runs.join(_first_places(runs, "line-first"), "hash").select("key", "start", F.lit(least).alias("n"), "hash", (own & (F.col("start") - F.col("first.start") < least)).alias("stays"))
    found = found.unionByName(stash(more, "line-run-repeats"))

    by_doc = found.groupBy("key").agg(F.collect_set(F.struct("start", "n", "hash")).alias("repeats"))
    same = stash(_same_bytes(keyed, by_doc), "line-same")
    return found.where(~F.col("stays")).join(same, "hash", "left_semi").groupBy("key").agg(F.collect_set(_span(F.col("start"), F.col("n"))).alias("spans"))


@named("n_lines", "n_removed")
def dedup_runs(docs: DataFrame, least: int = RUN, window: int = WINDOW, every: int = EVERY) -> DataFrame:
    """``docs``, all columns, with ``text`` without the lines of repeated runs, and n_lines and n_removed (lines) at the end."""
    return _without(docs, stash(repeated_runs(docs, least, window, every), "line-removals"))


def op10_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_removed", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("kept_sha256"))


def op10_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = dedup_runs(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_removed", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("kept_sha256"))


SQL = r"""
with d as (
  select doc_id, coalesce(text, '') as text, sha256(concat_ws(':', coalesce(doc_id::varchar, 'null'), coalesce(text, ''))) as key, string_split(coalesce(text, ''), chr(10)) as l from documents
), docs as (
  select distinct doc_id, key, l from d
), line as (
  select doc_id, key, i, l[i] as s, len(l) as n, ('0x' || substr(md5(l[i]), 1, 8))::bigint as h from docs, lateral (select unnest(range(1, len(l) + 1)) as i)
), cut as (
  select *, case when xor(h, 2 * coalesce(lag(h) over (partition by key order by i), 0)) % 4 = 0 or i = n then 1 else 0 end as last from line
), part as (
  select *, coalesce(sum(last) over (partition by key order by i rows between unbounded preceding and 1 preceding), 0) as c from cut
), chunk as (
  select doc_id, key, c, min(i) as start, count(*) as lines, string_agg(s, chr(10) order by i) as body from part group by all
), ranked as (
  select *, row_number() over (partition by body order by doc_id nulls first, key, start) as place from chunk where lines > 1
), kept as (
  select c.* from chunk c left join ranked r on c.key = r.key and c.c = r.c where coalesce(r.place, 1) = 1
), res as (
  select key, sum(lines)::bigint as n, string_agg(body, chr(10) order by c) as body from kept group by key
)
select doc_id, len(l)::bigint as n_lines, (len(l) - coalesce(n, 0))::bigint as n_removed, sha256(coalesce(body, '')) as kept_sha256 from d left join res using (key)
"""

RUNS_SQL = r"""
with d as (
  select doc_id, coalesce(text, '') as text, sha256(concat_ws(':', coalesce(doc_id::varchar, 'null'), coalesce(text, ''))) as key, string_split(coalesce(text, ''), chr(10)) as l from documents
), docs as (
  select distinct doc_id, key, l from d
), line as (
  select doc_id, key, i, l[i] as s, len(l) as n, l[i] || chr(10) || l[i + 1] as pair from docs, lateral (select unnest(range(1, len(l) + 1)) as i)
), ranked as (
  select key, i, first_value(key) over w as k, first_value(doc_id) over w as d, first_value(i) over w as i0, doc_id from line where i < n window w as (partition by pair order by doc_id nulls first, key, i)
), gone as (
  select key, i from ranked where not (k = key and d is not distinct from doc_id and i - i0 < 2)
), removed as (
  select key, i from gone union select key, i + 1 from gone
), res as (
  select key, count(*)::bigint as n, string_agg(s, chr(10) order by i) as body from line anti join removed using (key, i) group by key
)
select doc_id, len(l)::bigint as n_lines, (len(l) - coalesce(n, 0))::bigint as n_removed, sha256(coalesce(body, '')) as kept_sha256 from d left join res using (key)
"""
