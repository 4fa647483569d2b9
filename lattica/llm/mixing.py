"""Mixing sources to target weights by Sainte-Laguë apportionment of equal-token blocks.

DataFrame functions only. A source's target is its weight's share of the budget, levelled at
``most_repeats`` times its own size. The budget is cut into blocks of ``block_words`` words, which go
to the sources by highest quotients target / (2k + 1), and within a source to its shards the same way;
no source or shard gets more blocks than ``most_repeats`` times its own, and the next quotients get
what it can't take. In a shard the documents stand in a seeded order, their words form one stream that
is cut into blocks, and the shard's quota picks blocks at even distances from a seeded offset, so what a
document gives is a difference of two closed forms: no block is ever a row. Cost doesn't depend on the
block, so a block is one word and even a source of a few words comes within a word of its target;
larger blocks keep neighbouring words together.

Cases: null and empty texts have size 0 and take 0; null source is a source of its own and comes last;
rows with the same doc_id are documents of their own; an empty table gives no rows; ``mix`` ignores
further columns, ``mixed`` passes all on and adds its own under free names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._common import stash, table

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5, 2, 1)
BUDGET = 1.5
MOST_REPEATS = 2
#: Words of a block.
BLOCK_WORDS = 1
#: Words of a shard, so that the order within it is one task's small sort.
SHARD_WORDS = 1 << 21
#: Documents of a shard, where they are very short.
SHARD_DOCS = 1 << 16
SEED = "mix-1"


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sources: DataFrame, weights=WEIGHTS, budget: float = BUDGET, most: int = MOST_REPEATS) -> DataFrame:
    """``sources`` (source, source_size) with ``target``.

    Level filling: source i takes min(cap_i, level * weight_i). In the order of cap / weight the first
    sources are full; the level is the first at which the next one is not.
    """
    by_name = Window.partitionBy().orderBy(F.col("source").asc_nulls_last())
    ladder = Window.partitionBy().orderBy(F.col("_cap") / F.col("_weight"), "_rank")
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    df = sources.withColumn("_rank", F.row_number().over(by_name))
    df = df.withColumn("_weight", F.element_at(cycle, ((F.col("_rank") - 1) % len(weights) + 1).cast("int")))
    df = df.withColumn("_cap", F.col("source_size").cast("double") * most)
    total = F.sum("source_size").over(Window.partitionBy()) * F.lit(float(budget))
    full_before = F.coalesce(F.sum("_cap").over(ladder.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    weight_from = F.sum("_weight").over(ladder.rowsBetween(0, Window.unboundedFollowing))
    df = df.withColumn("_level", (total - full_before) / weight_from)
    # the level of the first source that the level does not fill; where it fills all, each is at its cap
    level = F.min(F.when(F.col("_level") * F.col("_weight") <= F.col("_cap"), F.struct(F.col("_cap") / F.col("_weight"), F.col("_rank"), F.col("_level")))).over(Window.partitionBy())
    df = df.withColumn("_found", level["_level"])
    return df.withColumn("target", F.coalesce(F.least("_cap", F.col("_found") * F.col("_weight")), F.col("_cap"))).select(*sources.columns, "target", F.col("_rank").alias("source_rank"))


def sainte_lague(parties: DataFrame, group: list[str], votes: str, seats: str, cap: str, order: list[str], out: str) -> DataFrame:
    """Seats of each party of a group by highest quotients votes / (2k + 1), at most ``cap`` each, ties by ``order``.

    Rounding votes at a divisor slightly too large gives all seats but at most one a party; the quotients
    between it and a divisor slightly too small, some two a party, are the only ones that are ranked. The caps
    must have room for all seats where each party has its exact share.
    """
    of = Window.partitionBy(*group)
    n, total = F.count("*").over(of), F.sum(votes).over(of)
    m = F.col(seats)
    base = F.when(m - n / 2 > 0, F.floor(F.col(votes) / (total / (m - n / 2)) + 0.5)).otherwise(0)
    limit = F.floor(F.col(votes) / (total / (m + n / 2)) + 0.5) + 1
    df = parties.withColumn("_base", F.least(cap, F.when(total > 0, base).otherwise(0).cast("long"))).withColumn("_limit", F.least(cap, F.when(total > 0, limit).otherwise(0).cast("long")))
    df = df.withColumn("_left", m - F.sum("_base").over(of))
    tried = df.withColumn("_k", F.explode_outer(F.when(F.col("_limit") > F.col("_base"), F.sequence(F.col("_base"), F.col("_limit") - 1))))
    tried = tried.withColumn("_quotient", F.when(F.col("_k").isNotNull(), F.col(votes) / (2 * F.col("_k") + 1)))
    place = F.row_number().over(of.orderBy(F.col("_quotient").desc_nulls_last(), *order))
    won = (F.col("_place") <= F.col("_left")) & F.col("_quotient").isNotNull()
    return tried.withColumn("_place", place).groupBy(*parties.columns).agg((F.first("_base") + F.sum(F.when(won, 1).otherwise(0))).alias(out))


def _apportioned(sized: DataFrame, weights, budget: float, most: int, block_words: int, shard_words: int, seed: str) -> DataFrame:
    """``sized`` (doc_id, source, size, tie and more) with source_size, target and taken."""
    sources = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("source_docs"))
    quota = targets(sources, weights, budget, most)
    whole = Window.partitionBy()
    blocks = lambda c: F.ceil(F.col(c) / block_words).cast("long")
    quota = quota.withColumn("_seats", F.round(F.sum("target").over(whole) / block_words).cast("long")).withColumn("_all", F.lit(0)).withColumn("_cap", blocks("source_size") * most)
    quota = sainte_lague(quota, ["_all"], "target", "_seats", "_cap", ["source_rank"], "source_blocks")
    quota = quota.withColumn("shards", F.greatest(F.lit(1), F.ceil(F.col("source_size") / shard_words), F.ceil(F.col("source_docs") / SHARD_DOCS)).cast("long"))
    quota = stash(quota.select("source", "source_rank", "source_size", "target", "source_blocks", "shards"), "mix-quota")

    same = sized["source"].eqNullSafe(quota["source"])
    placed = sized.join(quota, same).select(sized["*"], "source_rank", "source_size", "target", "source_blocks", "shards")
    seeded = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))))
    placed = placed.withColumn("_at", seeded).withColumn("shard", F.pmod(F.conv(F.substring("_at", 1, 12), 16, 10).cast("long"), F.col("shards")))
    shards = placed.groupBy("source_rank", "shard", "source_blocks").agg(F.sum("size").alias("shard_words"))
    shards = shards.withColumn("blocks", blocks("shard_words")).withColumn("_cap", F.col("blocks") * most)
    shards = sainte_lague(shards, ["source_rank"], "shard_words", "source_blocks", "_cap", ["shard"], "quota")
    start_of = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(seed), F.lit("offset"), F.col("source_rank"), F.col("shard"))), 1, 12), 16, 10).cast("long")
    shards = shards.withColumn("offset", F.when(F.col("blocks") > 0, F.pmod(start_of, F.col("blocks"))).otherwise(0)).select("source_rank", "shard", "blocks", "quota", "offset")

    order = Window.partitionBy("source_rank", "shard").orderBy("_at", "doc_id", "size", "tie").rowsBetween(Window.unboundedPreceding, 0)
    laid = placed.withColumn("_end", F.sum("size").over(order)).join(shards, ["source_rank", "shard"])
    # words of chosen blocks, repeats counted, before a word of the shard's stream
    picks = lambda j: f"((({j}) * quota + offset) div blocks)"
    before = lambda at, b: f"({picks(b)} * {block_words} + ({picks(f'{b} + 1')} - {picks(b)}) * ({at} % {block_words}))"
    chosen = lambda at: before(at, f"({at} div {block_words})")
    taken = F.expr(f"case when blocks > 0 then {chosen('_end')} - {chosen('(_end - size)')} else 0 end")
    return laid.select(*sized.columns, "source_size", "target", taken.cast("long").alias("taken"))


def mix(
    docs: DataFrame, weights=WEIGHTS, budget: float = BUDGET, most: int = MOST_REPEATS, block_words: int = BLOCK_WORDS, shard_words: int = SHARD_WORDS, seed: str = SEED
) -> DataFrame:
    """doc_id, size, source_size, target, taken of every row of ``docs`` (doc_id, text, source)."""
    sized = stash(docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), F.xxhash64("text").alias("tie")), "mix-sizes")
    return _apportioned(sized, weights, budget, most, block_words, shard_words, seed).select("doc_id", "size", "source_size", "target", "taken")


def taken_text(text: Column, size: Column, taken: Column) -> Column:
    """The words that the mix takes: whole copies, then the text's first words, as they stand in it; one a paragraph."""
    words = F.regexp_extract_all(text, F.lit(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+"), F.lit(0))
    copies = F.when(size > 0, F.floor(taken / size)).otherwise(0).cast("int")
    rest = F.when(size > 0, taken % size).otherwise(0).cast("int")
    part = F.when(rest > 0, F.array(F.array_join(F.slice(words, F.lit(1), rest), ""))).otherwise(F.array().cast("array<string>"))
    return F.array_join(F.concat(F.array_repeat(F.coalesce(text, F.lit("")), copies), part), "\n\n")


def mixed(docs: DataFrame, names: dict[str, str] | None = None, **options) -> DataFrame:
    """``docs`` (doc_id, text, source and more) with size, source_size, target, taken and mixed_text, which is what the mix takes of the text.

    ``names`` says what the added columns are called where ``docs`` has columns of these names.
    """
    added = ("size", "source_size", "target", "taken", "mixed_text")
    called = {c: (names or {}).get(c, c) for c in added}
    if clash := {c.lower() for c in docs.columns} & {c.lower() for c in called.values()}:
        raise ValueError(f"columns {sorted(clash)} would be hidden")
    own = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    others = F.to_json(F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != "text"]))
    rows = docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), F.xxhash64("text", others).alias("tie"), own.alias("own"))
    base = {"weights": WEIGHTS, "budget": BUDGET, "most": MOST_REPEATS, "block_words": BLOCK_WORDS, "shard_words": SHARD_WORDS, "seed": SEED}
    out = _apportioned(rows, **(base | options)).withColumn("mixed_text", taken_text(F.col("own.text"), F.col("size"), F.col("taken")))
    return out.select("own.*", *[F.col(c).alias(called[c]) for c in added])


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))


#: The same by brute force: every quotient below a cap is ranked, and every word of every document is laid out and picked or not.
SQL = r"""
with sized as (
  select doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::bigint as size from documents
), src as (
  select source, sum(size)::bigint as source_size, count(*) as docs, row_number() over (order by source nulls last) as rnk from sized group by source
), w as (
  select *, [5.0, 2.0, 1.0][((rnk - 1) % 3 + 1)::int]::double as weight, source_size::double * 2 as cap from src
), ladder as (
  select *, (sum(source_size) over ()::double * 1.5 - coalesce(sum(cap) over (order by cap / weight, rnk rows between unbounded preceding and 1 preceding), 0))
    / sum(weight) over (order by cap / weight, rnk rows between current row and unbounded following) as lvl from w
), found as (
  select *, (select lvl from ladder where lvl * weight <= cap order by cap / weight, rnk limit 1) as level from ladder
), tgt as (
  select source, source_size, rnk, coalesce(least(cap, level * weight), cap) as target, greatest(1, ceil(source_size / 2097152.0), ceil(docs / 65536.0))::bigint as shards from found
), seats as (
  select rnk, count(*) as words_won from (
    select rnk, row_number() over (order by target / (2 * k + 1) desc, rnk) as place, round(sum_t)::bigint as m
    from (select *, sum(target) over () as sum_t from tgt) t, lateral (select unnest(range(0, 2 * source_size)) as k)
  ) where place <= m group by rnk
), sharded as (
  select s.*, t.source_size, t.target, t.rnk, md5('mix-1:' || coalesce(s.doc_id::varchar, 'null')) as hexed, ('0x' || substr(md5('mix-1:' || coalesce(s.doc_id::varchar, 'null')), 1, 12))::bigint % t.shards as shard
  from sized s join tgt t on s.source is not distinct from t.source
), shard as (
  select rnk, shard, sum(size)::bigint as words from sharded group by all
), won as (
  select rnk, shard, count(*) as q from (
    select rnk, shard, row_number() over (partition by rnk order by words / (2 * k + 1) desc, shard) as place, words_won
    from (select s.*, coalesce(words_won, 0) as words_won from shard s left join seats using (rnk)) x, lateral (select unnest(range(0, 2 * words)) as k)
  ) where place <= words_won group by all
), cut as (
  select rnk, shard, words as m, coalesce(q, 0)::bigint as q, case when words > 0 then ('0x' || substr(md5('mix-1:offset:' || rnk || ':' || shard), 1, 12))::bigint % words else 0 end as o
  from shard left join won using (rnk, shard)
), laid as (
  select *, row_number() over () as r, sum(size) over (partition by rnk, shard order by hexed, doc_id, size rows unbounded preceding)::bigint as e from sharded
), word as (
  select r, ((j + 1) * q + o) // m - (j * q + o) // m as picked from laid join cut using (rnk, shard), lateral (select unnest(range(e - size, e)) as j)
), picked as (
  select r, sum(picked)::bigint as taken from word group by r
)
select doc_id, size, source_size, target, coalesce(taken, 0)::bigint as taken from laid left join picked using (r)
"""
