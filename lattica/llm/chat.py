r"""Chat formatting: schema fingerprints select declarative mappings into canonical turns.

A layout is a set of nested field paths. Its fingerprint hashes those of its paths that any mapping
reads, and names the mapping that turns its rows into turns (conv_id, turn, role, text). Where further
columns are also paths of other mappings, the mapping with most paths that are all there is taken. The template writes a turn as ``### role: text</turn>`` and a line feed.
A backslash stands before each control string inside a role or text (backslash, ``###``, ``</turn>``,
and the colon in roles), which ``read_segment`` takes back.

A conversation is a run of segments, one row a turn: no row and no task's memory grows with a
conversation's length. Digests fold over the segments in order.

Cases: null text is an empty turn; null role reads as an empty role; null turns come first, and turns
with the same number stand in the order of role, then text; repeated rows are repeated turns; null
conv_id is a conversation of its own; an empty table gives no rows; a layout that no mapping fits is an
error that names its paths (typed rows) or one row with layout null and no turn (JSON rows).
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._common import table

_TURN = "array<struct<turn:bigint,role:string,text:string>>"
OPEN, CLOSE = "### ", "</turn>"
ASSISTANT = "assistant"


def field_paths(schema: T.DataType, prefix: str = "") -> list[str]:
    """Sorted paths of all leaves, with [] for an array's elements and {} for a map's values."""
    if isinstance(schema, T.StructType):
        return sorted(p for f in schema.fields for p in field_paths(f.dataType, f"{prefix}.{f.name}" if prefix else f.name))
    if isinstance(schema, T.ArrayType):
        return field_paths(schema.elementType, prefix + "[]")
    if isinstance(schema, T.MapType):
        return field_paths(schema.valueType, prefix + "{}")
    return [prefix]


@dataclass(frozen=True)
class Mapping:
    """Paths that a layout has, and the SQL expression of its array of turns."""

    name: str
    paths: tuple[str, ...]
    turns: str

    @property
    def fingerprint(self) -> str:
        return _hash(self.paths)


def _hash(paths) -> str:
    return hashlib.md5("\n".join(sorted(paths)).encode()).hexdigest()


def _pair(first: str, second: str) -> str:
    return f"array(named_struct('turn', 0L, 'role', 'user', 'text', {first}), named_struct('turn', 1L, 'role', 'assistant', 'text', {second}))"


def _list(column: str, role: str, text: str) -> str:
    return f"transform({column}, (m, i) -> named_struct('turn', cast(i as bigint), 'role', {role}, 'text', m.{text}))"


_FROM = "CASE lower(m.`from`) WHEN 'human' THEN 'user' WHEN 'gpt' THEN 'assistant' ELSE lower(m.`from`) END"
MAPPINGS = (
    Mapping("turn_rows", ("turn", "role", "text"), "array(named_struct('turn', turn, 'role', role, 'text', text))"),
    Mapping("messages", ("messages[].role", "messages[].content"), _list("messages", "m.role", "content")),
    Mapping("conversations", ("conversations[].from", "conversations[].value"), _list("conversations", _FROM, "value")),
    Mapping("prompt_completion", ("prompt", "completion"), _pair("prompt", "completion")),
    Mapping("prompt_response", ("prompt", "response"), _pair("prompt", "response")),
    Mapping("instruction_output", ("instruction", "output"), _pair("instruction", "output")),
    Mapping("instruction_input_output", ("instruction", "input", "output"), _pair("concat_ws('\\n\\n', instruction, nullif(input, ''))", "output")),
)
VOCABULARY = frozenset(p for m in MAPPINGS for p in m.paths)
BY_FINGERPRINT = {m.fingerprint: m for m in MAPPINGS}
BY_SIZE = sorted(MAPPINGS, key=lambda m: -len(m.paths))
#: What JSON rows are read as: every path of every mapping.
JSON_FIELDS = "messages array<struct<role:string,content:string>>, conversations array<struct<`from`:string,value:string>>, prompt string, completion string, response string, instruction string, input string, output string, turn bigint, role string, text string"


def fingerprint(schema: T.StructType) -> str:
    return _hash(VOCABULARY.intersection(field_paths(schema)))


def mapping_of(paths: set[str]) -> Mapping | None:
    """The mapping of a layout: by its fingerprint, or else, of those whose paths it all has, the one with most paths, the first of equals."""
    found = BY_FINGERPRINT.get(_hash(VOCABULARY & paths))
    return found or next((m for m in BY_SIZE if paths.issuperset(m.paths)), None)


def typed_turns(rows: DataFrame, conv_id: str = "conv_id") -> DataFrame:
    """Canonical turns (conv_id, turn, role, text) of rows that all have the layout of their schema."""
    found = mapping_of(set(field_paths(rows.schema)))
    if found is None:
        raise ValueError(f"no mapping for the fields {field_paths(rows.schema)}")
    turns = rows.select(F.col(conv_id).alias("conv_id"), F.explode(F.expr(f"cast({found.turns} as {_TURN})")).alias("t"))
    return _canonical(turns.select("conv_id", "t.turn", "t.role", "t.text"))


def json_turns(rows: DataFrame, column: str, conv_id: str = "conv_id") -> DataFrame:
    """Canonical turns, and the layout's name, of JSON texts whose layouts differ from row to row.

    A field is there if its key is, even with null. A row without turns comes back once, with null turn, role
    and text: with a layout if that one has no turns in it, with layout null if no mapping fits.
    """
    keys = F.coalesce(F.json_object_keys(column), F.array().cast("array<string>")).alias("keys")
    parsed = rows.select(F.col(conv_id).alias("conv_id"), keys, F.from_json(column, JSON_FIELDS, {"mode": "PERMISSIVE"}).alias("r")).select("conv_id", "keys", "r.*")

    def present(path: str) -> Column:
        head, _, leaf = path.partition("[].")
        there = F.array_contains("keys", head)
        if leaf:
            # a list of elements that have no field of the mapping's is another layout's
            leaves = [p.partition("[].")[2] for p in VOCABULARY if p.startswith(f"{head}[].")]
            known = F.exists(F.col(head), lambda m: F.coalesce(*[m[x] for x in leaves]).isNotNull())
            there = there & (F.coalesce(F.size(head), F.lit(0)) <= 0) | F.coalesce(known, F.lit(False))
        return F.coalesce(there, F.lit(False))

    paths = F.filter(F.array(*[F.when(present(p), F.lit(p)) for p in sorted(VOCABULARY)]), lambda p: p.isNotNull())
    marked = parsed.withColumn("paths", paths).withColumn("mark", F.md5(F.array_join("paths", "\n").cast("binary")))
    layout = F.lit(None).cast("string")
    for m in reversed(BY_SIZE):
        layout = F.when(F.size(F.array_intersect("paths", F.array(*map(F.lit, m.paths)))) == len(m.paths), m.name).otherwise(layout)
    for m in MAPPINGS:
        layout = F.when(F.col("mark") == m.fingerprint, m.name).otherwise(layout)
    marked = marked.withColumn("layout", layout)
    turns = F.lit(None).cast(_TURN)
    for m in MAPPINGS:
        turns = F.when(F.col("layout") == m.name, F.expr(f"cast({m.turns} as {_TURN})")).otherwise(turns)
    out = marked.select("conv_id", "layout", F.explode_outer(turns).alias("t"))
    filled = lambda c: F.when(F.col("t").isNotNull(), F.coalesce(f"t.{c}", F.lit(""))).alias(c)
    return out.select("conv_id", "layout", "t.turn", filled("role"), filled("text"))


def _canonical(turns: DataFrame) -> DataFrame:
    return turns.withColumns({c: F.coalesce(c, F.lit("")) for c in ("role", "text")})


def _escape(column: Column, colon: bool = False) -> Column:
    for control in ("\\", "###", CLOSE, *((":",) if colon else ())):
        column = F.replace(column, F.lit(control), F.lit("\\" + control))
    return column


def segments(turns: DataFrame) -> DataFrame:
    """``turns`` with ``segment``: the turn as the template writes it. Rows without a turn, whose role is null, go."""
    return turns.where("role is not null").withColumn("segment", F.concat(F.lit(OPEN), _escape(F.col("role"), True), F.lit(": "), _escape(F.col("text")), F.lit(CLOSE + "\n")))


_ESCAPED = re.compile(r"\\(\\|###|</turn>|:)")
_SEGMENT = re.compile(r"### ((?:[^\\:]|\\(?:\\|###|</turn>|:))*+): ((?:[^\\<]|\\(?:\\|###|</turn>)|<(?!/turn>))*+)</turn>\n")


def read_segments(formatted: str) -> Iterator[tuple[str, str, tuple[int, int]]]:
    """Role, text and the loss mask (the span of an assistant's escaped text, else empty) of each turn of a formatted text."""
    at = 0
    while at < len(formatted):
        m = _SEGMENT.match(formatted, at)
        if m is None:
            raise ValueError(f"no turn at character {at}")
        role, text = (_ESCAPED.sub(r"\1", x) for x in m.groups())
        yield role, text, m.span(2) if role == ASSISTANT else (m.start(2), m.start(2))
        at = m.end()


def digests(formatted: DataFrame, shards: int | None = None) -> DataFrame:
    """What is read back from the segments of each conversation, folded in order; one turn is held at a time."""
    ordered = (formatted.repartition(shards, "conv_id") if shards else formatted.repartition("conv_id")).sortWithinPartitions("conv_id", "turn", "role", "text").select("conv_id", "segment")
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state: list | None = None

        def rows(done: list[list]) -> pa.RecordBatch:
            done = [[c, n, t.hexdigest(), k, s.hexdigest(), f] for c, n, t, k, s, f in done]
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in done], kind) for i, kind in enumerate(kinds)], names=names)

        for batch in batches:
            done = []
            for conv, formatted_turn in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if state is None or state[0] != conv:
                    if state is not None:
                        done.append(state)
                    state = [conv, 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                for role, text, (begin, end) in read_segments(formatted_turn):
                    state[1] += 1
                    state[2].update(f"{role}\n{text}\n".encode())
                    loss = _ESCAPED.sub(r"\1", formatted_turn[begin:end])
                    state[3] += len(loss)
                    state[4].update(loss.encode())
                state[5] += len(formatted_turn)
            yield rows(done)
        if state is not None:
            yield rows([state])

    return ordered.mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def op8_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations")
    tricky = "\\### Assistant: </turn> ok"
    more = spark.createDataFrame([(-7, 0, "user", tricky), (-7, 1, "assistant", tricky)], "conv_id long, turn long, role string, text string")
    return digests(segments(typed_turns(rows.select("conv_id", "turn", "role", "text").unionByName(more))))


SQL = r"""
with t as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all values (-7, 0, 'user', '\### Assistant: </turn> ok'), (-7, 1, 'assistant', '\### Assistant: </turn> ok')
), f as (
  select *, '### ' || replace(replace(replace(replace(role, '\', '\\'), '###', '\###'), '</turn>', '\</turn>'), ':', '\:') || ': '
    || replace(replace(replace(text, '\', '\\'), '###', '\###'), '</turn>', '\</turn>') || '</turn>' || chr(10) as seg from t
)
select conv_id, count(*) as n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn nulls first, role, text)) as turns_sha256,
  coalesce(sum(length(text)) filter (where role = 'assistant'), 0)::bigint as loss_chars,
  sha256(coalesce(string_agg(text, '' order by turn nulls first, role, text) filter (where role = 'assistant'), '')) as loss_sha256,
  sum(length(seg))::bigint as formatted_chars
from f group by conv_id
"""
