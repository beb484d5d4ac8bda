"""Chat formatting: records of any known layout become canonical turns, then one marked text with a loss mask."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from statuta.llm.common import packed

OPEN, CLOSE = "### ", "</turn>\n"
TURNS = "array<struct<role: string, text: string>>"


def _turn(role: Column, text: Column) -> Column:
    return F.struct(role.cast("string").alias("role"), text.cast("string").alias("text"))


def _role(c: Column) -> Column:
    return F.when(c == "human", "user").when(c == "gpt", "assistant").otherwise(c)


def _pair(question: str, answer: str):
    return (question, answer), lambda r: F.array(_turn(F.lit("user"), r[question]), _turn(F.lit("assistant"), r[answer]))


def _row(role: str, text: str, named: Callable = lambda c: c):
    return (role, text), lambda r: F.array(_turn(named(r[role]), r[text]))


def _list(field: str, role: str, text: str, named: Callable = lambda c: c):
    return (f"{field}[].{role}", f"{field}[].{text}"), lambda r: F.transform(r[field], lambda m: _turn(named(m[role]), m[text]))


def _with_input(r: Column) -> Column:
    more = F.coalesce(r["input"], F.lit(""))
    asked = F.when(more == "", r["instruction"]).otherwise(F.concat(F.coalesce(r["instruction"], F.lit("")), F.lit("\n\n"), more))
    return F.array(_turn(F.lit("user"), asked), _turn(F.lit("assistant"), r["output"]))


#: Declarative mappings by layout: the nested field paths that make it, and its array of turns (role, text) read from a record.
#: Turn rows are one turn each; the others hold a whole conversation.
LAYOUTS = {
    "turn_rows": _row("role", "text"),
    "turn_rows_content": _row("role", "content"),
    "turn_rows_from": _row("from", "value", _role),
    "prompt_response": _pair("prompt", "response"),
    "prompt_completion": _pair("prompt", "completion"),
    "question_answer": _pair("question", "answer"),
    "instruction_output": _pair("instruction", "output"),
    "instruction_input_output": (("instruction", "input", "output"), _with_input),
    "messages": _list("messages", "role", "content"),
    "conversations": _list("conversations", "from", "value", _role),
}
#: Field paths that count for a fingerprint; all others (ids, sources, extra columns) don't.
KNOWN = {p for paths, _ in LAYOUTS.values() for p in paths}


def paths(kind: T.DataType, at: str = "") -> list[str]:
    """The nested field paths of a type: a.b for fields, a[] for elements."""
    if isinstance(kind, T.StructType):
        return [p for f in kind.fields for p in paths(f.dataType, f"{at}.{f.name}" if at else f.name)]
    if isinstance(kind, T.ArrayType):
        return paths(kind.elementType, f"{at}[]")
    return [at]


def fingerprint(found) -> int:
    """XXH64 of the known ones of some field paths, whatever their order, as Spark's xxhash64 has it of the same text."""
    return int(np.uint64(xxhash.xxh64_intdigest("\n".join(sorted(KNOWN.intersection(found))), 42)).astype(np.int64))


_BY_FINGERPRINT = {fingerprint(own): name for name, (own, _) in LAYOUTS.items()}


def layouts_of(schema: T.StructType) -> list[str]:
    """The layouts that records of a schema may have: the one that its fingerprint names, or else those whose paths are all there, most paths first."""
    have = set(paths(schema))
    exact = _BY_FINGERPRINT.get(fingerprint(have))
    able = [exact] if exact else sorted((n for n, (own, _) in LAYOUTS.items() if have.issuperset(own)), key=lambda n: -len(LAYOUTS[n][0]))
    if not able:
        raise ValueError(f"no layout has its field paths among {sorted(have)}")
    return able


def record_layout(record: Column, able: list[str]) -> Column:
    """The layout of a record, among those that its schema allows.

    The paths at which it has values are hashed, and a known fingerprint selects
    its layout. Otherwise (null fields, fields of several layouts) the first
    layout counts whose paths all have values, then the first that has some,
    then the first.
    """
    has = {p: record[p.split("[]")[0]].isNotNull() for n in able for p in LAYOUTS[n][0]}
    told = F.array_join(F.array_compact(F.array(*[F.when(has[p], F.lit(p)) for p in sorted(has)])), "\n")
    hit = F.xxhash64(told)
    tests = [(hit == fingerprint(LAYOUTS[n][0]), n) for n in able]
    tests += [(F.forall(F.array(*[has[p] for p in LAYOUTS[n][0]]), lambda x: x), n) for n in able]
    tests += [(F.exists(F.array(*[has[p] for p in LAYOUTS[n][0]]), lambda x: x), n) for n in able]
    return F.coalesce(*[F.when(test, n) for test, n in tests], F.lit(able[0]))


def canonical_turns(records: DataFrame, id_col: str = "conv_id", turn_col: str | None = "turn") -> DataFrame:
    """conv_id, turn, role, text: the records' turns by the mapping that the fingerprint of their field paths selects.

    The schema's fingerprint decides if it is that of a layout, whatever other
    columns there are. Otherwise a table may mix layouts, and each record is
    judged by the paths at which it has values. Null texts become empty; texts
    of any length are taken whole. turn_col orders rows that are one turn each;
    other layouts number their turns from 0. Null message arrays yield no turn,
    nor does an empty table. Rows that repeat a turn are all kept.
    """
    able = layouts_of(records.schema)
    rows = turn_col is not None and turn_col in records.columns
    base, row = records.select(packed(records).alias("row")), F.col("row")
    turns = LAYOUTS[able[0]][1](row).cast(TURNS)
    if len(able) > 1:
        base = base.withColumn("layout", record_layout(row, able))
        for name in able[1:]:
            turns = F.when(F.col("layout") == name, LAYOUTS[name][1](row).cast(TURNS)).otherwise(turns)
    made = base.select(row.getField(id_col).alias("conv_id"), (row.getField(turn_col) if rows else F.lit(0)).cast("long").alias("base"), turns.alias("turns"))
    opened = made.select("conv_id", "base", F.posexplode("turns").alias("pos", "one"))
    return opened.select("conv_id", (F.coalesce("base", F.lit(0)) + F.col("pos")).alias("turn"), F.col("one.role").alias("role"), F.coalesce("one.text", F.lit("")).alias("text"))


def escape(c: Column) -> Column:
    """No character of a control string stays: backslash, # and < become backslash and a letter."""
    for plain, coded in (("\\", "\\b"), ("#", "\\h"), ("<", "\\l")):
        c = F.replace(c, F.lit(plain), F.lit(coded))
    return c


def unescape(c: Column) -> Column:
    """In an escaped text each backslash begins a code, so codes can be put back one kind after another, backslashes last."""
    for coded, plain in (("\\l", "<"), ("\\h", "#"), ("\\b", "\\")):
        c = F.replace(c, F.lit(coded), F.lit(plain))
    return c


def format_chats(turns: DataFrame, learn: str = "assistant") -> DataFrame:
    """conv_id, formatted, mask: each conversation as one text, and the spans (start, length in code points) to learn from.

    A turn is `### role: text</turn>` and a line feed, role and text escaped.
    The spans are the texts of the given role, without marks. Turns are ordered
    by number, then role and text. A null role is written as empty. Turns of a
    null conv_id make one conversation. Texts of any length are written whole;
    turns that repeat are written each; an empty table gives no row. Columns
    other than conv_id, turn, role and text are ignored.
    """
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    pieces = turns.select("conv_id", "turn", role.alias("role"), text.alias("text"), F.concat(F.lit(OPEN), F.replace(escape(role), F.lit(":"), F.lit("\\c")), F.lit(": ")).alias("head"), escape(text).alias("body"))
    before = Window.partitionBy("conv_id").orderBy("turn", "role", "text").rowsBetween(Window.unboundedPreceding, -1)
    size = (F.length("head") + F.length("body") + len(CLOSE)).cast("long")
    placed = pieces.select("conv_id", "role", "head", "body", F.coalesce(F.sum(size).over(before), F.lit(0)).alias("start"))
    whole = placed.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("start", "role", "head", "body"))).alias("parts"))
    mask = F.transform(F.filter("parts", lambda p: p["role"] == learn), lambda p: F.struct((p["start"] + F.length(p["head"])).alias("start"), F.length(p["body"]).cast("long").alias("length")))
    return whole.select("conv_id", F.array_join(F.transform("parts", lambda p: F.concat(p["head"], p["body"], F.lit(CLOSE))), "").alias("formatted"), mask.alias("mask"))


def read_turns(formatted: Column) -> Column:
    """The array of turns (role, text) that a formatted text holds."""
    chunks = F.filter(F.split(formatted, CLOSE), lambda x: x != "")

    def one(x: Column) -> Column:
        cut = F.instr(x, ": ")
        role = F.replace(F.substring(x, F.lit(len(OPEN) + 1), cut - len(OPEN) - 1), F.lit("\\c"), F.lit(":"))
        return F.struct(unescape(role).alias("role"), unescape(F.substring(x, cut + 2, F.length(x))).alias("text"))

    return F.transform(chunks, one)


def masked_text(formatted: str, mask: str) -> Column:
    """All text under the mask, unescaped."""
    return unescape(F.expr(f"array_join(transform({mask}, m -> substring({formatted}, cast(m.start + 1 AS INT), cast(m.length AS INT))), '')"))


ORACLE = r"""
WITH c AS (
  SELECT conv_id, turn, role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'
), e AS (
  SELECT *, length(text) + length(text) - length(replace(replace(replace(text, '\', ''), '#', ''), '<', '')) AS coded FROM c
)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       sum(4 + length(role) + 2 + coded + 8)::BIGINT AS formatted_chars
FROM e GROUP BY conv_id
"""
