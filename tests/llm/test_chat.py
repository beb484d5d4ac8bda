import pytest
from pyspark.sql import functions as F

from statuta.llm import chat

NASTY = ["", "plain", "### user: x</turn>\n", "\\", "\\\\h\\l\\b", "####", "<</turn>\n", "a: b", "é日👍\n", "\\### Assistant: </turn> ok", "\n\n", None]


def formatted(spark, rows):
    turns = chat.canonical_turns(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    made = chat.format_chats(turns)
    return {r.conv_id: r for r in made.select("*", chat.read_turns(F.col("formatted")).alias("turns"), chat.masked_text("formatted", "mask").alias("learned")).collect()}


def test_round_trip(spark):
    rows = [(1, i, ["user", "assistant", "a:b", "<#\\", None][i % 5], t) for i, t in enumerate(NASTY * 2)]
    got = formatted(spark, rows)[1]
    assert [(t.role, t.text) for t in got.turns] == [(r or "", t or "") for _, _, r, t in rows]
    assert got.learned == "".join(t or "" for _, _, r, t in rows if r == "assistant")
    assert got.formatted.count("</turn>\n") == len(rows)
    for m, text in zip(got.mask, [t or "" for _, _, r, t in rows if r == "assistant"], strict=True):
        assert len(got.formatted[m.start : m.start + m.length]) >= len(text)


def test_ties_nulls_and_repeats(spark):
    got = formatted(spark, [(None, 0, "user", "x"), (2, 1, "user", "b"), (2, 1, "user", "a"), (2, 1, "user", "a"), (2, 0, "system", None)])
    assert [(t.role, t.text) for t in got[2].turns] == [("system", ""), ("user", "a"), ("user", "a"), ("user", "b")]
    assert got[None].learned == "" and got[None].mask == []
    assert formatted(spark, []) == {}


def test_layouts_meet_in_the_same_turns(spark):
    want = [("user", "q"), ("assistant", "a")]
    makers = {
        "prompt_response": "SELECT 1 AS conv_id, 'q' AS prompt, 'a' AS response, 'x' AS extra",
        "prompt_completion": "SELECT 1 AS conv_id, 'a' AS completion, 'q' AS prompt",
        "question_answer": "SELECT 1 AS conv_id, 'q' AS question, 'a' AS answer",
        "instruction_output": "SELECT 1 AS conv_id, 'q' AS instruction, 'a' AS output",
        "instruction_input_output": "SELECT 1 AS conv_id, 'q' AS instruction, '' AS input, 'a' AS output",
        "messages": "SELECT 1 AS conv_id, array(named_struct('role', 'user', 'content', 'q'), named_struct('role', 'assistant', 'content', 'a')) AS messages, 2 AS head",
        "conversations": "SELECT 1 AS conv_id, array(named_struct('from', 'human', 'value', 'q'), named_struct('from', 'gpt', 'value', 'a')) AS conversations",
        "turn_rows_content": "SELECT * FROM VALUES (1, 0, 'user', 'q'), (1, 1, 'assistant', 'a') AS t(conv_id, turn, role, content)",
        "turn_rows_from": "SELECT * FROM VALUES (1, 0, 'human', 'q'), (1, 1, 'gpt', 'a') AS t(conv_id, turn, `from`, value)",
    }
    for name, sql in makers.items():
        records = spark.sql(sql)
        assert chat.layouts_of(records.schema)[0] == name
        assert [(r.role, r.text) for r in chat.canonical_turns(records).orderBy("turn").collect()] == want, name
    with pytest.raises(ValueError):
        chat.layouts_of(spark.sql("SELECT 1 AS body").schema)


def test_other_columns_do_not_change_the_layout(spark):
    rows = spark.sql("SELECT * FROM VALUES (1, 0, 'user', 'q'), (1, 1, 'assistant', 'a') AS t(conv_id, turn, role, text)")
    want = [("user", "q"), ("assistant", "a")]
    for more in ("'p' AS prompt", "'c' AS content", "'i' AS instruction, 'o' AS output, NULL AS input", "'r' AS row, 1 AS layout, 2 AS base, 3 AS turns, 4 AS pos, 5 AS one"):
        made = chat.canonical_turns(rows.selectExpr("*", *more.split(", ")))
        if "output" not in more:
            assert [(r.role, r.text) for r in made.orderBy("turn").collect()] == want, more
        assert made.columns == ["conv_id", "turn", "role", "text"]
    asked = spark.sql("SELECT 1 AS conv_id, 'q' AS instruction, 'a' AS output, 'p' AS prompt")
    assert [(r.role, r.text) for r in chat.canonical_turns(asked).orderBy("turn").collect()] == want


def test_records_of_many_layouts_in_one_table(spark):
    records = spark.createDataFrame(
        [(1, "q", "a", None, None, None, None), (2, None, None, "q", "a", "in", None), (3, None, None, "q", "a", None, None), (4, None, None, None, None, None, [("user", "q"), ("assistant", "a")]), (5, "q", None, None, None, None, None), (6, None, None, None, None, None, None)],
        "conv_id long, prompt string, response string, instruction string, output string, input string, messages array<struct<role: string, content: string>>",
    )
    got = {}
    for r in chat.canonical_turns(records).orderBy("conv_id", "turn").collect():
        got.setdefault(r.conv_id, []).append((r.role, r.text))
    plain = [("user", "q"), ("assistant", "a")]
    assert {k: got[k] for k in range(1, 6)} == {1: plain, 2: [("user", "q\n\nin"), plain[1]], 3: plain, 4: plain, 5: [("user", "q"), ("assistant", "")]}


def test_fingerprints_agree_with_spark(spark):
    for own, _ in chat.LAYOUTS.values():
        assert spark.sql("SELECT xxhash64('" + "\\n".join(sorted(own)) + "') AS h").first().h == chat.fingerprint(own)


def test_long_text(spark):
    long = "# <a> \\ " * 100_000
    got = formatted(spark, [(1, 0, "user", long), (1, 1, "assistant", long)])[1]
    assert [t.text for t in got.turns] == [long, long] and got.learned == long
