from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from statuta.functions import text as tx
from statuta.operators import ngrams
from statuta.operators.synonyms import canonical, parse_synonyms


def one(spark, f, *values):
    schema = ", ".join(f"c{i} string" for i in range(len(values)))
    return spark.createDataFrame([values], schema).select(f(*[F.col(f"c{i}") for i in range(len(values))]).alias("x")).first().x


@pytest.mark.parametrize(
    ("f", "given_", "want"),
    [
        (tx.clean_text, "  A\r\n\tB!!  C? ", "a b c"),
        (tx.clean_text, "a ! b", "a  b"),
        (tx.clean_text, "???", ""),
        (tx.clean_text, "x  y", "x y"),
        (tx.normalize_term, "Chủ__đầu_tư ", "chủ đầu tư"),
        (tx.normalize_term, "", None),
        (tx.normalize_term, None, None),
        (tx.normalize_term, "_", ""),
        (tx.normalize_token, "đầu_tư ", "đầu tư"),
        (tx.move_tone_marks, "hòa bình, Ủy ban, thủy", "hoà bình, Uỷ ban, thuỷ"),
        (tx.char_to_hex, "ư", "\\u01b0"),
        (tx.hex_to_char, "\\u01b0", "ư"),
        (tx.collapse, " \n ", None),
        (tx.ner_label, "L-PER", "I-PER"),
        (tx.pos_name, "Np", "Proper noun (Danh từ riêng)"),
        (tx.pos_name, "Zz", "Zz"),
        (tx.is_numeric, "-1.5", True),
        (tx.is_numeric, "1,5", False),
        (tx.has_punctuation, "a-b", True),
        (tx.is_punctuation, "", True),
        (tx.is_alphabetic, "", True),
        (tx.is_closing, "”", True),
    ],
)
def test_functions(spark, f, given_, want):
    assert one(spark, f, given_) == want


def test_cutting(spark):
    assert one(spark, lambda c: tx.after_first(c, "."), "1.2 x") == "2 x"
    assert one(spark, lambda c: tx.before_first(c, "."), "1.2 x") == "1"
    assert one(spark, lambda c: tx.after_first(c, ")"), "none") == ""
    assert tuple(one(spark, lambda c: tx.first_match(c, "b+"), "abbc")) == ("a", "bb", "c")
    assert one(spark, lambda c: tx.with_suffix(c, ".docx"), "x.y.doc") == "x.y.docx"
    assert one(spark, lambda *c: tx.join_path(*c), "a", "", "b") == "a__b"
    assert one(spark, lambda a, b: tx.punctuation_label(a, b), "CH", "x") == "punct"
    names = [F.array(F.lit("nguyễn")), F.array(F.lit("thị"))]
    tag = lambda form: one(spark, lambda p, f: tx.proper_noun_tag(p, f, *names), "Np", form)
    assert [tag("Nguyễn_A"), tag("Lan_Thị"), tag("Lan")] == ["Np-1", "Np-1", "Np-0"]
    assert one(spark, lambda a, b: tx.word_line(a, b, F.lit(None), F.lit("O"), F.lit(None), F.lit("x")), "1", "w") == "1\tw\t_\tO\t_\tx"


def test_synonyms(spark):
    lines = spark.createDataFrame([(0, "A1#Sống, tồn_tại"), (1, "no hash"), (2, ""), (3, "B2#sống")], "line_no int, value string")
    table = parse_synonyms(lines)
    assert {r.term: r.key for r in table.collect()} == {"sống": "B2", "tồn tại": "A1"}
    rows = spark.createDataFrame([("sống",), ("khác",), (None,)], "w string")
    assert [r.w for r in canonical(rows, "w", table).collect()] == ["B2", "khác", None]


@settings(max_examples=20, deadline=None)
@given(st.lists(st.text(alphabet="aB_  đ\n", max_size=12), min_size=1, max_size=8))
def test_normalising_twice_changes_nothing(spark, words):
    df = spark.createDataFrame([(w,) for w in words], "w string")
    once = tx.normalize_term(F.col("w"))
    for r in df.select(once.alias("a"), tx.normalize_term(once).alias("b")).collect():
        assert r.b == (r.a or None)


def test_grams_are_counted_by_as_many_tasks_as_they_take(spark, monkeypatch):
    """One split with many texts: no task counts all of their grams."""
    monkeypatch.setattr(ngrams, "TASK_GRAMS", 100)
    said = [(i % 40, f"abc{i}cba") for i in range(200)] + [(41, None), (41, " "), (42, "ab")]
    rows = spark.createDataFrame(said, "k long, t string").coalesce(1)
    want = Counter((k, t.strip()[i : i + 3]) for k, t in said if t for i in range(len(t.strip()) - 2))
    made = ngrams.char_ngrams(rows, "t", 3, ["k"])
    assert {(r.k, r.gram): r.n for r in made.collect()} == want
    assert "REPARTITION_BY_NUM" in made._jdf.queryExecution().executedPlan().toString()
    words = ngrams.token_ngrams(spark.createDataFrame([(1, list("abab"), "x")] * 60, "k long, ws array<string>, other string").coalesce(1), "ws", 2, ["k"])
    assert {(r.gram, r.n, r.first_pos) for r in words.collect()} == {("a b ", 120, 0), ("b a ", 60, 1)}
