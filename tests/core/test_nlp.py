import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from statuta.operators import annotate, ngrams, segmenter, tokenizer, triplets
from statuta.operators.segmenter import Lexicon, parse_rules, segment, segment_text
from statuta.operators.tokenizer import join_tokens, sentences, split_sentences, tokenize, tokens


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("93% 9-10 anh-yeu-em", ["93%", "9-10", "anh-yeu-em"]),
        ("tốt,", ["tốt", ","]),
        ("A.", ["A."]),
        ("nhà.", ["nhà", "."]),
        ("Tp.", ["Tp."]),
        ("(Tp.HCM)", ["(", "Tp.", "HCM", ")"]),
        ("hết...", ["hết", "..."]),
        ("a@b.vn,", ["a@b.vn", ","]),
        ("12/2015", ["12/2015"]),
        ("ngày12/2015", ["ngày", "12/2015"]),
        ("$5.000", ["$5.000"]),
        ("km/h", ["km/h"]),
        ('"nhà"', ['"', "nhà", '"']),
        ("", []),
        (None, []),
        (" \n ", []),
    ],
)
def test_tokenize(text, want):
    assert tokenize(text) == want


@pytest.mark.parametrize(("text", "n"), [("Tôi đi . Bạn ở .", 2), ("tôi đi . bạn ở .", 1), ("1 . Mở đầu .", 1), ('Ông nói : " Đi ! " Rồi về .', 1), ("", 0), ("Hết", 1)])
def test_split_sentences(text, n):
    assert len(split_sentences(tokenize(text))) == n


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="aĐ .,:!?19-/()\"'@$\n", max_size=40))
def test_no_character_is_lost(text):
    made = tokenize(text)
    assert "".join(made) == "".join(text.split())
    assert [t for s in split_sentences(made) for t in s] == made


def test_columns(spark):
    df = spark.createDataFrame([("Tôi đi. Bạn ở.",), (None,)], "t string").select(tokens(F.col("t")).alias("a"), sentences(F.col("t")).alias("b"))
    first, second = df.collect()
    assert first.a == ["Tôi", "đi", ".", "Bạn", "ở", "."] and first.b == ["Tôi đi .", "Bạn ở ."]
    assert second.a == [] and second.b == []


RULES = ["True : object.conclusion = \"NN\"", '\tobject.tag == "I" : object.conclusion = "I"', '\t\tobject.prevWord1 == "quận" : object.conclusion = "B"', '\t\t\tobject.prevWord1 == "quận" and object.word == "huyện" : object.conclusion = "I"', '\tobject.tag == "B" : object.conclusion = "B"', '\t\tobject.nextWord1 == "" and object.prevTag1 == "" : object.conclusion = "I"']


def test_segmentation():
    lexicon = Lexicon(words=frozenset({"làm việc", "quận đội", "quận huyện", "đại học quốc gia"}), family_names=frozenset({"nguyễn"}), middle_names=frozenset({"khắc"}))
    rules = parse_rules(RULES)
    assert segment("Ông đang làm việc tại đại học quốc gia .", lexicon, []) == "Ông đang làm_việc tại đại_học_quốc_gia ."
    assert segment("Ông Nguyễn Khắc Chúc", lexicon, []) == "Ông_Nguyễn_Khắc_Chúc"
    assert segment("ở quận đội , quận huyện", lexicon, rules) == "ở quận đội , quận_huyện"
    assert segment(" ", lexicon, rules) == "\n"
    assert segment_text("Tôi làm việc. Bạn ở.", lexicon, rules) == ["Tôi làm_việc .", "Bạn ở ."]
    assert segment("nhà Hòa", lexicon, rules) == "nhà Hoà"


def tokens_of(text):
    out = []
    for i, x in enumerate(text.split(" · "), 1):
        word, pos, label = x.rsplit("/", 2)
        out.append({"id": i, "word": word, "pos": pos, "head": 0, "deprel": label})
    return out


CASES = [
    ("chủ_đầu_tư/N/sub · bảo_trì/V/root · đoạn/N/dob · và/C/coord · cầu/N/conj · ./CH/punct", [("chủ_đầu_tư", "bảo_trì", "đoạn"), ("chủ_đầu_tư", "bảo_trì", "cầu")]),
    ("a/N/sub · b/V/root · c/N/dob · d/V/vmod · e/N/dob", [("a", "b", "c"), ("c", "d", "e")]),
    ("b/V/root · c/N/dob", None),
    ("a/N/sub · b/V/root · c/N/dob · ,/CH/punct · e/N/conj", [("a", "b", "c e")]),
    ("a/N/sub · b/V/root · c/N/dob · ,/X/punct · e/N/conj", [("a", "b", "c"), ("a", "b", "e")]),
    ("a/N/sub · b/V/root · và/C/coord · c/V/conj · d/N/dob", [("a", "b", "d"), ("a", "c", "d")]),
    ("a/N/sub · b/V/root · c/N/dob · và/C/coord · các/L/det · d/N/conj", [("a", "b", "c"), ("a", "b", "d")]),
    ("xe/N/sub · chở/V/nmod · khách/N/dob · dừng/V/root · bến/N/dob", [("xe", "chở", "khách"), ("khách", "dừng", "bến")]),
    ("xe/N/sub · chở/V/nmod · nặng/A/amod · dừng/V/root · bến/N/dob", [("xe chở nặng", "dừng", "bến")]),
    ("a/N/sub · b/V/root · c/N/dob · và/C/coord · d/V/conj · e/N/dob", [("a", "b", "c"), ("c", "d", "e")]),
    ("a/N/sub · b/V/root", []),
]


@pytest.mark.parametrize(("text", "want"), CASES)
def test_triplet_rules(text, want):
    assert triplets.by_dependency(tokens_of(text)) == want


def test_variants():
    assert triplets.by_dependency([]) == []
    assert triplets.without_semicolon(tokens_of("a/N/sub · b/V/root · hai/M/num · c/N/dob · ;/X/punct · d/N/conj")) == [("a", "b", "hai c ; d")]
    assert triplets.by_pos(tokens_of("a/N/x · b/V/x · c/N/x · r/R/x · d/V/x · e/A/x")) == [("a", "b", "c"), ("c", "d", "e")]


def test_more_variants():
    modifier = tokens_of("xe/N/sub · chở/V/nmod · khách/N/dob · dừng/V/root · bến/N/dob")
    assert triplets.flat(modifier) == [("xe chở khách", "dừng", "bến")]
    assert triplets.flat(tokens_of("a/N/sub · b/V/root · c/N/dob · d/V/vmod · e/N/dob")) == [("a", "b", "c d e")]
    owned = tokens_of("a/N/sub · ở/E/loc · b/V/root · d/V/vmod · c/N/dob")
    owned[0]["head"] = 3
    assert triplets.owned_root(owned) == [("a", "b d", "c")]
    assert triplets.owned_root(tokens_of("a/N/x · b/V/root · c/N/dob")) == []
    text = "các/L/x · cơ_quan/N/x · được/V/x · cấp/V/x · giấy_phép/N/x · ./CH/x · họ/P/x · có/V/x · trách_nhiệm/N/x · phối_hợp/V/x · giải_quyết/V/x · vụ_việc/N/x"
    assert triplets.noun_phrases(tokens_of(text)) == [
        ("các cơ quan", "được cấp", "giấy phép"),
        ("giấy phép", "có", "trách nhiệm phối hợp giải quyết"),
        ("trách nhiệm phối hợp giải quyết", "giải quyết", "vụ việc"),
    ]
    assert triplets.noun_phrases(tokens_of("a/N/x · ví/V/x · sau/N/x")) == []
    for rule in triplets.VARIANTS.values():
        assert rule([]) == []


def test_triplets_in_spark(spark):
    rows = [(i, tokens_of(t)) for i, (t, _) in enumerate(CASES)] + [(99, None)]
    df = spark.createDataFrame(rows, f"i int, t array<struct<{triplets.TOKEN.replace(' ', ': ')}>>".replace(",: ", ", "))
    got = {r.i: r.x if r.x is None else [tuple(y) for y in r.x] for r in df.repartition(3).select("i", triplets.extract(F.col("t")).alias("x")).collect()}
    assert got == {**{i: w for i, (_, w) in enumerate(CASES)}, 99: None}


def test_token_array(spark):
    df = spark.createDataFrame([(["a", "b"], ["N", "V"], [2, 0], ["sub", "root"])], "w array<string>, p array<string>, h array<int>, l array<string>")
    got = df.select(triplets.token_array(*[F.col(c) for c in "wphl"]).alias("x")).first().x
    assert [tuple(x) for x in got] == [(1, "a", "N", 2, "sub"), (2, "b", "V", 0, "root")]


def test_ngrams(spark):
    df = spark.createDataFrame([(1, " abab ", ["x", "y", "x", "y"]), (2, "a", ["x"]), (3, "", []), (4, None, None)], "i int, t string, w array<string>")
    assert sorted(tuple(r) for r in ngrams.char_ngrams(df, "t", 2, ["i"]).collect()) == [(1, "ab", 2, 0), (1, "ba", 1, 1)]
    assert sorted(tuple(r) for r in ngrams.token_ngrams(df, "w", 2, ["i"]).collect()) == [(1, "x y ", 2, 0), (1, "y x ", 1, 1)]
    assert {tuple(r) for r in ngrams.word_counts(df, "w", []).collect()} == {("x", 3), ("y", 2)}


def test_injected_models(spark):
    df = spark.createDataFrame([("a b c",), (None,)], "t string")
    got = df.select(annotate.annotated(F.col("t"), annotate.stub_annotator).alias("a"), annotate.encoded(F.col("t"), annotate.stub_encoder).alias("e"), annotate.language(F.col("t"), lambda: lambda x: 1 / 0).alias("l")).collect()
    assert [x.deprel for x in got[0].a] == ["sub", "root", "dob"] and got[1].a is None
    assert abs(sum(x * x for x in got[0].e) - 1) < 1e-5
    assert got[0].l == got[1].l == "N/A"
    done = annotate.rewritten(df.where("t IS NOT NULL").withColumn("n", F.lit("1")), "n", "t", "s", annotate.stub_chat).first()
    assert done.lines == ["a b c"]


def test_joining():
    assert join_tokens(["a", "", " ", "b"]) == "a b"


def test_workers_get_texts_in_small_batches_and_keep_short_runs_only(spark):
    """What a worker holds is bounded by rows of a batch, and by number and length of the runs that it keeps."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    try:
        spark.conf.set(name, 10_000)
        tokenizer.sentences(F.col("text"))
        assert int(spark.conf.get(name)) == 1024
    finally:
        spark.conf.set(name, before)
    held = tokenizer._tokens_of.cache_info().currsize
    long = "x1-" * 5000
    assert tokenizer.tokenize(long) == list(tokenizer._cut(long)) and tokenizer._tokens_of.cache_info().currsize == held
    assert all(not m.isdisjoint(w) for kind, m in tokenizer._MARKS.items() for w in tokenizer._KEPT[kind])


def test_phrases_and_rules_that_begin_nowhere_change_nothing():
    """First syllables and first conditions only spare work: any phrase of the lists is still joined, any rule still tried."""
    lexicon = segmenter.Lexicon(words=frozenset(["of the", "a b c d", "b c"]))
    assert segmenter.segment("x of the a B c d b c of", lexicon, []) == "x of_the a B c d b_c of"
    rules = segmenter.parse_rules(["True", '\tobject.nextWord2 == "<W>" : object.conclusion = "I"', '\t\tobject.word == "q" : object.conclusion = "B"'])
    assert segmenter.segment("x y q", lexicon, rules) == "x_y q"
