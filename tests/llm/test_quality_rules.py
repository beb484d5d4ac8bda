import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from statuta.llm import quality_rules as qr
from statuta.llm.queries import QUERIES

SF = "/root/testdata/sf0.01"


def brute(text):
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    under = {i + k for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for k in range(3)}
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(under)


def failed(n_words, _chars, _symbols, _lines, repeats):
    return n_words < 50 or 100 * repeats > 50 * n_words


ODD = [None, "", " ", "\n\n", "a", "a b", "a b c", "a b c a b c", "x x x x x", "a b c d a b c e", " lead\ttab\x0bvt\x0cff\r\ncrlf \n", "é b c\u0085d", "l\nl\n l\nl", "# | <b> 100% & $5 *", "A\0B \0", "日本 語 日本 語 日本 語", "😀 " * 60, "w " * 30_000]


def test_statistics_equal_brute_force(spark):
    rng = random.Random(2)
    texts = ODD + [rng.choice([" ", "\n"]).join(rng.choices("ab cd e f\n g".split(" "), k=rng.randint(0, 90))) for _ in range(200)]
    texts += [r.text for r in spark.read.parquet(f"{SF}/documents.parquet").select("text").limit(300).collect()]
    docs = spark.createDataFrame([(i, t, [1], 2) for i, t in enumerate(texts)], "doc_id long, text string, words array<int>, sorted int")
    got = {r.doc_id: (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in qr.statistics(docs).collect()}
    assert got == {i: brute(t) for i, t in enumerate(texts)}


def test_query_keeps_good_documents_and_finds_the_bad(spark):
    told = {r.doc_id: r for r in QUERIES["op12_quality_rules"](spark, SF).collect()}
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    assert set(told) == set(docs)
    for i, text in docs.items():
        r = told[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == brute(text)
        assert r.base_failed == failed(*brute(text))
        assert r.kept == (not r.base_failed and r.rule == 0)
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    judged = [(labels[i], told[i].kept) for i in labels if not told[i].base_failed]
    good, bad = [k for q, k in judged if q == 1], [k for q, k in judged if q == 0]
    assert sum(good) >= 0.98 * len(good) and sum(bad) <= 0.15 * len(bad)


def test_rules_on_labels_that_were_not_learned_from(spark):
    """Learned from the labels of four fifths of the ids, judged on the others."""
    docs, labels = spark.read.parquet("/root/testdata/sf0.1/documents.parquet"), spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    told = qr.judge(docs, labels.where(F.crc32(F.col("doc_id").cast("string")) % 5 != 0))
    seen = told.join(labels.where(F.crc32(F.col("doc_id").cast("string")) % 5 == 0), "doc_id").where("NOT base_failed").groupBy("quality", "kept").count().collect()
    n = {(r["quality"], r["kept"]): r["count"] for r in seen}
    assert n.get((1, True), 0) >= 0.98 * (n.get((1, True), 0) + n.get((1, False), 0))
    assert n.get((0, False), 0) >= 0.85 * (n.get((0, True), 0) + n.get((0, False), 0))


def _stats(spark, rows):
    names = [*qr._COUNTS, *qr._MORE]
    return spark.createDataFrame([(i, *[r.get(n, 100) for n in names], bad) for i, (r, bad) in enumerate(rows)], "doc_id long, " + ", ".join(f"{n} long" for n in names) + ", bad int")


def test_learns_conjunctions_in_order(spark):
    """Bad are texts of many symbols that are long, and texts of few different words; noise in one label of a hundred."""
    rng = random.Random(5)
    rows = []
    for _ in range(3000):
        r = {"n_words": rng.randint(50, 950), "n_symbols": rng.randint(0, 300), "n_distinct_words": rng.randint(10, 50)}
        bad = int((r["n_symbols"] >= 0.5 * r["n_words"] and r["n_words"] >= 200) or r["n_distinct_words"] < 0.05 * r["n_words"])
        rows.append((r, bad if rng.random() > 0.01 else 1 - bad))
    stats = _stats(spark, rows)
    rules = qr.learn(stats)
    assert 2 <= len(rules) <= qr.RULES and any(len(r) > 1 for r in rules)
    n = {(r["bad"], r["hit"]): r["count"] for r in stats.select("bad", (qr.verdict(rules) > 0).alias("hit")).groupBy("bad", "hit").count().collect()}
    assert n[(1, True)] >= 0.85 * (n[(1, True)] + n[(1, False)]) and n[(0, True)] <= 0.04 * n[(0, False)]
    assert qr.learn(stats) == rules  # no chance in it
    places = stats.select(qr.verdict(rules).alias("at"), *[qr.verdict([r]).alias(f"r{k}") for k, r in enumerate(rules)]).collect()
    assert all(p["at"] == next((k + 1 for k in range(len(rules)) if p[f"r{k}"]), 0) for p in places)


@pytest.mark.parametrize("bad", [0, 1])
def test_one_label_only_gives_no_rule(spark, bad):
    assert qr.learn(_stats(spark, [({"n_words": k}, bad) for k in range(60)])) == []


def test_odd_tables(spark):
    docs = spark.createDataFrame([(None, "a b"), (1, None), (1, "w " * 80), (2, ""), (2, " ".join(map(str, range(60))))], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 0), (1, 1), (None, 1), (2, None)], "doc_id long, quality int")
    told = qr.judge(docs, labels)
    assert sorted((str(r.doc_id), r.n_words, r.base_failed, r.kept, r.rule) for r in told.collect()) == [("1", 0, True, False, 0), ("1", 80, True, False, 0), ("2", 0, True, False, 0), ("2", 60, False, True, 0), ("None", 2, True, False, 0)]
    assert qr.judge(docs.where("false"), labels).count() == 0
    assert qr.judge(docs, labels.where("false")).count() == 5
