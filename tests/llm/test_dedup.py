import hashlib
import re

import duckdb
import pytest
from pyspark.sql import functions as F

from statuta.llm import exact_dedup, line_dedup
from statuta.llm.queries import ORACLES, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_queries_match_sql(spark, name):
    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for t in ("documents", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    got = QUERIES[name](spark, sf)
    made = con.execute(ORACLES[name])
    columns = [c[0] for c in made.description]
    assert sorted(columns) == sorted(got.columns)
    assert sorted(tuple(r) for r in got.select(*columns).collect()) == sorted(made.fetchall())


def test_exact_cases(spark):
    rows = [(4, None), (9, ""), (9, ""), (None, "a  b"), (7, "a\tb"), (8, "a b"), (None, "alone"), (3, " "), (2, "x" * 500_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("body", F.lit(1)).withColumn("keep_id", F.lit("clash"))
    got = sorted(((r.doc_id, r.keep_id, r.group_size, r.kept) for r in exact_dedup.exact_dedup(docs).collect()), key=str)
    want = [(4, 4, 3, True), (9, 4, 3, False), (9, 4, 3, False), (None, 7, 3, False), (7, 7, 3, True), (8, 7, 3, False), (None, None, 1, True), (3, 3, 1, True), (2, 2, 1, True)]
    assert got == sorted(want, key=str)
    assert exact_dedup.exact_dedup(docs.limit(0)).count() == 0


def test_line_cases(spark):
    line = "This line is long enough to count for forty points"
    texts = {i: f"start {i}\n {line.upper() if i % 2 else line}\t\n{line}\nend" for i in range(1, 8)}
    texts |= {20: None, 21: "", 22: "\n\n", 23: "\n".join(f"{k} {line}" for k in range(40_000))}
    rows = [*texts.items(), (3, texts[3]), (None, f"{line}\nnull id")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("drops", F.lit("clash")).withColumn("line", F.lit(1))
    got = line_dedup.dedup_lines(docs).collect()
    assert len(got) == len(rows)
    for r in got:
        text = r.text or ""
        kept = text if r.doc_id in (7, 20, 21, 22, 23) else re.sub(rf"(?i)^ *{line}\t?\n", "", text, flags=re.M)
        assert r.kept_text == kept and r.n_lines == text.count("\n") + 1 and r.n_dropped == text.count("\n") - kept.count("\n"), r.doc_id
    assert line_dedup.dedup_lines(docs.limit(0)).count() == 0
    many = spark.createDataFrame([(i, "\n".join(f"{k} {line}" for k in range(500))) for i in range(6)], "doc_id long, text string")
    assert {r.doc_id: r.n_dropped for r in line_dedup.dedup_lines(many).collect()} == {**dict.fromkeys(range(5), 500), 5: 0}


def test_hot_line_spreads_over_slices(spark):
    line = "The same sentence stands at the top of every page here"
    docs = spark.createDataFrame([(i, f"{line}\nown {i}") for i in range(3000)], "doc_id long, text string")
    got = line_dedup.dedup_lines(docs).agg(F.sum("n_dropped"), F.max("n_dropped")).first()
    assert tuple(got) == (2999, 1)
    assert hashlib.sha256(b"").hexdigest()[:4] == "e3b0"
