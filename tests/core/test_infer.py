import hashlib
import os
import random
import uuid

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from statuta.operators import annotate
from statuta.operators.infer import create_answers, infer_once
from statuta.plans.build_graph import Settings, extracted, extracted_once
from statuta.sources import files


def counted(folder, bad=()):
    """A model that notes each call in a file of its own."""
    os.makedirs(folder, exist_ok=True)

    def one(sentence):
        open(f"{folder}/{hashlib.md5(sentence.encode()).hexdigest()}.{uuid.uuid4().hex}", "w").close()
        if sentence in bad:
            raise ValueError(sentence)
        return sentence.upper()

    return lambda: one


def calls(folder):
    return sorted(x.split(".")[0] for x in os.listdir(folder))


@pytest.mark.parametrize("most", [1000, 2])
def test_each_sentence_reaches_the_model_once(spark, tmp_path, most):
    said = ["hot"] * 50 + ["a", "b", "b", "", None, None, "bad", "bad", "é" * 5000]
    rows = spark.createDataFrame([(i, s, "x") for i, s in enumerate(said)], "key long, sentence string, `row.slice` string")
    store = create_answers(spark, str(tmp_path / "store"), T.StringType(), 8)
    run = lambda folder, bad, model="v1": sorted(map(tuple, infer_once(rows, F.col("sentence"), store, counted(str(tmp_path / folder), bad), model, most=most, hot=7).collect()))
    want = lambda bad: [(i, s, "x", None if s is None or s in bad else s.upper(), f"ValueError: {s}" if s in bad else None) for i, s in enumerate(said)]
    assert run("one", ("bad",)) == want(("bad",))
    assert calls(tmp_path / "one") == sorted(hashlib.md5(s.encode()).hexdigest() for s in {s for s in said if s is not None})
    assert run("two", ("hot",)) == want(())  # only what failed is asked again, so that hot keeps its answer
    assert calls(tmp_path / "two") == [hashlib.md5(b"bad").hexdigest()]
    assert run("three", ()) == want(()) and calls(tmp_path / "three") == []
    assert len(run("four", (), "v2")) == len(said) and len(calls(tmp_path / "four")) == 6


def test_empty_rows_and_clashing_names(spark, tmp_path):
    rows = spark.createDataFrame([], "s string, Answer string")
    store = create_answers(spark, str(tmp_path / "store"), T.StringType(), 8)
    model = counted(str(tmp_path / "calls"))
    with pytest.raises(ValueError, match="answer"):
        infer_once(rows, F.col("s"), store, model, "m")
    assert infer_once(rows, F.col("s"), store, model, "m", "said", "why").collect() == []


def test_triplets_by_way_of_the_store(spark, tmp_path):
    texts = ["a b c d. Cơ quan cấp phép", "a b c d. Sau đó thu", None, "  ", "cơ quan cấp phép"]
    laws = spark.createDataFrame([(str(i), "n", t) for i, t in enumerate(texts)], "id string, so_hieu string, content string")
    store = create_answers(spark, str(tmp_path / "store"), annotate.TOKENS, 8)
    settings = Settings(sentence_scope="all")
    for _ in range(2):
        got = extracted_once(laws, settings, store, "stub")
        want = extracted(laws, settings)
        assert got.columns == want.columns
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) != []


def test_a_file_of_many_splits_is_read_as_one_of_few(spark, tmp_path):
    rng = random.Random(5)
    for name, end in (("a.txt", "\n"), ("b.txt", "\r\n")):
        out = [""] if name == "b.txt" else []
        for s in range(60):
            out += [f"{i}\tw{s}é{i}\tN\t_\t0\troot" for i in range(1, rng.randrange(2, 9))]
            out += rng.choice([[""], ["", "  "], ["", "", ""]])
        (tmp_path / name).write_bytes(end.join(out).encode())
    (tmp_path / "c.txt").write_bytes(b"")

    def read():
        rows = annotate.read_annotations(spark, str(tmp_path))
        lines = files.numbered_lines(spark, str(tmp_path))
        return sorted((r.path, r.sent_id, r.sentence, str(r.tokens)) for r in rows.collect()), sorted(map(tuple, lines.collect())), spark.read.text(str(tmp_path)).rdd.getNumPartitions()

    few = read()
    most = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "397")
        many = read()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", most)
    assert many[:2] == few[:2] and many[2] > few[2] + 10
    for name in ("a.txt", "b.txt"):
        text = (tmp_path / name).read_bytes().decode().replace("\r\n", "\n")
        blocks, own = [], []
        for line in [*text.split("\n"), ""]:
            if line.strip():
                own.append(line.split("\t")[1])
            elif own:
                blocks.append(" ".join(own))
                own = []
        assert [x[2] for x in sorted(few[0], key=lambda x: x[1]) if x[0].endswith(name)] == blocks
        assert [(n, v) for p, n, v in few[1] if p.endswith(name)] == list(enumerate(text.split("\n")[: -1 if text.endswith("\n") else None]))


def moved(spark):
    """Bytes shuffled, spilled and written by all stages so far."""
    sc = spark.sparkContext
    sc._jsc.sc().listenerBus().waitUntilEmpty()
    stages = sc._jsc.sc().statusStore().stageList(None, False, False, sc._gateway.new_array(sc._jvm.double, 0), None)
    stages = [stages.apply(k) for k in range(stages.size())]
    return sum(s.shuffleWriteBytes() + s.diskBytesSpilled() + s.outputBytes() for s in stages)


def test_sentences_move_a_few_times_only(spark, tmp_path):
    """Each line crossed some twenty shuffles and tables, so that 6 GB became 200."""
    rng = random.Random(7)
    said = ["".join(chr(rng.randrange(33, 127)) for _ in range(4000)) for _ in range(400)]
    rows = spark.createDataFrame(list(enumerate(said)), "id long, sentence string").repartition(2)
    rows.write.parquet(str(tmp_path / "rows"))
    rows = spark.read.parquet(str(tmp_path / "rows"))
    store = create_answers(spark, str(tmp_path / "store"), T.StringType(), 8)

    def model(bad):
        def one(sentence):
            if ord(sentence[0]) % 7 in bad:
                raise ValueError("bad")
            return hashlib.md5(sentence.encode()).hexdigest()

        return lambda: one

    joins = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)  # as with tables that are too large for it
        before = moved(spark)
        infer_once(rows, F.col("sentence"), store, model({0}), "v1")
        made = infer_once(rows, F.col("sentence"), store, model({1, 2, 3, 4, 5, 6}), "v1").drop("sentence").collect()
        times = (moved(spark) - before) / sum(map(len, said))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", joins)
    assert sorted(map(tuple, made)) == [(i, hashlib.md5(s.encode()).hexdigest(), None) for i, s in enumerate(said)]
    assert times < 5, times


def test_a_failure_that_repeats_is_kept_once(spark, tmp_path):
    rows = spark.createDataFrame([("a",), ("b",), ("b",), (None,)], "s string")
    store = create_answers(spark, str(tmp_path / "store"), T.StringType(), 4)
    for bad in (("a", "b"), ("a", "b"), ("a",)):
        made = infer_once(rows, F.col("s"), store, counted(str(tmp_path / "calls"), bad), "m").collect()
        assert sorted(map(tuple, made), key=str) == sorted([(None, None, None), ("a", None, "ValueError: a"), *[("b", None, "ValueError: b") if "b" in bad else ("b", "B", None)] * 2], key=str)
    kept = sorted(map(tuple, store.rows().select("sentence", "answer", "error").collect()), key=str)
    assert kept == sorted([("a", None, "ValueError: a"), ("b", None, "ValueError: b"), ("b", "B", None)], key=str)
    assert sorted(os.listdir(tmp_path / "store" / "pieces")) and not [f for f in (tmp_path / "store" / "pieces").glob("*/bucket=-1")]
