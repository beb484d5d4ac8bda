import os
import random

import pytest
from pyspark.sql import functions as F

from statuta.operators import graph
from statuta.operators.support_store import SupportStore
from statuta.streaming import incremental

KIND = "name string, document_id string"


def new_store(spark, tmp_path, rows, buckets=64, kind=KIND, keys=("name",)):
    store = SupportStore.create(spark.createDataFrame([], kind), str(tmp_path / "store"), list(keys), buckets)
    store.merge(spark.createDataFrame(rows, kind))
    return store


def content(df):
    return sorted(map(tuple, df.collect()), key=str)


def files(store):
    """Path and time of each data file."""
    found = {}
    for at, _, names in os.walk(f"{store.folder}/pieces"):
        found |= {os.path.join(at, n): os.stat(os.path.join(at, n)).st_mtime_ns for n in names if n.endswith(".parquet")}
    return found


def test_random_batches_equal_the_full_merge(spark, tmp_path):
    rng = random.Random(4)
    draw = lambda n: [(rng.choice(["hot", None, "", f"n{rng.randrange(30)}"]), rng.choice([None, f"d{rng.randrange(20)}"])) for _ in range(n)]
    first = draw(80)
    store, want = new_store(spark, tmp_path, first, 16), set(first)
    for k in range(3):
        batch = draw(40)
        n = store.merge(spark.createDataFrame(batch, KIND))
        assert n == len(set(batch) - want)
        want |= set(batch)
        if k == 1:
            store.compact(1)
            store.vacuum()
    assert content(store.rows()) == sorted(want, key=str)
    full = graph.merge_into(spark.createDataFrame(first, KIND), spark.createDataFrame(list(want), KIND))
    assert content(store.rows()) == content(full)


def test_a_batch_reads_and_writes_its_buckets_only(spark, tmp_path, monkeypatch):
    names = [f"n{k}" for k in range(200)]
    store = new_store(spark, tmp_path, [(n, f"d{k}") for n in names for k in range(5)], 128)
    before, state = files(store), store.state()
    read = []
    whole = SupportStore._read
    monkeypatch.setattr(SupportStore, "_read", lambda self, s, pieces: read.extend(pieces) or whole(self, s, pieces))
    assert store.merge(spark.createDataFrame([("n3", "d0"), ("n3", "new"), ("n7", "new")], KIND)) == 2
    added = set(store.state().pieces) - set(state.pieces)
    assert {p.bucket for p in read} == {p.bucket for p in added} and len(read) == 2
    assert sum(p.n for p in read) <= 0.05 * sum(p.n for p in state.pieces)
    now = files(store)
    assert {f: now[f] for f in before} == before and len(now) - len(before) == 2
    read.clear()
    assert store.compact(1) == sorted(p.bucket for p in added)
    assert len(read) == 4
    assert {f for f in files(store)} >= set(before)
    assert store.vacuum() == 4
    assert len(set(before) - set(files(store))) == 2
    assert store.rows().count() == 1002


def test_look_up(spark, tmp_path):
    store = new_store(spark, tmp_path, [("a", "1"), ("a", "2"), ("b", "1"), (None, "3")], 8)
    asked = spark.createDataFrame([("a",), (None,), ("z",)], "name string")
    assert content(store.of(asked)) == sorted([("a", "1"), ("a", "2"), (None, "3")], key=str)
    assert content(store.of(asked.limit(0))) == []


def test_hot_key_is_written_in_several_files(spark, tmp_path, monkeypatch):
    monkeypatch.setattr("statuta.operators.support_store.FILE_ROWS", 100)
    store = new_store(spark, tmp_path, [("hot", f"d{k}") for k in range(1000)], 4)
    assert len(store.state().pieces) == 1
    assert len(files(store)) > 1
    assert store.merge(spark.createDataFrame([("hot", f"d{k}") for k in range(990, 1010)], KIND)) == 10


def test_repeated_batches_do_nothing(spark, tmp_path):
    store = new_store(spark, tmp_path, [])
    one, two = (spark.createDataFrame([(c, "d")], KIND) for c in "ab")
    assert [store.merge(one, 0), store.merge(one, 0), store.merge(two, 1), store.merge(one, 0)] == [1, 0, 1, 0]
    assert content(store.rows()) == [("a", "d"), ("b", "d")]


def test_a_merge_that_fails_leaves_the_table_as_it_was(spark, tmp_path, monkeypatch):
    store = new_store(spark, tmp_path, [("a", "1")])
    before = store.state()
    more = spark.createDataFrame([("a", "2"), ("b", "1")], KIND)

    def fail(*_):
        raise OSError("lost")

    with monkeypatch.context() as m:
        m.setattr(SupportStore, "_commit", fail)
        with pytest.raises(OSError):
            store.merge(more)
    assert store.state() == before and content(store.rows()) == [("a", "1")]
    assert store.merge(more) == 2
    assert content(store.rows()) == [("a", "1"), ("a", "2"), ("b", "1")]


def test_a_folder_with_a_store_is_not_made_anew(spark, tmp_path):
    new_store(spark, tmp_path, [("a", "1")])
    with pytest.raises(Exception, match="already exists"):
        SupportStore.create(spark.createDataFrame([], KIND), str(tmp_path / "store"), ["name"])
    assert SupportStore(spark, str(tmp_path / "store")).rows().count() == 1


def test_clashing_and_odd_column_names(spark, tmp_path):
    kind = "`bucket` int, `row` string, `a.b` string, `h` string, slice long"
    rows = [(1, "x", "y", None, 5), (1, "x", "y", "", 5), (None, None, None, None, None)]
    store = new_store(spark, tmp_path, rows, 4, kind, ["a.b", "bucket"])
    assert store.merge(spark.createDataFrame(rows, kind)) == 0
    assert content(store.rows()) == sorted(rows, key=str)
    assert content(store.of(spark.createDataFrame([("y", 1)], "`a.b` string, bucket int"))) == sorted(rows[:2], key=str)


def test_stream_into_stores_equals_the_batch(spark, tmp_path):
    kind = "document_id string, document_number string, c1 string, r string, c2 string"
    rng = random.Random(2)
    rows = [(f"d{rng.randrange(9)}", "n", f"A_{rng.randrange(5)}", rng.choice(["r", ""]), f"B{rng.randrange(5)}") for _ in range(60)]
    for k in range(3):
        spark.createDataFrame(rows[k * 15 : k * 15 + 30], kind).coalesce(1).write.parquet(str(tmp_path / f"in/{k}"))
    made = graph.build_triplets(spark.createDataFrame(rows, kind))
    want = [graph.node_support(made), graph.edge_support(made)]
    stores = [SupportStore.create(w, str(tmp_path / f"store{i}"), keys, 8) for i, (w, keys) in enumerate(zip(want, (["name"], ["c1", "r", "c2"]), strict=True))]
    stream = spark.readStream.schema(kind).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in/*"))
    for _ in range(2):  # the second start finds nothing new
        query = incremental.ingest_stores(stream, *stores, str(tmp_path / "checkpoint"))
        query.awaitTermination()
        assert query.exception() is None
    assert [content(s.rows()) for s in stores] == [content(w) for w in want]
    again = incremental.merge_batch(*stores)
    again(spark.createDataFrame(rows[:30], kind).withColumn("c1", F.lit("other")), 0)
    assert [content(s.rows()) for s in stores] == [content(w) for w in want]
