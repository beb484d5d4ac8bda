import random
import time
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from statuta.operators.support_store import SupportStore
from statuta.streaming import properties as pr

KIND = "c1 string, r string, c2 string, at timestamp, properties map<string,string>"
KEYS = ["c1", "r", "c2"]


def events(n, seed):
    rng = random.Random(seed)
    start = datetime(2024, 1, 1)
    made = []
    for _ in range(n):
        at = None if rng.random() < 0.05 else start + timedelta(microseconds=rng.randrange(40))
        told = {rng.choice("pqs"): rng.choice(["1", "2", "é", "", None]) for _ in range(rng.randrange(3))}
        made.append((rng.choice(["a", "b", None]), "r", rng.choice("cd"), at, told))
    return made


def by_hand(rows):
    best = {}
    for c1, r, c2, at, told in rows:
        for p, v in told.items():
            rank = (at is not None, at or datetime.min, v is not None, v or "")
            k = (c1, r, c2, p)
            if k not in best or rank > best[k][0]:
                best[k] = (rank, at, v)
    return sorted(((*k, at, v) for k, (_, at, v) in best.items()), key=str)


def rows_of(df):
    return sorted((tuple(r) for r in df.select(*KEYS, "property", "at", "value").collect()), key=str)


def put(spark, rows, folder):
    spark.createDataFrame(rows, KIND).coalesce(1).write.mode("append").parquet(folder)


def source(spark, folder):
    return spark.readStream.schema(KIND).option("maxFilesPerTrigger", 1).parquet(folder)


def test_batch_by_hand(spark):
    rows = events(200, 1)
    told = pr.told_properties(spark.createDataFrame(rows, KIND), KEYS)
    assert rows_of(pr.latest(told, KEYS)) == by_hand(rows)
    maps = {(r.c1, r.r, r.c2): r.properties for r in pr.property_maps(told, KEYS).collect()}
    assert {(k, p): v for k, m in maps.items() for p, v in m.items()} == {(x[:3], x[3]): x[5] for x in by_hand(rows)}
    assert pr.latest(told.limit(0), KEYS).count() == 0


@pytest.mark.parametrize("ttl", [None, 1])
def test_shuffled_repeated_batches_and_a_restart(spark, tmp_path, ttl):
    """Three runs from one checkpoint, with late and repeated events, also where every state is forgotten at once."""
    store = pr.create_property_store(spark, str(tmp_path / "store"), KEYS, 16)
    rows = events(120, 2)
    shuffled = random.Random(3).sample(rows, len(rows))
    seen = []
    for part in ([shuffled[:40], shuffled[20:70]], [shuffled[60:], shuffled[:30]], [shuffled]):
        for own in part:
            put(spark, own, str(tmp_path / "in"))
            seen += own
        run = pr.ingest_properties(source(spark, str(tmp_path / "in")), SupportStore(spark, str(tmp_path / "store")), str(tmp_path / "mark"), KEYS, ttl)
        if ttl is None:
            run.awaitTermination()
        else:
            until = time.monotonic() + 90
            while rows_of(pr.latest(store.rows(), KEYS)) != by_hand(seen) and time.monotonic() < until:
                time.sleep(1)
            run.stop()
        assert rows_of(pr.latest(store.rows(), KEYS)) == by_hand(seen)
    assert by_hand(seen) == by_hand(rows)


def test_only_changes_reach_the_store(spark, tmp_path):
    store = pr.create_property_store(spark, str(tmp_path / "store"), KEYS, 4)
    late = [("a", "r", "b", datetime(2024, 1, 1), {"p": "old"})]
    now = [("a", "r", "b", datetime(2024, 1, 2), {"p": "new"})]
    for k, rows in enumerate((now, late, now * 500, late)):
        put(spark, rows, str(tmp_path / "in"))
        pr.ingest_properties(source(spark, str(tmp_path / "in")), store, str(tmp_path / "mark"), KEYS).awaitTermination()
        assert [r.value for r in store.rows().collect()] == ["new"], k
    assert store.rows().where(F.col("at") == datetime(2024, 1, 2)).count() == 1


def test_state_without_a_time_to_live_stays_in_the_jvm(spark, tmp_path):
    """A Python call for each key of a batch took longer than all else."""
    put(spark, events(5, 4), str(tmp_path / "in"))
    told = pr.told_properties(source(spark, str(tmp_path / "in")), KEYS)
    plan = lambda ttl: pr.changes(told, KEYS, ttl)._jdf.queryExecution().analyzed().toString()
    assert "TransformWithState" in plan(1000)
    assert "TransformWithState" not in plan(None) and "MapInPandas" not in plan(None)
