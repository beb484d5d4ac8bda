import hashlib
import random
import re
import zlib
from collections import Counter
from math import floor, log

from statuta.llm import resampling as rs
from statuta.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def features(text, size, width):
    words = WORD.findall((text or "").translate(LOWER))
    return len(words), [zlib.crc32(" ".join(words[i : i + n]).encode()) % size for n in range(1, width + 1) for i in range(len(words) - n + 1)]


def brute(docs, target, percent=10, least=20, size=10_000, width=1, seed=2024):
    made = [(i, *features(t, size, width)) for i, t in docs]
    corpus, wanted = Counter(b for _, _, f in made for b in f), Counter(b for t in target for b in features(t, size, width)[1])
    s_all, t_all = sum(corpus.values()), sum(wanted.values())
    gain = [floor(1000 * log((wanted[b] + 1.0) * (s_all + size) / ((corpus[b] + 1.0) * (t_all + size)))) for b in range(size)]
    rows = []
    for i, n, f in made:
        weight = sum(gain[b] for b in f) // len(f) if f else 0
        h = int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        rows.append((i, n, len(f), weight, weight + floor(-1000 * log(-log((h + 0.5) / 4294967296)))))
    among = sorted((r for r in rows if r[1] >= least), key=lambda r: (-r[4], r[0] is None, r[0] or 0))
    return [(r[0], *r[2:]) for r in rows], [(r[0], *r[2:], k) for k, r in enumerate(among[: percent * len(among) // 100], 1)]


def order(rows):
    return sorted(rows, key=lambda r: tuple((x is None, x or 0) for x in r))


def check(df, docs, target, **how):
    every, drawn = brute(docs, target, **how)
    got = [tuple(r) for r in df.select("doc_id", "n_features", "weight", "score", "rank").collect()]
    assert order([r[:4] for r in got]) == order(every)
    told = sorted((r for r in got if r[4] is not None), key=lambda r: r[4])
    assert [r[4] for r in told] == [r[4] for r in drawn]
    assert [(r[3], r[0]) for r in told] == [(r[3], r[0]) for r in drawn]


def test_query_equals_brute_force(spark):
    docs = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    target = [r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("text").collect()]
    check(QUERIES["op13_resampling"](spark, SF), docs, target)


def _odd():
    rng = random.Random(4)
    words = ["the", "Übung", "12", "日本", "a-b", "x", "réal", "word"]
    docs = [(rng.choice([1, 2, 2, 2, 5, None, *range(6, 40)]), " ".join(rng.choices(words, k=rng.randint(0, 12)))) for _ in range(300)]
    docs += [(7, "copy of " * 9)] * 150 + [(None, None), (8, ""), (9, " ,.\0"), (10, "long " * 30_000)]
    return docs, ["the x 12", None, "", "Réal word word"]


def test_odd_rows_small_runs_and_wider_features(spark, monkeypatch):
    """Runs of 16 rows, of which an id that fills a third of the table has many; nulls, repeats, ties, columns of clashing names."""
    monkeypatch.setattr(rs, "RUN_ROWS", 16)
    monkeypatch.setattr(rs, "RANGE_ROWS", 16)
    docs, target = _odd()
    table = spark.createDataFrame([(i, t, "a", 1) for i, t in docs], "doc_id long, text string, run string, score int").repartition(5)
    wanted = spark.createDataFrame([(t,) for t in target], "text string")
    for how in ({"percent": 45, "least": 3}, {"percent": 100, "least": 0, "width": 2, "size": 64, "seed": 7}, {"percent": 1, "least": 8}):
        named = {("least_words" if k == "least" else k): v for k, v in how.items()}
        check(rs.resample(table, wanted, **named), docs, target, **how)


def test_empty_tables(spark):
    docs, target = spark.createDataFrame([(i, "some words " * 10) for i in range(30)], "doc_id long, text string"), spark.createDataFrame([("some",)], "text string")
    assert rs.resample(docs.where("false"), target).count() == 0
    check(rs.resample(docs, target.where("false")), [tuple(r) for r in docs.collect()], [])
    assert rs.resample(docs, target, percent=0).where("rank IS NOT NULL").count() == 0


def test_tournament_merges_any_number_of_runs():
    rng = random.Random(1)
    for k in range(0, 20):
        runs = [sorted((rng.randint(0, 9), r, n) for n in range(rng.randint(0, 7))) for r in range(k)]
        tree = rs.Tournament(runs)
        out = []
        while (row := tree.pop()) is not None:
            out.append(row)
        assert out == sorted(x for r in runs for x in r)
        assert tree.pop() is None
