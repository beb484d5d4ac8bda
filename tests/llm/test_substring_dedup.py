import hashlib
import random
import re
from collections import Counter

from pyspark.sql import functions as F

from statuta.llm import substring_dedup as sd
from statuta.llm.queries import QUERIES


def brute(texts, width=35):
    words = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for t in texts]
    seen = Counter(tuple(w[i : i + width]) for w in words for i in range(len(w) - width + 1))
    out = []
    for w in words:
        gone = set()
        for i in range(len(w) - width + 1):
            if seen[tuple(w[i : i + width])] > 1:
                gone.update(range(i, i + width))
        kept = " ".join(x for i, x in enumerate(w) if i not in gone)
        out.append((len(w), len(gone), kept))
    return out


def test_matches_brute_force(spark):
    rng = random.Random(3)
    make = lambda n, v=400: [f"w{rng.randrange(v)}" for _ in range(n)]
    passages = [make(n) for n in (34, 35, 36, 60, 200, 90)]
    texts = [None, "", " ", "one two", " ".join(["ha"] * 34), " ".join(["ho"] * 35), " ".join(["hi"] * 36), " ".join(["x", "y"] * 40), "é " * 50]
    for _ in range(60):
        t = make(rng.randrange(80))
        for _ in range(rng.randrange(4)):
            p = list(rng.choice(passages))
            if rng.random() < 0.5 and len(p) > 40:
                p[rng.randrange(len(p))] = "changed"
            if rng.random() < 0.3:
                p = p[rng.randrange(5) :]
            t += p + make(rng.randrange(50))
        texts.append(rng.choice([" ", "\n"]).join(t))
    texts += [texts[-1], texts[-2]] + [" ".join(make(3000, 3)) for _ in range(2)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_text) for r in sd.dedup_substrings(docs).collect()}
    for i, want in enumerate(brute(texts)):
        assert got[i] == want, (i, texts[i])


def test_cases(spark):
    long = " ".join(f"w{i}" for i in range(50))
    rows = [(1, long), (1, long), (1, "other"), (None, long + " end"), (4, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("spans", F.lit("clash")).withColumn("block", F.lit(3))
    got = sorted(((r.doc_id, r.n_words, r.n_removed, r.kept_text) for r in sd.dedup_substrings(docs).collect()), key=str)
    assert got == sorted([(1, 50, 50, ""), (1, 50, 50, ""), (1, 1, 0, "other"), (None, 51, 50, "end"), (4, 0, 0, "")], key=str)
    assert sd.dedup_substrings(docs.limit(0)).count() == 0


def test_query(spark):
    sf = "/root/testdata/sf0.001"
    rows = spark.read.parquet(f"{sf}/documents.parquet").collect()
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in QUERIES["op8_substring_dedup"](spark, sf).collect()}
    for r, (n, gone, kept) in zip(rows, brute([r.text for r in rows]), strict=True):
        assert got[r.doc_id] == (n, gone, hashlib.sha256(kept.encode()).hexdigest())
