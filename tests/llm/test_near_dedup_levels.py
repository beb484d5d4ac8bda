import random

import pytest

from statuta.llm import shingle_sets, simhash
from tests.llm.test_near_dedup_stage import edited


def brute_kept(texts, level):
    """The smallest ids of the groups by 5-word shingle similarity of the level or more, with plain sets of words."""
    p, q = level
    sets, parent = {}, {i: i for i in texts}
    for i, t in texts.items():
        words = (t or "").encode().lower().split()
        sets[i] = {tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))} if words else set()

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    ids = sorted(texts)
    for k, i in enumerate(ids):
        for j in ids[k + 1 :]:
            if q * len(sets[i] & sets[j]) >= p * len(sets[i] | sets[j]):
                low, high = sorted((root(i), root(j)))
                parent[high] = low
    return {i for i in ids if root(i) == i}


def test_every_level_matches_brute_force(spark):
    documents = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    texts = {r.doc_id: r.text for r in documents.collect()}
    rng = random.Random(7)
    base = [f"w{k}" for k in range(120)]
    texts |= {100_000 + i: " ".join(edited(rng, base, rng.choice([0.02, 0.05, 0.1, 0.2]))) for i in range(150)}
    texts |= {200_000: None, 200_001: "", 200_002: "one two three", 200_003: "ONE two  three", 200_004: "one two three four"}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    left = []
    for level in [(3, 10), (1, 2), (4, 5), (9, 10), (1, 1)]:
        kept = {r.doc_id for r in simhash.one_of_each(docs, level=level).collect()}
        assert kept == brute_kept(texts, level), level
        left.append(len(kept))
    assert left == sorted(set(left))


def test_the_usual_level_is_four_fifths():
    assert shingle_sets.layout() == shingle_sets.layout((4, 5)) == (shingle_sets.BANDS, shingle_sets.ROWS)


def test_bands_of_every_level_miss_as_few_links():
    for k in range(5, 61):
        bands, rows = shingle_sets.layout((k, 60))
        assert bands * rows <= shingle_sets.BANDS * shingle_sets.ROWS and (1 - (k / 60) ** rows) ** bands < shingle_sets.MISSED
    for level in [(0, 1), (1, 20), (6, 5)]:
        with pytest.raises(ValueError):
            shingle_sets.layout(level)
