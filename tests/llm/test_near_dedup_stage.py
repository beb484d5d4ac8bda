import random
from math import comb

import corpus_pipeline
from statuta.llm import shingle_sets, simhash
from tests.llm.test_simhash import brute_fingerprint


def brute_sets(texts):
    """Groups by 5-word shingle similarity of 0.8 or more, with plain sets of words."""
    sets = {}
    for i, t in texts.items():
        words = (t or "").encode().lower().split()
        sets[i] = {tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))} if words else set()
    ids, parent = sorted(texts), {i: i for i in texts}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in ids:
        for j in ids:
            a, b = sets[i], sets[j]
            if j > i and 5 * min(len(a), len(b)) >= 4 * max(len(a), len(b)) and 5 * len(a & b) >= 4 * len(a | b):
                low, high = sorted((root(i), root(j)))
                parent[high] = low
    return {i: root(i) for i in ids}


def edited(rng, words, share):
    return [f"n{rng.random()}" if rng.random() < share else w for w in words]


def test_stage_matches_brute_force(spark):
    documents = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    texts = {r.doc_id: r.text for r in documents.collect()}
    rng = random.Random(3)
    base = [f"w{k}" for k in range(150)]
    dense = {100_000 + i: " ".join(edited(rng, base, rng.choice([0.01, 0.02, 0.05, 0.1]))) for i in range(150)}
    few = {200_000: None, 200_001: " \t", 200_002: "one two three", 200_003: "ONE two  three", 200_004: "one two"}
    more = spark.createDataFrame(list({**dense, **few}.items()), "doc_id long, text string")
    docs = documents.select("doc_id", "text").union(more)
    texts = {**texts, **dense, **few}
    want = brute_sets(texts)
    kept = {r.doc_id for r in corpus_pipeline.drop_near_copies(spark, docs, "").collect()}
    assert kept == {i for i in texts if want[i] == i}


def test_pair_that_differs_in_more_than_four_bits_goes(spark):
    documents = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").where("doc_id IN (1, 177)")
    one, other = [brute_fingerprint(r.text) for r in documents.collect()]
    assert bin(one ^ other).count("1") > 4
    assert [r.doc_id for r in corpus_pipeline.drop_near_copies(spark, documents, "").collect()] == [1]


def test_one_row_of_each_group_stays(spark):
    a, b, c, d = ("one two three four five six", "seven eight nine ten eleven", "twelve thirteen", "fourteen")
    rows = [(5, a, "x"), (5, a, "y"), (5, b, "x"), (3, b, "x"), (None, c, "x"), (None, c, "x"), (None, c + " ", "x"), (None, d, "x"), (9, d, "x"), (None, None, "x"), (None, "", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3)
    kept = [(r.doc_id, (r.text or "").strip()) for r in corpus_pipeline.drop_near_copies(spark, docs, "").collect()]
    assert sorted(kept, key=str) == sorted([(5, a), (3, b), (None, c), (9, d), (None, "")], key=str)


def test_nothing_to_link(spark):
    docs = spark.createDataFrame([(1, "a b c"), (2, None)], "doc_id long, text string")
    assert corpus_pipeline.drop_near_copies(spark, docs, "").count() == 2
    assert simhash.one_of_each(docs.limit(0)).count() == 0


def test_similar_pairs_are_within_the_loose_bound():
    rng = random.Random(8)
    far = 0
    for n in [5, 10, 50, 400]:
        for _ in range(300):
            words = [f"w{rng.randrange(10**6)}" for _ in range(n + 4)]
            a = shingle_sets.shingle_set(" ".join(words))
            b = shingle_sets.shingle_set(" ".join(words[: -max(1, n // 5)] if n >= 5 else words))
            if 5 * len(b) >= 4 * len(a):
                far = max(far, bin((shingle_sets.bits(a) ^ shingle_sets.bits(b)) & (2**64 - 1)).count("1"))
    assert 4 < far <= simhash.LOOSE


def chance_of_another_bit(shared, more, other):
    """That a majority over shared + more random bits differs from that over shared + other."""
    found = 0.0
    for c in range(shared + 1):
        for x in range(more + 1):
            for y in range(other + 1):
                if ((c + x) * 2 > shared + more) != ((c + y) * 2 > shared + other):
                    found += comb(shared, c) * comb(more, x) * comb(other, y) / 2 ** (shared + more + other)
    return found


def test_the_loose_bound_discards_links_less_often_than_the_bands_miss_them():
    sizes = [(s, a, b) for s in range(4, 40) for a in range(s // 4 + 1) for b in range(a, s // 4 + 1 - a) if a + b]
    p = max(chance_of_another_bit(*z) for z in sizes)
    beyond = sum(comb(64, k) * p**k * (1 - p) ** (64 - k) for k in range(simhash.LOOSE + 1, 65))
    missed = (1 - 0.8**shingle_sets.ROWS) ** shingle_sets.BANDS
    assert beyond < missed < 6e-9


def test_stages_move_texts_by_one_plan_at_any_size(spark):
    """A broadcast of what is small, and a shuffle beyond it, made the disk grow faster than the input."""
    docs = spark.createDataFrame([(i, f"line {i % 3} " * 9) for i in range(40)], "doc_id long, text string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    chain = corpus_pipeline.toxic.fit_labels(docs, labels)
    for made in (corpus_pipeline.line_dedup.judged(docs), corpus_pipeline.toxic.without_toxic(docs, chain)):
        plan = made._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan
        assert made.count() == 40
