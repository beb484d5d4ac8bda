import math
import zlib

import numpy as np
import xxhash
from pyspark.sql import functions as F

from statuta.llm import quality, toxicity
from statuta.llm.queries import QUERIES

SF = "/root/testdata/sf0.1"


def test_quality_on_held_out_rows(spark):
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    got = QUERIES["op9_quality"](spark, SF).collect()
    assert len(got) == 10_000
    right, n, low = 0, 0, []
    for r in got:
        assert 0 <= r.score <= 1 and r.predicted == (r.score >= 0.3)
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0)
        if r.held_out and r.doc_id in labels:
            n += 1
            right += r.predicted == labels[r.doc_id]
            low.append((r.score, labels[r.doc_id]))
    assert n > 400 and right / n > 0.97
    bad, good = [s for s, y in low if not y], [s for s, y in low if y]
    assert np.mean([b < g for b in bad for g in good]) > 0.98


def test_toxicity_on_unlabelled_draws(spark):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    seen = labels.where("doc_id % 2 = 0")
    judged = {r.doc_id: r for r in toxicity.judge(docs.select("doc_id", "text"), seen).collect()}
    unseen = [(r.toxic, judged[r.doc_id]) for r in labels.where("doc_id % 2 = 1").collect()]
    caught = [r.rejected for y, r in unseen if y]
    wrong = [r.rejected for y, r in unseen if not y]
    assert np.mean(caught) > 0.9 and np.mean(wrong) < 0.005


def test_chain_feeds_out_of_fold_probabilities(spark):
    rng = np.random.default_rng(2)
    first = rng.integers(0, 2, 600).astype(float)
    rows = [np.array([0, 5 if y else 6]) for y in first]
    chain = toxicity.fit_chain(spark, rows, [first, first])
    assert chain.weights[1][toxicity.SIZE] > 0
    p = [chain.probabilities(r) for r in rows]
    assert all((a > 0.5) == (b > 0.5) == bool(y) for (a, b), y in zip(p, first, strict=True))


def test_link_helps_on_unseen_rows(spark):
    """The later category follows the earlier one, and may not use its features itself: only the link can tell."""
    rng = np.random.default_rng(5)
    first = rng.integers(0, 2, 1500).astype(float)
    second = np.where(rng.random(1500) < 0.9, first, 1 - first)
    rows = [np.sort(np.array([0, *(10 + int(y) * 40 + rng.integers(0, 40, 3)), *rng.integers(100, 140, 2)])) for y in first]
    masks = [np.ones(toxicity.SIZE, bool), np.arange(toxicity.SIZE) >= 100]
    masks[1][0] = True
    chain = toxicity.fit_chain(spark, rows[:1000], [first[:1000], second[:1000]], masks)
    alone = toxicity.fit_chain(spark, rows[:1000], [second[:1000]], masks[1:])
    linked = np.mean([(chain.probabilities(r)[1] > 0.5) == y for r, y in zip(rows[1000:], second[1000:], strict=True)])
    apart = np.mean([(alone.probabilities(r)[0] > 0.5) == y for r, y in zip(rows[1000:], second[1000:], strict=True)])
    assert linked > 0.85 > 0.65 > apart


def test_link_lowers_the_loss_on_unseen_documents(spark):
    """On the tables: log-loss of toxic on labelled rows that the fit did not see, with the link from quality and without it."""
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    toxic = {r.doc_id: r.toxic for r in labels.where("doc_id % 2 = 1").collect()}
    unseen = docs.join(labels.where("doc_id % 2 = 1").select("doc_id"), "doc_id")
    loss = {}
    for chain in (toxicity.CHAIN, toxicity.CHAIN[1:]):
        fitted = toxicity.fit_labels(docs, labels.where("doc_id % 2 = 0"), chain=chain)
        p = {r.doc_id: r.p_toxic for r in toxicity.score(unseen, fitted, names=[c[0] for c in chain]).collect()}
        loss[len(chain)] = -np.mean([np.log(max(1e-9, p[i] if y else 1 - p[i])) for i, y in toxic.items()])
    assert loss[2] < loss[1]


def plain_ftrl(rows, labels, epochs, alpha, l1, l2, seed=0):
    """Follow the regularised leader with a dictionary, number by number, from its published update."""
    z, n = {}, {}
    weight = lambda i: 0.0 if abs(z.get(i, 0.0)) <= l1 else -(z[i] - math.copysign(l1, z[i])) / ((1.0 + math.sqrt(n[i])) / alpha + l2)
    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        for k in rng.permutation(len(rows)):
            w = {i: weight(i) for i, _ in rows[k]}
            p = 1 / (1 + math.exp(-max(-35, min(35, sum(w[i] * x for i, x in rows[k])))))
            for i, x in rows[k]:
                g = (p - labels[k]) * x
                old = n.get(i, 0.0)
                n[i] = old + g * g
                z[i] = z.get(i, 0.0) + g - (math.sqrt(n[i]) - math.sqrt(old)) / alpha * w[i]
    return {i: weight(i) for i in z}


def plain_sample(spark, sf, use):
    """Labelled rows in order of the hash of their ids."""
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    labels = {r.doc_id: r for r in spark.read.parquet(f"{sf}/labels.parquet").collect() if use(r.doc_id)}
    signed = lambda i: int(np.uint64(xxhash.xxh64_intdigest(i.to_bytes(8, "little", signed=True), 42)).astype(np.int64))
    order = sorted((i for i in labels if i in texts), key=signed)
    return texts, order, labels


def test_quality_scores_match_a_plain_recomputation(spark):
    sf = "/root/testdata/sf0.01"
    texts, order, labels = plain_sample(spark, sf, lambda i: zlib.crc32(str(i).encode()) % 5 != 0)
    made = {i: [(int(a), float(np.float32(v))) for a, v in zip(*quality.features(t), strict=True)] for i, t in texts.items()}
    w = plain_ftrl([made[i] for i in order], [labels[i].quality for i in order], 3, 0.3, 0.5, 1.0)
    for r in QUERIES["op9_quality"](spark, sf).collect():
        want = 1 / (1 + math.exp(-sum(w.get(a, 0.0) * v for a, v in made[r.doc_id])))
        assert abs(r.score - want) < 1e-4


def test_toxicity_scores_match_a_plain_recomputation(spark):
    sf = "/root/testdata/sf0.01"
    texts, order, labels = plain_sample(spark, sf, lambda i: True)
    made = {i: set(map(int, toxicity.features(t))) for i, t in texts.items()}
    own = [[int(labels[i].quality == 0) for i in order], [int(labels[i].toxic == 1) for i in order]]
    total, weights, unseen = len(order), [], []
    for c, y in enumerate(own):
        count = {}
        for i, one in zip(order, y, strict=True):
            for a in made[i]:
                count.setdefault(a, [0, 0])[one] += 1
        kept = {0}
        for a, (other, ours) in count.items():
            n = other + ours
            term = lambda k, of: k * math.log(k * total / (n * of)) if k else 0.0  # noqa: E731, B023
            miss = lambda k, of: (of - k) * math.log((of - k) / max(of - n * of / total, 1e-9)) if of > k else 0.0  # noqa: E731, B023
            of = (total - sum(y), sum(y))
            ratio = 2 * sum(term(k, o) + miss(k, o) for k, o in ((other, of[0]), (ours, of[1])))
            if ours >= 4 and ours > 0.01 * n and ratio >= toxicity.LEAST_RATIO and ours / of[1] >= toxicity.LEAST_LIFT * (other + 0.5) / of[0]:
                kept.add(a)
        rows = [[(a, 1.0) for a in sorted(made[i] & kept)] + [(toxicity.SIZE + k, u[j]) for k, u in enumerate(unseen)] for j, i in enumerate(order)]
        folds = np.random.default_rng(1).permutation(total) % toxicity.FOLDS
        if c == 0:
            out = [0.0] * total
            for f in range(toxicity.FOLDS):
                inside = [j for j in range(total) if folds[j] != f]
                w = plain_ftrl([rows[j] for j in inside], [y[j] for j in inside], 6, 0.5, 0.1, 0.1)
                for j in np.flatnonzero(folds == f):
                    out[j] = 1 / (1 + math.exp(-sum(w.get(a, 0.0) * v for a, v in rows[j])))
            unseen.append(out)
        weights.append(plain_ftrl(rows, y, 6, 0.5, 0.1, 0.1))
    for r in QUERIES["op2_toxicity"](spark, sf).collect():
        p = []
        for w in weights:
            p.append(1 / (1 + math.exp(-sum(w.get(a, 0.0) for a in made[r.doc_id]) - sum(w.get(toxicity.SIZE + k, 0.0) * x for k, x in enumerate(p)))))
        assert abs(r.p_low_quality - p[0]) < 1e-4 and abs(r.p_toxic - p[1]) < 1e-4 and r.rejected == (r.p_toxic >= 0.5)


def test_fits_are_bounded(spark):
    labels = spark.createDataFrame([(i, i % 2, i % 2) for i in range(50)] + [(3, 0, 0)], "doc_id long, quality int, toxic int")
    docs = spark.createDataFrame([(i, f"word{i} " * 40) for i in range(50)] + [(7, "again")] * 30, "doc_id long, text string")
    chosen = quality.sample(labels, docs, ["quality"], 20)
    assert chosen.count() == 20 and chosen.select("doc_id").distinct().count() == 20
    rows, y = quality.examples(chosen, most=35)
    assert sum(len(a) for a, _ in rows) <= 35 and 0 < len(rows) < 20 and len(y) == len(rows)


def test_cases(spark):
    rows = [(1, None), (None, "x"), (2, ""), (2, "word " * 30_000), (2, "word " * 30_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("p_toxic", F.lit("clash")).withColumn("label", F.lit(1))
    some = spark.createDataFrame([(1, 1, 1), (2, 0, 0), (2, 1, 0), (None, 1, 1), (77, None, None)], "doc_id long, quality int, toxic int")
    for labels in (some, some.limit(0)):
        assert toxicity.judge(docs, labels).count() == 5
        got = quality.classify(docs, labels).collect()
        assert len(got) == 5 and all(0 <= r.score <= 1 for r in got)
    assert not any(r.rejected for r in toxicity.judge(docs, some.limit(0)).collect())
    assert toxicity.judge(docs.limit(0), some).count() == 0
    assert quality.classify(docs.limit(0), some).count() == 0
