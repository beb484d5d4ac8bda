"""Toxicity: a chain of linear classifiers, each fed the probabilities of the categories before it."""

from __future__ import annotations

from collections.abc import Iterator
from math import log2

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from statuta.llm.common import free, materialise, packed, parts, quoted, text_or_empty, tidy, unpacked
from statuta.llm.ftrl import Ftrl, sigmoid
from statuta.llm.quality import in_bound, sample

BITS = 20
SIZE = 1 << BITS
CACHE = 120_000
#: Bounds of a fit: labelled rows that it reads (those with the smallest hashes of their ids), and kept features of all of them together (the last rows go).
FIT_ROWS, FIT_FEATURES = 8000, 8_000_000
#: A feature is kept for a category if its log-likelihood ratio is this large and it is this many times as frequent in the category's rows.
LEAST_RATIO, LEAST_LIFT = 25.0, 3.0
FOLDS = 4
#: The categories in chain order, and the label of each with the value that means it. A row is rejected by the last one.
CHAIN = (("low_quality", "quality", 0), ("toxic", "toxic", 1))
_PUNCTUATION = "".join(c for c in map(chr, range(33, 127)) if not c.isalnum()) + "«»“”„‘’¿¡…–—"
_SEEN: dict[str, tuple[int, ...]] = {}


def _hash(kind: str, value: str) -> int:
    return 1 + xxhash.xxh64_intdigest(f"{kind}:{value}") % (SIZE - 1)


def _word(w: str) -> tuple[int, ...]:
    """Hashed features of a word as it stands: its lower-case form, the first 4, 5 and 6 letters (so that inflected forms meet), and the marks around it."""
    lower = w.lower()
    bare = lower.strip(_PUNCTUATION)
    found = tuple(_hash(str(k), bare[:k]) for k in (4, 5, 6) if len(bare) >= k) + (_hash("", bare),) if bare else ()
    marks = lower.replace(bare, " ") if bare else lower
    if len(marks) > 2 or not bare:
        found += (_hash("marks", marks),)
    if len(w) > 2 and w.isupper():
        found += (_hash("case", "upper"),)
    if len(w) < 40:
        if len(_SEEN) >= CACHE:
            _SEEN.clear()
        _SEEN[w] = found
    return found


def features(text: str) -> np.ndarray:
    """The distinct hashed features of all words, one more for each that two different words share, and how much words repeat; 0 is the constant."""
    told = text.split()
    words = set(told)
    found: list[int] = []
    for w in words:
        own = _SEEN.get(w)
        found += _word(w) if own is None else own
    at, counts = np.unique(np.array(found, np.int64), return_counts=True)
    twice = (at[counts > 1] * 40503 + 1_000_003) % (SIZE - 1) + 1
    repeats = [_hash("repeats", str(round(2 * log2(len(told) / len(words)))))] if words else []
    return np.concatenate([[0], np.union1d(np.union1d(at, twice), np.array(repeats, np.int64))])


class Chain:
    """A linear model for each category. Features past SIZE hold the probabilities of the categories before it."""

    def __init__(self, weights: list[np.ndarray]):
        self.weights = weights

    def probabilities(self, at: np.ndarray) -> list[float]:
        p: list[float] = []
        for w in self.weights:
            p.append(float(sigmoid(float(w[at].sum()) + sum(float(w[SIZE + k]) * x for k, x in enumerate(p)))))
        return p


def _fit(rows: list, labels: np.ndarray, size: int, epochs: int) -> np.ndarray:
    return Ftrl(size, alpha=0.5, l1=0.1, l2=0.1).fit(rows, labels, epochs).weights()


def fit_chain(spark, rows: list[np.ndarray], labels: list[np.ndarray], masks: list[np.ndarray] | None = None, epochs: int = 6) -> Chain:
    """Fit category after category. What a later model reads of an earlier one comes from models that did not see the row.

    A category's own fit and those of its folds are tasks of one Spark job, over
    the rows, a bounded sample that is broadcast. masks name the features that
    each category may use; without them, all.
    """
    n, k = len(rows), len(labels)
    folds = np.random.default_rng(1).permutation(n) % FOLDS
    before: list[np.ndarray] = []
    weights = []
    for c, y in enumerate(labels):
        own = [at if masks is None else at[masks[c][at]] for at in rows]
        examples = [(np.append(at, SIZE + np.arange(c)), np.append(np.ones(len(at)), [b[i] for b in before])) for i, at in enumerate(own)]
        shared = spark.sparkContext.broadcast((examples, y, folds))

        def run(batches: Iterator[pd.DataFrame], shared=shared, size=SIZE + k) -> Iterator[pd.DataFrame]:
            examples, y, folds = shared.value
            for fold in (int(f) for b in batches for f in b["id"]):
                inside = np.flatnonzero(folds != fold)
                w = _fit([examples[i] for i in inside], y[inside], size, epochs)
                if fold == FOLDS:
                    at = np.flatnonzero(w)
                    yield pd.DataFrame({"fold": fold, "at": at, "value": w[at]})
                else:
                    out = np.flatnonzero(folds == fold)
                    yield pd.DataFrame({"fold": fold, "at": out, "value": [float(sigmoid(w[examples[i][0]] @ examples[i][1])) for i in out]})

        first = 0 if c + 1 < k else FOLDS  # the last category feeds none, so it needs no folds
        made = spark.range(first, FOLDS + 1, 1, FOLDS + 1 - first).mapInPandas(tidy(run), "fold int, at long, value double").toPandas()
        shared.destroy()
        whole = made[made["fold"] == FOLDS]
        w = np.zeros(SIZE + k)
        w[whole["at"].to_numpy()] = whole["value"].to_numpy()
        weights.append(w)
        unseen = np.zeros(n)
        rest = made[made["fold"] < FOLDS]
        unseen[rest["at"].to_numpy()] = rest["value"].to_numpy()
        before.append(unseen)
    return Chain(weights)


def screen(with_own: np.ndarray, with_other: np.ndarray, own: int, other: int) -> np.ndarray:
    """Which features tell a category's rows from the others, from the numbers of rows of each kind that have them."""
    total, n = own + other, with_own + with_other
    if not own or not other:
        return np.zeros(len(n), bool)

    def part(seen, of):
        expected = n * of / total
        with np.errstate(divide="ignore", invalid="ignore"):
            return np.where(seen > 0, seen * np.log(seen / expected), 0) + np.where(of - seen > 0, (of - seen) * np.log((of - seen) / np.maximum(of - expected, 1e-9)), 0)

    ratio = 2 * (part(with_own, own) + part(with_other, other))
    return (ratio >= LEAST_RATIO) & (with_own / own >= LEAST_LIFT * (with_other + 0.5) / other)


def fit(labelled: DataFrame, names: list[str]) -> Chain:
    """A chain from labelled (hash, doc_id, text, a column of 0 and 1 for each name), a sample that the caller has bounded.

    One pass counts, by feature and category, the rows that have it; features
    that do not tell a category's rows apart leave it. The models are fitted on
    the rest. A category that none or all of the rows have gets a constant.
    """
    marked = labelled.select("hash", "doc_id", "text", *[F.col(n).cast("int").alias(n) for n in names])
    k = len(names)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in (p for b in batches for p in parts(b)):
            rows = [features(t) for t in part.column(2).to_pylist()]
            at, place = np.unique(np.concatenate(rows), return_inverse=True)
            sizes = [len(r) for r in rows]
            own = [np.bincount(place, np.repeat(part.column(3 + c).to_numpy(), sizes), len(at)).astype(np.int64) for c in range(k)]
            yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(np.bincount(place, minlength=len(at)).astype(np.int64)), *map(pa.array, own)], ["at", "n", *(f"own{c}" for c in range(k))])

    owns = [f"own{c}" for c in range(k)]
    schema = "at int, n long, " + ", ".join(f"{o} long" for o in owns)
    counts = marked.mapInArrow(tidy(count), schema).groupBy("at").agg(F.sum("n").alias("n"), *[F.sum(o).alias(o) for o in owns])
    often = " OR ".join(f"({o} >= 4 AND {o} > 0.01 * n)" for o in owns)
    seen = counts.where(f"at = 0 OR {often}").toPandas()  # at most 2 ** BITS rows
    all_ = seen[seen["at"] == 0]
    total = int(all_["n"].iloc[0]) if len(all_) else 0
    masks = []
    for o in owns:
        own = int(all_[o].iloc[0]) if total else 0
        mask = np.zeros(SIZE, bool)
        mask[seen["at"].to_numpy()[screen(seen[o].to_numpy(float), (seen["n"] - seen[o]).to_numpy(float), own, total - own)]] = True
        mask[0] = True
        masks.append(mask)
    either = np.logical_or.reduce(masks)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in (p for b in batches for p in parts(b)):
            rows = [a[either[a]].astype("<i4") for a in map(features, part.column(2).to_pylist())]
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), *part.columns[3:], pa.array([len(r) for r in rows], pa.int64()), pa.array([r.tobytes() for r in rows], pa.binary())], ["hash", "doc_id", *names, "n", "at"])

    labels_schema = ", ".join(f"{quoted(n)} int" for n in names)
    kept = materialise(marked.mapInArrow(tidy(keep), f"hash long, doc_id long, {labels_schema}, n long, at binary"), "examples")
    made = in_bound(kept, FIT_FEATURES)
    free(kept)
    if not len(made):
        low = np.zeros(SIZE + k)
        low[0] = -30.0
        return Chain([low] * k)
    rows = [np.frombuffer(a, "<i4").astype(np.int64) for a in made["at"]]
    return fit_chain(labelled.sparkSession, rows, [made[n].to_numpy(float) for n in names], masks)


def fit_labels(docs: DataFrame, labels: DataFrame, rows: int = FIT_ROWS, chain: tuple = CHAIN) -> Chain:
    """A chain fitted on at most `rows` labelled rows of docs (doc_id, text), each id once."""
    names = [name for name, _, _ in chain]
    meant = labels.select("doc_id", *[F.when(F.col(quoted(label)).isNotNull(), (F.col(quoted(label)) == value).cast("int")).alias(name) for name, label, value in chain])
    return fit(sample(meant, docs, names, rows), names)


def _scored(rows: DataFrame, chain: Chain, names: list[str]) -> DataFrame:
    """rows (text last) with p_<category> in place of the text."""
    shared = rows.sparkSession.sparkContext.broadcast([w.astype(np.float32) for w in chain.weights])  # 2 ** BITS numbers for each category
    place, added = len(rows.columns) - 1, [f"p_{n}" for n in names]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Chain(shared.value)
        for part in (p for b in batches for p in parts(b)):
            p = np.array([own.probabilities(features(t)) for t in part.column(place).to_pylist()]).reshape(-1, len(added))
            columns = [*part.columns[:place], *(pa.array(p[:, k]) for k in range(len(added)))]
            yield pa.RecordBatch.from_arrays(columns, schema=pa.schema([*list(part.schema)[:place], *(pa.field(c, pa.float64()) for c in added)]))

    from pyspark.sql import types as T

    return rows.mapInArrow(tidy(run), T.StructType([*rows.schema.fields[:place], *(T.StructField(c, T.DoubleType()) for c in added)]))


def _rejected(names: list[str], threshold: float) -> Column:
    return F.col(f"p_{names[-1]}") >= threshold


def score(docs: DataFrame, chain: Chain, threshold: float = 0.5, text_col: str = "text", names: list[str] | None = None) -> DataFrame:
    """The columns of docs, then p_<category> for each category of the chain, and rejected (the last one reaches the threshold).

    Null and empty texts have no words, so they score by the constants; texts
    are read whole; an empty table stays empty. Rows that repeat an id are
    scored each. Added columns replace columns of the same name; no other name
    matters.
    """
    names = names or [name for name, _, _ in CHAIN]
    made = _scored(docs.select(packed(docs).alias("row"), text_or_empty(text_col).alias("text")), chain, names)
    done = made.withColumn("rejected", _rejected(names, threshold))
    return done.select(*unpacked(done, *[f"p_{n}" for n in names], "rejected"))


def without_toxic(docs: DataFrame, chain: Chain, threshold: float = 0.5, text_col: str = "text") -> DataFrame:
    """The rows of docs that the chain does not reject, with all their columns, whatever their names.

    Only a hash of each rejected text (128 bits) leaves the Python workers; the
    rows themselves stay in the JVM. Null and empty texts count as one text.
    """
    names = [name for name, _, _ in CHAIN]
    base, text = docs.select(packed(docs).alias("row")), F.coalesce(F.col("row").getField(text_col), F.lit(""))
    hashes = [F.xxhash64(text).alias("h1"), F.xxhash64(F.lit("second half"), text).alias("h2")]
    judged = _scored(base.select(*hashes, text.alias("text")), chain, names).where(_rejected(names, threshold))
    gone = materialise(judged.select("h1", "h2").distinct(), "rejected")
    left = base.select("row", *hashes).join(gone.hint("merge"), ["h1", "h2"], "left_anti")  # a shuffle at every size, as in line dedup
    return left.select(*unpacked(left))


def judge(docs: DataFrame, labels: DataFrame, threshold: float = 0.5, rows: int = FIT_ROWS) -> DataFrame:
    """score() by a chain that is fitted on at most `rows` labelled rows of docs; no labels: every probability is near 0."""
    return score(docs, fit_labels(docs, labels, rows), threshold)
