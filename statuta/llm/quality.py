"""Quality classifier: hashed word n-gram logistic regression, follow-the-regularised-leader, sparse dot products."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from statuta.llm.common import free, materialise, parts, quoted, text_or_empty, tidy
from statuta.llm.ftrl import Ftrl, sigmoid

BITS = 18
SIZE = 1 << BITS
CACHE = 120_000
#: Bounds of a fit: labelled rows that it reads (those with the smallest hashes of their ids), and features of all of them together (the last rows go).
FIT_ROWS, FIT_FEATURES = 4000, 8_000_000
_LETTERS = re.compile(r"[^\W\d_]+")
_SEEN: dict[str, tuple[int, int]] = {}


def _word(w: str) -> tuple[int, int]:
    """Hash of the word and of its shape: runs of letters by case, digits as 0, other characters as they are."""
    h = xxhash.xxh64_intdigest
    shape = _LETTERS.sub(lambda m: "A" if len(m[0]) > 1 and m[0].isupper() else "Aa" if m[0][0].isupper() else "a", w)
    shape = re.sub(r"\d+", "0", shape)
    found = h(w.lower()), h(shape, 1)
    if len(w) < 40:
        if len(_SEEN) >= CACHE:
            _SEEN.clear()
        _SEEN[w] = found
    return found


def features(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Hashed features and their values (log-scaled shares, so that a text's length does not matter much).

    Word 1-grams and 2-grams, 1- and 2-grams of word shapes, and whether words
    repeat the one before. Feature 0 is the constant, 1 is not used, 2 to 14
    tell the length.
    """
    words = text.split()
    n = len(words)
    if not n:
        return np.array([0, 2]), np.array([1.0, 0.2])
    got = list(map(_SEEN.get, words))
    if None in got:
        got = [_word(w) if g is None else g for w, g in zip(words, got, strict=True)]
    pairs = np.array(got, np.uint64)
    word, shape = pairs[:, 0], pairs[:, 1]
    odd = np.uint64(0x9E3779B97F4A7C15)
    with np.errstate(over="ignore"):
        repeats = (word[1:] == word[:-1]).astype(np.uint64)
        every = [word, shape * odd, (word[:-1] * odd) ^ word[1:], ((shape[:-1] * odd) ^ shape[1:]) * odd, (repeats + np.uint64(11)) * odd * odd]
        all_ = np.concatenate(every)
        at = (all_ * np.uint64(0xBF58476D1CE4E5B9)) >> np.uint64(64 - BITS)
    at, counts = np.unique(at.astype(np.int64), return_counts=True)
    values = np.log1p(counts * (100.0 / n)) * 0.2
    keep = at > 14
    size = np.array([0, 2 + min(int(np.log2(n)), 12)])
    return np.concatenate([size, at[keep]]), np.concatenate([[1.0, 0.2], values[keep]])


def in_bound(rows: DataFrame, most: int) -> pd.DataFrame:
    """rows (hash, doc_id, n, other columns) in order of hash and id, as far as their sizes n stay within the bound together."""
    sizes = rows.select("hash", "doc_id", "n").toPandas().sort_values(["hash", "doc_id"])
    fit = sizes[sizes["n"].cumsum() <= most]
    if not len(fit):
        return rows.limit(0).toPandas()
    last = fit.iloc[-1]
    chosen = rows.where((F.col("hash") < int(last["hash"])) | ((F.col("hash") == int(last["hash"])) & (F.col("doc_id") <= int(last["doc_id"]))))
    return chosen.toPandas().sort_values(["hash", "doc_id"], kind="stable")


def examples(labelled: DataFrame, label: str = "quality", most: int = FIT_FEATURES) -> tuple[list, np.ndarray]:
    """Features with values, and labels, of labelled (hash, doc_id, text, label), a sample that the caller has bounded; in order of hash."""
    chosen = labelled.select("hash", "doc_id", "text", F.col(label).cast("int").alias("label"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in (p for b in batches for p in parts(b)):
            rows = [features(t) for t in part.column(2).to_pylist()]
            raw = [pa.array([r[k].astype(kind).tobytes() for r in rows], pa.binary()) for k, kind in ((0, "<i4"), (1, "<f4"))]
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), part.column(3), pa.array([len(r[0]) for r in rows], pa.int64()), *raw], ["hash", "doc_id", "label", "n", "at", "value"])

    made = materialise(chosen.mapInArrow(tidy(run), "hash long, doc_id long, label int, n long, at binary, value binary"), "examples")
    read = in_bound(made, most)
    free(made)
    return [(np.frombuffer(a, "<i4").astype(np.int64), np.frombuffer(v, "<f4").astype(float)) for a, v in zip(read["at"], read["value"], strict=True)], read["label"].to_numpy(float)


def fit(labelled: DataFrame, label: str = "quality", epochs: int = 3) -> np.ndarray:
    """Weights from a bounded labelled sample; none labelled: zeros."""
    rows, labels = examples(labelled, label)
    return Ftrl(SIZE, alpha=0.3).fit(rows, labels, epochs).weights()


def held_out(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string")) % 5 == 0


def sample(labels: DataFrame, docs: DataFrame, names: list[str], rows: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """hash, doc_id, text and the named labels: the ids with the smallest hashes, one text each (the least). The side is bounded by rows, so it is broadcast.

    Rows with a null label or id are left out. Of labels that differ for one id the largest counts.
    """
    ids = labels.select(F.col(quoted(id_col)).cast("long").alias("doc_id"), *[F.col(quoted(n)).alias(n) for n in names]).dropna()
    ids = ids.groupBy("doc_id").agg(*[F.max(n).alias(n) for n in names]).select(F.xxhash64("doc_id").alias("hash"), "doc_id", *names)
    ids = ids.orderBy("hash", "doc_id").limit(rows)
    texts = docs.select(F.col(quoted(id_col)).cast("long").alias("doc_id"), text_or_empty(text_col).alias("text"))
    met = texts.join(F.broadcast(ids), "doc_id")
    return met.groupBy("hash", "doc_id", *names).agg(F.min("text").alias("text")).select("hash", "doc_id", "text", *names)


def score(docs: DataFrame, weights: np.ndarray, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, score: the sparse dot product of each text's features with the weights, through the logistic function.

    Null text scores as empty. Rows that repeat an id are scored each. Other
    columns are ignored, whatever their names.
    """
    shared = docs.sparkSession.sparkContext.broadcast(weights.astype(np.float32))  # 2 ** BITS numbers

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = shared.value
        for part in (p for b in batches for p in parts(b)):
            made = [float(sigmoid(w[at] @ value)) for at, value in map(features, part.column(1).to_pylist())]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(made, pa.float64())], ["doc_id", "score"])

    return docs.select(F.col(quoted(id_col)).cast("long").alias("doc_id"), text_or_empty(text_col).alias("text")).mapInArrow(tidy(run), "doc_id long, score double")


def classify(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, rows: int = FIT_ROWS) -> DataFrame:
    """doc_id, held_out, score, predicted for each row of docs, from a fit on the rows that are not held out.

    Null and empty texts score by their length alone; texts are read whole, in
    the fit and in the scores; an empty table gives no row, and without labels
    every score is 0.5. Rows that repeat an id are scored each, and count once
    in the fit. Only doc_id, text and the label are read, whatever other columns
    there are.
    """
    labelled = labels.select("doc_id", "quality").where(~held_out(F.col("doc_id")))
    scored = score(docs, fit(sample(labelled, docs, ["quality"], rows)))
    return scored.select("doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
