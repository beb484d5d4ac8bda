"""Ranked lexical search: postings ordered by impact, read score at a time until bounds prove the best k documents."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from math import floor, log

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from statuta.llm.common import free, materialise, parts, quoted, text_or_empty, tidy
from statuta.llm.terms import terms

#: (item, term) entries of a block of items; a block is what tasks get by broadcast.
BLOCK_TERMS = 1 << 20
#: Documents and postings of a shard, which a task holds at a time.
SHARD_DOCS, SHARD_POSTINGS = 16_384, 1_000_000
#: Shares of an item's postings after which the bounds are looked at.
STEPS = np.array([1 / 64, 1 / 32, 1 / 16, 1 / 8, 1 / 4, 1 / 2, 1.0])
#: A null id as a number: it comes last among equal scores.
NO_ID = np.iinfo(np.int64).max


class Block:
    """Some items: their terms (numbered by the vocabulary of the block) with repeats."""

    def __init__(self, rows: list):
        self.ids = [r["item_id"] for r in rows]
        self.vocabulary: dict[bytes, int] = {}
        number = self.vocabulary.setdefault
        self.terms = [np.array([number(bytes(t), len(self.vocabulary)) for t in r["terms"]], np.int64) for r in rows]
        self.times = [np.array(r["times"], np.int64) for r in rows]


class Shard:
    """Documents with their postings, by term in descending order of impact; postings of equal impact are a segment."""

    def __init__(self, ids: np.ndarray, sizes: np.ndarray, starts: np.ndarray, term: np.ndarray, tf: np.ndarray, weights: np.ndarray, n_docs: int, n_terms: int):
        m = 75 + (25 * sizes * n_docs) // n_terms
        doc = np.repeat(np.arange(len(ids)), np.diff(starts))
        self.ids, self.starts, self.term = ids, starts, term
        self.impact = weights[term] * ((1_000_000_000 * tf) // (1000 * tf + 12 * m[doc]))
        order = np.lexsort((-self.impact, term))
        self.doc, self.sorted = doc[order], self.impact[order]
        self.first = np.searchsorted(term[order], np.arange(len(weights) + 1))
        cuts = np.ones(len(order) + 1, bool)
        cuts[1:-1] = (np.diff(term[order]) != 0) | (np.diff(self.sorted) != 0)
        self.cuts = np.flatnonzero(cuts)  # where segments begin, and the end

    def exact(self, docs: np.ndarray, times: np.ndarray) -> np.ndarray:
        """The whole scores of some documents, from their own postings; times holds the item's repeats of each term."""
        n = self.starts[docs + 1] - self.starts[docs]
        ends = np.cumsum(n)
        at = np.arange(ends[-1] if len(ends) else 0) + np.repeat(self.starts[docs] - (ends - n), n)
        total = np.concatenate([[0], np.cumsum(times[self.term[at]] * self.impact[at])])
        return total[ends] - total[ends - n]

    def best(self, wanted: np.ndarray, times: np.ndarray, k: int, least: int) -> tuple[np.ndarray, np.ndarray]:
        """Documents (numbers) that may be among the best k with at least the score `least`, and their whole scores.

        Whole segments are added in descending order of what they give. What a
        document can still gain is at most the sum of the terms' next segments:
        once that is below the k-th score so far, a document without a score
        cannot come in any more, and those that can get their scores completed.
        """
        have = self.first[wanted + 1] > self.first[wanted]
        ids, q = wanted[have], times[have]
        begin, end = self.first[ids], self.first[ids + 1]
        at = begin.copy()
        top = np.where(at < end, q * self.sorted[np.minimum(at, len(self.sorted) - 1)], 0) if len(ids) else np.zeros(0, np.int64)
        if top.sum() < max(least, 1):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        lo, hi = np.searchsorted(self.cuts, begin), np.searchsorted(self.cuts, end)
        owner = np.repeat(np.arange(len(ids)), hi - lo)
        seg = np.arange(len(owner)) + np.repeat(lo - np.concatenate([[0], np.cumsum(hi - lo)[:-1]]), hi - lo)
        gives = q[owner] * self.sorted[self.cuts[seg]]
        order = np.argsort(-gives, kind="stable")
        owner, stop = owner[order], self.cuts[seg + 1][order]
        read = np.cumsum(stop - self.cuts[seg][order])
        score = np.zeros(len(self.ids), np.int64)
        done, kth = 0, least
        for to in np.unique(np.searchsorted(read, STEPS * read[-1]) + 1):
            upto = at.copy()
            np.maximum.at(upto, owner[done:to], stop[done:to])
            for t in np.flatnonzero(upto > at):
                score[self.doc[at[t] : upto[t]]] += q[t] * self.sorted[at[t] : upto[t]]
            at, done = upto, to
            rest = int(np.where(at < end, q * self.sorted[np.minimum(at, len(self.sorted) - 1)], 0).sum())
            if len(score) >= k:
                kth = max(kth, int(np.partition(score, len(score) - k)[len(score) - k]))
            if rest < kth or not rest:
                break
        docs = np.flatnonzero(score + rest >= max(kth, 1))
        if not rest:
            return docs, score[docs]
        every = np.zeros(len(self.first) - 1, np.int64)
        every[ids] = q
        return docs, self.exact(docs, every)


def _blocks(items: DataFrame, item_col: str, text_col: str, most: int) -> Iterator[Block]:
    """The items, each different row once, in blocks of about `most` terms."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in (p for b in batches for p in parts(b)):
            counts = [Counter(terms(t)) for t in part.column(1).cast(pa.binary()).to_pylist()]
            told = [list(c) for c in counts], [list(c.values()) for c in counts], [len(c) for c in counts]
            kinds = pa.list_(pa.binary()), pa.list_(pa.int64()), pa.int64()
            yield pa.RecordBatch.from_arrays([part.column(0), *map(pa.array, told, kinds), part.column(2)], ["item_id", "terms", "times", "n", "h"])

    rows = items.select(F.col(quoted(item_col)).cast("long").alias("item_id"), text_or_empty(text_col).alias("text")).distinct()
    made = rows.withColumn("h", F.xxhash64("item_id", "text")).mapInArrow(tidy(run), "item_id long, terms array<binary>, times array<long>, n long, h long")
    made = materialise(made.where("n > 0"), "items")
    total = made.agg(F.sum("n")).first()[0] or 0
    blocks = -(-total // most)
    for b in range(blocks):
        rows = made.where(F.pmod("h", F.lit(blocks)) == b).select("item_id", "terms", "times").collect()
        if rows:
            yield Block(sorted(rows, key=lambda r: (r["item_id"] is None, r["item_id"] or 0)))
    free(made)


def _postings(docs: DataFrame, block: Block) -> DataFrame:
    """doc_id, n (its terms), term (numbers), tf, of documents with a term; a term that no item has is counted only."""
    shared = docs.sparkSession.sparkContext.broadcast(block.vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for part in (p for b in batches for p in parts(b)):
            sizes, numbers, repeats = [], [], []
            for text in part.column(1).cast(pa.binary()).to_pylist():
                found = terms(text)
                counts = Counter(found)
                mine = [(known[t], c) for t, c in counts.items() if t in known]
                sizes.append(len(found))
                numbers.append([t for t, _ in mine])
                repeats.append([c for _, c in mine])
            kinds = pa.int64(), pa.list_(pa.int32()), pa.list_(pa.int32())
            yield pa.RecordBatch.from_arrays([part.column(0), *map(pa.array, (sizes, numbers, repeats), kinds)], ["doc_id", "n", "term", "tf"])

    return docs.mapInArrow(tidy(run), "doc_id long, n long, term array<int>, tf array<int>").where("n > 0")


def _ranked(postings: DataFrame, block: Block, weights: np.ndarray, n_docs: int, n_terms: int, k: int) -> DataFrame:
    """item (its place in the block), doc_id, score: of each task the best k of each item."""
    shared = postings.sparkSession.sparkContext.broadcast((block.terms, block.times, weights))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted, times, w = shared.value
        best = [(np.zeros(0, np.int64), np.zeros(0, np.int64))] * len(wanted)  # scores, ids
        held: list[pa.RecordBatch] = []

        def settle() -> None:
            rows = pa.Table.from_batches(held).combine_chunks()
            held.clear()
            flat = rows.column("term").combine_chunks()
            starts = flat.offsets.to_numpy().astype(np.int64)
            ids = rows.column("doc_id").fill_null(NO_ID).to_numpy()
            tf = rows.column("tf").combine_chunks().flatten().to_numpy().astype(np.int64)
            shard = Shard(ids, rows.column("n").to_numpy(), starts - starts[0], flat.flatten().to_numpy().astype(np.int64), tf, w, n_docs, n_terms)
            for i, (terms_, times_) in enumerate(zip(wanted, times, strict=True)):
                scores, ids = best[i]
                docs, new = shard.best(terms_, times_, k, int(scores[-1]) if len(scores) == k else 0)
                docs, new = docs[new > 0], new[new > 0]
                if len(docs):
                    scores, ids = np.concatenate([scores, new]), np.concatenate([ids, shard.ids[docs]])
                    order = np.lexsort((ids, -scores))[:k]
                    best[i] = scores[order], ids[order]

        docs = postings_ = 0
        for part in (p for b in batches for p in parts(b)):
            held.append(part)
            docs, postings_ = docs + part.num_rows, postings_ + len(part.column(2).flatten())
            if docs >= SHARD_DOCS or postings_ >= SHARD_POSTINGS:
                settle()
                docs = postings_ = 0
        if held:
            settle()
        item = np.repeat(np.arange(len(best)), [len(s) for s, _ in best])
        scores, ids = (np.concatenate([b[c] for b in best]) if best else np.zeros(0, np.int64) for c in (0, 1))
        yield pa.RecordBatch.from_arrays([pa.array(item), pa.array(ids, mask=ids == NO_ID), pa.array(scores)], ["item", "doc_id", "score"])

    return postings.mapInArrow(tidy(run), "item long, doc_id long, score long")


def search(docs: DataFrame, items: DataFrame, k: int = 20, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", block_terms: int = BLOCK_TERMS) -> DataFrame:
    """item_id, rank, doc_id, score: the k best documents of each item, by score and then by the smallest id (null last).

    Items come in blocks of about block_terms terms; a block's vocabulary is
    what a task gets, so its size is bounded whatever the number of items. One
    pass over the texts writes the postings of the block's terms, from which
    Spark counts documents, terms and document frequencies. Then each task cuts
    its documents into shards, orders a shard's postings by impact, and reads
    whole segments of equal impact, the highest first, until the bounds of the
    rest prove that no other document can be among the best k; the k-th score of
    the task's shards so far is a bound too. A task hands on k documents of each
    item at most, and a window ranks them. No term's postings meet in one place.

    Scores: w is floor(1000 ln((2 N + 2) / (2 df + 1))), m is 75 + 25 n N div L,
    and a term gives w ((10^9 tf) div (1000 tf + 12 m)) each time that the item
    has it. Null and empty texts, and others without a term, count nowhere.
    Texts are read whole. Rows that repeat an id are ranked each; equal rows of
    items count once, rows of one item_id with different texts are ranked each.
    Without documents or items there is no row. Other columns are ignored,
    whatever their names.
    """
    spark = docs.sparkSession
    texts = docs.select(F.col(quoted(id_col)).cast("long").alias("doc_id"), text_or_empty(text_col).alias("text"))
    found = []
    for block in _blocks(items, item_col, item_text_col, block_terms):
        postings = materialise(_postings(texts, block), "postings")
        n_docs, n_terms = postings.agg(F.count(F.lit(1)), F.sum("n")).first()
        seen = np.zeros(len(block.vocabulary), np.int64)
        for term, df in postings.select(F.explode("term").alias("term")).groupBy("term").count().collect():  # as many rows as the block has terms
            seen[term] = df
        weights = np.array([floor(1000 * log((2 * n_docs + 2) / (2 * int(df) + 1))) for df in seen], np.int64)
        tops = materialise(_ranked(postings, block, weights, n_docs, n_terms or 1, k), "tops")
        free(postings)
        order = Window.partitionBy("item").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last())
        ranked = tops.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
        names = spark.createDataFrame(list(enumerate(block.ids)), "item long, item_id long")
        found.append(ranked.join(names, "item").select("item_id", "rank", "doc_id", "score"))
    made = found[0] if found else spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    for more in found[1:]:
        made = made.union(more)
    return made


ORACLE = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents
), b AS (
  SELECT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark
), q AS (
  SELECT item_id, term, count(*) AS times FROM b GROUP BY item_id, term
), s AS (
  SELECT count(*) AS docs, CAST(sum(len(w)) AS BIGINT) AS words FROM d WHERE len(w) > 0
), p AS (
  SELECT doc_id, term, any_value(n) AS n, count(*) AS tf
  FROM (SELECT doc_id, len(w) AS n, unnest(w) AS term FROM d) AS e
  WHERE term IN (SELECT term FROM q) GROUP BY doc_id, term
), f AS (
  SELECT term, CAST(floor(1000 * ln((2 * docs + 2) / (2 * df + 1))) AS BIGINT) AS weight
  FROM (SELECT term, count(*) AS df FROM p GROUP BY term) AS c, s
), scored AS (
  SELECT item_id, doc_id, CAST(sum(times * weight * ((1000000000 * tf) // (1000 * tf + 12 * (100 - 25 + (25 * n * docs) // words)))) AS BIGINT) AS score
  FROM q JOIN p USING (term) JOIN f USING (term), s GROUP BY item_id, doc_id
), ranked AS (
  SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score FROM scored WHERE score > 0
)
SELECT item_id, rank, doc_id, score FROM ranked WHERE rank <= 20
"""
