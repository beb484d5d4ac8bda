"""Target-distribution importance resampling: array-scored weights, sorted runs merged by tournament trees, an exact draw."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain
from math import floor, log

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from statuta.llm.common import free, materialise, parts, quoted, text_or_empty, tidy
from statuta.llm.terms import Buckets, terms

#: Rows of a sorted run, which a task holds at a time, and of a range of the order, which a merge holds.
RUN_ROWS, RANGE_ROWS = 1 << 18, 1 << 18


def buckets(text: bytes, width: int, known: Buckets) -> np.ndarray:
    """The bucket of each run of 1 to width consecutive words, joined by a space; repeats stay."""
    words = terms(text)
    grams = (words if n == 1 else map(b" ".join, zip(*(words[i:] for i in range(n)), strict=False)) for n in range(1, width + 1))
    return np.array(list(map(known.__getitem__, chain.from_iterable(grams))), np.int64)


def totals(texts: DataFrame, size: int, width: int) -> np.ndarray:
    """How many features of all texts (text) fall into each bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, total = Buckets(size), np.zeros(size, np.int64)
        for part in (p for b in batches for p in parts(b)):
            for text in part.column(0).cast(pa.binary()).to_pylist():
                total += np.bincount(buckets(text, width, known), minlength=size)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["bucket", "n"])

    found = np.zeros(size, np.int64)
    for at, n in texts.mapInArrow(tidy(run), "bucket long, n long").groupBy("bucket").agg(F.sum("n")).collect():  # a row for each bucket
        found[at] = n
    return found


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 ln((t + 1)(S + size) / ((s + 1)(T + size)))) of each bucket."""
    whole, wanted, size = float(corpus.sum()), float(target.sum()), len(corpus)
    return np.array([floor(1000 * log((t + 1.0) * (whole + size) / ((s + 1.0) * (wanted + size)))) for s, t in zip(corpus.tolist(), target.tolist(), strict=True)], np.int64)


def noise(doc_id: Column, seed: int) -> Column:
    """floor(-1000 ln(-ln((h + 0.5) / 2 ** 32))), h from the first 8 hex digits of SHA-256; a null id counts as an empty text."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("long")
    return F.floor(F.lit(-1000.0) * F.log(-F.log((h + F.lit(0.5)) / F.lit(4294967296.0)))).cast("long")


def weighted(docs: DataFrame, target: DataFrame, size: int, width: int, seed: int) -> DataFrame:
    """doc_id, n_words, n_features, weight, score for each row of docs (doc_id, text)."""
    own = docs.sparkSession.sparkContext.broadcast(gains(totals(docs.select("text"), size, width), totals(target, size, width)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, gain = Buckets(size), own.value
        for part in (p for b in batches for p in parts(b)):
            made = [(len(at), int(gain[at].sum())) for at in (buckets(t, width, known) for t in part.column(1).cast(pa.binary()).to_pylist())]
            words = [n if width == 1 else len(terms(t)) for (n, _), t in zip(made, part.column(1).cast(pa.binary()).to_pylist(), strict=True)]
            weights = [total // n if n else 0 for n, total in made]
            columns = [part.column(0), *(pa.array(c, pa.int64()) for c in (words, [n for n, _ in made], weights))]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_words", "n_features", "weight"])

    made = docs.select("doc_id", "text").mapInArrow(tidy(run), "doc_id long, n_words long, n_features long, weight long")
    return made.withColumn("score", F.col("weight") + noise(F.col("doc_id"), seed))


class Tournament:
    """A tree of losers over sorted runs: each match is played once, and only the winner's path is played again."""

    def __init__(self, runs: list[list[tuple]]):
        self.runs = runs
        self.at = [0] * len(runs)
        self.losers = [0] * max(1, len(runs))
        self.winner = self._play(1) if len(runs) > 1 else 0

    def _head(self, run: int) -> tuple | None:
        return self.runs[run][self.at[run]] if self.at[run] < len(self.runs[run]) else None

    def _beats(self, a: int, b: int) -> bool:
        x, y = self._head(a), self._head(b)
        return x is not None and (y is None or x <= y)

    def _play(self, node: int) -> int:
        """The winner below a node; its children are 2 node and 2 node + 1, and leaves are numbered from len(runs)."""
        order, stack = [], [node]
        while stack:
            n = stack.pop()
            if n < len(self.runs):
                order.append(n)
                stack += [2 * n, 2 * n + 1]
        won: dict[int, int] = {}
        for n in reversed(order):
            a, b = (won.pop(c) if c < len(self.runs) else c - len(self.runs) for c in (2 * n, 2 * n + 1))
            won[n], self.losers[n] = (a, b) if self._beats(a, b) else (b, a)
        return won[node]

    def pop(self) -> tuple | None:
        """The next row of all runs in order; None at the end."""
        if not self.runs or (row := self._head(self.winner)) is None:
            return None
        run = self.winner
        self.at[run] += 1
        node = (run + len(self.runs)) // 2
        while node:
            if self._beats(self.losers[node], run):
                run, self.losers[node] = self.losers[node], run
            node //= 2
        self.winner = run
        return row


_RUN = "doc_id long, n_features long, weight long, score long, run long, at long"


def runs(rows: DataFrame) -> DataFrame:
    """Rows (doc_id, n_features, weight, score) in sorted runs of at most RUN_ROWS rows, several to a task: with run and at, the place in the run."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        run, held, n = TaskContext.get().partitionId() << 32, [], 0

        def cut() -> pa.RecordBatch:
            found = pa.Table.from_batches(held).sort_by([("score", "descending"), ("doc_id", "ascending"), ("n_features", "ascending"), ("weight", "ascending")])
            columns = [c.combine_chunks() for c in found.columns]
            return pa.RecordBatch.from_arrays([*columns, pa.array(np.full(len(found), run)), pa.array(np.arange(len(found)))], ["doc_id", "n_features", "weight", "score", "run", "at"])

        for part in (p for b in batches for p in parts(b, 1 << 14)):
            held.append(part)
            n += part.num_rows
            if n >= RUN_ROWS:
                yield cut()
                run, held, n = run + 1, [], 0
        if n:
            yield cut()

    return rows.select("doc_id", "n_features", "weight", "score").mapInArrow(tidy(make), _RUN)


def draw(rows: DataFrame, percent: int, eligible: Column) -> DataFrame:
    """doc_id, n_features, weight, score and rank for each of rows, a written table: of the N eligible rows the floor(percent N / 100) of highest score, ties to the smaller id, have ranks 1, 2, 3...

    Scores are whole numbers in a range that logarithms bound (about 10^5 of
    them), so counts by score go to the driver and say which score is the last
    that is drawn from. Only rows from there up become runs. Runs are dealt by
    ranges of (score, id, run, place), a key that no two rows share, so a score
    or an id that many rows share is split too. Counts by range give each range
    its first rank and how many rows it has to give; there the runs' parts are
    merged until that many are out.
    """
    spark = rows.sparkSession
    counts = sorted((tuple(r) for r in rows.where(eligible).groupBy("score").count().collect()), reverse=True)
    wanted = percent * sum(n for _, n in counts) // 100
    out = rows.select("doc_id", "n_features", "weight", "score", F.lit(None).cast("long").alias("rank"))
    if not wanted:
        return out
    upto = np.cumsum([n for _, n in counts])
    last = int(np.searchsorted(upto, wanted))
    among = eligible & (F.col("score") >= counts[last][0])
    ranges = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-int(upto[last]) // RANGE_ROWS))
    order = [F.col("score").desc(), F.col("doc_id").asc_nulls_last(), F.col("run"), F.col("at")]
    dealt = materialise(runs(rows.where(among)).repartitionByRange(ranges, *order).withColumn("range", F.spark_partition_id()), "runs")
    sizes = sorted(tuple(r) for r in dealt.groupBy("range").count().collect())  # a number for each range
    before = dict(zip((r for r, _ in sizes), (np.cumsum([n for _, n in sizes]) - [n for _, n in sizes]).tolist(), strict=True))

    def merge(table: pa.Table) -> pa.Table:
        table = table.sort_by([("run", "ascending"), ("at", "ascending")])
        score, run, doc_id = (table.column(c).to_pylist() for c in ("score", "run", "doc_id"))
        keys = [(-s, d is None, d or 0, r, k) for k, (s, d, r) in enumerate(zip(score, doc_id, run, strict=True))]
        cuts = [0, *(np.flatnonzero(np.diff(table.column("run").to_numpy())) + 1).tolist(), len(keys)]
        tree = Tournament([keys[a:b] for a, b in zip(cuts, cuts[1:], strict=False)])
        first = before[table.column("range")[0].as_py()]
        rank: list[int | None] = [None] * len(keys)
        for n in range(first + 1, min(first + len(keys), wanted) + 1):
            rank[tree.pop()[-1]] = n
        return table.select(["doc_id", "n_features", "weight", "score"]).append_column("rank", pa.array(rank, pa.int64()))

    merged = dealt.groupBy("range").applyInArrow(merge, "doc_id long, n_features long, weight long, score long, rank long")
    return out.where(~F.coalesce(among, F.lit(False))).union(merged)


def resample(docs: DataFrame, target: DataFrame, percent: int = 10, least_words: int = 20, size: int = 10_000, width: int = 1, seed: int = 2024, id_col: str = "doc_id", text_col: str = "text", target_text_col: str = "text") -> DataFrame:
    """doc_id, n_features, weight, score, rank for each row of docs; rank is null if the row is not drawn.

    weight is the floored mean gain of the row's features, hashed word runs, by
    their shares in the target's texts and in docs; score adds Gumbel noise, so
    that the highest scores are a draw without replacement in proportion to the
    weights. Drawn are floor(percent / 100) of the rows with at least
    least_words words. Two passes read the texts: one counts buckets, one adds up
    an array of gains.

    Null and empty texts have no feature and weight 0; texts are read whole.
    Rows that repeat an id are judged each, with equal noise; equal scores go by
    id (null last), then in any order of rows that agree in both. An empty table
    gives no row; an empty target leaves the corpus' own shares. Other columns
    are ignored, whatever their names.
    """
    texts = docs.select(F.col(quoted(id_col)).cast("long").alias("doc_id"), text_or_empty(text_col).alias("text"))
    rows = materialise(weighted(texts, target.select(text_or_empty(target_text_col).alias("text")), size, width, seed), "weights")
    return draw(rows, percent, F.col("n_words") >= least_words)
