"""Substring dedup: documents cut into blocks at anchors, which are looked up in an index of all blocks.

Anchor blocks and equi-joins on hashes take the place of a greedy parse into
longest factors, which needs the whole reference at hand to extend a match.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from statuta.llm.common import free, materialise, packed, parts, tidy, unpacked

GRAM = 8  # words in an anchor
ODD = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB)


def word_hashes(words: list[bytes]) -> np.ndarray:
    h = xxhash.xxh64_intdigest
    return np.array([h(w, 7) for w in words], np.uint64)


def _join(a: np.ndarray, b: np.ndarray, k: int) -> np.ndarray:
    x = a * np.uint64(ODD[k % 6]) + b
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(32)
    return x


def run_hashes(h: np.ndarray, width: int, salt: int = 0) -> np.ndarray:
    """A hash of each run of width words, from runs of 1, 2, 4, ... words."""
    n = len(h) - width + 1
    if n <= 0:
        return h[:0]
    made, size, step, at = None, 1, h, 0
    k = salt
    while True:
        if width & size:
            part = step[at : at + n]
            made = part if made is None else _join(made, part, k)
            at += size
        k += 1
        size *= 2
        if size > width:
            return made
        step = _join(step[: -size // 2], step[size // 2 :], k)


def blocks(h: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """First and last window of each block, its anchor's hash, and the hash of all its words with the anchor's place in them.

    A window's anchor is the smallest hash of its GRAM-word runs, the leftmost of
    equals; a block is a row of neighbouring windows with one anchor. Equal
    windows have equal anchors wherever they stand.
    """
    n = len(h) - width + 1
    grams = run_hashes(h, GRAM)
    span = width - GRAM + 1
    least, size = grams, 1
    while size * 2 <= span:
        least = np.minimum(least[:-size], least[size:])
        size *= 2
    least = np.minimum(least[:n], least[span - size : span - size + n])
    # Equal hashes have ascending places in this order, so the leftmost place of the least hash in a window is found by a search on (rank, place).
    order = np.argsort(grams, kind="stable")
    ranked = grams[order]
    first = np.searchsorted(ranked, least, "left")
    key = np.searchsorted(ranked, ranked, "left").astype(np.int64) * (len(grams) + 1) + order
    at = order[np.searchsorted(key, first.astype(np.int64) * (len(grams) + 1) + np.arange(n))]
    cuts = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
    lasts = np.concatenate([cuts[1:] - 1, [n - 1]])
    anchors = at[cuts]
    windows = run_hashes(h, width, 3)
    sizes = lasts - cuts + 1
    odd = np.uint64(ODD[1])
    power = np.ones(int(sizes.max()), np.uint64)
    if len(power) > 1:
        power[1:] = np.cumprod(np.full(len(power) - 1, odd, np.uint64))
    inside = np.arange(n) - np.repeat(cuts, sizes)
    whole = np.add.reduceat(windows * power[inside], cuts)
    whole = _join(whole, (sizes * 64 + (anchors - cuts)).astype(np.uint64), 4)
    return cuts, lasts, grams[anchors], whole


def window_hashes(h: np.ndarray, width: int) -> np.ndarray:
    return run_hashes(h, width, 3)


def _words(text: str) -> list[bytes]:
    return text.encode().split()  # bytes split at ASCII white space only


def duplicate_windows(docs: DataFrame, width: int = 35) -> DataFrame:
    """doc_id, text_key, spans: the merged word spans [first, end) under windows that start more than once in docs (doc_id, text_key, text).

    1. Each document is parsed into blocks of windows with one anchor; anchors
       that occur once in the corpus index are no reference and leave.
    2. A block that equals another reference block as a whole is one long
       factor, all of whose windows repeat; neighbouring ones grow together.
    3. At factor boundaries, blocks share an anchor but not their extent. There,
       and in one example of each equal block with that anchor, the windows
       themselves are compared, by anchor and window hash (128 bits together).
    """

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with np.errstate(over="ignore"):
            for batch in batches:
                for lo in range(0, batch.num_rows, 64):
                    ids, keys, found = [], [], []
                    part = batch.slice(lo, 64)
                    for i, (key, text) in enumerate(zip(part.column(1).to_pylist(), part.column(2).to_pylist(), strict=True)):
                        h = word_hashes(_words(text))
                        if len(h) >= width:
                            cuts, lasts, anchors, whole = blocks(h, width)
                            found.append((cuts, lasts, anchors, whole))
                            ids += [i] * len(cuts)
                            keys += [key] * len(cuts)
                    if found:
                        cuts, lasts, anchors, whole = (np.concatenate(c) for c in zip(*found, strict=True))
                        yield pa.RecordBatch.from_arrays(
                            [part.column(0).take(pa.array(ids)), pa.array(keys, pa.int64()), pa.array(anchors.view(np.int64)), pa.array(whole.view(np.int64)), pa.array(cuts.astype(np.int32)), pa.array((lasts - cuts + 1).astype(np.int16))],
                            ["doc_id", "text_key", "anchor", "whole", "first", "n"],
                        )

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with np.errstate(over="ignore"):
            for batch in batches:
                for lo in range(0, batch.num_rows, 64):
                    part = batch.slice(lo, 64)
                    rows, anchors, starts, windows = [], [], [], []
                    for i, (text, todo) in enumerate(zip(part.column(2).to_pylist(), part.column(3).to_pylist(), strict=True)):
                        hashes = window_hashes(word_hashes(_words(text)), width)
                        first = np.array([x["first"] for x in todo], np.int64)
                        n = np.array([x["n"] for x in todo], np.int64)
                        at = np.repeat(first - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
                        rows.append(np.full(len(at), i))
                        anchors.append(np.repeat(np.array([x["anchor"] for x in todo], np.int64), n))
                        starts.append(at)
                        windows.append(hashes[at].view(np.int64))
                    take = pa.array(np.concatenate(rows))
                    yield pa.RecordBatch.from_arrays(
                        [part.column(0).take(take), part.column(1).take(take), pa.array(np.concatenate(anchors)), pa.array(np.concatenate(windows)), pa.array(np.concatenate(starts).astype(np.int32))],
                        ["doc_id", "text_key", "anchor", "window", "first"],
                    )

    parsed = materialise(docs.select("doc_id", "text_key", "text").mapInArrow(tidy(parse), "doc_id long, text_key long, anchor long, whole long, first int, n short"), "blocks")
    index = parsed.groupBy("anchor").agg(F.count(F.lit(1)).alias("hits")).where("hits > 1").select("anchor")
    index = materialise(index, "index")  # a table of its own, so that AQE can split the join's hot anchors
    shared = materialise(parsed.join(index, "anchor"), "shared")
    wholes = shared.groupBy("anchor", "whole").agg(F.count(F.lit(1)).alias("copies"), F.min(F.struct("doc_id", "text_key", "first", "n")).alias("one"))
    wholes = materialise(wholes, "wholes")
    repeated = wholes.where("copies > 1").select("anchor", "whole")
    long_factors = shared.join(repeated, ["anchor", "whole"]).select("doc_id", "text_key", "first", (F.col("first") + F.col("n") + (width - 1)).alias("end"))
    mixed = wholes.groupBy("anchor").agg(F.count(F.lit(1)).alias("kinds")).where("kinds > 1").select("anchor")
    mixed = materialise(mixed, "mixed")
    todo = wholes.join(mixed, "anchor").select("one.doc_id", "one.text_key", F.struct("anchor", "one.first", "one.n").alias("block"))
    by_doc = todo.groupBy("doc_id", "text_key").agg(F.collect_list("block").alias("blocks"))
    ask = by_doc.select(F.col("doc_id").alias("_id"), F.col("text_key").alias("_key"), "blocks")
    opened = docs.join(ask, docs.doc_id.eqNullSafe(F.col("_id")) & (docs.text_key == F.col("_key"))).select("doc_id", "text_key", "text", "blocks")
    windows = materialise(opened.mapInArrow(tidy(compare), "doc_id long, text_key long, anchor long, window long, first int"), "windows")
    again = windows.groupBy("anchor", "window").agg(F.count(F.lit(1)).alias("hits")).where("hits > 1").select("anchor", "window")
    again = materialise(again, "again")
    short_factors = windows.join(again, ["anchor", "window"]).select("doc_id", "text_key", "first", (F.col("first") + width).alias("end"))
    spans = long_factors.union(short_factors).groupBy("doc_id", "text_key").agg(F.array_sort(F.collect_set(F.struct("first", "end"))).alias("spans"))
    spans = materialise(spans, "spans")
    free(parsed, index, shared, wholes, mixed, windows, again)
    return spans


def judged(docs: DataFrame, width: int = 35, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """row (all columns of docs as a struct), spans, n_words, n_removed, kept_text; see dedup_substrings()."""
    packed_rows = docs.select(packed(docs).alias("row"))
    doc_id, text = F.col("row").getField(id_col).cast("long"), F.coalesce(F.col("row").getField(text_col), F.lit(""))
    spans = duplicate_windows(packed_rows.select(doc_id.alias("doc_id"), F.xxhash64(text).alias("text_key"), text.alias("text")), width)
    found = packed_rows.join(spans, doc_id.eqNullSafe(F.col("doc_id")) & (F.xxhash64(text) == F.col("text_key")), "left").select("row", "spans")
    place = [f.name for f in found.schema["row"].dataType.fields].index(text_col)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in (p for batch in batches for p in parts(batch, 64)):
            counts, gone, kept = [], [], []
            for text, spans in zip(part.column(0).field(place).to_pylist(), part.column(1).to_pylist(), strict=True):
                words = _words(text or "")
                at, removed, stay = 0, 0, []
                for s in spans or ():
                    if s["first"] > at:
                        stay += words[at : s["first"]]
                    removed += max(0, s["end"] - max(at, s["first"]))
                    at = max(at, s["end"])
                stay += words[at:]
                counts.append(len(words))
                gone.append(removed)
                kept.append(b" ".join(stay).decode())
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(counts, pa.int64()), pa.array(gone, pa.int64()), pa.array(kept, pa.string())], ["row", "spans", "n_words", "n_removed", "kept_text"])

    added = [T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("kept_text", T.StringType())]
    return found.mapInArrow(tidy(cut), T.StructType([*found.schema.fields, *added]))


def dedup_substrings(docs: DataFrame, width: int = 35, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs with their columns and spans, n_words, n_removed, kept_text (kept words, joined by one space).

    A word goes if a window of width words over it also starts anywhere else in
    the input, the same document included; all copies of a passage go. Words
    are split at ASCII white space and compared unchanged. Null and empty texts
    have no words; texts are read whole; an empty table stays empty. Rows that
    repeat an id are cut each; equal rows repeat one another. Added columns
    replace columns of the same name; no other name matters.
    """
    made = judged(docs, width, id_col, text_col)
    return made.select(*unpacked(made, "spans", "n_words", "n_removed", "kept_text"))


ORACLE = r"""
WITH d AS (
  SELECT doc_id, [x FOR x IN regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+') IF x <> ''] AS w FROM documents
), s AS (
  SELECT doc_id, w, unnest(range(1, len(w) - 33)) AS i FROM d WHERE len(w) >= 35
), c AS (
  SELECT doc_id, i, count(*) OVER (PARTITION BY array_to_string(list_slice(w, i, i + 34), ' ')) AS hits FROM s
), gone AS (
  SELECT DISTINCT doc_id, unnest(range(i, i + 35)) AS pos FROM c WHERE hits > 1
), words AS (
  SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS pos FROM d
), kept AS (
  SELECT doc_id, string_agg(word, ' ' ORDER BY pos) AS text FROM words ANTI JOIN gone USING (doc_id, pos) GROUP BY doc_id
), lost AS (
  SELECT doc_id, count(*) AS n FROM gone GROUP BY doc_id
)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(lost.n, 0)::BIGINT AS n_removed, sha256(coalesce(kept.text, '')) AS kept_sha256
FROM d LEFT JOIN kept ON kept.doc_id = d.doc_id LEFT JOIN lost ON lost.doc_id = d.doc_id
"""
