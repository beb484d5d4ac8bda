"""Sets of word shingles: their names, SimHash fingerprints, bands of least hashes, and exact similarity."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from statuta.llm.common import mix, parts, tidy

#: The similarity from which on sets are linked, as a fraction.
LEVEL = (4, 5)
#: Bands of least hashes, and hashes in a band, at that level. A pair at 0.8 shares no band with probability (1 - 0.8 ** 5) ** 48 = 5e-9, above it with less.
BANDS, ROWS = 48, 5
#: Bound of that probability at every level.
MISSED = 6e-9
_RANDOM = np.random.default_rng(42)
ODDS = _RANDOM.integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
FLIPS = _RANDOM.integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64)


def layout(level: tuple[int, int] = LEVEL) -> tuple[int, int]:
    """Bands, and hashes in a band: as many hashes in a band as the BANDS * ROWS hashes allow while a pair at the level shares no band with a probability under MISSED."""
    p = level[0] / level[1]
    if not 0 < p <= 1:
        raise ValueError(f"no similarity between 0 and 1: {level}")
    fit = [r for r in range(1, BANDS * ROWS + 1) if (1 - p**r) ** (BANDS * ROWS // r) < MISSED]
    if not fit:
        raise ValueError(f"similarity {level} needs more than {BANDS * ROWS} bands")
    return next(b for b in range(1, BANDS * ROWS + 1) if (1 - p ** fit[-1]) ** b < MISSED), fit[-1]


def shingle_set(text: str | None, width: int = 5) -> np.ndarray:
    """The distinct XXH64 of the word shingles, ascending; a shorter text is one shingle, no word: none."""
    words = (text or "").encode().lower().split()  # bytes: lower() and split() know ASCII only
    if not words:
        return np.zeros(0, np.uint64)
    line = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = np.concatenate([[0], ends[:-1]])
    n = max(1, len(words) - width + 1)
    h = xxhash.xxh64_intdigest
    return np.unique(np.fromiter((h(line[s:e], 42) for s, e in zip(starts[:n].tolist(), (ends[-n:] - 1).tolist(), strict=True)), np.uint64, n))


def band_keys(shingles: np.ndarray, bands: int = BANDS, rows: int = ROWS) -> np.ndarray:
    """One key for each band of least hashes; none for an empty set."""
    if not len(shingles):
        return np.zeros(0, np.int64)
    n = bands * rows
    least = np.full(n, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(shingles), 512):
        part = (shingles[None, at : at + 512] ^ FLIPS[:n, None]) * ODDS[:n, None]
        least = np.minimum(least, part.min(axis=1))
    keys = np.arange(bands, dtype=np.uint64)
    for column in least.reshape(bands, rows).T:
        keys = mix(keys, column, 0x9E3779B97F4A7C15)
    return keys.view(np.int64)


def _set_id(shingles: np.ndarray) -> int:
    return int(np.uint64(xxhash.xxh64_intdigest(shingles.tobytes(), 42)).astype(np.int64))


def bits(shingles: np.ndarray) -> int:
    """The SimHash fingerprint of a set, as a signed number: a bit is 1 if set in over half of the hashes."""
    if not len(shingles):
        return 0
    counts = np.zeros(64, np.int64)
    for lo in range(0, len(shingles), 1 << 16):
        counts += np.unpackbits(shingles[lo : lo + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(counts * 2 > len(shingles), bitorder="little").view("<i8")[0])


def sketches(rows: DataFrame, width: int, level: tuple[int, int] = LEVEL) -> DataFrame:
    """doc_id, h1, h2 of rows (with text), node (names the shingle set), n (its size), fp (its SimHash fingerprint), keys (of its bands at the level)."""
    bands, deep = layout(level)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in (p for b in batches for p in parts(b)):
            sets = [shingle_set(t, width) for t in part.column(3).to_pylist()]
            made = [pa.array([_set_id(s) for s in sets], pa.int64()), pa.array([len(s) for s in sets], pa.int64()), pa.array([bits(s) for s in sets], pa.int64()), pa.array([band_keys(s, bands, deep) for s in sets], pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays([*part.columns[:3], *made], ["doc_id", "h1", "h2", "node", "n", "fp", "keys"])

    return rows.select("doc_id", "h1", "h2", "text").mapInArrow(tidy(run), "doc_id long, h1 long, h2 long, node long, n long, fp long, keys array<long>")


def sets_of(rows: DataFrame, width: int) -> DataFrame:
    """node, n, fp, shingles of rows (text): one row for each set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in (p for b in batches for p in parts(b)):
            sets = [shingle_set(t, width) for t in part.column(0).to_pylist()]
            made = [pa.array([_set_id(s) for s in sets], pa.int64()), pa.array([len(s) for s in sets], pa.int64()), pa.array([bits(s) for s in sets], pa.int64()), pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(made, ["node", "n", "fp", "shingles"])

    return rows.select("text").mapInArrow(tidy(run), "node long, n long, fp long, shingles array<long>").dropDuplicates(["node"])


def sizes_allow(x: str, y: str, level: tuple[int, int] = LEVEL) -> str:
    """SQL: two sets of such sizes (n) can have a similarity of the level."""
    p, q = level
    return f"{q} * least({x}.n, {y}.n) >= {p} * greatest({x}.n, {y}.n)"


def similar(x: str, y: str, level: tuple[int, int] = LEVEL) -> str:
    """SQL: Jaccard similarity of at least the level, in whole numbers; the sizes alone rule many pairs out."""
    p, q = level
    return f"CASE WHEN {sizes_allow(x, y, level)} THEN {p + q} * size(array_intersect({x}.shingles, {y}.shingles)) >= {p} * ({x}.n + {y}.n) ELSE false END"


#: Bounds of a block of a bucket's grid: shingles of its members together, and members, about.
BLOCK_SHINGLES, BLOCK_SETS = 400_000, 2048
#: Sets on the right from which on a shingle is a column of a matrix, columns of one product, and shingles that are looked up at a time.
DENSE, COLUMNS, STEP = 48, 512, 1 << 16


def common(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """How many shingles each set on the left has in common with each on the right.

    A shingle that many sets on the right have is a column of 0 and 1 in a
    product of matrices; one that few have is looked up set by set.
    """
    names, place = np.unique(np.concatenate([*left, *right]), return_inverse=True)
    cut = sum(map(len, left))
    rows, cols = (np.repeat(np.arange(len(s)), list(map(len, s))) for s in (left, right))
    at, to = place[:cut], place[cut:]
    order = np.argsort(to, kind="stable")
    to, cols = to[order], cols[order]
    first = np.searchsorted(to, np.arange(len(names) + 1))
    held = np.diff(first)
    found = np.zeros((len(left), len(right)), np.int32)
    flat = found.reshape(-1)
    few = np.flatnonzero((held[at] > 0) & (held[at] < DENSE))
    for lo in range(0, len(few), STEP):
        some = few[lo : lo + STEP]
        n = held[at[some]]
        spots = np.arange(n.sum()) + np.repeat(first[at[some]] - (np.cumsum(n) - n), n)
        np.add.at(flat, np.repeat(rows[some], n) * len(right) + cols[spots], 1)
    often = np.unique(at[held[at] >= DENSE])
    for lo in range(0, len(often), COLUMNS):
        part = often[lo : lo + COLUMNS]
        number = np.full(len(names), -1)
        number[part] = np.arange(len(part))
        x, y = (np.zeros((len(s), len(part)), np.float32) for s in (left, right))
        here, there = number[at] >= 0, number[to] >= 0
        x[rows[here], number[at[here]]] = 1
        y[cols[there], number[to[there]]] = 1
        found += (x @ y.T).astype(np.int32)
    return found


def _compare(table: pa.Table, pivots: np.ndarray, loose: int, level: tuple[int, int] = LEVEL) -> pa.Table:
    """a, b: which components (part) of a cell's members are linked, as few rows as connect them. Two blocks meet each other, one block itself."""
    part, own, n, fp = (table.column(c).to_numpy() for c in ("part", "own", "n", "fp"))
    p, q = level
    x, y = np.flatnonzero(own == own.min()), np.flatnonzero(own == own.max())
    names, label = np.unique(part, return_inverse=True)
    bits_ = fp.view(np.uint64)
    far = np.bitwise_count(bits_[:, None] ^ pivots[None, :]).astype(np.int8)
    # Pivot distances discard a pair before its Hamming distance is taken, and both before its sets are counted.
    open_ = (label[x][:, None] != label[y][None, :]) & (q * np.minimum(n[x][:, None], n[y][None, :]) >= p * np.maximum(n[x][:, None], n[y][None, :]))
    for k in range(len(pivots)):
        open_ &= np.abs(far[x, k][:, None] - far[y, k][None, :]) <= loose
    open_ &= np.bitwise_count(bits_[x][:, None] ^ bits_[y][None, :]) <= loose
    rows, cols = open_.any(axis=1), open_.any(axis=0)
    if not rows.any():
        return pa.table({"a": pa.array([], pa.int64()), "b": pa.array([], pa.int64())})
    x, y, open_ = x[rows], y[cols], open_[rows][:, cols]
    sets = table.column("shingles").combine_chunks()
    both = common([sets[int(k)].values.to_numpy() for k in x], [sets[int(k)].values.to_numpy() for k in y])
    linked = open_ & ((p + q) * both >= p * (n[x][:, None] + n[y][None, :]))
    for k in np.flatnonzero(linked.any(axis=1)):
        met = np.unique(np.append(label[y[linked[k]]], label[x[k]]))
        label[np.isin(label, met)] = met[0]
    made = np.stack([part, names[label]], axis=1)
    made = np.unique(made[made[:, 0] != made[:, 1]], axis=0)
    return pa.table({"a": pa.array(made[:, 0]), "b": pa.array(made[:, 1])})


def crossed(open_: DataFrame, sets: DataFrame, pivots: list[int], loose: int, level: tuple[int, int] = LEVEL) -> DataFrame:
    """a, b: links between components, of the members (key, node, part) of buckets and their sets (node, n, fp, shingles).

    A bucket's members are dealt to blocks, and each pair of blocks is a cell, a
    group of its own: a bucket of any size is spread over as many tasks as it
    has pairs of blocks, and none holds more than two blocks. A cell compares
    all its pairs by counting common shingles, and gives a row for each
    component that it joins to another.
    """
    told = open_.join(sets.select("node", "n"), "node")
    blocks = F.greatest(F.lit(1), F.ceil(F.greatest(F.sum("n") / BLOCK_SHINGLES, F.count(F.lit(1)) / BLOCK_SETS))).cast("int")
    rows = told.join(told.groupBy("key").agg(blocks.alias("blocks")), "key")
    rows = rows.select("key", "node", "part", F.pmod(F.xxhash64("node"), "blocks").cast("int").alias("own"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    cells = rows.select("key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "node", "part", "own").join(sets, "node")
    marks = np.array(pivots, np.uint64)
    return cells.groupBy("key", "i", "j").applyInArrow(lambda table: _compare(table, marks, loose, level), "a long, b long")
