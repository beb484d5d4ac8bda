"""SimHash near-dedup: fingerprints of word shingles, linked by Hamming distance through pivot distance tables."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from statuta.llm import shingle_sets
from statuta.llm.common import free, materialise, packed, quoted, tidy, unpacked
from statuta.llm.components import connected_components

#: The reference fingerprints: rows of the 64 x 64 Hadamard matrix, each 32 bits from every other.
PIVOTS = [sum((bin(i & j).count("1") & 1) << j for j in range(64)) for i in (1, 2, 4, 8, 16, 32, 3, 12, 48, 21, 42, 63, 7, 56, 25, 38)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def fingerprint(text: str | None, width: int = 4, seed: int = 42) -> int:
    """64 bits; a bit is 1 if set in over half of the XXH64 of the word shingles; no word: 0."""
    words = (text or "").encode().lower().split()  # bytes: lower() and split() know ASCII only
    if not words:
        return 0
    h = xxhash.xxh64_intdigest
    if len(words) <= width:
        return h(b" ".join(words), seed)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = np.concatenate([[0], ends[:-1]])
    line = b" ".join(words)
    counts, n = np.zeros(64, np.int64), len(words) - width + 1
    for lo in range(0, n, 1 << 16):
        hi = min(n, lo + (1 << 16))
        hashes = np.array([h(line[s:e], seed) for s, e in zip(starts[lo:hi].tolist(), (ends[lo + width - 1 : hi + width - 1] - 1).tolist(), strict=True)], "<u8")
        counts += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(counts * 2 > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, width: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fp (the fingerprint as a signed long); null text has no words."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"doc_id": batch["doc_id"], "fp": [_signed(fingerprint(t, width)) for t in batch["text"]]})

    return docs.select(F.col(quoted(id_col)).cast("long").alias("doc_id"), F.col(quoted(text_col)).alias("text")).mapInPandas(tidy(run), "doc_id long, fp long")


def _blocks(n: int) -> list[tuple[int, int]]:
    cuts = [64 * i // n for i in range(n + 1)]
    return [(a, b - a) for a, b in zip(cuts, cuts[1:], strict=False)]


def block_keys(fp: Column, distance: int, spare: int) -> Column:
    """Keys of which two fingerprints within the distance share one at least: of distance + spare blocks, spare agree."""
    masks = [sum(((1 << size) - 1) << at for at, size in chosen) for chosen in combinations(_blocks(distance + spare), spare)]
    return F.array(*[F.xxhash64(F.lit(k), fp.bitwiseAND(F.lit(_signed(m)))) for k, m in enumerate(masks)])


def pivot_tables(fp: Column) -> list[Column]:
    """The distances to the pivots, eight to a long."""
    packed = []
    for at in range(0, len(PIVOTS), 8):
        parts = [F.shiftleft(F.bit_count(fp.bitwiseXOR(F.lit(_signed(p)))).cast("long"), 8 * k) for k, p in enumerate(PIVOTS[at : at + 8])]
        total = parts[0]
        for part in parts[1:]:
            total = total.bitwiseOR(part)
        packed.append(total.alias(f"t{at // 8}"))
    return packed


def _near(distance: int) -> str:
    """SQL: the largest coordinate difference is within the distance, and then the Hamming distance is."""
    parts = [f"abs((shiftright(x.t{k // 8}, {8 * (k % 8)}) & 255) - (shiftright(y.t{k // 8}, {8 * (k % 8)}) & 255)) <= {distance}" for k in range(len(PIVOTS))]
    return " AND ".join([*parts, f"bit_count(x.fp ^ y.fp) <= {distance}"])


def shared_buckets(keyed: DataFrame) -> DataFrame:
    """key, node, leaders, members of the buckets (node, key: each pair once) with two members or more.

    Of buckets with the same members, as the bands of a group of copies are,
    one stays: members are compared by their number and two 64-bit sums of
    their hashes. leaders are up to three members: the smallest, the largest and
    the one of the smallest hash.
    """
    leaders = F.array_distinct(F.array(F.min("node"), F.max("node"), F.min_by("node", F.xxhash64("node"))))
    marks = [F.bit_xor(F.xxhash64(F.lit(k), "node")).alias(f"x{k}") for k in (0, 1)]
    seen = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("members"), leaders.alias("leaders"), *marks).where("members > 1")
    one = seen.groupBy("members", "x0", "x1").agg(F.min("key").alias("key"), F.first("leaders").alias("leaders"))
    return keyed.join(one.select("key", "members", "leaders"), "key").select("key", "node", "leaders", "members")


def link(keyed: DataFrame, verified: Callable[[DataFrame], DataFrame], crossed: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """node, component (smallest node reachable) of each node that has a link, from keyed (node, key): candidates share a key.

    First each bucket's members are tried against its leaders: pairs of ids,
    each once over all buckets, of which verified() gives the links. That joins
    dense groups in linear time, and it settles every bucket that has fewer than
    two other members. Then crossed() gets the members (key, node, part) of the
    buckets in which more than one component is left, and gives links between
    components; pairs that are no link are never rows. keyed is freed.
    """
    shared = materialise(shared_buckets(keyed), "shared")
    free(keyed)
    tried = shared.select("node", F.explode("leaders").alias("b")).where("node <> b")
    stars = materialise(verified(tried.select(F.least("node", "b").alias("a"), F.greatest("node", "b").alias("b")).distinct()), "stars")
    first = connected_components(stars)
    placed = shared.where("members - size(leaders) > 1").join(first, "node", "left").select("key", "node", F.coalesce("component", "node").alias("part"))
    placed = materialise(placed, "placed")
    mixed = placed.groupBy("key").agg(F.min("part").alias("lo"), F.max("part").alias("hi")).where("lo < hi").select("key")
    open_ = materialise(placed.join(mixed, "key"), "open")
    cross = materialise(crossed(open_).distinct(), "cross")
    merged = connected_components(cross)
    nodes = first.select("node", "component").union(merged.select("node").join(first, "node", "left_anti").select("node", F.col("node").alias("component")))
    joined = nodes.join(merged.select(F.col("node").alias("component"), F.col("component").alias("to")), "component", "left")
    found = materialise(joined.select("node", F.coalesce("to", "component").alias("component")), "parts")
    free(shared, stars, first, placed, open_, cross, merged)
    return found


#: Members of a hot bucket that one block of its grid holds, about.
BLOCK = 2048


def _pairs_by_bits(open_: DataFrame, near: str) -> DataFrame:
    """a, b: components that have a link, of (key, node: a fingerprint, part); a bucket of many members is a grid of blocks, one task for each pair of blocks."""
    sizes = open_.groupBy("key").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks"))
    rows = open_.join(sizes, "key").select("key", F.col("node").alias("fp"), "part", F.pmod(F.xxhash64("node"), "blocks").cast("int").alias("own"), "blocks", *pivot_tables(F.col("node")))
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    x = rows.select("*", F.col("own").alias("i"), other.alias("j")).alias("x")
    y = rows.select("*", other.alias("i"), F.col("own").alias("j")).alias("y")
    met = x.join(y, F.expr(f"x.key = y.key AND x.i = y.i AND x.j = y.j AND x.part <> y.part AND x.fp < y.fp AND {near}"))
    return met.select(F.col("x.part").alias("a"), F.col("y.part").alias("b"))


def link_fingerprints(distinct: DataFrame, distance: int = 4, spare: int = 3) -> DataFrame:
    """fp, component (smallest signed fp reachable) of each of the fingerprints (fp, each once) that has another one within the distance.

    Candidates share a block key: of distance + spare blocks, spare agree, so no
    pair within the distance is missed whatever spare is. The pivot tables
    discard a pair before its Hamming distance is taken. A larger spare makes
    more keys of more bits: 2 makes 15 keys of 21 bits, 3 35 of 27, 4 70 of 32,
    so 2 is for some millions of fingerprints, 3 for some billions, 4 beyond.
    """
    keyed = materialise(distinct.select(F.col("fp").alias("node"), F.explode(block_keys(F.col("fp"), distance, spare)).alias("key")), "keys")

    def verified(pairs: DataFrame) -> DataFrame:
        sides = [F.struct(F.col(c).alias("fp"), *pivot_tables(F.col(c))).alias(s) for c, s in (("a", "x"), ("b", "y"))]
        return pairs.select("a", "b", *sides).where(_near(distance)).select("a", "b")

    return link(keyed, verified, lambda rows: _pairs_by_bits(rows, _near(distance))).withColumnRenamed("node", "fp")


def near_duplicates(docs: DataFrame, distance: int = 4, width: int = 4, spare: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id (smallest doc_id reachable over links) for each row.

    Fingerprints within the distance are linked. Copies share a fingerprint and
    meet as one row, whatever their number. Null, empty and blank texts have
    fingerprint 0 and link like any other; a text of any length counts as a
    whole; an empty table gives no row. Rows that repeat an id each get a row;
    null ids never name a component unless it has no other id. Other columns
    are ignored, whatever their names.
    """
    marked = materialise(fingerprints(docs, width, id_col, text_col), "fingerprints")
    distinct = materialise(marked.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct")
    parts = link_fingerprints(distinct.select("fp"), distance, spare)
    named = distinct.join(parts, "fp", "left").select("fp", "least", F.coalesce("component", "fp").alias("component"))
    ids = named.groupBy("component").agg(F.min("least").alias("component_id"))
    classes = materialise(named.join(ids, "component").select("fp", "component_id"), "classes")
    free(distinct)
    return marked.join(classes, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


#: Fingerprints of sets at similarity 0.8 differ in 9.7 bits of 64 on average, with a deviation of 2.9. The worst are sets of 4 and 5
#: shingles: a bit differs with probability 3/16, so more than 32 bits do with 3.7e-9 (more than 28 with 1.1e-6).
LOOSE = 32


def link_similar(distinct: DataFrame, texts: DataFrame, width: int = 5, level: tuple[int, int] = shingle_sets.LEVEL) -> DataFrame:
    """node, component of each shingle set that has another one of Jaccard similarity 4/5 (the level) or more, of distinct (node, n, fp, keys, h1, h2) and the rows texts (h1, h2, text).

    At that similarity fingerprints differ in too many bits for block keys: to
    miss no pair within LOOSE bits there would be 33 keys of 2 bits at most. So
    candidates share one of 48 bands of 5 least hashes (a pair at 0.8 shares
    none with probability 5e-9; shingle_sets.layout for other levels). Pairs of
    ids are discarded by size, by pivot distances and by the Hamming distance of
    the fingerprints beyond LOOSE bits (below 0.8: by size alone, as links may
    differ in more); only survivors get their whole sets, on which they are
    verified. Buckets that this leaves open are compared block by block
    (shingle_sets.crossed).
    """
    loose = LOOSE if 5 * level[0] >= 4 * level[1] else 64
    keyed = materialise(distinct.select("node", F.explode("keys").alias("key")), "keys")
    again = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("members")).where("members > 1").select("key")
    wanted = distinct.join(keyed.join(again, "key").select("node").distinct(), "node", "left_semi").select("h1", "h2")
    sets = materialise(shingle_sets.sets_of(texts.join(wanted, ["h1", "h2"], "left_semi"), width), "sets")
    told = distinct.select("node", F.struct("n", "fp", *pivot_tables(F.col("fp"))).alias("told"))

    def both(pairs: DataFrame, side: DataFrame, column: str) -> DataFrame:
        for c, s in (("a", "x"), ("b", "y")):
            pairs = pairs.join(side.select(F.col("node").alias(c), F.col(column).alias(s)), c)
        return pairs

    def verified(pairs: DataFrame) -> DataFrame:
        close = both(pairs, told, "told").where(f"{shingle_sets.sizes_allow('x', 'y', level)} AND {_near(loose)}").select("a", "b")
        whole = sets.select("node", F.struct("n", "shingles").alias("whole"))
        return both(materialise(close, "close"), whole, "whole").where(shingle_sets.similar("x", "y", level)).select("a", "b")

    found = link(keyed, verified, lambda rows: shingle_sets.crossed(rows, sets, PIVOTS, loose, level))
    free(sets)
    return found


def one_of_each(docs: DataFrame, width: int = 5, id_col: str = "doc_id", text_col: str = "text", level: tuple[int, int] = shingle_sets.LEVEL) -> DataFrame:
    """One row of docs, with all its columns, of each group linked by a shingle similarity of 4/5 (the level, a fraction from 1/12 to 1) or more.

    The smallest row by id (null last), then by hash of id and text, then by
    hash of the row stays. Shingles are runs of `width` words, parted by ASCII
    white space, with A-Z in lower case. Rows of equal sets, among them all
    without a word (null, empty, blank), meet as one; rows that repeat an id are
    rows of their own. A text of any length counts as a whole. An empty table
    stays empty. Columns may have any name.
    """
    base = docs.select(packed(docs).alias("row"))
    doc_id, text = F.col("row").getField(id_col), F.col("row").getField(text_col)
    key = [doc_id.isNull(), doc_id, text.isNull(), text]
    hashes = [F.xxhash64(*key).alias("h1"), F.xxhash64(F.lit("second half"), *key).alias("h2")]
    rows = base.select(doc_id.cast("long").alias("doc_id"), *hashes, text.alias("text"))
    marked = materialise(shingle_sets.sketches(rows, width, level), "sketches")
    least = F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "h1", "h2")).alias("least")
    distinct = marked.groupBy("node").agg(least, *[F.first(c).alias(c) for c in ("n", "fp", "keys")])
    distinct = materialise(distinct.select("node", "n", "fp", "keys", "least", "least.h1", "least.h2"), "distinct")
    parts = link_similar(distinct, rows.select("h1", "h2", "text"), width, level)
    named = distinct.select("node", "least").join(parts, "node", "left").groupBy(F.coalesce("component", "node").alias("component")).agg(F.min("least").alias("least"))
    stay = materialise(named.select("least.h1", "least.h2"), "stay")
    free(marked, distinct, parts)
    met = base.select("row", *hashes).join(stay, ["h1", "h2"], "left_semi")
    equal = Window.partitionBy("h1", "h2").orderBy(F.xxhash64(F.col("row").cast("string")))  # rows that repeat id and text
    made = met.withColumn("at", F.row_number().over(equal)).where("at = 1")
    return made.select(*unpacked(made))
