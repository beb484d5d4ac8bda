"""Document fingerprints by Order MinHash: minimal occurrence-numbered k-mers, in text order, hashed as tuples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from statuta.llm.common import quoted, text_or_empty

WORDS = 3  # words in a k-mer
BINS = 64  # tuples in a signature, a power of two
#: The low bits of a packed number hold a place in the text, the others a hash. A string has no more words than that.
PLACE_BITS = 31
PLACE = (1 << PLACE_BITS) - 1
#: Documents are handled in runs of neighbouring ids, one to a task: CELL_ROWS rows each, but no more than MOST_CELLS tasks, beyond which runs grow (their sorts spill).
MOST_CELLS = 1 << 16
CELL_ROWS = 500


def signatures(df: DataFrame, texts: dict[str, str]) -> DataFrame:
    """df with a signature (array of BINS longs, 0: empty bin) for each named text column, which it replaces.

    A k-mer is WORDS words in a row, words being parted by single spaces (a
    shorter text is one k-mer). Its repeats in a text are numbered, and k-mer
    and number are hashed together. The hash deals the numbered k-mers into
    BINS bins (one permutation cut in bins stands for as many permutations); in
    each bin the two smallest are taken, put in text order, and hashed as a
    tuple. So a signature depends on which k-mers occur, how often, and in
    which order. All steps are linear but for two sorts of packed longs.
    """
    for name, to in texts.items():
        keep = [c for c in df.columns if c != name and not c.startswith("_w")]
        df = df.select(*keep, F.split(name, " ").alias("_w"))
        df = df.select(*keep, F.expr(f"if(size(_w) < {WORDS}, array(xxhash64(_w)), transform(sequence(0, size(_w) - {WORDS}), i -> xxhash64({', '.join(f'get(_w, i + {k})' for k in range(WORDS))})))").alias("_h"))
        df = df.select(*keep, F.expr(f"sort_array(transform(_h, (h, i) -> (h & ~{PLACE}L) | (i & {PLACE})))").alias("_p"))
        df = df.select(*keep, "_p", F.expr(f"filter(sequence(0, size(_p) - 1), j -> j = 0 OR shiftright(get(_p, j), {PLACE_BITS}) <> shiftright(get(_p, j - 1), {PLACE_BITS}))").alias("_s"))
        numbered = "(xxhash64(shiftright({p}, %d), {o}) & ~%dL) | (coalesce({p}, 0L) & %dL)" % (PLACE_BITS, PLACE, PLACE)
        once = f"transform(_p, p -> {numbered.format(p='p', o='0')})"
        more = f"flatten(transform(_s, (s, r) -> transform(sequence(s, coalesce(get(_s, r + 1), size(_p)) - 1), j -> {numbered.format(p='get(_p, j)', o='j - s')})))"
        df = df.select(*keep, F.expr(f"sort_array(if(size(_s) = size(_p), {once}, {more}))").alias("_q"))
        top = 64 - (BINS - 1).bit_length()
        df = df.select(*keep, "_q", F.expr(f"filter(sequence(0, size(_q) - 1), j -> j = 0 OR shiftright(get(_q, j), {top}) <> shiftright(get(_q, j - 1), {top}))").alias("_b"))
        a, b = "get(_q, s)", "get(_q, s + 1)"
        ida, idb = f"shiftright({a}, {PLACE_BITS})", f"shiftright({b}, {PLACE_BITS})"
        pair = f"CASE WHEN s + 1 >= coalesce(get(_b, r + 1), size(_q)) THEN xxhash64({ida}) WHEN ({a} & {PLACE}L) <= ({b} & {PLACE}L) THEN xxhash64({ida}, {idb}) ELSE xxhash64({idb}, {ida}) END"
        df = df.select(*keep, F.expr(f"transform(_b, s -> shiftright(get(_q, s), {top}) + {BINS // 2})").alias("_n"), F.expr(f"transform(_b, (s, r) -> ({pair}) & 4294967295L)").alias("_v"))
        spread = f"transform(sequence(0, {BINS - 1}), k -> coalesce(get(_v, cast(array_position(_n, cast(k AS BIGINT)) AS INT) - 1), 0L))"
        df = df.select(*keep, F.expr(f"if(size(_v) = {BINS}, _v, {spread})").alias(to))
    return df


def as_hex(signature: str) -> Column:
    return F.lower(F.expr(f"array_join(transform({signature}, v -> lpad(hex(v), 8, '0')), '')"))


def likeness(a: str, b: str) -> Column:
    """Share of equal bins among those that are not empty on both sides."""
    return F.expr(f"aggregate(zip_with({a}, {b}, (x, y) -> if(x = y AND x <> 0L, 1, 0)), 0, (t, e) -> t + e) / greatest(1, aggregate(zip_with({a}, {b}, (x, y) -> if(x = 0L AND y = 0L, 0, 1)), 0, (t, e) -> t + e))").cast("double")


def with_next(docs: DataFrame) -> tuple[DataFrame, Window]:
    """docs (doc_id, text) in ascending order of id, dealt by cells of neighbouring ids, each cell closed by a copy of the next one's first row (last: true).

    Cells are cut at quantiles of the ids, so that they hold about as many rows
    each however the ids lie. The number of cells is bounded, so the table of
    their first ids is as well; it is broadcast to fetch the copies. The last
    cell is closed by the first row.
    """
    key = F.coalesce(F.col("doc_id"), F.lit(-(1 << 63)))
    cells = max(1, min(MOST_CELLS, docs.count() // CELL_ROWS))
    cell = F.lit(0)
    if cells > 1:
        shares = ",".join(str(k / cells) for k in range(1, cells))
        found = docs.select(key.alias("key")).agg(F.expr(f"percentile_approx(key, CAST(split('{shares}', ',') AS ARRAY<DOUBLE>), {max(10_000, 4 * cells)})")).first()[0]
        borders = sorted(set(found))
        steps = ", ".join(str(1 << k) for k in reversed(range(len(borders).bit_length())))
        at_or_above = f"get(CAST(split('{','.join(map(str, borders))}', ',') AS ARRAY<BIGINT>), p + s - 1) <= coalesce(doc_id, {-(1 << 63) + 1}L - 1L)"
        cell = F.expr(f"aggregate(array({steps}), 0, (p, s) -> if(coalesce({at_or_above}, false), p + s, p))")  # borders up to the id, by bisection
    placed = docs.select("doc_id", "text", key.alias("key"), cell.alias("cell"))
    heads = placed.groupBy("cell").agg(F.min("key").alias("key"))
    order = Window.partitionBy(F.lit(0)).orderBy("cell")  # over at most MOST_CELLS rows
    first = F.max("cell").over(Window.partitionBy(F.lit(0)))
    before = heads.select("key", F.coalesce(F.lag("cell").over(order), first).alias("cell"))
    copies = placed.drop("cell").join(F.broadcast(before), "key").groupBy("cell").agg(F.min("text").alias("text"))
    rows = placed.select("cell", "key", "doc_id", "text", F.lit(False).alias("last")).union(copies.select("cell", F.lit((1 << 63) - 1), F.lit(None).cast("long"), "text", F.lit(True)))
    return rows, Window.partitionBy("cell").orderBy("last", "key", "text")


def edit_fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next: one row for each row of docs.

    The edited text has its last floor(n_chars / 2) code points replaced by the
    first as many (or all) of the next document, in ascending order of id; the
    last one's next is the first. Null text is empty; texts are read whole,
    whatever their length; null ids come first; rows that repeat an id follow
    one another in order of text. A table of one row is its own next; an empty
    one gives no row. Other columns are ignored, whatever their names.
    """
    base = docs.select(F.col(quoted(id_col)).cast("long").alias("doc_id"), text_or_empty(text_col).alias("text"))
    rows, order = with_next(base)
    turn = ["cell", "last", "key"]
    half = F.expr("n_chars - n_chars div 2").cast("int")
    read = rows.select(*turn, "doc_id", "text", F.lead("text").over(order).alias("next"), F.row_number().over(order).alias("at")).withColumn("n_chars", F.length("text").cast("long"))
    edited = read.select(*turn, "at", "doc_id", "n_chars", "text", F.concat(F.substring("text", F.lit(1), half), F.substring(F.coalesce("next", F.lit("")), F.lit(1), F.expr("cast(n_chars div 2 AS INT)"))).alias("edited"))
    digest = edited.select(*turn, "at", "doc_id", "n_chars", "text", "edited", F.sha2("edited", 256).alias("edited_sha256"))
    signed = signatures(digest, {"text": "sig", "edited": "edited_sig"})
    paired = signed.withColumn("next_sig", F.lead("sig").over(Window.partitionBy("cell").orderBy("last", "key", "at"))).where("NOT last")
    return paired.select("doc_id", "n_chars", "edited_sha256", as_hex("sig").alias("fingerprint"), as_hex("edited_sig").alias("edited_fingerprint"), likeness("sig", "edited_sig").alias("near_edited"), likeness("sig", "next_sig").alias("near_next"))
