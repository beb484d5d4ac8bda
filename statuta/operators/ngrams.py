"""Word counts and n-grams with counts and first places."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from statuta.functions.text import strip


def word_counts(rows: DataFrame, words: str, by: list[str]) -> DataFrame:
    """by, word, n from an array of words."""
    return rows.select(*by, F.explode(words).alias("word")).groupBy(*by, "word").agg(F.count(F.lit(1)).alias("n"))


#: Grams that one task counts before the shuffle, about.
TASK_GRAMS = 2_000_000


def _grams(rows: DataFrame, grams, by: list[str], sizes: Column, cut: Callable[[DataFrame], DataFrame] = lambda rows: rows) -> DataFrame:
    """Grams are nearly as many as rows explode into, so what a task counts is bounded by the rows it gets: these are dealt first, to as many tasks as `sizes` (grams of a row, about) takes."""
    total = rows.agg(F.sum(F.coalesce(sizes, F.lit(0)).cast("long"))).first()[0] or 0
    tasks = -(-total // TASK_GRAMS)
    if tasks > 1:
        rows = rows.repartition(tasks, *rows.columns)
    return cut(rows).select(*by, F.posexplode(grams).alias("pos", "gram")).groupBy(*by, "gram").agg(F.count(F.lit(1)).alias("n"), F.min("pos").alias("first_pos"))


def char_ngrams(rows: DataFrame, text: str, n: int, by: list[str]) -> DataFrame:
    """by, gram, n, first_pos of the runs of n code points of the stripped text; none in a shorter text.

    The text is cut into characters once, so long texts take linear time.
    """
    texts = rows.select(*by, F.col(text).alias("_text"))
    grams = F.expr(f"if(size(_c) >= {n} AND _c[0] <> '', transform(sequence(0, size(_c) - {n}), i -> concat({', '.join(f'get(_c, i + {k})' for k in range(n))})), array())")
    chars = F.split(strip(F.col("_text")), "").alias("_c")
    return _grams(texts, grams, by, F.length("_text"), lambda dealt: dealt.select(*by, chars))


def token_ngrams(rows: DataFrame, tokens: str, n: int, by: list[str]) -> DataFrame:
    """by, gram (each token and a space), n, first_pos of the runs of n tokens."""
    grams = F.expr(f"if(size({tokens}) >= {n}, transform(sequence(0, size({tokens}) - {n}), i -> concat({', '.join(f'get({tokens}, i + {k}), chr(32)' for k in range(n))})), array())")
    return _grams(rows.select(*by, tokens), grams, by, F.size(tokens))
