"""Annotators, rewriters, extractors and embedders: given as factories, made once in each Python worker."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from statuta.functions.text import rewrite_prompt
from statuta.sources.files import placed_lines

TOKENS = T.ArrayType(T.StructType([T.StructField("id", T.IntegerType()), T.StructField("word", T.StringType()), T.StructField("pos", T.StringType()), T.StructField("ner", T.StringType()), T.StructField("head", T.IntegerType()), T.StructField("deprel", T.StringType())]))
Factory = Callable[[], Callable]


def _applied(factory: Factory, returns: T.DataType, c: Column) -> Column:
    @F.pandas_udf(returns)
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        apply = factory()  # once for each task, over all its batches
        for s in batches:
            yield s.map(lambda x: None if x is None else apply(x))

    return run(c)


def annotated(sentence: Column, factory: Factory) -> Column:
    """Tokens (id, word, pos, ner, head, deprel) of a segmented sentence by an injected annotator."""
    return _applied(factory, TOKENS, sentence)


def language(text: Column, factory: Factory) -> Column:
    """Code of the most likely language; "N/A" where the detector fails or finds none."""

    def safe():
        detect = factory()

        def one(x):
            try:
                return detect(x) or "N/A"
            except Exception:
                return "N/A"

        return one

    return F.coalesce(_applied(safe, T.StringType(), text), F.lit("N/A"))


def encoded(sentence: Column, factory: Factory) -> Column:
    """Embedding of a segmented sentence by an injected encoder."""
    return _applied(factory, T.ArrayType(T.FloatType()), sentence)


def rewritten(rows: DataFrame, number: str, sentence: str, system_prompt: str, factory: Factory) -> DataFrame:
    """rows with user_prompt, answer and lines: an injected chat model's simple sentences, one to a line.

    A model is costly and not repeatable: write the result before using it twice.
    """
    asked = rows.withColumn("user_prompt", rewrite_prompt(F.col(number), F.col(sentence)))

    def with_system():
        chat = factory()
        return lambda user: chat(system_prompt, user)

    answered = asked.withColumn("answer", _applied(with_system, T.StringType(), F.col("user_prompt")))
    return answered.withColumn("lines", F.filter(F.split("answer", "\n"), lambda x: x != ""))


def cosine(a: Column, b: Column) -> Column:
    def dot(x, y):
        return F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda t, e: t + e)

    return dot(a, b) / F.sqrt(dot(a, a) * dot(b, b))


def read_annotations(spark: SparkSession, path: str) -> DataFrame:
    """path, sent_id, sentence, tokens (id, word, pos, ner, head, deprel) from text files of six tab-separated columns, a blank line behind each sentence.

    `_` stands for what is missing. Sentences are numbered in each file, blank
    lines apart; sentence is the words joined by spaces. A file may be of any
    size: its splits are read by different tasks, and a sentence may lie across
    their border.
    """
    own = Window.partitionBy("path", "start").orderBy("place")
    lines = placed_lines(spark, path).withColumn("blank", F.trim("value") == "").withColumn("after", F.lag("blank").over(own))
    inner = F.count_if(~F.col("blank") & F.col("after"))
    splits = lines.groupBy("path", "start").agg(inner.alias("inner"), F.min_by("blank", "place").alias("first"), F.max_by("blank", "place").alias("last"))
    file = Window.partitionBy("path").orderBy("start")  # one row for each split of a file
    splits = splits.withColumn("before", F.coalesce(F.lag("last").over(file), F.lit(True)))
    splits = splits.withColumn("n", F.col("inner") + (~F.col("first") & F.col("before")).cast("long"))
    splits = splits.select("path", "start", "before", (F.sum("n").over(file) - F.col("n")).alias("base"))
    begins = (~F.col("blank") & F.coalesce("after", "before")).cast("long")
    placed = lines.join(splits, ["path", "start"]).withColumn("sent_id", (F.col("base") + F.sum(begins).over(own) - 1).cast("int")).where(~F.col("blank"))
    cut = lambda k: F.get(F.split("value", "\t"), F.lit(k))
    known = lambda c: F.when(c != "_", c)
    token = F.struct(cut(0).cast("int").alias("id"), cut(1).alias("word"), known(cut(2)).alias("pos"), known(cut(3)).alias("ner"), known(cut(4)).cast("int").alias("head"), known(cut(5)).alias("deprel"))
    made = placed.select("path", "sent_id", F.struct("start", "place", token.alias("token")).alias("x")).groupBy("path", "sent_id").agg(F.array_sort(F.collect_list("x")).alias("xs"))
    made = made.select("path", "sent_id", F.transform("xs", lambda x: x["token"]).alias("tokens"))
    return made.select("path", "sent_id", F.array_join(F.transform("tokens", lambda t: t["word"]), " ").alias("sentence"), "tokens")


def stub_annotator() -> Callable:
    """Stands in for a model: words in turn noun, verb, noun; the first verb is the root."""

    def one(sentence: str) -> list[dict]:
        words = sentence.split()
        root = 2 if len(words) > 1 else 1
        made = []
        for i, w in enumerate(words, 1):
            verb = i % 3 == 2
            pos = "CH" if not (w[0].isalnum() or any(c.isalnum() for c in w)) else "V" if verb else "N"
            label = "root" if i == root else "sub" if i < root else "conj" if pos == "V" else "punct" if pos == "CH" else "dob"
            made.append({"id": i, "word": w, "pos": pos, "ner": "O", "head": 0 if i == root else root, "deprel": label})
        return made

    return one


def stub_encoder(size: int = 16) -> Callable:
    """Stands in for a model: a unit vector that depends on the text alone."""

    def one(text: str) -> np.ndarray:
        raw = np.frombuffer(hashlib.shake_128(text.encode()).digest(size), np.uint8).astype(np.float32) - 127.5
        return raw / np.linalg.norm(raw)

    return one


def stub_chat() -> Callable:
    """Stands in for a model: gives back the quoted sentence, one clause to a line."""
    return lambda system, user: user.rsplit('"', 2)[-2].replace(", ", ".\n")
