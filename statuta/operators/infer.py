"""Models asked once for each different sentence: answers lie in a store by the SHA-256 of model version and sentence."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from statuta.operators.annotate import Factory
from statuta.operators.support_store import SupportStore
from statuta.sources.shared import free, materialise

#: Sentences whose answers are committed together; a run that dies loses the answers of one such round.
ROUND = 10_000_000
#: Rows of one sentence that meet its answer in one task, at least; a sentence with more is dealt to slices.
HOT = 10_000
#: Sentences that are dealt to slices, at most: the bound of what is broadcast. The more rows there are, the more of them a slice takes.
MOST_HOT = 100_000


def create_answers(spark: SparkSession, folder: str, returns: T.DataType, buckets: int = 1024) -> SupportStore:
    """An empty store of answers (key, sentence, answer, error) of one type, which holds no map. Several models may share it."""
    kind = T.StructType([T.StructField("key", T.StringType()), T.StructField("sentence", T.StringType()), T.StructField("answer", returns), T.StructField("error", T.StringType())])
    return SupportStore.create(spark.createDataFrame([], kind), folder, ["key"], buckets)


def key_of(sentence: Column, model: str) -> Column:
    """The SHA-256 of model version and sentence, 44 characters. Rows meet by it alone, so it must have no collisions, as MD5 has, with which earlier stores were keyed."""
    return F.base64(F.unhex(F.sha2(F.concat(F.lit(model + "\n"), sentence).cast("binary"), 256)))


def _known(store: SupportStore, keys: DataFrame) -> DataFrame:
    """key, answer of those keys (each once) that have an answer, each once."""
    return store.near(keys).where("error IS NULL").join(keys, "key", "left_semi").groupBy("key").agg(F.min("answer").alias("answer"))


def _lacking(store: SupportStore, keys: DataFrame) -> DataFrame:
    """Those keys that have no answer. No sentence and no answer moves."""
    return keys.join(store.near(keys).where("error IS NULL").select("key"), "key", "left_anti")


def _unanswered(store: SupportStore, keys: DataFrame, different: int) -> tuple[DataFrame, int, int]:
    """key, failed (true, or null) of those of so many keys that have no answer, how many there are, and how many failed before: the store holds their sentences."""
    if not store.state().pieces:
        return keys.withColumn("failed", F.lit(None).cast("boolean")), different, 0
    told = store.near(keys).where("error IS NOT NULL").select("key").distinct().withColumn("failed", F.lit(True))
    new = materialise(_lacking(store, keys).join(told, "key", "left"), "unanswered")
    return new, *new.agg(F.count(F.lit(1)), F.count("failed")).first()


def add_answers(store: SupportStore, model: str, told: DataFrame) -> int:
    """Take answers made elsewhere, as annotation files (see annotate.read_annotations): rows of sentence and answer; how many were new.

    Of several answers to a sentence the least counts; sentences that have an
    answer keep it; null sentences are passed over.
    """
    own = told.where("sentence IS NOT NULL").groupBy("sentence").agg(F.min("answer").alias("answer"))
    own = materialise(own.select(key_of(F.col("sentence"), model).alias("key"), "sentence", "answer"), "told")
    lacking = _lacking(store, own.select("key"))
    n = store.merge(own.join(lacking, "key", "left_semi").withColumn("error", F.lit(None).cast("string")))
    free(own)
    return n


def _asked_model(new: DataFrame, factory: Factory, returns: T.DataType) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = None
        for batch in batches:
            answers, errors = [], []
            for sentence in batch["sentence"]:
                try:
                    model = model or factory()  # once for each task that has a sentence
                    answers.append(model(sentence))
                    errors.append(None)
                except Exception as e:  # the model's failure on one sentence is a row, and it is asked again in the next run
                    answers.append(None)
                    errors.append(f"{type(e).__name__}: {e}")
            yield pd.DataFrame({"key": batch["key"], "sentence": batch["sentence"], "answer": pd.Series(answers, dtype=object, index=batch.index), "error": pd.Series(errors, dtype=object, index=batch.index)})

    return new.select("key", "sentence").mapInPandas(run, T.StructType([*new.select("key", "sentence").schema.fields, T.StructField("answer", returns), T.StructField("error", T.StringType())]))


def infer_once(rows: DataFrame, sentence: Column, store: SupportStore, factory: Factory, model: str, answer: str = "answer", error: str = "error", most: int = ROUND, hot: int = HOT) -> DataFrame:
    """rows with the model's answer to each sentence and the error where it failed.

    Only different sentences that the store has no answer to reach the model,
    each once in a run, but for tasks that are run again. Failures are kept with
    their error, and asked again in the next run. A null sentence has no answer
    and no error; an empty one is a sentence. Columns of rows may have any name
    but those of the two new ones. What is returned reads a table that is
    deleted with the session.

    New sentences move to be met by their copies, and once more to the tasks that
    ask the model and write its answers into the store; those that failed before
    are taken from there; all else meets by keys alone. rows are read once to
    count, once for each round with new sentences, and once for what is returned.
    """
    clash = {answer.lower(), error.lower()} & {c.lower() for c in rows.columns}
    if clash:
        raise ValueError(f"rows have columns {sorted(clash)} already")
    returns, parallel = store.state().kind()["answer"].dataType, rows.sparkSession.sparkContext.defaultParallelism
    # Numbers stand for the names of columns until the end. Columns of their own, and not of a struct, are left out by Spark if nobody reads them.
    told = rows.select(*[F.col("`" + c.replace("`", "``") + "`").alias(f"c{i}") for i, c in enumerate(rows.columns)], sentence.cast("string").alias("sentence"))
    told = told.withColumn("key", key_of(F.col("sentence"), model))
    asked = materialise(told.where("key IS NOT NULL").groupBy("key").agg(F.count(F.lit(1)).alias("n")), "asked")
    keys = asked.select("key")
    total, different = asked.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1))).first()

    new, left, again = _unanswered(store, keys, different)
    failed = []
    rounds = max(1, -(-left // most))
    for k in range(rounds if left else 0):
        part = F.pmod(F.xxhash64("key"), F.lit(rounds)) == k
        own, texts = new.where(part), []
        if again < left:
            text = told.where("key IS NOT NULL").where(part).groupBy("key").agg(F.min("sentence").alias("sentence"))  # equal ones, of which as few as can be leave a task
            texts.append(text if left - again == different else text.join(own.where("failed IS NULL").select("key"), "key", "left_semi"))
        if again:
            text = store.near(own).where("error IS NOT NULL").join(own.select("key"), "key", "left_semi")
            texts.append(text.groupBy("key").agg(F.min("sentence").alias("sentence")))
        # The number of tasks is given, since the model's time and not the bytes decides it.
        tasks = min(left, max(parallel, left // rounds // 10_000))
        failed.append(store.fill(own.select("key"), reduce(DataFrame.unionByName, texts), lambda t: _asked_model(t, factory, returns), "error IS NULL", tasks))
    answers = _known(store, keys).withColumn("error", F.lit(None).cast("string"))
    for made in failed:
        # The store holds equal rows once, and failures are all that can be there already.
        seen = store.near(made).where("error IS NOT NULL").select("key", "error")
        store.add(made.join(seen, ["key", "error"], "left_anti"))
        answers = answers.unionByName(made.select("key", "answer", "error"))

    bound = max(hot, -(-total // MOST_HOT))
    many = F.broadcast(asked.where(F.col("n") > bound).select("key", F.ceil(F.col("n") / bound).alias("slices")))  # fewer than MOST_HOT rows, as each stands for more than total / MOST_HOT
    slices = F.coalesce("slices", F.lit(1).cast("long"))
    dealt = answers.join(many, "key", "left").select("key", "answer", "error", F.explode(F.sequence(F.lit(0).cast("long"), slices - 1)).alias("slice"))
    at = F.monotonically_increasing_id()
    met = told.drop("sentence").join(many, "key", "left").withColumn("slice", F.when(F.col("key").isNull(), at).otherwise(F.pmod(at, slices)))  # rows without a sentence meet nothing, each in a slice of its own
    met = met.join(dealt, ["key", "slice"], "left")
    return met.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(rows.columns)], F.col("answer").alias(answer), F.col("error").alias(error))


def no_model() -> Factory:
    """Stands for a model that cannot be asked: sentences that the store lacks get an error."""

    def made():
        def one(sentence: str):
            raise LookupError("no answer to this sentence")

        return one

    return made
