"""Ancestor chains over (id, parent_id) tables, and the context text along a chain."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from statuta.functions.text import strip
from statuta.sources.shared import free, materialise

#: Levels beyond which chains are looked at for cycles; no result depends on it.
DEEP = 64


def ancestor_links(rows: DataFrame, starts: DataFrame | None = None) -> DataFrame:
    """leaf_id, id, depth: each start (without starts, each row) with itself (depth 0) and all its ancestors, however many.

    Rows jump to their parents, then to their parents' parents, and so on, so
    the number of joins grows with the logarithm of the depth. Each round takes
    the ancestors so far a jump further up. A chain ends where its parent is
    null or missing. In a cycle it ends before a row that it already has: from
    DEEP levels on, the nearest place of each ancestor counts, and the rounds
    end when none is new. Jumps meet a hot parent on one side only, so AQE can
    split it.
    """
    ids = rows.select("id").where("id IS NOT NULL").distinct()
    up = rows.where("id IS NOT NULL AND parent_id IS NOT NULL").select("id", "parent_id").join(ids.withColumnRenamed("id", "parent_id"), "parent_id", "left_semi")
    jump = materialise(up.select("id", F.col("parent_id").alias("to")), "jump")
    leaves = ids if starts is None else ids.join(starts.select("id").distinct(), "id", "left_semi")
    found = materialise(leaves.select(F.col("id").alias("leaf_id"), "id", F.lit(0).alias("depth")), "chains")
    step, size = 1, 0
    while not jump.isEmpty():
        further = found.join(jump, "id").select("leaf_id", F.col("to").alias("id"), (F.col("depth") + step).alias("depth"))
        longer, deep = found.union(further), step >= DEEP
        if deep:
            longer = longer.groupBy("leaf_id", "id").agg(F.min("depth").alias("depth"))
        longer = materialise(longer, "chains")
        free(found)
        found, grown = longer, longer.count() if deep else 0
        if deep and grown == size:
            break
        ahead = jump.join(jump.select(F.col("id").alias("to"), F.col("to").alias("next")), "to").select("id", F.col("next").alias("to"))
        again = materialise(ahead, "jump")
        free(jump)
        jump, size, step = again, grown, 2 * step
    free(jump)
    return found


def ancestor_chains(rows: DataFrame, starts: DataFrame | None = None) -> DataFrame:
    """leaf_id, depth (0: the row itself), and the columns of each row on the chain from a start up to its root; see ancestor_links()."""
    links = ancestor_links(rows, starts)
    return links.join(rows, "id").select("leaf_id", "depth", *rows.columns)


def context_texts(chains: DataFrame) -> DataFrame:
    """leaf_id, context, id, so_hieu: root first, each title and a space, then each content and a line feed.

    Contents of chapters and articles are left out, and null ones.
    """
    part = F.struct(F.negative("depth").alias("at"), "title", F.when(~strip(F.col("title")).rlike("^(Chương|Điều)"), F.col("content")).alias("content"))
    whole = chains.groupBy("leaf_id").agg(F.array_sort(F.collect_list(part)).alias("parts"), F.max_by("id", F.negative("depth")).alias("id"), F.max_by("so_hieu", F.negative("depth")).alias("so_hieu"))
    titles = F.array_join(F.transform("parts", lambda p: F.concat(p["title"], F.lit(" "))), "")
    contents = F.array_join(F.transform(F.filter("parts", lambda p: p["content"].isNotNull()), lambda p: F.concat(p["content"], F.lit("\n"))), "")
    return whole.select("leaf_id", F.concat(titles, contents).alias("context"), "id", "so_hieu")
