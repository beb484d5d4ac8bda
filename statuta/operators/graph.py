"""The knowledge graph as two tables: concepts and relations, with the documents that support them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from statuta.functions.text import normalize_term
from statuta.operators.synonyms import canonical

#: Values that an exported row holds at most, about.
VALUES = 100_000


def build_triplets(rows: DataFrame, synonyms: DataFrame | None = None) -> DataFrame:
    """Rows with c1, r, c2: incomplete ones leave, terms are normalised and replaced by their synonym's key."""
    whole = rows.where("coalesce(c1, '') <> '' AND coalesce(r, '') <> '' AND coalesce(c2, '') <> ''")
    for c in ("c1", "r", "c2"):
        whole = whole.withColumn(c, normalize_term(F.col(c)))
    return whole if synonyms is None else canonical(whole, ["c1", "r", "c2"], synonyms)


def node_support(triplets: DataFrame) -> DataFrame:
    """name, document_id, document_number: one row for each, the node table in normal form."""
    valid = triplets.dropna(subset=["c1", "r", "c2"])
    return valid.select(F.explode(F.array("c1", "c2")).alias("name"), "document_id", "document_number").distinct()


def edge_support(triplets: DataFrame) -> DataFrame:
    """c1, r, c2, document_id: one row for each."""
    return triplets.dropna(subset=["c1", "r", "c2"]).select("c1", "r", "c2", "document_id").distinct()


def _dealt(support: DataFrame, keys: list[str], values: list[str], most: int) -> DataFrame:
    """support with part: a key with more than `most` rows is dealt to so many parts, by its values, that a part holds about as many."""
    sizes = support.groupBy(*keys).agg(F.count(F.lit(1)).alias("_size")).where(F.col("_size") > most)
    part = F.coalesce(F.pmod(F.xxhash64(*values), F.ceil(F.col("_size") / most)), F.lit(0)).cast("int")
    return support.join(sizes, keys, "left").withColumn("part", part).drop("_size")


def merge_nodes(support: DataFrame, most: int = VALUES) -> DataFrame:
    """Export of the node table: name, part, document_id, document_number as sorted sets.

    A name with more than `most` supporting documents gives several rows, its
    parts, whose sets together are its support; no row or task holds them all.
    Counts and joins are taken on the support rows instead.
    """
    values = support.select("name", F.explode(F.array(F.struct(F.lit(0).alias("k"), F.col("document_id").alias("v")), F.struct(F.lit(1).alias("k"), F.col("document_number").alias("v")))).alias("x"))
    each = _dealt(values.select("name", "x.k", "x.v").distinct(), ["name"], ["k", "v"], 2 * most)
    sets = [F.array_sort(F.collect_list(F.when(F.col("k") == k, F.col("v")))).alias(c) for k, c in enumerate(("document_id", "document_number"))]
    return each.groupBy("name", "part").agg(*sets)


def merge_edges(support: DataFrame, most: int = VALUES) -> DataFrame:
    """Export of the edge table: c1, r, c2, part, source_document_ids as a sorted set; parts as in merge_nodes()."""
    each = _dealt(support, ["c1", "r", "c2"], ["document_id"], most)
    return each.groupBy("c1", "r", "c2", "part").agg(F.array_sort(F.collect_list("document_id")).alias("source_document_ids"))


def joined_sets(support: DataFrame, keys: list[str], values: list[str], mark: str = ",") -> DataFrame:
    """keys and, for each of values, its sorted set as one text: one row a key, whatever its support, for readers that want no parts.

    Values are dealt by ranges, so a key's values are sorted and joined in runs
    by many tasks, and its row is put together from the runs' texts, not from
    the values. The row itself must stay below Spark's 2 GB.
    """
    told = F.array(*[F.struct(F.lit(k).alias("k"), F.col(v).cast("string").alias("v")) for k, v in enumerate(values)])
    each = support.select(*keys, F.explode(told).alias("_x")).select(*keys, F.col("_x.k").alias("_k"), F.col("_x.v").alias("_v")).distinct()
    dealt = each.repartitionByRange(*keys, "_k", "_v").withColumn("_run", F.spark_partition_id())
    runs = dealt.groupBy(*keys, "_k", "_run").agg(F.count("_v").alias("_n"), F.array_join(F.array_sort(F.collect_list("_v")), mark).alias("_text"))
    rows = runs.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("_k", "_run", "_n", "_text"))).alias("_runs"))
    whole = lambda k: F.array_join(F.transform(F.filter("_runs", lambda r: (r["_k"] == k) & (r["_n"] > 0)), lambda r: r["_text"]), mark)
    return rows.select(*keys, *[whole(k).alias(v) for k, v in enumerate(values)])


def merge_into(current: DataFrame, delta: DataFrame) -> DataFrame:
    """Support rows of a graph and of a batch, each once: the same result in any order and on any repeat."""
    return current.unionByName(delta.select(*current.columns)).distinct()


def merge_properties(current: DataFrame, delta: DataFrame, keys: list[str], properties: str = "properties") -> DataFrame:
    """Map properties by key: those of delta override those of current."""
    new = delta.select(*keys, F.col(properties).alias("_new"))
    both = current.join(new, keys, "full")
    old = F.coalesce(F.map_filter(properties, lambda k, v: ~F.coalesce(F.map_contains_key(F.col("_new"), k), F.lit(False))), F.create_map().cast("map<string,string>"))
    return both.select(*keys, F.map_concat(old, F.coalesce("_new", F.create_map().cast("map<string,string>"))).alias(properties))


def merge_triplet(nodes: DataFrame, edges: DataFrame, triplet: tuple[str, str, str], c1_metadata: dict | None = None, c2_metadata: dict | None = None, rel_metadata: dict | None = None) -> tuple[DataFrame, DataFrame]:
    """Node table (name, properties) and edge table (c1, r, c2, properties) with one triplet merged in.

    What is not there yet is made; metadata given for it is laid over the
    properties that it has. Keys stay what they are.
    """
    c1, r, c2 = triplet
    spark = nodes.sparkSession
    ends = {c1: dict(c1_metadata or {})}
    ends.setdefault(c2, {}).update(c2_metadata or {})
    more = spark.createDataFrame(list(ends.items()), "name string, properties map<string,string>")
    edge = spark.createDataFrame([(c1, r, c2, dict(rel_metadata or {}))], "c1 string, r string, c2 string, properties map<string,string>")
    return merge_properties(nodes, more, ["name"]), merge_properties(edges, edge, ["c1", "r", "c2"])


def graph_counts(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One row: n_nodes, n_edges, from the support rows."""
    marked = nodes.select("name").distinct().select(F.lit(1).alias("n"), F.lit(0).alias("e")).union(edges.select("c1", "r", "c2").distinct().select(F.lit(0), F.lit(1)))
    return marked.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n_nodes"), F.coalesce(F.sum("e"), F.lit(0)).alias("n_edges"))


def relation_names(edges: DataFrame) -> DataFrame:
    return edges.where("r IS NOT NULL").select(F.col("r").alias("name")).distinct().orderBy("name")


def concept_names(nodes: DataFrame) -> DataFrame:
    return nodes.where("name IS NOT NULL").select("name").distinct().orderBy("name")


def triplets_for(edges: DataFrame, names: DataFrame) -> DataFrame:
    """relation, subject, object of the edges whose relation is among names (name), each once and in order."""
    wanted = edges.join(names.select(F.col("name").alias("r")).distinct(), "r", "left_semi").select("r", "c1", "c2").distinct()
    return wanted.select(F.col("r").alias("relation"), F.col("c1").alias("subject"), F.col("c2").alias("object")).orderBy("relation", "subject", "object")


def counts_for(edges: DataFrame, names: DataFrame) -> DataFrame:
    """relation, n (edges) for each requested name, 0 where it has no edge."""
    counts = edges.select("c1", "r", "c2").distinct().groupBy("r").agg(F.count(F.lit(1)).alias("n"))
    asked = names.select("name").distinct()
    return asked.join(counts, asked["name"] == counts["r"], "left").select(F.col("name").alias("relation"), F.coalesce("n", F.lit(0)).alias("n"))


def group_by_relation(edges: DataFrame, names: DataFrame, most: int = VALUES) -> DataFrame:
    """relation, part and sorted (subject, object) pairs, for the requested names; parts as in merge_nodes()."""
    each = _dealt(triplets_for(edges, names), ["relation"], ["subject", "object"], most)
    return each.groupBy("relation", "part").agg(F.array_sort(F.collect_list(F.struct("subject", "object"))).alias("pairs"))


def patterns(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """concept1, relation, concept2 with the number of documents of either end: node, edge, node. Documents are counted on the support rows."""
    sized = nodes.select("name", "document_id").distinct().groupBy("name").agg(F.count("document_id").alias("docs"))
    a, b, e = sized.alias("a"), sized.alias("b"), edges.select("c1", "r", "c2").distinct().alias("e")
    joined = e.join(a, F.expr("e.c1 = a.name")).join(b, F.expr("e.c2 = b.name"))
    return joined.select(F.col("e.c1").alias("concept1"), F.col("e.r").alias("relation"), F.col("e.c2").alias("concept2"), F.col("a.docs").alias("docs1"), F.col("b.docs").alias("docs2"))


def sample(rows: DataFrame, keys: list[str], k: int, seed: int = 0) -> DataFrame:
    """k rows without replacement, the same ones for a seed: the smallest hashes of the keys (a top-k, no full sort)."""
    text = F.concat_ws("|", *[F.col(c).cast("string") for c in keys], F.lit(str(seed)))
    return rows.orderBy(F.md5(text), *keys).limit(k)
