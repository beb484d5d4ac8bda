import random
import sqlite3
import zipfile

import duckdb
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from statuta.operators import annotate, graph, infer
from statuta.plans import queries
from statuta.plans.build_graph import Settings, build, extracted, extracted_once, triplets_of
from statuta.sources import files, sinks
from statuta.sources.sqlite import read_sqlite, sqlite_tables
from statuta.streaming import incremental

ROWS = [("d1", "n1", "A", "r", "B"), ("d1", "n1", "A", "r", "B"), ("d2", "n2", "A", "r", "B"), ("d2", "n2", "B", "s", "B")]
KIND = "document_id string, document_number string, c1 string, r string, c2 string"


def merged(spark, rows):
    df = spark.createDataFrame(rows, KIND)
    nodes = {r["name"]: (r.document_id, r.document_number) for r in graph.merge_nodes(graph.node_support(df)).collect()}
    edges = {(r.c1, r.r, r.c2): r.source_document_ids for r in graph.merge_edges(graph.edge_support(df)).collect()}
    return nodes, edges


def test_golden(spark):
    nodes, edges = merged(spark, ROWS)
    assert nodes == {"A": (["d1", "d2"], ["n1", "n2"]), "B": (["d1", "d2"], ["n1", "n2"])}
    assert edges == {("A", "r", "B"): ["d1", "d2"], ("B", "s", "B"): ["d2"]}


@settings(max_examples=8, deadline=None)
@given(st.lists(st.tuples(*[st.sampled_from(["a", "b", "c", None]) for _ in range(5)]), max_size=12), st.randoms())
def test_order_and_repeats_do_not_matter(spark, rows, rng):
    mixed = rows + rows[: len(rows) // 2]
    rng.shuffle(mixed)
    nodes, edges = merged(spark, rows)
    assert merged(spark, mixed) == (nodes, edges)
    for (c1, _, c2), ids in edges.items():
        for end in (c1, c2):
            assert set(ids) <= set(nodes[end][0])


def test_queries(spark):
    df = spark.createDataFrame(ROWS, KIND)
    nodes, edges = graph.node_support(df), graph.edge_support(df)
    assert tuple(graph.graph_counts(nodes, edges).first()) == (2, 2)
    assert tuple(graph.graph_counts(nodes.limit(0), edges.limit(0)).first()) == (0, 0)
    names = spark.createDataFrame([("s",), ("none",)], "name string")
    assert [tuple(r) for r in graph.triplets_for(edges, names).collect()] == [("s", "B", "B")]
    assert sorted(tuple(r) for r in graph.counts_for(edges, names).collect()) == [("none", 0), ("s", 1)]
    assert [r["name"] for r in graph.relation_names(edges).collect()] == ["r", "s"]
    assert sorted(tuple(r) for r in graph.patterns(nodes, edges).collect()) == [("A", "r", "B", 2, 2), ("B", "s", "B", 2, 2)]
    assert graph.sample(nodes.select("name").distinct(), ["name"], 5).count() == 2
    a = graph.sample(spark.range(100), ["id"], 7, 3).collect()
    assert a == graph.sample(spark.range(100).repartition(5), ["id"], 7, 3).collect() and len({r.id for r in a}) == 7


def test_building_drops_incomplete_and_normalises(spark):
    rows = [("d", "n", "A_b", "R", "C"), ("d", "n", "", "R", "C"), ("d", "n", None, "R", "C"), ("d", "n", "_", "R", "C")]
    got = graph.build_triplets(spark.createDataFrame(rows, KIND)).select("c1", "r", "c2").collect()
    assert sorted(tuple(r) for r in got) == [("", "r", "c"), ("a b", "r", "c")]


def test_hot_keys_are_exported_in_parts(spark):
    rows = [(f"d{i}", f"n{i % 40}", "hot", "r", f"o{i % 3}") for i in range(300)]
    df = spark.createDataFrame(rows, KIND)
    parts = graph.merge_nodes(graph.node_support(df), most=25).where("name = 'hot'").collect()
    assert len(parts) > 3 and max(len(p.document_id) for p in parts) < 100
    assert sorted(d for p in parts for d in p.document_id) == sorted(r[0] for r in rows)
    assert sorted(d for p in parts for d in p.document_number) == sorted({r[1] for r in rows})
    edges = graph.merge_edges(graph.edge_support(df), most=25)
    assert edges.count() > 3 and edges.selectExpr("explode(source_document_ids) AS d").count() == 300
    names = spark.createDataFrame([("r",)], "name string")
    pairs = graph.group_by_relation(graph.edge_support(df), names, most=1).selectExpr("explode(pairs) AS p")
    assert sorted((r.p.subject, r.p.object) for r in pairs.collect()) == [("hot", f"o{k}") for k in range(3)]


def test_single_triplet(spark):
    nodes = spark.createDataFrame([("a", {"k": "1", "old": "x"})], "name string, properties map<string,string>")
    edges = spark.createDataFrame([], "c1 string, r string, c2 string, properties map<string,string>")
    for _ in range(2):
        nodes, edges = graph.merge_triplet(nodes, edges, ("a", "r", "b"), {"k": "2"}, {"t": "3"}, {"w": "4"})
    assert {r["name"]: r.properties for r in nodes.collect()} == {"a": {"old": "x", "k": "2"}, "b": {"t": "3"}}
    assert [(r.c1, r.r, r.c2, r.properties) for r in edges.collect()] == [("a", "r", "b", {"w": "4"})]


def test_a_document_that_fails_is_reported(spark):
    def picky():
        inner = annotate.stub_annotator()
        return lambda sentence: 1 / 0 if "bad" in sentence else inner(sentence)

    laws = spark.createDataFrame([("1", "n", "a b c"), ("2", "n", "bad b c"), ("3", "n", "d e f")], "id string, so_hieu string, content string")
    settings = Settings(annotator=picky, sentence_scope="all")
    assert sorted((r.document_id, r.error) for r in extracted(laws, settings).collect()) == [("1", None), ("2", "ZeroDivisionError: division by zero"), ("3", None)]
    assert {r.document_id for r in triplets_of(laws, settings).collect()} == {"1", "3"}
    assert build(laws, None, settings)[1].count() == 2


def test_annotations_of_a_tool_outside(spark, tmp_path):
    told = [("d", 0, i, w, p, None, h, x) for i, w, p, h, x in [(1, "cơ quan", "N", 2, "sub"), (2, "cấp", "V", 0, "root"), (3, "phép", "N", 2, "dob")]]
    tokens = spark.createDataFrame(told, "doc_id string, sent_id int, id int, word string, pos string, ner string, head int, deprel string")
    sinks.write_annotations(tokens, str(tmp_path / "a"))
    read = annotate.read_annotations(spark, str(tmp_path / "a")).first()
    assert read.sentence == "cơ quan cấp phép" and [t.head for t in read.tokens] == [2, 0, 2] and read.tokens[0].ner is None
    laws = spark.createDataFrame([("1", "n", "Cơ quan cấp phép"), ("2", "n", "khác")], "id string, so_hieu string, content string")
    store = infer.create_answers(spark, str(tmp_path / "store"), annotate.TOKENS, 4)
    told = annotate.read_annotations(spark, str(tmp_path / "a")).select("sentence", F.col("tokens").alias("answer"))
    assert infer.add_answers(store, "files", told) == 1 and infer.add_answers(store, "files", told) == 0
    got = extracted_once(laws, Settings(annotator=infer.no_model()), store, "files")
    assert sorted((r.document_id, r.c1, r.r, r.c2, r.error) for r in got.collect()) == [("1", "cơ quan", "cấp", "phép", None), ("2", None, None, None, "LookupError: no answer to this sentence")]


def test_tables(spark, tmp_path):
    for name in ("laws", "law_refs"):
        spark.sql(f"DROP TABLE IF EXISTS {name}")
    sinks.create_tables(spark)
    sinks.create_tables(spark)
    spark.sql("INSERT INTO laws VALUES ('1', 't', 'c', NULL, 'n')")
    assert spark.table("laws").count() == 1 and spark.table("law_refs").columns == ["so_hieu", "title", "content"]
    sinks.clear_tables(spark)
    assert spark.table("laws").count() == 0
    for name in ("laws", "law_refs"):
        spark.sql(f"DROP TABLE {name}")


def test_late_rows_are_counted_in_their_window(spark, tmp_path):
    rows = [("2024-01-01 00:10:00", "r"), ("2024-01-01 00:50:00", "r"), ("2024-01-01 01:10:00", "s")]
    spark.createDataFrame(rows, "ts string, r string").selectExpr("CAST(ts AS TIMESTAMP) AS ts", "r").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("ts timestamp, r string").parquet(str(tmp_path / "in"))
    query = incremental.late_counts(stream).writeStream.outputMode("complete").format("memory").queryName("late").trigger(availableNow=True).start()
    query.awaitTermination()
    assert sorted((str(r.start), r.r, r.n) for r in spark.table("late").collect()) == [("2024-01-01 00:00:00", "r", 2), ("2024-01-01 01:00:00", "s", 1)]


def test_properties(spark):
    now = spark.createDataFrame([("a", {"x": "1", "y": "2"}), ("b", None)], "k string, properties map<string,string>")
    new = spark.createDataFrame([("a", {"y": "3"}), ("c", {"z": "4"})], "k string, properties map<string,string>")
    got = {r.k: r.properties for r in graph.merge_properties(now, new, ["k"]).collect()}
    assert got == {"a": {"x": "1", "y": "3"}, "b": {}, "c": {"z": "4"}}


def test_stream_equals_batch(spark, tmp_path):
    rng = random.Random(4)
    rows = [(f"d{rng.randrange(9)}", "n", rng.choice("abc"), rng.choice("rs"), rng.choice("abc")) for _ in range(60)]
    df = spark.createDataFrame(rows, KIND)
    for lo in (0, 30):
        spark.createDataFrame(rows[lo : lo + 40], KIND).coalesce(1).write.mode("append").json(str(tmp_path / "in"))
    stream = spark.readStream.schema(KIND).option("maxFilesPerTrigger", 1).json(str(tmp_path / "in"))
    incremental.ingest(stream, str(tmp_path / "graph"), str(tmp_path / "mark")).awaitTermination()
    support = incremental.read_support(spark, str(tmp_path / "graph"), "edges")
    want = graph.edge_support(graph.build_triplets(df))
    assert sorted(map(tuple, support.select(*want.columns).collect())) == sorted(map(tuple, want.collect()))


def test_build(spark):
    laws = spark.createDataFrame([("1", "n", "Cơ quan cấp phép. Sau đó thu"), ("2", "n", None), ("3", "n", "  "), (None, "n", "a b c")], "id string, so_hieu string, content string")
    rows = triplets_of(laws, Settings(sentence_scope="all"))
    assert {r.document_id for r in rows.collect()} == {"1", "None"}
    nodes, edges = build(laws, None, Settings())
    assert edges.where("c1 = 'a' AND r = 'b' AND c2 = 'c'").first().document_id == "None"


def test_sqlite(spark, tmp_path):
    path = str(tmp_path / "laws.db")
    with sqlite3.connect(path) as db:
        db.execute('CREATE TABLE laws (id TEXT PRIMARY KEY, title TEXT NOT NULL, n INTEGER, "odd name" REAL)')
        db.executemany("INSERT INTO laws VALUES (?, ?, ?, ?)", [(str(i), f"Điểm {i}" if i % 2 else "Điều", i, i / 2) for i in range(50)])
        db.execute("CREATE TABLE empty (a TEXT)")
    laws = read_sqlite(spark, path, "laws", 4)
    assert laws.count() == 50 and laws.schema["n"].dataType.simpleString() == "bigint"
    assert [r.id for r in laws.where(F.col("id") == "7").collect()] == ["7"]
    assert laws.where(F.col("title").contains("Điểm")).count() == 25
    assert read_sqlite(spark, path, "empty").count() == 0
    assert read_sqlite(spark, path, "laws", columns=["id", "n"]).columns == ["id", "n"]
    with sqlite3.connect(path) as db:
        db.execute("CREATE TABLE keyed (k TEXT PRIMARY KEY, v INTEGER) WITHOUT ROWID")
        db.execute("INSERT INTO keyed VALUES ('x', 1), ('y', 2)")
    assert read_sqlite(spark, path, "keyed").where(F.col("k") == "y").first().v == 2
    assert sqlite_tables(path) == ["empty", "keyed", "laws"]


def test_files(spark, tmp_path):
    w = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    p = lambda t: f"<w:p><w:r><w:t>{t}</w:t></w:r></w:p>"
    body = p("Số: 1") + p(" ") + f"<w:tbl><w:tr><w:tc>{p('a')}{p('b')}</w:tc><w:tc>{p('c')}</w:tc></w:tr></w:tbl>" + p("Điều 1. x")
    (tmp_path / "deep").mkdir()
    with zipfile.ZipFile(tmp_path / "deep" / "law.DOCX", "w") as z:
        z.writestr("word/document.xml", f"<w:document {w}><w:body>{body}</w:body></w:document>")
    (tmp_path / "bad.docx").write_bytes(b"not a zip")
    (tmp_path / "other.txt").write_text("x")
    found = files.find_documents(spark, str(tmp_path))
    rows = files.extract_lines(found).orderBy("doc", "line_no").collect()
    assert [r.line for r in rows if r.error is None] == ["Số: 1", "a\nb", "c", "Điều 1. x"]
    assert sum(r.error is not None for r in rows) == 1
    pages = files.extract_pages(found, lambda b: ["one", "two"] if b[:2] == b"PK" else 1 / 0).collect()
    assert sorted((r.n_pages, r.text, r.has_text) for r in pages if r.error is None) == [(2, "one\ntwo", True)]
    (tmp_path / "old.doc").write_bytes(b"old")
    made = files.converted(files.find_documents(spark, str(tmp_path)).where("path LIKE '%.doc'"), lambda b: b.upper()).first()
    assert made.path.endswith("old.docx") and bytes(made.content) == b"OLD" and made.error is None
    assert files.converted(found, lambda b: 1 / 0).where("error IS NULL").count() == 0
    (tmp_path / "s.txt").write_text("a\r\n\nb\n")
    assert [(r.line_no, r.value) for r in files.numbered_lines(spark, str(tmp_path / "s.txt")).collect()] == [(0, "a"), (1, ""), (2, "b")]
    assert files.annotator_lines(spark, str(tmp_path / "s.txt")).count() == 2
    assert files.whole_text(spark, str(tmp_path / "other.txt")) == "x"
    (tmp_path / "w.tsv").write_text("words\tlàm việc\nlocations\thà nội\n")
    assert sorted(tuple(r) for r in files.word_lists(spark, str(tmp_path / "w.tsv")).collect()) == [("locations", "hà nội"), ("words", "làm việc")]


def lines_of(spark, path):
    return [r.value for r in sorted(spark.read.text(str(path)).select("value", F.input_file_name().alias("f"), F.monotonically_increasing_id().alias("i")).collect(), key=lambda r: (r.f, r.i))]


def test_sinks(spark, tmp_path):
    names = spark.createDataFrame([("b ",), ("a",), ("b",)], "name string")
    sinks.write_names(names, str(tmp_path / "names"))
    assert lines_of(spark, tmp_path / "names") == ["a", "b"]
    t = spark.createDataFrame([("r", "x", "y"), ("r", "a", "b"), ("q", "m", "n")], "relation string, subject string, object string")
    sinks.write_relation_sections(t, str(tmp_path / "sections"))
    assert lines_of(spark, tmp_path / "sections") == ["=== Relation: q ===", "m\tq\tn", "", "=== Relation: r ===", "a\tr\tb", "x\tr\ty", ""]
    words = spark.createDataFrame([("d", 0, 2, "b", "V", None, 0, "root"), ("d", 0, 1, "a", "N", "O", 2, "sub")], "doc_id string, sent_id int, id int, word string, pos string, ner string, head int, deprel string")
    assert sinks.annotation_text(words).first().value == "1\ta\tN\tO\t2\tsub\n2\tb\tV\t_\t0\troot\n"
    nodes, edges = sinks.empty_graph(spark)
    assert nodes.count() == edges.count() == 0
    one, two = sinks.write_snapshot(names, str(tmp_path / "snap")), sinks.write_snapshot(names, str(tmp_path / "snap"))
    assert one != two and spark.read.parquet(one).count() == 3


def test_registered_queries_have_matching_columns(spark):
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).count() > 0


@pytest.mark.parametrize("name", ["merge_nodes", "merge_edges", "incremental_merge"])
def test_merged_rows_are_whole_beyond_the_size_of_a_part(spark, tmp_path, name):
    """230,000 documents of one edge: more than an exported part holds, one row in the SQL."""
    for t in ("customer", "nation"):
        spark.read.parquet(f"/root/testdata/sf0.001/{t}.parquet").write.parquet(str(tmp_path / f"{t}.parquet"))
    one = spark.read.parquet("/root/testdata/sf0.001/customer.parquet").agg(F.min("c_custkey")).first()[0]
    spark.range(300_000).selectExpr("id AS o_orderkey", f"CAST({one} AS BIGINT) AS o_custkey", "'F' AS o_orderstatus").write.parquet(str(tmp_path / "orders.parquet"))
    con = duckdb.connect()
    for t in ("customer", "nation", "orders"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet/*.parquet'")
    got = queries.QUERIES[name](spark, str(tmp_path))
    made = con.execute(queries.ORACLES[name])
    assert got.columns == [d[0] for d in made.description]
    assert sorted(map(tuple, got.collect())) == sorted(made.fetchall())


def test_joined_sets_by_hand(spark):
    rows = [("a", "2", None), ("a", "10", ""), ("a", "2", "x"), ("b", None, None), (None, "1", "é,")]
    got = graph.joined_sets(spark.createDataFrame(rows, "k string, p string, q string"), ["k"], ["p", "q"])
    assert sorted(map(tuple, got.collect()), key=str) == sorted([("a", "10,2", ",x"), ("b", "", ""), (None, "1", "é,")], key=str)
