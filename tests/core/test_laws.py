import hashlib

import pytest

from statuta.operators import hierarchy, lawdoc

LINES = ["QUỐC HỘI", "Số: 92/2015/QH13", "BỘ LUẬT", "TỐ TỤNG", "Căn cứ Hiến pháp", "Chương I", "QUY ĐỊNH CHUNG", "Mục 1", "PHẠM VI", "Điều 1. Phạm vi điều chỉnh", "1. Bộ luật này", "a) Nội dung;", "tiếp theo", "Điều 2. Đối tượng"]
P = "92/2015/QH13"


def parsed(spark, docs, **options):
    rows = [(d, i, x) for d, lines in docs.items() for i, x in enumerate(lines)]
    lines = spark.createDataFrame(rows, "doc string, line_no int, line string").repartition(3)
    heads = lawdoc.law_headers(lines)
    return {r.doc: (r.so_hieu, r.title, r.content) for r in heads.collect()}, lawdoc.law_provisions(lines, heads, **options).orderBy("doc", "seg").collect()


def test_golden(spark):
    heads, rows = parsed(spark, {"d": LINES})
    assert heads == {"d": (P, "BỘ LUẬT TỐ TỤNG", "Căn cứ Hiến pháp")}
    base = f"{P}_Chương I"
    want = [
        ("Chương I", "QUY ĐỊNH CHUNG", None, base),
        ("Mục 1", "PHẠM VI", base, f"{base}_Mục 1"),
        ("Điều 1", "Phạm vi điều chỉnh", f"{base}_Mục 1", f"{base}_Mục 1_Điều 1"),
        ("Khoản 1", "Bộ luật này", f"{base}_Mục 1_Điều 1", f"{base}_Mục 1_Điều 1_Khoản 1"),
        ("Điểm a", "Nội dung; tiếp theo", f"{base}_Mục 1_Điều 1_Khoản 1", f"{base}_Mục 1_Điều 1_Khoản 1_Điểm a"),
        ("Điều 2", "Đối tượng", f"{base}_Mục 1", f"{base}_Mục 1_Điều 2"),
    ]
    sha = lambda x: x and hashlib.sha256(x.encode()).hexdigest()
    assert [(r.title, r.content, r.parent_id, r.path, r.id) for r in rows] == [(t, c, sha(u), p, sha(p)) for t, c, u, p in want]


def test_edges(spark):
    docs = {
        "orphan": ["Số: 1", "Điều 1. x", "b) y"],
        "number": ["Số: 2", "Điều 1. x", "1.2 z"],
        "body": ["Số: 3", "Điều 1. x", "Điều kiện chung"],
        "twice": ["Số: 4", "Chương I", "A", "Chương I", "B"],
        "none": ["Điều 1. x"],
        "accent": ["Số: 5", "é) first", "ê) more", "Chương I"],
        "reset": ["Số: 6", "Chương I", "Mục 1", "Điều 1. a", "1. b", "Chương II", "Điều 2. c", "d) e"],
        "early": ["  ", "lead in", "Số: 7 / 8", "ngày 1 tháng 2 năm 2020", "LUẬT\nChương x", "sau", "Chương I"],
    }
    heads, rows = parsed(spark, docs)
    by_doc = {}
    for r in rows:
        by_doc.setdefault(r.doc, []).append(r)
    orphan = by_doc["orphan"][1]
    assert orphan.parent_id is None and orphan.path == "1__Điều 1__Điểm b"
    assert (by_doc["number"][1].title, by_doc["number"][1].content) == ("Khoản 1", "2 z")
    assert [r.title for r in by_doc["body"]] == ["Điều 1", "Điều kiện chung"]
    assert [r.content for r in by_doc["twice"]] == ["B"]
    assert "none" not in by_doc and heads["none"] == (None, "", "")
    assert [(r.title, r.content) for r in by_doc["accent"]] == [("Điểm é", "first ê) more"), ("Chương I", None)]
    assert [r.path for r in by_doc["reset"]][-2:] == ["6_Chương II_Điều 2", "6_Chương II_Điều 2__Điểm d"]
    assert heads["early"] == ("7/8", "lead in LUẬT sau", "")
    _, strict = parsed(spark, {"body": docs["body"]}, strict_headings=True)
    assert [(r.title, r.content) for r in strict] == [("Điều 1", "x Điều kiện chung")]


def test_every_parent_exists_or_is_null(spark):
    _, rows = parsed(spark, {"d": LINES})
    ids = {r.id for r in rows}
    assert all(r.parent_id is None or r.parent_id in ids for r in rows)


def test_chains(spark):
    rows = spark.createDataFrame([("1", None, "Chương I", "A", "n"), ("2", "1", "Khoản 1", None, "n"), ("3", "2", "Điểm a", "C", "n"), ("4", "9", "Điều 4", "D", "n"), ("5", "5", "x", "loop", "n")], "id string, parent_id string, title string, content string, so_hieu string")
    starts = spark.createDataFrame([("3",), ("4",), ("77",)], "id string")
    chains = hierarchy.ancestor_chains(rows, starts)
    got = {}
    for r in chains.orderBy("leaf_id", "depth").collect():
        got.setdefault(r.leaf_id, []).insert(0, r.id)
    assert got == {"3": ["1", "2", "3"], "4": ["4"]}
    texts = {r.leaf_id: (r.context, r.id) for r in hierarchy.context_texts(chains).collect()}
    assert texts == {"3": ("Chương I Khoản 1 Điểm a C\n", "3"), "4": ("Điều 4 ", "4")}
    tree = rows.where("id <> '5'")
    assert sorted((r.leaf_id, r.depth, r.id) for r in hierarchy.ancestor_links(tree).collect()) == sorted((r.leaf_id, r.depth, r.id) for r in hierarchy.ancestor_chains(tree).collect())
    assert hierarchy.ancestor_chains(rows).where("leaf_id = '5'").count() == 1


def test_upsert(spark):
    now = spark.createDataFrame([("a", 1), ("b", 2)], "id string, v int")
    delta = spark.createDataFrame([("b", 3, 0), ("b", 4, 1), ("c", 5, 0)], "id string, v int, seq int")
    assert sorted(tuple(r) for r in lawdoc.upsert(now, delta, ["id"], ["seq"]).collect()) == [("a", 1), ("b", 4), ("c", 5)]


def links(spark, pairs, starts=None):
    rows = spark.createDataFrame(pairs, "id string, parent_id string")
    made = hierarchy.ancestor_links(rows, None if starts is None else spark.createDataFrame([(x,) for x in starts], "id string"))
    got = {}
    for r in made.orderBy("leaf_id", "depth").collect():
        got.setdefault(r.leaf_id, []).append(r.id)
    return got


@pytest.mark.parametrize("n", [1, 8, 200])
def test_chains_of_any_depth(spark, n):
    got = links(spark, [(str(i), str(i - 1) if i else None) for i in range(n)])
    assert got == {str(i): [str(k) for k in range(i, -1, -1)] for i in range(n)}


def test_cycles_end_before_a_row_comes_again(spark):
    pairs = [("a", "b"), ("b", "c"), ("c", "a"), ("tail", "a"), ("longer", "tail"), ("self", "self"), ("over", "self"), ("root", None), ("leaf", "root"), ("lost", "gone"), (None, "root")]
    want = {"a": "abc", "b": "bca", "c": "cab"}
    got = links(spark, pairs)
    assert {k: "".join(got[k]) for k in want} == want
    assert got["longer"] == ["longer", "tail", "a", "b", "c"] and got["self"] == ["self"] and got["over"] == ["over", "self"]
    assert got["leaf"] == ["leaf", "root"] and got["lost"] == ["lost"] and None not in got
    assert links(spark, [("a", "b"), ("b", "c"), ("c", "a"), ("t", "a")], ["t"]) == {"t": ["t", "a", "b", "c"]}
    assert links(spark, pairs, ["longer", "nobody"]) == {"longer": got["longer"]}


def test_a_million_rows(spark):
    """More rows than a recursive query may make."""
    rows = spark.range(400_000).selectExpr("CAST(id AS STRING) AS id", "IF(id < 4, NULL, CAST(id DIV 4 AS STRING)) AS parent_id")
    links_ = hierarchy.ancestor_links(rows)
    depth = lambda i: 1 + depth(i // 4) if i >= 4 else 1
    assert links_.count() == sum(depth(i) for i in range(400_000)) > 1_000_000
