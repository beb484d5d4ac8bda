from statuta.llm import fingerprint as fp


def test_far_off_ids_do_not_crowd_the_cells(spark, monkeypatch):
    monkeypatch.setattr(fp, "CELL_ROWS", 50)
    ids = [None, -(2**62), *range(2000), 10**9, 2**62]
    docs = spark.createDataFrame([(i, f"text {i}") for i in ids], "doc_id long, text string").repartition(6)
    rows = fp.with_next(docs)[0].where("NOT last").select("cell", "key").collect()
    assert len(rows) == len(ids)
    cells = {}
    for r in rows:
        cells.setdefault(r.cell, []).append(r.key)
    assert max(map(len, cells.values())) <= 100
    spans = sorted((min(k), max(k), c) for c, k in cells.items())
    assert all(x[1] < y[0] and x[2] < y[2] for x, y in zip(spans, spans[1:]))
