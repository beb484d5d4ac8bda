import hashlib

import xxhash
from pyspark.sql import functions as F

from statuta.llm import fingerprint as fp
from statuta.llm.queries import QUERIES


def edit(texts):
    out = []
    for i, t in enumerate(texts):
        t, after = t or "", texts[(i + 1) % len(texts)] or ""
        half = len(t) // 2
        out.append(t[: len(t) - half] + after[:half])
    return out


def test_query(spark):
    sf = "/root/testdata/sf0.01"
    rows = spark.read.parquet(f"{sf}/documents.parquet").orderBy("doc_id").collect()
    got = {r.doc_id: r for r in QUERIES["op10_fingerprint"](spark, sf).collect()}
    assert len(got) == len(rows)
    texts = [r.text for r in rows]
    by_text = {}
    for r, e in zip(rows, edit(texts), strict=True):
        g = got[r.doc_id]
        assert g.n_chars == len(r.text) and g.edited_sha256 == hashlib.sha256(e.encode()).hexdigest()
        assert by_text.setdefault(r.text, g.fingerprint) == g.fingerprint
        assert 0 <= g.near_edited <= 1 and 0 <= g.near_next <= 1
        assert len(g.fingerprint) == 8 * fp.BINS
    assert sum(g.near_edited > g.near_next for g in got.values()) > 0.9 * len(got)


def test_order_and_repeats_matter(spark):
    a = " ".join(f"w{i}" for i in range(400))
    swapped = " ".join([*(f"w{i}" for i in range(200, 400)), *(f"w{i}" for i in range(200))])
    one = a.replace("w77 ", "x ")
    texts = {"a": a, "same": a, "swapped": swapped, "one": one, "other": " ".join(f"v{i}" for i in range(400)), "twice": "p q r p q r s", "thrice": "p q r p q r p q r s", "": "", "long": "la " * 100_000}
    df = spark.createDataFrame(list(texts.items()), "name string, text string")
    sig = {r["name"]: r.sig for r in fp.signatures(df, {"text": "sig"}).collect()}
    near = lambda x, y: sum(p == q != 0 for p, q in zip(sig[x], sig[y], strict=True)) / fp.BINS
    assert sig["a"] == sig["same"]
    assert near("a", "other") == 0
    assert near("a", "one") > 0.9
    assert near("a", "swapped") < near("a", "one")
    assert sig["twice"] != sig["thrice"]


def test_cases(spark):
    rows = [(5, "abcd"), (None, "n"), (2, None), (9, ""), (5, "abcd"), (5, "abcz"), (2**62, "far away"), (-(2**62), "low")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("cell", F.lit("clash")).withColumn("last", F.lit(1))
    got = fp.edit_fingerprints(docs).collect()
    ordered = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    want = sorted(str((r[0], hashlib.sha256(e.encode()).hexdigest())) for r, e in zip(ordered, edit([t for _, t in ordered]), strict=True))
    assert sorted(str((r.doc_id, r.edited_sha256)) for r in got) == want
    assert fp.edit_fingerprints(docs.limit(0)).count() == 0
    one = fp.edit_fingerprints(spark.createDataFrame([(1, "abc")], "doc_id long, text string")).first()
    assert one.edited_sha256 == hashlib.sha256(b"aba").hexdigest() and one.near_next == 1.0


def test_cells_close_with_the_next_ones_first_row(spark, monkeypatch):
    monkeypatch.setattr(fp, "CELL_ROWS", 3)
    texts = [f"{i} " * (i % 7 + 1) + "tail" for i in range(100)]
    docs = spark.createDataFrame([(i * i, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(6)
    got = {r.doc_id: r.edited_sha256 for r in fp.edit_fingerprints(docs).collect()}
    assert got == {i * i: hashlib.sha256(e.encode()).hexdigest() for i, e in enumerate(edit(texts))}


def chained(*parts, seed=42):
    for p in parts:
        seed = xxhash.xxh64_intdigest(p.encode() if isinstance(p, str) else (p & (2**64 - 1)).to_bytes(8, "little") if p.bit_length() > 31 or isinstance(p, Long) else p.to_bytes(4, "little", signed=True), seed)
    return seed - (1 << 64) if seed >> 63 else seed


class Long(int):
    """A number that Spark holds in 64 bits."""


def brute_signature(text):
    """The signature from its definition, with plain lists: numbered k-mers, bins, the two least in text order."""
    words = text.split(" ")
    grams = [chained(*words[i : i + 3]) for i in range(len(words) - 2)] or [chained(*words)]
    seen, numbered = {}, []
    for place, g in enumerate(grams):
        g >>= fp.PLACE_BITS
        numbered.append((chained(Long(g), seen.get(g, 0)) >> fp.PLACE_BITS, place))
        seen[g] = seen.get(g, 0) + 1
    out = []
    for b in range(-fp.BINS // 2, fp.BINS // 2):
        own = sorted((h, p) for h, p in numbered if h >> (64 - fp.PLACE_BITS - 6) == b)[:2]
        least = [Long(h) for h, _ in sorted(own, key=lambda x: x[1])]
        out.append(chained(*least) & 0xFFFFFFFF if least else 0)
    return out


def brute_likeness(a, b):
    return sum(x == y != 0 for x, y in zip(a, b, strict=True)) / max(1, sum(x != 0 or y != 0 for x, y in zip(a, b, strict=True)))


def test_query_matches_brute_force(spark):
    sf = "/root/testdata/sf0.001"
    rows = spark.read.parquet(f"{sf}/documents.parquet").orderBy("doc_id").collect()
    texts = [r.text or "" for r in rows]
    own, edited = [brute_signature(t) for t in texts], [brute_signature(t) for t in edit(texts)]
    as_hex = lambda s: "".join(f"{v:08x}" for v in s)
    got = {r.doc_id: r for r in QUERIES["op10_fingerprint"](spark, sf).collect()}
    for i, r in enumerate(rows):
        g = got[r.doc_id]
        assert (g.fingerprint, g.edited_fingerprint) == (as_hex(own[i]), as_hex(edited[i]))
        assert abs(g.near_edited - brute_likeness(own[i], edited[i])) < 1e-12
        assert abs(g.near_next - brute_likeness(own[i], own[(i + 1) % len(own)])) < 1e-12


def test_long_text_through_the_operator(spark):
    long = " ".join(f"w{i}" for i in range(300_000))
    docs = spark.createDataFrame([(1, long), (2, long + " end"), (3, "x")], "doc_id long, text string")
    got = {r.doc_id: r for r in fp.edit_fingerprints(docs).collect()}
    assert got[1].near_next > 0.95 and 0 < got[1].near_edited < 0.6 and got[3].n_chars == 1
