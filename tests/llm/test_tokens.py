import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import sentencepiece
from pyspark.sql import functions as F
from sentencepiece import sentencepiece_model_pb2 as pb
from tokenizers import Tokenizer

from statuta.llm import packing
from statuta.llm import sentencepiece_codec as codec
from statuta.llm.queries import QUERIES

ODD = ["", " ", "  ", "\n", "a\nb", "\n\n x", " \n ", "a  b", " \t x\r\n y", "▁", "a▁▁b", "<s> </s> <unk>", "日本語 テスト", "é́ x", "\0a\0", "<|endoftext|> hi", "don't we'll’s  12 34", "x \n\n  y\n", "👍🏽 ok", "\u0085a\u001cb", "<0x0A>"]
rng = random.Random(1)
ODD += ["".join(rng.choice(" \n\n  ab'sThe12é日▁\t .!<>👍　Ωж") for _ in range(rng.randrange(1, 40))) for _ in range(500)]
SF = "/root/testdata/sf0.001"


def test_byte_bpe_matches_the_library():
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    own = packing.tokenizer("byte_bpe_50k.json")
    for t in ODD:
        assert own.encode(t) == np.array(library.encode(t, add_special_tokens=False).ids, "<u4").tobytes(), t


def test_sentencepiece_matches_the_library():
    own = codec.codec("piece_bpe_32k.model")
    for t in ODD:
        ids, starts, ends, decoded = own.encode(t)
        want = own.model.encode(t, return_type="proto")
        assert list(ids) == [p.id for p in want.pieces], t
        assert decoded == own.model.decode(list(map(int, ids))), t
        data = t.encode()
        for i, a, b, p in zip(ids, starts, ends, want.pieces, strict=True):
            if not p.piece.startswith("<0x"):
                assert (a, b) == (p.begin, p.end), t
        assert "▁" in t or b"".join(data[a:b] for a, b in zip(starts, ends, strict=True)) == data


def test_normalizer_follows_the_compiled_character_map():
    for rule in ("nfkc", "nmt_nfkc_cf"):
        library = sentencepiece.SentencePieceNormalizer(rule_name=rule)
        proto = pb.ModelProto()
        proto.ParseFromString(library.serialized_model_proto())
        own = codec.Normalizer(proto.normalizer_spec)
        for t in ["ﬁne  ㌔ Ⅷ ｶﾞ  x ", " é́ ①②", *ODD]:
            if "\0" not in t:
                norm, places = own(t)
                assert norm.decode() == library.normalize(t), (rule, t)
                assert len(places) == len(norm) + 1 and (np.diff(places) >= 0).all()


def own_spans(model, text):
    """First and last-plus-one byte of each piece by the library, whose spans of the bytes of one character are set apart."""
    out, size = [], len(text.encode())
    pieces = model.encode(text, return_type="proto").pieces
    for p in pieces:
        out.append((out[-1][1] if out else 0, min(size, (out[-1][1] if out else 0) + 1)) if p.piece.startswith("<0x") else (p.begin, p.end))
    return out


def test_sentencepiece_query(spark):
    model = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    library = {i: own_spans(model, t) for i, t in texts.items()}
    told = spark.createDataFrame([(i, [a for a, _ in s], [b for _, b in s]) for i, s in library.items()], "doc_id long, starts array<int>, ends array<int>")
    spans = {r.doc_id: r.h for r in told.select("doc_id", F.xxhash64("starts", "ends").alias("h")).collect()}
    for r in QUERIES["op3_sentencepiece"](spark, SF).collect():
        ids = model.encode(texts[r.doc_id])
        assert r.n_tokens == len(ids) and r.n_bytes == len(texts[r.doc_id].encode())
        assert r.spans_xxhash64 == spans[r.doc_id]
        assert r.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(model.decode(ids).encode()).hexdigest()


def test_codec_with_a_character_map(tmp_path):
    """The same pieces behind the normaliser of another rule: ids, spans and decoded text as the library gives them."""
    for rule in ("nmt_nfkc", "nfkc_cf"):
        normalizer, proto = pb.ModelProto(), pb.ModelProto()
        normalizer.ParseFromString(sentencepiece.SentencePieceNormalizer(rule_name=rule).serialized_model_proto())
        with open(public_tokenizers.path("piece_bpe_32k.model"), "rb") as f:
            proto.ParseFromString(f.read())
        proto.normalizer_spec.precompiled_charsmap = normalizer.normalizer_spec.precompiled_charsmap
        proto.normalizer_spec.remove_extra_whitespaces = rule == "nmt_nfkc"
        path = tmp_path / f"{rule}.model"
        path.write_bytes(proto.SerializeToString())
        own = codec.Codec(str(path))
        assert own.normalize.map.units and not own.split
        for t in ["ﬁne  ㌔ Ⅷ ｶﾞ  x ", " é́ ①② ½", "Ａ full  width", *ODD]:
            if "\0" in t:
                continue
            ids, starts, ends, decoded = own.encode(t)
            want = own.model.encode(t, return_type="proto").pieces
            assert list(ids) == [p.id for p in want], (rule, t)
            assert decoded == own.model.decode(list(map(int, ids)))
            for a, b, p in zip(starts, ends, want, strict=True):
                if not p.piece.startswith("<0x"):
                    assert (a, b) == (p.begin, p.end), (rule, t, p.piece)


def test_long_text_is_encoded_whole():
    own = codec.codec("piece_bpe_32k.model")
    text = " ".join(f"word{i % 977} été\n" for i in range(60_000))
    ids, starts, ends, decoded = own.encode(text)
    assert list(ids) == own.model.encode(text) and decoded == text and ends[-1] == len(text.encode())


def test_packing_query_does_not_depend_on_cores(spark, monkeypatch):
    made = []
    for cores in (3, 16):
        monkeypatch.setattr(type(spark.sparkContext), "defaultParallelism", cores)
        made.append(sorted(map(tuple, QUERIES["op1_packing"](spark, SF).collect())))
    most = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:  # a table of more than one full split for each core
        spark.conf.set("spark.sql.files.maxPartitionBytes", "4k")
        made.append(sorted(map(tuple, QUERIES["op1_packing"](spark, SF).collect())))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", most)
    assert made[0] == made[1] == made[2]


def test_sentencepiece_cases(spark):
    docs = spark.createDataFrame([(1, None), (None, "x"), (2, ""), (2, "a b"), (2, "a b")], "doc_id long, text string").withColumn("ids", F.lit("clash"))
    got = codec.encode(docs).collect()
    assert sorted((str(r.doc_id), len(r.ids), r.decoded) for r in got) == [("1", 0, ""), ("2", 0, ""), ("2", 2, "a b"), ("2", 2, "a b"), ("None", 1, "x")]
    assert codec.encode(docs.limit(0)).count() == 0


def check_pieces(rows, texts, library):
    by_sequence, by_doc = {}, {}
    for r in rows:
        by_sequence.setdefault(r.sequence_id, []).append((r.offset, r.length))
        by_doc.setdefault(r.doc_id, []).append(r)
    assert sorted(by_sequence) == list(range(len(by_sequence)))
    for k, parts in by_sequence.items():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at == 2048 or k == len(by_sequence) - 1
    assert set(by_doc) == set(texts)
    for doc, parts in by_doc.items():
        ids = [*library.encode(texts[doc] or "", add_special_tokens=False).ids, 1]
        at = 0
        for r in sorted(parts, key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(ids)
            assert r.ids_crc32 == zlib.crc32(np.array(ids[at : at + r.length], "<u4").tobytes())
            at += r.length
        assert at == len(ids)


def test_packing_query(spark):
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    check_pieces(QUERIES["op1_packing"](spark, SF).collect(), texts, library)


def test_packing_cases(spark):
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    texts = {1: None, 2: "", 3: "word " * 9000, 4: "<|endoftext|>\t x", 5: "日本語 " * 40}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string").withColumn("ids", F.lit("clash"))
    rows = packing.pack(docs.repartition(3)).withColumn("ids_crc32", F.crc32("ids")).collect()
    check_pieces(rows, texts, library)
    assert {r.padded_length for r in rows if r.sequence_id < max(x.sequence_id for x in rows)} == {2048}
    repeated = spark.createDataFrame([(1, "a"), (1, "a"), (None, "b")], "doc_id long, text string")
    assert sum(r.length for r in packing.pack(repeated).collect()) == 6
    assert packing.pack(docs.limit(0)).count() == 0
    two = packing.pack(spark.createDataFrame([(1, "a")], "doc_id long, text string")).collect()
    assert [(r.length, r.padded_length) for r in two] == [(2, 2)]
