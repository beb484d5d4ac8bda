"""SentencePiece encoding and decoding that keeps offsets into the original bytes."""

from __future__ import annotations

import re
import struct
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from statuta.llm.common import quoted, text_or_empty, tidy

MARK = "▁"  # stands for a space in pieces
CACHE = 250_000
#: Space marks and what follows them, up to the next mark or line feed.
SEGMENT = re.compile(r" *[^ \n]+|\n| +")


class CharsMap:
    """The compiled character map of a model: a double-array trie over bytes, whose values point at replacements."""

    def __init__(self, blob: bytes):
        size = struct.unpack_from("<I", blob)[0] if blob else 0
        self.units = np.frombuffer(blob[4 : 4 + size], "<u4").tolist()
        self.texts = blob[4 + size :]

    def longest(self, data: bytes, at: int) -> tuple[int, bytes] | None:
        """Length of the longest prefix of data[at:] that the map knows, and what replaces it."""
        units = self.units
        if not units:
            return None
        unit, node, best = units[0], 0, None
        node ^= (unit >> 10) << ((unit & 0x200) >> 6)
        for k in range(at, len(data)):
            c = data[k]
            node ^= c
            if node >= len(units):
                break
            unit = units[node]
            if unit & 0x800000FF != c:
                break
            node ^= (unit >> 10) << ((unit & 0x200) >> 6)
            if unit >> 8 & 1:
                best = k + 1 - at, units[node] & 0x7FFFFFFF
        if best is None:
            return None
        end = self.texts.index(b"\0", best[1])
        return best[0], self.texts[best[1] : end]


def char_size(first: int) -> int:
    return 1 if first < 0xC0 else 2 if first < 0xE0 else 3 if first < 0xF0 else 4


class Normalizer:
    """Normalised bytes and, for each of them and the end, the place in the original bytes.

    At each place the longest prefix that the character map knows is replaced,
    else one character is kept; each byte made points at the start of what it
    came from. Then white space is treated as the model asks.
    """

    def __init__(self, spec):
        self.map = CharsMap(spec.precompiled_charsmap)
        self.dummy, self.squeeze, self.escape = spec.add_dummy_prefix, spec.remove_extra_whitespaces, spec.escape_whitespaces
        self.plain = not self.map.units and not self.squeeze and self.escape

    def __call__(self, text: str) -> tuple[bytes, np.ndarray]:
        data = text.encode()
        if not data:
            return b"", np.zeros(1, np.int64)
        if not self.map.units:
            out, places = data, np.arange(len(data), dtype=np.int64)
        else:
            made, sources, at = [], [], 0
            while at < len(data):
                found = self.map.longest(data, at)
                size, to = found if found else (char_size(data[at]), data[at : at + char_size(data[at])])
                made.append(to)
                sources += [at] * len(to)
                at += size
            out, places = b"".join(made), np.array(sources, np.int64)
        if self.squeeze:
            keep = np.frombuffer(out, np.uint8) != 32
            spaces = ~keep
            spaces[1:] &= keep[:-1]  # the first space of a run stays
            spaces[:1] = False
            keep |= spaces
            out, places = np.frombuffer(out, np.uint8)[keep].tobytes(), places[keep]
            if not out:
                return b"", np.zeros(1, np.int64)
        if self.dummy:
            out, places = b" " + out, np.concatenate([places[:1], places])
        if self.escape:
            source = np.frombuffer(out, np.uint8)
            repeat = np.where(source == 32, 3, 1)
            out, places = out.replace(b" ", MARK.encode()), np.repeat(places, repeat)
        end = len(data)
        if self.squeeze:
            mark = MARK.encode() if self.escape else b" "
            while out.endswith(mark):
                end = places[-len(mark)]  # the last piece ends where the white space behind it begins
                out, places = out[: -len(mark)], places[: -len(mark)]
            if not out:
                return b"", np.zeros(1, np.int64)
        return out, np.concatenate([places, [end]])


class Codec:
    """A model's encode and decode by segments: no piece runs from a letter to the space mark after it, nor over a line feed.

    So each segment (its marks, then letters) has the same ids alone as in its
    text, and segments already seen come from a store.
    """

    def __init__(self, path: str):
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2 as pb

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        proto = pb.ModelProto()
        with open(path, "rb") as f:
            proto.ParseFromString(f.read())
        self.normalize = Normalizer(proto.normalizer_spec)
        pieces = [p.piece for p in proto.pieces]
        self.split = all(MARK not in p.lstrip(MARK) and ("\n" not in p or p == "\n") for p in pieces) and self.normalize.plain and self.normalize.dummy and proto.trainer_spec.model_type == 2 and "<0x0A>" in pieces
        byte = re.compile(r"<0x([0-9A-F]{2})>")
        self.bytes = [bytes([int(m[1], 16)]) if (m := byte.fullmatch(p)) else p.replace(MARK, " ").encode() for p in pieces]
        self.lead = self.model.encode("\n") if self.split else []
        self.unknown = self.model.unk_id()
        self.seen: dict[str, tuple[bytes, bytes, bytes]] = {}

    def _segment(self, s: str) -> tuple[bytes, bytes, bytes]:
        """Ids, their sizes in bytes, and the decoded bytes of a segment."""
        if s == " ":
            ids = [self.model.piece_to_id(MARK)]
        elif s[0] == " ":
            ids = self.model.encode(s[1:])
        else:
            ids = self.model.encode("\n" + s)[len(self.lead) :] if s != "\n" else self.lead[1:]
        made = [self.bytes[i] for i in ids]
        decoded = b"".join(made)
        if decoded != s.encode():
            raise ValueError(f"pieces don't tile {s!r}")
        found = array("i", ids).tobytes(), array("i", map(len, made)).tobytes(), decoded
        if len(s) < 40:
            if len(self.seen) >= CACHE:
                self.seen.clear()
            self.seen[s] = found
        return found

    def encode(self, text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray, str]:
        """Ids, first and last-plus-one original byte of each, and the decoded text."""
        if self.split and MARK not in text and text:
            segments = SEGMENT.findall(" " + text)
            parts = list(map(self.seen.get, segments))
            if None in parts:
                parts = [self._segment(s) if p is None else p for s, p in zip(segments, parts, strict=True)]
            ids = np.frombuffer(b"".join([p[0] for p in parts]), "<i4")
            ends = np.cumsum(np.frombuffer(b"".join([p[1] for p in parts]), "<i4"), dtype=np.int32) - 1  # the dummy space is no byte of the text
            starts = np.concatenate([[0], ends[:-1]]).astype(np.int32)
            return ids, starts, ends, b"".join([p[2] for p in parts])[1:].decode()
        norm, places = self.normalize(text)
        if not norm:
            none = np.zeros(0, np.int32)
            return none, none, none, ""
        ids, ends = self._whole(text, norm)
        return ids, places[np.concatenate([[0], ends[:-1]])].astype(np.int32), places[ends].astype(np.int32), self.model.decode(ids.tolist())

    def _whole(self, text: str, norm: bytes) -> tuple[np.ndarray, np.ndarray]:
        """Any other model: the library's pieces, laid over the normalised bytes; an unknown piece takes what the next one leaves."""
        got = self.model.encode(text, return_type="proto")
        sizes = [1 if re.fullmatch(r"<0x[0-9A-F]{2}>", p.piece) and p.id != self.unknown else len(p.piece.encode()) for p in got.pieces]
        ends = np.cumsum(sizes, dtype=np.int64)
        if len(ends) and ends[-1] != len(norm):
            raise ValueError("pieces don't tile the normalised text")
        return np.array([p.id for p in got.pieces], np.int32), ends


_LOADED: dict[str, Codec] = {}


def codec(name: str) -> Codec:
    if name not in _LOADED:
        import public_tokenizers as public

        _LOADED[name] = Codec(public.path(name))
    return _LOADED[name]


def encode(docs: DataFrame, model: str = "piece_bpe_32k.model", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, ids, starts, ends (first and last-plus-one byte of each piece in the text's UTF-8), decoded: one row for each input row.

    Null text is empty; empty text has no ids and decodes to "". Texts are
    encoded whole, whatever their length. Rows that repeat an id are encoded
    each; an empty table gives no row. Other columns are ignored, whatever
    their names.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(model)
        for batch in batches:
            for lo in range(0, batch.num_rows, 128):
                part = batch.slice(lo, 128)
                rows = [own.encode(t) for t in part.column(1).to_pylist()]
                cuts = pa.array(np.concatenate([[0], np.cumsum([len(r[0]) for r in rows])]), pa.int32())
                lists = [pa.ListArray.from_arrays(cuts, pa.array(np.concatenate([r[k] for r in rows]), pa.int32())) for k in range(3)]
                yield pa.RecordBatch.from_arrays([part.column(0), *lists, pa.array([r[3] for r in rows], pa.string())], ["doc_id", "ids", "starts", "ends", "decoded"])

    rows = docs.select(F.col(quoted(id_col)).cast("long").alias("doc_id"), text_or_empty(text_col).alias("text"))
    return rows.mapInArrow(tidy(run), "doc_id long, ids array<int>, starts array<int>, ends array<int>, decoded string")
