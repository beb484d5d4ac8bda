"""Packing: documents laid end to end and cut into fixed windows, by two passes of prefix sums."""

from __future__ import annotations

import base64
import re
from array import array
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from statuta.llm.common import materialise, quoted, text_or_empty, tidy

#: Chunks of text whose ids a Python worker keeps; beyond it the store starts anew.
CACHE = 300_000
#: A chunk: blanks or line feeds, then what follows up to the next. No token crosses from a word to the white space after it.
CHUNK = re.compile(r"[ \n]*[^ \n]+|[ \n]+")
#: White space that could stand inside a longer run of white space across a cut, and strings that the tokenizer takes as special.
ODD = re.compile(r"[^\S \n]")


class ByteBpe:
    """Ids of a byte-level BPE as `tokenizers` gives them, chunk by chunk with a store of chunks already seen.

    Chunks of Latin text that are new go through `tiktoken`, which has the same
    vocabulary and is several times as quick; other chunks, and texts with
    special tokens or unusual white space, go through `tokenizers`.
    """

    def __init__(self, json_path: str, ranks_path: str | None = None, pattern: str | None = None):
        from tokenizers import Tokenizer

        self.slow = Tokenizer.from_file(json_path)
        self.special = [t.content for t in self.slow.get_added_tokens_decoder().values()]
        self.quick = None
        if ranks_path:
            import tiktoken

            with open(ranks_path, "rb") as lines:
                ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
            self.quick = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.seen: dict[str, bytes] = {}

    def whole(self, text: str) -> bytes:
        return np.array(self.slow.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def chunk(self, text: str) -> bytes:
        if self.quick is not None and max(text) < "ɐ":
            found = array("I", self.quick.encode_ordinary(text)).tobytes()
        else:
            found = self.whole(text)
        if len(text) < 40:
            if len(self.seen) >= CACHE:
                self.seen.clear()
            self.seen[text] = found
        return found

    def encode(self, text: str) -> bytes:
        """The ids as little-endian unsigned 32-bit numbers."""
        if any(s in text for s in self.special) or ODD.search(text):
            return self.whole(text)
        chunks = CHUNK.findall(text)
        parts = list(map(self.seen.get, chunks))
        if None in parts:
            parts = [self.chunk(c) if p is None else p for c, p in zip(chunks, parts, strict=True)]
        return b"".join(parts)


_LOADED: dict[tuple, ByteBpe] = {}


def tokenizer(name: str) -> ByteBpe:
    """The tokenizer of a public vocabulary file, loaded once in each Python worker."""
    if name not in _LOADED:
        import public_tokenizers as public

        ranks = public.path(name.replace(".json", ".tiktoken")) if name.startswith("byte_bpe_50k") else None
        _LOADED[name] = ByteBpe(public.path(name), ranks, public.PATTERN if ranks else None)
    return _LOADED[name]


def pack(docs: DataFrame, vocabulary: str = "byte_bpe_50k.json", length: int = 2048, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each piece: doc_id, start, length, ids (binary, little-endian unsigned 32-bit), doc_tokens, sequence_id, offset, padded_length.

    Pass one tokenises, appends end_id, and writes each document's ids with its
    place inside its task. The totals of the tasks (one number each) are added
    up on the driver, which gives every task its global offset. Pass two cuts
    each document where a window of the given length ends, with no row order
    needed: a document that crosses a border gives one piece to each side.
    Sequences are full but for the last one, so only that one is padded: to
    length, or not at all if its own length is a power of two. Documents are
    laid in the order of the partitions of docs and of the rows in them.

    Null text is empty and yields end_id alone; a text of any length is cut into
    as many pieces as it takes. Rows that repeat an id are packed each. An empty
    table gives no piece. Other columns are ignored, whatever their names.
    """

    def first(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        task, at = TaskContext.get().partitionId(), 0
        encoder, last = tokenizer(vocabulary), np.array([end_id], "<u4").tobytes()
        for batch in batches:
            for lo in range(0, len(batch), 256):
                part = batch.iloc[lo : lo + 256]
                ids = [np.frombuffer(encoder.encode(t) + last, "<u4") for t in part["text"]]
                sizes = np.array([len(x) for x in ids], np.int64)
                ends = at + np.cumsum(sizes)
                yield pd.DataFrame({"doc_id": part["doc_id"].array, "task": task, "place": ends - sizes, "doc_tokens": sizes, "ids": [x.astype("<u2").tobytes() if x.max() < 65536 else x.tobytes() for x in ids]})
                at = int(ends[-1])

    spark = docs.sparkSession
    rows = docs.select(F.col(quoted(id_col)).cast("long").alias("doc_id"), text_or_empty(text_col).alias("text"))
    table = materialise(rows.mapInPandas(tidy(first), "doc_id long, task int, place long, doc_tokens long, ids binary"), "tokens")
    totals = table.groupBy("task").agg(F.sum("doc_tokens").alias("n")).orderBy("task").collect()  # a number for each task
    bases = np.concatenate([[0], np.cumsum([r.n for r in totals])]).astype(int)
    total = int(bases[-1])
    offsets = spark.createDataFrame([(r.task, int(b)) for r, b in zip(totals, bases, strict=False)], "task int, base long")
    rest = total % length
    padded_last = rest if rest & (rest - 1) == 0 else length

    def second(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for doc, at, n, raw in zip(batch["doc_id"].array, batch["at"], batch["doc_tokens"], batch["ids"], strict=True):
                ids = np.frombuffer(raw, "<u2" if len(raw) == 2 * n else "<u4").astype("<u4")
                start = 0
                while start < n:
                    offset = (at + start) % length
                    size = min(length - offset, n - start)
                    sequence = (at + start) // length
                    rows.append((doc, start, size, ids[start : start + size].tobytes(), n, sequence, offset, padded_last if sequence * length + rest == total and rest else length))
                    start += size
                    if len(rows) >= 2000:
                        yield pd.DataFrame(rows, columns=names)
                        rows = []
            yield pd.DataFrame(rows, columns=names)

    names = ["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset", "padded_length"]
    placed = table.join(F.broadcast(offsets), "task").select("doc_id", (F.col("base") + F.col("place")).alias("at"), "doc_tokens", "ids")
    return placed.mapInPandas(tidy(second), "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long, padded_length long")

