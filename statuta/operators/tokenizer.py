"""Tokens and sentences of Vietnamese text: rules in plain Python, applied to Arrow batches."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from statuta.functions.constants import ABBREVIATIONS, CLOSING, EXCEPTIONS, PATTERNS, SENTENCE_END
from statuta.sources.memory import KEEP, give_back, resident, small_batches

_BLANK = " \t\n\x0b\f\r"
_TRIMMED = "".join(map(chr, range(33)))
_SPACES = regex.compile(f"[{_BLANK}]+")
_COMPILED = {name: regex.compile(p) for name, p in PATTERNS.items()}
_END = regex.compile(SENTENCE_END)
_KEPT = {"abbreviation": frozenset(ABBREVIATIONS), "exception": frozenset(EXCEPTIONS)}
# Where several stand in a token, the longest one is cut out, then the first in order of code points.
_INSIDE = {kind: sorted(words, key=lambda w: (-len(w), w)) for kind, words in _KEPT.items()}
#: Each of these words has one of these, so a token without any holds none of the words.
_MARKS = {kind: frozenset(c for w in words for c in w if not c.isalpha()) for kind, words in _KEPT.items()}
#: First characters of tokens at which a sentence can end.
_ENDS = frozenset(":.?!…")
_QUOTES = ('"', "''")


def _plain(c: str) -> bool:
    return c.isalpha() or unicodedata.category(c) == "Nd"


def _inside(kind: str, token: str) -> tuple[int, int] | None:
    if _MARKS[kind].isdisjoint(token):
        return None
    for word in _INSIDE[kind]:
        at = token.find(word)
        if at >= 0:
            return at, at + len(word)
    return None


def _is_address(token: str) -> bool:
    """Not one if a part between stops is a single capital or holds a character beyond ASCII."""
    return not any((len(p) == 1 and p.isupper()) or not p.isascii() for p in token.split("."))


def _by_pattern(token: str) -> tuple[int, int] | None:
    """The span to cut out: the first pattern that matches a part of the token; a pattern that matches it whole keeps it."""
    if any(p.fullmatch(token) for p in _COMPILED.values()):
        return None
    for name, pattern in _COMPILED.items():
        found = pattern.search(token)
        if not found or (name == "url" and not _is_address(token)):
            continue
        if name == "month" and not any(c.isalpha() for c in token[: found.start()]):
            return None
        return found.span()
    return None


def _parts(token: str) -> list[str] | None:
    """The pieces that a token falls into, each to be looked at again; None: it stays whole."""
    if len(token) == 1 or all(map(_plain, token)):
        return None
    if token.endswith(","):
        return [token[:-1], ","]
    if token in _KEPT["abbreviation"]:
        return None
    if token.endswith(".") and token[-2].isalpha():
        initial = len(token) == 2 and token[0].isupper()
        if token[:-1].isalpha() and not initial:
            return [token[:-1], "."]
        return None if initial or _COMPILED["short_name"].search(token) else [token[:-1], "."]
    if token in _KEPT["exception"]:
        return None
    span = _inside("abbreviation", token) or _inside("exception", token) or _by_pattern(token)
    if span is None or span == (0, len(token)):
        return None
    return [p for p in (token[: span[0]], token[slice(*span)], token[span[1] :]) if p]


def _cut(chunk: str) -> tuple[str, ...]:
    waiting, out = [chunk], []
    while waiting:
        token = waiting.pop()
        parts = _parts(token)
        if parts is None:
            out.append(token)
        else:
            waiting += [p for q in reversed(parts) for p in reversed(_SPACES.split(q)) if p]
    return tuple(out)


#: Tokens of a run without white space; short runs recur, so they are kept, and their number and length bound what a worker holds.
_SHORT = 48
_tokens_of = lru_cache(maxsize=100_000)(_cut)


def tokenize(text: str | None) -> list[str]:
    """Tokens of a text; null and blank texts have none."""
    out: list[str] = []
    for chunk in _SPACES.split((text or "").strip(_TRIMMED)):
        if chunk.isalpha():
            out.append(chunk)
        elif chunk:
            word, mark = chunk[:-1], chunk[-1]
            if mark == "," and word.isalpha():
                out += (word, mark)
            else:
                out += _tokens_of(chunk) if len(chunk) <= _SHORT else _cut(chunk)
    return out


def _goes_on(tokens: list[str], start: int, at: int) -> bool:
    """Whether the sentence from start on runs on behind the closing mark at a place."""
    after = tokens[at + 1]
    if after in _QUOTES and sum(t in _QUOTES for t in tokens[start : at + 1]) % 2:
        return True
    if after in CLOSING or after == "," or after[0].islower() or after[0].isdigit():
        return True
    if at - start == 1 and tokens[at] == ".":
        first = tokens[start]
        return first[0].isdigit() or first[0].islower() or (len(first) == 1 and first.isupper())
    return False


def split_sentences(tokens: list[str], most: int | None = None) -> list[list[str]]:
    """Sentences as lists of tokens; what follows the last mark is one as well. No more than `most` are sought."""
    out: list[list[str]] = []
    start = 0
    last = len(tokens) - 1
    for i, token in enumerate(tokens):
        if token[0] not in _ENDS or i == last:
            continue
        after = tokens[i + 1]
        listed = token == ":" and i + 1 < last and ((after[0].isdigit() and tokens[i + 2] == ".") or tokens[i + 2] == ",")
        if listed or (_END.fullmatch(token) and not _goes_on(tokens, start, i)):
            out.append(tokens[start : i + 1])
            start = i + 1
            if len(out) == most:
                return out
    return [*out, tokens[start:]] if start < len(tokens) else out


def join_tokens(tokens: list[str]) -> str:
    return " ".join(t for t in tokens if t and t != " ")


def _lists(rows: list[list[str]]) -> pa.Array:
    """Lists of strings as one flat Arrow array."""
    ends = np.concatenate([[0], np.cumsum([len(r) for r in rows])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array([x for r in rows for x in r], pa.string()))


def by_text(f: Callable[[str | None], list[str]]) -> Callable[[Column], Column]:
    """array<string> of a text column by f, over small Arrow batches in slices. A worker that has grown gives freed memory back between batches."""
    session = SparkSession.getActiveSession()
    if session is not None:
        small_batches(session)

    @F.arrow_udf(T.ArrayType(T.StringType()))
    def run(texts: pa.Array) -> pa.Array:
        made = [_lists([f(t) for t in texts.slice(lo, 256).to_pylist()]) for lo in range(0, len(texts), 256)]
        whole = pa.concat_arrays(made) if made else _lists([])
        del made
        if resident() > KEEP:
            give_back()
        return whole

    return run


def tokens(text: Column) -> Column:
    """array<string> of a text column."""
    return by_text(tokenize)(text)


def sentences(text: Column) -> Column:
    """array<string> of a text column: each sentence's tokens, which hold no white space, joined by spaces."""
    return by_text(lambda t: [join_tokens(s) for s in split_sentences(tokenize(t))])(text)
