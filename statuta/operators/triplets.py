"""Triplets (concept, relation, concept) from tokens with part-of-speech tags and dependency labels."""

from __future__ import annotations

from dataclasses import dataclass, field
from itertools import product
from operator import itemgetter

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from statuta.functions.constants import AUXILIARIES, COORDINATORS, DETERMINERS, DROPPED_POS, DUTY_NOUNS, KEPT_POS, NO_OBJECTS, VERB_LABELS

TOKEN = "id INT, word STRING, pos STRING, head INT, deprel STRING"
TRIPLETS = T.ArrayType(T.StructType([T.StructField(c, T.StringType()) for c in ("c1", "r", "c2")]))


def _emit(found: dict[tuple, None], *roles: list[list[str]]) -> None:
    """Each group of words of one role with each of the others."""
    if all(roles):
        found.update(dict.fromkeys(product(*[[" ".join(g) for g in role] for role in roles])))


@dataclass
class Frame:
    """What has been gathered for the next triplets: groups of tokens in three roles; coordination opens another group."""

    subjects: list[list[dict]] = field(default_factory=list)
    relations: list[list[dict]] = field(default_factory=list)
    objects: list[list[dict]] = field(default_factory=list)
    found: dict[tuple, None] = field(default_factory=dict)

    def add(self, role: str, token: dict, fork: bool = False) -> None:
        groups = getattr(self, role)
        if fork or not groups:
            groups.append([])
        groups[-1].append(token)

    def add_relation(self, token: dict, fork: bool = False) -> None:
        """A relation behind objects closes the triplets so far."""
        if self.objects:
            self.emit()
            self.subjects, self.relations, self.objects = self.objects, [], []
        self.add("relations", token, fork)

    def add_concept(self, token: dict, fork: bool = False) -> None:
        self.add("objects" if self.relations else "subjects", token, fork)

    def emit(self) -> None:
        roles = [[[t["word"] for t in g] for g in role] for role in (self.subjects, self.relations, self.objects)]
        _emit(self.found, *roles)

    def result(self) -> list[tuple]:
        self.emit()
        return list(self.found)


def _nominal(at: dict[int, dict], token: dict) -> bool:
    around = (at.get(token["id"] - 1), at.get(token["id"] + 1))
    return all(t is not None and t["pos"].startswith("N") for t in around)


def by_dependency(tokens: list[dict], dropped: tuple = DROPPED_POS, coordinators: tuple = COORDINATORS) -> list[tuple] | None:
    """The production rules. None: the first token is the root. Tokens are taken in order of id; no tokens: no triplets."""
    tokens = sorted(tokens, key=itemgetter("id"))
    at = {t["id"]: t for t in tokens}
    if at.get(1, {}).get("deprel") == "root":
        return None
    # As Frame does it, with words for tokens and no call for each of them.
    subjects, relations, objects, found, fork = [], [], [], {}, False
    for t in tokens:
        pos, label, word = t["pos"], t["deprel"], t["word"]
        root = label == "root"
        if pos.startswith(dropped) and not root:
            continue
        if pos.startswith("C") or word.lower() in coordinators:
            fork = True
            continue
        verb = pos.startswith("V")
        goes_on = verb and label == "vmod" and relations
        named = verb and label in VERB_LABELS and (label != "nmod" or _nominal(at, t))
        if root or goes_on or named:
            if objects:  # a relation behind objects closes the triplets so far
                _emit(found, subjects, relations, objects)
                subjects, relations, objects = objects, [], []
            groups = relations
        else:
            groups = objects if relations else subjects
        if fork or not groups:
            groups.append([word])
        else:
            groups[-1].append(word)
        fork = False
    _emit(found, subjects, relations, objects)
    return list(found)


def without_semicolon(tokens: list[dict]) -> list[tuple] | None:
    """The earlier grouped rules: numerals are kept and a semicolon does not coordinate."""
    return by_dependency(tokens, tuple(p for p in DROPPED_POS if p != "M"), tuple(c for c in COORDINATORS if c != ";"))


def by_pos(tokens: list[dict]) -> list[tuple]:
    """By part of speech alone: every verb is a relation, other kept words are concepts; no coordination. Incomplete triplets are left out here and below."""
    frame = Frame()
    for t in sorted(tokens, key=lambda t: t["id"]):
        if t["pos"].startswith(KEPT_POS):
            word = t | {"word": t["word"].replace("_", " ")}
            (frame.add_relation if t["pos"].startswith("V") else frame.add_concept)(word)
    return frame.result()


def _flat_relation(at: dict[int, dict], t: dict) -> bool:
    return t["pos"].startswith("V") and t["deprel"] in ("root", *VERB_LABELS) and (t["deprel"] != "nmod" or not _nominal(at, t))


def flat(tokens: list[dict]) -> list[tuple]:
    """By dependency without groups; a noun modifier is a relation unless it stands between nouns, a verb modifier never is."""
    at, frame = {t["id"]: t for t in tokens}, Frame()
    for i in sorted(at):
        if not at[i]["pos"].startswith(("R", "CH")):
            (frame.add_relation if _flat_relation(at, at[i]) else frame.add_concept)(at[i])
    return frame.result()


def owned_root(tokens: list[dict]) -> list[tuple]:
    """As flat, without prepositions; the root is a relation only if a subject of its own has been seen, and verb modifiers join the relation before any object."""
    at, frame = {t["id"]: t for t in tokens}, Frame()
    for i in sorted(at):
        t = at[i]
        if t["pos"].startswith(("R", "CH", "E")):
            continue
        relation = _flat_relation(at, t)
        if relation and t["deprel"] == "root":
            relation = any(s["deprel"] == "sub" and s["head"] == i for g in frame.subjects for s in g)
        if relation:
            frame.add_relation(t)
        elif t["deprel"] == "vmod" and not frame.objects:
            frame.add("relations", t)
        else:
            frame.add_concept(t)
    return frame.result()


def _phrase(words: list[tuple[str, str]], at: int) -> list[str]:
    """Nouns, prepositions and determiners from a place on; behind a noun of duty the verbs that follow as well."""
    end = at
    while end < len(words) and words[end][1].startswith(("N", "E", "L")):
        end += 1
    if end > at and words[end - 1][0] in DUTY_NOUNS:
        while end < len(words) and words[end][1].startswith("V"):
            end += 1
    return [w for w, _ in words[at:end]]


def noun_phrases(tokens: list[dict]) -> list[tuple]:
    """Each verb with the nearest noun phrase before it and the next one after it; auxiliaries are part of the verb behind them."""
    plain = [(t["word"].replace("_", " ").strip(), t["pos"].split(" ")[0]) for t in sorted(tokens, key=lambda t: t["id"])]
    words: list[tuple[str, str]] = []
    joined = False
    for word, pos in plain:
        joined = bool(words) and not joined and words[-1][0] in AUXILIARIES and pos.startswith("V")
        if joined:
            word = f"{words.pop()[0]} {word}"
        words.append((word, pos))
    found: dict[tuple, None] = {}
    for i, (verb, pos) in enumerate(words):
        if not pos.startswith("V"):
            continue
        subject: list[str] = []
        start = next((j for j in range(i - 1, -1, -1) if words[j][1].startswith("N")), None)
        if start is not None:
            while start and words[start - 1][1].startswith(("N", "E")):
                start -= 1
            subject = ([words[start - 1][0]] if start and words[start - 1][0] in DETERMINERS else []) + _phrase(words, start)
        stop = next((k for k in range(i + 1, len(words)) if words[k][1].startswith(("N", "CH", "V"))), None)
        target = _phrase(words, stop) if stop is not None and words[stop][1].startswith("N") else []
        subject_text, target_text = " ".join(subject).strip(), " ".join(target).strip()
        if subject_text and target_text and target_text not in NO_OBJECTS:
            found[subject_text, verb, target_text] = None
    return list(found)


VARIANTS = {"production": by_dependency, "grouped": without_semicolon, "pos": by_pos, "flat": flat, "owned_root": owned_root, "noun_phrases": noun_phrases}


def extract(tokens: Column, variant: str = "production") -> Column:
    """array<struct<c1, r, c2>> from array<struct<id, word, pos, head, deprel>>; null where the rules give none for a sentence."""
    rule = VARIANTS[variant]

    @F.pandas_udf(TRIPLETS)
    def run(s: pd.Series) -> pd.Series:
        def one(x):
            if x is None:
                return None
            made = rule([t if isinstance(t, dict) else t.asDict() for t in x])
            return None if made is None else [dict(zip(("c1", "r", "c2"), m, strict=True)) for m in made]

        return s.map(one)

    return run(tokens)


def token_array(words: Column, pos: Column, heads: Column, labels: Column) -> Column:
    """Parallel arrays of an annotation as tokens numbered from 1."""
    zipped = F.arrays_zip(words.alias("word"), pos.alias("pos"), heads.alias("head"), labels.alias("deprel"))
    return F.transform(zipped, lambda t, i: F.struct((i + 1).cast("int").alias("id"), t["word"].alias("word"), t["pos"].alias("pos"), t["head"].cast("int").alias("head"), t["deprel"].alias("deprel")))
