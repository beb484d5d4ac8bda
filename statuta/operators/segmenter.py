"""Word segmentation: a longest-match first guess, corrected by an exception-rule tree."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field
from functools import cached_property

from pyspark.sql import Column, DataFrame

from statuta.functions.constants import TONE_MARKS
from statuta.operators.tokenizer import by_text, join_tokens, split_sentences, tokenize

#: The ten things that a rule can ask about, as offsets from the word it judges.
SLOTS = {"tag": 0, "word": 0, "prevTag1": -1, "prevWord1": -1, "prevTag2": -2, "prevWord2": -2, "nextTag1": 1, "nextWord1": 1, "nextTag2": 2, "nextWord2": 2}
#: Of each: whether it is a tag, the offset, what stands beyond the edge of the sentence.
_SOURCES = {name: ("tag" in name.lower(), step, "<T>" if "tag" in name.lower() else "<W>") for name, step in SLOTS.items()}


@dataclass(frozen=True)
class Lexicon:
    """Word lists, lower case. All come from the user; empty ones are allowed."""

    words: frozenset = frozenset()
    locations: frozenset = frozenset()
    long_countries: frozenset = frozenset()
    short_countries: frozenset = frozenset()
    companies: frozenset = frozenset()
    sentence_starts: frozenset = frozenset()
    middle_names: frozenset = frozenset()
    family_names: frozenset = frozenset()

    @staticmethod
    def from_rows(rows) -> Lexicon:
        """From (kind, entry) pairs."""
        kinds: dict[str, set] = {}
        for kind, entry in rows:
            kinds.setdefault(kind, set()).add(entry.lower())
        return Lexicon(**{k: frozenset(v) for k, v in kinds.items()})

    @cached_property
    def starts(self) -> frozenset:
        """First syllables of what can be joined, since most syllables begin nothing."""
        return frozenset(p.split(" ", 1)[0] for kind in (self.words, self.locations, self.long_countries) for p in kind)

    def joined(self, phrase: str) -> bool:
        return phrase in self.words or phrase in self.locations or phrase in self.long_countries

    def stands_alone(self, word: str) -> bool:
        return word in self.sentence_starts or word in self.short_countries or word in self.companies


@dataclass
class Rule:
    conditions: dict[str, str]
    conclusion: str
    children: list[Rule] = field(default_factory=list)


def parse_rules(lines) -> list[Rule]:
    """The rules at depth 1, each with its exceptions; depth is the number of leading tabs. The first line is the root."""
    top: list[Rule] = []
    open_: list[list[Rule]] = [top]
    for line in list(lines)[1:]:
        body = line.strip()
        if not body or "cc:" in body:
            continue
        depth = min(len(line) - len(line.lstrip("\t")), 7)
        left, right = body.split(" : ")[:2]
        conditions = dict(re.findall(r'object\.(\w+) == "([^"]*)"', left))
        conditions = {k: v or ("<W>" if "Word" in k else "<T>") for k, v in conditions.items()}
        rule = Rule(conditions, re.search(r'"([^"]*)"', right)[1])
        del open_[max(1, depth) :]
        open_[-1].append(rule)
        open_.append(rule.children)
    return top


def slot_value(slot: str, at: int, tags: list[str], words: list[str]) -> str:
    """What a rule that asks for a slot is told of the word at a place."""
    source, step, edge = _SOURCES[slot]
    row, k = tags if source else words, at + step
    return row[k] if 0 <= k < len(row) else edge


def contexts(text: Column, lexicon: Lexicon) -> Column:
    """array<string>: for each syllable of a text, the values of all slots (see SLOTS) before any rule, parted by tabs."""

    def one(t: str | None) -> list[str]:
        syllables = (t or "").split()
        tags, words = first_guess(syllables, lexicon), [s.lower() for s in syllables]
        return ["\t".join(slot_value(slot, i, tags, words) for slot in SLOTS) for i in range(len(words))]

    return by_text(one)(text)


class Ladder:
    """Rules of one level, found by the value that their first condition asks for; exceptions hang below."""

    def __init__(self, rules: list[Rule]):
        self.by: dict[str, dict[str, list[tuple[int, tuple, str, Ladder]]]] = {}
        for k, rule in enumerate(rules):
            (slot, value), *rest = rule.conditions.items() or [("", "")]
            self.by.setdefault(slot, {}).setdefault(value, []).append((k, tuple(rest), rule.conclusion, Ladder(rule.children)))

    def first(self, value: Callable[[str], str]):
        """The first rule, in order, that holds: its conclusion and its exceptions."""
        best = None
        for slot, values in self.by.items():
            for found in values.get(value(slot) if slot else "", ()):
                if (best is None or found[0] < best[0]) and all(value(k) == v for k, v in found[1]):
                    best = found
                    break
        return best

    def judge(self, value: Callable[[str], str]) -> str | None:
        """The last conclusion on the way down: at each level the first rule that holds, then its exceptions."""
        out, level = None, self
        while (hit := level.first(value)) is not None:
            out, level = hit[2], hit[3]
        return out


def _name_run(syllables: list[str], at: int) -> int:
    """End of a run of at most four capitalised syllables."""
    end = at + 1
    while end < min(at + 4, len(syllables)) and syllables[end].isalpha() and not syllables[end][0].islower() and syllables[end] not in ("LBKT", "RBKT"):
        end += 1
    return end


def first_guess(syllables: list[str], lexicon: Lexicon) -> list[str]:
    """A tag for each syllable: B begins a word, I goes on with it."""
    lower = [s.lower() for s in syllables]
    tags: list[str] = []
    n, starts = len(syllables), lexicon.starts
    while (i := len(tags)) < n:
        s = syllables[i]
        small = s[0].islower()
        begins = lower[i] in starts
        if (small and not begins) or not s.isalpha() or (small and i + 1 < n and syllables[i + 1][0].isupper()):
            tags.append("B")
            continue
        end = next((j for j in range(min(i + 4, n), i + 1, -1) if lexicon.joined(" ".join(lower[i:j]))), None) if begins else None
        if end:
            tags += ["B"] + ["I"] * (end - i - 1)
        elif small or (s.isupper() and all(c.isupper() for c in s)) or lexicon.stands_alone(lower[i]):
            tags.append("B")
        else:
            end = _name_run(syllables, i)
            after_family = i > 0 and syllables[i - 1][0].isupper() and lower[i - 1] in lexicon.family_names
            goes_on = end > i + 1 and lower[i] in lexicon.middle_names and after_family
            tags += ["I" if goes_on else "B"] + ["I"] * (end - i - 1)
    return tags


def segment(sentence: str, lexicon: Lexicon, rules: list[Rule] | Ladder) -> str:
    """A sentence of tokens joined by spaces, with the syllables of a word joined by underscores; blank: a line feed."""
    sentence = sentence.strip()
    if not sentence:
        return "\n"
    if not sentence.isascii():
        for old, new in TONE_MARKS.items():
            if old in sentence:
                sentence = sentence.replace(old, new)
    syllables = sentence.split()
    tags = first_guess(syllables, lexicon)
    ladder = rules if isinstance(rules, Ladder) else Ladder(rules)
    if ladder.by:
        words, guess = [s.lower() for s in syllables], tags
        # A rule at the top can hold only where a value that its first condition asks for stands.
        rows = [(guess if tag else words, step, edge, ladder.by[slot]) for slot in ladder.by if slot for tag, step, edge in [_SOURCES[slot]]]
        if "" not in ladder.by:
            able = [any((row[k] if 0 <= (k := i + step) < len(row) else edge) in asked for row, step, edge, asked in rows) for i in range(len(words))]
        else:
            able = [True] * len(words)
        tags = [ok and ladder.judge(lambda slot, i=i: slot_value(slot, i, guess, words)) or guess[i] for i, ok in enumerate(able)]
    if "I" not in tags:
        return " ".join(syllables)
    return "".join((" " if tag == "B" else "_") + s for s, tag in zip(syllables, tags, strict=True))[1:]


def segment_text(text: str | None, lexicon: Lexicon, rules: list[Rule] | Ladder, most: int | None = None) -> list[str]:
    """The segmented sentences of a text, no more than `most`."""
    return [segment(join_tokens(s), lexicon, rules) for s in split_sentences(tokenize(text), most)]


def segmented(text: Column, lexicon: Lexicon, rules: list[Rule]) -> Column:
    """array<string> of segmented sentences. Word lists and rules travel with the function, once for each Python worker."""
    ladder = Ladder(rules)
    return by_text(lambda t: segment_text(t, lexicon, ladder))(text)


def rules_of(lines: DataFrame, number: str = "line_no", value: str = "value") -> list[Rule]:
    """The rules of a rule file (see files.numbered_lines): a few thousand lines, which every worker needs whole."""
    return parse_rules([r[value] for r in lines.orderBy(number).select(value).collect()])


def lexicon_of(entries: DataFrame) -> Lexicon:
    """The lexicon of word lists (kind, entry; see files.word_lists), which every worker needs whole."""
    return Lexicon.from_rows([(r.kind, r.entry) for r in entries.select("kind", "entry").distinct().collect()])
