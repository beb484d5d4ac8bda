"""Quality rules: a decision list of threshold conjunctions, learned by sequential covering from labelled statistics."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from math import log2
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from statuta.llm.common import SPACE, free, materialise, quoted, text_or_empty

#: Candidate thresholds of a feature: quantiles of the rows of either label.
CUTS = 32
#: Bounds of a list: rules, and conditions of a rule.
RULES, CONDITIONS = 16, 4
#: A rule is kept if it covers so many rejected rows at least, and so large a part of the rows that it covers is rejected.
LEAST_ROWS, LEAST_PRECISION = 10, 0.8

_COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
_MORE = ["n_lines", "n_upper", "n_marks", "n_digits", "n_distinct_words"]


def statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and counts of each text: words, their characters, symbols, repeated lines, words in repeated windows of three, and more.

    n_repeat_words: windows of three words get 64-bit hashes; where two are
    equal, the hashes are sorted with their places, equal neighbours are
    repeats, and each word under such a window counts once. All of it happens
    inside the row, so no text or window is shuffled.
    """
    text, words, lines = F.col("text"), F.col("words"), F.col("lines")

    def without(pattern: str) -> Column:
        return (F.length(text) - F.length(F.regexp_replace(text, pattern, ""))).cast("long")

    base = docs.select(F.col(quoted(id_col)).cast("long").alias("doc_id"), text_or_empty(text_col).alias("text"))
    base = base.select("doc_id", "text", F.array_remove(F.split(text, SPACE + "+"), "").alias("words"), F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")).alias("lines"))
    n = F.size(words)
    windows = F.when(n > 2, F.transform(F.sequence(F.lit(0), n - 3), lambda i: F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2))))
    counted = base.select(
        "doc_id",
        n.cast("long").alias("n_words"),
        F.length(F.array_join(words, "")).cast("long").alias("word_chars"),
        F.regexp_count(text, F.lit("[#*$%&|<>]")).cast("long").alias("n_symbols"),
        (F.size(lines) - F.size(F.array_distinct(lines))).cast("long").alias("n_dup_lines"),
        F.size(lines).cast("long").alias("n_lines"),
        without(r"\p{Lu}+").alias("n_upper"),
        without(r"[!-/:-@\[-`{-~]+").alias("n_marks"),
        without(r"[0-9]+").alias("n_digits"),
        F.size(F.array_distinct(words)).cast("long").alias("n_distinct_words"),
        windows.alias("windows"),
    )
    rest = [c for c in counted.columns if c != "windows"]
    placed = F.transform("windows", lambda h, i: F.struct(h.alias("h"), i.alias("i")))
    twice = counted.select(*rest, F.when(F.size(F.array_distinct("windows")) < F.size("windows"), F.sort_array(placed)).alias("sorted"))
    ordered = F.col("sorted")
    equal = F.filter(ordered, lambda x, k: ((k > 0) & (F.get(ordered, k - 1)["h"] == x["h"])) | F.coalesce(F.get(ordered, k + 1)["h"] == x["h"], F.lit(False)))
    repeats = twice.select(*rest, F.sort_array(F.transform(equal, lambda x: x["i"])).alias("places"))
    places = F.col("places")
    new = F.transform(places, lambda p, k: F.when(k == 0, 3).otherwise(F.least(F.lit(3), p - F.get(places, k - 1))))
    covered = F.coalesce(F.aggregate(new, F.lit(0), lambda a, x: a + x), F.lit(0)).cast("long")
    return repeats.select("doc_id", *_COUNTS[:-1], covered.alias("n_repeat_words"), *_MORE)


def base_failed() -> Column:
    """Fewer than 50 words, or over half of the words stand in repeated windows."""
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def _share(part: str, whole: str) -> Column:
    return F.col(part).cast("double") / F.greatest(F.col(whole), F.lit(1)).cast("double")


#: The features that conditions may name, of the statistics.
FEATURES: dict[str, Callable[[], Column]] = {
    "words": lambda: F.col("n_words").cast("double"),
    "word_length": lambda: _share("word_chars", "n_words"),
    "symbols_a_word": lambda: _share("n_symbols", "n_words"),
    "repeated_lines": lambda: _share("n_dup_lines", "n_lines"),
    "repeated_words": lambda: _share("n_repeat_words", "n_words"),
    "words_a_line": lambda: _share("n_words", "n_lines"),
    "capitals": lambda: _share("n_upper", "word_chars"),
    "marks_a_word": lambda: _share("n_marks", "n_words"),
    "digits": lambda: _share("n_digits", "word_chars"),
    "distinct_words": lambda: _share("n_distinct_words", "n_words"),
}


class Condition(NamedTuple):
    feature: str
    at_least: bool
    threshold: float

    def column(self) -> Column:
        value = FEATURES[self.feature]()
        return value >= F.lit(self.threshold) if self.at_least else value < F.lit(self.threshold)

    def __str__(self) -> str:
        return f"{self.feature} {'>=' if self.at_least else '<'} {self.threshold:.6g}"


Rule = tuple[Condition, ...]


def verdict(rules: list[Rule]) -> Column:
    """The decision list as one conditional expression over the statistics: the place of the first rule that holds, from 1; 0 if none does."""
    found = F.lit(0)
    for k, rule in reversed(list(enumerate(rules, 1))):
        found = F.when(reduce(Column.__and__, (c.column() for c in rule)), F.lit(k)).otherwise(found)
    return found


def _gain(p: int, n: int, p0: int, n0: int) -> float:
    """FOIL's gain of a condition that leaves p of p0 rejected and n of n0 other rows."""
    return p * (log2(p / (p + n)) - log2(p0 / (p0 + n0))) if p else 0.0


def _reached(value: Column, thresholds: list[float]) -> Column:
    return F.size(F.filter(F.array(*map(F.lit, thresholds)), lambda t: t <= value)) if thresholds else F.lit(0)


def _binned(labelled: DataFrame) -> tuple[DataFrame, dict[str, list[float]]]:
    """bad, growing and one number for each feature: how many of its candidate thresholds the row reaches; and the thresholds."""
    names = list(FEATURES)
    rows = labelled.select("doc_id", "bad", *[FEATURES[f]().alias(f) for f in names])
    share = [k / CUTS for k in range(1, CUTS)]
    cuts: dict[str, set[float]] = {f: set() for f in names}
    for r in rows.groupBy("bad").agg(*[F.percentile_approx(f, share, 10_000).alias(f) for f in names]).collect():  # two rows
        for f in names:
            cuts[f].update(r[f])
    steps = {f: sorted(c) for f, c in cuts.items()}
    bins = [_reached(F.col(f), steps[f]).alias(f) for f in names]
    return rows.select("bad", (F.pmod(F.xxhash64("doc_id"), F.lit(3)) > 0).alias("growing"), *bins), steps


class _Step(NamedTuple):
    """A condition as the binned rows know it."""

    feature: str
    at_least: bool
    bin: int

    def column(self) -> Column:
        return F.col(self.feature) >= self.bin if self.at_least else F.col(self.feature) < self.bin


def _holds(steps: list[_Step]) -> Column:
    return reduce(Column.__and__, (s.column() for s in steps), F.lit(True))


def _grow(rows: DataFrame, most: int) -> list[_Step]:
    """Condition after condition of the greatest gain, until no other row is covered. One aggregate for each, of a row for each feature and bin."""
    names = list(FEATURES)
    bins = F.explode(F.arrays_zip(F.array(*map(F.lit, names)).alias("feature"), F.array(*names).alias("bin")))
    steps: list[_Step] = []
    while len(steps) < most:
        seen = rows.where(_holds(steps)).select("bad", bins.alias("b")).groupBy("b.feature", "b.bin").agg(F.sum("bad").alias("p"), F.sum(1 - F.col("bad")).alias("n"))
        counts: dict[str, dict[int, tuple[int, int]]] = {}
        for r in seen.collect():
            counts.setdefault(r["feature"], {})[r["bin"]] = (r["p"], r["n"])
        if not counts:
            break
        p0, n0 = (sum(c[k] for c in counts[names[0]].values()) for k in (0, 1))
        if not p0 or not n0:
            break
        best = (0.0, None)
        for f in names:
            p = n = 0
            for b in sorted(counts[f])[:-1]:
                p, n = p + counts[f][b][0], n + counts[f][b][1]
                for gain, at_least in ((_gain(p, n, p0, n0), False), (_gain(p0 - p, n0 - n, p0, n0), True)):
                    if gain > best[0] + 1e-9:
                        best = (gain, _Step(f, at_least, b + 1))
        if best[1] is None:
            break
        steps.append(best[1])
    return steps


def _prune(rows: DataFrame, steps: list[_Step]) -> tuple[list[_Step], tuple[int, int]]:
    """The shortest beginning of the rule with the best (p - n) / (p + n) on other rows, and p and n of all rows that it covers."""
    kept = [F.sum(F.when(_holds(steps[: k + 1]) & ~F.col("growing"), x)) for k in range(len(steps)) for x in (F.col("bad"), 1 - F.col("bad"))]
    every = [F.sum(F.when(_holds(steps[: k + 1]), x)) for k in range(len(steps)) for x in (F.col("bad"), 1 - F.col("bad"))]
    seen = [x or 0 for x in rows.agg(*[c.alias(f"c{i}") for i, c in enumerate([*kept, *every])]).first()]
    value = [(p - n) / (p + n) if p + n else -1.0 for p, n in zip(seen[: 2 * len(steps) : 2], seen[1 : 2 * len(steps) : 2], strict=True)]
    k = max(range(len(steps)), key=lambda i: (value[i], -i))
    return steps[: k + 1], (seen[2 * len(steps) + 2 * k], seen[2 * len(steps) + 2 * k + 1])


def learn(labelled: DataFrame, rules: int = RULES, conditions: int = CONDITIONS, least_rows: int = LEAST_ROWS, least_precision: float = LEAST_PRECISION) -> list[Rule]:
    """Rules that tell rejected rows from others, of labelled statistics (and bad, 1 or 0, not null), in the order in which they are to be tried.

    Sequential covering: a rule grows on two thirds of the rows (by the hash of
    the id), condition by condition, is pruned on the other third, and the rows
    that it covers leave. Rows only ever meet as counts by feature and bin, so
    any number of labelled rows will do, and no row reaches the driver. The list
    ends with a rule that covers too few rejected rows or too many others, or
    after `rules` rules. No labelled row, or one label only: no rule.
    """
    made, cuts = _binned(labelled)
    rows = materialise(made, "labelled")
    found: list[Rule] = []
    left = rows
    while len(found) < rules:
        steps = _grow(left.where("growing"), conditions)
        if not steps:
            break
        steps, (p, n) = _prune(left, steps)
        if p < least_rows or p < least_precision * (p + n):
            break
        found.append(tuple(Condition(s.feature, s.at_least, cuts[s.feature][s.bin - 1]) for s in steps))
        left = left.where(~_holds(steps))
    free(rows)
    return found


def judge(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", **bounds) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, rule for each row of docs.

    Base rules come first; a decision list that learn() makes of the labelled
    rows which they let pass judges the rest: rule is the place of its first rule
    that holds, from 1, and 0 if none does; kept is true if no base rule and no
    learned rule holds. label 1 means good.

    Null and empty texts have no words, so they fail the base rules; texts are
    read whole; an empty table gives no row, and without labels there is no
    learned rule. Rows that repeat an id are judged each. Of labels that differ
    for one id the largest counts; null labels and ids are left out. Other
    columns are ignored, whatever their names.
    """
    stats = materialise(statistics(docs, id_col, text_col), "statistics")
    marks = labels.select(F.col(quoted(id_col)).cast("long").alias("doc_id"), F.col(quoted(label_col)).cast("int").alias("label")).dropna()
    marks = marks.groupBy("doc_id").agg((1 - F.max("label")).alias("bad"))
    rules = learn(stats.where(~base_failed()).join(marks, "doc_id"), **bounds)
    judged = stats.select("*", base_failed().alias("base_failed"), verdict(rules).alias("rule"))
    return judged.select("doc_id", *_COUNTS, "base_failed", (~F.col("base_failed") & (F.col("rule") == 0)).alias("kept"), "rule")
