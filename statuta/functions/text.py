"""Scalar text functions as Column expressions; all stay inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from statuta.functions.constants import CLOSING, POS_NAMES, TONE_MARKS


def strip(c: Column) -> Column:
    """Without Unicode white space at the ends; trim() knows the space only."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def clean_text(c: Column) -> Column:
    """Line breaks and white space collapse, runs of ! and ? go (spaces around them stay), ends stripped, lower case."""
    flat = F.regexp_replace(F.regexp_replace(c, r"[\r\n\t]+", " "), r"(?U)\s+", " ")
    return F.lower(strip(F.regexp_replace(flat, "[!?]+", "")))


def collapse(c: Column) -> Column:
    """Words joined by single spaces; nothing left: null."""
    return F.nullif(strip(F.regexp_replace(c, r"(?U)\s+", " ")), F.lit(""))


def normalize_term(c: Column) -> Column:
    """Underscores and white space become single spaces, lower case; null and empty: null."""
    spaced = strip(F.regexp_replace(F.nullif(c, F.lit("")), "_+", " "))
    return F.lower(F.regexp_replace(spaced, r"(?U)\s+", " "))


def synonym_form(c: Column) -> Column:
    """A listed synonym: stripped, lower case, each underscore one space."""
    return F.replace(F.lower(strip(c)), F.lit("_"), F.lit(" "))


def normalize_token(c: Column) -> Column:
    return strip(F.replace(c, F.lit("_"), F.lit(" ")))


def not_blank(c: Column) -> Column:
    return c.isNotNull() & c.rlike(r"(?U)\S")  # ends at the first, where strip() goes through the text


def non_empty_lines(c: Column) -> Column:
    return F.filter(F.split(c, "\n"), lambda x: x != "")


def before_first(c: Column, mark: str) -> Column:
    return F.substring_index(c, mark, 1)


def after_first(c: Column, mark: str) -> Column:
    """What follows the first mark; no mark: empty."""
    at = F.locate(mark, c)
    return F.when(at > 0, F.substring(c, at + len(mark), F.length(c))).otherwise("")


def join_path(*parts: Column) -> Column:
    """Parts joined by underscores; an empty part keeps its place, a null one does not."""
    return F.concat_ws("_", *parts)


def content_id(path: Column) -> Column:
    return F.sha2(path, 256)


def move_tone_marks(c: Column) -> Column:
    for old, new in TONE_MARKS.items():
        c = F.replace(c, F.lit(old), F.lit(new))
    return c


def has_punctuation(c: Column) -> Column:
    return c.rlike(r"[^\p{L}\p{Nd}]")


def is_punctuation(c: Column) -> Column:
    return ~c.rlike(r"[\p{L}\p{Nd}]")


def is_numeric(c: Column) -> Column:
    return F.coalesce(c.rlike(r"^[-+]?\d*\.?\d+$"), F.lit(False))


def is_closing(c: Column) -> Column:
    return c.isin(*CLOSING)


def is_alphabetic(c: Column) -> Column:
    return c.rlike(r"^\p{L}*$")


def char_to_hex(c: Column) -> Column:
    return F.concat(F.lit("\\u"), F.lower(F.hex(F.encode(c, "UTF-16BE"))))


def hex_to_char(c: Column) -> Column:
    return F.decode(F.unhex(F.substring(c, 3, 4)), "UTF-16BE")


def first_match(c: Column, pattern: str) -> Column:
    """Struct prefix, match, suffix of the first match; null without one."""
    at, found = F.regexp_instr(c, F.lit(pattern)), F.regexp_substr(c, F.lit(pattern))
    return F.when(at > 0, F.struct(F.substring(c, F.lit(1), at - 1).alias("prefix"), found.alias("match"), F.substring(c, at + F.length(found), F.length(c)).alias("suffix")))


def preview(c: Column, n: int = 500) -> Column:
    return F.substring(c, 1, n)


def with_suffix(path: Column, suffix: str) -> Column:
    return F.regexp_replace(path, r"\.[^.]*$", suffix)


def no_spaces(c: Column) -> Column:
    return F.replace(c, F.lit(" "), F.lit(""))


def ner_label(c: Column) -> Column:
    return F.replace(F.replace(c, F.lit("U-"), F.lit("B-")), F.lit("L-"), F.lit("I-"))


def proper_noun_tag(pos: Column, form: Column, family: Column, middle: Column) -> Column:
    """Np becomes Np-1 if the first syllable is a family name or the second a middle name (arrays of lower-case names), else Np-0."""
    parts = F.split(F.lower(form), "_")
    named = F.array_contains(family, F.get(parts, F.lit(0))) | F.coalesce(F.array_contains(middle, F.get(parts, F.lit(1))), F.lit(False))
    return F.when(pos == "Np", F.when(named, "Np-1").otherwise("Np-0")).otherwise(pos)


def punctuation_label(pos: Column, label: Column) -> Column:
    return F.when(pos == "CH", "punct").otherwise(label)


def pos_name(pos: Column) -> Column:
    """A tag's description, or the tag itself where none is known."""
    names = F.create_map(*[F.lit(x) for pair in POS_NAMES.items() for x in pair])
    return F.coalesce(F.try_element_at(names, pos), pos)


def word_line(index: Column, form: Column, pos: Column, ner: Column, head: Column, label: Column) -> Column:
    """Six tab-separated fields, _ for what is missing."""
    fields = [F.coalesce(x.cast("string"), F.lit("_")) for x in (index, form, pos, ner, head, label)]
    return F.concat_ws("\t", *fields)


def rewrite_prompt(number: Column, sentence: Column) -> Column:
    """The user prompt that asks for full simple sentences, one to a line."""
    return F.concat(
        F.lit("Ngữ cảnh: Bộ luật số "),
        F.coalesce(number, F.lit("None")),
        F.lit(" trong luật Việt Nam.\nNhiệm vụ: Viết lại câu sau để hoàn chỉnh cấu trúc với đầy đủ chủ ngữ và vị ngữ, giữ nguyên ý nghĩa. Mỗi câu xuất ra phải là một câu đơn đầy đủ (một dòng một câu nếu có nhiều câu).\nCâu cần viết lại: \""),
        F.coalesce(sentence, F.lit("None")),
        F.lit('"'),
    )
