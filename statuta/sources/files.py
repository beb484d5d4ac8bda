"""Readers of documents, word lists and prompts. Bytes come through Spark's readers, so any store works."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Callable, Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from statuta.functions.text import not_blank, with_suffix

_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"


def find_documents(spark: SparkSession, folder: str) -> DataFrame:
    """path, modificationTime, length, content of the .pdf, .doc and .docx files below a folder; columns not asked for are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
    return files.where(F.lower("path").rlike(r"\.(pdf|doc|docx)$"))


def docx_lines(content: bytes) -> list[str]:
    """Texts of paragraphs and table cells in the order of the body, without blank ones; a cell's paragraphs are joined by line feeds."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        body = ElementTree.fromstring(z.read("word/document.xml")).find(f"{_W}body")

    def text(p) -> str:
        marks = {f"{_W}tab": "\t", f"{_W}br": "\n", f"{_W}cr": "\n"}
        return "".join(x.text or "" if x.tag == f"{_W}t" else marks.get(x.tag, "") for x in p.iter())

    out = []
    for child in body:
        if child.tag == f"{_W}p":
            out.append(text(child))
        elif child.tag == f"{_W}tbl":
            for row in child.findall(f"{_W}tr"):
                out += ["\n".join(text(p) for p in cell.findall(f"{_W}p")) for cell in row.findall(f"{_W}tc")]
    return [x.strip() for x in out if x.strip()]


def extract_lines(files: DataFrame, extract: Callable[[bytes], list[str]] = docx_lines) -> DataFrame:
    """doc (the path), line_no, line, error: the texts of each file by an extractor (bytes to list). A file that fails gives one row with its error."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, content in zip(batch["path"], batch["content"], strict=True):
                try:
                    rows = [(path, i, x, None) for i, x in enumerate(extract(bytes(content)))]
                except Exception as e:  # one bad file must not end the run; it is reported
                    rows = [(path, None, None, f"{type(e).__name__}: {e}")]
                yield pd.DataFrame(rows, columns=["doc", "line_no", "line", "error"])

    return files.select("path", "content").mapInPandas(run, "doc string, line_no int, line string, error string")


def extract_pages(files: DataFrame, pages: Callable[[bytes], list[str]]) -> DataFrame:
    """path, n_pages, text (pages joined by line feeds), has_text (the first page has some), preview, error, by an injected page reader or OCR."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for path, content in zip(batch["path"], batch["content"], strict=True):
                try:
                    got = pages(bytes(content))
                    rows.append((path, len(got), "\n".join(got), bool(got and got[0].strip()), got[0][:500] if got else "", None))
                except Exception as e:  # as above
                    rows.append((path, None, None, None, None, f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(rows, columns=["path", "n_pages", "text", "has_text", "preview", "error"])

    return files.select("path", "content").mapInPandas(run, "path string, n_pages int, text string, has_text boolean, preview string, error string")


def converted(files: DataFrame, convert: Callable[[bytes], bytes], suffix: str = ".docx") -> DataFrame:
    """path (with another suffix), content, error of files by an injected converter of bytes (.doc to .docx, say). A file that fails gives its error."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for path, content in zip(batch["path"], batch["content"], strict=True):
                try:
                    rows.append((path, convert(bytes(content)), None))
                except Exception as e:  # as above
                    rows.append((path, None, f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(rows, columns=["path", "content", "error"])

    made = files.select("path", "content").mapInPandas(run, "path string, content binary, error string")
    return made.select(with_suffix(F.col("path"), suffix).alias("path"), "content", "error")


def placed_lines(spark: SparkSession, path: str) -> DataFrame:
    """path, start, place, value: lines of text files, in the order of start (of the split that read them) and place in each file."""
    return spark.read.text(path).select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().alias("place"), "value")


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """path, line_no, value of text files, numbered in each file; several tasks read a large file, and prefix sums over its splits give the numbers."""
    lines = placed_lines(spark, path)
    file, own = Window.partitionBy("path").orderBy("start"), Window.partitionBy("path", "start").orderBy("place")
    splits = lines.groupBy("path", "start").agg(F.count(F.lit(1)).alias("n"))  # a row for each split of a file
    splits = splits.select("path", "start", (F.sum("n").over(file) - F.col("n")).alias("base"))
    return lines.join(splits, ["path", "start"]).select("path", (F.col("base") + F.row_number().over(own) - 1).cast("int").alias("line_no"), "value")


def annotator_lines(spark: SparkSession, path: str) -> DataFrame:
    """The lines of text files that are not blank, numbered, for annotation."""
    return numbered_lines(spark, path).where(not_blank(F.col("value")))


def whole_text(spark: SparkSession, path: str) -> str:
    """A prompt file."""
    return spark.read.text(path, wholetext=True).first()[0]


def word_lists(spark: SparkSession, path: str) -> DataFrame:
    """kind, entry from lines `kind<tab>entry`."""
    return spark.read.text(path).where(F.col("value").contains("\t")).select(F.substring_index("value", "\t", 1).alias("kind"), F.trim(F.substring_index("value", "\t", -1)).alias("entry"))
