"""Law documents: lines to a header row and a tree of provisions, with windows over each document's lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from statuta.functions.constants import BASIS, BOILERPLATE, HEADINGS
from statuta.functions.text import after_first, before_first, collapse, content_id, no_spaces, strip

DATE = r"(?Ud)^.*ngày\s+\d{1,2}\s+tháng\s+\d{1,2}\s+năm\s+\d{4}"
NUMBER = r"(?Ud)Số:\s*(.+)"
STOP = r"(?U)^\s*(\d+\.\s*|[a-zA-ZđĐ]\)\s*)"
CLAUSE = r"(?U)^\d+\."
POINT = r"^([\p{L}\p{Nl}\p{No}])\)"
KINDS = ("chapter", "section", "article", "clause", "point")


def _starts(c: Column, words: tuple[str, ...]) -> Column:
    out = c.startswith(words[0])
    for w in words[1:]:
        out = out | c.startswith(w)
    return out


def law_headers(lines: DataFrame, doc: str = "doc", number: str = "line_no", line: str = "line") -> DataFrame:
    """doc, so_hieu, title, content from the lines before each document's first heading.

    A sub-line that begins the basis clause turns all that follows into content.
    Before it, a line that states the law's number sets it (the last one counts)
    and gives no title; boilerplate and dates are left out; the rest is title.
    """
    base = lines.select(F.col(doc).alias("doc"), F.col(number).alias("line_no"), F.col(line).alias("line"))
    by_doc = Window.partitionBy("doc")
    body = strip(F.col("line"))
    first_stop = F.min(F.when(_starts(body, HEADINGS), F.col("line_no"))).over(by_doc)
    before = base.withColumn("stop", first_stop).where("stop IS NULL OR line_no < stop")
    subs = before.select("doc", "line_no", "line", F.posexplode(F.split(body, "\n")).alias("sub_no", "raw")).withColumn("sub", strip(F.col("raw")))
    halt = F.min(F.when(_starts(F.col("sub"), HEADINGS), F.col("sub_no"))).over(Window.partitionBy("doc", "line_no"))
    live = subs.withColumn("halt", halt).where("(halt IS NULL OR sub_no < halt) AND sub <> ''")
    so_far = Window.partitionBy("doc").orderBy("line_no", "sub_no")
    told = live.withColumn("basis", F.max(F.col("sub").startswith(BASIS)).over(so_far))
    stated = F.when(~F.col("basis") & F.col("line").rlike(NUMBER), no_spaces(F.regexp_extract("line", NUMBER, 1)))
    named = told.withColumn("stated", stated)
    at = F.struct("line_no", "sub_no")
    part = F.struct("line_no", "sub_no", "sub")
    is_title = ~F.col("basis") & F.col("stated").isNull() & ~_starts(F.col("sub"), BOILERPLATE) & ~F.col("sub").rlike(DATE)
    grouped = named.groupBy("doc").agg(
        F.max_by("stated", F.when(F.col("stated").isNotNull(), at)).alias("so_hieu"),
        F.array_sort(F.collect_list(F.when(is_title, part))).alias("titles"),
        F.array_sort(F.collect_list(F.when(F.col("basis"), part))).alias("contents"),
    )
    join = lambda c: strip(F.array_join(F.transform(c, lambda x: x["sub"]), " "))
    found = grouped.select("doc", "so_hieu", join("titles").alias("title"), join("contents").alias("content"))
    empty = base.select("doc").distinct()
    return empty.join(found, "doc", "left").select("doc", "so_hieu", F.coalesce("title", F.lit("")).alias("title"), F.coalesce("content", F.lit("")).alias("content"))


def law_provisions(lines: DataFrame, headers: DataFrame, strict_headings: bool = False, doc: str = "doc", number: str = "line_no", line: str = "line") -> DataFrame:
    """doc, seg, kind, id, title, content, parent_id, so_hieu, path: the provisions of documents whose header has a number.

    A marker line opens a provision and the lines up to the next one are its
    content, so the provision is a running count of markers. Ancestors are the
    last markers of each kind, unless a marker of a higher kind came since.
    Documents without a number yield nothing. Of provisions with one path the
    last one stays. strict_headings asks for a number or numeral after the
    heading's word, so that body lines that begin alike are content.
    """
    in_doc = Window.partitionBy("doc").orderBy("line_no")
    s = F.col("s")
    heads = [s.rlike(rf"^{w}\s+[\dIVXLC]+") if strict_headings else s.startswith(w) for w in ("Chương", "Mục", "Điều")]
    kind = F.when(heads[0], "chapter").when(heads[1], "section").when(heads[2], "article").when(s.rlike(CLAUSE), "clause").when(s.rlike(POINT), "point")
    base = lines.select(F.col(doc).alias("doc"), F.col(number).alias("line_no"), strip(F.col(line)).alias("s")).withColumn("kind", kind)
    stop = heads[0] | heads[1] | heads[2] | s.rlike(STOP)
    seen = F.coalesce(F.max(F.col("kind").isNotNull()).over(in_doc.rowsBetween(Window.unboundedPreceding, -1)), F.lit(False))
    # A point whose letter the stop rule does not know opens a provision only where no marker stands before it.
    marked = base.withColumn("stop", stop).withColumn("seen", seen).withColumn("marker", F.col("kind").isNotNull() & (F.col("stop") | ~F.col("seen")))
    numbered = marked.withColumn("seg", F.sum(F.col("marker").cast("int")).over(in_doc)).where("seg > 0")
    texts = numbered.groupBy("doc", "seg").agg(
        F.max(F.when(F.col("marker"), F.col("kind"))).alias("kind"),
        F.max(F.when(F.col("marker"), F.col("s"))).alias("head"),
        F.array_sort(F.collect_list(F.when(~F.col("marker") & (s != ""), F.struct("line_no", "s")))).alias("rest"),
    )
    extra = F.array_join(F.transform("rest", lambda x: x["s"]), "\n")
    head, k = F.col("head"), F.col("kind")
    title = (
        F.when(k.isin("chapter", "section"), strip(before_first(head, "\n")))
        .when(k == "article", strip(before_first(head, ".")))
        .when(k == "clause", F.concat(F.lit("Khoản "), strip(before_first(head, "."))))
        .otherwise(F.concat(F.lit("Điểm "), F.regexp_extract(head, POINT, 1)))
    )
    own = F.when(k.isin("article", "clause"), after_first(head, ".")).when(k == "point", after_first(head, ")")).otherwise("")
    rows = texts.select("doc", "seg", "kind", title.alias("title"), collapse(F.concat_ws("\n", own, extra)).alias("content"))
    numbers = headers.where("so_hieu IS NOT NULL AND so_hieu <> ''").select("doc", "so_hieu")
    rows = rows.join(numbers, "doc")
    upto = Window.partitionBy("doc").orderBy("seg")
    for name in KINDS[:4]:
        rows = rows.withColumn(name, F.last(F.when(k == name, F.struct("seg", "title")), ignorenulls=True).over(upto))
    newest = F.col("chapter.seg")
    for name in KINDS[1:4]:
        rows = rows.withColumn(name, F.when(F.col(f"{name}.seg") > F.coalesce(newest, F.lit(0)), F.col(name)))
        newest = F.greatest(newest, F.col(f"{name}.seg"))
    so, ch, sec, art, cl = F.col("so_hieu"), *[F.col(f"{n}.title") for n in KINDS[:4]]
    empty = lambda c: F.coalesce(c, F.lit(""))
    path = {
        "chapter": F.concat_ws("_", so, ch),
        "section": F.concat_ws("_", so, empty(ch), sec),
        "article": F.concat_ws("_", so, empty(ch), sec, art),
        "clause": F.concat_ws("_", so, empty(ch), sec, empty(art), cl),
        "point": F.concat_ws("_", so, empty(ch), sec, empty(art), empty(cl), F.col("title")),
    }
    id_of = {n: F.when(F.col(n).isNotNull(), content_id(path[n])) for n in KINDS[:4]}
    parent = F.when(k == "section", id_of["chapter"]).when(k == "article", F.coalesce(id_of["section"], id_of["chapter"])).when(k == "clause", id_of["article"]).when(k == "point", id_of["clause"])
    own_path = path["point"]
    for n in KINDS[:4]:
        own_path = F.when(k == n, path[n]).otherwise(own_path)
    made = rows.select("doc", "seg", "kind", own_path.alias("path"), "title", "content", parent.alias("parent_id"), "so_hieu").withColumn("id", content_id(F.col("path")))
    return upsert_last(made, ["id"], ["doc", "seg"])


def upsert_last(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Of the rows of a key, the last one in the given order."""
    newest = Window.partitionBy(*keys).orderBy(*[F.desc_nulls_last(c) for c in order])
    return rows.withColumn("_n", F.row_number().over(newest)).where("_n = 1").drop("_n")


def upsert(current: DataFrame, delta: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """current with the rows of delta in place of those that share their keys; the caller writes it as a new snapshot."""
    last = upsert_last(delta, keys, order).select(*current.columns)
    return current.join(last.select(*keys), keys, "left_anti").unionByName(last)
