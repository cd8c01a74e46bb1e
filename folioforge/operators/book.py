"""Books: front matter, chapters and back matter from line markers, as window expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.pytext import lines, n_words, strip, sub
from ..functions.strings import book_slug
from ..session import kept

#: Headings before and after the chapters of a book, as patterns.
FRONT = [
    "foreword", "preface", "acknowledgements?", "contents?", "table of contents", "list of (?:figures|tables|abbreviations|contributors)", "abbreviations", "glossary",
    "series (?:foreword|editor)", "general editor", "dedication", "about the (?:author|editor|book)", "notes on (?:the|this) (?:text|book)",
]
BACK = ["references", "bibliography", "notes", "index", "appendix", "author (?:index|bio)", "about the (?:author|editor)", "colophon"]
NUMBER = r"[IVXLCivxlc\d]+"
PART_LINE = rf"(?iuU)^\s*#?\s*part\s+{NUMBER}(?:\s*[.:-]\s*\w+)?\s*$"
CHAPTER_LINE = rf"(?iuU)^\s*#?\s*chapter\s+({NUMBER}(?:\s*[.:-]\s*\w+)?)\b"
FRONT_LINE = rf"(?iuU)^\s*#?\s*(?:{'|'.join(FRONT)})\s*$"
BACK_LINE = rf"(?iuU)^\s*#?\s*(?:{'|'.join(BACK)})\s*$"
CONTENTS_LINE = r"(?iuU)^\s*#?\s*(?:table of )?contents\s*$"
REAL_HEAD = r"(?iuU)^\s*#\s+(?:part|chapter)\s"
TITLE_LINE = r"(?U)^\s*#{1,2}\s+(.+?)\s*$"
ITALIC_TITLE = r"(?U)^\s*#{1,3}\s+\*(.+?)\*\s*$"
TOC_NUMBERED = rf"(?iuU)^\s*#?\s*(?:chapter|part)\s+{NUMBER}\.\s+\S.*\d\s*$"
TOC_LONG = rf"(?iuU)^\s*#?\s*(?:chapter|part)\s+{NUMBER}\.\s+\S"
BOILERPLATE = r"(?iuU)(^|\n)\s*(?:ISBN[-: ]?\S+|All rights reserved|Library of Congress Catalog|Printed in |Published by |First (?:published|edition)|This book is printed on |©\s*\d{4}|Copyright\s+©?\s*\d{4}|\d{13}|\d{10})"


def toc_line(line) -> Column:
    return line.rlike(TOC_NUMBERED) | (line.rlike(TOC_LONG) & (n_words(line) > 6))


def clean_heading(line) -> Column:
    inner = F.when(line.rlike(TITLE_LINE), F.regexp_extract(line, TITLE_LINE, 1)).otherwise(strip(sub(line, "^#+|#+$")))
    return strip(F.translate(inner, "*_", ""))


def without_yaml(text) -> Column:
    """The text behind a leading block between lines of three dashes; unchanged without one."""
    at = F.locate("\n---", text, 4)
    return F.when(text.startswith("---") & (at > 0), strip(F.substring(text, at + 4, F.length(text)))).otherwise(text)


def book_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, line_no, line, zone): zone is front, body or back; a leading YAML block has no rows.

    The body begins at the first "# Part" or "# Chapter" heading behind the contents heading, if
    any; without such a heading all is front. The back begins at the first back heading of the rest.
    """
    ls = docs.select(id_col, lines(F.coalesce(F.col(text_col), F.lit(""))).alias("_ls"))
    dashes = F.transform("_ls", lambda x: strip(x) == "---")
    close = F.array_position(F.slice(dashes, F.lit(2), F.size("_ls") + 1), F.lit(True))
    skip = F.when(F.coalesce(F.get(dashes, F.lit(0)), F.lit(False)) & (close > 0), close + 1).otherwise(0).cast("int")
    ls = ls.withColumn("_ls", F.slice("_ls", skip + 1, F.size("_ls") + 1))
    first = lambda flags, start: F.array_position(F.slice(flags, start + 1, F.size("_ls") + 1), F.lit(True))
    contents = F.array_position(F.transform("_ls", lambda x: x.rlike(CONTENTS_LINE)), F.lit(True)).cast("int")
    ls = ls.withColumn("_c", contents)
    head = first(F.transform("_ls", lambda x: x.rlike(REAL_HEAD)), F.col("_c")).cast("int")
    ls = ls.withColumn("_b", F.when(head > 0, F.col("_c") + head - 1).otherwise(F.size("_ls")))
    back = first(F.transform("_ls", lambda x: x.rlike(BACK_LINE)), F.col("_b")).cast("int")
    ls = ls.withColumn("_k", F.when(back > 0, F.col("_b") + back - 1).otherwise(F.size("_ls")))
    rows = ls.select(id_col, "_b", "_k", F.posexplode("_ls").alias("p", "line"))
    zone = F.when(F.col("p") < F.col("_b"), "front").when(F.col("p") < F.col("_k"), "body").otherwise("back")
    return rows.select(id_col, (F.col("p") + 1).cast("long").alias("line_no"), "line", zone.alias("zone"))


def book_chapters(rows: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, chapter_no, part, number, title, text) from ``book_lines``.

    A chapter opens at a chapter line, or at a level-1 heading unless it is the title of a chapter
    line just passed. A part line closes the open chapter; lines outside chapters are left out.
    """
    line = F.col("line")
    b = rows.where("zone = 'body'").where(~toc_line(line))
    part = line.rlike(PART_LINE)
    chapter = ~part & line.rlike(CHAPTER_LINE)
    front = line.rlike(FRONT_LINE)
    head = ~part & ~chapter & line.rlike(TITLE_LINE)
    level1 = head & line.rlike(r"(?U)^#\s") & ~front
    b = b.withColumns({"_e": F.when(part, "part").when(chapter, "chapter").when(level1, "title"), "_title": F.when(head & ~front, F.when(line.rlike(ITALIC_TITLE), strip(F.regexp_extract(line, ITALIC_TITLE, 1))).otherwise(clean_heading(line)))})
    order = Window.partitionBy(key).orderBy("line_no")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    upto = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    b = b.withColumn("_prev", F.last("_e", True).over(before))
    opens = (F.col("_e") == "chapter") | ((F.col("_e") == "title") & (F.coalesce("_prev", F.lit("")) != "chapter"))
    b = b.withColumn("_opens", F.coalesce(opens, F.lit(False)))
    b = b.withColumns(
        {
            "chapter_no": F.sum(F.col("_opens").cast("int")).over(upto),
            "_open": F.last(F.when(F.col("_e") == "part", False).when(F.col("_opens"), True), True).over(upto),
            "part": F.coalesce(F.last(F.when(F.col("_e") == "part", F.upper(clean_heading(line))), True).over(upto), F.lit("")),
        }
    )
    b = b.where("_open")
    own = (F.col("_e").isNull()) | (F.col("_e") != "chapter")
    ch = b.groupBy(key, "chapter_no").agg(
        F.min_by("part", "line_no").alias("part"),
        F.coalesce(F.max(F.when(F.col("_e") == "chapter", clean_heading(F.regexp_extract("line", CHAPTER_LINE, 1)))), F.lit("")).alias("number"),
        F.coalesce(F.min_by(F.when(own & (F.col("_title") != ""), F.col("_title")), F.when(own & (F.col("_title") != ""), F.col("line_no"))), F.lit("")).alias("title"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.when(own, F.struct("line_no", "line")))), lambda x: x["line"]), "\n").alias("text"),
    )
    return ch.withColumn("text", strip(sub(strip("text"), BOILERPLATE, "$1"))).withColumn("chapter_no", F.col("chapter_no").cast("int"))


def book_parts(rows: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, parts): part names in order of first mention, case aside."""
    line = F.col("line")
    p = rows.where("zone = 'body'").where(~toc_line(line) & line.rlike(PART_LINE)).select(key, "line_no", F.upper(clean_heading(line)).alias("part")).where("part <> ''")
    first = p.groupBy(key, F.lower("part").alias("k")).agg(F.min(F.struct("line_no", "part")).alias("f"))
    return first.groupBy(key).agg(F.transform(F.array_sort(F.collect_list("f")), lambda x: x["part"]).alias("parts"))


def book_frame(rows: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, front_matter, back_matter)."""
    text = lambda zone: strip(F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("zone") == zone, F.struct("line_no", "line")))), lambda x: x["line"]), "\n"))
    return rows.groupBy(key).agg(text("front").alias("front"), text("back").alias("back_matter")).select(key, without_yaml(F.col("front")).alias("front_matter"), "back_matter")


def _label() -> Column:
    name = lambda c: F.nullif(F.col(c), F.lit(""))
    return F.coalesce(name("title"), name("number"), F.concat(F.lit("chapter_"), F.col("chapter_no").cast("string")))


def contents_index(chapters: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, content): numbered chapters under the headings of the parts they change to."""
    order = Window.partitionBy(key).orderBy("chapter_no").rowsBetween(Window.unboundedPreceding, -1)
    prev = F.last(F.nullif("part", F.lit("")), True).over(order)
    c = chapters.withColumn("_new", (F.col("part") != "") & ~F.col("part").eqNullSafe(prev))
    item = F.concat(F.when(F.col("_new"), F.concat(F.lit("\n## "), F.col("part"), F.lit("\n"))).otherwise(""), F.col("chapter_no").cast("string"), F.lit(". "), _label())
    rows = c.select(key, "chapter_no", item.alias("item"))
    return rows.groupBy(key).agg(F.concat(F.lit("# Contents\n\n"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("chapter_no", "item"))), lambda x: x["item"]), "\n"), F.lit("\n")).alias("content"))


def book_files(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", name_col: str = "filename") -> DataFrame:
    """(id, rel_path, content): the files of each book."""
    rows = book_lines(docs, id_col, text_col)
    # several files are made of each
    ch, frame = kept(book_chapters(rows, id_col), "chapters"), kept(book_frame(rows, id_col), "frames")
    stem = sub(F.element_at(F.split(F.col(name_col), "[/\\\\]"), -1), r"(?<=.)\.[^.]*$")
    one = lambda df, path, content: df.select(id_col, path.alias("rel_path"), content.alias("content"))
    title = F.concat(F.lit("---\ntitle: "), stem, F.lit("\nsource_file: "), F.col(name_col), F.lit("\n---\n# "), stem, F.lit("\n"))
    head = F.concat(F.lit("# "), _label(), F.when(F.col("part") != "", F.concat(F.lit("\n\n> "), F.col("part"))).otherwise(""))
    files = one(docs, F.lit("bibliographic.md"), title)
    files = files.union(one(frame.where("front_matter <> ''"), F.lit("00_front_matter.md"), F.col("front_matter")))
    files = files.union(one(ch, F.concat(F.format_string("%02d_", "chapter_no"), book_slug(_label()), F.lit(".md")), F.concat(head, F.lit("\n\n"), F.col("text"), F.lit("\n"))))
    index = docs.select(id_col).join(contents_index(ch, id_col), id_col, "left").withColumn("content", F.coalesce("content", F.lit("# Contents\n\n")))
    files = files.union(one(index, F.lit("contents.md"), F.col("content")))
    files = files.union(one(frame.where("back_matter <> ''"), F.lit("zz_back_matter.md"), F.col("back_matter")))
    return files.union(one(docs, F.lit("raw.md"), F.coalesce(F.col(text_col), F.lit(""))))
