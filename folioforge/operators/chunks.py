"""Plain text of Markdown, token estimates and overlapping passages."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.pytext import SPACE, bound, col, n_words, named, spaced, sub, words


#: Signs that a text must hold for a pattern to match, the pattern and what stands for its matches.
MARKS = (
    (("```",), r"```[\s\S]*?```", " "),
    (("`",), "`[^`]+`", " "),
    (("#",), rf"(?m)(?d)^#{{1,6}}[{SPACE}]+", ""),
    (("![",), r"!\[[^\n]*?\]\([^\n]*?\)", " "),
    (("](",), r"\[([^\]]+)\]\([^\n]*?\)", "$1"),
    (("*", "_"), r"[*_]{1,3}([^*_]+)[*_]{1,3}", "$1"),
)
#: A sign that every one of these patterns needs.
ANY_MARK = r"[`#*_\]]"


def plain_text(markdown) -> Column:
    """Markdown without code, heading marks, images, links and emphasis, white space as one space."""

    def one(signs, pattern, by):
        return lambda x: F.when(reduce(or_, map(x.contains, signs)), sub(x, pattern, by)).otherwise(x)

    def unmarked(t):
        for mark in MARKS:
            t = bound(t, one(*mark))
        return t

    return spaced(bound(col(markdown), lambda t: F.when(t.rlike(ANY_MARK), unmarked(t)).otherwise(t)))


def _measured(content) -> Column:
    """(n, plain): words of a text and length of its plain text, from one split where the text holds no mark."""
    plain = lambda ws: F.when(content.rlike(ANY_MARK), F.length(plain_text(content))).otherwise(F.length(F.array_join(ws, " ")))
    return bound(words(content), lambda ws: F.struct(F.size(ws).alias("n"), plain(ws).alias("plain")))


def token_estimate(c) -> Column:
    return _estimate(n_words(c))


def _estimate(n: Column) -> Column:
    return F.floor(n * F.lit(13) / F.lit(10)).cast("int")


def _total(xs) -> Column:
    return F.aggregate(xs, F.lit(0), lambda a, x: a + x)


def running(sizes: Column, block: int = 32) -> Column:
    """array<int>: for each number the sum of those before it, by sums of whole blocks and the rest of its own block."""

    def before(xs, whole, i):
        b = F.floor(i / block).cast("int")
        return _total(F.slice(whole, F.lit(1), b)) + _total(F.slice(xs, b * block + 1, i - b * block))

    blocks = lambda xs: F.transform(F.sequence(F.lit(0), F.floor(F.size(xs) / block).cast("int")), lambda b: _total(F.slice(xs, b * block + 1, F.lit(block))))
    return named(sizes, lambda xs: named(blocks(xs), lambda whole: F.transform(xs, lambda x, i: before(xs, whole, i))))


def n_reached(sorted_marks: Column, at: Column) -> Column:
    """How many of the rising numbers are at or below ``at``, by halving."""
    halvings = F.ceil(F.log2(F.size(sorted_marks) + F.lit(1))).cast("int")
    pair = lambda lo, hi: F.struct(lo.cast("int").alias("lo"), hi.cast("int").alias("hi"))

    def step(acc, _):
        mid = F.shiftright(acc["lo"] + acc["hi"], 1)
        below = F.get(sorted_marks, mid) <= at
        return F.when(acc["lo"] >= acc["hi"], acc).when(below, pair(mid + 1, acc["hi"])).otherwise(pair(acc["lo"], mid))

    return F.aggregate(F.sequence(F.lit(1), F.greatest(F.lit(1), halvings)), pair(F.lit(0), F.size(sorted_marks)), step, lambda acc: acc["lo"])


def passages(text, window: int | Column, overlap: int | Column) -> Column:
    """array<struct<passage, char_offset>>: windows of words that advance by window - overlap.

    The last window is the first that reaches the end. char_offset is the length of the words
    before it joined by spaces. Numbers whose overlap leaves no advance are refused; columns give
    each row windows of its own.
    """
    return windows(words(text), window, overlap)


def windows(ws: Column, window: int | Column, overlap: int | Column) -> Column:
    """``passages`` of an array of words."""
    step = window - overlap
    if not isinstance(step, Column) and step <= 0:
        raise ValueError("overlap must be smaller than window")

    def built(ws):
        n = F.size(ws)
        k = F.when(n <= window, 1).otherwise(F.ceil((n - window) / F.lit(step)) + 1).cast("int")
        # lengths of the words between two starts, so that an offset adds up one number a window
        between = F.transform(F.sequence(F.lit(0), k - 1), lambda j: F.length(F.array_join(F.slice(ws, j * step + 1, F.lit(step)), "")) + F.when(j == 0, F.lit(step) - 1).otherwise(F.lit(step)))

        def one(before, j):
            return F.struct(F.array_join(F.slice(ws, j * step + 1, F.lit(window)), " ").alias("passage"), before.cast("int").alias("char_offset"))

        rows = named(running(between), lambda starts: F.transform(starts, one))
        return F.when(n == 0, F.array().cast("array<struct<passage:string,char_offset:int>>")).otherwise(rows)

    return named(ws, built)


SECTION = "section_ord int, content string, heading_path array<string>, language string"


def chunked(docs: DataFrame, sections: DataFrame | str | None = None, id_col: str = "doc_id", text_col: str = "text", window: int | Column = 300, overlap: int | Column = 50) -> DataFrame:
    """(id, position, chunk_id, kind, heading_path, language, content, token_count, char_offset).

    Position 0 is the whole document, then its non-blank sections in order, then passages of its
    plain text. ``sections`` has section_ord, content, heading_path, language: the name of an array
    of such structs in ``docs``, in order, which needs no shuffle, or a table with the id; a passage
    takes path and language of the last section whose offset (lengths of the plain section texts,
    plus one each) is not behind it, and none before the first.
    """
    rows = docs.withColumns({"_window": F.lit(window), "_overlap": F.lit(overlap)})
    empty = F.array().cast("array<string>")
    own = lambda s: F.struct(s["section_ord"].cast("int").alias("section_ord"), s["content"].alias("content"), s["heading_path"].alias("heading_path"), F.coalesce(s["language"], F.lit("")).alias("language"))
    if isinstance(sections, DataFrame):
        per = sections.groupBy(id_col).agg(F.array_sort(F.collect_list(F.struct("section_ord", "content", "heading_path", "language"))).alias("_secs"))
        rows, sections = rows.join(per, id_col, "left"), "_secs"
    secs = F.transform(sections, own) if sections else F.lit(None).cast(f"array<struct<{SECTION}>>")
    rows = rows.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), "_window", "_overlap", F.coalesce(secs, F.array().cast(f"array<struct<{SECTION}>>")).alias("secs"))
    if isinstance(window, Column):
        window, overlap = F.col("_window"), F.col("_overlap")
    none = F.lit(None).cast("int")
    piece = lambda kind, path, language, content, tokens, offset: F.struct(F.lit(kind).alias("kind"), path.alias("heading_path"), language.alias("language"), content.alias("content"), tokens.alias("token_count"), offset.alias("char_offset"))
    whole = piece("full_doc", empty, F.lit(""), F.col("text"), token_estimate("text"), none)

    def passage(p, j, secs, marks, n):
        at = n_reached(marks, p["char_offset"])
        last = F.get(secs, at - 1)
        tokens = _estimate(F.least(F.lit(window), n - j * F.lit(window - overlap)))
        return piece("passage", F.coalesce(last["heading_path"], empty), F.coalesce(last["language"], F.lit("")), p["passage"], tokens, p["char_offset"])

    def laid(secs, sizes):
        parts = F.transform(secs, lambda s, i: piece("section", s["heading_path"], s["language"], s["content"], _estimate(F.get(sizes, i)["n"]), none))
        parts = F.filter(parts, lambda c: c["token_count"] > 0)
        marks = running(F.transform(sizes, lambda m: m["plain"] + 1))
        below = lambda ws, m: F.transform(windows(ws, window, overlap), lambda p, j: passage(p, j, secs, m, F.size(ws)))
        return F.concat(F.array(whole), parts, named(marks, lambda m: named(words(plain_text("text")), lambda ws: below(ws, m))))

    # sections, their sizes and marks are bound, so that each is made once a document
    rows = rows.withColumn("chunks", named(F.col("secs"), lambda secs: named(F.transform(secs, lambda s: _measured(s["content"])), lambda sizes: laid(secs, sizes))))
    # a document has at least one chunk: the outer form spares the filter that would lay all chunks to see that they are not empty
    rows = rows.select("id", F.posexplode_outer("chunks").alias("position", "c"))
    return rows.select(F.col("id").alias(id_col), "position", F.format_string("%s_%04d", F.col("id").cast("string"), F.col("position")).alias("chunk_id"), F.col("c.kind").alias("kind"), "c.heading_path", "c.language", "c.content", "c.token_count", "c.char_offset")
