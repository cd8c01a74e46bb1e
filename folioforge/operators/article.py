"""Article parts: abstract, body and references by line rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.pytext import col, n_words, rstrip, strip, sub

#: The words that open the parts of an article, as patterns.
ABSTRACT = "abstract|résumé|abstrak|summary"
HEADING = r"^#{1,6}\s"
ABSTRACT_HEADING = rf"(?iuU)^#{{1,3}}\s+(?:{ABSTRACT})\b"
ABSTRACT_LINE = rf"(?iuU)^(?:{ABSTRACT})\s*$"
ABSTRACT_BOLD = rf"(?iuU)^\*{{1,2}}(?:{ABSTRACT})[:.*]*\*{{1,2}}\s*.*$"
KEYWORDS_BLOCK = r"(?iuU)^\*{0,2}(?:keywords?|key\s+words?|mots[\s\-]cl[eé]s?|palavras[\s\-]chave)\*{0,2}[\s:]*$"
KEYWORDS_INLINE = r"(?iuU)^\*{0,2}(?:keywords?|key\s+words?|mots[\s\-]cl[eé]s?)\s*[:*]{1,3}\s*\S"
INTRODUCTION = r"(?iuU)^#{1,3}\s+(?:\d+[.\s|]+)?(?:introduction|background|overview|context|introductory|mise\s+en\s+contexte)\b"
REFERENCES = r"(?iuU)^#{1,3}\s+(?:references|bibliography|works\s+cited|bibliographie|références|bibliografía|referências)\b"
APPENDIX = r"(?iuU)^#{1,3}\s*(?:appendix|appendices|annexe?s?|supplementary|supporting\s+information)\b"
BARE_HEADING = r"(?U)^\s*\d+(?:\.\d+)*\.?\s+[A-Z][A-Za-z]"
SIGNALS = r"(?iuU)@|\bdoi\s*:|https?://|www\.|^received\b|^accepted\b|^published\b|^correspondence\b|^email\b|^funding\b|^edited\s+by\b|^reviewed\s+by\b|\bvol\b\.?\s+\d|\bno\b\.?\s+\d|\bpp\b\.?\s+\d|issn|eissn|orcid"
ABSTRACT_WORDS = 400
INTRODUCTION_WITHIN = 120


def bare_heading(line) -> Column:
    """A short numbered line such as "1. Introduction" that carries no heading mark."""
    s = strip(line)
    return (s != "") & (F.length(s) <= 60) & s.rlike(BARE_HEADING)


def substantive(text, least: int) -> Column:
    s = strip(text)
    return (F.length(s) >= least) & (F.length(s) >= 40) & ~s.rlike(SIGNALS)


def _first(flags: Column, start=0) -> Column:
    """Index of the first true flag at or after start; null if there is none."""
    found = F.array_position(F.slice(flags, col(start).cast("int") + 1 if not isinstance(start, int) else F.lit(start + 1), F.size(flags) + 1), F.lit(True))
    return F.when(found > 0, found - 1 + start)


def _paragraph(lines_: Column, before: Column) -> Column:
    """struct<s, e>: the lines of the paragraph that ends above a line; null without one."""
    blank = F.transform(lines_, lambda x: strip(x) == "")
    head = F.slice(blank, F.lit(1), before.cast("int"))
    end = F.size(head) - F.array_position(F.reverse(head), F.lit(False))  # index of the last non-blank line
    stop = F.transform(F.slice(lines_, F.lit(1), (end + 0).cast("int")), lambda x: (strip(x) == "") | x.rlike(HEADING))
    back = F.array_position(F.reverse(stop), F.lit(True))
    start = F.when(back > 0, F.size(stop) - back + 1).otherwise(0)
    return F.when(F.array_contains(head, False), F.struct(start.cast("int").alias("s"), (end + 1).cast("int").alias("e")))


def split_article(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, abstract, body, references, abstract_start, abstract_end, references_start).

    The abstract begins, by the first rule that fires, at an abstract heading, a line that is such
    a word, a bold one, or is the paragraph above the first keywords line or the first introductory
    heading; it is capped at whole paragraphs of 400 words. References run from the last such
    heading to the first appendix heading. The body is all else. Lines count from 0; parts are
    trimmed; null texts have empty parts. One row per document, no shuffle.
    """
    df = docs.select(id_col, F.coalesce(F.col(text_col), F.lit("")).alias("_t"))
    # line ends stay with their lines: split behind them
    df = df.withColumn("_ls", F.when(F.col("_t") == "", F.array().cast("array<string>")).otherwise(F.filter(F.split("_t", r"(?<=\n)|(?<=\r)(?!\n)|(?<=[\x{b}\x{c}\x{1c}-\x{1e}\x{85}\x{2028}\x{2029}])", -1), lambda x: x != "")))
    flag = lambda test: F.transform("_ls", test)
    key = lambda x: strip(x).rlike(KEYWORDS_BLOCK) | strip(x).rlike(KEYWORDS_INLINE)
    df = df.withColumns(
        {
            "_n": F.size("_ls"),
            "_head": flag(lambda x: x.rlike(HEADING) | bare_heading(x)),
            "_key": flag(key),
            "_a1": _first(flag(lambda x: rstrip(x).rlike(ABSTRACT_HEADING))),
            "_a2": _first(flag(lambda x: strip(x).rlike(ABSTRACT_LINE))),
            "_a3": _first(flag(lambda x: rstrip(x).rlike(ABSTRACT_BOLD))),
            "_intro": _first(flag(lambda x: rstrip(x).rlike(INTRODUCTION))),
            "_refs": F.transform("_ls", lambda x: rstrip(x).rlike(REFERENCES)),
            "_app": F.transform("_ls", lambda x: rstrip(x).rlike(APPENDIX)),
        }
    )
    df = df.withColumns({"_k": _first(F.col("_key")), "_r": F.when(F.array_contains("_refs", True), F.size("_refs") - F.array_position(F.reverse("_refs"), F.lit(True)))})
    df = df.withColumns({"_pk": _paragraph(F.col("_ls"), F.col("_k")), "_pi": _paragraph(F.col("_ls"), F.col("_intro"))})
    either = F.zip_with("_head", "_key", lambda a, b: a | b)
    end = lambda flags, at: F.coalesce(_first(flags, at + 1), F.col("_n"))
    said = lambda p: F.array_join(F.slice("_ls", p["s"] + 1, p["e"] - p["s"]), " ")
    none = F.lit(None).cast("struct<s:int,e:int>")
    span = lambda s, e: F.struct(s.cast("int").alias("s"), e.cast("int").alias("e"))
    by_key = F.when(F.col("_pk").isNotNull() & substantive(said(F.col("_pk")), 100), span(F.col("_pk.s"), F.col("_k")))
    by_intro = F.when((F.col("_intro") <= INTRODUCTION_WITHIN) & F.col("_pi").isNotNull() & substantive(said(F.col("_pi")), 200), span(F.col("_pi.s"), F.col("_intro")))
    found = (
        F.when(F.col("_a1").isNotNull(), span(F.col("_a1"), end(F.col("_head"), F.col("_a1"))))
        .when(F.col("_a2").isNotNull(), span(F.col("_a2"), end(either, F.col("_a2"))))
        .when(F.col("_a3").isNotNull(), span(F.col("_a3"), end(either, F.col("_a3"))))
        .otherwise(F.coalesce(by_key, by_intro, none))
    )
    df = df.withColumn("_a", found)
    df = df.withColumn("_e", capped_end(F.slice("_ls", F.col("_a.s") + 1, F.col("_a.e") - F.col("_a.s"))) + F.col("_a.s"))
    df = df.withColumn("_re", F.coalesce(_first(F.col("_app"), F.col("_r") + 1), F.col("_n")))
    text = lambda s, e: F.coalesce(strip(F.array_join(F.slice("_ls", s.cast("int") + 1, F.greatest(e - s, F.lit(0)).cast("int")), "")), F.lit(""))
    inside = lambda i, s, e: F.coalesce((i >= s) & (i < e), F.lit(False))
    body = F.filter("_ls", lambda x, i: ~inside(i, F.col("_a.s"), F.col("_e")) & ~inside(i, F.col("_r"), F.col("_re")))
    return df.select(
        id_col,
        text(F.col("_a.s"), F.col("_e")).alias("abstract"),
        strip(F.array_join(body, "")).alias("body"),
        text(F.col("_r"), F.col("_re")).alias("references"),
        F.col("_a.s").alias("abstract_start"),
        F.col("_e").cast("int").alias("abstract_end"),
        F.col("_r").cast("int").alias("references_start"),
    )


def capped_end(part: Column, most: int = ABSTRACT_WORDS) -> Column:
    """How many of the lines of an abstract stay: whole paragraphs within the word budget.

    Of the blank lines, the first over budget ends it at the last blank line within budget, or at
    itself if there is none; without one over budget, all lines stay if they keep the budget, else
    those to the last blank line within it, or all.
    """

    def step(acc, x):
        words = acc["w"] + n_words(x)
        blank = strip(x) == ""
        over = blank & (words > most) & acc["cut"].isNull()
        return F.struct(
            (acc["i"] + 1).cast("int").alias("i"),
            words.cast("int").alias("w"),
            F.when(blank & (words <= most) & acc["cut"].isNull(), acc["i"]).otherwise(acc["good"]).cast("int").alias("good"),
            F.when(over, F.coalesce(acc["good"], acc["i"])).otherwise(acc["cut"]).cast("int").alias("cut"),
        )

    null = F.lit(None).cast("int")
    start = F.struct(F.lit(0).alias("i"), F.lit(0).alias("w"), null.alias("good"), null.alias("cut"))
    return F.aggregate(part, start, step, lambda acc: F.coalesce(acc["cut"], F.when(acc["w"] <= most, acc["i"]), acc["good"], acc["i"]))
