"""Decorated documents: sample texts given headings, citations, references and page furniture.

The sample tables hold plain prose, so the structure operators read these. DuckDB makes them by SQL;
Spark lays the same lines out as one array a document, so that they are shuffled once, as whole texts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BODY = """
n AS (SELECT doc_id, max(i) AS n FROM doc_lines GROUP BY doc_id),
d AS (
  SELECT doc_id, 0 AS k1, 0 AS k2, concat('# Title ', doc_id) AS line FROM n
  UNION ALL SELECT doc_id, 0, 1, '' FROM n
  UNION ALL SELECT doc_id, 0, 2, '## Abstract' FROM n WHERE doc_id % 5 <> 4
  UNION ALL SELECT doc_id, 0, 3, '' FROM n WHERE doc_id % 2 = 0
  UNION ALL SELECT doc_id, i, 0, concat(CASE WHEN i % 10 = 5 THEN '### ' ELSE '## ' END, 'Section ', i) FROM doc_lines WHERE i % 5 = 0
  UNION ALL SELECT doc_id, i, 1, concat(line, CASE WHEN i % 7 = 3 THEN concat(' (Smith ', 1990 + i % 30, ', ', i, ')') ELSE '' END) FROM doc_lines
  UNION ALL SELECT doc_id, i, 2, cast(i AS VARCHAR(10)) FROM doc_lines WHERE i % 11 = 0
  UNION ALL SELECT doc_id, i, 3, concat('DOI: 10.1234/x', i) FROM doc_lines WHERE i % 13 = 0
  UNION ALL SELECT doc_id, 1000000, 0, '## References' FROM n WHERE doc_id % 4 <> 3
  UNION ALL SELECT doc_id, 1000000, 1, concat('- Smith, J. (', 1990 + doc_id % 30, '). Work.') FROM n WHERE doc_id % 4 <> 3
  UNION ALL SELECT doc_id, 1000001, 0, '## Appendix A' FROM n WHERE doc_id % 3 = 0
  UNION ALL SELECT doc_id, 1000001, 1, 'Extra material.' FROM n WHERE doc_id % 3 = 0)
"""
ORDERED = "SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY k1, k2) AS line_no, line FROM d"

BOOK_BODY = """
b AS (
  SELECT doc_id, -9 AS k1, 0 AS k2, '---' AS line FROM n WHERE doc_id % 3 = 0
  UNION ALL SELECT doc_id, -9, 1, concat('title: Book ', doc_id) FROM n WHERE doc_id % 3 = 0
  UNION ALL SELECT doc_id, -9, 2, '---' FROM n WHERE doc_id % 3 = 0
  UNION ALL SELECT doc_id, -8, 0, '# Preface' FROM n
  UNION ALL SELECT doc_id, -7, 0, 'Contents' FROM n WHERE doc_id % 2 = 0
  UNION ALL SELECT doc_id, -7, 1, 'Chapter I. The first long title of them all 12' FROM n WHERE doc_id % 2 = 0
  UNION ALL SELECT doc_id, -6, 0, '# Part I' FROM n WHERE doc_id % 5 <> 0
  UNION ALL SELECT doc_id, -6, 1, 'Words between part and chapter.' FROM n WHERE doc_id % 5 <> 0
  UNION ALL SELECT doc_id, 0, 0, '# Chapter 1' FROM n
  UNION ALL SELECT doc_id, 0, 1, concat('# Opening ', doc_id) FROM n WHERE doc_id % 2 = 1
  UNION ALL SELECT doc_id, 0, 2, '## *An italic title*' FROM n WHERE doc_id % 4 = 0
  UNION ALL SELECT doc_id, i, 0, concat('# Part ', CASE WHEN i % 2 = 0 THEN 'II' ELSE 'III' END) FROM doc_lines WHERE i % 9 = 8
  UNION ALL SELECT doc_id, i, 1, concat('Chapter ', i) FROM doc_lines WHERE i % 4 = 0
  UNION ALL SELECT doc_id, i, 2, concat('# Essay ', i) FROM doc_lines WHERE i % 6 = 5
  UNION ALL SELECT doc_id, i, 3, line FROM doc_lines
  UNION ALL SELECT doc_id, i, 4, 'ISBN 978-1-23 sold' FROM doc_lines WHERE i % 10 = 9
  UNION ALL SELECT doc_id, 1000000, 0, '# References' FROM n WHERE doc_id % 3 <> 1
  UNION ALL SELECT doc_id, 1000000, 1, 'Smith, J. Work.' FROM n WHERE doc_id % 3 <> 1)
"""
BOOK_ORDERED = "SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY k1, k2) AS line_no, line FROM b"

DUCK_LINES = "doc_lines AS (SELECT doc_id, generate_subscripts(ls, 1) AS i, unnest(ls) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents))"
DUCK_TEXT = "SELECT doc_id, string_agg(line, chr(10) ORDER BY line_no) AS text FROM ({}) GROUP BY doc_id"
#: CTEs of DuckDB: doc_lines, n, d, dec (lines) and doc (texts); likewise for books.
DUCK = f"WITH {DUCK_LINES}, {BODY}, dec AS ({ORDERED}), doc AS ({DUCK_TEXT.format('SELECT * FROM dec')})"
DUCK_BOOK = f"WITH {DUCK_LINES}, n AS (SELECT doc_id, max(i) AS n FROM doc_lines GROUP BY doc_id), {BOOK_BODY}, bookdec AS ({BOOK_ORDERED})"


def _laid(spark: SparkSession, sf_dir: str, before: list, each, after: list) -> DataFrame:
    """(doc_id, lines): blocks of (condition, lines) around what ``each`` makes of the lines of number i; rows that share an id are one document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").where("text is not null")
    docs = docs.groupBy("doc_id").agg(F.collect_list("text").alias("texts"))
    docs = docs.withColumn("parts", F.transform("texts", lambda t: F.split(t, "\n", -1)))
    none = F.array().cast("array<string>")
    block = lambda cond, made: F.array(*made) if cond is None else F.when(cond, F.array(*made)).otherwise(none)
    own = lambda i: F.filter(F.transform("parts", lambda p: F.get(p, i - 1)), lambda x: x.isNotNull())
    every = lambda i: F.concat(*(ls if cond is None else F.when(cond, ls).otherwise(none) for cond, ls in each(i, own(i))))
    body = F.flatten(F.transform(F.sequence(F.lit(1), F.array_max(F.transform("parts", F.size))), every))
    return docs.select("doc_id", F.concat(*(block(*b) for b in before), body, *(block(*b) for b in after)).alias("lines"))


def _text(*parts):
    return F.concat(*(F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts))


def _instead(ls, *parts):
    """``parts`` for each of the lines ``ls``."""
    return F.transform(ls, lambda _: _text(*parts))


def decorated_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, lines)."""
    d = F.col("doc_id")
    before = [(None, [_text("# Title ", d), F.lit("")]), (d % 5 != 4, [F.lit("## Abstract")]), (d % 2 == 0, [F.lit("")])]
    after = [(d % 4 != 3, [F.lit("## References"), _text("- Smith, J. (", 1990 + d % 30, "). Work.")]), (d % 3 == 0, [F.lit("## Appendix A"), F.lit("Extra material.")])]

    def each(i, ls):
        cite = F.when(i % 7 == 3, _text(" (Smith ", 1990 + i % 30, ", ", i, ")")).otherwise("")
        return [
            (i % 5 == 0, _instead(ls, F.when(i % 10 == 5, "### ").otherwise("## "), "Section ", i)),
            (None, F.transform(ls, lambda x: F.concat(x, cite))),
            (i % 11 == 0, _instead(ls, i)),
            (i % 13 == 0, _instead(ls, "DOI: 10.1234/x", i)),
        ]

    return _laid(spark, sf_dir, before, each, after)


def book_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, lines) of the book variant."""
    d = F.col("doc_id")
    before = [
        (d % 3 == 0, [F.lit("---"), _text("title: Book ", d), F.lit("---")]), (None, [F.lit("# Preface")]),
        (d % 2 == 0, [F.lit("Contents"), F.lit("Chapter I. The first long title of them all 12")]), (d % 5 != 0, [F.lit("# Part I"), F.lit("Words between part and chapter.")]),
        (None, [F.lit("# Chapter 1")]), (d % 2 == 1, [_text("# Opening ", d)]), (d % 4 == 0, [F.lit("## *An italic title*")]),
    ]

    def each(i, ls):
        return [
            (i % 9 == 8, _instead(ls, "# Part ", F.when(i % 2 == 0, "II").otherwise("III"))),
            (i % 4 == 0, _instead(ls, "Chapter ", i)),
            (i % 6 == 5, _instead(ls, "# Essay ", i)),
            (None, ls),
            (i % 10 == 9, _instead(ls, "ISBN 978-1-23 sold")),
        ]

    return _laid(spark, sf_dir, before, each, [(d % 3 != 1, [F.lit("# References"), F.lit("Smith, J. Work.")])])


def decorated_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, line_no, line)."""
    return decorated_docs(spark, sf_dir).select("doc_id", F.posexplode("lines").alias("p", "line")).select("doc_id", (F.col("p") + 1).alias("line_no"), "line")


def decorated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, text)."""
    return texts_of(decorated_docs(spark, sf_dir))


def book_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, text) of the book variant."""
    return texts_of(book_docs(spark, sf_dir))


def texts_of(docs: DataFrame) -> DataFrame:
    """(doc_id, text) of (doc_id, lines)."""
    return docs.select("doc_id", F.array_join("lines", "\n").alias("text"))
