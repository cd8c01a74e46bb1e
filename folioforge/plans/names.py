"""Queries on names, duplicates, resumption and library items."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import strings as S
from ..operators import names as N
from .registry import registry

QUERIES, ORACLES, query = registry()


def _read(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query("SELECT doc_id, source, n_chars FROM (SELECT *, row_number() OVER (PARTITION BY source, n_chars % 50 ORDER BY doc_id) AS r FROM documents) WHERE r = 1")
def uploads_deduplicated(spark, sf_dir):
    d = _read(spark, sf_dir, "documents").select("doc_id", "source", "n_chars", (F.col("n_chars") % 50).alias("size"))
    return N.first_of(d, ["source", "size"], F.col("doc_id")).drop("size")


@query("SELECT doc_id, concat(source, '/', doc_id) AS source FROM documents WHERE doc_id % 4 <> 1")
def pending_documents(spark, sf_dir):
    d = _read(spark, sf_dir, "documents").selectExpr("doc_id", "concat(source, '/', doc_id) AS source")
    return N.pending(d, d.where("doc_id % 4 = 1")).select("doc_id", "source")


ITEMS = "SELECT o_orderkey AS ord, concat('K', o_orderkey) AS item_key, concat('Order ', o_orderkey) AS title, cast(o_orderdate AS {date}) AS d, o_custkey, o_orderkey FROM {orders}"


@query(
    """WITH kids AS (SELECT concat('K', l_orderkey) AS item_key, l_orderkey, l_linenumber AS child_ord, concat('C:/lib dir/', l_partkey % 97, '_', l_suppkey % 13, '.pdf') AS pdf_path FROM lineitem WHERE l_linenumber % 3 = 1),
 done AS (SELECT DISTINCT concat('K', l_orderkey) AS item_key FROM lineitem WHERE l_linenumber % 3 = 2 AND l_partkey % 5 = 0),
 r AS (SELECT o_orderkey, k.item_key, pdf_path, concat('Order ', o_orderkey) AS title, CASE WHEN o_custkey % 2 = 0 THEN concat('Name', o_custkey % 10) ELSE concat('Name', o_custkey % 10, ', Other') END AS authors, CAST(year(o_orderdate) AS INT) AS year,
   done.item_key IS NOT NULL AS already_parsed, row_number() OVER (PARTITION BY pdf_path ORDER BY o_orderkey, child_ord) AS rn FROM kids k JOIN orders o ON o.o_orderkey = k.l_orderkey LEFT JOIN done ON done.item_key = k.item_key)
SELECT item_key, pdf_path, title, authors, year, already_parsed FROM r WHERE rn = 1"""
)
def library_candidates(spark, sf_dir):
    """Orders stand for items, their lines for attachments and notes."""
    o = _read(spark, sf_dir, "orders").selectExpr("o_orderkey AS ord", "concat('K', o_orderkey) AS item_key", "concat('Order ', o_orderkey) AS title", "date_format(o_orderdate, 'yyyy-MM-dd') AS date", "CASE WHEN o_custkey % 2 = 0 THEN array(concat('Name', o_custkey % 10), '') ELSE array(concat('Name', o_custkey % 10), 'Other') END AS creators")
    kids = _read(spark, sf_dir, "lineitem").selectExpr(
        "concat('K', l_orderkey) AS item_key",
        "l_linenumber AS ord",
        "CASE WHEN l_linenumber % 3 = 2 THEN 'note' ELSE 'attachment' END AS item_type",
        "CASE WHEN l_linenumber % 3 = 1 THEN 'application/pdf' ELSE 'text/html' END AS content_type",
        "CASE WHEN l_linenumber % 3 = 2 AND l_partkey % 5 = 0 THEN 'x parsed-md: y' ELSE 'z' END AS note",
        "concat('file:///C:/lib%20dir/', l_partkey % 97, '_', l_suppkey % 13, '.pdf') AS file_url",
    )
    return N.library_candidates(o, kids)


@query(
    r"""SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN CAST(y AS INT) WHEN 1 THEN CAST(y + 1 AS INT) WHEN 2 THEN CAST(y AS INT) END AS year
FROM (SELECT o_orderkey, year(o_orderdate) AS y FROM orders)"""
)
def recovered_years(spark, sf_dir):
    o = _read(spark, sf_dir, "orders").selectExpr("o_orderkey", "year(o_orderdate) AS y")
    o = o.selectExpr("o_orderkey", "CASE o_orderkey % 4 WHEN 0 THEN cast(y AS string) WHEN 1 THEN concat('in ', y, ' or ', y + 1) WHEN 3 THEN '17' END AS value", "CASE WHEN o_orderkey % 4 = 2 THEN concat('Data, 2001 - ', y) ELSE 'none' END AS info")
    return o.select("o_orderkey", S.recovered_year("value", "info").alias("year"))


@query("SELECT c_custkey, concat('<pre>', 'parsed-md:', c_custkey, chr(10), replace(replace(replace(concat('<', c_name, '> & ', chr(39), c_mktsegment, chr(39)), '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '</pre>') AS note FROM customer".replace("replace(replace(replace(", "replace(replace(replace(replace(").replace("'>', '&gt;')", "'>', '&gt;'), chr(39), '&#x27;')"))
def note_payloads(spark, sf_dir):
    c = _read(spark, sf_dir, "customer").selectExpr("c_custkey", "concat('parsed-md:', c_custkey) AS marker", "concat('<', c_name, '> & ', chr(39), c_mktsegment, chr(39)) AS t")
    return c.select("c_custkey", S.note_html("marker", "t").alias("note"))


@query("SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN 'image/jpeg' WHEN 1 THEN 'image/png' WHEN 2 THEN 'image/gif' WHEN 3 THEN 'image/webp' ELSE 'image/png' END AS mime FROM part")
def mime_types(spark, sf_dir):
    heads = "CASE p_partkey % 5 WHEN 0 THEN X'FFD8FFE000' WHEN 1 THEN X'89504E470D' WHEN 2 THEN X'474946383961' WHEN 3 THEN X'52494646000000005745425000' ELSE X'00' END"
    return _read(spark, sf_dir, "part").selectExpr("p_partkey", f"{heads} AS b").select("p_partkey", S.mime_type("b").alias("mime"))


@query("SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'pdf' WHEN 1 THEN 'docx' WHEN 2 THEN 'md' ELSE 'unknown' END AS format FROM part")
def document_formats(spark, sf_dir):
    p = _read(spark, sf_dir, "part").selectExpr("p_partkey", "concat('/a.b/', p_partkey, CASE p_partkey % 4 WHEN 0 THEN '.PDF' WHEN 1 THEN '.docx' WHEN 2 THEN '.Txt' ELSE '' END) AS path")
    return p.select("p_partkey", S.document_format("path").alias("format"))
