"""Markdown files from documents, sections and metadata."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.pytext import col, rstrip
from ..functions.strings import apa_citation, language_label, language_slug, yaml_list, yaml_string
from .article import split_article


def _text(c) -> Column:
    return F.coalesce(col(c), F.lit(""))


def _year(year) -> Column:
    return F.coalesce(col(year).cast("string"), F.lit("null"))


def main_markdown(slug, title, authors, year, journal, doi, source, text) -> Column:
    """Seven front matter keys, a blank line and the whole text."""
    head = [("title", yaml_string(_text(title))), ("authors", yaml_list(authors)), ("year", _year(year)), ("journal", yaml_string(_text(journal))), ("doi", yaml_string(_text(doi))), ("slug", yaml_string(_text(slug))), ("source_pdf", yaml_string(_text(source)))]
    return F.concat(F.lit("---\n"), *(F.concat(F.lit(f"{k}: "), v, F.lit("\n")) for k, v in head), F.lit("---\n\n"), _text(text))


def bibliographic_markdown(slug, title, authors, year, journal, doi, source, content_source, publication_info, cited_by) -> Column:
    """Ten front matter keys and the citation."""
    head = [
        ("title", yaml_string(_text(title))), ("authors", yaml_list(authors)), ("year", _year(year)), ("journal", yaml_string(_text(journal))), ("doi", yaml_string(_text(doi))), ("slug", yaml_string(_text(slug))),
        ("source_pdf", yaml_string(_text(source))), ("content_source", yaml_string(_text(content_source))), ("publication_info", yaml_string(_text(publication_info))), ("cited_by", F.coalesce(col(cited_by).cast("string"), F.lit("null"))),
    ]
    return F.concat(F.lit("---\n"), *(F.concat(F.lit(f"{k}: "), v, F.lit("\n")) for k, v in head), F.lit("---\n## Citation\n\n"), apa_citation(authors, year, title, journal, doi), F.lit("\n"))


def article_files(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, rel_path, content): the five files of an article; the folder is the slug.

    ``docs`` also has slug, title, authors, year, journal, doi, source, content_source,
    publication_info and cited_by.
    """
    parts = split_article(docs, id_col, text_col)
    d = docs.join(parts.select(id_col, "abstract", "body", "references"), id_col)
    closed = lambda c: F.when(F.col(c) == "", "").otherwise(F.concat(F.col(c), F.lit("\n")))
    files = [
        (F.concat("slug", F.lit(".md")), main_markdown("slug", "title", "authors", "year", "journal", "doi", "source", text_col)),
        (F.lit("abstract.md"), closed("abstract")),
        (F.lit("body.md"), closed("body")),
        (F.lit("references.md"), closed("references")),
        (F.lit("bibliographic.md"), bibliographic_markdown("slug", "title", "authors", "year", "journal", "doi", "source", "content_source", "publication_info", "cited_by")),
    ]
    rows = F.array(*(F.struct(F.concat("slug", F.lit("/"), p).alias("rel_path"), c.alias("content")) for p, c in files))
    return d.select(id_col, F.explode(rows).alias("f")).select(id_col, "f.rel_path", "f.content")


def _section_blocks(sections: DataFrame, key: str, tagged: bool) -> DataFrame:
    label = F.coalesce(F.nullif("label", F.lit("")), F.col("section_id"))
    tag = F.when(F.col("language").isin("both", "unknown", ""), "").otherwise(F.concat(F.lit(" ["), language_label("language"), F.lit("]"))) if tagged else F.lit("")
    block = F.concat(F.repeat(F.lit("#"), F.col("level").cast("int")), F.lit(" "), label, tag, F.lit("\n\n"), F.col("content"), F.lit("\n\n---\n\n"))
    rows = sections.select(key, "section_ord", block.alias("b"))
    return rows.groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("section_ord", "b"))), lambda x: x["b"]), "").alias("blocks"))


def combined_markdown(profiles: DataFrame, sections: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, content): all sections under a profile header, headings tagged with their language.

    ``profiles`` has key, doc_type, languages (array), structure_pattern, parsed_at.
    """
    d = profiles.join(_section_blocks(sections, key, True), key, "left")
    head = F.concat(F.lit("---\ndocument_id: "), F.col(key).cast("string"), F.lit("\ndoc_type: "), F.col("doc_type"), F.lit("\nlanguages: "), F.array_join("languages", ", "), F.lit("\nstructure_pattern: "), F.col("structure_pattern"), F.lit("\nparsed_at: "), F.col("parsed_at"), F.lit("\n---\n\n"))
    return d.select(key, F.concat(rstrip(F.concat(head, F.coalesce("blocks", F.lit("")))), F.lit("\n")).alias("content"))


def language_markdown(profiles: DataFrame, sections: DataFrame, language: str, key: str = "doc_id") -> DataFrame:
    """(key, content): the sections in one language, and those in both or unknown; "" without any."""
    own = sections.where((language_slug("language") == language_slug(F.lit(language))) | F.col("language").isin("both", "unknown"))
    d = profiles.join(_section_blocks(own, key, False), key, "left")
    head = F.concat(F.lit("---\ndocument_id: "), F.col(key).cast("string"), F.lit(f"\nlanguage: {language}\nparsed_at: "), F.col("parsed_at"), F.lit("\n---\n\n"))
    return d.select(key, F.when(F.col("blocks").isNull(), "").otherwise(F.concat(rstrip(F.concat(head, F.col("blocks"))), F.lit("\n"))).alias("content"))


def detected_languages(sections: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, slugs): language slugs in order of first section."""
    own = sections.where(~F.col("language").isin("both", "unknown", ""))
    return own.groupBy(key).agg(F.array_distinct(F.transform(F.array_sort(F.collect_list(F.struct("section_ord", language_slug("language").alias("l")))), lambda x: x["l"])).alias("slugs"))
