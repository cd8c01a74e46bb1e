"""The composite runs: standard parsing, genre-aware pipeline, article vault, free-form files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.pytext import lines, sub
from ..functions.strings import article_slug, file_slug
from . import article, book, chunks, genres, names, plan, render
from . import lines as L


def parse_standard(docs: DataFrame, headings: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """(sections, chunks) of noise-filtered texts; ``headings`` is a plan over the same line numbers."""
    clean = docs.select(id_col, F.array_join(L.without_noise(F.coalesce(text_col, F.lit(""))), "\n").alias(text_col))
    totals = clean.select(id_col, F.size(lines(text_col)).alias("n_lines"))
    full = plan.heading_paths(plan.gaps_filled(headings, totals, id_col), id_col)
    rows = plan.with_sections(clean, full, id_col, text_col, 3, "_sections")
    return _exploded(rows, id_col), chunks.chunked(rows, "_sections", id_col, text_col)


def structured(docs: DataFrame, plans: DataFrame, id_col: str = "doc_id", text_col: str = "text", window=300, overlap=50) -> tuple[DataFrame, DataFrame]:
    """(sections, chunks) by a section plan, gaps filled; heading paths are section id and label."""
    keep = ()
    if isinstance(window, Column):  # sizes by row travel with the rows
        docs, keep = docs.withColumns({"_size": window, "_shared": overlap}), ("_size", "_shared")
        window, overlap = F.col("_size"), F.col("_shared")
    rows = plan.with_sections(docs, plans, id_col, text_col, out="_sections", keep=keep, gaps=True)
    paths = F.transform("_sections", lambda s: s.withField("heading_path", F.array(s["section_id"], s["label"])))
    rows = rows.withColumn("_sections", paths)
    return _exploded(rows, id_col), chunks.chunked(rows, "_sections", id_col, text_col, window, overlap)


def _exploded(rows: DataFrame, id_col: str) -> DataFrame:
    return rows.select(id_col, F.explode("_sections").alias("_s")).select(id_col, "_s.*")


def genre_pipeline(docs: DataFrame, profiles: DataFrame, plans: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> dict[str, DataFrame]:
    """genres, sections and chunks of documents, and files of books.

    ``docs`` has id, text, filename; ``profiles`` id and doc_type. Books are split by rule and not
    chunked; other genres are cut by their plan and chunked with the genre's window.
    """
    routed = docs.join(profiles.select(id_col, "doc_type"), id_col, "left").withColumn("genre", genres.routed("doc_type", text_col))
    out = {"genres": routed.select(id_col, "genre"), "files": book.book_files(routed.where("genre = 'book'"), id_col, text_col)}
    per = lambda size: F.coalesce(*(F.when(F.col("genre") == g.id, size(g)) for g in map(genres.genre, genres.available_genres())))
    laid = [g for g in genres.available_genres() if genres.genre(g).layout != "book"]
    own = routed.where(F.col("genre").isin(laid))
    secs, chks = structured(own, plans.join(own.select(id_col), id_col, "left_semi"), id_col, text_col, per(lambda g: g.window), per(lambda g: g.overlap))
    return out | {"sections": secs, "chunks": chks}


def article_vault(docs: DataFrame, metadata: DataFrame, done: DataFrame | None = None, content_source: str = "") -> tuple[DataFrame, DataFrame]:
    """(files, results) of articles not yet done.

    ``docs`` has doc_id, source, text, error; ``metadata`` doc_id, title, authors, year, journal,
    doi. A document with an error gives a result row with it and no files.
    """
    todo = docs if done is None else names.pending(docs, done)
    d = todo.join(metadata, "doc_id", "left")
    title = F.coalesce(F.nullif("title", F.lit("")), sub("source", r"\.[^.]*$"))
    d = d.withColumns({"title": title, "authors": F.coalesce("authors", F.array().cast("array<string>")), "content_source": F.lit(content_source), "publication_info": F.lit(""), "cited_by": F.lit(None).cast("int")})
    d = d.withColumn("slug", article_slug("authors", "year", "title"))
    ok = d.where("error is null")
    parts = article.split_article(ok)
    flags = parts.select("doc_id", (F.col("abstract") != "").alias("has_abstract"), (F.col("references") != "").alias("has_references"))
    results = d.join(flags, "doc_id", "left").select("source", F.when(F.col("error").isNull(), F.col("slug")).alias("slug"), F.when(F.col("error").isNull(), F.col("slug")).alias("folder"), "title", "authors", "year", "has_abstract", "has_references", "error")
    return render.article_files(ok), results


def section_files(docs: DataFrame, sections: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(id, rel_path, content): one numbered file per section, as statutes are laid out."""
    safe = F.substring(file_slug("section_id"), 1, 60)
    name = F.concat(F.format_string("%02d_", F.col("section_ord")), safe, F.lit(".md"))
    label = F.coalesce(F.nullif("label", F.lit("")), F.col("section_id"))
    return sections.join(docs.select(id_col), id_col, "left_semi").select(id_col, name.alias("rel_path"), F.concat(F.lit("# "), label, F.lit("\n\n"), F.col("content"), F.lit("\n")).alias("content"))


def freeform(docs: DataFrame, folder: str = "out") -> DataFrame:
    """(source, rel_path, content, error): one Markdown file per document under a free name."""
    d = docs.withColumns({"_stem": sub(F.element_at(F.split("source", "/"), -1), r"(?<=.)\.[^.]*$"), "_folder": F.lit(folder)})
    named = names.unique_names(d.select("source", "text", "error", "_stem", "_folder"), "_stem", "source", "_folder")
    return named.select("source", F.concat("name", F.lit(".md")).alias("rel_path"), F.col("text").alias("content"), "error")
