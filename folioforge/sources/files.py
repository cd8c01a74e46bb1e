"""Documents from folders: listing, text, Word files and page images."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.pytext import sub
from ..functions.strings import document_format
from ..operators.lines import PAGE_BREAK, gathered
from ..session import reachable
from .providers import OcrProvider, ocr_pages

#: Suffixes that are taken.
SUFFIXES = [".pdf", ".docx", ".md", ".txt", ".png", ".jpg", ".jpeg", ".webp", ".gif"]


def listed(spark: SparkSession, path: str, recursive: bool = False, with_content: bool = True) -> DataFrame:
    """(path, filename, format, size, content) of the files under ``path`` with a known suffix.

    ``path`` may be one file. The suffix is compared without case. The content column is read only
    if used; a listing without it is sorted by path. Empty files give no row.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).load(path)
    suffix = F.lower(F.regexp_extract("path", r"(\.[^./]+)$", 1))
    rows = files.where(suffix.isin(SUFFIXES)).select("path", F.element_at(F.split("path", "/"), -1).alias("filename"), document_format("path").alias("format"), F.col("length").alias("size"), *(["content"] if with_content else []))
    return rows if with_content else rows.orderBy("path")


def first_files(files: DataFrame, most: int = 100) -> DataFrame:
    """The first ``most`` files by path: the limit of one run is the feature."""
    return files.orderBy("path").limit(most)


def docx_markdown(content: bytes) -> str:
    """Paragraphs and tables of a Word file in order, headings as Markdown."""
    import io
    import zipfile
    from xml.etree import ElementTree

    w = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        body = ElementTree.fromstring(z.read("word/document.xml")).find(f"{w}body")
        styles = {}
        if "word/styles.xml" in z.namelist():
            for s in ElementTree.fromstring(z.read("word/styles.xml")).iter(f"{w}style"):
                name = s.find(f"{w}name")
                styles[s.get(f"{w}styleId")] = name.get(f"{w}val") if name is not None else ""

    def text(p) -> str:
        parts = {f"{w}t": lambda e: e.text or "", f"{w}tab": lambda e: "\t", f"{w}br": lambda e: "\n", f"{w}cr": lambda e: "\n"}
        return "".join(parts[e.tag](e) for e in p.iter() if e.tag in parts).strip()

    out: list[str] = []
    for block in body if body is not None else []:
        if block.tag == f"{w}p":
            t, style = text(block), block.find(f"{w}pPr/{w}pStyle")
            name = (styles.get(style.get(f"{w}val"), style.get(f"{w}val")) if style is not None else "").lower()
            level = next((k for k in range(1, 7) if f"heading {k}" in name or f"heading{k}" in name), 0)
            out.append(f"{'#' * min(level, 4)} {t}" if t and level else t)
        elif block.tag == f"{w}tbl":
            rows = [[" ".join("\n".join(text(p) for p in c.iter(f"{w}p")).strip().split("\n")) for c in r.findall(f"{w}tc")] for r in block.findall(f"{w}tr")]
            lines = [" | ".join(r) for r in rows]
            if lines:
                out += ["", lines[0], " | ".join("---" for _ in rows[0]), *lines[1:], ""]
    return "\n".join(out)


def documents(files: DataFrame, ocr: OcrProvider | None = None) -> DataFrame:
    """(path, filename, format, text, error) of files from ``listed``.

    Text and Markdown are decoded (a byte order mark is dropped), Word files read, PDF files and
    images go through the OCR provider with pages joined in order. Without a provider, and for
    other formats, the row has an error. A file that fails spares the others.
    """

    def word(batches):
        import pyarrow as pa

        for batch in batches:
            texts, errors = [], []
            for content in batch.column(3).to_pylist():
                try:
                    texts.append(docx_markdown(content))
                    errors.append(None)
                except Exception as e:  # noqa: BLE001 - reported in the row
                    texts.append(None)
                    errors.append(str(e) or repr(e))
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(texts, pa.string()), pa.array(errors, pa.string())], names=["path", "filename", "format", "text", "error"])

    reachable(files.sparkSession)
    no_error = F.lit(None).cast("string").alias("error")
    plain = files.where("format = 'md'").select("path", "filename", "format", sub(F.decode("content", "UTF-8"), r"^\x{feff}").alias("text"), no_error)
    docx = files.where("format = 'docx'").select("path", "filename", "format", "content").mapInArrow(word, "path string, filename string, format string, text string, error string")
    scans = files.where("format in ('pdf', 'image')")
    if ocr is None:
        read = scans.select("path", "filename", "format", F.lit(None).cast("string").alias("text"), F.lit("no OCR provider").alias("error"))
    else:
        pages = ocr_pages(scans, ocr)
        failed = pages.where("error is not null").select("path", "error")
        full = gathered(pages.where("error is null and trim(text) <> ''"), ["path"], "page_no", "text", PAGE_BREAK)
        read = scans.select("path", "filename", "format").join(full, "path", "left").join(failed, "path", "left").select("path", "filename", "format", F.when(F.col("error").isNull(), F.coalesce("text", F.lit(""))).alias("text"), "error")
    other = files.where("format = 'unknown'").select("path", "filename", "format", F.lit(None).cast("string").alias("text"), F.lit("unsupported file type").alias("error"))
    return plain.union(docx).union(read).union(other)


def library_json(spark: SparkSession, items_path: str, children_path: str) -> tuple[DataFrame, DataFrame]:
    """(items, children) for ``library_candidates`` from JSON pages of a reference manager."""
    item = spark.read.schema("ord long, key string, data struct<title:string,date:string,creators:array<struct<lastName:string>>>").json(items_path)
    kid = spark.read.schema("ord long, parent string, key string, url string, data struct<itemType:string,contentType:string,note:string>").json(children_path)
    items = item.select("ord", F.col("key").alias("item_key"), F.coalesce("data.title", F.lit("")).alias("title"), F.coalesce("data.date", F.lit("")).alias("date"), F.coalesce("data.creators.lastName", F.array().cast("array<string>")).alias("creators"))
    return items, kid.select(F.col("parent").alias("item_key"), "ord", F.col("data.itemType").alias("item_type"), F.col("data.contentType").alias("content_type"), F.coalesce("data.note", F.lit("")).alias("note"), F.coalesce("url", F.lit("")).alias("file_url"))


def library_collections(spark: SparkSession, path: str) -> DataFrame:
    """(key, name) of the collections in JSON pages of a reference manager, by name without case."""
    c = spark.read.schema("key string, data struct<name:string>").json(path)
    return c.select("key", F.coalesce("data.name", F.lit("")).alias("name")).orderBy(F.lower("name"), "key")


def find_collection(collections: DataFrame, name: str) -> DataFrame:
    """The collection of a name, compared without case; no row if there is none."""
    return collections.where(F.lower("name") == name.strip().lower()).orderBy("key").limit(1)


def paged(spark: SparkSession, template: str, schema: str, limit: int = 100, rows: str = "results", total: str = "total", tasks: int = 64) -> DataFrame:
    """All rows of a JSON interface that answers by pages, read in parallel; see ``paged``."""
    from .vault import registered

    options = {"path": template, "limit": limit, "rows": rows, "total": total, "tasks": tasks}
    return registered(spark).read.format("paged_json").schema(schema).options(**options).load()
