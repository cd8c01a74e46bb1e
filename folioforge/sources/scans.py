"""Page images: rendered, batched, transcribed, cleaned of echoed prompts and joined in order.

Pages are rows, so the pages of one long document are spread over tasks; a batch is bounded in
images and bytes. Rendering and transcription are interfaces; their stand-ins read form-feed parted
bytes as pages.
"""

from __future__ import annotations

from abc import ABC, abstractmethod

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.pytext import strip
from ..operators.lines import PAGE_BREAK, gathered, page_batches, without_leaks
from ..session import dropped, kept, reachable
from .ledger import Ledger
from .prompts import TRANSCRIBE
from .providers import ProviderError, named_class, retried


class PageRenderer(ABC):
    @abstractmethod
    def render(self, filename: str, content: bytes) -> list[bytes]:
        """An image of each page; an image file is its own page."""


class VisionProvider(ABC):
    @abstractmethod
    def transcribe(self, images: list[bytes], prompt: str) -> str:
        """Markdown of some page images, pages parted by a line of dashes."""


class FormFeedPages(PageRenderer):
    """Deterministic stand-in: pages are the form-feed parted parts."""

    def render(self, filename: str, content: bytes) -> list[bytes]:
        return content.split(b"\f") if content else []


class EchoVision(VisionProvider):
    """Deterministic stand-in: an image is its text."""

    def transcribe(self, images: list[bytes], prompt: str) -> str:
        return "\n\n---\n\n".join(x.decode("utf-8", "replace") for x in images)


def with_bytes(sources: DataFrame, fetch=None, attempts: int = 1) -> DataFrame:
    """(path, filename, content, error): content as given, else what ``fetch(url)`` returns.

    ``sources`` has path, filename, url, content. A source with neither, or whose fetch fails, has
    an error; without ``fetch`` no URL is read.
    """

    def run(batches):
        import pyarrow as pa

        get = retried(attempts, 0)(fetch) if fetch else None
        for batch in batches:
            found, errors = [], []
            for url, content in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                error = None
                if content is None and url and get:
                    try:
                        content = get(url)
                    except ProviderError as e:
                        error = f"could not fetch {url}: {e}"
                elif content is None:
                    error = "neither content nor a URL that can be read"
                found.append(content)
                errors.append(error)
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(found, pa.binary()), pa.array(errors, pa.string())], names=["path", "filename", "content", "error"])

    reachable(sources.sparkSession)
    return sources.select("path", "filename", "url", "content").mapInArrow(run, "path string, filename string, content binary, error string")


def page_images(files: DataFrame, renderer: PageRenderer) -> DataFrame:
    """(path, page_no from 1, image, error) of (path, filename, content); a file without pages has an error."""

    def run(batches):
        import pyarrow as pa

        schema = pa.schema([("path", pa.string()), ("page_no", pa.int32()), ("image", pa.binary()), ("error", pa.string())])
        for batch in batches:
            for path, name, content in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                try:
                    pages = renderer.render(name, content or b"")
                    error = None if pages else f"no pages rendered from {name!r}"
                except Exception as e:  # noqa: BLE001 - reported in the row
                    pages, error = [], str(e) or repr(e)
                rows = [(path, k, x, None) for k, x in enumerate(pages, 1)] or [(path, 1, None, error)]
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    reachable(files.sparkSession)
    return files.select("path", "filename", "content").mapInArrow(run, "path string, page_no int, image binary, error string")


def batched(pages: DataFrame, pages_per_call: int = 4, most_images: int = 20, most_bytes: int = 18 << 20) -> DataFrame:
    """Adds (part, batch): runs of ``pages_per_call`` pages, each cut greedily at the limits of a call."""
    part = F.floor((F.col("page_no") - 1) / max(1, min(pages_per_call, most_images))).cast("int")
    sized = pages.select("path", part.alias("part"), "page_no", F.octet_length("image").alias("size"))
    lists = sized.groupBy("path", "part").agg(F.array_sort(F.collect_list(F.struct("page_no", "size"))).alias("ps"))
    numbers = page_batches(F.transform("ps", lambda x: x["size"]), most_images, most_bytes)
    flat = lists.withColumn("bs", numbers).select("path", "part", F.explode(F.arrays_zip("ps", "bs")).alias("x"))
    return pages.join(flat.select("path", "part", F.col("x.ps.page_no").alias("page_no"), F.col("x.bs").alias("batch")), ["path", "page_no"])


def transcribed(files: DataFrame, renderer: PageRenderer, vision: VisionProvider, pages_per_call: int = 4, attempts: int = 3, wait: float = 1.0, ledger: Ledger | None = None) -> DataFrame:
    """(path, text, error) of (path, filename, content).

    Blank pages and what follows an echoed prompt on a page go; pages are joined by the page break.
    A document of which a page or a call fails has the error and no text. Files are rendered once
    and batches sent once, when this is called; what it returns only reads rows.
    """

    def call(name, model, parts):
        return vision.transcribe(parts["images"], parts["prompt"])

    ledger = ledger or Ledger(files.sparkSession)
    pages = kept(page_images(files, renderer), "images")
    images = F.transform(F.array_sort(F.collect_list(F.struct("page_no", "image"))), lambda x: x["image"])
    calls = batched(pages.where("error is null"), pages_per_call).groupBy("path", "part", "batch").agg(images.alias("images"))
    prompt = F.concat(F.lit(f"{TRANSCRIBE}\n"), F.size("images").cast("string"), F.lit(" page image(s)"))
    asked = calls.select("path", "part", "batch", F.lit(named_class(vision)).alias("provider"), F.lit(None).cast("string").alias("model"), "images", prompt.alias("prompt"))
    replies = ledger.ask(asked, ["path", "part", "batch"], ["images", "prompt"], call, attempts, wait)
    unread = kept(pages.where("error is not null").select("path", "error"), "unread")
    dropped(pages)
    failed = unread.union(replies.where("error is not null").select("path", "error")).groupBy("path").agg(F.min("error").alias("error"))
    clean = replies.where("error is null").withColumn("text", without_leaks("reply")).where(strip("text") != "")
    full = gathered(clean, ["path"], F.struct("part", "batch"), "text", PAGE_BREAK)
    out = files.select("path").join(full, "path", "left").join(failed, "path", "left")
    return out.select("path", F.when(F.col("error").isNull(), F.coalesce("text", F.lit(""))).alias("text"), "error")
