"""Documents as rows of lines, noise lines, prompt leaks and pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.pytext import any_of, col, lines, strip, sub

#: Whole lines that are publisher or page furniture.
NOISE = [
    r"DOI:?\s*10\.\d{4,}/\S+",
    r"doi:\s*10\.\d{4,}/\S+",
    r"ISSN[:.]?\s*\S+",
    r"e-ISSN[:.]?\s*\S+",
    r"COPYRIGHT\s*©\s*\d{4}.*",
    r"©\s*\d{4}.*",
    r"PUBLISHED\s+\d{1,2}\s+\w+\s+\d{4}",
    r"RECEIVED\s+\d{1,2}\s+\w+\s+\d{4}",
    r"ACCEPTED\s+\d{1,2}\s+\w+\s+\d{4}",
    r"EDITED BY\s+.+",
    r"REVIEWED BY\s+.+",
    r"\*?CORRESPONDENCE\s+.+",
    r"Check for updates",
    r"OPEN ACCESS",
    r"Working\s*\|\s*paper",
    r"This project has received funding from .+",
    r"Volume\s+\d+,\s*No\.\s*\d+.*\(\d+-\d+\)",
    r"Issue\s+\d+/\d+\s*[•·]\s*\w+\s+\d{4}",
    r"www\.\S+\.\S+",
    r"[\w.-]+\.(?:com|org|edu|net)",
    r"---\s*Page\s+\d+\s*---",
    r"Page\s+\d+",
    r"p\.\s*\d+",
    r"\d{1,4}",
    r"International Development Research Centre",
    r"IDRC",
    r"Project Completion Report",
    r"Page\s+\d+\s+of\s+\d+",
    r"\d+\s*/\s*\d+",
    r"Confidential",
    r"Draft",
]
#: Lower-case texts that betray an echoed prompt.
LEAKS = [
    "you transcribe document page images into markdown",
    "emit one block per page image",
    "you are a large language model built by cohere",
    "contextual safety mode",
    "system preamble",
    "default preamble",
    "developer preamble",
]
PAGE_BREAK = "\n\n---\n\n"


def is_noise(line, extra: tuple = ()) -> Column:
    """Whether the trimmed line is furniture as a whole; blank lines never are."""
    s = strip(line)
    return (s != "") & s.rlike(any_of([rf"^(?:{p})$" for p in [*NOISE, *extra]]))


def without_noise(text, extra: tuple = ()) -> Column:
    """The lines of a text with furniture blanked, so line numbers stay."""
    return F.transform(lines(text), lambda x: F.when(is_noise(x, extra), "").otherwise(x))


def numbered(text_lines) -> Column:
    """One string of "1: first line" and so on."""
    return F.array_join(F.transform(text_lines, lambda x, i: F.concat((i + 1).cast("string"), F.lit(": "), x)), "\n")


def exploded(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, line_no from 1, line). Narrow: no shuffle; a text without lines gives no rows."""
    return df.select(id_col, F.posexplode(lines(F.coalesce(F.col(text_col), F.lit("")))).alias("p", "line")).select(id_col, (F.col("p") + 1).cast("long").alias("line_no"), "line")


def gathered(rows: DataFrame, key: list, order, value, sep: str = "\n", name: str = "text") -> DataFrame:
    """One string per key from ordered rows."""
    items = F.array_sort(F.collect_list(F.struct(order, F.col(value).alias("_v") if isinstance(value, str) else value.alias("_v"))))
    return rows.groupBy(*key).agg(F.array_join(F.transform(items, lambda x: x["_v"]), sep).alias(name))


def without_leaks(text) -> Column:
    """Page blocks (parted by lines of dashes), each cut at the first line with an echoed prompt."""
    blocks = F.split(col(text), r"(?m)^-{3,}[^\S\n]*$", -1)

    def cut(block):
        ls = lines(block)

        def leaky(x):
            probe = F.lower(strip(sub(strip(x), "^#+")))
            found = F.lit(False)
            for s in LEAKS:
                found = found | probe.contains(s)
            return found

        flags = F.transform(ls, leaky)
        at = F.array_position(flags, F.lit(True))
        return strip(F.array_join(F.when(at > 0, F.slice(ls, F.lit(1), (at - 1).cast("int"))).otherwise(ls), "\n"))

    return F.array_join(F.filter(F.transform(blocks, cut), lambda b: b != ""), PAGE_BREAK)


def joined_pages(pages: DataFrame, key: str, page_no: str, content: str) -> DataFrame:
    """(key, text): non-blank pages in order, parted by the page break."""
    full = pages.where(strip(F.col(content)) != "")
    return gathered(full, [key], page_no, content, PAGE_BREAK)


def page_count(text) -> Column:
    return F.size(F.split(col(text), PAGE_BREAK, -1))


def page_batches(sizes, most_images: int = 20, most_bytes: int = 18 << 20) -> Column:
    """Batch number of each page, greedily, from page sizes in bytes (base64 adds a third)."""

    def step(acc, size):
        size = F.floor(size * 4 / 3).cast("long")
        full = (acc["n"] >= most_images) | ((acc["n"] > 0) & (acc["bytes"] + size > most_bytes))
        batch = F.when(full, acc["batch"] + 1).otherwise(acc["batch"])
        return F.struct(
            batch.cast("int").alias("batch"),
            F.when(full, 1).otherwise(acc["n"] + 1).cast("int").alias("n"),
            F.when(full, size).otherwise(acc["bytes"] + size).cast("long").alias("bytes"),
            F.concat(acc["out"], F.array(batch.cast("int"))).alias("out"),
        )

    start = F.struct(F.lit(0).alias("batch"), F.lit(0).alias("n"), F.lit(0).cast("long").alias("bytes"), F.array().cast("array<int>").alias("out"))
    return F.aggregate(col(sizes), start, step, lambda acc: acc["out"])
