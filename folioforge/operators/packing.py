"""Greedy packing of pages into calls, for documents of any length.

A call takes pages in order until one more would pass its limits. From the sizes, each page has a
pointer to the page that would start the next call if it started one; only the pointers that lead on
from the first page count. Pages are cut into blocks. Within a block the pointers are doubled, which
gives for each page that may be entered (at most as many as a call takes) where the block is left
and how many calls start in it. Blocks are composed by doubling as well, in joins of neighbours, so
each learns its entry; then it numbers its own pages. No task holds more than a block.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import dropped, kept, reachable
from .names import ranked

#: Pages of a block.
BLOCK = 4096


def _pointers(sizes, own: int, most_images: int, most_bytes: int):
    """For each of the first ``own`` pages the page that would start the next call, as numpy."""
    import numpy as np

    sums = np.concatenate([[0], np.cumsum(sizes)])
    at = np.arange(own)
    fits = np.searchsorted(sums, sums[at] + most_bytes, side="right") - 1
    return np.minimum(np.maximum(fits, at + 1), np.minimum(at + most_images, len(sizes)))


def packed_pages(pages: DataFrame, most_images: int = 20, most_bytes: int = 18 << 20, path: str = "path", page_no: str = "page_no", size: str = "size", block: int = BLOCK) -> DataFrame:
    """(path, page_no, batch): the batch from 0 of each page, greedily by ``page_no``, as ``lines.page_batches`` folds them.

    ``size`` is in bytes, of which base64 makes a third more; null counts as 0. A page over the limit is a
    call of its own. ``page_no`` must differ within a path; a null path is no document.
    """
    if block < most_images:
        raise ValueError("a block must hold the pages of a call")
    reachable(pages.sparkSession)
    encoded = F.floor(F.coalesce(F.col(size), F.lit(0)) * 4 / 3).cast("long")
    own = pages.where(F.col(path).isNotNull()).select(F.col(path).alias("path"), F.col(page_no).alias("page_no"), encoded.alias("size"))
    placed = ranked(own, ["path"], ["page_no"], "at")
    first = F.floor(F.col("at") / block)
    # the first pages of a block are also seen by the one before it
    seen = F.when((F.col("at") % block < most_images) & (F.col("at") >= block), F.array(first, first - 1)).otherwise(F.array(first))
    rows = placed.select("path", F.explode(seen).alias("block"), "at", "page_no", "size")
    lists = rows.groupBy("path", "block").agg(F.array_sort(F.collect_list(F.struct("at", "page_no", "size"))).alias("ps"))
    in_own = F.size(F.filter("ps", lambda p: F.floor(p["at"] / block) == F.col("block")))
    blocks = kept(lists.select("path", "block", in_own.alias("own"), F.transform("ps", lambda p: p["page_no"]).alias("pages"), F.transform("ps", lambda p: p["size"]).alias("sizes")), "blocks")

    def exits(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            out, calls = [], []
            for n, sizes in zip(batch.column(2).to_pylist(), batch.column(3), strict=True):
                to = _pointers(np.asarray(sizes.values), n, most_images, most_bytes)
                # positions n to n + most_images - 1 lie behind the block and point to themselves
                jump = np.concatenate([to, np.arange(n, n + most_images)])
                count = np.concatenate([np.ones(n, np.int64), np.zeros(most_images, np.int64)])
                while (jump[:n] < n).any():
                    count, jump = count + count[jump], jump[jump]
                out.append((jump[: min(n, most_images)] - n).tolist())
                calls.append(count[: min(n, most_images)].tolist())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.list_(pa.int64())), pa.array(calls, pa.list_(pa.int64()))], names=["path", "block", "exits", "calls"])

    kind = own.schema["path"].dataType.simpleString()
    scan = kept(blocks.select("path", "block", "own", "sizes").mapInArrow(exits, f"path {kind}, block long, exits array<long>, calls array<long>"), "scan")
    longest, step = scan.agg(F.max("block")).first()[0] or 0, 1
    while step <= longest:
        before = scan.select("path", (F.col("block") + step).alias("block"), F.col("exits").alias("x"), F.col("calls").alias("c"))
        both = scan.join(before, ["path", "block"], "left")
        nxt = both.select(
            "path",
            "block",
            F.when(F.col("x").isNull(), F.col("exits")).otherwise(F.transform("x", lambda e: F.get("exits", e))).alias("exits"),
            F.when(F.col("x").isNull(), F.col("calls")).otherwise(F.zip_with("x", "c", lambda e, c: c + F.get("calls", e))).alias("calls"),
        )
        nxt = kept(nxt, "scan")
        dropped(scan)
        scan, step = nxt, 2 * step
    entries = scan.select("path", (F.col("block") + 1).alias("block"), F.get("exits", F.lit(0)).alias("entry"), F.get("calls", F.lit(0)).alias("before"))

    def numbered(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            for k in range(batch.num_rows):
                name, _, n, nos, sizes, entry, before = (batch.column(c)[k] for c in range(7))
                n, entry = n.as_py(), entry.as_py() or 0
                to, starts, at = _pointers(np.asarray(sizes.values), n, most_images, most_bytes).tolist(), np.zeros(n, np.int64), entry
                while at < n:
                    starts[at] = 1
                    at = to[at]
                batches_ = np.cumsum(starts) + ((before.as_py() or 0) - 1)
                yield pa.RecordBatch.from_arrays([pa.array([name.as_py()] * n, batch.column(0).type), nos.values[:n], pa.array(batches_.astype(np.int32))], names=["path", "page_no", "batch"])

    number = own.schema["page_no"].dataType.simpleString()
    told = blocks.join(entries, ["path", "block"], "left").select("path", "block", "own", "pages", "sizes", "entry", "before")
    return told.mapInArrow(numbered, f"path {kind}, page_no {number}, batch int").toDF(path, page_no, "batch")
