"""A ledger of paid calls: each request is called once, whoever reads its reply and however often.

A request is known by what it asks: the SHA-256 of provider, model and all parts of the prompt. Its
reply is a row of the ledger, a Parquet table in a folder that all executors reach. ``ask`` makes
the calls that the ledger lacks (an anti join on the digest, one call for equal requests) and only
then returns; readers and actions after that read rows. While a task calls, each reply is put into
a journal file named by the digest as soon as it is there, so a task that is run again, or a run
that was ended and is started again, finds the replies of the first try and pays for none twice.
When the calls of an ``ask`` are written to the table their journal files are deleted.

A call that fails is a row with an error in this ``ask`` and is no entry of the ledger: the next
``ask`` tries it again. One ``ask`` at a time writes to a ledger: two that run at once may pay for the
same request twice. Two copies of one task at the same time (speculation) may both make a call
that is in neither journal nor ledger; leave ``spark.speculation`` off where calls cost money.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType

from ..session import dropped, exists, kept, reachable, work_folder
from .providers import ProviderError, retried

ROWS = "call string, provider string, model string, reply string, latency_s double"


def digest(provider, model, *parts, lists: tuple = ()) -> Column:
    """The SHA-256 that names a request: each part with its length in bytes, so that no two requests run together; null is no empty part. ``lists`` names parts that are arrays."""

    def part(c):
        c = F.col(c) if isinstance(c, str) else c
        raw = c.cast("binary")
        return F.when(c.isNull(), F.lit("-").cast("binary")).otherwise(F.concat(F.octet_length(raw).cast("string").cast("binary"), F.lit(":").cast("binary"), raw))

    def parts_of(name):
        if name not in lists:
            return part(name)
        return F.concat(F.size(name).cast("string").cast("binary"), F.lit("#").cast("binary"), F.aggregate(F.transform(name, part), F.lit("").cast("binary"), lambda a, x: F.concat(a, x)))

    return F.sha2(F.concat(part(provider), part(model), *map(parts_of, parts)), 256)


class Ledger:
    """Replies to requests under ``root``, a URI; without one it lasts as long as the application."""

    def __init__(self, spark: SparkSession, root: str | None = None):
        self.spark = spark
        self.root = (root or f"{work_folder(spark)}/calls").rstrip("/")

    def replies(self) -> DataFrame:
        """(call, provider, model, reply, latency_s): one row for each request that has been answered."""
        path = f"{self.root}/replies"
        return self.spark.read.schema(ROWS).parquet(path) if exists(self.spark, path) else self.spark.createDataFrame([], ROWS)

    def ask(self, asked: DataFrame, keys: list, parts: list, call: Callable[[str, str, dict], str], attempts: int = 3, wait: float = 1.0) -> DataFrame:
        """(keys, reply, error, latency_s) of rows with keys, provider, model and ``parts`` (strings, binary or arrays of such).

        ``call(provider, model, parts)`` returns the reply as text; an exception is tried again, at
        most ``attempts`` times in all, and then is the row's error. Rows without a request (all
        parts null) have null reply and error. latency_s is the time that the request's calls took,
        waits included, also where the reply came from the ledger.
        """
        lists = tuple(p for p in parts if isinstance(asked.schema[p].dataType, ArrayType))
        rows = kept(asked.select(*keys, "provider", "model", *parts, digest("provider", "model", *parts, lists=lists).alias("call")), "asked")
        some = reduce(or_, (F.col(p).isNotNull() for p in parts))
        wanted = rows.where(some).groupBy("call").agg(*(F.first(c).alias(c) for c in ("provider", "model", *parts)))
        new = wanted.join(self.replies().select("call"), "call", "left_anti")
        made = self._called(new.select("call", "provider", "model", *parts), parts, call, attempts, wait)
        fresh = kept(made, "calls")
        fresh.where("error is null").select("call", "provider", "model", "reply", "latency_s").write.mode("append").parquet(f"{self.root}/replies")
        self._settled(fresh.where("error is null").select("call"))
        own = kept(rows.select(*keys, "call"), "keys")
        failed = kept(fresh.where("error is not null").select("call", "error", "latency_s"), "failed")
        dropped(rows, fresh)
        known = self.replies().select("call", "reply", F.lit(None).cast("string").alias("error"), "latency_s")
        known = known.union(failed.select("call", F.lit(None).cast("string"), "error", "latency_s"))
        return own.join(known, "call", "left").select(*keys, "reply", "error", "latency_s")

    def _settled(self, calls: DataFrame) -> None:
        """Delete the journal files of calls that are in the table; those of a run that ended before stay until their request is asked again."""
        journal = f"{self.root}/journal"

        def run(rows):
            from pyarrow import fs

            store, base = fs.FileSystem.from_uri(journal)
            for r in rows:
                entry = f"{base}/{r['call'][:2]}/{r['call']}.json"
                if store.get_file_info(entry).type == fs.FileType.File:
                    store.delete_file(entry)

        calls.foreachPartition(run)

    def _called(self, requests: DataFrame, parts: list, call, attempts: int, wait: float) -> DataFrame:
        journal = f"{self.root}/journal"

        def run(batches):
            import pyarrow as pa
            from pyarrow import fs

            store, base = fs.FileSystem.from_uri(journal)
            ask = retried(attempts, wait)(call)
            for batch in batches:
                out = []
                for name, provider, model, *values in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    entry = f"{base}/{name[:2]}/{name}.json"
                    if store.get_file_info(entry).type == fs.FileType.File:
                        with store.open_input_stream(entry) as f:
                            old = json.loads(f.readall())
                        out.append((name, provider, model, old["reply"], None, old["latency_s"]))
                        continue
                    began, reply, error = time.monotonic(), None, None
                    try:
                        reply = ask(provider, model, dict(zip(parts, values, strict=True)))
                    except ProviderError as e:
                        error = str(e)
                    took = round(time.monotonic() - began, 2)
                    if error is None:
                        store.create_dir(f"{base}/{name[:2]}", recursive=True)
                        part = f"{entry}.{uuid.uuid4().hex}.part"
                        with store.open_output_stream(part) as f:
                            f.write(json.dumps({"reply": reply, "latency_s": took}).encode())
                        store.move(part, entry)
                    out.append((name, provider, model, reply, error, took))
                if out:
                    kinds = [pa.string()] * 5 + [pa.float64()]
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names=["call", "provider", "model", "reply", "error", "latency_s"])

        reachable(self.spark)
        return requests.mapInArrow(run, "call string, provider string, model string, reply string, error string, latency_s double")
