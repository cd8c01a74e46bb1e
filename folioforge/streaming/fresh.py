"""New sources against a growing table of finished ones: a Bloom filter first, an exact join for the rest.

The filter is a bit map built by Spark's bitmap aggregate: ``HASHES`` bits for each source that is done. A
source with any of its bits unset is certainly new and needs no join; only the others, the finished
ones and a few false alarms, are shuffled to the exact anti join. The bits are cut into pages of
``PAGE`` bits and a page is looked up by a join with a table of at most ``bits`` / ``PAGE`` rows, 4 KB
each, which has a size known beforehand and may be broadcast.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import exists

#: Fixed value: bits of one bit map of the aggregate.
PAGE = 32768
HASHES = 3
#: Most bits: 32 MB of pages.
MOST_BITS = 1 << 28


def bits_for(n: int, per_source: int = 10) -> int:
    """Bits of a filter for ``n`` sources: about 1.7 % false alarms at 10 bits a source, a power of two of at most ``MOST_BITS``.

    Beyond some 27 million sources the filter fills up and lets more through to the exact join; results stay the same.
    """
    return min(MOST_BITS, max(PAGE, 1 << (max(1, n * per_source) - 1).bit_length()))


def _positions(source: Column, bits: int) -> Column:
    """The ``HASHES`` bits of a source."""
    return F.array(*(F.pmod(F.xxhash64(source, F.lit(k)), F.lit(bits)) for k in range(HASHES)))


def done_filter(done: DataFrame, bits: int, key: str = "source") -> DataFrame:
    """(page, bitmap) of all sources in ``done``, at most ``bits`` / ``PAGE`` rows."""
    at = done.where(F.col(key).isNotNull()).select(F.explode(_positions(F.col(key), bits)).alias("at"))
    return at.groupBy(F.floor(F.col("at") / PAGE).alias("page")).agg(F.bitmap_construct_agg(F.pmod("at", F.lit(PAGE))).alias("bitmap"))


def _bit(bitmap: Column, at: Column) -> Column:
    """Whether bit ``at`` is set; bit 0 is the lowest of the first byte."""
    place = F.pmod(at, F.lit(PAGE))
    byte = F.conv(F.hex(F.substring(bitmap, F.floor(place / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    return byte.bitwiseAND(F.element_at(F.array(*(F.lit(1 << k) for k in range(8))), F.pmod(place, F.lit(8)).cast("int") + 1)) != 0


def split_by_filter(docs: DataFrame, pages: DataFrame, bits: int, key: str = "source") -> DataFrame:
    """``docs`` with a column maybe_done: false where no finished source can be equal. Null sources are never done."""
    out, names = docs.withColumn("_at", _positions(F.col(key), bits)), []
    pages = F.broadcast(pages)  # at most MOST_BITS / 8 bytes
    for k in range(HASHES):
        own = pages.select(F.col("page").alias(f"_page{k}"), F.col("bitmap").alias(f"_bitmap{k}"))
        out = out.join(own, F.floor(F.col("_at")[k] / PAGE) == F.col(f"_page{k}"), "left")
        out = out.withColumn(f"_hit{k}", F.coalesce(_bit(F.col(f"_bitmap{k}"), F.col("_at")[k]), F.lit(False))).drop(f"_page{k}", f"_bitmap{k}")
        names.append(f"_hit{k}")
    hits = F.col(names[0])
    for n in names[1:]:
        hits = hits & F.col(n)
    return out.withColumn("maybe_done", hits & F.col(key).isNotNull()).drop("_at", *names)


def pending_filtered(docs: DataFrame, done: DataFrame, key: str = "source", n_done: int | None = None) -> DataFrame:
    """Rows of ``docs`` whose ``key`` is not in ``done``: the rows of a left anti join, most of them without a shuffle.

    Rows with a null key stay. ``n_done`` is the count of ``done`` if it is known, else it is counted.
    """
    bits = bits_for(done.count() if n_done is None else n_done)
    marked = split_by_filter(docs, done_filter(done, bits, key), bits, key)
    sure = marked.where(~F.col("maybe_done")).select(docs.columns)
    doubtful = marked.where("maybe_done").select(docs.columns)
    return sure.unionByName(doubtful.join(done.select(key).distinct(), key, "left_anti").select(docs.columns))


def ingest_pending(spark: SparkSession, source: str, schema, done_path: str, target: str, checkpoint: str, work, key: str = "source", files: int | None = None):
    """Process new files of ``source``; rows whose ``key`` is finished, in this stream or elsewhere, are passed over.

    ``work(batch)`` gives the rows to write. Each micro-batch reads the table of finished sources
    (Parquet under ``done_path``) as it stands, filters by it, writes its own folder of ``target`` and
    adds its sources, one row each, to its own folder of ``done_path``; a batch that is run again sees
    what others finished and writes the same folders. Of rows that share a source in one batch all go.
    """

    def put(batch: DataFrame, batch_id: int) -> None:
        own = f"{done_path}/by={batch_id}"
        done = None
        if exists(spark, done_path):
            done = spark.read.option("basePath", done_path).schema(f"{key} string, by string").parquet(done_path).where(F.col("by") != str(batch_id)).select(key)
        fresh = batch if done is None else pending_filtered(batch, done, key)
        fresh = fresh.persist()
        try:
            work(fresh).write.mode("overwrite").parquet(f"{target}/batch={batch_id}")
            fresh.select(F.col(key).cast("string").alias(key)).where(F.col(key).isNotNull()).distinct().write.mode("overwrite").parquet(own)
        finally:
            fresh.unpersist()

    stream = spark.readStream.schema(schema)
    if files:
        stream = stream.option("maxFilesPerTrigger", files)
    return stream.parquet(source).writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
