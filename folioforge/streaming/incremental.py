"""Structured Streaming: new documents become passages as they arrive; events by time window."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import chunks


def passages_of(docs: DataFrame, window: int = 300, overlap: int = 50) -> DataFrame:
    """(doc_id, j, passage, char_offset); works on a batch or a stream, without state."""
    d = docs.select("doc_id", F.posexplode(chunks.passages(chunks.plain_text("text"), window, overlap)).alias("j", "p"))
    return d.select("doc_id", "j", "p.passage", "p.char_offset")


def ingest(spark: SparkSession, source: str, target: str, checkpoint: str, schema: str = "doc_id bigint, text string, lang string, source string, n_chars bigint"):
    """Process the Parquet files of ``source`` that no earlier call has, then stop.

    The checkpoint names the files done. Each batch overwrites its own folder, so a batch that is
    run again after a failure does not double its rows.
    """

    def put(batch: DataFrame, batch_id: int) -> None:
        passages_of(batch).write.mode("overwrite").parquet(f"{target}/batch={batch_id}")

    stream = spark.readStream.schema(schema).parquet(source)
    return stream.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def event_counts(events: DataFrame, late: str = "10 minutes", size: str = "1 hour") -> DataFrame:
    """(start, event_type, n, value): events by tumbling window; late events within the watermark count."""
    w = events.withWatermark("ts", late).groupBy(F.window("ts", size).alias("w"), "event_type")
    return w.agg(F.count("*").alias("n"), F.sum("value").alias("value")).select(F.col("w.start").alias("start"), "event_type", "n", "value")
