"""Keyed streaming state: what a key chose last holds for its later events, until a time limit."""

from __future__ import annotations

from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..session import reachable

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class _Remember(StatefulProcessor):
    """One value for each key: (choice, time of it in microseconds); a timer clears it at its limit."""

    def __init__(self, key: str, kind: str, limit_us: int):
        self._key, self._kind, self._limit = key, kind, limit_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._handle = handle
        self._last = handle.getValueState("last", f"choice {self._kind}, at_us long")

    def handleInputRows(self, key, rows, timerValues):
        from pyspark.sql import Row

        choice, at = self._last.get() if self._last.exists() else (None, None)
        was = at
        for r in sorted(rows, key=lambda r: (r["at_us"], r["ord"])):
            if r["choice"] is not None and (at is None or r["at_us"] >= at):
                choice, at = r["choice"], r["at_us"]
            holds = at is not None and at <= r["at_us"] <= at + self._limit
            yield Row(**{self._key: key[0], "ord": r["ord"], "at_us": r["at_us"], "remembered": choice if holds else None})
        if at != was:
            self._last.update((choice, at))
            self._handle.registerTimer((at + self._limit) // 1000 + 1)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        if self._last.exists() and (self._last.get()[1] + self._limit) // 1000 + 1 <= expiredTimerInfo.getExpiryTimeInMs():
            self._last.clear()
        yield from ()

    def close(self) -> None:
        pass


def remembered(events: DataFrame, choice: str, key: str = "user_id", at: str = "ts", order: str = "event_id", limit: str = "2 days", late: str = "1 hour") -> DataFrame:
    """(key, ord, at_us, remembered) of each event of a stream, in append mode.

    ``choice`` is an SQL expression, null where an event chooses nothing. An event has its own
    choice, else the last one that its key made at most ``limit`` before; null without one. Events
    of one batch go by ``at`` and ``order``; an event that comes in a later batch than a newer choice
    of its key has no choice. State is one row a key and is cleared at its limit. Rows with a null key
    are a key of their own; rows without a time or later than the watermark of ``late`` are left out.
    """
    spark = events.sparkSession
    reachable(spark)
    limit_us = spark.sql(f"SELECT unix_micros(timestamp'1970-01-01 00:00:00+00:00' + interval {limit})").first()[0]
    rows = events.where(F.col(at).isNotNull()).select(F.col(key).alias(key), F.col(at).cast("timestamp").alias("at"), F.unix_micros(F.col(at).cast("timestamp")).alias("at_us"), F.col(order).alias("ord"), F.expr(choice).alias("choice"))
    kind = {f.name: f.dataType.simpleString() for f in rows.schema}
    timed = rows.withWatermark("at", late)
    out = f"{key} {kind[key]}, ord {kind['ord']}, at_us long, remembered {kind['choice']}"
    return timed.groupBy(key).transformWithState(_Remember(key, kind["choice"], limit_us), outputStructType=out, outputMode="append", timeMode="eventTime")


@contextmanager
def rocks(spark: SparkSession):
    """Keyed state of several kinds and timers need the RocksDB store; the setting is put back afterwards."""
    name = "spark.sql.streaming.stateStore.providerClass"
    old = spark.conf.get(name, None)
    spark.conf.set(name, ROCKS)
    try:
        yield
    finally:
        spark.conf.set(name, old) if old else spark.conf.unset(name)


def remember_new(spark: SparkSession, source: str, schema, target: str, checkpoint: str, choice: str, **options) -> dict:
    """Run all events that no earlier call has, from the files under ``source`` to Parquet files under ``target``; what the last batch said of itself.

    The checkpoint holds offsets and state, so a call after an end of any kind goes on where the last
    one stood.
    """
    with rocks(spark):
        stream = remembered(spark.readStream.schema(schema).parquet(source), choice, **options)
        query = stream.writeStream.format("parquet").option("path", target).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
        query.awaitTermination()
        return query.lastProgress
