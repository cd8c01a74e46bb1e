"""Progress of a run from the run itself: counts that ride on the action that does the work.

``DataFrame.observe`` adds aggregates to a plan; they are summed while the action runs and told to
the driver when it ends, so no second job reads anything. Batches hand them out through an
``Observation``, streams through a listener that adds up the micro-batches of each query.
"""

from __future__ import annotations

import threading

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener

from ..session import kept


def counts(error: str = "error", **more: Column) -> list[Column]:
    """Aggregates total, done (no error) and failed, and ``more`` under their names."""
    failed = F.col(error).isNotNull()
    return [F.count(F.lit(1)).alias("total"), F.count_if(~failed).alias("done"), F.count_if(failed).alias("failed"), *(c.alias(n) for n, c in more.items())]


def run_counted(results: DataFrame, name: str, error: str = "error", **more: Column) -> tuple[DataFrame, dict]:
    """(results, counts): the results written once and read again, with what was counted on the way.

    The counts are those of the rows written, by the job that wrote them. An empty table counts 0.
    """
    seen = Observation(name)
    out = kept(results.observe(seen, *counts(error, **more)), name)
    return out, seen.get


def as_row(spark, name: str, counted: dict) -> DataFrame:
    """(name, total, done, failed, ...) as a table of one row, for a log of runs."""
    kinds = ", ".join(f"{k} {'double' if isinstance(v, float) else 'long'}" for k, v in counted.items())
    return spark.createDataFrame([(name, *counted.values())], f"name string, {kinds}")


class StreamCounts(StreamingQueryListener):
    """Adds up the counts that streams observe under ``name``, by query; also the batches and rows they took.

    Register it with ``spark.streams.addListener``; ``of(run_id)`` is the state so far. A query that
    is started again from its checkpoint has a new run and counts on from 0.
    """

    def __init__(self, name: str):
        self._name, self._sums, self._ended, self._lock = name, {}, set(), threading.Lock()

    def onQueryStarted(self, event) -> None:
        with self._lock:
            self._sums[str(event.runId)] = {"batches": 0, "rows": 0}

    def onQueryProgress(self, event) -> None:
        p = event.progress
        seen = p.observedMetrics.get(self._name)
        with self._lock:
            sums = self._sums.setdefault(str(p.runId), {"batches": 0, "rows": 0})
            if p.numInputRows:
                sums["batches"] += 1
                sums["rows"] += p.numInputRows
            for k, v in (seen.asDict() if seen is not None else {}).items():
                sums[k] = sums.get(k, 0) + (v or 0)

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        with self._lock:
            self._ended.add(str(event.runId))

    def ended(self, run_id) -> bool:
        with self._lock:
            return str(run_id) in self._ended

    def of(self, run_id) -> dict:
        with self._lock:
            return dict(self._sums.get(str(run_id), {}))
