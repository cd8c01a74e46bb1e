"""Pages of a JSON interface as a Spark data source: offsets are planned first and read in parallel.

``spark.read.format("paged_json").schema(...).option("path", template).load()``: ``template`` is a URI
with ``{start}`` and ``{limit}``, of a file system or of http. A page is an object with the list of
its rows under ``rows`` and, at least on the first, the number of all rows under ``total``; a bare
list is rows alone. Fields are taken by name, whatever their order; missing ones are null.
"""

from __future__ import annotations

import json

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition


class _Pages(InputPartition):
    """Some offsets, read by one task."""

    def __init__(self, starts: list):
        super().__init__(tuple(starts))
        self.starts = starts


def _fetched(uri: str):
    """The JSON behind a URI; tried again as ``retried`` says."""
    from .providers import retried

    def get():
        if uri.startswith(("http://", "https://")):
            from urllib.request import urlopen

            with urlopen(uri, timeout=60) as f:  # noqa: S310 - the scheme is one of the two
                return f.read()
        from pyarrow import fs

        store, path = fs.FileSystem.from_uri(uri)
        with store.open_input_stream(path) as f:
            return f.readall()

    return json.loads(retried(3, 0.2)(get)())


class _Reader(DataSourceReader):
    def __init__(self, schema, options):
        self._schema, self._template = schema, options["path"]
        self._limit, self._rows, self._total = int(options.get("limit", 100)), options.get("rows", "results"), options.get("total", "total")
        self._tasks = int(options.get("tasks", 64))

    def _page(self, start: int):
        return _fetched(self._template.replace("{start}", str(start)).replace("{limit}", str(self._limit)))

    def partitions(self):
        """Offsets of all pages, dealt to at most ``tasks`` tasks; the first page says how many rows there are."""
        first = self._page(0)
        total = len(first) if isinstance(first, list) else int(first.get(self._total, len(first.get(self._rows) or [])))
        starts = list(range(0, max(total, 1), self._limit))
        n = min(self._tasks, len(starts))
        return [_Pages(starts[len(starts) * k // n : len(starts) * (k + 1) // n]) for k in range(n)]

    def read(self, partition):
        import datetime

        from pyspark.sql import types as T

        def value(x, kind):
            """A JSON value as ``kind``; null where it is none."""
            if x is None:
                return None
            if isinstance(kind, T.StructType):
                return tuple(value(x.get(f.name), f.dataType) for f in kind) if isinstance(x, dict) else None
            if isinstance(kind, T.ArrayType):
                return [value(v, kind.elementType) for v in x] if isinstance(x, list) else None
            if isinstance(kind, T.MapType):
                return {k: value(v, kind.valueType) for k, v in x.items()} if isinstance(x, dict) else None
            try:
                if isinstance(kind, T.StringType):
                    return x if isinstance(x, str) else json.dumps(x, ensure_ascii=False, separators=(",", ":"))
                if isinstance(kind, T.BooleanType):
                    return x if isinstance(x, bool) else None
                if isinstance(kind, (T.IntegerType, T.LongType, T.ShortType, T.ByteType)):
                    return x if isinstance(x, int) and not isinstance(x, bool) else None
                if isinstance(kind, (T.DoubleType, T.FloatType)):
                    return float(x) if isinstance(x, (int, float)) and not isinstance(x, bool) else None
                if isinstance(kind, T.DateType):
                    return datetime.date.fromisoformat(x)
                if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
                    return datetime.datetime.fromisoformat(x)
            except (TypeError, ValueError):
                return None
            raise ValueError(f"no JSON value is a {kind.simpleString()}")

        for start in partition.starts:
            page = self._page(start)
            for row in page if isinstance(page, list) else page.get(self._rows) or []:
                yield value(row, self._schema)


class PagedJson(DataSource):
    """Options: path (a template), limit, rows and total (names in a page), tasks. The schema is given by the reader."""

    @classmethod
    def name(cls) -> str:
        return "paged_json"

    def schema(self):
        raise ValueError("paged_json needs a schema: spark.read.schema(...)")

    def reader(self, schema):
        return _Reader(schema, self.options)
