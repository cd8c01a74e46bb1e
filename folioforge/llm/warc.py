"""WARC archives: one gzip member per record, written by Spark's file committer, read sequentially.

The text writer puts one row after another with a separator. A gzip member of a record below
2**24 bytes ends in a zero byte (the top byte of its length), so each row is a member without its
last byte and the separator is that byte; a longer record is followed by an empty member, which
readers pass over. The files are therefore plain concatenated gzip members in any file system that
Spark can write, and a task that is lost and run again leaves no trace.

Files are bounded: large pages are written apart from the others, with as few records in a file as
their size asks for. The reader streams a file, so others may be of any length.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded_batches, drop_written, written

#: Records and bytes of payload in one archive file (one record at least).
FILE_RECORDS, FILE_BYTES = 10_000, 1 << 30
CHUNK = 1 << 16
#: Schemes of stores whose files Python can open as streams.
STREAMED = frozenset(("file", "hdfs", "s3", "s3a", "gs"))


def _digest(data: bytes) -> str:
    import base64
    import hashlib

    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def write_warc(df: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", least: int = 0, date: str = "2024-01-01T00:00:00Z", level: int = 3, suffix: bool = False) -> None:
    """Archive one record a row under ``path``.

    Files keep the names of Spark's writer; with ``suffix`` the driver renames each to end in
    .warc.gz, which takes a moment a file (and a copy in an object store).

    The payload is the column in UTF-8 (null: empty). Of rows with equal payloads of at least
    ``least`` bytes the one with the smallest id becomes a response and the others revisit records
    that name it; all others are responses. A null id is never grouped; rows that share an id and
    a payload are all responses if that id is the smallest. A null url becomes an empty target.
    """
    bounded_batches(df.sparkSession)
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(url_col), F.lit("")).alias("url"), F.coalesce(F.col(payload_col), F.lit("")).cast("binary").alias("payload"))
    keyed = rows.where("id is not null").select("id", F.sha1("payload").alias("sha"), F.octet_length("payload").alias("size")).where(F.col("size") >= least)
    firsts = keyed.groupBy("sha", "size").agg(F.min("id").alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    revisits = keyed.join(firsts, ["sha", "size"]).where("id <> first").select("id", "sha", "first").distinct()
    revisits = written(revisits, "revisits")  # of known size, so that few are broadcast and no payload is shuffled
    rows = rows.withColumn("sha", F.sha1("payload")).join(revisits, ["id", "sha"], "left").select("id", "url", "payload", "first")

    def members(batches):
        import uuid
        import zlib

        import pyarrow as pa

        def name(i, sha):
            return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{i}:{sha}')}>"

        def packed(data):
            z = zlib.compressobj(level, zlib.DEFLATED, 31)
            out = z.compress(data) + z.flush()
            if len(data) >= 1 << 24:
                z = zlib.compressobj(level, zlib.DEFLATED, 31)
                out += z.flush()
            assert out[-1] == 0
            return out[:-1]

        for batch in batches:
            out = []
            for i, url, payload, first in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                sha = _digest(payload)
                http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
                block = http + payload if first is None else http
                target = url.replace("\r", "%0D").replace("\n", "%0A")
                head = [
                    "WARC/1.1",
                    f"WARC-Type: {'response' if first is None else 'revisit'}",
                    f"WARC-Record-ID: {name(i, sha)}",
                    f"WARC-Date: {date}",
                    f"WARC-Target-URI: {target}",
                    f"WARC-Payload-Digest: sha1:{sha}",
                    f"WARC-Block-Digest: sha1:{_digest(block)}",
                    "Content-Type: application/http; msgtype=response",
                    f"Content-Length: {len(block)}",
                ]
                if i is not None:
                    head.append(f"X-Row-Id: {i}")
                if first is not None:
                    head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {name(first, sha)}", f"X-Refers-To-Row-Id: {first}"]
                out.append(packed("\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"))
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["value"])

    small = FILE_BYTES // FILE_RECORDS
    size = F.octet_length("payload")
    largest = df.select(F.octet_length(F.col(payload_col).cast("binary")).alias("n")).agg(F.max("n")).first()[0] or 0
    parts = [(rows.where(size <= small), FILE_RECORDS)]
    if largest > small:
        parts.append((rows.where(size > small), max(1, FILE_BYTES // largest)))
    for part, records in parts:
        files = part.mapInArrow(members, "value binary").select(F.col("value").cast("string"))
        files.write.mode("append").option("lineSep", "\0").option("maxRecordsPerFile", records).text(path)
    drop_written(revisits)
    if suffix:
        _rename(df.sparkSession, path)


def _rename(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    folder = jvm.org.apache.hadoop.fs.Path(path)
    fs = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    for status in fs.listStatus(folder):
        if status.getPath().getName().endswith(".txt"):
            fs.rename(status.getPath(), jvm.org.apache.hadoop.fs.Path(folder, status.getPath().getName()[:-4] + ".warc.gz"))


def records(data, chunk: int = CHUNK):
    """(header, block) of each record of one archive, read and decompressed a chunk at a time.

    ``data`` is bytes or an open stream. Each gzip member must hold one record: a version line, named
    fields, a blank line and Content-Length bytes, then two line ends. ValueError where the framing
    is broken. No more than one record and one chunk is held.
    """
    import io
    import zlib

    stream, left = data if hasattr(data, "read") else io.BytesIO(data), b""
    while left or (left := stream.read(chunk)):
        z, parts = zlib.decompressobj(31), []
        while not z.eof:
            piece, left = left or stream.read(chunk), b""
            if not piece:
                raise ValueError("archive ends within a gzip member")
            parts.append(z.decompress(piece))
        left = z.unused_data
        record = b"".join(parts)
        if not record:
            continue
        end = record.find(b"\r\n\r\n")
        if end < 0 or not record.startswith(b"WARC/"):
            raise ValueError("no WARC header")
        header = {}
        for line in record[:end].decode("utf-8").split("\r\n")[1:]:
            key, _, value = line.partition(":")
            header[key.strip().lower()] = value.strip()
        n = int(header["content-length"])
        block = record[end + 4 : end + 4 + n]
        if len(block) != n or record[end + 4 + n :] != b"\r\n\r\n":
            raise ValueError("content length does not frame the record")
        yield header, block


def _opened(uri: str):
    """A stream of a file that Spark has listed."""
    from pyarrow import fs

    scheme, _, rest = uri.partition(":")
    if scheme == "file":  # Spark gives paths as they are, not as URIs write them
        return fs.LocalFileSystem().open_input_stream("/" + rest.lstrip("/"), compression=None)
    store, path = fs.FileSystem.from_uri(uri.replace("s3a://", "s3://", 1))
    return store.open_input_stream(path, compression=None)


def read_warc(spark: SparkSession, path: str, with_payload: bool = True) -> DataFrame:
    """(row_id, url, record_type, payload_bytes, payload_digest, refers_to, payload) of every record.

    All files under ``path`` are archives. Each is read as a stream by one task, whatever its length; in
    a store that only Spark can open it is read whole and may have 2 GB. An archive without records,
    or no archive, gives no rows; null and repeated ids come back as they were written.

    Block digests, and the payload digests of responses, are checked; a mismatch or broken framing
    fails the read. A revisit gives the length and digest of the payload that it stands for and no
    payload. With ``with_payload`` false the payload column is null.
    """
    bounded_batches(spark)

    def parsed(batches):
        import pyarrow as pa

        schema = pa.schema([("row_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("refers_to", pa.int64()), ("payload", pa.binary())])
        for batch in batches:
            for one in batch.column(0):
                rows, size = [], 0
                for header, block in records(_opened(one.as_py()) if streamed else one.as_buffer()):
                    http, _, payload = block.partition(b"\r\n\r\n")
                    digest = header["warc-payload-digest"].removeprefix("sha1:")
                    if _digest(block) != header["warc-block-digest"].removeprefix("sha1:"):
                        raise ValueError(f"block digest of {header['warc-record-id']}")
                    whole = header["warc-type"] == "response"
                    if whole and _digest(payload) != digest:
                        raise ValueError(f"payload digest of {header['warc-record-id']}")
                    n = len(payload) if whole else next(int(x.split(b":")[1]) for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:"))
                    number = lambda key: int(header[key]) if key in header else None
                    rows.append((number("x-row-id"), header["warc-target-uri"], header["warc-type"], n, digest, number("x-refers-to-row-id"), payload if whole and with_payload else None))
                    size += len(payload) if with_payload else 200
                    if size > 4_000_000:
                        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)
                        rows, size = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    streamed = path.partition(":")[0] in STREAMED or path.startswith("/")
    files = spark.read.format("binaryFile").load(path).select("path" if streamed else "content")
    return files.mapInArrow(parsed, "row_id long, url string, record_type string, payload_bytes long, payload_digest string, refers_to long, payload binary")
