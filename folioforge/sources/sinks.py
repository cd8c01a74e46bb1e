"""Vault files, archives, JSON documents and the table of finished sources."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import kept, reachable
from .vault import registered, safe_path


def vault_folder(root: str, case: str, override: str | None = None) -> str:
    """Where a case is written: under the root, a named vault of it, or an absolute folder or URI."""
    if not override:
        return f"{root.rstrip('/')}/{case}"
    if override.startswith("/") or "://" in override:
        path = override.rstrip("/")
        return path if path.rsplit("/", 1)[-1] == case else f"{path}/{case}"
    return f"{root.rstrip('/')}/{override}/{case}"


def collisions(files: DataFrame) -> DataFrame:
    """(rel_path, n): paths that more than one row would write."""
    return files.groupBy("rel_path").agg(F.count("*").alias("n")).where("n > 1")


def write_vault(files: DataFrame, root: str, folders: tuple = ("notes",)) -> None:
    """Write (rel_path, content) rows as files under ``root``, a URI that every executor reaches, all or none.

    Each top folder also gets ``folders``, empty. Paths that leave the vault are refused; paths written
    twice raise before anything is written. See ``vault`` for what a lost task leaves: nothing.
    """
    twice = collisions(files).limit(5).collect()
    if twice:
        raise ValueError(f"written twice: {', '.join(r['rel_path'] for r in twice)}")
    registered(files.sparkSession)
    files.select("rel_path", "content").write.format("vault").mode("append").option("folders", ",".join(folders)).save(root)


def zipped(files: DataFrame, folders: tuple = ("notes",)) -> DataFrame:
    """(folder, archive): one zip per top folder, members sorted, empty ``folders`` kept as entries.

    A folder's files are one Arrow group and its archive one value, so a folder must stay well below
    2 GB; an article or a book does. Larger collections go to ``write_vault``.
    """

    def pack(table):
        import io
        import zipfile

        import pyarrow as pa

        buf = io.BytesIO()
        rows = sorted(zip(table.column("rel_path").to_pylist(), table.column("content").to_pylist(), strict=True))
        top = table.column("folder")[0].as_py()
        names = sorted({f"{top}/", *(f"{top}/{f}/" for f in folders)})
        with zipfile.ZipFile(buf, "w", zipfile.ZIP_DEFLATED) as z:
            for name in names:
                z.writestr(zipfile.ZipInfo(name), "")
            for path, content in rows:
                z.writestr(zipfile.ZipInfo(safe_path(path)), content or "", zipfile.ZIP_DEFLATED)
        return pa.table({"folder": [top], "archive": [buf.getvalue()]})

    reachable(files.sparkSession)
    own = files.select(F.substring_index("rel_path", "/", 1).alias("folder"), "rel_path", "content")
    return own.groupBy("folder").applyInArrow(pack, "folder string, archive binary")


def save_uploads(uploads: DataFrame, root: str) -> DataFrame:
    """(path, size, written): files of (path, content) written under ``root``, sub-paths kept, when this is called.

    A file of the same size that is there already is left alone. Paths that leave the folder are
    refused; of a path given twice the last one written stays. What was done is a written table, so
    further actions on it write nothing and report the same rows.
    """

    def put(batches):
        import posixpath
        import uuid

        import pyarrow as pa
        from pyarrow import fs

        store, base = fs.FileSystem.from_uri(root)
        for batch in batches:
            paths, data, fresh = batch.column(0).to_pylist(), [x or b"" for x in batch.column(1).to_pylist()], []
            for path, content in zip(paths, data, strict=True):
                target = f"{base.rstrip('/')}/{safe_path(path)}"
                info = store.get_file_info(target)
                fresh.append(info.type != fs.FileType.File or info.size != len(content))
                if fresh[-1]:
                    store.create_dir(posixpath.dirname(target), recursive=True)
                    part = f"{target}.{uuid.uuid4().hex}.part"
                    with store.open_output_stream(part, compression=None) as out:
                        out.write(content)
                    store.move(part, target)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(x) for x in data], pa.int64()), pa.array(fresh)], names=["path", "size", "written"])

    reachable(uploads.sparkSession)
    return kept(uploads.select("path", "content").mapInArrow(put, "path string, size long, written boolean"), "uploads")


def pretty_json(documents: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, json): each row as one JSON document over lines, two spaces a level, non-ASCII kept."""
    kind = documents.schema[key].dataType.simpleString()

    def run(batches):
        import json

        import pyarrow as pa

        for batch in batches:
            texts = [json.dumps(json.loads(x), indent=2, ensure_ascii=False) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=[key, "json"])

    reachable(documents.sparkSession)
    return as_json(documents, key).mapInArrow(run, f"{key} {kind}, json string")


def as_json(documents: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, json): each row as one JSON document, non-ASCII kept."""
    return documents.select(key, F.to_json(F.struct(*documents.columns), {"ignoreNullFields": "false"}).alias("json"))


def done_sources(spark: SparkSession, path: str) -> DataFrame:
    """(source) of the table of finished sources; empty if it was never written."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    if not p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p):
        return spark.createDataFrame([], "source string")
    return spark.read.schema("source string").json(path).distinct()


def mark_done(results: DataFrame, path: str) -> None:
    """Append the sources of rows without error."""
    results.where("error is null").select("source").distinct().write.mode("append").json(path)
