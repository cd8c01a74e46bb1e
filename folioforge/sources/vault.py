"""A vault of files as a Spark data source: ``df.write.format("vault").mode("append").save(root)``.

Tasks write into a staging folder of the job, which only the driver makes; it moves files to their
places when all tasks have succeeded, and deletes the folder in any case. A task that outlives its
job finds no folder to write to. So a task that is killed leaves no file, a job that fails leaves
none, and of a task that ran twice the files of one run are taken. Rows need rel_path and content
(text, or binary as it is); other columns are ignored.
"""

from __future__ import annotations

import time
import uuid
from dataclasses import dataclass

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

STAGING = ".vault-staging"
#: Files that the driver moves at a time.
MOVES = 16


@dataclass
class _Staged(WriterCommitMessage):
    """The folder of a task and the paths of its files below it."""

    folder: str
    paths: list


def safe_path(rel_path: str) -> str:
    """The path with forward slashes; ValueError if it leaves the vault."""
    parts = rel_path.replace("\\", "/").split("/")
    if rel_path.startswith("/") or any(p in ("", ".", "..") for p in parts) or ":" in parts[0] or parts[0] == STAGING:
        raise ValueError(f"path leaves the vault: {rel_path!r}")
    return "/".join(parts)


class _Writer(DataSourceArrowWriter):
    def __init__(self, root: str, folders: list):
        self._root, self._folders, self._job = root, folders, uuid.uuid4().hex
        store, base = self._store()
        store.create_dir(f"{base}/{STAGING}/{self._job}", recursive=True)

    def _store(self):
        from pyarrow import fs

        store, base = fs.FileSystem.from_uri(self._root)
        return store, base.rstrip("/")

    def write(self, iterator):
        store, base = self._store()
        folder, paths = f"{base}/{STAGING}/{self._job}/{uuid.uuid4().hex}", []
        made = {""}
        store.create_dir(folder, recursive=False)
        for batch in iterator:
            at = [batch.schema.get_field_index(c) for c in ("rel_path", "content")]
            for path, content in zip(*(batch.column(k).to_pylist() for k in at), strict=True):
                path = safe_path(path or "")
                parts = path.split("/")[:-1]
                for above in ("/".join(parts[: k + 1]) for k in range(len(parts))):
                    if above not in made:
                        store.create_dir(f"{folder}/{above}", recursive=False)
                        made.add(above)
                with store.open_output_stream(f"{folder}/{path}", compression=None) as out:
                    out.write(content if isinstance(content, bytes) else (content or "").encode())
                paths.append(path)
        return _Staged(folder, paths)

    def commit(self, messages):
        import posixpath
        from concurrent.futures import ThreadPoolExecutor

        store, base = self._store()
        try:
            staged = [m for m in messages if m is not None]
            seen: set = set()
            twice = sorted({p for m in staged for p in m.paths if p in seen or seen.add(p)})
            if twice:
                raise ValueError(f"written twice: {', '.join(twice[:5])}")
            tops = {p.split("/")[0] for p in seen if "/" in p}
            for d in sorted({posixpath.dirname(f"{base}/{p}") for p in seen} | {f"{base}/{t}/{f}" for t in tops for f in self._folders}):
                store.create_dir(d, recursive=True)
            moves = [(f"{m.folder}/{p}", f"{base}/{p}") for m in staged for p in m.paths]
            with ThreadPoolExecutor(MOVES) as pool:
                list(pool.map(lambda m: store.move(*m), moves))
        finally:
            self._cleared(store, base)

    def abort(self, messages):
        self._cleared(*self._store())

    def _cleared(self, store, base):
        """The staging folder goes; again, where a task was just writing to it."""
        from pyarrow import fs

        own, top = f"{base}/{STAGING}/{self._job}", f"{base}/{STAGING}"
        there = lambda d: store.get_file_info(d).type == fs.FileType.Directory
        for _ in range(50):
            try:
                if there(own):
                    store.delete_dir(own)
                break
            except OSError:
                time.sleep(0.1)
        if there(top) and not store.get_file_info(fs.FileSelector(top)):
            store.delete_dir(top)


class VaultSource(DataSource):
    """Options: path (a URI that all executors reach) and folders (empty ones that each top folder gets, parted by commas)."""

    @classmethod
    def name(cls) -> str:
        return "vault"

    def writer(self, schema, overwrite: bool):
        if overwrite:
            raise ValueError("a vault is added to, not overwritten: use mode append")
        missing = {"rel_path", "content"} - set(schema.fieldNames())
        if missing:
            raise ValueError(f"a vault needs the columns {', '.join(sorted(missing))}")
        return _Writer(self.options["path"], [f for f in self.options.get("folders", "").split(",") if f])


def registered(spark: SparkSession) -> SparkSession:
    """The session, in which the formats ``vault`` and ``paged_json`` are known."""
    from ..session import reachable
    from .paged import PagedJson

    reachable(spark)
    spark.dataSource.register(VaultSource)
    spark.dataSource.register(PagedJson)
    return spark
