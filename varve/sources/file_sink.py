"""Rows (path, content) written as files: the sink of restores, region rebuilds and manifests.

    files.write.format("varve_files").mode("append").save(folder)

Each executor writes its rows through the file system that the folder's URI names (local, HDFS, S3, GCS), under names that
no reader looks for.  When all tasks have ended, the files of those attempts that counted are moved to their names, each whole
or not at all; what other attempts wrote is deleted.  So lost executors leave neither gaps, nor halves, nor files twice.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage
from pyspark.sql.types import StructType

SCHEMA = "path string, content binary"


#: Files moved to their names at once.
AT_ONCE = 16


@dataclass
class Written(WriterCommitMessage):
    moves: list[tuple[str, str]]


def target(root: str, path: str) -> str:
    """Where a relative path goes; one that leaves the root is an error."""
    parts = path.split("/")
    if not path or path.startswith("/") or any(p in ("", ".", "..") for p in parts):
        raise ValueError(f"not a path below the folder: {path!r}")
    return f"{root.rstrip('/')}/{path}"


class FileWriter(DataSourceWriter):
    def __init__(self, root: str):
        self.root, self.job = root, uuid.uuid4().hex

    def write(self, iterator: Iterator) -> Written:
        from pyarrow import fs

        system, base = fs.FileSystem.from_uri(self.root)
        moves: list[tuple[str, str]] = []
        made: set[str] = set()
        for row in iterator:
            place = target(base, row.path)
            folder, name = place.rsplit("/", 1)
            if folder not in made:
                system.create_dir(folder, recursive=True)
                made.add(folder)
            fresh = f"{folder}/.{name}.{self.job}.{uuid.uuid4().hex}.tmp"
            with system.open_output_stream(fresh, compression=None) as out:  # the bytes as they are, whatever the name
                out.write(bytes(row.content))
            moves.append((fresh, place))
        return Written(moves)

    def commit(self, messages: list) -> None:
        from pyarrow import fs

        system, _ = fs.FileSystem.from_uri(self.root)
        with ThreadPoolExecutor(AT_ONCE) as pool:
            list(pool.map(lambda x: system.move(*x), [x for m in messages if m is not None for x in m.moves]))
        self._tidy(system)

    def abort(self, messages: list) -> None:
        from pyarrow import fs

        self._tidy(fs.FileSystem.from_uri(self.root)[0])

    def _tidy(self, system) -> None:
        """Delete what attempts that did not count have left."""
        from pyarrow import fs

        base = fs.FileSystem.from_uri(self.root)[1]
        for found in system.get_file_info(fs.FileSelector(base, allow_not_found=True, recursive=True)):
            if f".{self.job}." in found.base_name and found.base_name.endswith(".tmp"):
                system.delete_file(found.path)


class FileSink(DataSource):
    @classmethod
    def name(cls) -> str:
        return "varve_files"

    def schema(self) -> str:
        return SCHEMA

    def writer(self, schema: StructType, overwrite: bool) -> FileWriter:
        if overwrite:
            raise ValueError("files are added or replaced one by one; overwriting a folder is not offered")
        return FileWriter(self.options["path"])


def write_files(files: DataFrame, folder: str) -> None:
    """Write rows (path, content) below a folder; files of other names stay."""
    spark: SparkSession = files.sparkSession
    spark.dataSource.register(FileSink)
    if "://" not in folder:
        folder = "file://" + folder
    files.select("path", "content").write.format("varve_files").mode("append").save(folder)
