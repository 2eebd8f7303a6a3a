"""A data source that lists files: partitions are folders, and tasks walk them."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

LISTING = "path string, length long, modified timestamp"
FORMAT = "media_listing"
#: Levels of folders that become partitions of their own; what lies deeper belongs to the folder above it.
DEPTH = 2
ROWS = 10_000
_ARROW = pa.schema([("path", pa.string()), ("length", pa.int64()), ("modified", pa.timestamp("us", "UTC"))])


class Folder(InputPartition):
    def __init__(self, path: str, recursive: bool):
        self.path, self.recursive = path, recursive


def _open(uri: str) -> tuple[pafs.FileSystem, str, str]:
    """File system, path in it, and what a URI has before such a path."""
    system, path = pafs.FileSystem.from_uri(uri)
    return system, path, "file:" if uri.startswith("file:") else uri.rstrip("/").removesuffix(path.rstrip("/"))


class FolderReader(DataSourceReader):
    def __init__(self, root: str, depth: int):
        self.root, self.depth = root, depth

    def partitions(self) -> list[InputPartition]:
        """One for each folder down to ``depth`` levels. The driver sees names of folders there; files are seen in tasks."""
        system, top, _ = _open(self.root)
        out, level = [], [top]
        for k in range(self.depth + 1):
            last = k == self.depth
            out += [Folder(p, recursive=last) for p in level]
            if last:
                break
            level = [i.path for p in level for i in system.get_file_info(pafs.FileSelector(p)) if i.type == pafs.FileType.Directory]
        return out

    def read(self, partition: Folder) -> Iterator[pa.RecordBatch]:
        system, _, prefix = _open(self.root)
        waiting = [partition.path]
        while waiting:
            files = []
            for info in system.get_file_info(pafs.FileSelector(waiting.pop())):
                if info.type == pafs.FileType.Directory:
                    if partition.recursive:
                        waiting.append(info.path)
                elif info.type == pafs.FileType.File and not info.base_name.startswith(("_", ".")):
                    files.append((prefix + info.path, info.size, info.mtime))
            for at in range(0, len(files), ROWS):
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*files[at : at + ROWS]), _ARROW)], schema=_ARROW)


class MediaListing(DataSource):
    """``spark.read.format("media_listing").load(uri)``: path, length and modification time of all files below a folder."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return LISTING

    def reader(self, schema) -> DataSourceReader:
        return FolderReader(self.options["path"], int(self.options.get("depth", DEPTH)))


def list_files(spark: SparkSession, root: str, depth: int = DEPTH) -> DataFrame:
    """Listing of all files below ``root``, hidden ones left out. A path without scheme is one of the session's file system."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(root)
    uri = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(path).toString()
    uri = f"file:///{uri.removeprefix('file:').lstrip('/')}" if uri.startswith("file:") else uri
    spark.dataSource.register(MediaListing)
    return spark.read.format(FORMAT).option("depth", depth).load(uri)
