"""The shared folder of a cluster, tables written once, and plain files below it."""

from __future__ import annotations

import posixpath
import re
import tempfile
import uuid

from pyarrow import fs as arrow_fs
from pyspark.sql import DataFrame, SparkSession

DIR_KEY = "spark.checkpoint.dir"


def shared_dir(spark: SparkSession) -> str:
    """A new folder below the one that the cluster names in spark.checkpoint.dir; local sessions without one get a temporary one."""
    base = spark.conf.get(DIR_KEY, None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError(f"set {DIR_KEY} to a folder that all executors share")
        base = tempfile.mkdtemp(prefix="spark-")
        spark.conf.set(DIR_KEY, base)
    return f"{base.rstrip('/')}/factgrid/{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """df written once to the shared folder and read back: its rows, and the partitions they came in, no longer change."""
    path = f"{shared_dir(df.sparkSession)}/{name}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


class Folder:
    """Plain files below a folder, on any storage that Arrow reaches: a path, or a URI such as file:, hdfs: or s3:."""

    def __init__(self, path: str):
        self.fs, self.root = arrow_fs.FileSystem.from_uri(path) if re.match("[A-Za-z][A-Za-z0-9+.-]+:", path) else (arrow_fs.LocalFileSystem(), path)

    def _at(self, name: str) -> str:
        return posixpath.join(self.root, name)

    def read(self, name: str) -> bytes | None:
        """The file's bytes, or None where there is none."""
        try:
            with self.fs.open_input_stream(self._at(name)) as f:
                return f.read()
        except FileNotFoundError:
            return None

    def write(self, name: str, data: bytes) -> None:
        """Puts the whole file in place or nothing: it is written under another name first, which no other attempt uses, then renamed."""
        self.fs.create_dir(posixpath.dirname(self._at(name)), recursive=True)
        part = self._at(f"{name}.{uuid.uuid4().hex}.part")
        try:
            with self.fs.open_output_stream(part) as f:
                f.write(data)
            self.fs.move(part, self._at(name))
        except BaseException:
            if self.fs.get_file_info(part).type != arrow_fs.FileType.NotFound:
                self.fs.delete_file(part)
            raise

    def delete(self, name: str) -> None:
        """Takes a file away, if it is there."""
        try:
            self.fs.delete_file(self._at(name))
        except FileNotFoundError:
            pass

    def names(self, below: str = "", any_kind: bool = False) -> list[str]:
        """The files directly in a folder, sorted; with any_kind its folders too."""
        found = self.fs.get_file_info(arrow_fs.FileSelector(self._at(below), allow_not_found=True))
        return sorted(posixpath.join(below, f.base_name) for f in found if any_kind or f.type == arrow_fs.FileType.File)
