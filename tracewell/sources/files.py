"""Small files beside tables: read, listed, and created whole or not at all."""

from __future__ import annotations

import os
from pathlib import Path
from urllib.parse import unquote, urlparse
from uuid import uuid4

from pyspark.sql import SparkSession


class FileThere(ValueError):
    """A file that is to be created is there already."""


class Folder:
    """A folder on any file system that Spark writes to, reached through Hadoop."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root

    def _path(self, name: str):
        jvm = self.spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)
        return jvm, path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), path

    def local(self, name: str = "") -> Path | None:
        """The place on this machine's file system, if that is where the folder lies."""
        _, fs, path = self._path(name)
        return Path(unquote(urlparse(str(fs.makeQualified(path).toString())).path)) if str(fs.getUri().getScheme()) == "file" else None

    def put(self, name: str, text: str) -> None:
        """Create ``name`` with ``text``, whole or not at all; FileThere if it is there, also if another writer is quicker.

        On a local file system by a hard link, which fails where the name is taken; elsewhere by a rename that may not
        overwrite, which HDFS does in one step. A store of objects needs a client whose rename or create is exclusive.
        """
        jvm, fs, target = self._path(name)
        if fs.exists(target):
            raise FileThere(f"{name} is there already")
        stage = jvm.org.apache.hadoop.fs.Path(target.getParent(), f".{target.getName()}.{uuid4().hex}.tmp")
        out = fs.create(stage, False)
        out.write(bytearray(text.encode()))
        out.close()
        here = self.local(name)
        try:
            if here is not None:
                os.link(here.parent / str(stage.getName()), here)
            else:
                context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), self.spark.sparkContext._jsc.hadoopConfiguration())
                options = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
                options[0] = jvm.org.apache.hadoop.fs.Options.Rename.NONE
                context.rename(stage, target, options)
        except Exception as e:
            if fs.exists(target):
                raise FileThere(f"{name} is there already") from e
            raise
        finally:
            fs.delete(stage, False)

    def get(self, name: str) -> str | None:
        jvm, fs, path = self._path(name)
        if not fs.exists(path):
            return None
        stream = fs.open(path)
        try:
            return str(jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def names(self, name: str = "") -> list[str]:
        """What lies in the folder ``name``, in order, without hidden files; nothing if it isn't there."""
        _, fs, path = self._path(name)
        if not fs.exists(path):
            return []
        found = [str(s.getPath().getName()) for s in fs.listStatus(path)]
        return sorted(n for n in found if n[0] not in "._")

    def delete(self, name: str) -> None:
        """Delete the file or folder ``name``, if it is there."""
        _, fs, path = self._path(name)
        fs.delete(path, True)
