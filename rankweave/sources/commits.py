"""Small files that decide which change comes next: one JSON entry per version, published at most once.

An entry is written in full under a name of its own and then given its final name in one step that fails if the name
is taken: a hard link on a local file system, a rename without overwriting elsewhere.  So a reader never sees part of an
entry, and of two writers of one version exactly one succeeds.  The file system has to rename atomically, as HDFS
does; plain object stores do not.

Entries are read and written by the driver; their number is kept small by whoever publishes them.
"""

from __future__ import annotations

import json
import uuid
from typing import Any

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession

_TAKEN = ("java.nio.file.FileAlreadyExistsException", "org.apache.hadoop.fs.FileAlreadyExistsException")
_GONE = ("java.io.FileNotFoundException", "java.nio.file.NoSuchFileException")


def _kind(problem: Py4JJavaError) -> str:
    return problem.java_exception.getClass().getName()


def unique() -> int:
    """A folder number no other attempt uses."""
    return uuid.uuid4().int >> 66


class Entries:
    """The entries ``<name>.json`` of a folder."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder.rstrip("/")

    def _path(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")

    def _system(self):
        return self._path("x").getFileSystem(self.spark._jsc.hadoopConfiguration())

    def names(self) -> list[str]:
        """Names of all published entries in order; none if the folder does not exist."""
        try:
            found = self._system().listStatus(self.spark._jvm.org.apache.hadoop.fs.Path(self.folder))
        except Py4JJavaError as problem:
            if _kind(problem) in _GONE:
                return []
            raise
        names = [f.getPath().getName() for f in found]
        return sorted(n.removesuffix(".json") for n in names if n.endswith(".json") and not n.startswith("."))

    def read(self, name: str) -> dict[str, Any] | None:
        """The entry, or None if there is none of this name (any more)."""
        try:
            stream = self._system().open(self._path(f"{name}.json"))
        except Py4JJavaError as problem:
            if _kind(problem) in _GONE:
                return None
            raise
        try:
            return json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def publish(self, name: str, content: dict[str, Any]) -> bool:
        """Whether this call has published the entry; False if the name is taken."""
        system, draft, target = self._system(), self._path(f".draft-{uuid.uuid4().hex}"), self._path(f"{name}.json")
        out = system.create(draft, True)
        out.write(bytearray(json.dumps(content), "utf-8"))
        out.close()
        try:
            self._name(system, draft, target)
            return True
        except Py4JJavaError as problem:
            if _kind(problem) in _TAKEN:
                return False
            raise
        finally:
            system.delete(draft, False)

    def _name(self, system, draft, target) -> None:
        jvm = self.spark._jvm
        if system.getUri().getScheme() == "file":
            local = lambda path: jvm.java.io.File(path.toUri().getPath()).toPath()
            jvm.java.nio.file.Files.createLink(local(system.makeQualified(target)), local(system.makeQualified(draft)))
        else:
            self._rename(system, draft, target)

    def _rename(self, system, draft, target) -> None:
        jvm, kind = self.spark._jvm, getattr(self.spark._jvm.org.apache.hadoop.fs, "Options$Rename")
        options = self.spark.sparkContext._gateway.new_array(kind, 1)
        options[0] = kind.NONE
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(system.getUri(), self.spark._jsc.hadoopConfiguration())
        context.rename(system.makeQualified(draft), system.makeQualified(target), options)

    def remove(self, name: str) -> None:
        self._system().delete(self._path(f"{name}.json"), False)
