"""Numbered manifests: what makes new files the current state of a folder.

A state's files are written first, to folders that no reader knows of. A single new file, a manifest with the next number,
then names them. It is put in place by a rename that fails if the number is taken: readers see all of a state or none of
it, whenever the writer stops, and of two writers only one wins.
"""

from __future__ import annotations

import json
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession


class Conflict(RuntimeError):
    """Another writer has published meanwhile."""


class Manifests:
    """root/manifests/000000000007.json and so on; any JSON object is a manifest."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self._jvm = spark.sparkContext._jvm
        self._conf = spark.sparkContext._jsc.hadoopConfiguration()
        self._fs = self._path("").getFileSystem(self._conf)

    def _path(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)

    def numbers(self) -> list[int]:
        found = self._fs.globStatus(self._path("manifests/*.json")) or []
        return sorted(int(s.getPath().getName().removesuffix(".json")) for s in found)

    def load(self, number: int) -> dict:
        return json.loads(self.spark.read.text(f"{self.root}/manifests/{number:012d}.json", wholetext=True).first()[0])

    def latest(self) -> tuple[int, dict | None]:
        """The highest number and its manifest; 0 and None where there is none."""
        numbers = self.numbers()
        return (numbers[-1], self.load(numbers[-1])) if numbers else (0, None)

    def put(self, number: int, content: dict) -> None:
        """The commit: the whole file under another name, then a rename that does not replace."""
        draft, name = (self._path(f"manifests/{x}") for x in (f".{uuid.uuid4().hex}", f"{number:012d}.json"))
        out = self._fs.create(draft, False)
        out.write(json.dumps(content, ensure_ascii=False).encode())
        out.close()
        files = self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._path("").toUri(), self._conf)
        never_replace = self.spark.sparkContext._gateway.new_array(self._jvm.org.apache.hadoop.fs.Options.Rename, 0)
        try:
            files.rename(self._fs.makeQualified(draft), self._fs.makeQualified(name), never_replace)
        except Py4JJavaError as e:
            self._fs.delete(draft, False)
            if "AlreadyExists" in e.java_exception.getClass().getName():
                raise Conflict(f"version {number} is taken") from e
            raise

    def forget(self, number: int) -> None:
        self._fs.delete(self._path(f"manifests/{number:012d}.json"), False)

    def delete(self, folder: str) -> None:
        self._fs.delete(self._path(folder), True)
