"""Small files next to the data, by the file system that holds it."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import SparkSession


class Marks:
    """Numbered JSON files in a folder; a number is given once, and the highest one counts.

    A file appears under its number by a rename that never replaces another, so
    it is there whole or not at all, and two writers cannot take one number.
    """

    def __init__(self, spark: SparkSession, folder: str):
        self.folder = folder
        self._jvm, self._gateway = spark._jvm, spark.sparkContext._gateway
        self._conf = spark._jsc.hadoopConfiguration()
        self._fs = self._path().getFileSystem(self._conf)

    def _path(self, name: str = ""):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}" if name else self.folder)

    def numbers(self) -> list[int]:
        if not self._fs.exists(self._path()):
            return []
        names = (s.getPath().getName() for s in self._fs.listStatus(self._path()))
        return sorted(int(n) for n in names if n.isdigit())

    def read(self, number: int) -> dict:
        stream = self._fs.open(self._path(f"{number:012d}"))
        try:
            return json.loads(self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def latest(self) -> tuple[int, dict] | None:
        numbers = self.numbers()
        return (numbers[-1], self.read(numbers[-1])) if numbers else None

    def publish(self, number: int, content: dict) -> None:
        """Fails if the number is taken."""
        draft = self._path(f"_draft-{uuid.uuid4().hex}")
        out = self._fs.create(draft, True)
        try:
            out.write(bytearray(json.dumps(content).encode()))
        finally:
            out.close()
        fs = self._jvm.org.apache.hadoop.fs
        plain = self._gateway.new_array(getattr(fs, "Options$Rename"), 0)
        context = fs.FileContext.getFileContext(self._fs.getUri(), self._conf)
        try:
            context.rename(draft, self._path(f"{number:012d}"), plain)
        except Exception:
            self._fs.delete(draft, False)
            raise

    def forget(self, number: int) -> None:
        self._fs.delete(self._path(f"{number:012d}"), False)

    def remove_folder(self, path: str) -> None:
        self._fs.delete(self._jvm.org.apache.hadoop.fs.Path(path), True)
