"""Tables whose versions are lists of folders: appends, compaction, and nothing lost in between."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tidemark.streaming.files import Marks


class VersionedTable:
    """Parquet folders, and numbered versions that name the folders a table consists of.

    Rows are written into a new folder first; the version that names it is
    published last. A run that breaks off anywhere leaves the last version as it
    was, and no stored file is ever written again or renamed. A folder is
    deleted only by ``vacuum``, when no kept version names it. One writer at a
    time; a second one fails when it publishes.
    """

    def __init__(
        self, spark: SparkSession, path: str, schema: StructType | str, partition_by: Sequence[str] = ()
    ):
        self.spark, self.path, self.partition_by = spark, path, list(partition_by)
        if not isinstance(schema, StructType):
            schema = spark.createDataFrame([], schema).schema
        self.schema = schema
        self.versions = Marks(spark, f"{path}/versions")

    def entries(self) -> list[dict]:
        """Folders of the latest version: ``folder``, ``batch``, ``base``, ``token``."""
        latest = self.versions.latest()
        return latest[1]["folders"] if latest else []

    def _read(self, entries: Sequence[dict]) -> DataFrame:
        if not entries:
            return self.spark.createDataFrame([], self.schema)
        data = f"{self.path}/data"
        reader = self.spark.read.option("basePath", data).schema(
            StructType([*self.schema.fields]).add("__folder", "string")
        )
        return reader.parquet(*[f"{data}/__folder={e['folder']}" for e in entries]).drop("__folder")

    def read(self) -> DataFrame:
        return self._read(self.entries())

    def _write(self, rows: DataFrame, batch: int, base: bool) -> dict:
        folder = uuid.uuid4().hex
        if "batch" in self.schema.fieldNames() and "batch" not in rows.columns:
            rows = rows.withColumn("batch", F.lit(batch).cast("bigint"))
        out = rows.select(*self.schema.fieldNames()).write
        if self.partition_by:
            out = out.partitionBy(*self.partition_by)
        out.parquet(f"{self.path}/data/__folder={folder}")
        return {"folder": folder, "batch": batch, "base": base}

    def _publish(self, number: int, entries: list[dict]) -> None:
        self.versions.publish(number, {"folders": entries})

    def _next(self) -> tuple[int, list[dict]]:
        latest = self.versions.latest()
        return (latest[0] + 1, latest[1]["folders"]) if latest else (0, [])

    def append(self, rows: DataFrame, token: str | None = None) -> None:
        """Add rows; a column ``batch`` of the table that they lack gets the number of the append.

        ``token`` tells micro-batches apart: the last one, run again, adds nothing.
        """
        number, entries = self._next()
        last = max(entries, key=lambda e: e["batch"], default={"batch": -1, "token": None})
        if token is not None and token == last["token"]:
            return
        added = self._write(rows, last["batch"] + 1, False)
        self._publish(number, [*entries, {**added, "token": token}])

    def deltas(self) -> int:
        return sum(not e["base"] for e in self.entries())

    def compact(self, merge: Callable[[DataFrame], DataFrame]) -> None:
        """Put one folder, ``merge`` of all rows, in place of the folders of the latest version."""
        number, entries = self._next()
        if len(entries) < 2:
            return
        last = max(entries, key=lambda e: e["batch"])
        base = self._write(merge(self._read(entries)), last["batch"], True)
        self._publish(number, [{**base, "token": last["token"]}])

    def vacuum(self, keep: int = 2) -> None:
        """Forget all but the last ``keep`` versions, and delete folders that only those named.

        Readers of a forgotten version fail, so keep as many as may be in use.
        Folders of runs that broke off are in no version and stay.
        """
        numbers = self.versions.numbers()
        kept, gone = numbers[-keep:], numbers[:-keep]
        held = {e["folder"] for n in kept for e in self.versions.read(n)["folders"]}
        for n in gone:
            for e in self.versions.read(n)["folders"]:
                if e["folder"] not in held:
                    self.versions.remove_folder(f"{self.path}/data/__folder={e['folder']}")
            self.versions.forget(n)
