"""A store of rows by key that grows without making a batch read more of it."""

from __future__ import annotations

import json
import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tidemark.streaming.files import Marks


class KeyedStore:
    """Rows in buckets by the hash of their key, with a file of key hashes per bucket.

    A batch opens the hash files of the buckets its keys fall into, and the keys
    themselves only of buckets where a hash is found; hashes decide nothing
    alone. ``reorganise`` deals rows out to more buckets as the store grows, so a
    bucket has about ``bucket_rows`` at most, and a batch of n keys reads at
    most n buckets of that size however large the store is.

    Batches are numbered by the store, and told apart by a token (which stream,
    which of its batches). A batch sees the rows of earlier numbers only, and
    writes into folders of its own number, so one that is run again leaves the
    same rows; a stream that begins anew goes on after the last. Readers see
    batches that are done. One writer at a time.

    The driver handles bucket numbers, never keys.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        self.layouts, self.done = Marks(spark, f"{path}/layouts"), Marks(spark, f"{path}/done")
        latest = self.layouts.latest()
        if latest is None:
            raise ValueError(f"no store at {path}")
        layout = latest[1]
        self.keys, self.buckets, self.folder = layout["keys"], layout["buckets"], layout["folder"]
        self.bucket_rows = layout["bucket_rows"]
        self.schema = StructType.fromJson(json.loads(layout["schema"]))
        self.opened: list[str] = []

    @classmethod
    def create(
        cls,
        spark: SparkSession,
        path: str,
        keys: Sequence[str],
        schema: StructType | str,
        buckets: int = 16,
        bucket_rows: int = 100_000,
    ) -> KeyedStore:
        """The store at ``path``, made if there is none."""
        layouts = Marks(spark, f"{path}/layouts")
        if layouts.latest() is None:
            if not isinstance(schema, StructType):
                schema = spark.createDataFrame([], schema).schema
            content = {
                "keys": list(keys), "buckets": buckets, "folder": uuid.uuid4().hex,
                "bucket_rows": bucket_rows, "schema": schema.json(),
            }
            cls._prepare(spark, f"{path}/{content['folder']}", schema, buckets)
            layouts.publish(0, content)
        return cls(spark, path)

    @staticmethod
    def _prepare(spark: SparkSession, folder: str, schema: StructType, buckets: int) -> None:
        """Give every bucket a folder, so that any of them can be named in a read."""
        each = spark.range(buckets).select(F.col("id").cast("int").alias("bucket"))
        empty = each.select(
            *[F.lit(None).cast(f.dataType).alias(f.name) for f in schema],
            F.lit(None).cast("bigint").alias("__hash"),
            "bucket",
            F.lit(-1).cast("bigint").alias("batch"),
        )
        for name in ("rows", "hashes"):
            part = empty.drop("__hash") if name == "rows" else empty.select("__hash", "bucket", "batch")
            part.repartition("bucket").write.mode("overwrite").partitionBy("bucket", "batch").parquet(
                f"{folder}/{name}"
            )

    def _hash(self) -> Column:
        return F.xxhash64(*self.keys)

    def _bucket(self, buckets: int | None = None) -> Column:
        return F.pmod(self._hash(), F.lit(buckets or self.buckets)).cast("int")

    def _open(self, name: str, numbers: Sequence[int]) -> DataFrame:
        """Rows or hashes of the given buckets; no other folder is listed."""
        base = f"{self.path}/{self.folder}/{name}"
        paths = [f"{base}/bucket={k}" for k in numbers]
        self.opened += paths
        return self._reader(name).parquet(*paths).where("batch >= 0")

    def _reader(self, name: str):
        own = self.schema if name == "rows" else StructType().add("__hash", "long")
        kind = StructType([*own.fields]).add("bucket", "integer").add("batch", "long")
        return self.spark.read.option("basePath", f"{self.path}/{self.folder}/{name}").schema(kind)

    def read(self) -> DataFrame:
        """All rows of the batches that are done."""
        latest = self.done.latest()
        if latest is None:
            return self.spark.createDataFrame([], self.schema)
        rows = self._reader("rows").parquet(f"{self.path}/{self.folder}/rows")
        return rows.where(F.col("batch").between(0, latest[0])).drop("bucket", "batch")

    def number_of(self, token: str) -> int:
        """The number of a batch: that of the last one if it had this token, else the next."""
        latest = self.done.latest()
        if latest is None:
            return 0
        return latest[0] + (latest[1]["token"] != token)

    def missing(self, rows: DataFrame, batch: int) -> DataFrame:
        """The rows whose key no earlier batch stored. ``rows`` should be stored or cheap."""
        self.opened = []
        tagged = rows.withColumns({"__hash": self._hash(), "bucket": self._bucket()})
        touched = [r["bucket"] for r in tagged.select("bucket").distinct().collect()]
        if not touched:
            return rows
        earlier = F.col("batch") < batch
        hashes = self._open("hashes", touched).where(earlier).select("bucket", "__hash")
        found = tagged.join(hashes, ["bucket", "__hash"], "left_semi")
        open_ = [r["bucket"] for r in found.select("bucket").distinct().collect()]
        if not open_:
            return rows
        known = self._open("rows", open_).where(earlier).select(*self.keys)
        return rows.join(known, list(self.keys), "left_anti")

    def put(self, rows: DataFrame, batch: int, token: str) -> DataFrame:
        """Store rows, one per key, under a batch number, in place of what it stored before; and read them."""
        tagged = rows.select(
            *self.schema.fieldNames(), self._bucket().alias("bucket"),
            F.lit(batch).cast("bigint").alias("batch"),
        ).repartition("bucket")
        base = f"{self.path}/{self.folder}"

        def write(part: DataFrame, name: str) -> None:
            part.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(
                "bucket", "batch"
            ).parquet(f"{base}/{name}")

        write(tagged, "rows")
        numbers = [r["bucket"] for r in tagged.select("bucket").distinct().collect()]
        here = self.spark.createDataFrame([], self.schema)
        if numbers:  # the hashes of what was stored, so that both agree
            held = self._reader("rows").parquet(
                *[f"{base}/rows/bucket={k}/batch={batch}" for k in numbers]
            )
            write(
                held.select(self._hash().alias("__hash"), "bucket", "batch")
                .repartition("bucket")
                .sortWithinPartitions("bucket", "__hash"),
                "hashes",
            )
            here = held.drop("bucket", "batch")
        latest = self.done.latest()
        if latest is None or latest[0] < batch:
            total = here.count() + (latest[1]["rows"] if latest else 0)
            self.done.publish(batch, {"rows": total, "token": token})
            for old in self.done.numbers()[:-2]:
                self.done.forget(old)
        return here

    def crowded(self) -> bool:
        """Whether buckets hold more than ``bucket_rows`` on average."""
        latest = self.done.latest()
        return latest is not None and latest[1]["rows"] > self.bucket_rows * self.buckets

    def reorganise(self, spare: int = 4) -> None:
        """Deal all rows out to enough buckets for ``spare`` times as many, one file each.

        A job of its own: its work is in proportion to the store, and as the
        store has to grow by ``spare`` before the next one, adds a constant
        factor. The new layout is published last; the old folder goes with the
        next call.
        """
        latest = self.done.latest()
        if latest is None:
            return
        buckets = self.buckets
        while buckets * self.bucket_rows < spare * latest[1]["rows"]:
            buckets *= 2
        folder = uuid.uuid4().hex
        base = f"{self.path}/{folder}"
        self._prepare(self.spark, base, self.schema, buckets)
        # The last batch may be run again, so its rows keep their number.
        number = F.when(F.col("batch") == latest[0], F.col("batch")).otherwise(F.lit(0).cast("bigint"))
        held = self._reader("rows").parquet(f"{self.path}/{self.folder}/rows")
        rows = held.where(F.col("batch").between(0, latest[0])).select(
            *self.schema.fieldNames(), self._hash().alias("__hash"),
            self._bucket(buckets).alias("bucket"), number.alias("batch"),
        ).repartition("bucket")
        rows.drop("__hash").write.mode("append").partitionBy("bucket", "batch").parquet(f"{base}/rows")
        rows.select("__hash", "bucket", "batch").sortWithinPartitions("bucket", "__hash").write.mode(
            "append"
        ).partitionBy("bucket", "batch").parquet(f"{base}/hashes")
        number, layout = self.layouts.latest()
        self.layouts.publish(number + 1, {**layout, "folder": folder, "buckets": buckets})
        for old in self.layouts.numbers()[:-2]:
            self.layouts.remove_folder(f"{self.path}/{self.layouts.read(old)['folder']}")
            self.layouts.forget(old)
        self.folder, self.buckets = folder, buckets
