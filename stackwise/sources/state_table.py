"""A keyed table whose rows change: hash buckets of Parquet, of which a write replaces only those that it touches.

The manifest names the folder of each bucket. A write reads the touched buckets alone, merges the new rows into them, and
writes these buckets to a new folder; all others keep their files, by name. Readers of the manifest before see the state
before, until ``vacuum``.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .manifests import Manifests

Merge = Callable[[DataFrame, DataFrame], DataFrame]


class StateTable:
    """``keys`` decide a row's bucket. Choose ``buckets`` so that one is a good task's work; they are fixed at creation."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self.manifests = Manifests(spark, root)

    @classmethod
    def create(cls, spark: SparkSession, root: str, schema: T.StructType, keys: list[str], buckets: int = 64) -> StateTable:
        t = cls(spark, root)
        t.manifests.put(1, {"keys": keys, "buckets": buckets, "schema": schema.jsonValue(), "folders": {}})
        return t

    def _state(self) -> tuple[int, dict]:
        number, m = self.manifests.latest()
        if m is None:
            raise ValueError(f"there is no state table in {self.root}")
        return number, m

    def _rows(self, m: dict, buckets: list[int] | None = None) -> DataFrame:
        """Rows of some buckets (null: all): a scan for each folder that holds some of them, of these partitions only."""
        schema = T.StructType.fromJson(m["schema"])
        wanted: dict[str, list[int]] = {}
        for b, folder in m["folders"].items():
            if buckets is None or int(b) in buckets:
                wanted.setdefault(folder, []).append(int(b))
        if not wanted:
            return self.spark.createDataFrame([], schema)
        full = T.StructType([*schema.fields, T.StructField("_bucket", T.IntegerType())])
        scans = [self.spark.read.schema(full).parquet(f"{self.root}/{f}").where(F.col("_bucket").isin(bs)) for f, bs in sorted(wanted.items())]
        return reduce(DataFrame.unionByName, scans).select(*schema.names)

    def read(self) -> DataFrame:
        return self._rows(self._state()[1])

    def lookup(self, keys: DataFrame) -> DataFrame:
        """Rows of some keys; their buckets alone are read."""
        _, m = self._state()
        touched = self._touched(keys, m)
        return self._rows(m, touched).join(keys.select(*m["keys"]).distinct(), m["keys"], "left_semi")

    def _bucket(self, m: dict):
        return F.pmod(F.xxhash64(*[F.col(k) for k in m["keys"]]), F.lit(m["buckets"])).cast("int")

    def _touched(self, rows: DataFrame, m: dict) -> list[int]:
        return [r[0] for r in rows.select(self._bucket(m).alias("b")).distinct().collect()]  # at most one for each bucket

    def merge(self, new: DataFrame, how: Merge) -> int:
        """The next state: how(old rows of the touched buckets, new rows). Gives the number of buckets written. Fails with
        Conflict, changing nothing, if another writer was faster."""
        number, m = self._state()
        schema = T.StructType.fromJson(m["schema"])
        touched = self._touched(new, m)
        if not touched:
            return 0
        out = how(self._rows(m, touched), new).select(*[F.col(f.name).cast(f.dataType) for f in schema.fields])
        folder = f"data/{uuid.uuid4().hex}"
        out.withColumn("_bucket", self._bucket(m)).repartition("_bucket").write.partitionBy("_bucket").parquet(f"{self.root}/{folder}")
        self.manifests.put(number + 1, m | {"folders": m["folders"] | {str(b): folder for b in touched}})
        return len(touched)

    def vacuum(self) -> None:
        """Forgets older states, and deletes the folders that the current one does not name."""
        number, m = self._state()
        used = set(m["folders"].values())
        old = [(n, self.manifests.load(n)) for n in self.manifests.numbers() if n < number]
        for n, _ in old:
            self.manifests.forget(n)
        for folder in {f for _, o in old for f in o["folders"].values()} - used:
            self.manifests.delete(folder)

    def describe(self) -> str:
        return json.dumps({k: v for k, v in self._state()[1].items() if k != "schema"})
