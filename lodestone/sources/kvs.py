"""A key-value store over an append-only table; the last version of a key wins.

Each vacuum makes a folder of its own, which counts from the moment its marker is there.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import NoData
from ..session import delete, exists, folders, touch

SCHEMA = "key binary, value binary, ver long"


def latest(log: DataFrame) -> DataFrame:
    """(key, value) of the live keys: the last version of each, unless that deleted it (null value)."""
    last = log.groupBy("key").agg(F.max_by(F.struct("value"), "ver").alias("v_"))
    return last.select("key", "v_.value").where(F.col("value").isNotNull())


class KVS:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        if not exists(spark, f"{path}/v0") and not self._versions():
            spark.createDataFrame([], SCHEMA).write.parquet(f"{path}/v0")

    def _versions(self) -> list[int]:
        return sorted(int(n[1:]) for n in folders(self.spark, self.path) if n[1:].isdigit() and exists(self.spark, f"{self.path}/{n}/_whole"))

    @property
    def _base(self) -> str:
        return f"{self.path}/v{([0] + self._versions())[-1]}"

    def _log(self) -> DataFrame:
        return self.spark.read.schema(SCHEMA).parquet(self._base)

    def _next(self) -> int:
        return self._log().agg(F.coalesce(F.max("ver"), F.lit(-1))).first()[0] + 1

    @staticmethod
    def _bytes(v) -> bytearray | None:
        return None if v is None else bytearray(v.encode() if isinstance(v, str) else v)

    def set(self, key, value) -> None:
        self.set_many([(key, value)])

    def set_many(self, pairs) -> None:
        ver = self._next()
        rows = [(self._bytes(k), self._bytes(v), ver + i) for i, (k, v) in enumerate(pairs)]
        self.spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(self._base)

    def set_all(self, pairs: DataFrame) -> None:
        """Adds a table of (key, value) as one version; keys are distinct."""
        pairs.select(F.col("key").cast("binary").alias("key"), F.col("value").cast("binary").alias("value"), F.lit(self._next()).alias("ver")).write.mode("append").parquet(self._base)

    def get(self, key) -> bytes:
        row = latest(self._log().where(F.col("key") == F.lit(bytes(self._bytes(key))))).first()
        if row is None:
            raise NoData(key)
        return bytes(row.value)

    def delete(self, key) -> None:
        self.set(key, None)

    def clear(self) -> None:
        delete(self.spark, self.path)
        self.spark.createDataFrame([], SCHEMA).write.parquet(f"{self.path}/v0")

    def vacuum(self) -> None:
        """Rewrites the live versions alone, in a new folder; a failure on the way leaves the old one, which goes last."""
        old = self._base
        new = f"{self.path}/v{int(old.rpartition('v')[2]) + 1}"
        delete(self.spark, new)
        latest(self._log()).withColumn("ver", F.lit(0).cast("long")).write.parquet(new)
        touch(self.spark, f"{new}/_whole")
        delete(self.spark, old)

    def items(self) -> DataFrame:
        return latest(self._log())

    def each_pair(self, call: Callable[[bytes, bytes], object]) -> None:
        """Calls for each pair of a snapshot until a call returns something true."""
        for r in self.items().toLocalIterator():
            if call(bytes(r.key), bytes(r.value)):
                return

    def each_key(self, call: Callable[[bytes], object]) -> None:
        self.each_pair(lambda k, _: call(k))

    def each_value(self, call: Callable[[bytes], object]) -> None:
        self.each_pair(lambda _, v: call(v))

    def __iter__(self) -> Iterator[bytes]:
        return (bytes(r.key) for r in self.items().select("key").toLocalIterator())
