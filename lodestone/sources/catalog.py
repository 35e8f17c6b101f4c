"""The master table of an engine and what changes it: Parquet in a folder that all nodes share.

items     seq, item_id, vector (text form), flag, commit_id   append only
changes   item_id, flag, commit_id                            append only; the last commit of an item wins
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..errors import InvalidArguments
from ..functions.ids import shard as shard_of
from ..session import delete, exists

ITEMS = "seq long, item_id string, vector string, flag int, commit_id long, bucket string"
CHANGES = "item_id string, flag int, commit_id long"

#: The bit of flag that marks a deleted item.
DELETED = 1


def table_name(namespace: str, driver: str) -> str:
    if not re.fullmatch(r"[A-Za-z0-9_]*", namespace or ""):
        raise InvalidArguments(f"not a namespace: {namespace!r}")
    return f"{namespace}_{driver}" if namespace else driver


def is_namespace(name: Column) -> Column:
    """What ``table_name`` takes as a namespace, for a column of names."""
    return name.rlike(r"^[A-Za-z0-9_]*\z")


def absent(new: DataFrame, known: DataFrame) -> DataFrame:
    """Rows of ``new`` whose item_id isn't known yet, one each: the one with the smallest seq."""
    first = new.groupBy("item_id").agg(F.min("seq").alias("seq"))
    return new.join(first, ["item_id", "seq"]).dropDuplicates(["item_id"]).join(known.select("item_id"), "item_id", "left_anti")


def resolved(items: DataFrame, changes: DataFrame) -> DataFrame:
    """Items with the flag and commit of their last change."""
    last = changes.groupBy("item_id").agg(F.max_by("flag", "commit_id").alias("f_"), F.max("commit_id").alias("c_"))
    return items.join(last, "item_id", "left").withColumn("flag", F.coalesce("f_", "flag")).withColumn("commit_id", F.coalesce("c_", "commit_id")).drop("f_", "c_")


def last_ids(items: DataFrame, changes: DataFrame) -> tuple[int, int]:
    """The largest seq and commit_id, -1 where there is none."""
    a = items.agg(F.coalesce(F.max("seq"), F.lit(-1))).first()[0]
    return a, changes.agg(F.coalesce(F.max("commit_id"), F.lit(-1))).first()[0]


@dataclass
class Master:
    """One engine's master table. ``bucket`` (the first hexadecimal digit of the id) partitions the files, so shards and
    look-ups read only theirs."""

    spark: SparkSession
    root: str

    @property
    def items_path(self) -> str:
        return f"{self.root}/items"

    @property
    def changes_path(self) -> str:
        return f"{self.root}/changes"

    def create(self) -> None:
        """Makes the empty tables; does nothing where they are."""
        for path, schema in ((self.items_path, ITEMS), (self.changes_path, CHANGES)):
            if not exists(self.spark, path):
                self.spark.createDataFrame([], schema).write.parquet(path)

    def drop(self) -> None:
        delete(self.spark, self.root)

    def items(self) -> DataFrame:
        return self.spark.read.schema(ITEMS).parquet(self.items_path)

    def changes(self) -> DataFrame:
        return self.spark.read.schema(CHANGES).parquet(self.changes_path)

    def insert(self, rows: DataFrame) -> None:
        """Adds (item_id, vector) unless the id is there; an id that is there is undeleted."""
        top, commit = last_ids(self.items(), self.changes())
        rows = rows.select("item_id", "vector").withColumn("seq", F.lit(0).cast("long")).dropDuplicates(["item_id"]).cache()
        known = resolved(self.items(), self.changes())
        fresh = absent(rows, known)
        # numbers follow the partition and the row in it: unique and above all earlier ones, without a global sort
        fresh = fresh.withColumn("seq", F.lit(top + 1) + F.monotonically_increasing_id())
        back = known.join(rows.select("item_id"), "item_id", "left_semi").where(F.col("flag") != 0).select("item_id").cache()
        back.count()
        fresh.select("seq", "item_id", "vector", F.lit(0).alias("flag"), F.lit(None).cast("long").alias("commit_id"), F.substring("item_id", 1, 1).alias("bucket")).write.mode("append").parquet(self.items_path)
        self._commit(back, 0, commit)
        rows.unpersist()
        back.unpersist()

    def remove(self, ids: DataFrame) -> None:
        """Flags items as deleted. Unknown ids, and ids that are deleted already, change nothing."""
        _, commit = last_ids(self.items(), self.changes())
        known = resolved(self.items(), self.changes())
        self._commit(known.join(ids.select("item_id").distinct(), "item_id", "left_semi").where(F.col("flag").bitwiseAND(DELETED) == 0).select("item_id"), DELETED, commit)

    def _commit(self, ids: DataFrame, flag: int, last: int) -> None:
        ids.select("item_id", F.lit(flag).alias("flag"), (F.lit(last + 1) + F.monotonically_increasing_id()).alias("commit_id")).write.mode("append").parquet(self.changes_path)

    def exists(self, ids: DataFrame) -> DataFrame:
        """(item_id, found). Deleted items are found."""
        known = self.items().select("item_id").distinct().withColumn("found_", F.lit(True))
        return ids.select("item_id").join(known, "item_id", "left").select("item_id", F.coalesce("found_", F.lit(False)).alias("found"))

    def vector(self, item_id: str) -> DataFrame:
        """The stored vector of an id, deleted or not."""
        return self.items().where((F.col("bucket") == item_id[:1]) & (F.col("item_id") == item_id)).select("item_id", "vector")

    def vectors(self, ids: DataFrame) -> DataFrame:
        """(item_id, vector) of the stored ids among ``ids``, deleted or not. The buckets join prunes the files read."""
        wanted = ids.select("item_id").distinct().withColumn("bucket", F.substring("item_id", 1, 1))
        return self.items().select("bucket", "item_id", "vector").join(wanted, ["bucket", "item_id"], "left_semi").select("item_id", "vector")

    def new_items(self, after: int, up_to: int, shard: str | list[str] | None = None, limit: int | None = None) -> DataFrame:
        x = self.items().where((F.col("seq") > after) & (F.col("seq") <= up_to))
        x = x if shard is None else x.where(shard_of(F.col("item_id"), shard))
        return x if limit is None else x.orderBy("seq").limit(limit)

    def new_changes(self, after: int, up_to: int, shard: str | list[str] | None = None) -> DataFrame:
        x = self.changes().where((F.col("commit_id") > after) & (F.col("commit_id") <= up_to))
        return x if shard is None else x.where(shard_of(F.col("item_id"), shard))


def numbered(rows: DataFrame, order: list[str], start: int = 0) -> DataFrame:
    """Strictly increasing numbers in an order. One task numbers all rows: for small batches alone."""
    return rows.withColumn("seq", F.row_number().over(Window.orderBy(*order)) + F.lit(start))
