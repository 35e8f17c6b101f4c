"""Incremental pull: new items and flag changes flow from the master's folders into a local index."""

from __future__ import annotations

import hashlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.ids import shard as shard_of
from ..operators.inverted import StoredIndex
from ..session import delete, exists, folders, touch
from ..sources.catalog import CHANGES, ITEMS, Master, last_ids, resolved

def batch_names(checkpoint: str) -> Callable[[int], str]:
    """Names of a stream's micro-batches: a batch that is replayed has its name again, and no other stream has it."""
    stream = hashlib.sha1(checkpoint.encode()).hexdigest()[:16]
    return lambda n: f"s{stream}-{n}"


def stream_postings(index: StoredIndex, posts: DataFrame, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Writes a stream of (item, word) pairs to an index. An item's words come in one micro-batch, as those of an item that
    is there are left out. With ``once`` it takes what is there and stops."""
    name = batch_names(checkpoint)
    writer = posts.writeStream.option("checkpointLocation", checkpoint).foreachBatch(lambda rows, n: index.add(rows, name(n)))
    return (writer.trigger(availableNow=True) if once else writer).start()


STATE = "last_seq long, last_commit long, at timestamp"


class LocalIndex:
    """One node's copy of a shard: items and changes pulled so far, and how far that is.

    Reading resolves flags by the last commit. Writing is append-only and each batch leaves out what is there, so a
    batch that is replayed after a failure changes nothing.
    """

    def __init__(self, spark: SparkSession, root: str, shard: str | list[str] | None = None):
        self.spark, self.root, self.shard = spark, root, shard

    def _versions(self) -> list[int]:
        """Numbers of the versions that are whole: each but the first ends with a marker, written after all its tables."""
        names = folders(self.spark, self.root)
        return sorted(int(n[1:]) for n in names if n[:1] == "v" and n[1:].isdigit() and exists(self.spark, f"{self.root}/{n}/_whole"))

    @property
    def base(self) -> str:
        """The folder of the last whole version."""
        found = self._versions()
        return f"{self.root}/v{found[-1]}" if found else f"{self.root}/v0"

    def vacuum(self) -> None:
        """Rewrites the index in few files, with each item's last flag alone. The new version counts from the moment its
        marker is there, so a failure on the way leaves the old one as it was."""
        old, n = self.base, max([0, *self._versions()]) + 1
        new = f"{self.root}/v{n}"
        delete(self.spark, new)
        self.items().select(*[c.split()[0] for c in ITEMS.split(", ")]).repartition("bucket").sortWithinPartitions("seq").write.parquet(f"{new}/items")
        seq, commit = self.cursors()
        self._state(seq, commit).write.parquet(f"{new}/state")
        touch(self.spark, f"{new}/_whole")
        delete(self.spark, old)

    def drop(self) -> None:
        delete(self.spark, self.root)

    def _state(self, seq: int, commit: int) -> DataFrame:
        return self.spark.range(1).select(F.lit(seq).cast("long").alias("last_seq"), F.lit(commit).cast("long").alias("last_commit"), F.current_timestamp().alias("at")).coalesce(1)

    def _table(self, name: str, schema: str) -> DataFrame:
        path = f"{self.base}/{name}"
        return self.spark.read.schema(schema).parquet(path) if exists(self.spark, path) else self.spark.createDataFrame([], schema)

    def items(self) -> DataFrame:
        return resolved(self._table("items", ITEMS), self._table("changes", CHANGES))

    def cursors(self) -> tuple[int, int]:
        row = self._table("state", STATE).agg(F.coalesce(F.max("last_seq"), F.lit(-1)), F.coalesce(F.max("last_commit"), F.lit(-1))).first()
        return row[0], row[1]

    def append_items(self, rows: DataFrame) -> None:
        rows = rows if self.shard is None else rows.where(shard_of(F.col("item_id"), self.shard))
        known = self._table("items", ITEMS).select("item_id")
        rows.dropDuplicates(["item_id"]).join(known, "item_id", "left_anti").select(*[c.split()[0] for c in ITEMS.split(", ")]).write.mode("append").parquet(f"{self.base}/items")

    def append_changes(self, rows: DataFrame) -> None:
        rows = rows if self.shard is None else rows.where(shard_of(F.col("item_id"), self.shard))
        known = self._table("changes", CHANGES).select("item_id", "commit_id")
        rows.select("item_id", "flag", "commit_id").distinct().join(known, ["item_id", "commit_id"], "left_anti").select("item_id", "flag", "commit_id").write.mode("append").parquet(f"{self.base}/changes")

    def pull(self, master: Master) -> None:
        """New items, then flag changes, up to one snapshot of the master's largest numbers."""
        seq, commit = self.cursors()
        top_seq, top_commit = last_ids(master.items(), master.changes())
        self.append_items(master.new_items(seq, top_seq, self.shard))
        self.append_changes(master.new_changes(commit, top_commit, self.shard))
        self._state(top_seq, top_commit).write.mode("append").parquet(f"{self.base}/state")

    def pull_stream(self, master: Master, checkpoint: str, once: bool = True, also: Callable[[DataFrame, str], None] | None = None) -> list[StreamingQuery]:
        """The same as two file streams. With ``once`` each takes what is there and stops.

        ``also`` gets each micro-batch's items of this shard as well, with a name that a replay of the batch has again.
        """
        batch = batch_names(checkpoint)

        def take_items(rows: DataFrame, n: int) -> None:
            self.append_items(rows)
            if also is not None:
                also(rows if self.shard is None else rows.where(shard_of(F.col("item_id"), self.shard)), batch(n))

        out = []
        for name, schema, path, take in (("items", ITEMS, master.items_path, take_items), ("changes", CHANGES, master.changes_path, lambda rows, _: self.append_changes(rows))):
            writer = self.spark.readStream.schema(schema).parquet(path).writeStream.option("checkpointLocation", f"{checkpoint}/{name}")
            writer = writer.foreachBatch(take)
            out.append((writer.trigger(availableNow=True) if once else writer).start())
            if once:
                out[-1].awaitTermination()
        return out
