"""What the training-data operators share: written tables in the shared folder, ASCII text rules."""

from __future__ import annotations

import ctypes
import gc
import os
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The six ASCII white-space characters of the contracts, as a regular-expression class and as text.
WS_CLASS = "[\\x20\\x09-\\x0D]"
WORD = "[^\\x20\\x09-\\x0D]+"
WS_CHARS = " \t\n\x0b\x0c\r"

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. A local one serves only where executors are
    threads of the driver; on a cluster without the setting this raises, as tables on local disks would lose rows."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = f"{tempfile.gettempdir()}/lodestone-shared"
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


#: Rows of an Arrow batch, where the session has Spark's own 10,000: so many long texts would be hundreds of MB, twice.
BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch", "10000", "2000"


def importable(spark: SparkSession) -> None:
    """Lets Python workers that share this file system import the package, wherever the driver was started, and keeps the
    batches that they get small."""
    if spark.conf.get(BATCH[0], BATCH[1]) == BATCH[1]:
        spark.conf.set(BATCH[0], BATCH[2])
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    env = spark.sparkContext.environment
    if root not in env.get("PYTHONPATH", "").split(":"):
        env["PYTHONPATH"] = ":".join(filter(None, [root, env.get("PYTHONPATH")]))


class Scratch:
    """Intermediate tables of one run, written as Parquet to the shared folder so that a lost executor loses none.

    ``keep`` writes a table and returns it reread; ``drop`` deletes tables that no later step reads. Tables that
    the returned lazy result still reads stay until the folder is cleared.
    """

    def __init__(self, spark: SparkSession):
        importable(spark)
        self.spark, self.root, self.n = spark, f"{shared_dir(spark)}/lodestone-{uuid.uuid4().hex}", 0

    def keep(self, df: DataFrame, name: str = "t", *by: str) -> DataFrame:
        """``by`` names columns that get a folder for each value, so reading one value reads its files alone."""
        self.n += 1
        path = f"{self.root}/{self.n:03d}-{name}"
        (df.write.partitionBy(*by) if by else df.write).parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._kept_at = path
        return out

    def drop(self, *tables: DataFrame) -> None:
        jvm = self.spark.sparkContext._jvm
        for t in tables:
            path = jvm.org.apache.hadoop.fs.Path(t._kept_at)
            path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_or_empty(col: str) -> Column:
    return F.coalesce(F.col(col).cast("string"), F.lit(""))


def without_space(text: Column) -> Column:
    """The text without its ASCII white space: byte replacement, no regular expression."""
    for c in WS_CHARS:
        text = F.replace(text, F.lit(c), F.lit(""))
    return text


def ascii_lower(text: Column) -> Column:
    """Lower-cases A-Z alone.

    lower() has a fast path and does the same wherever the characters beyond ASCII have no upper case among them;
    only other texts take the slower translate().
    """
    beyond = F.regexp_replace(text, "[\\x00-\\x7F]+", "")
    return (
        F.when(F.octet_length(text) == F.char_length(text), F.lower(text))
        .when(F.lower(beyond) == beyond, F.lower(text))
        .otherwise(F.translate(text, _UPPER, _LOWER))
    )


def strip_space(text: Column) -> Column:
    return F.btrim(text, F.lit(WS_CHARS))


def fresh(name: str, *frames: DataFrame) -> str:
    """A column name that none of the frames has, whatever the case: ``name``, lengthened as needed."""
    taken = {c.lower() for f in frames for c in f.columns}
    while name.lower() in taken:
        name += "_"
    return name


def give_back() -> None:
    """Returns freed memory to the system."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def trimmed(run):
    """Wraps the function of a mapInArrow: at its end the worker gives freed memory back, as it will be used again. What
    these functions hold has no cycles, so Python needn't look for any while they run."""

    def wrapped(batches):
        gc.disable()
        try:
            yield from run(batches)
        finally:
            gc.enable()
        give_back()

    return wrapped


def join_hot(left: DataFrame, heads: DataFrame, on: str | list[str], count: str, total: int, parts: int = 1000) -> DataFrame:
    """left join heads on ``on``, where heads has one row per key and ``count`` says how many rows of left have it.

    Keys with more than a ``parts``-th of all ``total`` rows, of which there are fewer than ``parts``, are broadcast, so
    the shuffled join holds none of their rows. ``heads`` should be a written table, as it is read three times.
    """
    on = [on] if isinstance(on, str) else on
    hot = F.col(count) > max(1000, total // parts)
    few = F.broadcast(heads.where(hot))
    if not heads.where(hot).limit(1).count():
        return left.join(heads, on)
    cold = left.join(F.broadcast(heads.where(hot).select(*on)), on, "left_anti").join(heads.where(~hot), on)
    return left.join(few, on).unionByName(cold)


def small(df: DataFrame, rows: int = 100_000, size: int = 256 << 20) -> DataFrame:
    """Marks a written table for broadcast if it has at most ``rows`` rows and its files at most ``size`` bytes; a larger
    one is left to a shuffled join."""
    files = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows and (files <= size or rows <= 1000) else df


def by_hash(df: DataFrame, n: int, *cols: str) -> DataFrame:
    """At most n rows, those with the smallest hashes of ``cols``, the same at every run.

    A threshold on the hash leaves few more than n rows before they are ordered, so tasks send little to the merge.
    """
    total, h = df.count(), F.xxhash64(F.lit("sample"), *cols)
    if total > 2 * n:
        df = df.where(F.pmod(h, F.lit(1 << 31)) < int(1.5 * n / total * (1 << 31)))
    return df.orderBy(F.pmod(h, F.lit(1 << 31)), *cols).limit(n)
