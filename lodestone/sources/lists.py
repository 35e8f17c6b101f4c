"""Lists of inputs, matrices and results as text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_LABELLED = r"^\s*(-?\d+)\s+(\S.*?)\s*$"


def parse_lines(lines: DataFrame, labelled: bool | None = None, col: str = "value") -> DataFrame:
    """(label, path) of an import list: a path a line, or a number and a path. Unless told, the first line decides."""
    if labelled is None:
        first = lines.where(F.trim(col) != "").first()
        labelled = first is not None and bool(lines.sparkSession.range(1).select(F.lit(first[col]).rlike(_LABELLED)).first()[0])
    rows = lines.where(F.trim(col) != "")
    if labelled:
        return rows.where(F.col(col).rlike(_LABELLED)).select(F.regexp_extract(col, _LABELLED, 1).cast("long").alias("label"), F.regexp_extract(col, _LABELLED, 2).alias("path"))
    return rows.select(F.lit(None).cast("long").alias("label"), F.trim(col).alias("path"))


def read_list(spark: SparkSession, path: str, labelled: bool | None = None) -> DataFrame:
    return parse_lines(spark.read.text(path), labelled)


def result_json(item_id: Column, similarity: Column) -> Column:
    return F.to_json(F.struct(item_id.alias("id"), F.struct(similarity.alias("similarity")).alias("value")))


def write_matrix(rows: DataFrame, path: str) -> None:
    """(row, vec) as Parquet."""
    rows.select("row", "vec").write.mode("overwrite").parquet(path)


def read_matrix(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("row int, vec array<double>").parquet(path)


def with_flips(listed: DataFrame) -> DataFrame:
    """A training list with every image twice: as it is, and mirrored left and right."""
    return listed.withColumn("flip", F.explode(F.array(F.lit(False), F.lit(True))))


def with_paths(found: DataFrame, store: DataFrame) -> DataFrame:
    """A search's results with the path that a key-value store (key, value) has for each id; null where it has none.
    Where results are few, Spark sends them to the store's rows."""
    keyed = found.withColumn("key_", F.col("item_id").cast("string"))
    held = store.select(F.col("key").cast("string").alias("key_"), F.col("value").cast("string").alias("path"))
    held = held.join(keyed.select("key_"), "key_", "left_semi")
    return keyed.join(held, "key_", "left").drop("key_")
