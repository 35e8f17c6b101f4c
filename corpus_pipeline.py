"""The corpus pipeline: stages over documents, each written to the shared folder and reread before the next.

All stages take nulls in any column, empty and very long texts, repeated rows, an empty table, and extra columns of any
name, which all but the last hand on.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm import bpe, exact, jaccard, mixing, quality
from lodestone.llm.common import Scratch, fresh, small, table
from lodestone.llm.queries import vocabulary


def _by_row(docs: DataFrame, work: Scratch) -> tuple[DataFrame, str]:
    """The documents and a column that tells their rows apart: doc_id, or where an id is missing or repeated, numbers in
    the order of the ids, rows without one last."""
    if not docs.groupBy("doc_id").count().where("doc_id is null or count > 1").limit(1).count():
        return docs, "doc_id"
    key = fresh("row_", docs)
    rows = docs.orderBy(F.col("doc_id").asc_nulls_last(), F.xxhash64("text")).withColumn(key, F.monotonically_increasing_id())
    return work.keep(rows, "numbered"), key


def _without(docs: DataFrame, key: str, gone: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose ``key`` isn't in the one column of ``gone``, a written table."""
    name = fresh("gone_", docs)
    gone = small(gone.select(F.col(gone.columns[0]).alias(name)), 1_000_000)
    return docs.join(gone, F.col(key).cast("long") == F.col(name), "left_anti")


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier doesn't reject; it learns from the labels of those given. A null text is
    scored as an empty one."""
    return quality.accepted(docs, quality.train(docs, table(spark, sf_dir, "labels")))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts, the one that ``exact`` keeps; null and empty texts are one group."""
    work = Scratch(spark)
    rows, key = _by_row(docs, work)
    found = work.keep(exact.marked(rows, row_col=key).select("row_", "kept"), "groups")
    return _without(rows, key, found.where("not kept").select("row_")).select(*docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each component of near copies. Where an id is missing or repeated, rows are
    compared by their numbers; documents without words are alone."""
    work = Scratch(spark)
    rows, key = _by_row(docs, work)
    found = work.keep(jaccard.near_duplicates(rows, id_col=key), "components")
    return _without(rows, key, found.where(F.col("doc_id") != F.col("component_id")).select("doc_id")).select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: each document as often as it is taken (not at all, once or twice). A null source is a source; rows that
    repeat an id are taken alike; a document without words is taken as its id's hash falls."""
    i, s, n, copy = (fresh(c, docs) for c in ("id_", "source_", "times_", "copy_"))
    taken = mixing.mix(docs).where("times > 0").select(F.col("doc_id").alias(i), F.col("source").alias(s), F.col("times").alias(n)).distinct()
    taken = small(Scratch(spark).keep(taken, "taken"), 1_000_000)
    out = docs.join(taken, F.col("doc_id").cast("long").eqNullSafe(F.col(i)) & F.col("source").eqNullSafe(F.col(s)))
    return out.withColumn(copy, F.explode(F.sequence(F.lit(1), n))).select(*docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The ids of each document, with their count and digests; null and empty texts have no ids."""
    return bpe.digest_columns(bpe.encode(docs, vocabulary()))


STAGES = [
    ("quality classifier", keep_good),
    ("exact dedup", drop_copies),
    ("n-gram Jaccard join", drop_near_copies),
    ("mixing sources to target weights", mix_sources),
    ("BPE encoding and decoding", encode),
]

#: SQL can't express the classifier; the tests hold the stages against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, work = table(spark, sf_dir, "documents"), Scratch(spark)
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = work.keep(docs, f"stage{i + 1}")
    return docs
