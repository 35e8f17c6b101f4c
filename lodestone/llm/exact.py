"""Exact de-duplication by skew-safe combining, in DataFrame operations only."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, join_hot, small, text_or_empty, without_space

_STEP = Decimal(10) ** 20

#: What stands for a content where its groups come together; only a content that shares both is told apart by itself.
KEYS = ["text_sha256", "check_"]


def _digests(content: Column) -> list[Column]:
    return [F.sha2(content, 256).alias(KEYS[0]), F.xxhash64(content).alias(KEYS[1])]


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", salts: int = 32) -> DataFrame:
    """One row per row of ``docs``: its id, the id that its group of equal texts keeps, and the group's size.

    Texts are equal when they are the same without ASCII white space. Three combining steps, each keyed by the
    digests *and the whole content*, so that equal digests of different contents never merge: each task combines
    its own rows (partial aggregation), salted digest groups are merged, then the salts' winners. A group's winner
    is its longest original text, then its smallest id. It travels as one fixed-width decimal, length * 10^20 - id,
    so all steps are hash aggregations. A hot group costs at most one row per task, then one per salt.

    Winners go back to their rows by digests. How many contents have the same digests is counted first; where there
    are several, their rows find the winner by the whole content. Winners of more than a thousandth of all rows are
    broadcast, so no task of the join holds such a group.

    Null text counts as empty and all empty texts are one group; a null id loses ties to any other id, and a group
    of null ids keeps null. Of rows that repeat the winner's id and text one is kept. Extra columns are ignored. An
    empty table gives an empty one.
    """
    return marked(docs, id_col, text_col, salts).drop("row_")


def marked(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", salts: int = 32, row_col: str | None = None) -> DataFrame:
    """The rows of ``exact_groups`` with row_, a number that tells the rows of ``docs`` apart: ``row_col``, if given."""
    work = Scratch(docs.sparkSession)
    text = text_or_empty(text_col)
    row = F.col(row_col).cast("long") if row_col else F.monotonically_increasing_id()
    base = docs.select(row.alias("row_"), F.col(id_col).cast("long").alias("doc_id"), F.length(text).alias("len_"), without_space(text).alias("content_"))
    base = base.select("*", *_digests(F.col("content_")))
    lose = F.coalesce(F.col("doc_id").cast("decimal(20,0)"), F.lit(Decimal(2**63)))
    win = F.col("len_").cast("decimal(10,0)") * F.lit(_STEP) - lose
    local = base.select(*KEYS, "content_", "len_", win.cast("decimal(38,0)").alias("win_"), F.pmod(F.xxhash64("doc_id", "len_"), F.lit(salts)).alias("salt_"))
    salted = local.groupBy(*KEYS, "content_", "salt_").agg(F.max("win_").alias("win_"), F.max("len_").alias("len_"), F.count("*").alias("n_"))
    groups = salted.groupBy(*KEYS, "content_").agg(F.max("win_").alias("win_"), F.max("len_").alias("len_"), F.sum("n_").alias("n_"))
    best = F.col("len_").cast("decimal(10,0)") * F.lit(_STEP) - F.col("win_")
    winner = [F.when(best < F.lit(Decimal(2**63)), best.cast("long")).alias("keep_id"), F.col("len_").alias("keep_len_"), F.col("n_").alias("group_size")]
    heads = groups.groupBy(*KEYS).agg(F.count("*").alias("contents_"), F.max("win_").alias("win_"), F.max("len_").alias("len_"), F.sum("n_").alias("n_"))
    heads = work.keep(heads.select(*KEYS, "contents_", *winner), "winners")
    narrow = work.keep(base.drop("content_"), "digests")

    found = join_hot(narrow, heads.where("contents_ = 1").drop("contents_"), KEYS, "group_size", narrow.count())
    found = found.select("row_", "doc_id", "len_", F.lit(0).cast("long").alias("which_"), *KEYS, "keep_id", "keep_len_", "group_size")
    clashes = heads.where("contents_ > 1").select(*KEYS)
    if clashes.limit(1).count():
        clashes = small(clashes)
        own = work.keep(groups.join(clashes, KEYS).select(*KEYS, "content_", F.monotonically_increasing_id().alias("which_"), *winner), "clashes")
        found = found.unionByName(base.join(clashes, KEYS).join(own, [*KEYS, "content_"]).select(*found.columns))
    found = work.keep(found.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("len_") == F.col("keep_len_"))), "found")

    # rows that repeat a winner: the one with the smallest number stays
    twice = found.where(F.col("kept") & (F.col("group_size") > 1)).groupBy(*KEYS, "which_").agg(F.count("*").alias("times_"), F.min("row_").alias("first_"))
    twice = twice.where("times_ > 1").drop("times_")
    if twice.limit(1).count():
        found = found.join(small(work.keep(twice, "repeated"), 1_000_000), [*KEYS, "which_"], "left")
        found = found.withColumn("kept", F.col("kept") & (F.col("first_").isNull() | (F.col("first_") == F.col("row_"))))
    return found.select("row_", "doc_id", "keep_id", "group_size", "kept", "text_sha256")


ORACLE = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS c FROM documents),
r AS (SELECT *, row_number() OVER (PARTITION BY c ORDER BY length(t) DESC, doc_id NULLS LAST) AS place, count(*) OVER (PARTITION BY c) AS group_size,
             first_value(doc_id) OVER (PARTITION BY c ORDER BY length(t) DESC, doc_id NULLS LAST) AS keep_id FROM d)
SELECT doc_id, keep_id, group_size, place = 1 AS kept, sha256(c) AS text_sha256 FROM r
"""
