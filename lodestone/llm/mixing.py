"""Mixing sources to target weights by hash-threshold histograms, in DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import WS_CHARS, Scratch, small, text_or_empty

#: Bits of the 60-bit hash that each histogram resolves. 28 bits bring a source of 10^10 documents to 40 in its boundary bucket.
LEVELS = (12, 16, 32)


def word_count(text):
    """Words of a text: the pieces between runs of ASCII white space."""
    inner = F.btrim(text, F.lit(WS_CHARS))
    return F.when(inner == "", F.lit(0)).otherwise(F.size(F.split(inner, "[\\x20\\x09-\\x0D]+"))).cast("long")


def targets(sizes: DataFrame, share: float = 1.5, most: float = 2.0, weights: tuple[int, ...] = (3, 1, 2)) -> DataFrame:
    """Words that each source is to give: ``sizes`` (source, source_size) plus ``target``.

    The sources share ``share`` times all words by weight; none gives more than ``most`` times its own, and what it
    can't give is shared again by weight. Sorted by most * size / weight, the sources that stop form a prefix, so
    one running sum over the sources finds them all. Sources are ordered by code point, null last.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    pick = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights))) + 1).cast("int"))
    x = sizes.withColumn("w_", pick).withColumn("cap_", F.col("source_size") * F.lit(float(most)))
    by_cap = Window.orderBy((F.col("cap_") / F.col("w_")).asc(), F.col("source").asc_nulls_last())
    before, after = by_cap.rowsBetween(Window.unboundedPreceding, -1), by_cap.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    x = x.withColumn("all_", F.sum("source_size").over(Window.partitionBy()) * F.lit(float(share)))
    level = (F.col("all_") - F.coalesce(F.sum("cap_").over(before), F.lit(0.0))) / F.sum("w_").over(after)
    x = x.withColumn("level_", level).withColumn("stops_", F.col("cap_") <= F.col("level_") * F.col("w_"))
    # the first source that doesn't stop fixes the level of all after it; the later ones would have lower levels
    x = x.withColumn("level_", F.max(F.when(~F.col("stops_"), F.col("level_"))).over(Window.partitionBy()))
    return x.select("source", "source_size", F.when(F.col("stops_"), F.col("cap_")).otherwise(F.least(F.col("cap_"), F.col("level_") * F.col("w_"))).alias("target"))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", share: float = 1.5, most: float = 2.0, weights: tuple[int, ...] = (3, 1, 2)) -> DataFrame:
    """One row per document: size, source_size, target and the words that the mix takes of it.

    Every document gives its words floor(target / source size) times. What is left of the budget goes to documents
    with the smallest hashes: words are summed by source and hash bucket, the running sum shows the last bucket that
    fits whole and the boundary bucket, and only the boundary bucket is summed again by the next bits of the hash.
    The thresholds are nested, so a larger budget takes a superset. No document list is sorted or collected; each
    histogram has at most 2^bits rows a source and is pre-aggregated before it is shuffled. The narrow table
    (id, source, size, hash) is written once to the shared folder, so each histogram reads no text.

    Null text has size 0 and a null source is a source of its own; a null id is hashed like a value. Rows that
    repeat an id share a hash and are taken or left together. Sources without words get target 0. Extra columns are
    ignored. An empty table gives an empty one. The hash is of the id alone: reruns agree.
    """
    work = Scratch(docs.sparkSession)
    bits = F.conv(F.substring(F.md5(F.coalesce(F.col(id_col).cast("string"), F.lit("null"))), 1, 15), 16, 10).cast("long")
    narrow = work.keep(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(source_col).cast("string").alias("source"), word_count(text_or_empty(text_col)).alias("size"), bits.alias("h_")), "sizes")
    goals = targets(narrow.groupBy("source").agg(F.sum("size").alias("source_size")), share, most, weights)
    goals = goals.withColumn("times_", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)))
    goals = work.keep(goals.withColumn("rest_", F.col("target") - F.col("times_") * F.col("source_size")), "goals")

    found = goals.select("source", "rest_", F.lit(0).cast("long").alias("below_"), F.lit(0).cast("long").alias("low_"))
    left, width = narrow, 60
    for level, n in enumerate(LEVELS):
        width -= n
        size = 1 << width
        inside = left
        if level:  # only the rows of the boundary bucket
            edge = small(found.select(F.col("source").alias("s_"), "low_"))
            inside = left.join(edge, F.col("source").eqNullSafe(F.col("s_")) & (F.col("h_") >= F.col("low_")) & (F.col("h_") < F.col("low_") + F.lit(size << n))).drop("s_", "low_")
        hist = inside.groupBy("source", F.expr(f"h_ div {size}").alias("bucket_")).agg(F.sum("size").alias("words_"))
        run = hist.withColumn("upto_", F.sum("words_").over(Window.partitionBy("source").orderBy("bucket_").rowsBetween(Window.unboundedPreceding, Window.currentRow)))
        run = run.join(small(found.select(F.col("source").alias("s_"), "rest_", "below_")), F.col("source").eqNullSafe(F.col("s_")))
        over = run.where(F.col("below_") + F.col("upto_") > F.col("rest_"))
        first = over.groupBy("source", "rest_").agg(F.min("bucket_").alias("bucket_"), F.min(F.col("below_") + F.col("upto_") - F.col("words_")).alias("below_"))
        found = work.keep(first.select("source", "rest_", "below_", (F.col("bucket_") * F.lit(size)).alias("low_")), f"edge{level}")
    # hashes below the last boundary fit; a source without a boundary fits whole, and then nothing is left over
    edge = small(found.select(F.col("source").alias("s_"), "low_"))
    goals_ = small(goals.select(F.col("source").alias("g_"), "source_size", "target", "times_", "rest_"))
    out = narrow.join(goals_, F.col("source").eqNullSafe(F.col("g_"))).join(edge, F.col("source").eqNullSafe(F.col("s_")), "left")
    more = F.when(F.col("rest_") <= 0, F.lit(0)).when(F.col("low_").isNull() | (F.col("h_") < F.col("low_")), F.lit(1)).otherwise(F.lit(0))
    return out.select("doc_id", "source", "size", "source_size", "target", (F.col("size") * (F.col("times_") + more)).cast("long").alias("taken"), (F.col("times_") + more).cast("int").alias("times"))


ORACLE = r"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
                  ('0x' || substr(md5(coalesce(doc_id::VARCHAR, 'null')), 1, 15))::BIGINT AS h FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT *, [3.0e0, 1.0e0, 2.0e0][((row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 + 1)::INT] AS w, source_size * 2.0e0 AS cap FROM s),
c AS (SELECT *, (sum(source_size) OVER () * 1.5e0 - coalesce(sum(cap) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0e0))
                 / sum(w) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM w),
m AS (SELECT *, max(CASE WHEN cap > level * w THEN level END) OVER () AS flat FROM c),
t AS (SELECT source, source_size, CASE WHEN cap <= level * w THEN cap ELSE least(cap, flat * w) END AS target FROM m),
u AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END AS times FROM t)
SELECT d.doc_id, d.size, u.source_size, u.target,
       (d.size * (u.times + CASE WHEN u.target - u.times * u.source_size > 0
           AND sum(d.size) OVER (PARTITION BY d.source ORDER BY d.h RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) <= u.target - u.times * u.source_size THEN 1 ELSE 0 END))::BIGINT AS taken
FROM d JOIN u ON d.source IS NOT DISTINCT FROM u.source
"""
