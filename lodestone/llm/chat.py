"""Chat formatting: logged snapshots of a conversation collapse into the longest, which is then rendered."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, small


#: What opens and closes a turn. In roles and texts they are written with a blank after "<", so no text forges a turn.
START, END = "<|im_start|>", "<|im_end|>"


def _order() -> list[Column]:
    return [F.col("turn").asc_nulls_first(), F.col("role").asc_nulls_first(), F.col("md5_").asc_nulls_first()]


def maximal(turns: DataFrame) -> DataFrame:
    """(conv_id, n_turns, text_): the conversations that are no snapshot of another one. text_ is null but for turns
    without a conv_id, each of which is a conversation of its own: there it is the rendered turn.

    Each turn's role and text are hashed once to 128 bits; only hashes are sorted and summed. With the position they give
    a turn's share of the running XOR, the hash of the conversation up to that turn, so prefixes are compared by length
    and hash. A conversation whose whole hash is a proper prefix of another goes (anti-join with the distinct prefixes);
    of equal ones the smallest conv_id stays, null last.

    Turns are ordered by turn, role and the MD5 of the text, nulls first, and a null role or text differs from an empty
    one. Repeated rows are turns of their own. Extra columns are ignored. An empty table gives an empty one.
    """
    part = lambda salt: F.xxhash64(F.lit(salt), F.col("role").isNull(), F.col("role"), F.col("text").isNull(), F.col("text"))
    x = turns.select("conv_id", "turn", "role", "text", part("a").alias("a_"), part("b").alias("b_"))
    of = x.where(F.col("conv_id").isNotNull()).select("conv_id", "turn", "role", F.md5("text").alias("md5_"), "a_", "b_")
    w = Window.partitionBy("conv_id").orderBy(*_order())
    up_to, whole = w.rowsBetween(Window.unboundedPreceding, Window.currentRow), Window.partitionBy("conv_id")
    placed = lambda h: F.bit_xor(F.xxhash64("k_", h)).over(up_to).alias(h)
    of = of.withColumn("k_", F.row_number().over(w)).select("conv_id", "k_", placed("a_"), placed("b_"), F.count("*").over(whole).alias("n_"))
    ends = of.where(F.col("k_") == F.col("n_")).select("k_", "a_", "b_", "conv_id", F.lit(None).cast("string").alias("text_"))
    one = x.where(F.col("conv_id").isNull()).withColumn("k_", F.lit(1))
    ends = ends.unionByName(one.select("k_", F.xxhash64("k_", "a_").alias("a_"), F.xxhash64("k_", "b_").alias("b_"), "conv_id", turn_text(F.col("role"), F.col("text")).alias("text_")))
    ends = ends.groupBy("k_", "a_", "b_").agg(F.min("conv_id").alias("conv_id"), F.min("text_").alias("text_"))
    starts = of.where(F.col("k_") < F.col("n_")).select("k_", "a_", "b_").distinct()
    kept = ends.join(starts, ["k_", "a_", "b_"], "left_anti")
    return kept.select("conv_id", F.col("k_").cast("long").alias("n_turns"), F.when(F.col("conv_id").isNull(), F.col("text_")).alias("text_"))


def turn_text(role: Column, text: Column) -> Column:
    """One turn in chat markup, a null role or text as empty, markers in them made harmless."""
    plain = lambda c: F.replace(F.replace(F.coalesce(c, F.lit("")), F.lit(START), F.lit("< |im_start|>")), F.lit(END), F.lit("< |im_end|>"))
    return F.concat(F.lit(START), plain(role), F.lit("\n"), plain(text), F.lit(END + "\n"))


def render(turns: DataFrame) -> DataFrame:
    """One row per maximal conversation: conv_id, n_turns and the text in chat markup.

    Text is shuffled once, for the conversations that stay. ``maximal`` says what nulls, ties and repeated rows do.
    """
    work = Scratch(turns.sparkSession)
    keep = work.keep(maximal(turns), "maximal")
    k = keep.where(F.col("conv_id").isNotNull()).select(F.col("conv_id").alias("c_"), "n_turns")
    x = turns.select("conv_id", "turn", "role", F.md5("text").alias("md5_"), turn_text(F.col("role"), F.col("text")).alias("said_"))
    x = x.join(small(k, 1_000_000), F.col("conv_id") == F.col("c_"))
    x = x.groupBy("conv_id", "n_turns").agg(F.sort_array(F.collect_list(F.struct("turn", "role", "md5_", "said_"))).alias("t_"))
    x = x.select("conv_id", "n_turns", F.array_join(F.transform("t_", lambda t: t["said_"]), "").alias("text"))
    return x.unionByName(keep.where(F.col("conv_id").isNull()).select("conv_id", "n_turns", F.col("text_").alias("text")))


ORACLE = r"""
WITH r AS (SELECT *, row_number() OVER () AS rid FROM conversations),
s AS (SELECT *, replace(replace(coalesce(role, ''), '<|im_start|>', '< |im_start|>'), '<|im_end|>', '< |im_end|>') AS role_,
             replace(replace(coalesce(text, ''), '<|im_start|>', '< |im_start|>'), '<|im_end|>', '< |im_end|>') AS text_ FROM r),
t AS (SELECT conv_id, CASE WHEN conv_id IS NULL THEN rid END AS rid, row_number() OVER w AS k, concat('<|im_start|>', role_, chr(10), text_, '<|im_end|>', chr(10)) AS s,
             to_json([role, text]) AS j
      FROM s WINDOW w AS (PARTITION BY conv_id, CASE WHEN conv_id IS NULL THEN rid END ORDER BY turn NULLS FIRST, role NULLS FIRST, md5(text) NULLS FIRST)),
p AS (SELECT conv_id, rid, k, count(*) OVER (PARTITION BY conv_id, rid) AS n, string_agg(j, chr(10)) OVER (PARTITION BY conv_id, rid ORDER BY k) AS upto,
             string_agg(s, '') OVER (PARTITION BY conv_id, rid ORDER BY k) AS said FROM t),
e AS (SELECT upto, min(conv_id) AS conv_id, min(rid) AS rid FROM p WHERE k = n GROUP BY upto),
m AS (SELECT e.* FROM e WHERE NOT EXISTS (SELECT 1 FROM p WHERE p.k < p.n AND p.upto = e.upto))
SELECT m.conv_id, p.n AS n_turns, sha256(p.said) AS text_sha256
FROM m JOIN p ON p.k = p.n AND CASE WHEN m.conv_id IS NULL THEN p.rid = m.rid ELSE p.conv_id = m.conv_id END
"""
