"""Audit of how filters interact: every order of five filters is replayed over the documents' flags, in DataFrame
operations only."""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD, Scratch, text_or_empty

#: Fixed by the contract: the symbols of filter D and the thresholds of filters A to C.
SYMBOLS = "#$%&*|"
LEAST_WORDS, LEAST_DISTINCT, MOST_UPPER = 50, 65, 5

FILTERS = "ABCDE"
_NO_CAPITALS = "[^A-Z]+"


def text_flags(text: Column) -> list[Column]:
    """Whether a text fails the filters A to D, which need the text alone."""
    words = F.regexp_extract_all(text, F.lit(WORD), F.lit(0))
    n = F.size(words)
    capitals = F.length(F.regexp_replace(text, _NO_CAPITALS, ""))
    symbol = F.contains(text, F.lit(SYMBOLS[0]))
    for s in SYMBOLS[1:]:
        symbol = symbol | F.contains(text, F.lit(s))
    return [n < LEAST_WORDS, 100 * F.size(F.array_distinct(words)) < LEAST_DISTINCT * n, 100 * capitals > MOST_UPPER * F.length(text), symbol]


def flagged(docs: DataFrame, labels: DataFrame, work: Scratch, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source") -> DataFrame:
    """One row per row of ``docs``: part, mask (bit i is set if the row fails the i-th of FILTERS), good and toxic.

    Texts are read once and never shuffled: what is written of a row is its id, its part, four bits and the digest of
    its text. Filter E compares digests. The smallest id of each digest comes from a partial aggregation; it comes back
    to the rows by a join whose key has the id as well, as only the row with the smallest id, or its repeats, stay
    unmarked: so a text with very many copies makes no large group.
    """
    text = F.col("text_")
    base = docs.select(F.col(id_col).cast("long").alias("id_"), F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part_"), text_or_empty(text_col).alias("text_"))
    bits = sum((F.when(f, 1 << i).otherwise(0) for i, f in enumerate(text_flags(text))), F.lit(0))
    rows = work.keep(base.select("id_", "part_", bits.cast("int").alias("mask_"), F.unhex(F.sha2(text, 256)).alias("digest_")), "flags")

    firsts = rows.where("id_ is not null").groupBy("digest_").agg(F.min("id_").alias("id_"), F.lit(True).alias("first_"))
    marks = labels.select(F.col("doc_id").cast("long").alias("id_"), (F.col("quality") == 1).alias("good_"), (F.col("toxic") == 1).alias("toxic_"))
    marks = marks.where("id_ is not null and (good_ or toxic_)").groupBy("id_").agg(F.coalesce(F.max("good_"), F.lit(False)).alias("good_"), F.coalesce(F.max("toxic_"), F.lit(False)).alias("toxic_"))
    copies = F.when(F.col("first_").isNull(), 1 << FILTERS.index("E")).otherwise(0)
    known = rows.where("id_ is not null").join(firsts, ["id_", "digest_"], "left").join(marks, "id_", "left")
    known = known.select("part_", (F.col("mask_") + copies).alias("mask_"), F.coalesce("good_", F.lit(False)).alias("good_"), F.coalesce("toxic_", F.lit(False)).alias("toxic_"))
    return known.unionByName(rows.where("id_ is null").select("part_", "mask_", F.lit(False).alias("good_"), F.lit(False).alias("toxic_")))


def orders(docs: DataFrame, filters: str = FILTERS) -> DataFrame:
    """All orders of the filters: order_ (a number), filter_order and bits_, the bits of the filters in their order. A
    table of a fixed size: 120 rows for five filters."""
    all_orders = ["".join(p) for p in permutations(filters)]
    rows = [(k, name, [1 << filters.index(c) for c in name]) for k, name in enumerate(all_orders)]
    return docs.sparkSession.createDataFrame(rows, "order_ int, filter_order string, bits_ array<int>")


def replay(flags: DataFrame, work: Scratch, filters: str = FILTERS) -> DataFrame:
    """One row per part, order of the filters and step, with the counts of the documents there.

    The documents' flags are crossed with the broadcast orders. In each order a document's first failure is the first
    step whose filter it fails (none: beyond the last step); five steps are exploded, and sums by (part, order, step)
    count what is kept, removed and so on. Tasks combine their own rows first, so the exchange carries a row for each
    task, part, order and step at most, whatever the number of documents and however they are dealt to parts.
    """
    plans = orders(flags, filters)
    n = len(filters)
    mask = F.col("mask_")
    first = F.lit(n + 1)
    for k in reversed(range(n)):
        first = F.when(mask.bitwiseAND(F.col("bits_")[k]) != 0, k + 1).otherwise(first)
    run = flags.crossJoin(F.broadcast(plans.select("order_", "bits_"))).withColumn("first_", first)
    run = run.select("part_", "order_", "first_", "mask_", "good_", "toxic_", F.posexplode("bits_").alias("at_", "bit_")).withColumn("step", F.col("at_") + 1)
    one = lambda c: F.sum(F.when(c, F.lit(1)).otherwise(F.lit(0))).cast("long")
    gone = F.col("step") == F.col("first_")
    counts = run.groupBy("part_", "order_", "step").agg(
        one(F.col("step") < F.col("first_")).alias("kept"), one(gone).alias("removed"),
        one((F.col("step") > F.col("first_")) & (mask.bitwiseAND(F.col("bit_")) != 0)).alias("redundant"), one(mask == F.col("bit_")).alias("unique_fails"),
        one(gone & F.col("good_")).alias("good_lost"), one(gone & F.col("toxic_")).alias("toxic_lost"),
    )
    named = work.keep(counts, "counts").join(F.broadcast(plans.select("order_", "filter_order")), "order_").withColumn("filter_", F.substring("filter_order", F.col("step"), F.lit(1)))
    shares = named.groupBy("part_", "filter_").agg(F.sum("removed").alias("shapley"))
    out = named.join(shares, ["part_", "filter_"])
    return out.select(F.col("part_").alias("part"), "filter_order", F.col("step").cast("int").alias("step"), "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


def interactions(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source") -> DataFrame:
    """What each filter removes in every order of the five: part, filter_order, step, kept, removed, redundant,
    unique_fails, good_lost, toxic_lost and shapley (the removals of the step's filter, summed over all orders).

    Null and empty texts have no words and fail A alone (E too, where a smaller id has one). A null source is the part
    "", as is an empty one. Each row counts, also those that repeat an id; rows with the same id and text are no copies
    of each other. A row with a null id neither fails E nor makes another fail it, and has no labels. Where labels
    repeat an id, one of them that says 1 is enough; null labels say nothing. Extra columns are ignored. An empty table
    gives an empty one.
    """
    work = Scratch(docs.sparkSession)
    return replay(work.keep(flagged(docs, labels, work, id_col, text_col, part_col), "marked"), work)


ORACLE = r"""
WITH d AS MATERIALIZED (
  SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
l AS (SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY doc_id),
e AS (SELECT sha256(t) AS h, min(doc_id) AS first FROM d GROUP BY 1),
f AS MATERIALIZED (
  SELECT d.part, coalesce(l.good, false) AS good, coalesce(l.toxic, false) AS toxic,
         len(w) < 50 AS a, 100 * len(list_distinct(w)) < 65 * len(w) AS b, 100 * length(regexp_replace(t, '[^A-Z]+', '', 'g')) > 5 * length(t) AS c,
         regexp_matches(t, '[#$%&*|]') AS s, coalesce(d.doc_id > e.first, false) AS e
  FROM d LEFT JOIN l ON d.doc_id = l.doc_id LEFT JOIN e ON sha256(d.t) = e.h),
n AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
o AS (SELECT a.x || b.x || c.x || d.x || e.x AS filter_order FROM n a, n b, n c, n d, n e
      WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5),
r AS (SELECT f.*, filter_order, list_transform(string_split(filter_order, ''), lambda x: CASE x WHEN 'A' THEN a WHEN 'B' THEN b WHEN 'C' THEN c WHEN 'D' THEN s ELSE e END) AS fails,
             a::INT + b::INT + c::INT + s::INT + e::INT AS n_fails FROM f, o),
p AS (SELECT *, coalesce(list_position(fails, true), 6) AS first FROM r),
k AS (
  SELECT part, filter_order, step, sum((step < first)::INT)::BIGINT AS kept, sum((step = first)::INT)::BIGINT AS removed, sum((step > first AND fails[step])::INT)::BIGINT AS redundant,
         sum((n_fails = 1 AND fails[step])::INT)::BIGINT AS unique_fails, sum((step = first AND good)::INT)::BIGINT AS good_lost, sum((step = first AND toxic)::INT)::BIGINT AS toxic_lost
  FROM p, (SELECT unnest(range(1, 6)) AS step) GROUP BY part, filter_order, step)
SELECT part, filter_order, step::INT AS step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
       (sum(removed) OVER (PARTITION BY part, filter_order[step]))::BIGINT AS shapley FROM k
"""
