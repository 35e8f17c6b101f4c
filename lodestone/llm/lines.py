"""Line de-duplication over levelled sorted runs of line hashes, in DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, ascii_lower, join_hot, small, strip_space, text_or_empty

KEY = ["a_", "b_"]


def line_keys(text: Column) -> Column:
    """The keys of a text's lines: A-Z lower-cased, ASCII white space stripped at both ends."""
    return F.transform(F.split(ascii_lower(text), "\n"), strip_space)


def digest(key: Column) -> Column:
    """128 bits of a key. Keys are compared by these alone."""
    return F.struct(F.xxhash64(key).alias("a_"), F.xxhash64(F.lit("line"), key).alias("b_"))


class LineRuns:
    """Levelled sorted runs of line keys. Batches come in descending order of ids, so the batch that first shows a key
    holds the largest id with it.

    ``add`` merge-anti-joins a batch with the runs. A key that no run holds is new: it comes in with its count and its
    largest id, which no later batch can change. A key that the runs hold adds its count alone, and nothing once
    ``enough`` documents are counted, so lines on very many documents cost later batches no row. The rows that came in
    form the batch's own sorted run at level 0. ``fanout`` runs of one level are compacted into one of the next, so a
    batch meets at most fanout - 1 runs a level and rows are rewritten once a level. Runs are Parquet in the shared
    folder, hash-partitioned and sorted by key.
    """

    def __init__(self, work: Scratch, enough: int, fanout: int = 4):
        self.work, self.enough, self.fanout, self.levels = work, enough, fanout, [[]]

    def _write(self, rows: DataFrame, level: int) -> DataFrame:
        return self.work.keep(rows.repartition(*KEY).sortWithinPartitions(*KEY), f"run-level{level}")

    @staticmethod
    def _merged(runs: list[DataFrame]) -> DataFrame:
        rows = runs[0]
        for r in runs[1:]:
            rows = rows.unionByName(r)
        return rows.groupBy(*KEY).agg(F.sum("docs_").alias("docs_"), F.max("last_").alias("last_"))

    def runs(self) -> list[DataFrame]:
        return [r for level in self.levels for r in level]

    def add(self, batch: DataFrame) -> DataFrame:
        """Takes a batch of (doc_id, a_, b_), one row per document and key; returns the run that it became."""
        own = batch.groupBy(*KEY).agg(F.count("*").alias("docs_"), F.max("doc_id").alias("last_"))
        if known := self.runs():
            own = self.work.keep(own, "batch")
            held = self._merged(known).select(*KEY, F.col("docs_").alias("held_"))
            fresh = own.join(held, KEY, "left_anti")
            more = own.join(held.where(F.col("held_") < self.enough), KEY).select(*KEY, "docs_", F.lit(None).cast("long").alias("last_"))
            run = self._write(fresh.unionByName(more), 0)
            self.work.drop(own)
        else:
            run = self._write(own, 0)
        self.levels[0].append(run)
        level = 0
        while len(self.levels[level]) >= self.fanout:
            olds, self.levels[level] = self.levels[level], []
            if level + 1 == len(self.levels):
                self.levels.append([])
            self.levels[level + 1].append(self._write(self._merged(olds), level + 1))
            self.work.drop(*olds)
            level += 1
        return run

    def common(self) -> DataFrame:
        """The keys of at least ``enough`` documents, with the largest id among those (null where none has an id)."""
        return self._merged(self.runs()).where(F.col("docs_") >= self.enough)


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_chars: int = 20, least_docs: int = 3, batches: int = 6, fanout: int = 4) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_lines, n_dropped and the text of the lines that stay.

    Keys of at least ``least_chars`` code points found in at least ``least_docs`` documents lose all their lines, except
    those in the largest id that holds the key. The keys of all documents come in ``batches`` by ranges of the id, the
    highest first, and go through ``LineRuns``. Each document then gets the digests that it loses, sorted, and filters its own
    lines by binary search, so lines keep their order, no text is exploded and a document of very many lines takes little
    more than its share. A line common to many documents is counted by partial
    aggregation, and its digest goes back by broadcast (``join_hot``).

    Null and empty texts are one empty line. Rows that repeat an id are one document: a key counts once for them, and
    they keep its lines together. A row with a null id is a document of its own, never holds the last copy and loses
    nothing. Extra columns are ignored. An empty table gives an empty one.
    """
    work = Scratch(docs.sparkSession)
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).alias("text_"))
    ids = base.where(F.col("doc_id").isNotNull()).select("doc_id")
    cuts = ids.select(F.percentile_approx("doc_id", [i / batches for i in range(1, batches)], 1000)).first()[0] or [] if batches > 1 else []
    # distinct as text, which is told apart by hash; structures would be compared one by one
    long_keys = F.filter(line_keys(F.col("text_")), lambda k: F.length(k) >= least_chars)
    rows = base.select("doc_id", F.explode(F.transform(F.array_distinct(long_keys), digest)).alias("k_")).select("doc_id", "k_.*")
    if ids.groupBy("doc_id").count().where("count > 1").limit(1).count():
        rows = rows.where(F.col("doc_id").isNotNull()).distinct().unionByName(rows.where(F.col("doc_id").isNull()))
    # descending: batch 0 has the highest ids, the last one also the rows without an id
    above = sum((F.when(F.col("doc_id") > c, 0).otherwise(1) for c in cuts), F.lit(0))
    keys = work.keep(rows.withColumn("batch_", above.cast("int")), "keys", "batch_")
    runs = LineRuns(work, least_docs, fanout)
    for i in range(len(cuts) + 1):
        runs.add(keys.where(F.col("batch_") == i).drop("batch_"))
    common = runs.common().where(F.col("last_").isNotNull())
    common = work.keep(common.select(*KEY, "last_", "docs_"), "common")
    work.drop(*runs.runs())
    # docs_ stops growing at enough, so how many rows a key has is counted for the join
    held = keys.drop("batch_").join(small(common.select(*KEY)), KEY, "left_semi").groupBy(*KEY).agg(F.count("*").alias("rows_"))
    heads = work.keep(common.drop("docs_").join(held, KEY), "heads")
    lost = join_hot(keys.drop("batch_"), heads, KEY, "rows_", keys.count()).where(F.col("doc_id") < F.col("last_"))
    lost = lost.groupBy("doc_id").agg(F.array_sort(F.collect_set(F.struct(*KEY))).alias("lost_"))
    # rows without an id lose nothing, and there may be many of them: they meet no other row
    x = base.where(F.col("doc_id").isNotNull()).join(lost, "doc_id", "left")
    x = x.unionByName(base.where(F.col("doc_id").isNull()), allowMissingColumns=True)
    lines = F.split("text_", "\n")
    digests = F.transform(line_keys(F.col("text_")), lambda k: F.when(F.length(k) >= least_chars, digest(k)))
    # the steps are bound once a document
    drops = F.transform(F.array(halves(F.size("lost_"))), lambda steps: F.zip_with(lines, digests, lambda line, d: F.when(~is_in(d, F.col("lost_"), steps), line)))[0]
    x = x.select("doc_id", F.size(lines).cast("long").alias("n_lines"), F.when(F.col("lost_").isNull(), lines).otherwise(F.filter(drops, lambda s: s.isNotNull())).alias("kept_"))
    return x.select("doc_id", "n_lines", (F.col("n_lines") - F.size("kept_")).cast("long").alias("n_dropped"), F.array_join("kept_", "\n").alias("text"))


def halves(n: Column) -> Column:
    """The powers of two up to n, the largest first: the steps of a binary search in an array of n values."""
    bits = F.ceil(F.log2(F.greatest(n, F.lit(1)) + 1)).cast("int")
    return F.transform(F.sequence(bits - 1, F.lit(0), F.lit(-1)), lambda i: F.call_function("shiftleft", F.lit(1), i))


def is_in(value: Column, ordered: Column, steps: Column) -> Column:
    """Whether a sorted array has a value, false for null: by binary search, as array_contains goes through all of it."""
    at = F.aggregate(steps, F.lit(0), lambda pos, step: F.when(F.get(ordered, pos + step - 1) <= value, pos + step).otherwise(pos))
    return F.coalesce(F.get(ordered, at - 1) == value, F.lit(False))


ORACLE = r"""
WITH d AS MATERIALIZED (SELECT doc_id, row_number() OVER () AS rid, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
l AS (SELECT doc_id, rid, unnest(lines) AS line, unnest(range(len(lines))) AS pos FROM d),
k AS (SELECT *, regexp_replace(translate(line, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g') AS key FROM l),
c AS (SELECT key, max(doc_id) AS last FROM k WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT CASE WHEN doc_id IS NULL THEN 'row ' || rid ELSE doc_id::VARCHAR END) >= 3),
m AS (SELECT k.*, c.key IS NOT NULL AND coalesce(k.doc_id < c.last, false) AS gone FROM k LEFT JOIN c ON k.key = c.key)
SELECT any_value(doc_id) AS doc_id, count(*)::BIGINT AS n_lines, sum(gone::INT)::BIGINT AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256 FROM m GROUP BY rid
"""
