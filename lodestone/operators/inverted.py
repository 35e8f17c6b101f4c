"""Inverted index: words of items, document frequency, weights, and search by weighted cosine with a hit threshold."""

from __future__ import annotations

import math
import uuid
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..errors import InvalidArguments
from ..session import delete, exists, folders, importable

#: More shared words than this are needed unless a call says otherwise.
HIT_THRESHOLD = 8

#: Shared words of all pairs up to which these are gathered by (query, item), and what a block of more has at most: rows,
#: and words of them.
HITS, BLOCK_ROWS, BLOCK_WORDS = 1 << 22, 1 << 16, 1 << 22


def word_sets(words: DataFrame) -> DataFrame:
    """(item, word) pairs to one sorted array of distinct words per item."""
    return words.groupBy("item").agg(F.array_sort(F.collect_set("word")).alias("words"))


def postings(sets: DataFrame) -> DataFrame:
    return sets.select("item", F.explode("words").alias("word"))


def doc_freq(posts: DataFrame, universe: DataFrame | None = None) -> DataFrame:
    """(word, df); with a universe of words, those that no item holds come with 0."""
    found = posts.groupBy("word").agg(F.count("*").alias("df"))
    return found if universe is None else universe.select("word").join(found, "word", "left").select("word", F.coalesce("df", F.lit(0).cast("long")).alias("df"))


def idf(df: Column, n: Column, stop: int = 0, was: Column | None = None) -> Column:
    """log2((n + .5) / (df + .5)) + 1. A positive ``stop`` zeroes words in more items than that; 0 zeroes none; a
    negative one keeps the zeros of the weights ``was``."""
    w = F.log2((n + 0.5) / (df + 0.5)) + 1
    if stop > 0:
        return F.when(df > stop, F.lit(0.0)).otherwise(w)
    return F.when(was == 0, F.lit(0.0)).otherwise(w) if stop < 0 and was is not None else w


def item_norms(posts: DataFrame, weights: DataFrame) -> DataFrame:
    """(item, norm): the root of the sum of squared weights."""
    return posts.join(weights, "word").groupBy("item").agg(F.sqrt(F.sum(F.col("weight") * F.col("weight"))).alias("norm"))


def _asked(weights: DataFrame, queries: DataFrame) -> DataFrame:
    """(query, word, w2_): the queries' words that match something, with their squared weights."""
    return queries.join(weights.where("weight > 0"), "word").select("query", "word", (F.col("weight") * F.col("weight")).alias("w2_"))


def index_scores(posts: DataFrame, weights: DataFrame, queries: DataFrame, more_than: int = 0, norms: DataFrame | Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """(query, item, hits, similarity): the weighted cosine of each query with the items that share more words than that.

    ``posts`` (item, word), ``weights`` (word, weight), ``queries`` (query, word). Stop words (weight 0 or none) match
    nothing. Queries meet only the postings of their own words; hits are summed before and after one exchange by
    (query, item), and norms are joined to what passed. ``norms`` (item, norm) may be a function that makes them for the
    items (item) that passed.
    """
    q = _asked(weights, queries)
    q_norm = q.groupBy("query").agg(F.sqrt(F.sum("w2_")).alias("q_norm_"))
    hits = posts.join(q, "word").groupBy("query", "item").agg(F.count("*").alias("hits"), F.sum("w2_").alias("sum_")).where(F.col("hits") > more_than)
    norms = item_norms(posts, weights) if norms is None else norms(hits.select("item").distinct()) if callable(norms) else norms
    scored = hits.join(norms, "item").join(q_norm, "query")
    none = (F.col("norm") == 0) | (F.col("q_norm_") == 0)
    return scored.select("query", "item", "hits", F.when(none, F.lit(0.0)).otherwise(F.col("sum_") / (F.col("norm") * F.col("q_norm_"))).alias("similarity"))


def index_topk(posts: DataFrame, weights: DataFrame, queries: DataFrame, k: int, threshold: int = HIT_THRESHOLD, norms: DataFrame | Callable[[DataFrame], DataFrame] | None = None, most: int = HITS) -> DataFrame:
    """The k best items of each query with more than ``threshold`` words in common: index_scores plus rank.

    Where all pairs together share more than ``most`` words, which is quadratic, queries and items meet in blocks that
    pass on k items a query, so no task's memory grows with the pairs.
    """
    if k < 1:
        raise InvalidArguments("k is at least 1")
    often = lambda x, n: x.groupBy("word").agg(F.count("*").cast("double").alias(n))
    shared = often(posts, "a_").join(often(_asked(weights, queries), "b_"), "word").agg(F.sum(F.col("a_") * F.col("b_"))).first()[0] or 0
    scored = (index_scores if shared <= most else _BlockScores(k))(posts, weights, queries, max(1, threshold), norms)
    w = Window.partitionBy("query").orderBy(F.round("similarity", 9).desc(), F.col("item").asc())
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


class _BlockScores:
    """As ``index_scores``, but of an item block's rows a query has its k best alone."""

    def __init__(self, k: int):
        self.k = k

    def __call__(self, posts: DataFrame, weights: DataFrame, queries: DataFrame, more_than: int, norms: DataFrame | Callable[[DataFrame], DataFrame] | None) -> DataFrame:
        importable(posts.sparkSession)
        posts = posts.where("item is not null and word is not null")
        norms = item_norms(posts, weights) if norms is None else norms(posts.select("item").distinct()) if callable(norms) else norms
        left = _asked(weights, queries).where("query is not null").groupBy("query").agg(F.collect_list(F.struct("word", "w2_")).alias("x_"), F.sqrt(F.sum("w2_")).alias("norm"))
        left = left.select("query", "norm", F.col("x_.word").alias("words"), F.col("x_.w2_").alias("w2"))
        right = posts.groupBy("item").agg(F.collect_list("word").alias("words")).join(norms, "item").select("item", "norm", "words")
        side = max(1, math.isqrt(3 * posts.sparkSession.sparkContext.defaultParallelism))

        def blocks(x: DataFrame) -> int:
            rows, words = x.agg(F.count("*"), F.coalesce(F.sum(F.size("words")), F.lit(0))).first()
            return max(1, min(side, rows // 1024), -(-rows // BLOCK_ROWS), -(-words // BLOCK_WORDS))

        of_queries, of_items = blocks(left), blocks(right)
        number = lambda c, parts: F.pmod(F.xxhash64(c), F.lit(parts)).cast("int")
        every = lambda parts: F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))
        left = left.withColumn("one_", number("query", of_queries)).withColumn("two_", every(of_items))
        right = right.withColumn("two_", number("item", of_items)).withColumn("one_", every(of_queries))
        k, kind = self.k, lambda x, c: x.schema[c].dataType.simpleString()
        meet = lambda a, b: _block_topk(a, b, k, more_than)
        schema = f"query {kind(left, 'query')}, item {kind(right, 'item')}, hits long, similarity double"
        return left.groupBy("one_", "two_").cogroup(right.groupBy("one_", "two_")).applyInArrow(meet, schema)


def _block_topk(queries: pa.Table, items: pa.Table, k: int, more_than: int) -> pa.Table:
    """The k best of a block's items for each of a block's queries: (query, item, hits, similarity)."""
    items = items.take(pc.sort_indices(items["item"]))
    lists = items["words"].combine_chunks()
    words = lists.flatten().to_numpy(zero_copy_only=False) if len(lists) else np.zeros(0, np.int64)
    held = np.repeat(np.arange(len(lists)), pc.list_value_length(lists).to_numpy(zero_copy_only=False)) if len(lists) else np.zeros(0, np.int64)
    order = np.argsort(words, kind="stable")
    held = held[order]
    known, starts = np.unique(words[order], return_index=True)
    ends = np.append(starts[1:], len(held))
    norm = items["norm"].to_numpy()
    found = [], [], [], []
    for at in range(queries.num_rows if len(held) else 0):
        own, w2, own_norm = (queries[c][at] for c in ("words", "w2", "norm"))
        own, w2 = own.values.to_numpy(zero_copy_only=False), w2.values.to_numpy()
        place = np.minimum(np.searchsorted(known, own), len(known) - 1)
        there = known[place] == own
        place, w2 = place[there], w2[there]
        if not len(place):
            continue
        rows = np.concatenate([held[starts[i] : ends[i]] for i in place])
        hits = np.bincount(rows, minlength=len(norm))
        some = np.flatnonzero(hits > more_than)
        if not len(some):
            continue
        size = norm[some] * own_norm.as_py()
        total = np.bincount(rows, np.repeat(w2, ends[place] - starts[place]), len(norm))[some]
        similarity = np.divide(total, size, out=np.zeros(len(some)), where=size > 0)
        near = np.round(similarity, 9)
        if len(some) > k:  # what ties with the last of k is told apart by the item
            least = np.partition(near, len(near) - k)[len(near) - k]
            best = np.flatnonzero(near >= least)
            best = best[np.argsort(-near[best], kind="stable")[:k]]
            some, similarity = some[best], similarity[best]
        for x, y in zip(found, (np.full(len(some), at), some, hits[some], similarity)):
            x.append(y)
    row, item, hits, similarity = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in found)
    return pa.table({"query": queries["query"].take(pa.array(row)), "item": items["item"].take(pa.array(item)), "hits": pa.array(hits, pa.int64()), "similarity": pa.array(similarity, pa.float64())})


def region_bounds(height: Column, margin: float = 1 / 20) -> list[tuple[Column, Column]]:
    """First and end position of each third of a height; neighbours overlap by a margin, a twentieth of a third."""
    third = height / 3
    m = third * margin
    return [(F.lit(0.0), third + m), (third - m, 2 * third + m), (2 * third - m, height)]


def regions(position: Column, height: Column, margin: float = 1 / 20) -> Column:
    """The thirds that a position lies in, as 0, 1, 2. Positions count from 0."""
    return F.array_compact(F.array(*[F.when((position >= lo) & (position < hi), F.lit(i)) for i, (lo, hi) in enumerate(region_bounds(height, margin))]))


#: The bits that mark a word of the top, middle and bottom third.
REGION_FLAGS = (0x10000000, 0x20000000, 0x40000000)


def flagged(word: Column, region: Column) -> Column:
    return word.bitwiseOR(F.element_at(F.array(*[F.lit(f) for f in REGION_FLAGS]), region + 1))


def unflagged(word: Column) -> Column:
    return word.bitwiseAND(F.lit(~sum(REGION_FLAGS) & 0xFFFFFFFF))


#: Words of a search that a filter on the postings names one by one; more are put together to so many ranges, and beyond
#: the second number the filter is left out.
WORD_TERMS, WORDS_NAMED = 256, 20_000


def word_filter(words: list[int], column: str = "word", terms: int = WORD_TERMS) -> Column:
    """A condition that holds for all of ``words``, and for few others: ranges around them, the widest gaps left out. It is
    made of comparisons alone, so it reaches the Parquet reader, whatever its limit on lists."""
    words = sorted(set(words))
    gaps = sorted(range(1, len(words)), key=lambda i: words[i - 1] - words[i])[: terms - 1]
    cuts = [0, *sorted(gaps), len(words)]
    parts = [F.col(column) == words[a] if b == a + 1 else F.col(column).between(words[a], words[b - 1]) for a, b in zip(cuts, cuts[1:]) if b > a]
    if not parts:
        return F.lit(False)
    while len(parts) > 1:  # a balanced tree
        parts = [parts[i] | parts[i + 1] if i + 1 < len(parts) else parts[i] for i in range(0, len(parts), 2)]
    return parts[0]


class StoredIndex:
    """An inverted index on disk, in batches that are merged as they grow in number.

    A batch holds postings by ranges of hashed words, sorted by word inside a file, its items with their words, and its
    words with how many of its items have them. Nothing else is kept: frequencies are the sums of the batches' counts,
    so a batch costs no more than itself, however large the index is. A row of ``batches`` ends a write, and only what
    such rows name is read; so a write or a merge that fails half-way leaves the index as it was.

    ``add`` leaves out items that are there. A batch can be named: a name that was taken adds nothing, so a stream may
    replay it. Every ``fanout`` batches of a level are merged into one of the next, and ``compact`` merges all.
    """

    #: Rows of a page of postings: what a search for few words reads at least.
    PAGE_ROWS = 2000

    def __init__(self, spark: SparkSession, root: str, ranges: int = 64, fanout: int = 8):
        self.spark, self.root, self.ranges, self.fanout = spark, root, ranges, fanout

    def _range(self, word: Column) -> Column:
        return F.pmod(F.xxhash64(word.cast("long")), F.lit(self.ranges)).cast("int")

    def _log(self) -> list:
        path = f"{self.root}/batches"
        return sorted(self.spark.read.parquet(path).collect(), key=lambda r: r.n) if exists(self.spark, path) else []

    def batches(self) -> list:
        """Rows (n, batch, level, items, upto, merged) of the batches that count: those that no other one has taken in."""
        log = self._log()
        gone = {b for r in log for b in r.merged}
        return [r for r in log if r.batch not in gone]

    def cursor(self) -> int:
        """The largest number that ``add`` was told its items go up to, or -1."""
        return max([-1, *(r.upto for r in self._log() if r.upto is not None)])

    def _table(self, name: str, own: list[str] | None = None) -> DataFrame | None:
        own = [r.batch for r in self.batches() if r.items] if own is None else own
        return self.spark.read.parquet(f"{self.root}/{name}").where(F.col("batch").isin(own)) if own else None

    def postings(self) -> DataFrame | None:
        return self._table("postings")

    def items(self) -> DataFrame | None:
        """(item, n_words, words, batch)."""
        return self._table("items")

    def counts(self) -> DataFrame | None:
        """(word, df): in how many items each word is, from the batches' counts."""
        found = self._table("counts")
        return None if found is None else found.groupBy("word").agg(F.sum("df").alias("df"))

    def weights(self, stop: int = 0) -> DataFrame:
        """(word, df, weight) by ``idf`` over all items, with ``stop`` as there."""
        n = float(sum(r.items for r in self.batches()))
        return self.counts().select("word", "df", idf(F.col("df"), F.lit(n), stop).alias("weight"))

    def add(self, posts: DataFrame, batch: str | None = None, upto: int | None = None) -> None:
        """Takes (item, word) pairs, as the batch of that name if one is given (a letter, then letters, digits and -)."""
        if batch is not None and not (batch[:1].isalpha() and batch.replace("-", "").isalnum()):
            raise InvalidArguments(f"not a name of a batch: {batch!r}")
        log = self._log()
        if batch is not None and any(batch == r.batch or batch in r.merged for r in log):
            return
        batch = batch or f"b{uuid.uuid4().hex}"
        known = self.items()
        new = posts.select("item", "word").distinct()
        new = new if known is None else new.join(known.select("item"), "item", "left_anti")
        self._write(new, batch, 0, upto, [])
        while len(same := self._last_level()) >= self.fanout:
            self._merge(same, same[0].level + 1)

    def _last_level(self) -> list:
        """The batches with items that are of the last one's level."""
        rows = [r for r in self.batches() if r.items]
        return [r for r in rows if r.level == rows[-1].level]

    def _write(self, posts: DataFrame, batch: str, level: int, upto: int | None, merged: list[str]) -> None:
        for name in ("postings", "items", "counts"):
            delete(self.spark, f"{self.root}/{name}/batch={batch}")  # what a failed write of this name has left
        at = lambda name: f"{self.root}/{name}/batch={batch}"
        x = posts.withColumn("range_", self._range(F.col("word")))
        # a word on very many items is written by several tasks
        x = x.repartition("range_", F.pmod(F.xxhash64("item"), F.lit(4))).sortWithinPartitions("range_", "word", "item")
        x.write.option("parquet.page.row.count.limit", self.PAGE_ROWS).partitionBy("range_").parquet(at("postings"))
        n = 0
        if any(f.startswith("range_=") for f in folders(self.spark, at("postings"))):
            own = self.spark.read.parquet(at("postings"))
            words = own.groupBy("item").agg(F.array_sort(F.collect_list("word")).alias("words"))
            words.select("item", F.size("words").cast("long").alias("n_words"), "words").write.parquet(at("items"))
            doc_freq(own).withColumn("range_", self._range(F.col("word"))).repartition("range_").sortWithinPartitions("word").write.partitionBy("range_").parquet(at("counts"))
            n = self.spark.read.parquet(at("items")).count()
        row = [(max([-1, *(r.n for r in self._log())]) + 1, batch, level, n, upto, merged)]
        self.spark.createDataFrame(row, "n int, batch string, level int, items long, upto long, merged array<string>").coalesce(1).write.mode("append").parquet(f"{self.root}/batches")

    def _merge(self, rows: list, level: int) -> None:
        taken = sorted({b for r in rows for b in [r.batch, *r.merged]})
        upto = [r.upto for r in rows if r.upto is not None]
        if not (names := [r.batch for r in rows if r.items]):
            return
        self._write(self._table("postings", names).select("item", "word"), f"m{uuid.uuid4().hex}", level, max(upto) if upto else None, taken)

    def compact(self) -> None:
        """Merges all batches into one and deletes what no batch that counts holds, also what failed writes have left.
        Until the merged batch is whole, searches read the old ones."""
        rows = self.batches()
        if len(rows) > 1:
            self._merge(rows, max(r.level for r in rows) + 1)
        live = {f"batch={r.batch}" for r in self.batches()}
        for name in ("postings", "items", "counts") if live else ():
            for folder in folders(self.spark, f"{self.root}/{name}"):
                if folder not in live:
                    delete(self.spark, f"{self.root}/{name}/{folder}")

    def _read(self, table: DataFrame, words: DataFrame) -> DataFrame:
        """The rows of a table that may have ``words`` (word): their ranges are the folders read, and the words themselves
        a filter that skips the pages between them."""
        asked = words.where("word is not null").select(F.col("word").cast("long").alias("word"), self._range(F.col("word")).alias("r")).distinct().limit(WORDS_NAMED + 1).collect()
        if len(asked) > WORDS_NAMED:
            return table
        return table.where(F.col("range_").isin(sorted({x.r for x in asked})) & word_filter([x.word for x in asked]))

    def near(self, words: DataFrame) -> DataFrame:
        """(item, word): the postings that may have ``words`` (word), and few others."""
        return self._read(self.postings(), words).select("item", "word")

    def search(self, queries: DataFrame, k: int, threshold: int = HIT_THRESHOLD, stop: int = 0) -> DataFrame:
        """As ``index_topk``, for queries (query, word). Norms are made for the items alone that pass the threshold, from
        their own words and the frequencies that hold now."""
        weights, items = self.weights(stop), self.items()
        own = lambda passed: item_norms(items.join(passed, "item", "left_semi").select("item", F.explode("words").alias("word")), weights)
        return index_topk(self.near(queries), weights, queries, k, threshold, own)
