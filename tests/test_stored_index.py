"""The stored index: merges, failures, replays, what a search reads, and an engine fed by a stream."""

import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from lodestone.errors import InvalidArguments
from lodestone.operators import inverted
from lodestone.session import folders


def some_posts(seed=1, items=120, words=300):
    rng = random.Random(seed)
    return {i: sorted({min(words - 1, int(rng.expovariate(1 / 40))) for _ in range(rng.randrange(3, 60))}) for i in range(items)}


def frame(spark, sets):
    return spark.createDataFrame([(i, w) for i, ws in sets.items() for w in ws], "item long, word long")


def plain_search(sets, asked, k, threshold, stop=0):
    df = Counter(w for ws in sets.values() for w in ws)
    weight = {w: 0.0 if stop and n > stop else math.log2((len(sets) + 0.5) / (n + 0.5)) + 1 for w, n in df.items()}
    norm = {i: math.sqrt(sum(weight[w] ** 2 for w in ws)) for i, ws in sets.items()}
    out = []
    for q, ws in asked.items():
        q_norm, scored = math.sqrt(sum(weight.get(w, 0) ** 2 for w in ws)), []
        for i, own in sets.items():
            shared = [w for w in set(ws) & set(own) if weight[w] > 0]
            if len(shared) > threshold:
                scored.append((-round(sum(weight[w] ** 2 for w in shared) / (norm[i] * q_norm), 9), i, len(shared)))
        out += [(q, i, n, r, round(-s, 6)) for r, (s, i, n) in enumerate(sorted(scored)[:k], 1)]
    return sorted(out)


def found(index, spark, asked, k=5, threshold=3, stop=0):
    q = spark.createDataFrame([(i, w) for i, ws in asked.items() for w in ws], "query long, word long")
    return sorted((r.query, r.item, r.hits, r.rank, round(r.similarity, 6)) for r in index.search(q, k, threshold, stop).collect())


def test_merges_change_no_search(spark, tmp_path):
    sets = some_posts()
    asked = {q: sets[q] for q in (0, 50, 100)} | {999: [1, 2, 3, 4, 5, 10_000]}
    index = inverted.StoredIndex(spark, f"{tmp_path}/index", ranges=4, fanout=3)
    for part in range(7):
        index.add(frame(spark, {i: ws for i, ws in sets.items() if i % 7 == part}))
    assert sorted(r.level for r in index.batches()) == [0, 1, 1]
    want = plain_search(sets, asked, 5, 3)
    assert found(index, spark, asked) == want
    files = lambda: len(list((tmp_path / "index" / "postings").rglob("*.parquet")))
    before = files()
    index.compact()
    assert [r.items for r in index.batches()] == [120] and files() < before and len(folders(spark, f"{tmp_path}/index/postings")) == 1
    assert found(index, spark, asked) == want
    assert found(index, spark, asked, stop=40) == plain_search(sets, asked, 5, 3, stop=40)
    # items that are there add nothing, new ones count at once
    sets[500] = [1, 2, 3, 4, 5, 6, 7]
    index.add(frame(spark, {500: sets[500], 3: [299]}))
    assert found(index, spark, asked | {500: sets[500]}) == plain_search(sets, asked | {500: sets[500]}, 5, 3)


def test_frequencies_are_sums_of_batches(spark, tmp_path, monkeypatch):
    """An add reads its own words alone: the index's postings aren't read, whatever their number."""
    sets = some_posts(2)
    index = inverted.StoredIndex(spark, f"{tmp_path}/index", ranges=4)
    index.add(frame(spark, {i: ws for i, ws in sets.items() if i < 100}))
    read = []
    monkeypatch.setattr(index, "postings", lambda: read.append(1))
    index.add(frame(spark, {i: ws for i, ws in sets.items() if i >= 100}))
    assert not read
    assert {r.word: r.df for r in index.counts().collect()} == Counter(w for ws in sets.values() for w in ws)


@pytest.mark.parametrize("step", ["items", "batches"])
def test_a_merge_that_fails_leaves_the_old_batches(spark, tmp_path, monkeypatch, step):
    sets, root = some_posts(3, 60), f"{tmp_path}/index"
    asked = {0: sets[0], 50: sets[50]}
    index = inverted.StoredIndex(spark, root, ranges=2)
    for part in range(2):
        index.add(frame(spark, {i: ws for i, ws in sets.items() if i % 2 == part}))
    writer = type(spark.range(1).write)
    parquet = writer.parquet

    def failing(self, path, *a, **b):
        if f"/{step}" in path[len(root):]:
            raise OSError("no more room")
        return parquet(self, path, *a, **b)

    monkeypatch.setattr(writer, "parquet", failing)
    with pytest.raises(OSError):
        index.compact()
    monkeypatch.undo()
    assert len(index.batches()) == 2 and found(index, spark, asked) == plain_search(sets, asked, 5, 3)
    index.compact()
    assert len(folders(spark, f"{root}/postings")) == 1 and found(index, spark, asked) == plain_search(sets, asked, 5, 3)


def test_named_batches_are_taken_once(spark, tmp_path):
    sets = some_posts(4, 20)
    index = inverted.StoredIndex(spark, f"{tmp_path}/index", ranges=2)
    index.add(frame(spark, sets), "s1-0", upto=19)
    index.add(frame(spark, {99: [1]}), "s1-0")
    assert index.items().count() == 20 and index.cursor() == 19
    index.add(frame(spark, {}), "s1-1")
    index.add(frame(spark, {50: [1]}))
    index.compact()
    index.add(frame(spark, {99: [1]}), "s1-1")
    index.add(frame(spark, {99: [1]}), "s1-0")
    assert index.items().count() == 21 and index.cursor() == 19
    for bad in ("1e5", "", "a/b"):
        with pytest.raises(InvalidArguments):
            index.add(frame(spark, {}), bad)
    none = inverted.StoredIndex(spark, f"{tmp_path}/none")
    none.add(frame(spark, {}))
    none.compact()
    assert none.items() is None and none.cursor() == -1


def test_word_filter():
    rng = random.Random(7)
    for n, terms in ((0, 4), (1, 4), (5, 4), (300, 16), (40, 64)):
        words = [rng.randrange(10_000) for _ in range(n)]
        text = str(inverted.word_filter(words, terms=terms))
        assert text.count("word =") + text.count("<=") <= 2 * terms


def test_a_search_reads_its_words_pages(spark, tmp_path):
    """400,000 postings of 20,000 words; a search for 40 of them reads a small part of the rows."""
    posts = spark.range(400_000).select((F.col("id") / 20).cast("long").alias("item"), (F.xxhash64("id") % 20_000).alias("word")).withColumn("word", F.abs("word"))
    index = inverted.StoredIndex(spark, f"{tmp_path}/index", ranges=2)
    index.PAGE_ROWS = 500
    index.add(posts.coalesce(2))
    asked = spark.range(40).select((F.col("id") * 500 + 7).alias("word"))
    near = index.near(asked)
    plan = near._jdf.queryExecution().executedPlan().toString()
    assert "range_" in plan.split("PartitionFilters")[1].split("PushedFilters")[0] and "EqualTo(word,7)" in plan.split("PushedFilters")[1]
    want = index.postings().join(asked, "word", "left_semi").count()
    assert near.count() == want > 0
    assert rows_scanned(near) < 100_000


def rows_scanned(df):
    """What the scans of a plan have read."""
    plan = df._jdf.queryExecution().executedPlan()
    plan.executeCollect()
    leaves = plan.collectLeaves()
    return sum(leaves.apply(i).metrics().apply("numOutputRows").value() for i in range(leaves.size()))


def test_words_beyond_the_limit_are_joined_alone(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(inverted, "WORDS_NAMED", 10)
    sets = some_posts(6)
    index = inverted.StoredIndex(spark, f"{tmp_path}/index", ranges=2)
    index.add(frame(spark, sets))
    asked = {q: sets[q] for q in (0, 50)}
    assert found(index, spark, asked) == plain_search(sets, asked, 5, 3)
