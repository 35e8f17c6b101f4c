import random

import pytest
from pyspark.sql import functions as F

from lodestone.operators import inverted


def _rows(df):
    return sorted((str(r.query), str(r.item), r.hits, round(r.similarity, 9), r.rank) for r in df.collect())


@pytest.mark.parametrize("kind", ["long", "string"])
def test_blocks_find_what_the_plain_search_finds(spark, monkeypatch, kind):
    monkeypatch.setattr(inverted, "BLOCK_ROWS", 40)
    draw = random.Random(5)
    rows = [(i, w) for i in range(300) for w in draw.sample(range(30), draw.randint(1, 9))]
    rows += [(i, w) for i in range(300, 340) for w in (1, 2, 3, 4)]  # ties
    rows += [(340, None), (None, 1), (None, 2), (None, 3), (7, 1), (7, 1)]
    posts = spark.createDataFrame(rows, "item long, word long").withColumn("item", F.col("item").cast(kind))
    weights = inverted.doc_freq(posts.where("word is not null")).select("word", F.when(F.col("word") % 11 == 0, 0.0).otherwise(inverted.idf(F.col("df"), F.lit(340))).alias("weight"))
    queries = posts.where(F.coalesce(F.col("item").cast("long") % 3 == 0, F.lit(True))).select(F.col("item").alias("query"), "word")
    queries = queries.unionByName(spark.createDataFrame([("-1", 1), ("-2", 500)], "query string, word long").withColumn("query", F.col("query").cast(kind)))
    for k, threshold in ((5, 2), (1, 3), (1000, 1)):
        plain = inverted.index_topk(posts, weights, queries, k, threshold)
        assert _rows(inverted.index_topk(posts, weights, queries, k, threshold, most=0)) == _rows(plain)
    norms = lambda passed: inverted.item_norms(posts.join(passed, "item", "left_semi"), weights)
    assert _rows(inverted.index_topk(posts, weights, queries, 5, 2, norms, most=0)) == _rows(inverted.index_topk(posts, weights, queries, 5, 2))
    assert inverted.index_topk(posts, weights, queries.where("word > 400"), 5, 2, most=-1).count() == 0
    assert inverted.index_topk(posts.where("word > 400"), weights, queries, 5, 2, most=-1).count() == 0


def test_many_shared_words_are_not_gathered_by_pair(spark):
    posts = spark.range(3000).crossJoin(spark.range(8).withColumnRenamed("id", "word")).select(F.col("id").alias("item"), "word")
    weights = spark.range(8).select(F.col("id").alias("word"), F.lit(1.0).alias("weight"))
    found = inverted.index_topk(posts, weights, posts.where("item % 10 = 0").withColumnRenamed("item", "query"), 4, 2)
    assert "FlatMapCoGroupsInArrow" in found._jdf.queryExecution().executedPlan().toString()
    assert {(r.item, r.rank) for r in found.collect()} == {(i, i + 1) for i in range(4)} and found.count() == 1200
