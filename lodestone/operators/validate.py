"""Retrieval quality: nearest-neighbour classification and same-group hits."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import shared_dir
from .topk import dense_topk_many


def knn_scores(items: DataFrame, k: int = 20) -> DataFrame:
    """Per class: accuracy of a vote among the k nearest others, precision and recall over the k + 1 nearest, self included.

    ``items`` (item_id, vector, label). Accuracy leaves the item itself out of the vote (ties: the smaller label);
    precision is the share of an item's neighbours of its own class, itself included, averaged over the class, and
    recall the same count over the size of the class.
    """
    path = f"{shared_dir(items.sparkSession)}/near-{uuid.uuid4().hex}"  # read twice, and by far the most work: written once
    dense_topk_many(items, items.select(F.col("item_id").alias("query_id"), "vector"), k + 1).write.parquet(path)
    near = items.sparkSession.read.parquet(path)
    labels = items.select("item_id", "label")
    size = labels.groupBy("label").agg(F.count("*").alias("size_"))
    near = near.join(labels, "item_id").withColumnRenamed("label", "near_")
    near = near.join(labels.select(F.col("item_id").alias("query_id"), "label"), "query_id")
    hits = near.groupBy("query_id", "label").agg(F.sum((F.col("near_") == F.col("label")).cast("long")).alias("hits_"), F.count("*").alias("of_"))
    votes = near.where(F.col("item_id") != F.col("query_id"))
    votes = votes.withColumn("r_", F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("similarity").desc(), "item_id"))).where(F.col("r_") <= k)
    votes = votes.groupBy("query_id", "near_").agg(F.count("*").alias("n_")).groupBy("query_id").agg(F.max_by("near_", F.struct("n_", -F.col("near_"))).alias("voted_"))
    x = hits.join(votes, "query_id", "left").join(size, "label")
    right = F.coalesce((F.col("voted_") == F.col("label")).cast("double"), F.lit(0.0))
    return x.groupBy("label").agg(F.avg(right).alias("accuracy"), F.avg(F.col("hits_") / F.col("of_")).alias("precision"), F.avg(F.col("hits_") / F.col("size_")).alias("recall"))


def group_score(items: DataFrame, k: int = 4) -> DataFrame:
    """The mean number of items of the query's own group among its k best, itself included, and the number of queries."""
    near = dense_topk_many(items, items.select(F.col("item_id").alias("query_id"), "vector"), k)
    labels = items.select("item_id", "label")
    near = near.join(labels, "item_id").join(labels.select(F.col("item_id").alias("query_id"), F.col("label").alias("own_")), "query_id")
    per = near.groupBy("query_id").agg(F.sum((F.col("label") == F.col("own_")).cast("long")).alias("n_"))
    return per.agg(F.avg("n_").alias("score"), F.count("*").alias("queries"))


def macro_mean(scores: DataFrame) -> DataFrame:
    """(classes, accuracy, precision, recall): the means over classes of ``knn_scores``, each class with the same weight."""
    return scores.agg(F.count("*").alias("classes"), *[F.avg(c).alias(c) for c in ("accuracy", "precision", "recall")])
