"""Models: flat centroids and colour palettes; trees and codebooks by sign are in ``clusters``, projections in ``metric``."""

from __future__ import annotations

from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .clusters import CentroidTree, centroid_tree, pooled_weights, sampled_points, signed_codebooks
from .metric import fit_metric, pca_matrix, projected, sampled


def split_by_sign(points: DataFrame) -> DataFrame:
    """Adds sign: 1 for points with a positive response, 0 for the others. Each sign has its own codebook."""
    return points.withColumn("sign", F.when(F.col("response") > 0, 1).otherwise(0))


def centroids(points: DataFrame, k: int, steps: int = 60, seed: int = 1) -> DataFrame:
    """(label, vec): flat k-means over the column vec."""
    spark = points.sparkSession
    model = KMeans(k=k, maxIter=steps, seed=seed, featuresCol="f_").fit(points.select(array_to_vector(F.col("vec").cast("array<double>")).alias("f_")))
    return spark.createDataFrame([(i, [float(v) for v in c]) for i, c in enumerate(model.clusterCenters())], "label int, vec array<double>")


def palette(pixels: DataFrame, n: int = 64, sample: int = 200_000) -> DataFrame:
    """(label, vec): n colours of a bounded sample of pixels (columns h, s, v)."""
    return centroids(sampled(pixels.select(F.array("h", "s", "v").alias("vec")), sample, "vec"), n)


__all__ = [
    "CentroidTree", "centroid_tree", "centroids", "fit_metric", "palette", "pca_matrix", "pooled_weights", "projected", "sampled", "sampled_points",
    "signed_codebooks", "split_by_sign",
]
