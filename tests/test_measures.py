"""Searches by blocks against the expressions that say what they compare."""

import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone.functions import codec
from lodestone.functions import similarity as S
from lodestone.operators import measures, topk
from lodestone.operators.metric import _least
from lodestone.plans.catalogue import ORACLES, QUERIES
from tests.oracle import same


def _ranked(df) -> list:
    return sorted((r.query_id, r["rank"], r.item_id, None if r.similarity is None else str(r.similarity)) for r in df.select("query_id", "rank", "item_id", "similarity").collect())


def _rows(spark, dims: int, n: int = 300):
    """Vectors of which every third has two copies, with short, null and unusual ones."""
    number = lambda i: F.sin(F.floor(F.col("id") / 3) * 1.7 + i * 2.3 + F.col("id") % 3 * (F.col("id") % 2))
    x = spark.range(n).select(F.col("id").alias("item_id"), F.array(*[number(i) for i in range(dims)]).alias("v"))
    odd = F.when(F.col("item_id") == 7, F.lit(None)).when(F.col("item_id") == 9, F.slice("v", 1, dims - 1)).when(F.col("item_id") == 50, F.transform("v", lambda x, i: F.when(i > 0, x)))
    odd = odd.when(F.col("item_id") == 11, F.transform("v", lambda x: F.lit(float("nan")))).when(F.col("item_id") == 100, F.transform("v", lambda x: F.lit(0.0)))
    return x.withColumn("v", odd.when(F.col("item_id") == 13, F.transform("v", lambda x: x * 1e200)).otherwise(F.col("v")))


NEAREST = lambda: S.major_similarity(F.slice("v", 1, 3), F.slice("v", 4, 3), F.slice("q_v", 1, 3), F.slice("q_v", 4, 3))
GATED = lambda: S.blend(*[g(S.metric_similarity(F.slice("v", lo, n), F.slice("q_v", lo, n))) for g, lo, n in ((lambda x: x, 1, 6), (lambda x: S.step_gate(x, 0.7), 7, 4))], 0.5)
LEVELS = lambda v: F.transform(v, lambda x: F.least(F.floor(F.abs(x) * 5), F.lit(9)).cast("int"))
CASES = {
    "nearest": (measures.Nearest(6), 6, lambda v: F.transform(v, lambda x: F.rint(x * 90)), NEAREST),
    "code": (measures.Metric(6, (3 * 255.0**2) ** 0.5), 4, lambda v: F.transform(v, lambda x: F.rint(x * 90)), lambda: S.colour_code_similarity(F.col("v"), F.col("q_v"))),
    "pyramid": (measures.Pyramid(6, 4, 2), 32, LEVELS, lambda: S.pyramid_cosine(F.col("v"), F.col("q_v"), 2)),
    "levels": (measures.Levels(6), 16, LEVELS, lambda: S.level_cosine(F.col("v"), F.col("q_v"))),
    "gated": (measures.Gated(6, 6), 10, lambda v: F.transform(v, lambda x: x / 4), GATED),
    "residual": (measures.Residual(6), 9, lambda v: v, lambda: S.residual_similarity(F.col("v"), F.col("q_v"))),
    "metric": (measures.Metric(6), 9, lambda v: v, lambda: S.metric_similarity(F.col("v"), F.col("q_v"))),
    "bits": (measures.Bits(6), 64, lambda v: F.when(F.size(v) == 64, codec.sign_bits(v)), lambda: S.bit_cosine(F.col("v"), F.col("q_v"))),
}


@pytest.mark.parametrize("name", sorted(CASES))
def test_blocks_find_what_the_expression_says(spark, name):
    measure, dims, to, score = CASES[name]
    score = F.round(score(), 6)
    x = _rows(spark, dims).select("item_id", to(F.col("v")).alias("v")).cache()
    q = x.where("item_id % 10 = 0").select(F.col("item_id").alias("query_id"), F.col("v").alias("q_v"))
    want = _ranked(topk.topk_many(x, q, score, 7))
    assert len(want) == 210 and _ranked(topk.measured_topk_many(x, q, score, measure, 7, "v")) == want


BLOCKS = ["q24_major_colours", "q48_colour_code", "q19_colour_pyramid", "q18_colour_levels", "q22_colour_gate", "q47_residual_similarity", "q46_hsv_similarity", "q21_projection", "q17_bit_cosine"]


@pytest.mark.parametrize("name", BLOCKS)
def test_no_pair_of_an_item_and_a_query_is_a_row(spark, sf_dir, name):
    plan = QUERIES[name](spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    assert "InArrow" in plan


def test_a_long_vector_is_normalized_in_one_pass(spark):
    start = time.time()
    x = spark.range(1).select(F.transform(F.sequence(F.lit(1), F.lit(30_000)), lambda i: i.cast("double") + F.col("id")).alias("v"))
    assert abs(x.select(S.norm(S.normalized(F.col("v")))).first()[0] - 1) < 1e-9
    assert time.time() - start < 30


def test_many_words_are_kept_by_a_map_in_one_pass(spark):
    start = time.time()
    x = spark.range(1).select(F.transform(F.sequence(F.lit(1), F.lit(20_000)), lambda i: i + F.col("id")).alias("w"))
    weight = F.map_from_arrays("w", F.transform("w", lambda w: F.when(w % 3 == 0, F.lit(0.0)).when(w % 3 == 1, F.lit(None)).otherwise(F.lit(1.0))))
    assert list(x.select(codec.hex_to_words(codec.words_to_hex(F.col("w")), weight)).first()[0]) == list(range(2, 20_001, 3))
    assert time.time() - start < 30


def test_the_least_are_those_of_a_stable_sort():
    d = np.random.default_rng(3).integers(0, 9, (40, 60)).astype(float)
    d[d == 4], d[0], d[1, 2:] = np.inf, np.inf, np.inf
    want = np.argsort(d, axis=1, kind="stable")[:, :3]
    values = np.take_along_axis(d, want, axis=1)
    at, found = _least(d.copy(), 3)
    assert (found == values).all() and (at == want)[np.isfinite(values)].all()


@pytest.mark.parametrize("name", ["q49_tfidf_dense", "q50_weight_function"])
def test_all_items_that_share_a_word_are_told(spark, tmp_path, name):
    x = spark.range(3000).selectExpr("id % 101 AS l_suppkey", "(id * id) % 97 AS l_partkey")
    x.write.parquet(f"{tmp_path}/lineitem.parquet")
    got = QUERIES[name](spark, str(tmp_path)).cache()
    assert got.where("query = 50").count() > 90
    same(got, ORACLES[name], str(tmp_path))
