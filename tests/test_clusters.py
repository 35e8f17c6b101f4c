"""Samples, trees and codebooks by sign, and the metric, against plain versions."""

import hashlib
import math
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone.operators import clusters, metric, training
from lodestone.plans import models as plans


def points(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(F.col("vec_id").alias("item_id"), F.col("embedding").cast("array<double>").alias("vec"))


def test_sample_takes_images_alike(spark):
    """An image with half of all points, spread over all tasks, counts no more than others; and no task holds its points."""
    x = spark.range(0, 40_000, 1, 8).select(F.when(F.col("id") % 2 == 0, 0).otherwise(F.col("id") % 97 + 1).alias("item"), (F.col("id") % 3 % 2).cast("int").alias("sign"), "id")
    got = clusters.sampled_points(x, 20, 30, 200, ["id"])
    rows = [(r.item, r.sign, r.id) for r in got.collect()]
    md5 = lambda s: hashlib.md5(s.encode()).hexdigest()
    every = [(0 if i % 2 == 0 else i % 97 + 1, i % 3 % 2, i) for i in range(40_000)]
    images = set(sorted({p[0] for p in every}, key=lambda i: md5(str(i)))[:20])
    want = []
    for sign in (0, 1):
        own = []
        for image in images:
            of = [p for p in every if p[0] == image and p[1] == sign]
            own += sorted(of, key=lambda p: md5(f"{p[0]}:{p[1]}:{p[2]}"))[:30]
        want += sorted(own, key=lambda p: md5("codebook:" + md5(f"{p[0]}:{p[1]}:{p[2]}")))[:200]
    assert sorted(rows) == sorted(want)
    assert max(Counter(r[:2] for r in rows).values()) <= 30
    assert got._jdf.queryExecution().executedPlan().toString().count("WindowGroupLimit") >= 4
    assert clusters.sampled_points(x.where("id < 0"), 20, 30, 200, ["id"]).count() == 0


def plain_tree(v, start, steps):
    """Depth by depth, node by node, step by step. ``start``: a list of {parent: centres}."""
    node, out = np.zeros(len(v), int), []
    for given in start:
        child, first, after = np.full(len(v), -1), 0, []
        for p in sorted(given):
            own, c = v[node == p], given[p].copy()
            for _ in range(steps):
                near = ((own[:, None] - c[None]) ** 2).sum(-1).argmin(1)
                c = np.array([own[near == i].mean(0) if (near == i).any() else c[i] for i in range(len(c))])
            child[node == p] = first + ((own[:, None] - c[None]) ** 2).sum(-1).argmin(1)
            first += len(c)
            after.append(c)
        out.append(np.concatenate(after))
        node = child
    return out


def test_all_nodes_of_a_depth_move_as_a_plain_tree(spark, sf_dir, monkeypatch):
    x = points(spark, sf_dir)
    v = np.array([r.vec for r in x.collect()])
    start = [{0: v[:3]}, {i: v[10 * i + 10 : 10 * i + 14] for i in range(3)}, {i: v[2 * i + 100 : 2 * i + 102] for i in range(12)}]
    steps, seen = 6, []
    moved = clusters._moved
    monkeypatch.setattr(clusters, "_moved", lambda *a: seen.append(len(a[2].centres)) or moved(*a))
    got = clusters.grown(x.select(F.lit(0).alias("node_"), "vec"), 1, [3, 4, 2], steps, start)
    for a, b in zip(got, plain_tree(v, start, steps)):
        assert np.allclose(a.centres, b)
    assert len(seen) <= steps * 3 and set(seen) == {3, 12, 24}  # one job a step, whatever the number of nodes


def test_warm_start(spark, sf_dir):
    x = points(spark, sf_dir)
    small = clusters.centroid_tree(x, [4], 8)
    deep = clusters.centroid_tree(x, [4, 3], 8, start=small, keep=1)
    assert all(np.array_equal(deep.levels[0][p], small.levels[0][p]) for p in small.levels[0]) and len(deep.leaves) == 12
    again = clusters.centroid_tree(x, [4, 3], 8, start=deep)
    error = lambda t: t.predict(x, 12).agg(F.sum("distance")).first()[0]
    assert error(again) <= error(deep) + 1e-9
    wider = clusters.centroid_tree(x, [6], 0, start=small)
    assert all(np.array_equal(wider.levels[0][(i,)], small.levels[0][(i,)]) for i in range(4)) and len(wider.leaves) == 6


def test_trees_of_few_points(spark):
    one = spark.createDataFrame([([1.0, 2.0],)] * 50 + [([3.0, 4.0],)] * 2, "vec array<double>")
    tree = clusters.centroid_tree(one, [5, 2])
    assert sorted(map(list, tree.levels[0].values())) == [[1.0, 2.0], [3.0, 4.0]] and len(tree.leaves) == 2
    assert clusters.centroid_tree(spark.createDataFrame([], "vec array<double>"), [3]).levels == []


def test_codebooks_of_each_sign(spark, sf_dir):
    x = points(spark, sf_dir).select((F.col("vec")[0] > 0).cast("int").alias("sign"), (F.col("item_id") % 7).alias("item"), F.transform("vec", lambda e: e * 3).alias("vec"))
    books = training.signed_codebooks(x, 5, 40).collect()
    assert Counter(r.sign for r in books) == {0: 5, 1: 5}
    rows = x.collect()
    want = {}
    for sign in (0, 1):
        v = np.array([r.vec for r in rows if r.sign == sign])
        v /= np.linalg.norm(v, axis=1)[:, None]
        c = np.array([r.vec for r in sorted((r for r in books if r.sign == sign), key=lambda r: r.label)])
        near = ((v[:, None] - c[None]) ** 2).sum(-1).argmin(1)
        assert all(np.allclose(v[near == k].mean(0), c[k], atol=1e-3) for k in range(5))
        items = [r.item for r in rows if r.sign == sign]
        for k, item, vec in zip(near, items, v):
            n, s = want.get((item, int(k) + (0 if sign else 5)), (0, 0))
            want[(item, int(k) + (0 if sign else 5))] = n + 1, s + vec - c[k]
    total, took = len(rows), Counter()
    for (_, w), (n, _) in want.items():
        took[w] += n
    got = {(r.item, r.word): r for r in plans.signed_residuals(x, spark.createDataFrame(books), 5).collect()}
    assert set(got) == set(want)
    for key, (n, s) in want.items():
        assert got[key].points == n and np.allclose(got[key].residual, s, atol=1e-9)
        assert got[key].weight == pytest.approx(math.log2((total + 0.5) / (took[key[1]] + 0.5)) + 1, abs=1e-6)


def test_pooled_weights(spark):
    counts = spark.createDataFrame([(1, 0, 3), (1, 2, 5), (0, 0, 1), (1, 0, 1)], "sign int, label int, n long")
    got = {r.word: (r.n, r.weight) for r in training.pooled_weights(counts, 3).collect()}
    want = {0: 4, 1: 0, 2: 5, 3: 1, 4: 0, 5: 0}
    assert {w: n for w, (n, _) in got.items()} == want
    assert all(got[w][1] == pytest.approx(math.log2(10.5 / (n + 0.5)) + 1) for w, n in want.items())


def plain_metric(items, dims, steps, k=3, others=3, margin=0.05, pull=0.3, push=0.45, rate=0.1):
    rows = items.orderBy("item_id").collect()
    x, y = np.array([r.vector for r in rows], np.float64), np.array([r.label for r in rows])
    m = metric.pca_matrix(items, dims)
    for _ in range(steps):
        z = x @ m.T
        d, s = ((z[:, None] - z[None]) ** 2).sum(-1), np.zeros((x.shape[1],) * 2)
        for i in range(len(x)):
            order = np.argsort(d[i], kind="stable")
            friends, foes = [j for j in order if y[j] == y[i] and j != i][:k], [j for j in order if y[j] != y[i]][:others]
            reach = max((d[i, j] for j in friends), default=-np.inf)
            for j in friends:
                s += pull * np.outer(x[i] - x[j], x[i] - x[j])
            for j in foes:
                if d[i, j] < reach + margin:
                    s -= push * np.outer(x[i] - x[j], x[i] - x[j])
        m = m - rate * (m @ s) / len(x)
    return m


@pytest.mark.parametrize("rows", [1024, 90])
def test_metric_equals_a_plain_version(spark, sf_dir, monkeypatch, rows):
    """Whatever the blocks; a class of one item has no friends and pushes nobody."""
    monkeypatch.setattr(metric, "ROWS", rows)
    x = spark.read.parquet(f"{sf_dir}/embeddings.parquet").where("vec_id < 300").select(F.col("vec_id").alias("item_id"), F.col("embedding").cast("array<double>").alias("vector"), F.when(F.col("vec_id") == 7, 99).otherwise(F.col("label")).alias("label"))
    reached = []
    for name, size in (("collect", len), ("toArrow", lambda t: t.num_rows)):
        monkeypatch.setattr(type(x), name, lambda self, f=getattr(type(x), name), size=size: reached.append(size(out := f(self))) or out)
    got = metric.fit_metric(x, 8, steps=3)
    assert max(reached) <= 8  # sums of tasks, and counts
    assert np.allclose(got, plain_metric(x, 8, 3), atol=1e-12)


def test_metric_without_labels(spark, sf_dir):
    x = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(F.col("vec_id").alias("item_id"), F.col("embedding").cast("array<double>").alias("vector"), F.lit(None).cast("int").alias("label"))
    assert np.allclose(metric.fit_metric(x, 4, steps=2), metric.pca_matrix(x, 4))


def test_metric_learns_from_all_items(spark):
    """Above the 20,000 that it once drew; one step against a plain one."""
    rng = np.random.default_rng(3)
    v, y = rng.standard_normal((20_200, 3)) * [3, 2, 1], rng.integers(0, 4, 20_200)
    x = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(zip(v.tolist(), y.tolist()))], "item_id long, vector array<double>, label int")
    m = metric.pca_matrix(x, 1)
    z, s = (v @ m.T)[:, 0], np.zeros((3, 3))
    for at in range(0, len(z), 500):
        d, own = (z[at : at + 500, None] - z) ** 2, y[at : at + 500, None] == y[None]
        friends, foes = np.where(own, d, np.inf), np.where(own, np.inf, d)
        friends[np.arange(len(d)), np.arange(at, at + len(d))] = np.inf
        near, far = (np.argpartition(t, 2, axis=1)[:, :3] for t in (friends, foes))
        reach = np.take_along_axis(friends, near, 1).max(1)
        pushed = np.take_along_axis(foes, far, 1) < reach[:, None] + 0.05
        for j in range(3):
            e, o = v[at : at + len(d)] - v[near[:, j]], (v[at : at + len(d)] - v[far[:, j]])[pushed[:, j]]
            s += 0.3 * e.T @ e - 0.45 * o.T @ o
    assert np.allclose(metric.fit_metric(x, 1, steps=1), m - 0.1 * (m @ s) / len(v), atol=1e-10)


@pytest.mark.parametrize("held, rate, searches", [(64, 0.01, 3), (64, 0.3, 12), (3, 0.1, 12)])
def test_metric_looks_anew_only_when_it_has_moved(spark, sf_dir, monkeypatch, held, rate, searches):
    """With copies of vectors, a class of two, and too many neighbours to hold."""
    for name, value in (("ROWS", 60), ("HELD", held)):
        monkeypatch.setattr(metric, name, value)
    x = spark.read.parquet(f"{sf_dir}/embeddings.parquet").where("vec_id < 200")
    x = x.unionByName(x.where("vec_id < 12").withColumn("vec_id", F.col("vec_id") + 500))
    x = x.select(F.col("vec_id").alias("item_id"), F.col("embedding").cast("array<double>").alias("vector"), F.when(F.col("vec_id").isin(7, 30), 99).otherwise(F.col("label")).alias("label"))
    sought, find = [], metric._found
    monkeypatch.setattr(metric, "_found", lambda *a: sought.append(1) or find(*a))
    assert np.allclose(metric.fit_metric(x, 8, steps=12, rate=rate), plain_metric(x, 8, 12, rate=rate), atol=1e-10)
    assert len(sought) <= searches
    assert held > 3 or len(sought) > 2
