"""Models, strip and pictures against plain versions, and what calls refuse."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone.errors import InvalidArguments
from lodestone.functions import ids
from lodestone.operators import inverted, strip, topk, training
from lodestone.plans.catalogue import QUERIES
from lodestone.sources import images, kvs, tables
from lodestone.sources.catalog import table_name


def points(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(F.col("vec_id").alias("item_id"), F.col("embedding").cast("array<double>").alias("vec"))


def test_kmeans_has_settled(spark, sf_dir):
    """Every centre is the mean of the points nearest to it, and the query's figures are those of that assignment."""
    x = points(spark, sf_dir)
    v = np.array([r.vec for r in x.collect()])
    c = np.array([r.vec for r in training.centroids(x, 10).orderBy("label").collect()])
    d = ((v[:, None] - c[None]) ** 2).sum(-1)
    near = d.argmin(1)
    for k in range(10):
        assert np.allclose(v[near == k].mean(0), c[k], atol=2e-2)
    got = {r.label: r for r in QUERIES["q27_kmeans"](spark, sf_dir).collect()}
    for k in range(10):
        own = np.sqrt(d[near == k, k])
        assert got[k].points == len(own) and got[k].least == pytest.approx(own.min()) and got[k].most == pytest.approx(own.max())


def test_tree_descends_by_the_beam(spark, sf_dir):
    """Point by point and path by path; with the widest beam, the nearest leaf of all."""
    x = points(spark, sf_dir)
    tree = training.centroid_tree(x, [4, 4])
    number = {p: i for i, p in enumerate(tree.leaves)}
    for beam in (1, 4, 16):
        got = {r.item_id: (r.label, r.distance) for r in tree.predict(x, beam).collect()}
        for r in x.limit(150).collect():
            front = [()]
            for level in tree.levels:
                below = sorted((sum((a - b) ** 2 for a, b in zip(level[p], r.vec)), p) for p in level if p[:-1] in front)
                front = [p for _, p in below[:beam]]
            assert got[r.item_id][0] == number[front[0]] and got[r.item_id][1] == pytest.approx(below[0][0])
    every = {p: v for p, v in tree.levels[-1].items()}
    for r in x.limit(50).collect():
        assert got[r.item_id][1] == pytest.approx(min(((v - np.array(r.vec)) ** 2).sum() for v in every.values()))


def test_metric_search_equals_numpy(spark, sf_dir):
    x = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(F.col("vec_id").alias("item_id"), F.col("embedding").cast("array<double>").alias("vector"), "label")
    m = training.fit_metric(x, 16)
    rows = x.collect()
    z = np.array([r.vector for r in rows]) @ m.T
    z /= np.linalg.norm(z, axis=1)[:, None]
    at = [r.item_id for r in rows].index(0)
    want = sorted(((round(-(1 - np.sqrt(((v - z[at]) ** 2).sum()) / 2), 6), r.item_id) for v, r in zip(z, rows)))[:10]
    got = [(r.similarity, r.item_id) for r in QUERIES["q27c_metric"](spark, sf_dir).orderBy("rank").collect()]
    assert [i for _, i in got] == [i for _, i in want] and [s for s, _ in got] == pytest.approx([-s for s, _ in want], abs=2e-6)


def plain_leading_run(scores):
    if len(scores) <= 16:
        return len(scores)
    distinct = sorted(set(scores))
    k = min(16, len(distinct))
    ordered = sorted(scores)
    place = [i / (k - 1) * (len(ordered) - 1) for i in range(k)] if k > 1 else [0]
    centres = [ordered[int(p)] + (p - int(p)) * (ordered[min(int(p) + 1, len(ordered) - 1)] - ordered[int(p)]) for p in place]
    for _ in range(50):
        label = [min(range(k), key=lambda c: (abs(s - centres[c]), c)) for s in scores]
        new = [sum(own) / len(own) if (own := [s for s, at in zip(scores, label) if at == c]) else centres[c] for c in range(k)]
        if all(abs(a - b) <= 1e-8 + 1e-5 * abs(b) for a, b in zip(new, centres)):
            break
        centres = new
    runs = [0]
    for a, b in zip(label, label[1:]):
        runs += [runs[-1] + (a != b)]
    keep = sum(r == 0 for r in runs)
    return keep + sum(r == 1 for r in runs) if min(scores[:keep]) >= 0.8 else keep


def test_strip_equals_a_plain_version(spark, sf_dir):
    rng = random.Random(4)
    for n in (0, 1, 16, 17, 40, 80):
        for _ in range(20):
            scores = sorted((round(rng.choice([0.95, 0.85, 0.6, 0.3]) + rng.random() * 0.05, 6) for _ in range(n)), reverse=True)
            assert strip.leading_run(np.array(scores)) == plain_leading_run(scores)
    x = spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()
    q = np.array(next(r.embedding for r in x if r.vec_id == 0), np.float64)
    best = sorted(((-round(float(q @ np.array(r.embedding, np.float64)), 6), r.vec_id) for r in x))[:80]
    want = [i for _, i in best][: plain_leading_run([-s for s, _ in best])]
    assert [r.item_id for r in QUERIES["q31_strip"](spark, sf_dir).orderBy("rank").collect()] == want


def test_png_filters(spark):
    """All five row filters, for one to four channels, against a byte-by-byte version."""
    import struct
    import zlib

    rng = np.random.default_rng(6)
    for kind, channels in ((0, 1), (2, 3), (4, 2), (6, 4)):
        h, w = 10, 7
        raw = rng.integers(0, 256, (h, w * channels)).astype(np.uint8)
        filters = rng.permutation(np.repeat(np.arange(5), 2))
        part = lambda name, data: struct.pack(">I", len(data)) + name + data + b"\0\0\0\0"
        body = b"".join(bytes([f]) + row.tobytes() for f, row in zip(filters, raw))
        png = b"\x89PNG\r\n\x1a\n" + part(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, kind, 0, 0, 0)) + part(b"IDAT", zlib.compress(body)) + part(b"IEND", b"")
        out = [[0] * (w * channels) for _ in range(h)]
        for y in range(h):
            for x in range(w * channels):
                a = out[y][x - channels] if x >= channels else 0
                b = out[y - 1][x] if y else 0
                c = out[y - 1][x - channels] if y and x >= channels else 0
                p = a + b - c
                paeth = min((abs(p - a), 0, a), (abs(p - b), 1, b), (abs(p - c), 2, c))[2]
                out[y][x] = (int(raw[y, x]) + [0, a, b, (a + b) // 2, paeth][filters[y]]) % 256
        want = np.array(out, np.uint8).reshape(h, w, channels)
        want = want[..., :3] if channels >= 3 else np.repeat(want[..., :1], 3, axis=2)
        assert (images.decode(png) == want).all()


def test_many_queries_come_in_parts(spark):
    x = spark.range(200).select(F.col("id").alias("item_id"))
    q = spark.range(40).select(F.col("id").alias("query_id"))
    score = -F.abs(F.col("item_id") - F.col("query_id") * 3)
    one, parts = (topk.topk_many(x, q, score, 3, most_queries=n).collect() for n in (100, 9))
    assert sorted(map(tuple, one)) == sorted(map(tuple, parts)) and len(one) == 120


def test_wide_shards(spark):
    x = spark.range(3000).select(F.sha1(F.col("id").cast("string")).alias("i"))
    got = {r.i for r in x.where(ids.shard(F.col("i"), "0ab1-F00f")).collect()}
    assert got == {r.i for r in x.collect() if "0ab1" <= r.i[:4] <= "f00f"}


def test_what_calls_refuse(spark):
    none = spark.createDataFrame([], "item long, word long")
    with pytest.raises(InvalidArguments):
        inverted.index_topk(none, spark.createDataFrame([], "word long, weight double"), spark.createDataFrame([], "query long, word long"), 0)
    with pytest.raises(InvalidArguments):
        topk.topk(none, F.lit(1.0), 0)
    for bad in ("a-b", "a b", "ü"):
        with pytest.raises(InvalidArguments):
            table_name(bad, "sim")
    with pytest.raises(InvalidArguments):
        tables.Field("a;b", "int")
    with pytest.raises(InvalidArguments):
        tables.seek(none, [F.col("item")], -1, 5)
    with pytest.raises(InvalidArguments):
        ids.parse_id("xyz")
    assert ids.parse_id(bytes(20)) == "00" * 20


def test_cursor_stops_early(spark, tmp_path):
    store, seen = kvs.KVS(spark, f"{tmp_path}/kv"), []
    store.set_many([(str(i), str(i * 11)) for i in range(20)])
    store.each_pair(lambda k, v: seen.append((k, v)) or len(seen) == 5)
    assert len(seen) == 5 and all(int(v) == 11 * int(k) for k, v in seen)


def test_stored_index_shows_whole_batches_alone(spark, tmp_path):
    index = inverted.StoredIndex(spark, f"{tmp_path}/index", 4)
    posts = spark.createDataFrame([(i, w) for i in range(30) for w in range(i % 5, 20)], "item long, word long")
    index.add(posts.where("item < 10"))
    kept = sorted(map(tuple, index.postings().select("item", "word").collect()))
    # a write that ended before its row of batches
    posts.where("item >= 10").selectExpr("item", "word", "'lost' AS batch", "0 AS range_").write.mode("append").partitionBy("batch", "range_").parquet(f"{tmp_path}/index/postings")
    assert sorted(map(tuple, index.postings().select("item", "word").collect())) == kept
    index.add(posts)
    assert sorted(map(tuple, index.postings().select("item", "word").collect())) == sorted(map(tuple, posts.collect())) and index.items().count() == 30
    plan = index.near(spark.createDataFrame([(3,)], "word long"))._jdf.queryExecution().executedPlan().toString()
    assert "range_" in plan.split("PartitionFilters")[1].split("PushedFilters")[0]
