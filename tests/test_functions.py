import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lodestone.errors import InvalidArguments
from lodestone.features import Colours, Words, registry
from lodestone.functions import codec, ids
from lodestone.functions import similarity as S
from lodestone.operators import inverted, topk, validate
from lodestone.operators.strip import leading_run


def row(spark, *cols):
    return spark.range(1).select(*cols).first()


def test_ids(spark):
    assert ids.content_id_of(b"abc") == row(spark, ids.content_id(F.lit("abc")))[0]
    assert ids.parse_id("A" * 40) == "a" * 40 and ids.parse_id(b"\x01" * 20) == "01" * 20
    for bad in ("a" * 39, "g" * 40, b"\x01" * 19):
        with pytest.raises(InvalidArguments):
            ids.parse_id(bad)
    assert row(spark, ids.from_hex(F.lit("zz")))[0] is None


def test_shard(spark):
    x = spark.createDataFrame([(f"{i:02x}" + "0" * 38,) for i in range(256)], "item_id string")
    assert x.where(ids.shard(F.col("item_id"), "01")).count() == 1
    assert x.where(ids.shard(F.col("item_id"), "00-0f")).count() == 16
    assert x.where(ids.shard(F.col("item_id"), ["8-b", "90-cf"])).count() == 48
    for bad in ("g", "5-3", "1-22", "", []):
        with pytest.raises(InvalidArguments):
            ids.shard(F.col("item_id"), bad)


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.integers(-(2**63), 2**63 - 1), min_size=2, max_size=2))
def test_blocks_round_trip(spark, blocks):
    text = codec.blocks_to_hex(F.array(*[F.lit(b) for b in blocks]))
    assert list(row(spark, codec.hex_to_blocks(text, 2))[0]) == blocks


def test_codec_rejects(spark):
    r = row(spark, codec.hex_to_blocks(F.lit("0" * 15), 1), codec.hex_to_words(F.lit(" a 1  a f ")), codec.text_to_floats(F.lit("1 x")), codec.text_to_floats(F.lit("1e0 -2.5"), 2))
    assert r[0] is None and list(r[1]) == [1, 10, 15] and r[2] is None and list(r[3]) == [1.0, -2.5]


def test_floats_to_text_rounds_exactly(spark):
    """Exact halves go to even, near halves to their own side, as C's printf has it."""
    near = [float(f"{m}5e{e}") for m in (1000000, 1289062, 2345678, 9999999) for e in (-40, -14, -8, -3, 0, 6, 11, 14, 30)]
    v = [2.0**-11, 0.12890625, *near, *[float(np.nextafter(x, 0)) for x in near], 2.0**62, 2.0**63, 1e300, 1.0, 0.1, 0.0, -0.0, float("inf")]
    v += [-x for x in v] + [float("nan")]
    got = spark.createDataFrame([(v,)], "v array<double>").select(codec.floats_to_text(F.col("v"))).first()[0]
    assert got.split() == [f"{x:.6e}" for x in v]
    odd = spark.createDataFrame([([0.12890625, None],)], "v array<float>").select(codec.floats_to_text(F.col("v")).alias("t")).select("t", codec.text_to_floats(F.col("t"))).first()
    assert tuple(odd) == ("1.289062e-01 null", None)


def test_similarities(spark):
    v = lambda *x: F.array(*[F.lit(float(a)) for a in x])
    r = row(
        spark, S.bit_cosine(F.array(F.lit(7).cast("long")), F.array(F.lit(3).cast("long"))), S.bit_cosine(F.array(F.lit(0).cast("long")), F.array(F.lit(3).cast("long"))),
        S.metric_similarity(v(1, 0), v(1, 0)), S.metric_similarity(v(1, 0), v(-1, 0)), S.residual_similarity(v(1, 0), v(-1, 0)), S.major_similarity(v(1, 2, 3), v(9, 9, 9), v(0, 0, 0), v(9, 9, 9)),
        S.colour_code_similarity(v(0, 0, 0, 0), v(255, 255, 255, 0)), S.step_gate(F.lit(0.7), 0.7), S.level_cosine(F.array(F.lit(4), F.lit(0)), F.array(F.lit(1), F.lit(3))),
    )
    assert np.allclose(r, [2 / np.sqrt(6), 0, 1, 0, 0, 1, 0, 0, 1 / 4])
    assert list(row(spark, S.normalized(v(0, 0)))[0]) == [-1.0, 0.0]


def test_feature_text_round_trip(spark):
    for kind, words in ((Words(2048, "boc"), [0, 63, 64, 2047]), (Words(524288, None, dense=False), [1, 500000])):
        colour = [0, 1, 2, 3, 4] + [0] * 59 if kind.colour else None
        f = F.struct(F.array(*[F.lit(w).cast("long") for w in words]).alias("words"), (F.array(*[F.lit(c) for c in colour]) if colour else F.lit(None).cast("array<int>")).alias("colour"), F.lit(None).cast("array<double>").alias("vec"))
        text = row(spark, kind.encode(f))[0]
        back = row(spark, kind.decode(F.lit(text)).alias("f")).f
        assert back.words == words and back.colour == colour
        assert row(spark, kind.decode(F.lit(text + "!")).alias("f")).f is None or not kind._blocks
        assert row(spark, kind.score(f, f, {"color_weight": 0.3}))[0] == pytest.approx(1)
    assert len(registry()) == 43 and isinstance(registry()["color"][0], Colours)


def test_dense_tfidf_equals_sparse(spark):
    rng = np.random.default_rng(0)
    w = {i: float(v) for i, v in enumerate(rng.random(40))}
    a, b = (sorted(rng.choice(40, 12, replace=False).tolist()) for _ in range(2))
    dense = lambda s: np.array([w[i] * (i in s) for i in range(40)])
    weight = F.create_map(*[F.lit(x) for kv in w.items() for x in kv])
    got = row(spark, S.set_cosine(F.array(*map(F.lit, a)), F.array(*map(F.lit, b)), weight))[0]
    x, y = dense(a), dense(b)
    assert got == pytest.approx(x @ y / np.linalg.norm(x) / np.linalg.norm(y))


def test_index_search_is_the_exact_one_above_the_threshold(spark):
    rng = np.random.default_rng(1)
    sets = {i: set(rng.choice(60, 20, replace=False).tolist()) for i in range(40)}
    posts = spark.createDataFrame([(i, int(w)) for i, s in sets.items() for w in s], "item long, word long")
    weights = spark.createDataFrame([(w, 0.0 if w == 5 else 1.0 + w / 60) for w in range(60)], "word long, weight double")
    queries = posts.where("item < 3").selectExpr("item as query", "word")
    wt = {w: 0.0 if w == 5 else 1.0 + w / 60 for w in range(60)}
    found = {(r.query, r.item): r.similarity for r in inverted.index_topk(posts, weights, queries, 100, 8).collect()}
    norm = {i: sum(wt[w] ** 2 for w in s) ** 0.5 for i, s in sets.items()}
    want = {(q, i): sum(wt[w] ** 2 for w in sets[q] & s) / norm[q] / norm[i] for q in range(3) for i, s in sets.items() if len([w for w in sets[q] & s if wt[w] > 0]) > 8}
    assert found.keys() == want.keys() and all(found[k] == pytest.approx(want[k]) for k in want)


def test_dense_topk_many_equals_numpy(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(300, 8))
    x[7] = x[3]
    items = spark.createDataFrame([(i, v.tolist(), int(i % 3)) for i, v in enumerate(x)], "item_id long, vector array<double>, label int").repartition(5)
    queries, missing = items.selectExpr("item_id as query_id", "vector"), spark.createDataFrame([(500, None, 0)], items.schema)
    for few in ({}, {"most_queries": 10, "block": 64}):  # broadcast, and in blocks
        got = {}
        for r in topk.dense_topk_many(items.union(missing), queries.where("query_id < 20"), 6, **few).collect():
            got.setdefault(r.query_id, {})[r.rank] = r.item_id
        assert len(got) == 20
        for q in range(20):
            assert [got[q][i] for i in range(1, 7)] == sorted(range(300), key=lambda i: (-round(x[q] @ x[i], 12), i))[:6]
    assert topk.dense_topk_many(items.where("false"), queries, 6, most_queries=10).count() == 0
    assert topk.dense_topk_many(items.where("item_id < 4"), queries, 6, most_queries=10, block=64).count() == 1200
    assert topk.dense_topk_many(items, items.selectExpr("item_id as query_id", "vector").where("false"), 3).count() == 0
    assert validate.group_score(items).first().queries == 300


def test_topk_arguments(spark):
    x = spark.createDataFrame([(1, 1)], "item_id long, flag int")
    with pytest.raises(InvalidArguments):
        topk.topk(x, F.lit(1.0), 0)


def test_strip():
    assert leading_run(np.array([0.99, 0.98, 0.3, 0.29, 0.28])) >= 1
    assert leading_run(np.array([])) == 0
    assert leading_run(np.array([0.5] * 4)) == 4
