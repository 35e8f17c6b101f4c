"""Life of an engine: insert, pull, search, remove, shards, streams; and the image path under it."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone.engine import Engine
from lodestone.errors import InvalidArguments, NoData, NotSupported, SystemFailure
from lodestone.features import Models
from lodestone.functions.ids import content_id_of
from lodestone.operators import aggregate, training
from lodestone.sources import images as I
from lodestone.sources.kvs import KVS


def picture(seed: int, shift: int = 0) -> bytes:
    rng = np.random.default_rng(seed)
    base = np.kron(rng.integers(0, 255, (8, 8, 3)), np.ones((8, 8, 1)))
    return I.encode_png(np.roll(base, shift, axis=1).astype(np.uint8))


@pytest.fixture(scope="module")
def palette(spark):
    rng = np.random.default_rng(0)
    rows = [(i, [float(rng.uniform(0, 360)), float(rng.random()), float(rng.random())]) for i in range(64)]
    return spark.createDataFrame(rows, "label int, vec array<double>").cache()


@pytest.fixture
def config(tmp_path):
    return lambda **driver: {"namespace": "test", "driver": {"name": "color", "data_dir": str(tmp_path / driver.pop("node", "a")), **driver}, "database": {"name": str(tmp_path / "db")}}


def test_png_round_trip(spark, tmp_path):
    rng = np.random.default_rng(3)
    x = rng.integers(0, 255, (5, 7, 3)).astype(np.uint8)
    assert (I.decode(I.encode_png(x)) == x).all()
    assert I.decode(b"no image") is None and I.decode(b"\x89PNG\r\n\x1a\nbroken") is None
    assert (I.decode(b"P6 7 5 255\n" + x.tobytes()) == x).all()
    path = tmp_path / "x.png"
    path.write_bytes(I.encode_png(x))
    from_file = I.read_files(spark, str(path)).first()
    from_bytes = I.read_bytes(spark.createDataFrame([(bytearray(I.encode_png(x)),)], "content binary")).first()
    assert from_file.item_id == from_bytes.item_id == content_id_of(path.read_bytes())
    assert from_file.image == from_bytes.image


def test_pixels_crop_and_order(spark):
    x = np.arange(2 * 3 * 3).reshape(2, 3, 3).astype(np.uint8)
    img = I.read_bytes(spark.createDataFrame([(bytearray(I.encode_png(x)),)], "content binary"))
    got = {(r.x, r.y): (r.r, r.g, r.b) for r in I.pixels(img).collect()}
    assert got == {(c, r): tuple(x[r, c]) for r in range(2) for c in range(3)}
    crop = {(r.x, r.y): r.r for r in I.pixels(img, region=(1, 1, 9, 9)).collect()}
    assert crop == {(0, 0): x[1, 1, 0], (1, 0): x[1, 2, 0]}
    flipped = {(r.x, r.y): r.r for r in I.pixels(img, flip=True).collect()}
    assert flipped[0, 0] == x[0, 2, 0]
    raw = spark.range(1).select(I.from_pixels(F.lit(x.tobytes()), F.lit(3), F.lit(2), "rgb").alias("i")).first().i
    assert bytes(raw.data) == x[..., ::-1].tobytes()
    hue = spark.range(1).select(I.hsv(F.lit(0), F.lit(255), F.lit(0)).alias("h")).first().h
    assert hue == [120.0, 1.0, 1.0]


def test_lifecycle(spark, palette, config, tmp_path):
    e = Engine.open(spark, config(), Models(palette=palette))
    assert e.active
    e.create_database()
    e.create_database()
    a, b, blank = picture(1), picture(2), I.encode_png(np.full((64, 64, 3), 255, np.uint8))
    assert e.insert({"data": a}) == content_id_of(a)
    assert e.insert({"data": a}) == content_id_of(a)
    e.insert({"data": b})
    e.insert({"data": blank})
    assert e.count() == 0
    e.pull()
    e.pull()
    assert e.count() == 3
    e.vacuum_index()
    assert e.count() == 3
    e.drop_index()
    assert e.count() == 0
    e.pull()
    found = e.search(10, {"data": a}).collect()
    assert found[0].item_id == content_id_of(a) and found[0].similarity == pytest.approx(1) and len(found) == 3
    text = e.feature_string({"data": a})
    path = tmp_path / "a.png"
    path.write_bytes(a)
    for q in ({"file": str(path)}, {"string": text}, {"id": content_id_of(a)}, {"raw": e.feature_raw({"data": a})}):
        got = e.search(10, q).collect()
        assert [(r.item_id, round(r.similarity, 6)) for r in got] == [(r.item_id, round(r.similarity, 6)) for r in found]
    e.remove(content_id_of(a))
    e.remove("0" * 40)
    e.pull()
    assert content_id_of(a) not in [r.item_id for r in e.search(10, {"id": content_id_of(a)}).collect()]
    assert e.count() == 3 and e.live_count() == 2
    assert e.exists(spark.createDataFrame([(content_id_of(a),), ("1" * 40,)], "item_id string").orderBy("item_id")).where("found").count() == 1
    e.insert({"data": a})
    e.pull()
    assert e.search(1, {"data": a}).first().item_id == content_id_of(a)
    assert e.similarity({"data": a}, {"data": picture(1, 3)}) > e.similarity({"data": a}, {"data": blank})
    e.set("strip", "true")
    assert e.search(10, {"data": a}).count() >= 1
    e.drop_database()
    e.close()
    assert not e.active


def test_errors(spark, palette, config, tmp_path):
    with pytest.raises(SystemFailure):
        Engine.open(spark, str(tmp_path / "none.yaml"))
    with pytest.raises(InvalidArguments):
        Engine.open(spark, {"namespace": "ok-success", "driver": {"name": "color"}})
    with pytest.raises(InvalidArguments):
        Engine.open(spark, {"driver": {"name": "nothing"}})
    with pytest.raises(InvalidArguments):
        Engine.open(spark, {})
    e = Engine.open(spark, config(), Models(palette=palette))
    e.create_database()
    with pytest.raises(InvalidArguments):
        e.insert({"data": b"not an image"})
    with pytest.raises(SystemFailure):
        e.insert({"file": str(tmp_path / "none.png")})
    with pytest.raises(InvalidArguments):
        e.search(1, {})
    with pytest.raises(InvalidArguments):
        e.search(0, {"data": picture(1)})
    with pytest.raises(InvalidArguments):
        e.search(1, {"string": "xyz"})
    with pytest.raises(NoData):
        e.search(1, {"id": "0" * 40})
    with pytest.raises(InvalidArguments):
        e.invoke("update_idf")
    n = Engine.open(spark, config(name="color_nodb"), Models(palette=palette))
    with pytest.raises(NotSupported):
        n.insert({"data": picture(1)})
    assert n.similarity({"data": picture(1)}, {"data": picture(1)}) == pytest.approx(1)


def test_two_shards_and_stream(spark, palette, config, tmp_path):
    low, high = (Engine.open(spark, config(node=n, shard=s), Models(palette=palette)) for n, s in (("n1", "0-7"), ("n2", "8-f")))
    low.create_database()
    data = [picture(i) for i in range(4)]
    for d in data:
        low.insert({"data": d})
    low.pull()
    high.pull_stream(str(tmp_path / "offsets"))
    high.pull_stream(str(tmp_path / "offsets"))
    small = sum(content_id_of(d)[0] < "8" for d in data)
    assert (low.count(), high.count()) == (small, 4 - small)
    victim = content_id_of(data[0])
    high.remove(victim)
    low.pull()
    high.pull_stream(str(tmp_path / "offsets"))
    assert low.live_count() + high.live_count() == 3


def test_words_engine(spark, tmp_path):
    """Trees and weights trained on a few pictures; dense search with weights agrees with itself, the index finds itself."""
    data = [picture(i) for i in range(4)]
    imgs = I.read_bytes(spark.createDataFrame([(bytearray(d),) for d in data], "content binary")).cache()
    points = I.grid_points(imgs).cache()
    assert points.count() > 0
    trees = [training.centroid_tree(p, [3, 3], 5) for p in (points.where("response > 0"), points.where("response <= 0"))]
    idf = spark.createDataFrame([(w, 1.0 + w / 50) for w in range(18)], "word long, weight double")
    models = Models(bright=trees[0], dark=trees[1], idf=idf)
    for name in ("bovw2k", "id"):
        e = Engine.open(spark, {"driver": {"name": name, "data_dir": str(tmp_path / name), "hit_threshold": 1}}, models)
        e.create_database()
        e.insert(imgs)
        e.pull()
        assert e.count() == 4
        best = e.search(2, {"data": data[2]}).first()
        assert best.item_id == content_id_of(data[2]) and best.similarity == pytest.approx(1)
        weights = e.invoke("update_idf" if name == "bovw2k" else "print_idf")
        assert weights.count() == e.kind.size
        with pytest.raises(InvalidArguments):
            e.invoke("no_such")
    # the same index from a stream, which may replay, answers alike; so does it once its batches are merged
    want = [tuple(r) for r in e.search(4, {"data": data[2]}).collect()]
    streamed = Engine.open(spark, {"driver": {"name": "id", "data_dir": str(tmp_path / "streamed"), "hit_threshold": 1}}, models)
    streamed.create_database()
    for half in (imgs.limit(2), imgs):
        streamed.insert(half)
        streamed.pull_stream(str(tmp_path / "offsets-id"))
    streamed.pull_stream(str(tmp_path / "offsets-again"))
    assert streamed.postings.items().count() == 4
    assert [tuple(r) for r in streamed.search(4, {"data": data[2]}).collect()] == want
    streamed.pull()
    streamed.vacuum_index()
    assert len([r for r in streamed.postings.batches() if r.items]) == 1 and [tuple(r) for r in streamed.search(4, {"data": data[2]}).collect()] == want
    e.set("color_weight", "0.5")
    assert e.get("color_weight") == 0.5
    e.unset("color_weight")
    assert e.get("color_weight") == 0


def test_residuals_and_metric(spark):
    rng = np.random.default_rng(4)
    book = rng.normal(size=(3, 6))
    pts = [(int(i % 2), rng.normal(size=6)) for i in range(40)]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in pts], "item int, vec array<double>")
    cb = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(book)], "label int, vec array<double>")
    got = {(r.item, r.label, r.dim): r.value for r in aggregate.residuals(aggregate.nearest(df, cb, ["item"]), cb).collect()}
    for item in (0, 1):
        want = np.zeros((3, 6))
        for i, v in pts:
            if i == item:
                k = ((book - v) ** 2).sum(1).argmin()
                want[k] += v - book[k]
        want /= np.linalg.norm(want)
        for (i, label, dim), value in got.items():
            if i == item:
                assert value == pytest.approx(want[label, dim])
    items = spark.createDataFrame([(i, (rng.normal(size=6) + 3 * np.eye(6)[i % 3]).tolist(), i % 3) for i in range(60)], "item_id long, vector array<double>, label int")
    m = training.fit_metric(items, 3, steps=5)
    assert m.shape == (3, 6) and np.isfinite(m).all()
    assert training.projected(items, m).selectExpr("size(vector) as n").distinct().first().n == 3


def test_kvs(spark, tmp_path):
    kv = KVS(spark, str(tmp_path / "kv"))
    kv.set_many([(str(i), str(i * 11)) for i in range(10)])
    kv.set("3", "x")
    kv.delete("4")
    assert kv.get("3") == b"x" and kv.get("5") == b"55"
    with pytest.raises(NoData):
        kv.get("4")
    kv.vacuum()
    # a vacuum that fails before its marker is there leaves the store as it was
    with pytest.MonkeyPatch.context() as m:
        m.setattr("lodestone.sources.kvs.touch", lambda *_: (_ for _ in ()).throw(OSError("lost")))
        with pytest.raises(OSError):
            kv.vacuum()
    assert KVS(spark, str(tmp_path / "kv")).get("5") == b"55"
    kv.vacuum()
    seen = []
    kv.each_key(lambda k: seen.append(k) or len(seen) == 4)
    assert len(seen) == 4 and sorted(kv) == sorted(str(i).encode() for i in range(10) if i != 4)
    kv.clear()
    assert list(kv) == []


def test_dense(spark):
    rows = [("a", 0, 1.0), ("a", 3, 2.0), ("b", 4, 5.0), ("c", 2, 3.0)]
    got = {r.k: r.v for r in aggregate.dense(spark.createDataFrame(rows, "k string, index long, value double"), "k", 5, F.lit(0.0), "v").collect()}
    assert got == {"a": [1, 0, 0, 2, 0], "b": [0, 0, 0, 0, 5], "c": [0, 0, 3, 0, 0]}


def test_metric_kinds(spark, palette):
    imgs = I.read_bytes(spark.createDataFrame([(bytearray(picture(i)),) for i in range(2)], "content binary")).cache()
    book = training.centroids(training.sampled(I.grid_points(imgs).select("item", "vec"), 200), 4, 5)
    models = Models(palette=palette, codebook=book)
    for name in ("vlad_nodb", "lmca_vlad_nodb", "lmca_hsv_nodb", "lmca_vlad_hsv_nodb", "lmca_vladhsv_nodb", "lmca_vlad_colorcode_nodb"):
        e = Engine.open(spark, {"driver": {"name": name}}, models)
        if name == "lmca_vlad_hsv_nodb":
            e.options["colour_dims"] = 1024
        same, other = e.similarity({"data": picture(0)}, {"data": picture(0)}), e.similarity({"data": picture(0)}, {"data": picture(1)})
        assert same == pytest.approx(1) and other < same
