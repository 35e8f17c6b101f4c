"""Registered queries of what models are trained from and by, with their SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import aggregate, clusters, inverted, training
from ..sources import images
from ..streaming.pull import stream_postings
from .catalogue import query, vectors
from .extra import _PIXELS8, _pictures, scratch

def _points(spark, sf_dir) -> DataFrame:
    """(item, sign, point, vec): twenty vectors in a row are an image's key points, the first value is the response."""
    x = vectors(spark, sf_dir)
    return x.select(F.floor(F.col("item_id") / 20).cast("long").alias("item"), (F.col("vector")[0] > 0).cast("int").alias("sign"), F.col("item_id").alias("point"), F.col("vector").alias("vec"))


@query("""
WITH p AS (SELECT vec_id // 20 AS item, (embedding[1] > 0)::INT AS sign, vec_id AS point FROM embeddings),
i AS (SELECT item FROM (SELECT DISTINCT item FROM p) ORDER BY md5(item::VARCHAR), item LIMIT 2000),
a AS (SELECT *, md5(concat_ws(':', item::VARCHAR, sign::VARCHAR, point::VARCHAR)) AS h FROM p WHERE item IN (SELECT item FROM i)),
b AS (SELECT *, row_number() OVER (PARTITION BY item, sign ORDER BY h) AS place FROM a),
c AS (SELECT *, row_number() OVER (PARTITION BY sign ORDER BY md5('codebook:' || h)) AS drawn FROM b WHERE place <= 8)
SELECT item, sign, point FROM c WHERE drawn <= 10000
""")
def q72_point_sample(spark, sf_dir):
    """Points to train from: 2000 images, of each up to 8 points a sign, of these up to 10,000 a sign."""
    return training.sampled_points(_points(spark, sf_dir), 2000, 8, 10_000, ["point"]).drop("vec")


@query("""
WITH e AS (SELECT vec_id, embedding::DOUBLE[] AS v, (embedding[1] > 0)::INT AS sign FROM embeddings),
c AS (SELECT vec_id % 4 AS label, (vec_id < 4)::INT AS sign, embedding::DOUBLE[] AS c FROM embeddings WHERE vec_id < 8),
a AS (SELECT e.vec_id, e.sign, c.label, list_sum(list_transform(range(1, 65), lambda i: (v[i] - c[i]) * (v[i] - c[i]))) AS d FROM e JOIN c USING (sign)),
w AS (SELECT vec_id, arg_min(label, struct_pack(d := d, l := label)) + CASE WHEN sign = 1 THEN 0 ELSE 4 END AS word FROM a GROUP BY vec_id, sign),
n AS (SELECT word, count(*) AS n FROM w GROUP BY word)
SELECT u.word, coalesce(n, 0) AS n, round(log2(((SELECT count(*) FROM w) + 0.5e0) / (coalesce(n, 0) + 0.5e0)) + 1, 6) AS weight FROM (SELECT unnest(range(8)) AS word) u LEFT JOIN n ON n.word = u.word
""")
def q73_pooled_idf(spark, sf_dir):
    """One table of weights over the words of both signs' codebooks, from a union of their counts."""
    x = training.split_by_sign(vectors(spark, sf_dir).select("item_id", F.col("vector").alias("vec"), F.col("vector")[0].alias("response")))
    counts = None
    for sign, lo in ((1, 0), (0, 4)):
        book = vectors(spark, sf_dir).where(F.col("item_id").between(lo, lo + 3)).select((F.col("item_id") % 4).cast("int").alias("label"), F.col("vector").alias("vec"))
        own = aggregate.nearest(x.where(F.col("sign") == sign), book, ["item_id"]).groupBy("label").agg(F.count("*").alias("n")).select(F.lit(sign).alias("sign"), "label", "n")
        counts = own if counts is None else counts.unionByName(own)
    return training.pooled_weights(counts, 4).withColumn("weight", F.round("weight", 6))


@query()
def q77_signed_codebooks(spark, sf_dir):
    """Two codebooks of 32 from points drawn by image and sign, the words of all points, their pooled weights, and each
    image's weighted residuals: (item, word, points, weight, residual)."""
    points = _points(spark, sf_dir)
    books = training.signed_codebooks(training.sampled_points(points, 2000, 8, 10_000, ["point"]), 32)
    return signed_residuals(points, books, 32).withColumn("residual", F.transform("residual", lambda v: F.round(v, 6)))


def signed_residuals(points: DataFrame, books: DataFrame, half: int) -> DataFrame:
    """(item, word, points, weight, residual) of points (item, sign, vec): how many of an image's points took a word, the
    word's pooled weight, and the sum of their differences from the word's centre."""
    unit = points.select("item", "sign", clusters.normalized(F.col("vec")).alias("vec"))
    of = lambda s: books.where(F.col("sign") == s).select("label", "vec")
    words = aggregate.signed_words(unit, of(1), of(0), half, ["item", "sign"])
    centres = F.broadcast(books.select(F.when(F.col("sign") == 1, F.col("label")).otherwise(F.col("label") + half).alias("word"), F.col("vec").alias("c_")))
    x = words.join(centres, "word").select("item", "word", F.zip_with("vec", "c_", lambda a, b: a - b).alias("d_"))
    dim = len(books.first().vec)
    x = x.groupBy("item", "word").agg(F.count("*").alias("points"), F.array(*[F.sum(F.col("d_")[i]) for i in range(dim)]).alias("residual"))
    counts = words.groupBy("sign", F.when(F.col("sign") == 1, F.col("word")).otherwise(F.col("word") - half).alias("label")).agg(F.count("*").alias("n"))
    weights = F.broadcast(training.pooled_weights(counts, half).select(F.col("word").cast("int").alias("word"), "weight"))
    return x.join(weights, "word").select("item", "word", "points", F.round("weight", 6).alias("weight"), "residual")


# stored indexes: the large values of a vector, with their signs, are its words

_TOP = """
WITH e AS (SELECT vec_id AS item, unnest(range(64)) AS i, unnest(embedding)::DOUBLE AS v FROM embeddings), p AS (SELECT item, i * 2 + (v > 0)::INT AS word FROM e WHERE abs(v) >= 0.2e0),
n AS (SELECT count(DISTINCT item)::DOUBLE AS n FROM p), w AS (SELECT word, log2((n.n + 0.5e0) / (count(*) + 0.5e0)) + 1 AS weight FROM p, n GROUP BY word, n.n),
m AS (SELECT item, sqrt(sum(weight * weight)) AS norm FROM p JOIN w USING (word) GROUP BY item),
s AS (SELECT q.item AS query, p.item AS item, count(*) AS hits, sum(weight * weight) / (any_value(a.norm) * any_value(b.norm)) AS similarity
      FROM p q JOIN p USING (word) JOIN w USING (word) JOIN m a ON a.item = q.item JOIN m b ON b.item = p.item WHERE q.item % 50 = 0 GROUP BY q.item, p.item)
SELECT query, item, hits, round(similarity, 6) AS similarity, rank FROM (
  SELECT *, row_number() OVER (PARTITION BY query ORDER BY round(similarity, 9) DESC, item)::INT AS rank FROM s WHERE hits > 2) WHERE rank <= 10
"""


def _large_values(spark, sf_dir) -> DataFrame:
    """(item, word)"""
    x = vectors(spark, sf_dir).select(F.col("item_id").alias("item"), F.posexplode("vector").alias("i", "v")).where(F.abs("v") >= 0.2)
    return x.select("item", (F.col("i") * 2 + (F.col("v") > 0).cast("int")).cast("long").alias("word"))


def _found(index: inverted.StoredIndex, posts: DataFrame) -> DataFrame:
    asked = posts.where(F.col("item") % 50 == 0).select(F.col("item").alias("query"), "word")
    return index.search(asked, 10, 2).withColumn("similarity", F.round("similarity", 6))


@query(_TOP)
def q75_compacted_index(spark, sf_dir):
    """An index written in five batches, merged by levels on the way and into one at the end."""
    posts = _large_values(spark, sf_dir)
    index = inverted.StoredIndex(spark, scratch(spark, "merged"), ranges=8, fanout=3)
    for part in range(5):
        index.add(posts.where(F.col("item") % 5 == part))
    index.compact()
    return _found(index, posts)


@query(_TOP)
def q76_streamed_index(spark, sf_dir):
    """An index fed by a file stream, a batch a file, and then by the same files again, which adds nothing."""
    posts, root = _large_values(spark, sf_dir), scratch(spark, "streamed")
    posts.repartition(3, "item").write.parquet(f"{root}/posts")
    index = inverted.StoredIndex(spark, f"{root}/index", ranges=8)
    for checkpoint in ("one", "again"):
        source = spark.readStream.schema(posts.schema).option("maxFilesPerTrigger", 1).parquet(f"{root}/posts")
        stream_postings(index, source, f"{root}/{checkpoint}").awaitTermination()
    return _found(index, posts)


# pictures


@query(f"""
WITH {_PIXELS8}, o AS (SELECT n, unnest(range(n)) AS t FROM (SELECT unnest([4, 3]) AS n)),
c AS (SELECT n, t, i, greatest(0.0e0, least(i + 1.0e0, (t + 1) * 8.0e0 / n) - greatest(i + 0.0e0, t * 8.0e0 / n)) * n / 8.0e0 AS w FROM o, (SELECT unnest(range(8)) AS i))
SELECT id AS item_id, a.n::INT AS size, a.t::INT AS x, b.t::INT AS y, {", ".join(f"floor(round(sum(a.w * b.w * {c}), 6) + 0.5e0)::INT AS {c}" for c in "rgb")}
FROM px JOIN c a ON a.i = px.x JOIN c b ON b.i = px.y AND b.n = a.n GROUP BY id, a.n, a.t, b.t
""")
def q78_image_resize(spark, sf_dir):
    """Pictures of 8 x 8 halved, and scaled by 3/8: means of the areas that the new pixels cover."""
    parts = [images.pixels(images.resized(_pictures(spark, sf_dir), n / 8)).select("item_id", F.lit(n).alias("size"), "x", "y", "r", "g", "b") for n in (4, 3)]
    return parts[0].unionByName(parts[1])


@query()
def q79_major_colours(spark, sf_dir):
    """From pixels to two colours: the means of the two largest of up to 32 clusters of each picture."""
    return images.major_colours(_pictures(spark, sf_dir))
