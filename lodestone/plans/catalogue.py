"""Registered queries of the similarity-search engine, each with the SQL that checks it.

The tables stand in for an engine's: embeddings are feature vectors (their signs bitmaps, their sizes histograms),
lineitem gives each supplier a set of parts and a picture of pixels (colour, x, y), documents are content, and events
are a changelog (signup inserts, error removes, event_id is the commit).
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import codec, ids
from ..functions import similarity as S
from ..operators import aggregate, inverted, measures, topk, training, validate
from ..operators.strip import strip
from ..session import importable, shared_dir
from ..sources import catalog, images, kvs, lists
from ..streaming.pull import LocalIndex

QUERIES: dict = {}
ORACLES: dict = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    importable(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("item_id"), F.col("embedding").cast("array<double>").alias("vector"), "label")


def one(items: DataFrame, key: int = 0, *cols: str) -> DataFrame:
    """The query item's columns under q_ names: one row, found by a pushed-down key."""
    return items.where(F.col("item_id") == key).select(*[F.col(c).alias(f"q_{c}") for c in cols or ("vector",)])


def best(df: DataFrame, score, k: int = 10) -> DataFrame:
    return topk.ranked(topk.topk(df, F.round(score, 6), k))


@query("SELECT doc_id, sha1(text) AS item_id FROM documents")
def q01_content_id(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", ids.content_id(F.col("text")).alias("item_id"))


@query("""
SELECT row_number() OVER (ORDER BY similarity DESC, item_id)::INT AS rank, item_id, similarity FROM (
  SELECT a.vec_id AS item_id, round(list_dot_product(a.embedding::DOUBLE[], q.embedding::DOUBLE[]), 6) AS similarity
  FROM embeddings a, embeddings q WHERE q.vec_id = 0 ORDER BY similarity DESC, item_id LIMIT 10)
""")
def q02_dense_topk(spark, sf_dir):
    x = vectors(spark, sf_dir)
    return best(x.crossJoin(F.broadcast(one(x))), S.dot(F.col("vector"), F.col("q_vector")))


_HEX = "array_to_string(list_transform(range(15, -1, -1), lambda j: substr('0123456789abcdef', 1 + (e[4*j+1] > 0)::INT + 2 * (e[4*j+2] > 0)::INT + 4 * (e[4*j+3] > 0)::INT + 8 * (e[4*j+4] > 0)::INT, 1)), '')"


@query(f"SELECT vec_id, {_HEX} AS bitmap, true AS same FROM (SELECT vec_id, embedding AS e FROM embeddings)")
def q03_hex_codec(spark, sf_dir):
    x = read(spark, sf_dir, "embeddings").select("vec_id", codec.sign_bits(F.col("embedding")).alias("b")).withColumn("bitmap", codec.blocks_to_hex(F.col("b")))
    return x.select("vec_id", "bitmap", (codec.hex_to_blocks(F.col("bitmap"), 1) == F.col("b")).alias("same"))


@query("SELECT vec_id, round(sqrt(list_dot_product(e, e)), 6) AS norm, round(list_sum(list_transform(e, lambda x: x / sqrt(list_dot_product(e, e)))), 6) AS total FROM (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings)")
def q04_normalize(spark, sf_dir):
    x = read(spark, sf_dir, "embeddings")
    return x.select("vec_id", F.round(S.norm(F.col("embedding")), 6).alias("norm"), F.round(S.total(S.normalized(F.col("embedding"))), 6).alias("total"))


@query("SELECT page_id AS label, url AS path FROM pages")
def q05_list_import(spark, sf_dir):
    return lists.parse_lines(read(spark, sf_dir, "pages").select(F.concat_ws(" ", F.col("page_id").cast("string"), "url").alias("value")))


@query("""
SELECT min(doc_id) AS seq, sha1(text) AS item_id FROM documents
WHERE sha1(text) NOT IN (SELECT sha1(text) FROM documents WHERE lang = 'en') GROUP BY sha1(text)
""")
def q06_insert_absent(spark, sf_dir):
    x = read(spark, sf_dir, "documents").select(F.col("doc_id").alias("seq"), ids.content_id(F.col("text")).alias("item_id"), "lang")
    return catalog.absent(x.select("seq", "item_id"), x.where("lang = 'en'").select("item_id")).select("seq", "item_id")


@query("""
SELECT doc_id, item_id FROM (SELECT doc_id, sha1(text) AS item_id FROM documents)
WHERE substr(item_id, 1, 2) BETWEEN '00' AND '3f' OR (substr(item_id, 1, 1) BETWEEN '8' AND 'b' AND substr(item_id, 1, 2) BETWEEN '90' AND 'cf')
""")
def q07_shard(spark, sf_dir):
    x = read(spark, sf_dir, "documents").select("doc_id", ids.content_id(F.col("text")).alias("item_id"))
    return x.where(ids.shard(F.col("item_id"), "00-3f") | ids.shard(F.col("item_id"), ["8-b", "90-cf"]))


def _changes(spark, sf_dir) -> DataFrame:
    x = read(spark, sf_dir, "events").where(F.col("event_type").isin("signup", "error"))
    return x.select(F.col("user_id").cast("string").alias("item_id"), F.when(F.col("event_type") == "error", 1).otherwise(0).alias("flag"), F.col("event_id").alias("commit_id"))


@query("""
SELECT event_id AS seq, user_id, event_type FROM events
WHERE event_id > -1 AND event_id <= (SELECT coalesce(max(event_id), -1) FROM events) ORDER BY event_id LIMIT 100000
""")
def q08_incremental_pull(spark, sf_dir):
    """All events up to the snapshot, in order. The LIMIT of the SQL is the reference's page, which it reads again while full."""
    x = read(spark, sf_dir, "events").select(F.col("event_id").alias("seq"), "user_id", "event_type")
    top = x.agg(F.coalesce(F.max("seq"), F.lit(-1)).alias("top"))
    return x.join(F.broadcast(top), (F.col("seq") > -1) & (F.col("seq") <= F.col("top"))).drop("top").orderBy("seq")


@query("SELECT coalesce(max(event_id), -1) AS last_seq, coalesce(max(event_id) FILTER (event_type IN ('signup', 'error')), -1) AS last_commit FROM events")
def q08b_max_ids(spark, sf_dir):
    commit = F.when(F.col("event_type").isin("signup", "error"), F.col("event_id"))
    return read(spark, sf_dir, "events").agg(F.coalesce(F.max("event_id"), F.lit(-1)).alias("last_seq"), F.coalesce(F.max(commit), F.lit(-1)).alias("last_commit"))


_FLAGS = "SELECT user_id, arg_max(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END, event_id) AS flag, max(event_id) AS commit_id FROM events WHERE event_type IN ('signup', 'error') GROUP BY user_id"


@query(f"SELECT user_id::VARCHAR AS item_id, commit_id FROM ({_FLAGS}) WHERE flag & 1 = 0")
def q09_tombstones(spark, sf_dir):
    changes = _changes(spark, sf_dir)
    items = changes.groupBy("item_id").agg(F.lit(0).alias("flag"), F.min("commit_id").alias("commit_id"))
    return topk.live(catalog.resolved(items, changes)).select("item_id", "commit_id")


@query(f"""
WITH f AS ({_FLAGS}), s AS (SELECT a.vec_id AS item_id, coalesce(f.flag, 0) AS flag, round(list_dot_product(a.embedding::DOUBLE[], q.embedding::DOUBLE[]), 6) AS similarity
  FROM embeddings a JOIN embeddings q ON q.vec_id = 0 LEFT JOIN f ON f.user_id = a.vec_id),
e AS (SELECT item_id, similarity FROM s WHERE flag = 0 ORDER BY similarity DESC, item_id LIMIT 10),
c AS (SELECT item_id, similarity FROM (SELECT * FROM s ORDER BY similarity DESC, item_id LIMIT 20) WHERE flag = 0 ORDER BY similarity DESC, item_id LIMIT 10)
SELECT 'exact' AS mode, row_number() OVER (ORDER BY similarity DESC, item_id)::INT AS rank, item_id, similarity FROM e
UNION ALL SELECT 'compat', row_number() OVER (ORDER BY similarity DESC, item_id)::INT, item_id, similarity FROM c
""")
def q09b_overfetch(spark, sf_dir):
    last = catalog.resolved(_changes(spark, sf_dir).groupBy("item_id").agg(F.lit(0).alias("flag"), F.min("commit_id").alias("commit_id")), _changes(spark, sf_dir))
    x = vectors(spark, sf_dir)
    x = x.crossJoin(F.broadcast(one(x))).join(last.select(F.col("item_id").cast("long").alias("item_id"), "flag"), "item_id", "left").withColumn("flag", F.coalesce("flag", F.lit(0)))
    score = F.round(S.dot(F.col("vector"), F.col("q_vector")), 6)
    exact, compat = topk.topk(topk.live(x), score, 10), topk.overfetched(x, score, 10, 2)
    return topk.ranked(exact).select(F.lit("exact").alias("mode"), "*").unionByName(topk.ranked(compat).select(F.lit("compat").alias("mode"), "*"))


_POSTS = """
p AS (SELECT DISTINCT l_suppkey AS item, l_partkey AS word FROM lineitem),
n AS (SELECT count(DISTINCT item)::DOUBLE AS n FROM p),
w AS (SELECT word, log2((n.n + 0.5e0) / (count(*) + 0.5e0)) + 1 AS weight FROM p, n GROUP BY word, n.n),
m AS (SELECT item, sqrt(sum(weight * weight)) AS norm FROM p JOIN w USING (word) GROUP BY item),
s AS (SELECT q.item AS query, p.item AS item, count(*) AS hits, sum(weight * weight) / (any_value(a.norm) * any_value(b.norm)) AS similarity
      FROM p q JOIN p USING (word) JOIN w USING (word) JOIN m a ON a.item = q.item JOIN m b ON b.item = p.item WHERE q.item % 50 = 0 GROUP BY q.item, p.item)
"""


def _posts(spark, sf_dir):
    posts = read(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("item"), F.col("l_partkey").alias("word")).distinct()
    n = posts.agg(F.countDistinct("item").cast("double").alias("n"))
    weights = inverted.doc_freq(posts).crossJoin(F.broadcast(n)).select("word", inverted.idf(F.col("df"), F.col("n")).alias("weight"))
    return posts, weights, posts.where(F.col("item") % 50 == 0).select(F.col("item").alias("query"), "word")


@query(f"WITH {_POSTS} SELECT query, item, hits, round(similarity, 6) AS similarity FROM s")
def q10_set_cosine(spark, sf_dir):
    return inverted.index_scores(*_posts(spark, sf_dir)).withColumn("similarity", F.round("similarity", 6))


@query(f"""
WITH {_POSTS} SELECT query, item, hits, round(similarity, 6) AS similarity, rank FROM (
  SELECT *, row_number() OVER (PARTITION BY query ORDER BY round(similarity, 9) DESC, item)::INT AS rank FROM s WHERE hits > 8) WHERE rank <= 10
""")
def q11_index_topk(spark, sf_dir):
    return inverted.index_topk(*_posts(spark, sf_dir), k=10).withColumn("similarity", F.round("similarity", 6))


def _doc_words(spark, sf_dir) -> DataFrame:
    """(item, word): distinct 19-bit hashes of a document's words."""
    w = F.explode(F.array_distinct(F.split(F.lower(F.col("text")), "[^\\p{L}]+"))).alias("w")
    x = read(spark, sf_dir, "documents").select(F.col("doc_id").alias("item"), w).where("w != ''")
    return x.select("item", F.conv(F.substring(F.md5("w"), 1, 5), 16, 10).cast("long").bitwiseAND(524287).alias("word")).distinct()


_WORDS = r"""
t AS (SELECT doc_id AS item, unnest(list_distinct(regexp_split_to_array(lower(text), '[^\p{L}]+'))) AS w FROM documents),
d AS (SELECT DISTINCT item, ('0x' || substr(md5(w), 1, 5))::BIGINT & 524287 AS word FROM t WHERE w != '')
"""


@query(f"WITH {_WORDS} SELECT word, count(*) AS df FROM d GROUP BY word")
def q12_doc_freq(spark, sf_dir):
    return inverted.doc_freq(_doc_words(spark, sf_dir))


@query(f"""
WITH {_WORDS}, n AS (SELECT count(*)::DOUBLE AS n FROM documents), f AS (SELECT word, count(*) AS df FROM d GROUP BY word),
i AS (SELECT word, df, log2((n + 0.5e0) / (df + 0.5e0)) + 1 AS idf FROM f, n)
SELECT word, round(idf, 6) AS idf, round(CASE WHEN df > 100 THEN 0.0e0 ELSE idf END, 6) AS idf_stop, round(CASE WHEN word % 7 = 0 THEN 0.0e0 ELSE idf END, 6) AS idf_kept FROM i
""")
def q13_idf(spark, sf_dir):
    n = read(spark, sf_dir, "documents").agg(F.count("*").cast("double").alias("n"))
    x = inverted.doc_freq(_doc_words(spark, sf_dir)).crossJoin(F.broadcast(n))
    was = F.when(F.col("word") % 7 == 0, F.lit(0.0)).otherwise(F.lit(1.0))
    weight = lambda stop: F.round(inverted.idf(F.col("df"), F.col("n"), stop, was), 6)
    return x.select("word", weight(0).alias("idf"), weight(100).alias("idf_stop"), weight(-1).alias("idf_kept"))


@query(f"WITH {_WORDS} SELECT item, string_agg(word::VARCHAR, ' ' ORDER BY word) AS words FROM d GROUP BY item")
def q14_word_sets(spark, sf_dir):
    return inverted.word_sets(_doc_words(spark, sf_dir)).select("item", F.array_join("words", " ").alias("words"))


@query(r"""
WITH t AS (SELECT doc_id AS item, list_filter(regexp_split_to_array(lower(text), '[^\p{L}]+'), lambda w: w != '') AS ws FROM documents),
p AS (SELECT item, len(ws)::DOUBLE AS h, unnest(ws) AS w, unnest(range(len(ws)))::DOUBLE AS y FROM t),
r AS (SELECT item, w, unnest([CASE WHEN y < h / 3 + h / 3 * 0.05e0 THEN 0 END, CASE WHEN y >= h / 3 - h / 3 * 0.05e0 AND y < 2 * (h / 3) + h / 3 * 0.05e0 THEN 1 END,
      CASE WHEN y >= 2 * (h / 3) - h / 3 * 0.05e0 THEN 2 END]) AS region FROM p)
SELECT item, region, count(DISTINCT w) AS words FROM r WHERE region IS NOT NULL GROUP BY item, region
""")
def q15_region_words(spark, sf_dir):
    ws = F.filter(F.split(F.lower(F.col("text")), "[^\\p{L}]+"), lambda w: w != "")
    x = read(spark, sf_dir, "documents").select(F.col("doc_id").alias("item"), ws.alias("ws"))
    # a document is one row and its thirds are ranges of its words, so nothing is exploded or shuffled
    part = lambda lo, hi: F.slice("ws", F.ceil(lo).cast("int") + 1, (F.ceil(hi) - F.ceil(lo)).cast("int"))
    found = [F.struct(F.lit(i).alias("region"), F.size(F.array_distinct(part(lo, hi))).cast("long").alias("words")) for i, (lo, hi) in enumerate(inverted.region_bounds(F.size("ws").cast("double")))]
    return x.where(F.size("ws") > 0).select("item", F.inline(F.array(*found))).where("words > 0")


def _codebook(x: DataFrame, n: int) -> DataFrame:
    return x.where(F.col("item_id") < n).select(F.col("item_id").cast("int").alias("label"), F.col("vector").alias("vec"))


_NEAR = """
c AS (SELECT vec_id::INT AS label, embedding::DOUBLE[] AS c FROM embeddings WHERE vec_id < {n}),
a AS (SELECT e.vec_id, e.label AS item, e.embedding::DOUBLE[] AS v, c.label, list_sum(list_transform(range(1, 65), lambda i: (e.embedding[i]::DOUBLE - c[i]) * (e.embedding[i]::DOUBLE - c[i]))) AS d FROM embeddings e, c),
k AS (SELECT vec_id, any_value(item) AS item, any_value(v) AS v, arg_min(label, d * 1e6 + label * 1e-9) AS label, min(d) AS d FROM a GROUP BY vec_id)
"""


@query(f"WITH {_NEAR.format(n=8)} SELECT vec_id AS item_id, label, round(d, 6) AS distance FROM k")
def q16_nearest_centroid(spark, sf_dir):
    x = vectors(spark, sf_dir)
    near = aggregate.nearest(x.select("item_id", F.col("vector").alias("vec")), _codebook(x, 8), ["item_id"])
    return near.select("item_id", "label", F.round("distance", 6).alias("distance"))


def _many(spark, items: DataFrame, cols: list[str], score, k: int = 10, measure: measures.Dot | None = None) -> DataFrame:
    """The stated query set: every item whose id divides by 50, against all items. With a measure, which says what the
    score does of the one column, by blocks."""
    if measure is not None:  # counted, dealt and compared: features are made once
        path = f"{shared_dir(spark)}/features-{uuid.uuid4().hex}"
        items.write.parquet(path)
        items = spark.read.parquet(path)
    q = items.where(F.col("item_id") % 50 == 0).select(F.col("item_id").alias("query_id"), *[F.col(c).alias(f"q_{c}") for c in cols])
    if measure is not None:
        return topk.measured_topk_many(items, q, F.round(score, 6), measure, k, *cols).select("query_id", "rank", "item_id", "similarity")
    return topk.topk_many(items, q, F.round(score, 6), k).select("query_id", "rank", "item_id", "similarity")


def _many_sql(with_: str, score: str) -> str:
    """x(item_id, ...) in ``with_``; score over a and q."""
    return f"""
WITH {with_}, s AS (SELECT q.item_id AS query_id, a.item_id, round({score}, 6) AS similarity FROM x a, x q WHERE q.item_id % 50 = 0)
SELECT query_id, rank, item_id, similarity FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, item_id)::INT AS rank FROM s) WHERE rank <= 10"""


@query(
    _many_sql(
        "x AS (SELECT vec_id AS item_id, list_transform(embedding, lambda v: (v > 0)::INT::DOUBLE) AS b FROM embeddings)",
        "CASE WHEN list_sum(a.b) * list_sum(q.b) = 0 THEN 0.0e0 ELSE list_dot_product(a.b, q.b) / (sqrt(list_sum(a.b)) * sqrt(list_sum(q.b))) END",
    )
)
def q17_bit_cosine(spark, sf_dir):
    x = vectors(spark, sf_dir).select("item_id", codec.sign_bits(F.col("vector")).alias("b"))
    return _many(spark, x, ["b"], S.bit_cosine(F.col("b"), F.col("q_b")), measure=measures.Bits(6))


def _levels(x: DataFrame, scale: float = 3.9) -> DataFrame:
    """A vector's absolute values as a histogram of colours, in levels."""
    level = lambda v, top: F.when(F.abs(v) / top * scale > 0.01, F.floor(F.abs(v) / top * scale) + 1).otherwise(F.lit(0)).cast("int")
    of = lambda top: F.transform("vector", lambda v: level(v, top))
    return x.withColumn("levels", S.bound(F.array_max(F.transform("vector", lambda v: F.abs(v))), of))


_LEVELS = """h AS (SELECT vec_id AS item_id, list_transform(embedding::DOUBLE[], lambda v: abs(v)) AS h, embedding::DOUBLE[] AS v FROM embeddings),
x AS (SELECT item_id, v, list_transform(h, lambda c: CASE WHEN c / list_max(h) * 3.9e0 > 0.01e0 THEN (floor(c / list_max(h) * 3.9e0) + 1)::DOUBLE ELSE 0.0e0 END) AS l,
      list_transform(v, lambda c: (c > 0)::INT::DOUBLE) AS b FROM h)"""
_LEVEL_COS = "CASE WHEN list_sum(a.l) * list_sum(q.l) = 0 THEN 0.0e0 ELSE list_sum(list_transform(range(1, 65), lambda i: least(a.l[i], q.l[i]))) / (sqrt(list_sum(a.l)) * sqrt(list_sum(q.l))) END"


@query(_many_sql(_LEVELS, _LEVEL_COS))
def q18_colour_levels(spark, sf_dir):
    x = _levels(vectors(spark, sf_dir)).select("item_id", "levels")
    return _many(spark, x, ["levels"], S.level_cosine(F.col("levels"), F.col("q_levels")), measure=measures.Levels(6))


def _pixels(spark, sf_dir) -> DataFrame:
    """(item, cell, colour, n): lineitem as pictures of 7 x 50 pixels, one a supplier."""
    x = read(spark, sf_dir, "lineitem")
    at = aggregate.cells(F.col("l_linenumber") - 1, F.col("l_quantity") - 1, F.lit(7), F.lit(50))
    x = x.select(F.col("l_suppkey").alias("item"), (F.col("l_partkey") % 64).cast("int").alias("colour"), F.explode(at).alias("cell"))
    return x.groupBy("item", "cell", "colour").agg(F.count("*").alias("n"))


_PIXELS = """
p AS (SELECT l_suppkey AS item, (l_partkey % 64)::INT AS colour, unnest([
        least(floor((l_quantity - 1) * 3 / 50), 2)::INT * 3 + least(floor((l_linenumber - 1)::DOUBLE * 3 / 7), 2)::INT, 9 + least(floor((l_quantity - 1) * 4 / 50), 3)::INT,
        13 + least(floor((l_quantity - 1) * 2 / 50), 1)::INT, 15]) AS cell FROM lineitem),
c AS (SELECT item, cell, colour, count(*) AS n FROM p GROUP BY item, cell, colour)
"""


@query(f"""
WITH {_PIXELS},
v AS (SELECT *, n::DOUBLE / max(n) OVER (PARTITION BY item, cell) * 3.99e0 AS v FROM c), x AS (SELECT item, cell, colour, CASE WHEN v > 0.01e0 THEN floor(v) + 1 ELSE 0 END AS l FROM v),
e AS (SELECT unnest([9, 13, 15, 16]) AS upto, unnest([0.4e0, 0.25e0, 0.15e0, 0.2e0]) AS w), z AS (SELECT item, upto, w, sqrt(sum(l)) AS norm FROM x JOIN e ON cell < upto GROUP BY item, upto, w),
t AS (SELECT q.item AS query_id, a.item AS item_id, upto, sum(least(a.l, q.l)) AS both_ FROM x a JOIN x q ON a.cell = q.cell AND a.colour = q.colour JOIN e ON a.cell < upto WHERE q.item % 50 = 0 GROUP BY q.item, a.item, upto),
s AS (SELECT query_id, item_id, round(sum(a.w * both_ / (a.norm * b.norm)), 6) AS similarity FROM t JOIN z a ON a.item = item_id AND a.upto = t.upto JOIN z b ON b.item = query_id AND b.upto = t.upto GROUP BY query_id, item_id)
SELECT query_id, rank, item_id, similarity FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, item_id)::INT AS rank FROM s) WHERE rank <= 10
""")
def q19_colour_pyramid(spark, sf_dir):
    x = aggregate.unary_levels(_pixels(spark, sf_dir), ["item", "cell"], 3.99)
    x = x.select(F.col("item").alias("item_id"), (F.col("cell") * 64 + F.col("colour")).alias("index"), F.col("level").alias("value"))
    x = aggregate.dense(x, "item_id", 1024, F.lit(0), "levels")
    return _many(spark, x, ["levels"], S.pyramid_cosine(F.col("levels"), F.col("q_levels"), 64), measure=measures.Pyramid(6))


@query(f"""
WITH {_LEVELS}, s AS (SELECT a.item_id, 0.68e0 * CASE WHEN list_sum(a.b) * list_sum(q.b) = 0 THEN 0.0e0 ELSE list_dot_product(a.b, q.b) / (sqrt(list_sum(a.b)) * sqrt(list_sum(q.b))) END
    + 0.32e0 * {_LEVEL_COS} AS first, round(list_dot_product(a.v, q.v), 6) AS similarity FROM x a, x q WHERE q.item_id = 0),
k AS (SELECT item_id, similarity FROM s ORDER BY round(first, 9) DESC, item_id LIMIT 100)
SELECT row_number() OVER (ORDER BY similarity DESC, item_id)::INT AS rank, item_id, similarity FROM (SELECT * FROM k ORDER BY similarity DESC, item_id LIMIT 10)
""")
def q20_two_stage(spark, sf_dir):
    x = _levels(vectors(spark, sf_dir)).withColumn("b", codec.sign_bits(F.col("vector")))
    x = x.crossJoin(F.broadcast(one(x, 0, "vector", "levels", "b")))
    first = S.blend(S.bit_cosine(F.col("b"), F.col("q_b")), S.level_cosine(F.col("levels"), F.col("q_levels")), 0.32)
    return topk.ranked(topk.topk(x, F.round(S.dot(F.col("vector"), F.col("q_vector")), 6), 10, first=F.round(first, 9)))


@query(
    _many_sql(
        """m AS (SELECT vec_id, embedding::DOUBLE[] AS r FROM embeddings WHERE vec_id < 16),
p AS (SELECT e.vec_id, list(list_dot_product(r, e.embedding::DOUBLE[]) ORDER BY m.vec_id) AS z FROM embeddings e, m GROUP BY e.vec_id),
x AS (SELECT vec_id AS item_id, list_transform(z, lambda v: v / sqrt(list_dot_product(z, z))) AS u FROM p)""",
        "1 - sqrt(list_sum(list_transform(range(1, 17), lambda i: (a.u[i] - q.u[i]) * (a.u[i] - q.u[i])))) / 2",
    )
)
def q21_projection(spark, sf_dir):
    x = vectors(spark, sf_dir)
    matrix = x.where("item_id < 16").agg(F.transform(F.array_sort(F.collect_list(F.struct("item_id", "vector"))), lambda r: r["vector"]).alias("m"))
    x = x.crossJoin(F.broadcast(matrix)).select("item_id", S.project(F.col("vector"), F.col("m")).alias("vector"))
    return _many(spark, x, ["vector"], S.metric_similarity(F.col("vector"), F.col("q_vector")), measure=measures.Metric(6))


_PART = "1 - sqrt(list_sum(list_transform(range({lo}, {hi}), lambda i: (a.v[i] - q.v[i]) * (a.v[i] - q.v[i])))) / 2"


@query(
    _many_sql(
        "x AS (SELECT vec_id AS item_id, embedding::DOUBLE[] AS v FROM embeddings)",
        f"0.5e0 * ({_PART.format(lo=1, hi=49)}) + 0.5e0 * CASE WHEN {_PART.format(lo=49, hi=65)} > 0.7e0 THEN 1.0e0 ELSE 0.0e0 END",
    )
)
def q22_colour_gate(spark, sf_dir):
    part = lambda lo, n: S.metric_similarity(F.slice("vector", lo, n), F.slice("q_vector", lo, n))
    return _many(spark, vectors(spark, sf_dir), ["vector"], S.blend(part(1, 48), S.step_gate(part(49, 16), 0.7), 0.5), measure=measures.Gated(6))


_RESIDUAL = "r AS (SELECT item, k.label, unnest(range(64)) AS dim, unnest(list_transform(range(1, 65), lambda i: v[i] - c[i])) AS d FROM k JOIN c ON c.label = k.label), g AS (SELECT item, label, dim, sum(d) AS d FROM r GROUP BY item, label, dim)"


def _residuals(spark, sf_dir, n: int) -> DataFrame:
    x = vectors(spark, sf_dir)
    near = aggregate.nearest(x.select(F.col("label").alias("item"), F.col("vector").alias("vec")), _codebook(x, n), ["item"])
    return aggregate.residuals(near, _codebook(x, n))


@query(f"WITH {_NEAR.format(n=8)}, {_RESIDUAL} SELECT item, label, dim, round(d / sqrt(sum(d * d) OVER (PARTITION BY item)), 6) AS value FROM g")
def q23_residuals(spark, sf_dir):
    return _residuals(spark, sf_dir, 8).withColumn("value", F.round("value", 6))


@query(f"""
WITH {_NEAR.format(n=16)}, {_RESIDUAL}, o AS (SELECT item, label AS cell, dim AS colour, CASE WHEN label < 9 THEN 0 WHEN label < 13 THEN 1 WHEN label < 15 THEN 2 ELSE 3 END AS level, sign(d) * sqrt(abs(d / sqrt(sum(d * d) OVER (PARTITION BY item)))) AS v FROM g)
SELECT item, cell, colour, round(v / sqrt(sum(v * v) OVER (PARTITION BY item, level)) * sqrt([0.4e0, 0.25e0, 0.15e0, 0.2e0][level + 1]), 6) AS value FROM o
""")
def q23b_power_level(spark, sf_dir):
    r = _residuals(spark, sf_dir, 16).select("item", F.col("label").alias("cell"), F.col("dim").alias("colour"), "value")
    return aggregate.level_normalized(r).withColumn("value", F.round("value", 6))


_PAIR = "list_sum(list_transform([1, 2, 3], lambda i: (a.{x}[i] - q.{y}[i]) * (a.{x}[i] - q.{y}[i])))"


@query(
    _many_sql(
        "x AS (SELECT p_partkey AS item_id, [(p_partkey % 256)::DOUBLE, p_size * 5.0e0, floor(p_retailprice) % 256] AS a, [(p_partkey * 7 % 256)::DOUBLE, (p_size * 3)::DOUBLE, (p_partkey % 97)::DOUBLE] AS b FROM part)",
        f"exp(-least({', '.join(_PAIR.format(x=x, y=y) for x in 'ab' for y in 'ab')}) / 5000.0e0)",
    )
)
def q24_major_colours(spark, sf_dir):
    k, d = F.col("p_partkey"), lambda c: c.cast("double")
    a = F.array(d(k % 256), d(F.col("p_size") * 5), d(F.floor("p_retailprice") % 256))
    b = F.array(d(k * 7 % 256), d(F.col("p_size") * 3), d(k % 97))
    x = read(spark, sf_dir, "part").select(k.alias("item_id"), F.concat(a, b).alias("c"))
    pair = lambda c: (F.slice(c, 1, 3), F.slice(c, 4, 3))
    return _many(spark, x, ["c"], S.major_similarity(*pair("c"), *pair("q_c")), measure=measures.Nearest(6))


@query(f"""
WITH {_PIXELS}, v AS (SELECT *, 2.0e0 * n / max(n) OVER (PARTITION BY item, cell) AS v FROM c),
l AS (SELECT *, CASE WHEN cell < 9 THEN 0 WHEN cell < 13 THEN 1 WHEN cell < 15 THEN 2 ELSE 3 END AS level, CASE WHEN v > 0.02e0 THEN sqrt(floor(v) + 1) ELSE 0.0e0 END AS h FROM v)
SELECT item, cell, colour, round(h / sqrt(sum(h * h) OVER (PARTITION BY item, level)) * sqrt([0.4e0, 0.25e0, 0.15e0, 0.2e0][level + 1]), 6) AS value FROM l
""")
def q25_spatial_histogram(spark, sf_dir):
    return aggregate.spatial_histogram(_pixels(spark, sf_dir)).withColumn("value", F.round("value", 6))


@query(f"WITH {_NEAR.format(n=8)} SELECT label, count(*) AS points, round(min(sqrt(d)), 6) AS least, round(max(sqrt(d)), 6) AS most FROM k GROUP BY label")
def q26_quantisation_error(spark, sf_dir):
    x = vectors(spark, sf_dir)
    e = aggregate.quantisation_error(aggregate.nearest(x.select("item_id", F.col("vector").alias("vec")), _codebook(x, 8), ["item_id"]))
    return e.select("label", "points", F.round("least", 6).alias("least"), F.round("most", 6).alias("most"))


@query()
def q27_kmeans(spark, sf_dir):
    x = vectors(spark, sf_dir).select("item_id", F.col("vector").alias("vec"))
    return aggregate.quantisation_error(aggregate.nearest(x, training.centroids(x, 10), ["item_id"]))


@query()
def q27b_kmeans_tree(spark, sf_dir):
    x = vectors(spark, sf_dir).select("item_id", F.col("vector").alias("vec"))
    return training.centroid_tree(x, [4, 4]).predict(x).select("item_id", "label", "distance")


@query()
def q27c_metric(spark, sf_dir):
    x = vectors(spark, sf_dir)
    y = training.projected(x, training.fit_metric(x, 16))
    return best(y.crossJoin(F.broadcast(one(y))), S.metric_similarity(F.col("vector"), F.col("q_vector")))


_KNN = """
s AS (SELECT q.vec_id AS query_id, a.vec_id AS item_id, q.label, a.label AS near, round(list_dot_product(q.embedding::DOUBLE[], a.embedding::DOUBLE[]), 9) AS s FROM embeddings q, embeddings a),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, item_id) AS rank FROM s)
"""


@query(f"""
WITH {_KNN}, k AS (SELECT * FROM r WHERE rank <= 21), h AS (SELECT query_id, label, sum((near = label)::INT) AS hits, count(*) AS n FROM k GROUP BY query_id, label),
o AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, item_id) AS o FROM k WHERE item_id != query_id),
v AS (SELECT query_id, near, count(*) AS n FROM o WHERE o <= 20 GROUP BY query_id, near), w AS (SELECT query_id, near, row_number() OVER (PARTITION BY query_id ORDER BY n DESC, near) AS o FROM v),
z AS (SELECT label, count(*) AS size FROM embeddings GROUP BY label)
SELECT h.label, round(avg((w.near = h.label)::INT), 6) AS accuracy, round(avg(hits / n), 6) AS precision, round(avg(hits / size), 6) AS recall
FROM h JOIN w ON w.query_id = h.query_id AND o = 1 JOIN z ON z.label = h.label GROUP BY h.label
""")
def q28_knn_scores(spark, sf_dir):
    x = validate.knn_scores(vectors(spark, sf_dir), 20)
    return x.select("label", *[F.round(c, 6).alias(c) for c in ("accuracy", "precision", "recall")])


@query(f"WITH {_KNN}, k AS (SELECT query_id, sum((near = label)::INT) AS n FROM r WHERE rank <= 4 GROUP BY query_id) SELECT round(avg(n), 6) AS score, count(*) AS queries FROM k")
def q29_group_score(spark, sf_dir):
    return validate.group_score(vectors(spark, sf_dir)).select(F.round("score", 6).alias("score"), "queries")


@query("""
SELECT user_id, round(arg_max(value, event_id), 6) AS value FROM events GROUP BY user_id HAVING arg_max(event_type, event_id) != 'error'
""")
def q30_kvs(spark, sf_dir):
    x = read(spark, sf_dir, "events")
    value = F.when(F.col("event_type") != "error", F.col("value").cast("string").cast("binary"))
    x = kvs.latest(x.select(F.col("user_id").cast("string").cast("binary").alias("key"), value.alias("value"), F.col("event_id").alias("ver")))
    return x.select(F.col("key").cast("string").cast("long").alias("user_id"), F.round(F.col("value").cast("string").cast("double"), 6).alias("value"))


@query()
def q31_strip(spark, sf_dir):
    x = vectors(spark, sf_dir)
    return strip(best(x.crossJoin(F.broadcast(one(x))), S.dot(F.col("vector"), F.col("q_vector")), 80))


@query("""
SELECT row_number() OVER (ORDER BY similarity DESC, item_id)::INT AS rank, '{"id":"' || item_id || '","value":{"similarity":' || similarity::VARCHAR || '}}' AS json FROM (
  SELECT a.vec_id AS item_id, round(list_dot_product(a.embedding::DOUBLE[], q.embedding::DOUBLE[]), 6) AS similarity
  FROM embeddings a, embeddings q WHERE q.vec_id = 0 ORDER BY similarity DESC, item_id LIMIT 10)
""")
def q32_json(spark, sf_dir):
    found = q02_dense_topk(spark, sf_dir)
    return found.select("rank", lists.result_json(F.col("item_id").cast("string"), F.col("similarity")).alias("json"))


@query(f"SELECT user_id::VARCHAR AS item_id, flag::INT AS flag, commit_id FROM ({_FLAGS})")
def q33_stream_pull(spark, sf_dir):
    root = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    changes = _changes(spark, sf_dir)
    master = catalog.Master(spark, f"{root}/master")
    items = changes.groupBy("item_id").agg(F.min("commit_id").alias("seq")).select("seq", "item_id", F.lit("").alias("vector"), F.lit(0).alias("flag"), F.lit(None).cast("long").alias("commit_id"), F.substring("item_id", 1, 1).alias("bucket"))
    items.write.parquet(master.items_path)
    changes.write.parquet(master.changes_path)
    index = LocalIndex(spark, f"{root}/index")
    index.pull_stream(master, f"{root}/offsets")
    return index.items().select("item_id", "flag", "commit_id")


@query("""
WITH v AS (SELECT vec_id AS id, unnest(range(64)) AS i, unnest(embedding)::DOUBLE AS v FROM embeddings),
px AS (SELECT id, i % 8 AS x, i // 8 AS y, trunc(greatest(0.0e0, least(255.0e0, v * 400 + 128)))::INT AS r, trunc(greatest(0.0e0, least(255.0e0, v * 300 + 128)))::INT AS g, trunc(greatest(0.0e0, least(255.0e0, v * 200 + 128)))::INT AS b FROM v),
m AS (SELECT *, greatest(r, g, b)::DOUBLE AS most, least(r, g, b)::DOUBLE AS least, (greatest(r, g, b) - least(r, g, b))::DOUBLE AS d FROM px),
h AS (SELECT id, x, y, floor(CASE WHEN most = least THEN 0.0e0 WHEN most = r THEN ((g - b) / d) - 6 * floor(((g - b) / d) / 6) WHEN most = g THEN (b - r) / d + 2 ELSE (r - g) / d + 4 END * 60 / 60)::INT AS colour FROM m),
c AS (SELECT id, unnest([least(y * 3 // 8, 2) * 3 + least(x * 3 // 8, 2), 9 + least(y * 4 // 8, 3), 13 + least(y * 2 // 8, 1), 15])::INT AS cell, colour FROM h),
n AS (SELECT id, cell, colour, count(*) AS n FROM c GROUP BY ALL), l AS (SELECT *, n / max(n) OVER (PARTITION BY id, cell) * 3.99e0 AS v FROM n)
SELECT id AS item, cell, colour, n, CASE WHEN v > 0.01e0 THEN floor(v) + 1 ELSE 0 END::INT AS level FROM l
""")
def q34_image_colours(spark, sf_dir):
    """Every vector as an 8 x 8 picture, as PNG bytes through decoding and pixels to the counts of its cells."""
    import numpy as np
    import pandas as pd

    def png(batches):
        for b in batches:
            rows = [(int(i), images.encode_png(np.clip((np.array(v).reshape(8, 8, 1) * np.array([400, 300, 200]) + 128), 0, 255).astype(np.uint8))) for i, v in zip(b["item_id"], b["vector"])]
            yield pd.DataFrame(rows, columns=["item_id", "content"])

    files = vectors(spark, sf_dir).select("item_id", "vector").mapInPandas(png, "item_id long, content binary")
    px = images.pixels(images.read_bytes(files, id_col="item_id"))
    hue = F.floor(images.hsv(F.col("r"), F.col("g"), F.col("b"))[0] / 60).cast("int")
    x = px.select(F.col("item_id").alias("item"), hue.alias("colour"), F.explode(aggregate.cells(F.col("x"), F.col("y"), F.col("width"), F.col("height"))).alias("cell"))
    return aggregate.unary_levels(x.groupBy("item", "cell", "colour").agg(F.count("*").alias("n")), ["item", "cell"], 3.99)


from . import extra, models  # noqa: E402, F401  register their queries with those above
