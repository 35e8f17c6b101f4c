"""Line de-duplication on documents of very many lines and on rows without an id."""

import time

from pyspark.sql import functions as F

from lodestone.llm import lines


def long_docs(spark, n):
    text = F.array_join(F.transform(F.sequence(F.lit(1), F.lit(n)), lambda i: F.concat(F.lit("a line of some length "), i.cast("string"))), "\n")
    return spark.range(4).select(F.col("id").alias("doc_id"), text.alias("text"))


def test_lines_take_linear_time(spark):
    took = {}
    lines.dedup_lines(long_docs(spark, 100)).collect()
    for n in (20_000, 100_000):
        x = long_docs(spark, n).cache()
        x.count()
        began = time.perf_counter()
        got = sorted((r.doc_id, r.n_lines, r.n_dropped, len(r.text)) for r in lines.dedup_lines(x).collect())
        took[n] = time.perf_counter() - began
        assert [g[:3] for g in got] == [(i, n, n if i < 3 else 0) for i in range(4)] and got[-1][3] > 20 * n and got[0][3] == 0
    assert took[100_000] < 60 and took[100_000] < 10 * took[20_000] + 10


def test_rows_without_an_id_lose_nothing(spark):
    line = "this line is in all of the documents"
    docs = spark.range(300).select(F.when(F.col("id") >= 200, F.col("id")).alias("doc_id"), F.lit(f"{line}\nx").alias("text"))
    got = {(r.doc_id, r.n_lines, r.n_dropped, r.text): r["count"] for r in lines.dedup_lines(docs).groupBy("doc_id", "n_lines", "n_dropped", "text").count().collect()}
    assert got == {(None, 2, 0, f"{line}\nx"): 200, (299, 2, 0, f"{line}\nx"): 1} | {(i, 2, 1, "x"): 1 for i in range(200, 299)}


def test_search_in_sorted_arrays(spark):
    rows = [(sorted({(i * 7919) % 101 for i in range(n)}), v) for n in (0, 1, 2, 3, 4, 7, 8, 9, 40) for v in (None, *range(-1, 102, 3))]
    x = spark.createDataFrame(rows, "a array<int>, v int")
    got = x.select("a", "v", lines.is_in(F.col("v"), F.col("a"), lines.halves(F.size("a"))).alias("found")).collect()
    assert all(r.found == (r.v in r.a) for r in got)
