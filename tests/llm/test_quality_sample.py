"""What the quality classifier learns from is bounded by rows alone: whole texts, however long."""

from pyspark.sql import functions as F

from lodestone.llm import quality


def test_all_words_of_a_long_row_are_learned_from(spark):
    """Two rows that differ in one of 5,000 words: the weight of that word's slot moves."""
    long_text = " ".join(f"w{i}" for i in range(5_000))
    rows = [(i, f"{long_text} {'bad' if i % 2 else 'good'}x{i % 2}", i % 2) for i in range(60)]
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, quality int")
    m = quality.train(docs, labels)
    (row, slot, weight, x), = quality.features([long_text.encode()], [None])
    assert len(slot) == 5_000
    got = quality.score(docs, m).join(labels, "doc_id").collect()
    assert all(r.predicted == r.quality for r in got)


def test_texts_of_the_sample_are_bounded_in_whole_rows(spark):
    docs = spark.range(100).select(F.col("id").alias("doc_id"), F.repeat(F.lit("x"), 100).alias("text_"))
    rows = spark.range(100).select(F.col("id").alias("doc_id"), F.lit(1).alias("y_"))
    take = lambda most: {r.doc_id for r in quality._first_bytes(docs, rows, most).collect()}
    assert len(take(10_000)) == 100 and len(take(2_550)) == 25 and len(take(10)) == 1
    assert take(10) < take(2_550) < take(9_000) and take(2_550) == take(2_550)
