"""The filter audit against a plain replay, and on nulls, repeats, empty tables and clashing columns."""

import re
from collections import Counter
from itertools import permutations

from pyspark.sql import functions as F

from lodestone.llm import audit

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def plain_audit(docs, labels):
    """docs: (doc_id, text, source); labels: (doc_id, quality, toxic). Filter by filter, document by document."""
    good, toxic = {i for i, q, _ in labels if q == 1 and i is not None}, {i for i, _, t in labels if t == 1 and i is not None}
    first = {}
    for i, text, _ in docs:
        if i is not None:
            first[text or ""] = min(i, first.get(text or "", i))
    out = Counter()
    for i, text, source in docs:
        t = text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", t)
        fails = {
            "A": len(words) < 50, "B": 100 * len(set(words)) < 65 * len(words), "C": 100 * len(re.findall("[A-Z]", t)) > 5 * len(t),
            "D": re.search(r"[#$%&*|]", t) is not None, "E": i is not None and i > first[t],
        }
        part = source or ""
        for order in map("".join, permutations("ABCDE")):
            there = True
            for step, f in enumerate(order, 1):
                at = (part, order, step)
                out[(*at, "removed")] += there and fails[f]
                out[(*at, "redundant")] += not there and fails[f]
                out[(*at, "good_lost")] += there and fails[f] and i in good
                out[(*at, "toxic_lost")] += there and fails[f] and i in toxic
                out[(*at, "unique_fails")] += fails[f] and sum(fails.values()) == 1
                out[(part, f, "shapley")] += there and fails[f]
                there = there and not fails[f]
                out[(*at, "kept")] += there
    return {(p, o, s): tuple(out[(p, o, s, c)] for c in COUNTS[:-1]) + (out[(p, o[s - 1], "shapley")],) for p, o, s in {k[:3] for k in out if len(k) == 4}}


COUNTS = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


def rows(df):
    return {(r.part, r.filter_order, r.step): tuple(r[c] for c in COUNTS) for r in df.collect()}


def test_audit_equals_a_plain_replay(spark):
    words = " ".join(f"word{i}" for i in range(60))
    docs = [
        (1, words, "a"), (2, words, "a"), (2, words, "b"), (3, words, None), (None, words, "a"), (None, None, "c"), (5, None, ""), (6, "", "a"), (7, "Up " * 60, "a"),
        (8, "same # " * 60, "b"), (8, "same # " * 60, "b"), (9, "é " * 100_000, "a"), (10, words + " $", "b"), (11, "UPPER CASE", "d"), (-4, words.upper(), "a"), (12, words.upper(), "a"),
    ]
    labels = [(1, 1, 0), (1, None, 1), (2, 0, 1), (3, None, None), (None, 1, 1), (8, 1, 1), (12, 1, 0), (99, 1, 1)]
    df = spark.createDataFrame([(i, t, "en", s, 0) for i, t, s in docs], DOCS).withColumn("mask_", F.lit(7)).withColumn("part", F.lit("x")).withColumn("step", F.lit(9))
    got = rows(audit.interactions(df, spark.createDataFrame(labels, "doc_id long, quality int, toxic int").withColumn("part_", F.lit(0))))
    assert got == plain_audit(docs, labels)
    assert len(got) == 5 * 600


def test_audit_of_an_empty_table(spark):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert audit.interactions(spark.createDataFrame([], DOCS), none).count() == 0
    assert rows(audit.interactions(spark.createDataFrame([(1, "a", "en", "s", 1)], DOCS), none))[("s", "ABCDE", 1)] == (0, 1, 0, 1, 0, 0, 120)


def test_audit_sends_counts_not_documents(spark, tmp_path):
    """What the replay exchanges follows the number of tasks and parts, not that of the documents."""
    flags = spark.range(0, 20_000, 1, 4).select(F.when(F.col("id") % 3 == 0, "hot").otherwise("cold").alias("part_"), (F.col("id") % 32).cast("int").alias("mask_"), F.lit(True).alias("good_"), F.lit(False).alias("toxic_"))
    from lodestone.llm.common import Scratch

    got = audit.replay(flags, Scratch(spark))
    assert got.count() == 2 * 600
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in plan
    assert got.where("step = 1").groupBy("filter_order").agg(F.sum(F.col("kept") + F.col("removed")).alias("n")).where("n != 20000").count() == 0
