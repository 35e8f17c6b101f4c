"""Quality rules: counts against plain Python, lists against planted rules, verdicts on held-out labels."""

import random
import re
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from lodestone.llm import queries, rules
from lodestone.llm.common import table
from lodestone.llm.quality import held_out

SF = "/root/testdata/sf0.01"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def plain_counts(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = Counter(zip(words, words[1:], words[2:]))
    repeated = set()
    for i in range(len(words) - 2):
        if windows[words[i], words[i + 1], words[i + 2]] > 1:
            repeated |= {i, i + 1, i + 2}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    failed = len(words) < 50 or 100 * len(repeated) > 50 * len(words)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(repeated), failed


def plain_shares(text):
    n, chars, symbols, dup, repeated, _ = plain_counts(text)
    text = text or ""
    words, lines = re.findall(r"[^\x20\x09-\x0D]+", text), [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    count = lambda marks, t=text: sum(c in marks for c in t)
    again = sum(a == b for a, b in zip(words, words[1:]))
    some, letters, full = max(n, 1), max(chars, 1), max(len(lines), 1)
    return [
        chars / some, symbols / some, dup / full, repeated / some, len(set(words)) / some, max(Counter(words).values(), default=0) / some, again / some,
        count("ABCDEFGHIJKLMNOPQRSTUVWXYZ") / letters, count("0123456789") / letters, count(".,;:!?'\"()-") / some, count(".!?") / some, n / full,
    ]


def test_counts_of_all_documents_equal_plain_ones(spark):
    text = {r.doc_id: r.text for r in table(spark, SF, "documents").select("doc_id", "text").collect()}
    got = queries.QUERIES["op11_rules"](spark, SF).collect()
    assert len(got) == len(text)
    for r in got:
        assert (*(r[c] for c in rules.COUNTS), r.base_failed) == plain_counts(text[r.doc_id]), r.doc_id
        assert not (r.kept and r.base_failed) and (r.rule is None) == r.kept


def test_counts_of_odd_texts(spark):
    rng = random.Random(5)
    texts = [None, "", " \n\t", "a", "a a a", "a b c a b c", "a b\x0bc\na b c\n\na b c", "é 😀 é 😀 é 😀", "x" * 300_000, "w " * 60_000, "    b", "# * $ % & | < >\n# * $ % & | < >", "\n" * 5_000]
    texts += [" ".join(rng.choice("abcd") + rng.choice(["", "\n", "#"]) for _ in range(rng.randrange(90))) for _ in range(200)]
    rows = [(i if i % 7 else None, t, None, None, None) for i, t in enumerate(texts)] + [(1, "a b", "en", "s", 1)] * 3
    df = spark.createDataFrame(rows, DOCS).withColumn("n_words", F.lit("x")).withColumn("text_", F.lit(1)).withColumn("kept", F.lit(2)).withColumn("rule", F.lit(3))
    got = Counter((r.doc_id, *(r[c] for c in rules.COUNTS), r.base_failed, r.kept) for r in rules.judged(df, []).collect())
    assert got == Counter((i, *plain_counts(t), not plain_counts(t)[-1]) for i, t, *_ in rows)
    for t in texts[:8] + texts[-50:]:
        (_, shares), = rules.measured([(t or "").encode()])
        assert np.allclose(shares[0], plain_shares(t))
    assert rules.judged(spark.createDataFrame([], DOCS), []).count() == 0


def test_list_finds_planted_rules_in_order():
    rng = np.random.Generator(np.random.PCG64(1))
    x = {c: rng.random(6000) for c in ("a", "b", "c", "noise")}
    bad = (x["a"] > 0.8) & (x["b"] <= 0.5) | (x["c"] <= 0.1)
    flipped = bad ^ (rng.random(6000) < 0.01)
    found = rules.cover(x, flipped)
    verdict = np.zeros(6000, bool)
    for r in found:
        verdict |= r.holds(x)
    assert (verdict == bad).mean() > 0.98 and len(found) <= 6
    assert {("c", "<=")} in [{c[:2] for c in r.conditions} for r in found]
    pair = next(r for r in found if {c[:2] for c in r.conditions} == {("a", ">"), ("b", "<=")})
    assert all(abs(t - {"a": 0.8, "b": 0.5}[s]) < 0.02 for s, _, t in pair.conditions)
    assert not any(s == "noise" for r in found for s, _, _ in r.conditions)
    # labels that nothing explains give no rule
    assert rules.cover(x, rng.random(6000) < 0.15) == []
    assert rules.cover(x, np.zeros(6000, bool)) == [] and rules.cover({"a": np.zeros(0)}, np.zeros(0, bool)) == []


def test_expression_is_the_list(spark):
    rng = np.random.Generator(np.random.PCG64(2))
    some = [rules.Rule((("n_words", ">", 60.0), ("upper_share", "<=", 0.3))), rules.Rule((("digit_share", ">", 0.7),)), rules.Rule((("n_words", "<=", 20.0),))]
    rows = [(int(rng.integers(100)), float(rng.random()), float(rng.random())) for _ in range(500)]
    got = spark.createDataFrame(rows, "n_words long, upper_share double, digit_share double").select(rules.decision(some).alias("k")).collect()
    x = {c: np.array(v) for c, v in zip(("n_words", "upper_share", "digit_share"), zip(*rows))}
    held = np.stack([r.holds(x) for r in some])
    assert [r.k for r in got] == [int(h.argmax()) + 1 if h.any() else 0 for h in held.T]
    assert str(some[0]) == "n_words > 60 and upper_share <= 0.3"
    assert rules.decision([]) is not None


def test_verdicts_on_held_out_labels(spark):
    docs, labels = table(spark, SF, "documents"), table(spark, SF, "labels")
    found = rules.learn(docs, labels)
    assert found
    rows = rules.judged(docs, found).where(~F.col("base_failed")).join(labels.where(held_out(F.col("doc_id"))), "doc_id").collect()
    assert len(rows) > 80
    assert sum(r.kept == (r.quality == 1) for r in rows) / len(rows) > 0.98
    assert rules.learn(docs, labels) == found


def test_without_labels(spark):
    docs = table(spark, SF, "documents")
    none = spark.createDataFrame([], "doc_id long, quality int")
    odd = spark.createDataFrame([(None, 0), (1, None)], "doc_id long, quality int")
    assert rules.learn(docs, none) == [] and rules.learn(docs, odd) == []
    assert rules.judged(docs, []).where("kept = base_failed").count() == 0
