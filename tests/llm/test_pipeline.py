"""Each stage of the pipeline against a plain version over its own input."""

import re
from collections import Counter

from pyspark.sql import functions as F

import corpus_pipeline
from lodestone.llm import quality
from lodestone.llm.common import Scratch, table
from tests.llm.test_operators import near_brute

SF = "/root/testdata/sf0.001"


def plain(text):
    return re.sub(r"[\x20\x09-\x0D]", "", text or "")


def test_stages(spark):
    docs, work = table(spark, SF, "documents"), Scratch(spark)
    columns = docs.columns
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert len(names) == 5
    kept = []
    for name, stage in corpus_pipeline.STAGES:
        docs = work.keep(stage(spark, docs, SF), "stage")
        kept.append((name, docs))
        if name != names[-1]:
            assert docs.columns == columns
    start = {r.doc_id: r for r in table(spark, SF, "documents").collect()}

    machine = quality.train(table(spark, SF, "documents"), table(spark, SF, "labels"))
    good = {r.doc_id for r in quality.score(table(spark, SF, "documents"), machine).where("predicted = 1").collect()}
    assert {r.doc_id for r in kept[0][1].collect()} == good

    best = {}
    for i in good:
        key = (-len(start[i].text or ""), i)
        best[plain(start[i].text)] = min(best.get(plain(start[i].text), key), key)
    single = {i for _, i in best.values()}
    assert {r.doc_id for r in kept[1][1].collect()} == single

    apart = {i for i, (_, c) in near_brute({i: start[i].text for i in single}).items() if c == i}
    assert {r.doc_id for r in kept[2][1].collect()} == apart

    mixed = Counter(r.doc_id for r in kept[3][1].collect())
    assert set(mixed) <= apart and max(mixed.values()) <= 2
    assert Counter(r.doc_id for r in kept[4][1].collect()) == mixed


def test_run(spark):
    assert corpus_pipeline.run(spark, SF).count() > 0


def test_repeated_rows_come_down_to_one(spark):
    rows = [(1, "a b", "en", "s", 3)] * 3 + [(2, "ab", "en", "s", 2), (None, "a b", "en", "s", 3), (4, "x", "en", "s", 1)]
    df = spark.createDataFrame(rows, table(spark, SF, "documents").schema)
    got = Counter(r.doc_id for r in corpus_pipeline.drop_copies(spark, df, SF).collect())
    assert got[1] == 1 and got[2] == 0 and got[4] == 1


def by_id_and_text(spark, stage, rows):
    df = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], table(spark, SF, "documents").schema)
    return Counter((r.doc_id, r.text) for r in stage(spark, df, SF).collect())


def test_copies_are_dropped_by_id_and_text(spark):
    rows = [(3, "c d"), (7, "c d"), (7, "own text"), (17, "a b"), (17, "ab"), (9, "ab"), (19, "a b"), (None, "n o"), (None, "n o"), (None, "no"), (None, "c d"), (None, "alone")]
    got = by_id_and_text(spark, corpus_pipeline.drop_copies, rows)
    assert got == {(3, "c d"): 1, (7, "own text"): 1, (17, "a b"): 1, (None, "n o"): 1, (None, "alone"): 1}


def test_near_copies_are_dropped_by_row(spark):
    base = [f"w{i}" for i in range(60)]
    near = lambda n: " ".join([*base, f"end{n}"])
    rows = [(3, near(0)), (7, near(1)), (7, "quite another text of id seven"), (None, near(2)), (None, "quite another text without id")]
    got = by_id_and_text(spark, corpus_pipeline.drop_near_copies, rows)
    assert got == {rows[0]: 1, rows[2]: 1, rows[4]: 1}
    far = " ".join(f"v{i}" for i in range(60))
    rows = [(None, far + " x"), (None, far + " y"), (5, near(0)), (5, near(1))]
    got = by_id_and_text(spark, corpus_pipeline.drop_near_copies, rows)
    assert Counter(i for i, _ in got.elements()) == {None: 1, 5: 1}


def odd(spark):
    """Nulls in every column, empty and very long texts, ties and repeated rows, and columns named as the stages name theirs."""
    long = "word " * 60_000
    rows = [(1, "a b c d e f g", "en", "s", 13), (1, "a b c d e f g", "en", "s", 13), (2, "abcdefg", None, None, None), (None, "x y z", "en", "s", 5), (None, None, None, None, None), (None, None, None, "s", 0)]
    rows += [(3, "", "en", "s", 0), (4, long, "en", "t", len(long)), (5, long + "end", "en", "t", 7), (2**63 - 1, "own text of this row", "fr", "t", 20)]
    df = spark.createDataFrame(rows, table(spark, SF, "documents").schema)
    return df.withColumns({c: F.lit(1) for c in ("times", "copy_", "i_", "s_", "gone_", "twice_", "row_", "id_", "source_", "times_", "kept", "text_", "size", "h_")})


def test_stages_on_odd_rows(spark):
    df = odd(spark)
    ids = lambda x: Counter((r.doc_id, r.text) for r in x.collect())
    all_rows, long = ids(df), "word " * 60_000
    by_name = dict(corpus_pipeline.STAGES)
    got = {n: by_name[n](spark, df, SF) for n, _ in corpus_pipeline.STAGES}
    for name, x in list(got.items())[:-1]:
        assert x.columns == df.columns and not ids(x).keys() - all_rows.keys(), name
    copies = ids(got["exact dedup"])
    assert copies == {(1, "a b c d e f g"): 1, (None, "x y z"): 1, (3, ""): 1, (4, long): 1, (5, long + "end"): 1, (2**63 - 1, "own text of this row"): 1}
    near = ids(got["n-gram Jaccard join"])
    assert near[(1, "a b c d e f g")] == 1 and near[(2, "abcdefg")] == 1 and near[(None, None)] == 2 and near[(4, long)] + near[(5, long + "end")] == (1 if near_brute({4: long, 5: long + "end"})[5][1] == 4 else 2)
    mixed = ids(got["mixing sources to target weights"])
    assert all(n <= 2 * all_rows[r] for r, n in mixed.items())
    assert got["BPE encoding and decoding"].count() == df.count()


def test_stages_on_an_empty_table(spark):
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, odd(spark).limit(0), SF).count() == 0, name
