"""Groups of excerpts from one text, in which most pairs share much and few link; the masks that rule links out."""

import random

import numpy as np
import pytest

from lodestone.llm import jaccard
from tests.llm.test_operators import near_brute


def excerpts(n: int, blocks: int, taken: int, size: int, seed: int) -> dict[int, str]:
    rng = random.Random(seed)
    pieces = [" ".join(f"w{b}_{i}" for i in range(size)) for b in range(blocks)]
    texts = {i: " ".join(pieces[b] for b in sorted(rng.sample(range(blocks), taken))) for i in range(1, n)}
    return {0: " ".join(pieces), **texts}


@pytest.mark.parametrize("cell", [2, 4096])
def test_excerpts_are_exact_and_few_pairs_are_measured(spark, monkeypatch, cell):
    tried, whole = [], jaccard._beyond_pivot

    def counted(*args):
        pairs, deeper = whole(*args)
        tried.append(pairs.count())
        return pairs, deeper

    monkeypatch.setattr(jaccard, "_beyond_pivot", counted)
    texts = excerpts(100, 12, 8, 40, 3)
    got = jaccard.near_duplicates(spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(3), cell=cell, rounds=2)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got.collect()} == near_brute(texts)
    assert cell == 2 or sum(tried) < 100 * 99 / 2 / 10, tried


def test_members_close_to_one_pivot_go_deeper_too(spark, monkeypatch):
    """Excerpts that lie within one long text: all share enough with it, so they meet by size, and too many go deeper."""
    deep, whole = [], jaccard._beyond_pivot

    def seen(*args):
        pairs, deeper = whole(*args)
        deep.append(0 if deeper is None else deeper.count())
        return pairs, deeper

    monkeypatch.setattr(jaccard, "_beyond_pivot", seen)
    rng = random.Random(4)
    base = [f"w{i}" for i in range(400)]
    texts = {0: " ".join(base)}
    for i in range(1, 60):
        at = rng.randint(0, 120)
        texts[i] = " ".join(base[at : at + rng.randint(240, 280)])
    got = jaccard.near_duplicates(spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(3), cell=4, rounds=2)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got.collect()} == near_brute(texts)
    assert any(deep)


def test_masks_never_rule_out_what_may_link(spark):
    rng, rows, want = np.random.default_rng(1), [], []
    for n in (1, 2, 31, 32, 33, 64, 65, 900, 5000):
        for other in (n, max(1, n * 3 // 4), max(1, n // 3), n + 1):
            a = np.unique(rng.integers(0, 2**64, n, dtype=np.uint64))
            b = np.unique(np.concatenate([a[: min(n, other) // 2], rng.integers(0, 2**64, other - min(n, other) // 2, dtype=np.uint64)]))
            rows.append(tuple(jaccard._mask(s).view(np.int64).tolist() for s in (a, b)))
            want.append(len(np.setxor1d(a, b)))
    got = [r.k for r in spark.createDataFrame(rows, "a array<long>, b array<long>").coalesce(1).select(jaccard._differ("a", "b").alias("k")).collect()]
    assert all(k <= w for k, w in zip(got, want)) and sum(got) > sum(want) / 4
