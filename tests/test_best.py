import numpy as np
import pytest

from lodestone.operators import validate
from lodestone.operators.measures import Best, Dot


@pytest.mark.parametrize("k", [1, 4, 21])
def test_few_merges_and_the_same_best(monkeypatch, k):
    draw = np.random.default_rng(3)
    x = draw.standard_normal((6000, 8)).round(1)  # few values, so many ties
    x[3000:5000] = x[:2000]
    q, merges = x[:300], []
    monkeypatch.setattr(Best, "TILE", 300 * 64)  # 94 tiles
    whole = Best._merge
    monkeypatch.setattr(Best, "_merge", lambda self, lo: (merges.append(lo), whole(self, lo))[1])
    best = Best(Dot(), q, k)
    for at in range(0, 6000, 500):
        best.add(np.arange(at, min(at + 500, 6000)), x[at : at + 500])
    got = best.columns(np.arange(300))
    scores = np.round(q @ x.T, 12)
    for i in range(300):
        order = np.lexsort((np.arange(6000), -scores[i]))[:k]
        assert got["item_id"][got["query_id"] == i].tolist() == order.tolist()
    assert len(merges) < 30


def test_neighbours_are_found_once(spark):
    rows = [(i, [float(i % 7), float(i % 5), 1.0], i % 3) for i in range(60)]
    scores = validate.knn_scores(spark.createDataFrame(rows, "item_id long, vector array<double>, label int"), 5)
    assert "InArrow" not in scores._jdf.queryExecution().executedPlan().toString() and scores.count() == 3
