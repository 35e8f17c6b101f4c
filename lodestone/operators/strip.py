"""Strip: of a search's results keep the cluster of the best scores."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame


def _cluster(scores: np.ndarray, k: int = 16, steps: int = 50) -> np.ndarray:
    """One-dimensional k-means from evenly spaced starts; a label per score."""
    k = min(k, len(np.unique(scores)))
    centres = np.quantile(scores, np.linspace(0, 1, k)) if k > 1 else scores[:1]
    label = np.zeros(len(scores), int)
    for _ in range(steps):
        label = np.abs(scores[:, None] - centres[None]).argmin(1)
        new = np.array([scores[label == i].mean() if (label == i).any() else c for i, c in enumerate(centres)])
        if np.allclose(new, centres):
            break
        centres = new
    return label


#: How many times n a search takes before the cut.
OVERFETCH = 8

#: Results that are never cut: clusters of so few say nothing.
FEW = 16


def leading_run(scores: np.ndarray, high: float = 0.8) -> int:
    """How many of the descending scores to keep: the run with the top one's label; if all of it is at least ``high``, the
    next run, too. FEW or fewer are all kept."""
    if len(scores) <= FEW:
        return len(scores)
    label = _cluster(np.asarray(scores, np.float64))
    ends = [*np.flatnonzero(np.diff(label)) + 1, len(scores)]
    keep = int(ends[0])
    return int(ends[1]) if scores[:keep].min() >= high and len(ends) > 1 else keep


def strip(results: DataFrame, query_col: str | None = None) -> DataFrame:
    """Keeps the leading cluster of each query's results. ``results`` is what a search returned, a few rows a query; a
    search that is to return n takes OVERFETCH times as many first."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("similarity", ascending=False, kind="stable")
        return pdf.head(leading_run(pdf["similarity"].to_numpy()))

    return results.groupBy(*([query_col] if query_col else [])).applyInPandas(run, results.schema)
