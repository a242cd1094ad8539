"""Distances between blocks of vectors, for use inside tasks."""

from __future__ import annotations

import numpy as np
import pandas as pd


def stack(col: pd.Series) -> np.ndarray:
    return np.stack(col.to_numpy()).astype(np.float64)


def distances(a: np.ndarray, b: np.ndarray, metric: str = "euclidean") -> np.ndarray:
    """All distances between the rows of two bounded blocks."""
    if metric == "manhattan":
        out = np.zeros((len(a), len(b)))
        for j in range(a.shape[1]):
            out += np.abs(a[:, j, None] - b[None, :, j])
        return out
    if metric != "euclidean":
        raise ValueError(f"unsupported metric: {metric}")
    centre = b.mean(axis=0)  # smaller numbers lose less in the product form
    a, b = a - centre, b - centre
    sq = (a * a).sum(1)[:, None] + (b * b).sum(1)[None, :] - 2.0 * (a @ b.T)
    return np.sqrt(np.maximum(sq, 0.0))
