"""Runs over the places of a text or token stream."""

from __future__ import annotations

import numpy as np


def covered(starts: np.ndarray, length: int, n: int) -> np.ndarray:
    """Mask of the places that lie in a window of ``length`` from one of ``starts``."""
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, starts, 1)
    np.add.at(edge, np.minimum(starts + length, n), -1)
    return np.cumsum(edge[:n]) > 0
