"""Safeguarded acceleration of fixed-point rounds (Anderson mixing)."""

from __future__ import annotations

import numpy as np


class Anderson:
    """Next point of an iteration x -> g(x) from the last ``depth`` residuals g(x) - x.

    A step whose residual grows beyond ``patience`` times the least one seen drops the history, and the plain step
    is taken, so that the rounds are never worse off for long than without acceleration.
    """

    def __init__(self, depth: int = 6, patience: float = 2.0):
        self.depth, self.patience = depth, patience
        self.points: list[np.ndarray] = []
        self.residuals: list[np.ndarray] = []
        self.least = np.inf

    def next(self, x: np.ndarray, gx: np.ndarray) -> np.ndarray:
        f = gx - x
        size = float(np.linalg.norm(f))
        if not np.isfinite(size):
            raise ValueError("a round gave no number")
        if size > self.patience * self.least:
            self.points, self.residuals = [], []
        self.least = min(self.least, size) if self.points else size
        self.points, self.residuals = [*self.points, gx][-self.depth:], [*self.residuals, f][-self.depth:]
        if len(self.residuals) < 2:
            return gx
        df = np.stack([b - a for a, b in zip(self.residuals[:-1], self.residuals[1:])], axis=1)
        dg = np.stack([b - a for a, b in zip(self.points[:-1], self.points[1:])], axis=1)
        weights = np.linalg.lstsq(df, f, rcond=1e-10)[0]
        out = gx - dg @ weights
        return out if np.isfinite(out).all() else gx
