"""Small NumPy kernels used inside folds and on the driver."""

from __future__ import annotations

import numpy as np


def ewma(x, window: int) -> np.ndarray:
    """Adjusted exponentially weighted mean: sum (1-a)^k x / sum (1-a)^k with a = 2 / (window + 1)."""
    x = np.asarray(x, float)
    keep = 1 - 2 / (window + 1)
    out, top, low = np.empty(len(x)), 0.0, 0.0
    for k, v in enumerate(x):
        top, low = top * keep + v, low * keep + 1
        out[k] = top / low
    return out


def ewma_last(x, window: int) -> float:
    x = np.asarray(x, float)
    w = (1 - 2 / (window + 1)) ** np.arange(len(x) - 1, -1, -1.0)
    return float((w * x).sum() / w.sum())


def ema(x, window: int) -> np.ndarray:
    """Recursive exponential mean, started at the first value."""
    x = np.asarray(x, float)
    a, out = 2 / (window + 1), np.empty(len(x))
    for k, v in enumerate(x):
        out[k] = v if k == 0 else a * v + (1 - a) * out[k - 1]
    return out


class EwmStd:
    """Running bias-corrected exponentially weighted standard deviation (span), as pandas' ewm(span).std()."""

    def __init__(self, span: int):
        self.keep, self.n = 1 - 2 / (span + 1), 0
        self.mean = self.var = self.total = self.square = 0.0

    def push(self, x: float) -> float:
        if np.isnan(x):  # a gap ages the weights that are there
            if self.n:
                self.total, self.square = self.total * self.keep, self.square * self.keep**2
            return self.value()
        old = self.total * self.keep
        self.square = self.square * self.keep**2 + 1
        self.total = old + 1
        new = (old * self.mean + x) / self.total
        self.var = (old * (self.var + (self.mean - new) ** 2) + (x - new) ** 2) / self.total
        self.mean, self.n = new, self.n + 1
        return self.value()

    def value(self) -> float:
        low = self.total**2 - self.square
        return float(np.sqrt(self.var * self.total**2 / low)) if self.n > 1 and low > 0 else np.nan
