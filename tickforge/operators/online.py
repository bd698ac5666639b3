"""Online portfolio selection: weights by date from relatives seen so far, and their cumulative return.

The relatives of all dates (dates by assets) come to one place, as every step depends on the last; a
date is a row of as many numbers as there are assets. ``select`` runs many strategies as tasks.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickforge.functions.linear import concave_maximum, simplex_projection


def relatives(prices: np.ndarray) -> np.ndarray:
    """p_t / p_(t-1), the first row being 1. Prices must be above 0."""
    prices = np.asarray(prices, float)
    if not np.isfinite(prices).all() or (prices <= 0).any():
        raise ValueError("prices must be numbers above 0, without gaps")
    out = np.ones_like(prices)
    out[1:] = prices[1:] / prices[:-1]
    return out


def log_optimal(x: np.ndarray, weight: np.ndarray | None = None, ridge: float = 0.0) -> np.ndarray:
    """The constant weights of the largest (weighted) mean log return over rows x, less ridge * ||w|| / 2."""
    if not len(x):
        return np.full(x.shape[1], 1 / x.shape[1])
    k = np.ones(len(x)) if weight is None else np.asarray(weight, float)

    def value(w):
        return float(k @ np.log(np.maximum(x @ w, 1e-300))) - ridge * math.sqrt(w @ w) / 2

    def gradient(w):
        return x.T @ (k / np.maximum(x @ w, 1e-300)) - ridge * w / (2 * math.sqrt(w @ w))

    return concave_maximum(value, gradient, x.shape[1], steps=500)


class Strategy:
    """weights[t] uses relatives up to t - 1. ``step(t, w, x)`` gives the weights after seeing x[:t + 1]."""

    def start(self, x, first):
        return np.full(x.shape[1], 1 / x.shape[1]) if first is None else np.asarray(first, float)

    def run(self, x: np.ndarray, first=None) -> np.ndarray:
        self.prepare(x)
        w = np.zeros_like(x)
        w[0] = self.start(x, first)
        for t in range(len(x) - 1):
            w[t + 1] = self.step(t, w[t], x)
        w = np.where(w < 1e-6, 0, w)
        return w / w.sum(1, keepdims=True)

    def prepare(self, x):
        pass


class BuyAndHold(Strategy):
    def step(self, t, w, x):
        v = w * x[t]
        return v / v.sum()


class ConstantRebalanced(Strategy):
    def __init__(self, weight=None):
        self.weight = weight

    def start(self, x, first):
        return super().start(x, self.weight if self.weight is not None else first)

    def step(self, t, w, x):
        return w


class BestStock(ConstantRebalanced):
    def start(self, x, first):
        return np.eye(x.shape[1])[x.prod(0).argmax()]


class BestConstantRebalanced(ConstantRebalanced):
    def start(self, x, first):
        return log_optimal(x)


class ExponentialGradient(Strategy):
    def __init__(self, rule="MU", eta=0.05, textbook=False):
        if rule not in ("MU", "EM", "GP"):
            raise ValueError("rule is MU, EM or GP")
        self.rule, self.eta, self.textbook = rule, eta, textbook

    def step(self, t, w, x):
        r = x[t] / (w @ x[t])
        if self.rule == "MU":
            v = w * np.exp(self.eta * r)
        elif self.rule == "EM":
            v = w * (1 + self.eta * (r - 1))
        else:
            mean = r.mean() if self.textbook else x[t].sum() / len(w) / (w @ x[t])
            v = w + self.eta * (r - mean)
        v = np.maximum(v, 0) if self.rule == "GP" else v
        return v / v.sum()


class FollowTheLeader(Strategy):
    def __init__(self, beta=0.0):
        self.beta = beta

    def step(self, t, w, x):
        return log_optimal(x[:t + 1], ridge=self.beta)


class PassiveAggressive(Strategy):
    def __init__(self, variant=0, epsilon=0.5, aggressiveness=10, textbook=False):
        if variant not in (0, 1, 2) or epsilon < 0 or aggressiveness < 0:
            raise ValueError("variant is 0, 1 or 2; epsilon and aggressiveness are at least 0")
        self.variant, self.epsilon, self.c, self.textbook = variant, epsilon, aggressiveness, textbook

    def step(self, t, w, x):
        d = x[t] - (x[t].mean() if self.textbook else x[t].mean() / len(w))
        loss, norm = max(0.0, w @ x[t] - self.epsilon), d @ d
        if self.variant == 2:
            tau = loss / (norm + 1 / (2 * self.c)) if self.c else 0.0
        else:
            tau = loss / norm if norm else 0.0
            tau = min(self.c, tau) if self.variant == 1 else tau
        return simplex_projection(w - tau * d)


class ConfidenceWeighted(Strategy):
    def __init__(self, confidence=0.5, epsilon=0.5, method="var"):
        if method not in ("var", "sd") or not 0 <= confidence <= 1 or not 0 <= epsilon <= 1:
            raise ValueError("method is var or sd; confidence and epsilon lie in [0, 1]")
        from statistics import NormalDist

        self.theta, self.epsilon, self.method = NormalDist().inv_cdf(min(max(confidence, 1e-12), 1 - 1e-12)), epsilon, method

    def prepare(self, x):
        self.sigma = np.eye(x.shape[1]) / x.shape[1] ** 2

    def step(self, t, w, x):
        v, s = x[t], self.sigma
        m, var, total = w @ v, v @ s @ v, s.sum()
        mean = (s @ v).sum() / total
        theta, eps = self.theta, self.epsilon
        cross = var - mean * (s @ v).sum()
        if self.method == "var":
            a = 2 * theta * var * cross
            b = 2 * theta * var * (eps - m) + cross
            c = eps - m - theta * var
        else:
            a = (cross + theta**2 * var / 2) ** 2 - theta**4 * var**2 / 4
            b = 2 * (eps - m) * (cross + theta**2 * var / 2)
            c = (eps - m) ** 2 - theta**2 * var
        root = b * b - 4 * a * c
        options = [(-b + k * math.sqrt(root)) / (2 * a) for k in (1, -1)] if a and root >= 0 else [-c / b] if b else [0.0]
        rate = min(max(0.0, *options), 1e4)
        new = simplex_projection(w - rate * s @ (v - mean))
        if self.method == "var":
            inverse = np.linalg.inv(s) + 2 * rate * theta * np.diag(v**2)
        else:
            u = ((-rate * theta * var + math.sqrt(rate**2 * theta**2 * var**2 + 4 * var)) / 2) ** 2
            inverse = np.linalg.inv(s) + rate * theta / math.sqrt(max(u, 1e-12)) * np.diag(v**2)
        s = np.linalg.inv(inverse)
        s[s < 1e-5] = 1e-5
        self.sigma = s / (np.trace(s) * len(w))
        return new


class MeanReversion(Strategy):
    """Moving-average reversion: 1 over a window, 2 exponential."""

    def __init__(self, method=1, epsilon=10, window=5, alpha=0.5):
        if method not in (1, 2) or epsilon < 1 or (method == 1 and window < 1) or (method == 2 and not 0 <= alpha <= 1):
            raise ValueError("method is 1 or 2, epsilon at least 1, window at least 1, alpha in [0, 1]")
        self.method, self.epsilon, self.window, self.alpha = method, epsilon, window, alpha

    def prepare(self, x):
        self.price, self.guess = x.cumprod(0), np.ones(x.shape[1])

    def predict(self, t, x):
        if self.method == 1:
            if t < self.window - 1:
                return x[t]
            return self.price[t - self.window + 1:t + 1].mean(0) / self.price[t]
        self.guess = self.alpha + (1 - self.alpha) * self.guess / x[t]
        return self.guess

    def step(self, t, w, x):
        guess = self.predict(t, x)
        d = guess - guess.mean()
        norm = d @ d
        rate = max(0.0, (self.epsilon - w @ guess) / norm) if norm else 0.0
        return simplex_projection(w + rate * d)


class RobustMedianReversion(MeanReversion):
    def __init__(self, epsilon=15, iterations=10, window=7, tau=0.001):
        self.epsilon, self.iterations, self.window, self.tau = epsilon, iterations, window, tau

    def predict(self, t, x):
        if t < self.window - 1:
            return x[t]
        p = self.price[t - self.window + 1:t + 1]
        mu = np.median(p, 0)
        for _ in range(self.iterations):
            gap = np.abs(p - mu).sum(1)
            far = gap > 0
            if not far.any():
                break
            near = (p[far] / gap[far, None]).sum(0) / (1 / gap[far]).sum()
            pull = np.abs(((p[far] - mu) / gap[far, None]).sum(0)).sum()
            eta = 0.0 if far.all() else 1.0
            share = min(1.0, eta / pull) if pull else 1.0
            new = (1 - share) * near + share * mu
            done = np.abs(new - mu).sum() <= self.tau * np.abs(mu).sum()
            mu = new
            if done:
                break
        return mu / self.price[t]


class Correlation(Strategy):
    """Log-optimal over the days whose trailing windows resemble the last one.

    kind: plain takes those correlated above rho; symmetric also sets the opposite days against them;
    functional weighs all days by a sigmoid of their correlation.
    """

    def __init__(self, window=5, rho=0.1, kind="plain", lambd=10.0):
        if window < 1 or not -1 <= rho <= 1 or kind not in ("plain", "symmetric", "functional"):
            raise ValueError("window is at least 1, rho in [-1, 1], kind plain, symmetric or functional")
        self.window, self.rho, self.kind, self.lambd = window, rho, kind, lambd

    def prepare(self, x):
        n = self.window
        flat = np.stack([x[k - n + 1:k + 1].ravel() for k in range(n - 1, len(x))]) if len(x) >= n else np.zeros((0, 1))
        c = flat - flat.mean(1, keepdims=True) if len(flat) else flat
        size = np.sqrt((c * c).sum(1, keepdims=True))
        self.unit = np.divide(c, size, out=np.zeros_like(c), where=size > 0)

    def step(self, t, w, x):
        n = self.window
        if t < n:
            return np.full(x.shape[1], 1 / x.shape[1])
        like = self.unit[:t - n + 1] @ self.unit[t - n + 1]  # windows that end at n - 1 .. t - 1
        days = np.arange(n, t + 1)  # the day after each
        if self.kind == "functional":
            up = like >= self.rho
            k = np.where(up, 1 / (1 + np.exp(-self.lambd * (like - self.rho))), 0) - np.where(like < -self.rho, 1 / (1 + np.exp(-self.lambd * (-like - self.rho))), 0)
            return log_optimal(x[days], k)
        near = like > self.rho
        if self.kind == "plain":
            return log_optimal(x[days[near]])
        far = like < -self.rho
        k = near.astype(float) - far
        return log_optimal(x[days[k != 0]], k[k != 0])


class Universal(Strategy):
    """A mix of experts: by past wealth (hist_performance), evenly (uniform), or over the k wealthiest (top-k)."""

    def __init__(self, experts=100, weighted="hist_performance", k=1, seed=0):
        if weighted not in ("hist_performance", "uniform", "top-k"):
            raise ValueError("weighted is hist_performance, uniform or top-k")
        self.experts, self.weighted, self.k, self.seed = experts, weighted, k, seed

    def make(self, x):
        """Random points of the simplex, by gaps of sorted uniforms."""
        u = np.sort(np.random.default_rng(self.seed).uniform(size=(self.experts, x.shape[1] - 1)), 1)
        w = np.diff(np.concatenate([np.zeros((self.experts, 1)), u, np.ones((self.experts, 1))], 1), axis=1)
        return [ConstantRebalanced(v) for v in w]

    def run(self, x, first=None):
        self.weights = np.stack([e.run(x) for e in self.make(x)])
        self.wealth = (self.weights * x).sum(2).cumprod(1)
        return self.combine(self.k)

    def combine(self, k):
        """The mix for another k, without running the experts again."""
        n, t = self.wealth.shape
        before = np.concatenate([np.ones((n, 1)), self.wealth[:, :-1]], 1)
        if self.weighted == "uniform":
            share = np.full((n, t), 1 / n)
        elif self.weighted == "hist_performance":
            share = before / before.sum(0)
        else:
            rank = np.argsort(np.argsort(-before, 0, kind="stable"), 0)
            share = (rank < k) / k
            share[:, 0] = 1 / n
        w = np.einsum("nt,nta->ta", share, self.weights)
        w = np.where(w < 1e-6, 0, w)
        return w / w.sum(1, keepdims=True)


class CorrelationEnsemble(Universal):
    """Correlation experts over windows 1 .. window and, for k > 0, rho levels 0, 1/rho, ...; uniform if k is 0, else the k best."""

    def __init__(self, window=5, rho=1, k=0, kind="plain", lambd=1):
        self.window, self.rho, self.kind, self.lambd = window, rho, kind, lambd
        self.weighted, self.k = ("top-k", k) if k else ("uniform", 1)

    def make(self, x):
        levels = [self.rho] if not self.k or self.weighted == "uniform" else [r / self.rho for r in range(int(self.rho))]
        slopes = [10.0**i for i in range(int(self.lambd))] if self.kind == "functional" else [1.0]
        return [Correlation(w, r, self.kind, s) for w in range(1, self.window + 1) for r in levels for s in slopes]


STRATEGIES = {
    "bah": BuyAndHold, "crp": ConstantRebalanced, "best_stock": BestStock, "bcrp": BestConstantRebalanced, "eg_mu": lambda: ExponentialGradient("MU"),
    "eg_em": lambda: ExponentialGradient("EM"), "eg_gp": lambda: ExponentialGradient("GP"), "ftl": FollowTheLeader, "ftrl": lambda: FollowTheLeader(0.1),
    "pamr": PassiveAggressive, "pamr_1": lambda: PassiveAggressive(1), "pamr_2": lambda: PassiveAggressive(2), "cwmr_var": ConfidenceWeighted,
    "cwmr_sd": lambda: ConfidenceWeighted(method="sd"), "olmar_1": MeanReversion, "olmar_2": lambda: MeanReversion(2), "rmr": RobustMedianReversion,
    "corn": Correlation, "scorn": lambda: Correlation(kind="symmetric"), "fcorn": lambda: Correlation(kind="functional"), "up": Universal,
    "corn_u": lambda: CorrelationEnsemble(3, 0.1), "corn_k": lambda: CorrelationEnsemble(2, 2, 2), "scorn_k": lambda: CorrelationEnsemble(2, 2, 2, "symmetric"),
    "fcorn_k": lambda: CorrelationEnsemble(2, 1, 2, "functional", 2),
}


def select(panel: DataFrame, names: list[str]) -> DataFrame:
    """strategy, ts, asset, weight, wealth of a panel (ts, asset, price), on the dates that have all assets; a task per strategy."""
    assets = panel.select("asset").distinct()
    n = assets.count()
    whole = panel.where("price is not null").groupBy("ts").agg(F.sort_array(F.collect_list(F.struct("asset", "price"))).alias("row")).where(F.size("row") == n)
    dated = whole.withColumn("strategy", F.explode(F.array(*[F.lit(x) for x in names])))

    def run(key, pdf):
        import pandas as pd

        pdf = pdf.sort_values("ts")
        assets = [r["asset"] for r in pdf["row"].iloc[0]]
        x = relatives(np.array([[r["price"] for r in row] for row in pdf["row"]]))
        w = STRATEGIES[key[0]]().run(x)
        wealth = (w * x).sum(1).cumprod()
        k = len(assets)
        return pd.DataFrame({"strategy": key[0], "ts": np.repeat(pdf["ts"].to_numpy(), k), "asset": assets * len(pdf), "weight": w.ravel(), "wealth": np.repeat(wealth, k)})

    return dated.groupBy("strategy").applyInPandas(run, "strategy string, ts timestamp_ntz, asset string, weight double, wealth double")
