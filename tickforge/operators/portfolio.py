"""Portfolios: moments of returns as Spark aggregations, and allocations as kernels in the number of assets.

Rows of a panel never leave the executors; what comes to the driver is a mean vector and a covariance
matrix, whose size is that of the assets.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tickforge.functions.linear import cut_tree, kmeans, leaves, linkage, quadratic, silhouettes


def returns(panel: DataFrame) -> DataFrame:
    """ts, asset, ret: simple returns of a panel (ts, asset, price)."""
    w = Window.partitionBy("asset").orderBy("ts")
    return panel.select("ts", "asset", (F.col("price") / F.lag("price").over(w) - 1).alias("ret")).where("ret is not null")


def mean_returns(rets: DataFrame, frequency: int = 252) -> DataFrame:
    return rets.groupBy("asset").agg((F.avg("ret") * frequency).alias("mean_return"))


def ewm_returns(rets: DataFrame, frequency: int = 252, span: int = 500) -> DataFrame:
    """asset, mean_return: the last exponentially weighted mean, from weights by rank from the end."""
    age = F.row_number().over(Window.partitionBy("asset").orderBy(F.desc("ts"))) - 1
    r = rets.withColumn("_w", F.pow(F.lit(1 - 2 / (span + 1)), age))
    return r.groupBy("asset").agg((F.sum(F.col("ret") * F.col("_w")) / F.sum("_w") * frequency).alias("mean_return"))


def covariance(rets: DataFrame, kind: str = "empirical", threshold: float = 0.0, span: int = 60, divide_by_rows: bool = False) -> DataFrame:
    """i, j, value over all pairs of assets with i <= j, on the times that both have.

    empirical divides by n; sample by n - 1; semi sums the products of shortfalls below the threshold and
    divides by times and assets (times alone if divide_by_rows); exponential is the last exponentially weighted mean of products of deviations.
    """
    a = rets.select("ts", F.col("asset").alias("i"), F.col("ret").alias("x"))
    b = rets.select("ts", F.col("asset").alias("j"), F.col("ret").alias("y"))
    p = a.join(b, "ts").where("i <= j")
    if kind in ("empirical", "sample"):
        return p.groupBy("i", "j").agg((F.covar_pop if kind == "empirical" else F.covar_samp)("x", "y").alias("value"))
    if kind == "semi":
        low = lambda c: F.least(F.col(c) - threshold, F.lit(0.0))
        assets = 1 if divide_by_rows else rets.select("asset").distinct().count()
        return p.groupBy("i", "j").agg((F.sum(low("x") * low("y")) / (F.count(F.lit(1)) * assets)).alias("value"))
    if kind == "exponential":
        w = Window.partitionBy("i", "j")
        p = p.withColumn("_p", (F.col("x") - F.avg("x").over(w)) * (F.col("y") - F.avg("y").over(w)))
        p = p.withColumn("_w", F.pow(F.lit(1 - 2 / (span + 1)), F.row_number().over(w.orderBy(F.desc("ts"))) - 1))
        return p.groupBy("i", "j").agg((F.sum(F.col("_p") * F.col("_w")) / F.sum("_w")).alias("value"))
    raise ValueError("kind is empirical, sample, semi or exponential")


def to_matrix(cells: DataFrame) -> tuple[list[str], np.ndarray]:
    """Names and the symmetric matrix of i, j, value; as many cells as pairs of assets."""
    rows = cells.collect()
    names = sorted({r["i"] for r in rows} | {r["j"] for r in rows})
    at, out = {n: k for k, n in enumerate(names)}, np.zeros((len(names), len(names)))
    for r in rows:
        out[at[r["i"]], at[r["j"]]] = out[at[r["j"]], at[r["i"]]] = r["value"]
    return names, out


def weights_table(spark: SparkSession, names: list[str], w: np.ndarray) -> DataFrame:
    return spark.createDataFrame([(n, float(x)) for n, x in zip(names, w)], "asset string, weight double")


def cov_to_corr(cov: np.ndarray) -> np.ndarray:
    s = np.sqrt(np.diag(cov))
    return np.clip(cov / np.outer(s, s), -1, 1)


def corr_to_cov(corr: np.ndarray, std: np.ndarray) -> np.ndarray:
    return corr * np.outer(std, std)


def shrunk(cov: np.ndarray, n: int | None = None, kind: str = "basic", share: float = 0.1, fourth: float | None = None) -> np.ndarray:
    """Shrinkage toward mu I: by a fixed share (basic), Ledoit-Wolf (needs ``fourth``, the mean of ||x x'||^2 over the n rows), or OAS."""
    p = len(cov)
    mu, sq = np.trace(cov) / p, (cov**2).sum()
    if kind == "lw":
        delta = (sq - 2 * mu * np.trace(cov) + p * mu**2) / p
        beta = (fourth - sq) / (n * p)
        share = 0.0 if delta == 0 else min(beta, delta) / delta
    elif kind == "oas":
        alpha, top = (cov**2).mean(), (cov**2).mean() + mu**2
        low = (n + 1) * (alpha - mu**2 / p)
        share = 1.0 if low == 0 else min(top / low, 1.0)
    elif kind != "basic":
        raise ValueError("kind is basic, lw or oas")
    return (1 - share) * cov + share * mu * np.eye(p)


def minimum_covariance_determinant(x: np.ndarray, support: float = 0.5, starts: int = 50, seed: int = 0) -> np.ndarray:
    """The covariance of the share of rows with the least determinant found, by concentration steps from random starts.

    For a bounded matrix of returns (times by assets).
    """
    rng, (n, p) = np.random.default_rng(seed), x.shape
    h, best = max(int(math.ceil(support * n)), (n + p + 1) // 2), (np.inf, None)
    for _ in range(starts):
        rows = rng.choice(n, min(n, p + 1), replace=False)
        for _ in range(30):
            m, s = x[rows].mean(0), np.cov(x[rows].T, bias=True)
            d = np.einsum("ij,jk,ik->i", x - m, np.linalg.pinv(s), x - m)
            new = np.argsort(d, kind="stable")[:h]
            if set(new) == set(rows):
                break
            rows = new
        sign, det = np.linalg.slogdet(np.cov(x[rows].T, bias=True))
        if sign > 0 and det < best[0]:
            best = (det, rows)
    return np.cov(x[best[1]].T, bias=True)


def marchenko_pastur_variance(eigenvalues: np.ndarray, q: float, bandwidth: float, points: int = 1000) -> float:
    """The noise variance whose Marchenko-Pastur density fits best a Gaussian kernel density of the eigenvalues."""
    def error(v):
        lo, hi = v * (1 - (1 / q) ** 0.5) ** 2, v * (1 + (1 / q) ** 0.5) ** 2
        x = np.linspace(lo, hi, points)
        pdf = q / (2 * np.pi * v * x) * np.sqrt(np.maximum(0, (hi - x) * (x - lo)))
        kde = np.exp(-(((x[:, None] - eigenvalues) / bandwidth) ** 2) / 2).mean(1) / (bandwidth * math.sqrt(2 * np.pi))
        return ((kde - pdf) ** 2).sum()

    grid = np.linspace(1e-5, 1 - 1e-5, 200)
    k = int(np.argmin([error(v) for v in grid]))
    a, b = grid[max(0, k - 1)], grid[min(len(grid) - 1, k + 1)]
    ratio = (math.sqrt(5) - 1) / 2
    for _ in range(60):  # golden section
        c, d = b - ratio * (b - a), a + ratio * (b - a)
        a, b = (a, d) if error(c) < error(d) else (c, b)
    return (a + b) / 2


def denoised(cov: np.ndarray, q: float, method: str = "const_resid_eigen", detone: bool = False, market: int = 1, bandwidth: float = 0.01, alpha: float = 0.0) -> np.ndarray:
    """The covariance with its noise eigenvalues averaged (or its noise part shrunk by alpha), detoned on request. q: times per asset."""
    std, corr = np.sqrt(np.diag(cov)), cov_to_corr(cov)
    value, vector = np.linalg.eigh(corr)
    value, vector = value[::-1], vector[:, ::-1]
    v = marchenko_pastur_variance(value, q, bandwidth)
    k = int((value > v * (1 + (1 / q) ** 0.5) ** 2).sum())
    if method == "const_resid_eigen":
        value = value.copy()
        if k < len(value):
            value[k:] = value[k:].mean()
        out = vector @ np.diag(value) @ vector.T
        s = np.sqrt(np.diag(out))
        out = out / np.outer(s, s)
    elif method == "target_shrink":
        signal, noise = (vector[:, a:b] @ np.diag(value[a:b]) @ vector[:, a:b].T for a, b in ((0, k), (k, len(value))))
        out = signal + alpha * noise + (1 - alpha) * np.diag(np.diag(noise))
    else:
        raise ValueError("method is const_resid_eigen or target_shrink")
    if detone:
        value, vector = np.linalg.eigh(out)
        top = np.argsort(value)[::-1][:market]
        out = out - vector[:, top] @ np.diag(value[top]) @ vector[:, top].T
        s = np.sqrt(np.diag(out))
        out = out / np.outer(s, s)
    return corr_to_cov(out, std)


# Risk of portfolio returns, as aggregations ----------------------------------------------------------


def risk_metrics(rets: DataFrame, level: float = 0.05) -> DataFrame:
    """asset, var, shortfall, cdar: the higher quantile of returns, the mean below it, and the mean of the largest
    drawdowns so far at or above their own higher quantile."""
    rank = lambda c: F.row_number().over(Window.partitionBy("asset").orderBy(c))
    n = F.count(F.lit(1)).over(Window.partitionBy("asset"))
    w = Window.partitionBy("asset").orderBy("ts").rowsBetween(Window.unboundedPreceding, 0)
    r = rets.withColumns({"_k": rank("ret"), "_n": n, "_fall": F.max("ret").over(w) - F.col("ret")})
    r = r.withColumn("_most", F.max("_fall").over(w))
    r = r.withColumn("_m", rank("_most"))
    place = lambda q: F.ceil(q * (F.col("_n") - 1) - 1e-9) + 1
    cut = Window.partitionBy("asset")
    r = r.withColumns({"_v": F.max(F.when(F.col("_k") == place(level), F.col("ret"))).over(cut), "_c": F.max(F.when(F.col("_m") == place(1 - level), F.col("_most"))).over(cut)})
    return r.groupBy("asset").agg(
        F.max("_v").alias("var"), F.avg(F.when(F.col("ret") < F.col("_v"), F.col("ret"))).alias("shortfall"), F.avg(F.when(F.col("_most") >= F.col("_c"), F.col("_most"))).alias("cdar")
    )


# Allocations -----------------------------------------------------------------------------------------


def inverse_variance(cov: np.ndarray) -> np.ndarray:
    w = 1 / np.diag(cov)
    return w / w.sum()


def mean_variance(solution: str, cov: np.ndarray, mu: np.ndarray | None = None, target_return=0.0, target_risk=0.01, aversion=10.0, low=None, high=None) -> np.ndarray:
    """Weights of sum 1 in [low, high] (0 to 1 by default) for one of eight solutions."""
    mu = np.zeros(len(cov)) if mu is None else mu

    def frontier(q, m):
        return critical_line(m, q, low, high)

    def along(points, wanted, of):
        """The point of the frontier, from the largest mean down, where ``of`` first falls to ``wanted``."""
        for (x, _), (y, _) in zip(points, points[1:]):
            if of(x) > wanted >= of(y):
                lo, hi = 0.0, 1.0
                for _ in range(80):
                    t = (lo + hi) / 2
                    lo, hi = (t, hi) if of((1 - t) * x + t * y) > wanted else (lo, t)
                return (1 - hi) * x + hi * y
        return points[0][0] if of(points[0][0]) <= wanted else points[-1][0]

    if solution == "inverse_variance":
        w = inverse_variance(cov)
    elif solution == "min_volatility":
        w = frontier(cov, mu)[-1][0]
    elif solution == "max_return_min_volatility":
        w = quadratic(2 * aversion * cov, -mu, low, high)
    elif solution == "efficient_risk":  # the least risk at a mean of the target at least
        points = frontier(cov, mu)
        w = points[-1][0] if points[-1][0] @ mu >= target_return else along(points, target_return, lambda v: v @ mu)
    elif solution == "efficient_return":  # the largest mean at a variance of the target at most
        w = along(frontier(cov, mu), target_risk, lambda v: v @ cov @ v)
    elif solution == "max_sharpe":
        w = critical_line_best(frontier(cov, mu), mu, cov, "max_sharpe")
    elif solution == "max_decorrelation":
        w = frontier(cov_to_corr(cov), mu)[-1][0]
    elif solution == "max_diversification":
        w = frontier(cov_to_corr(cov), mu)[-1][0] / np.diag(cov)
        w = w / w.sum()
    else:
        raise ValueError(f"no solution {solution}")
    w = np.where(w < 0, 0, w) if low is None else w
    return w / w.sum()


def efficient_frontier(cov, mu, risk_free=0.05, points=100) -> list[tuple[float, float, float]]:
    """(return, volatility, Sharpe ratio) along target returns."""
    out = []
    for r in np.linspace(mean_variance("min_volatility", cov, mu) @ mu, mu.max(), points):
        w = mean_variance("efficient_risk", cov, mu, target_return=r)
        s = math.sqrt(w @ cov @ w)
        out.append((float(w @ mu), s, (float(w @ mu) - risk_free) / s))
    return out


def hierarchical_risk_parity(cov: np.ndarray, method: str = "single", side: np.ndarray | None = None) -> np.ndarray:
    """Recursive bisection of the clustered order by inverse variance; short sides get half the budget, negative."""
    corr = cov_to_corr(cov)
    order = leaves(linkage(np.sqrt((1 - corr) / 2), method)) if len(cov) > 1 else [0]
    w = np.ones(len(cov))

    def variance(items):
        c = cov[np.ix_(items, items)]
        v = inverse_variance(c)
        return v @ c @ v

    stack = [order]
    while stack:
        items = stack.pop()
        if len(items) > 1:
            a, b = items[:len(items) // 2], items[len(items) // 2:]
            share = 1 - variance(a) / (variance(a) + variance(b))
            w[a] *= share
            w[b] *= 1 - share
            stack += [a, b]
    if side is not None and (np.asarray(side) < 0).any():
        short = np.asarray(side) < 0
        if not short.all():
            w[short] *= -0.5 / w[short].sum()
            w[~short] *= 0.5 / w[~short].sum()
        else:
            w = -w
    return w


def gap_clusters(corr: np.ndarray, x: np.ndarray, method: str = "ward", references: int = 5, seed: int = 0) -> int:
    """The number of clusters by the two-step gap statistic against uniform references. x: a bounded matrix, times by assets."""
    rng = np.random.default_rng(seed)

    def inertia(corr, k_max):
        merges = linkage(np.sqrt(np.maximum(0, 2 * (1 - corr))), method)
        out = []
        for k in range(1, k_max + 1):
            total = 0.0
            for items in cut_tree(merges, k):
                d = 2 * (1 - corr[np.ix_(items, items)])
                total += d.sum() / (2 * len(items))
            out.append(total)
        return np.log(np.maximum(1e-12, out))

    k_max = min(10, len(corr))
    own = inertia(corr, k_max)
    other = np.mean([inertia(np.corrcoef(rng.uniform(x.min(0), x.max(0), x.shape).T), k_max) for _ in range(references)], axis=0)
    return int(np.argmax(other - own)) + 1


def hierarchical_equal_risk(cov: np.ndarray, k: int, risk: str = "equal_weighting", method: str = "ward", asset_risk: np.ndarray | None = None) -> np.ndarray:
    """Risk budgets split down the tree to k clusters, then naive risk parity within. asset_risk: each asset's own risk
    for the measures (variance, standard_deviation, expected_shortfall, conditional_drawdown_risk)."""
    corr, n = cov_to_corr(cov), len(cov)
    merges = linkage(np.sqrt(np.maximum(0, 2 * (1 - corr))), method)
    own = np.diag(cov) if risk in ("equal_weighting", "variance") else np.sqrt(np.diag(cov)) if risk == "standard_deviation" else np.abs(np.asarray(asset_risk))

    def contribution(items):
        v = 1 / own[items]
        v = v / v.sum()
        if risk in ("variance", "equal_weighting"):
            return v @ cov[np.ix_(items, items)] @ v
        if risk == "standard_deviation":
            return math.sqrt(v @ cov[np.ix_(items, items)] @ v)
        return float(v @ own[items])

    clusters = cut_tree(merges, k)
    budget = np.ones(len(clusters))
    sets = [set(c) for c in clusters]
    for step in range(len(clusters) - 1):  # merges from the top
        node = 2 * n - 2 - step
        sides = [set(leaves(merges, int(merges[node - n, s]))) for s in (0, 1)]
        inside = [[i for i, c in enumerate(sets) if c <= s] for s in sides]
        risks = [sum(contribution(sorted(sets[i])) for i in part) for part in inside]
        share = 0.5 if risk == "equal_weighting" or sum(risks) == 0 else 1 - risks[0] / sum(risks)
        for part, x in zip(inside, (share, 1 - share)):
            budget[part] *= x
    w = np.zeros(n)
    for c, b in zip(clusters, budget):
        v = np.ones(len(c)) if risk == "equal_weighting" else 1 / own[c]
        w[c] = b * v / v.sum()
    return w


def critical_line(mu: np.ndarray, cov: np.ndarray, low=None, high=None) -> list[tuple[np.ndarray, float | None]]:
    """The turning points (weights, lambda) of the efficient frontier between bounds, from the largest mean down."""
    n = len(mu)
    mu = np.asarray(mu, float).copy()
    low = np.zeros(n) if low is None else np.broadcast_to(low, n).astype(float)
    high = np.ones(n) if high is None else np.broadcast_to(high, n).astype(float)
    if np.allclose(mu, mu.mean()):
        mu[-1] += 1e-5
    w, free = low.copy(), []
    for k in np.argsort(-mu, kind="stable"):
        room = min(high[k] - low[k], 1 - w.sum())
        w[k] += room
        if w.sum() >= 1 - 1e-12:
            free = [int(k)]
            break
    points: list[tuple[np.ndarray, float | None]] = [(w.copy(), None)]

    def parts(free):
        bound = [k for k in range(n) if k not in free]
        inverse = np.linalg.inv(cov[np.ix_(free, free)])
        one = np.ones(len(free))
        return bound, inverse, one, cov[np.ix_(free, bound)], w[bound]

    def level(free, k, limits):
        bound, inverse, one, cross, wb = parts(free)
        c1, c2 = one @ inverse @ one, inverse @ mu[free]
        c3, c4 = one @ inverse @ mu[free], inverse @ one
        i = free.index(k)
        c = -c1 * c2[i] + c3 * c4[i]
        if c == 0:
            return None, None
        b = limits if not isinstance(limits, tuple) else (limits[1] if c > 0 else limits[0])
        if bound:
            l1, l2 = wb.sum(), inverse @ cross @ wb
            return ((1 - l1 + one @ l2) * c4[i] - c1 * (b + l2[i])) / c, b
        return (c4[i] - c1 * b) / c, b

    last = np.inf
    while True:
        inside = (None, None, None)
        if len(free) > 1:
            for k in free:
                x, b = level(free, k, (low[k], high[k]))
                if x is not None and x < last - 1e-14 and (inside[0] is None or x > inside[0]):
                    inside = (x, k, b)
        outside = (None, None)
        for k in range(n):
            if k not in free:
                x, _ = level([*free, k], k, w[k])
                if x is not None and x < last - 1e-14 and (outside[0] is None or x > outside[0]):
                    outside = (x, k)
        best = max((x for x in (inside[0], outside[0]) if x is not None), default=None)
        final = best is None or best < 0
        if final:
            last = 0.0
        elif best == inside[0]:
            last = inside[0]
            free.remove(inside[1])
            w[inside[1]] = inside[2]
        else:
            last = outside[0]
            free.append(outside[1])
        bound, inverse, one, cross, wb = parts(free)
        g1, g2 = one @ inverse @ mu[free], one @ inverse @ one
        pull = inverse @ cross @ wb if bound else np.zeros(len(free))
        gamma = (-last * g1 + 1 - wb.sum() + one @ pull) / g2 if bound else (-last * g1 + 1) / g2
        w[free] = -pull + gamma * (inverse @ one) + last * (inverse @ mu[free])
        points.append((w.copy(), last))
        if final:
            break
    return [p for p in points if abs(p[0].sum() - 1) < 1e-6 and (p[0] >= low - 1e-9).all() and (p[0] <= high + 1e-9).all()]


def critical_line_best(points, mu, cov, solution: str) -> np.ndarray:
    """max_sharpe by golden section on each segment, or min_volatility."""
    if solution == "min_volatility":
        return min((p[0] for p in points), key=lambda w: w @ cov @ w)
    best, ratio = None, (math.sqrt(5) - 1) / 2
    score = lambda w: w @ mu / math.sqrt(w @ cov @ w)
    for (a, _), (b, _) in zip(points, points[1:]):
        x, y = 0.0, 1.0
        for _ in range(60):
            c, d = y - ratio * (y - x), x + ratio * (y - x)
            x, y = (x, d) if score((1 - c) * a + c * b) > score((1 - d) * a + d * b) else (c, y)
        for t in ((x + y) / 2, 0.0, 1.0):
            w = (1 - t) * a + t * b
            if best is None or score(w) > score(best):
                best = w
    return best if best is not None else points[0][0]


def critical_line_frontier(points, mu, cov, number=100) -> list[tuple[float, float]]:
    out = []
    for (a, _), (b, _) in zip(points, points[1:]):
        for t in np.linspace(0, 1, max(2, number // max(1, len(points) - 1)), endpoint=False):
            w = (1 - t) * a + t * b
            out.append((float(w @ mu), math.sqrt(w @ cov @ w)))
    w = points[-1][0]
    return [*out, (float(w @ mu), math.sqrt(w @ cov @ w))]


def convex_optimum(cov: np.ndarray, mu: np.ndarray | None = None) -> np.ndarray:
    inverse = np.linalg.inv(cov)
    mu = np.ones(len(cov)) if mu is None else mu
    w = inverse @ mu
    return w / (mu @ w)


def best_clusters(corr: np.ndarray, most: int = 10, repeats: int = 10, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Labels and silhouettes of the k-means over correlation distances with the best mean-to-deviation silhouette."""
    rng, x, best = np.random.default_rng(seed), np.sqrt(np.maximum(0, (1 - corr) / 2)), None
    for _ in range(repeats):
        for k in range(2, min(most, len(corr) - 1) + 1):
            label = kmeans(x, k, rng)
            s = silhouettes(x, label)
            q = s.mean() / s.std() if s.std() > 0 else -np.inf
            if best is None or q > best[0]:
                best = (q, label, s)
    return (np.zeros(len(corr), int), np.zeros(len(corr))) if best is None else best[1:]


def optimal_clusters(corr: np.ndarray, repeats: int = 10, seed: int = 0) -> list[list[int]]:
    """Optimal number of clusters: clusters of below-average quality are clustered again while that helps."""
    label, s = best_clusters(corr, repeats=repeats, seed=seed)
    groups = [np.flatnonzero(label == k) for k in np.unique(label)]
    quality = lambda v: v.mean() / v.std() if v.std() > 0 else 0.0
    q = [quality(s[g]) for g in groups]
    weak = [g for g, x in zip(groups, q) if x < np.mean(q)]
    if len(weak) <= 2:
        return [g.tolist() for g in groups]
    items = np.sort(np.concatenate(weak))
    again = [items[g].tolist() for g in optimal_clusters(corr[np.ix_(items, items)], repeats, seed + 1)]
    kept = [g.tolist() for g, x in zip(groups, q) if x >= np.mean(q)]
    joined = np.zeros(len(corr), int)
    for k, g in enumerate(kept + again):
        joined[g] = k
    s2 = silhouettes(np.sqrt(np.maximum(0, (1 - corr) / 2)), joined)
    before = np.mean([quality(s[g]) for g in weak])
    after = np.mean([quality(s2[g]) for g in again])
    return [g.tolist() for g in groups] if after <= before else kept + again


def nested_clusters(cov: np.ndarray, mu: np.ndarray | None = None, most: int | None = None, repeats: int = 10, seed: int = 0) -> np.ndarray:
    """Optimum within each cluster, then across clusters."""
    label, _ = best_clusters(cov_to_corr(cov), most or max(2, len(cov) // 2), repeats, seed)
    inside = np.zeros((len(cov), len(np.unique(label))))
    for j, k in enumerate(np.unique(label)):
        g = np.flatnonzero(label == k)
        inside[g, j] = convex_optimum(cov[np.ix_(g, g)], None if mu is None else mu[g])
    return inside @ convex_optimum(inside.T @ cov @ inside, None if mu is None else inside.T @ mu)


def monte_carlo_selection(mu: np.ndarray, cov: np.ndarray, n: int, simulations: int = 100, bandwidth: float = 0.01, minimum_variance: bool = True, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Weights of the convex and of the nested optimum over simulated moments, a row each."""
    rng, one, two = np.random.default_rng(seed), [], []
    for k in range(simulations):
        x = rng.multivariate_normal(mu, cov, n)
        m, c = x.mean(0), np.cov(x.T)
        if bandwidth > 0:
            c = denoised(c, n / len(mu), bandwidth=bandwidth)
        m = None if minimum_variance else m
        one.append(convex_optimum(c, m))
        two.append(nested_clusters(c, m, len(mu) // 2, repeats=2, seed=seed + k))
    return np.array(one), np.array(two)


def selection_errors(one, two, mu, cov, minimum_variance: bool = True) -> tuple[float, float]:
    true = convex_optimum(cov, None if minimum_variance else mu)
    return tuple(float((w - true).std(0, ddof=1).mean()) for w in (one, two))


def block_matrix(blocks: int, size: int, rho: float, std: np.ndarray | None = None, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """(means, covariance) of a shuffled block-correlation matrix."""
    rng, n = np.random.default_rng(seed), blocks * size
    corr = np.kron(np.eye(blocks), np.full((size, size), rho))
    np.fill_diagonal(corr, 1)
    order = rng.permutation(n)
    corr, std = corr[np.ix_(order, order)], rng.uniform(0.05, 0.2, n) if std is None else std
    return rng.normal(std, std), corr_to_cov(corr, std)


def theory_implied(tree: list[list], corr: np.ndarray, q: float | None = None, bandwidth: float = 0.01) -> np.ndarray:
    """The correlation implied by a hierarchy: each level's groups are linked by single average distances from the leaves up.

    tree: for each asset its codes from leaf to root. Linked groups are at the mean distance of their members.
    """
    n, d = len(corr), np.sqrt(np.maximum(0, (1 - corr) / 2))
    implied = np.zeros((n, n))
    levels = [tuple(str(x) for x in row[1:]) + ("",) for row in tree]
    clusters = [[k] for k in range(n)]
    for depth in range(len(levels[0])):
        parents: dict = {}
        for c in clusters:
            parents.setdefault(levels[c[0]][depth:], []).append(c)
        clusters = []
        for children in parents.values():
            while len(children) > 1:
                pairs = [(d[np.ix_(a, b)].mean(), i, j) for i, a in enumerate(children) for j, b in enumerate(children) if i < j]
                h, i, j = min(pairs)
                a, b = children[i], children[j]
                implied[np.ix_(a, b)], implied[np.ix_(b, a)] = h, h
                children = [c for k, c in enumerate(children) if k not in (i, j)] + [a + b]
            clusters += children
    out = 1 - 2 * implied**2
    np.fill_diagonal(out, 1)
    return cov_to_corr(denoised(out, q, bandwidth=bandwidth)) if q else out


def correlation_distance(a: np.ndarray, b: np.ndarray) -> float:
    return 1 - float(np.trace(a @ b) / (np.linalg.norm(a) * np.linalg.norm(b)))
