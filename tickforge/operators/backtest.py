"""Statistics of positions and returns, and haircuts for many trials."""

from __future__ import annotations

import math
from statistics import NormalDist

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

N, EULER = NormalDist(), 0.5772156649015329


def flips_and_flattenings(positions: DataFrame) -> DataFrame:
    """symbol, ts of positions (symbol, ts, position): where the sign turns or the position closes, and the last row if open."""
    w = Window.partitionBy("symbol").orderBy("ts")
    p = positions.withColumns({"_b": F.lag("position").over(w), "_n": F.lead("position").over(w)})
    flip = F.col("position") * F.col("_b") < 0
    flat = (F.col("position") == 0) & (F.col("_b") != 0)
    last = F.col("_n").isNull() & (F.col("position") != 0)
    return p.where(flip | flat | last).select("symbol", "ts")


def average_holding_period(positions: DataFrame) -> DataFrame:
    """symbol, days: the mean time from one change of a position to the next, while it is not zero.

    Null if the last position is open, or none was ever held.
    """
    w = Window.partitionBy("symbol").orderBy("ts")
    p = positions.select("symbol", "ts", "position").withColumns({"_before": F.lag("position").over(w), "_first": F.row_number().over(w) == 1, "_next": F.lead("ts").over(w)})
    changes = p.where(F.col("_first") | ~F.col("position").eqNullSafe(F.col("_before")) | F.col("_next").isNull())
    changes = changes.withColumn("_until", F.lead("ts").over(w))
    days = (F.unix_micros(F.col("_until").cast("timestamp")) - F.unix_micros(F.col("ts").cast("timestamp"))) / 86_400_000_000.0
    new = F.col("_first") | ~F.col("position").eqNullSafe(F.col("_before"))
    # The last row closes the span before it; as a row that changed nothing it begins none.
    held = F.avg(F.when(new & (F.col("position") != 0) & F.col("_until").isNotNull(), days))
    last = F.max(F.when(F.col("_next").isNull(), F.col("position")))
    return changes.groupBy("symbol").agg(held.alias("_held"), last.alias("_last")).select("symbol", F.when(F.col("_last") == 0, F.col("_held")).alias("days"))


def weighted_holding_period(positions: DataFrame) -> DataFrame:
    """symbol, days: the size-weighted mean time between opening and closing, null if nothing closed.

    Entry times average in as positions grow; that is an ordered fold over the changes.
    """
    from tickforge.operators.fold import fold, same_key

    class Holding:
        def __init__(self):
            self.entry, self.before, self.time, self.weight, self.origin, self.at = 0.0, None, 0.0, 0.0, None, 0.0

        def feed(self, key, c):
            for ts, x in zip(c["ts"].astype("datetime64[us]"), c["position"].astype(float).tolist()):
                self.origin = ts if self.origin is None else self.origin
                now = (ts - self.origin) / np.timedelta64(1, "D")
                if self.before is not None:
                    d = x - self.before
                    if d * self.before >= 0:  # opened or grown
                        if x != 0:
                            self.entry = (self.entry * self.before + now * d) / x
                    elif x * self.before < 0:  # turned
                        self.time += (now - self.entry) * abs(self.before)
                        self.weight += abs(self.before)
                        self.entry = now
                    else:  # reduced
                        self.time += (now - self.entry) * abs(d)
                        self.weight += abs(d)
                self.before = x

        def end(self, key):
            return {"symbol": same_key(key, 1), "days": np.array([self.time / self.weight if self.weight else np.nan])}

    return fold(positions.select("symbol", "ts", "position"), "symbol", ["ts"], Holding, "symbol string, days double")


def drawdowns(returns: DataFrame, dollars: bool = False, column="value") -> DataFrame:
    """symbol, ts, drawdown, years_under_water: per high-water mark that is followed by a fall. ``column`` is the wealth curve.

    The time under water runs to the next such mark, in years of 365.25 days.
    """
    w = Window.partitionBy("symbol").orderBy("ts")
    r = returns.withColumn("_top", F.max(column).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    g = r.groupBy("symbol", "_top").agg(F.min(column).alias("_low"), F.min("ts").alias("ts")).where("_low < _top")
    depth = F.col("_top") - F.col("_low") if dollars else 1 - F.col("_low") / F.col("_top")
    years = (F.unix_micros(F.lead("ts").over(w).cast("timestamp")) - F.unix_micros(F.col("ts").cast("timestamp"))) / (86_400e6 * 365.25)
    return g.select("symbol", "ts", depth.alias("drawdown"), years.alias("years_under_water"))


def ratios(returns: DataFrame, entries_per_year: int = 252, risk_free: float = 0.0, benchmark: float = 0.0, column="ret") -> DataFrame:
    """symbol, n, sharpe, information, skewness, kurtosis, from one aggregation; rates are per period."""
    x = F.col(column)
    s = returns.groupBy("symbol").agg(F.count(x).alias("n"), F.avg(x).alias("m"), F.stddev_samp(x).alias("s"), F.skewness(x).alias("skewness"), (F.kurtosis(x) + 3).alias("kurtosis"))
    root = math.sqrt(entries_per_year)
    return s.select(
        "symbol", "n", (F.try_divide(F.col("m") - risk_free, F.col("s")) * root).alias("sharpe"),
        (F.try_divide(F.col("m") - benchmark, F.col("s")) * root).alias("information"), "skewness", "kurtosis",
    )


def probabilistic_sharpe(observed: float, benchmark: float, n: int, skewness: float = 0.0, kurtosis: float = 3.0) -> float | None:
    """The probability that the true ratio is above the benchmark; None where it is not defined."""
    low = 1 - skewness * observed + (kurtosis - 1) / 4 * observed**2
    if n < 2 or low <= 0 or math.isnan(low):
        return None
    return N.cdf((observed - benchmark) * math.sqrt(n - 1) / math.sqrt(low))


def expected_maximum(spread: float, trials: int) -> float:
    """The expected largest of ``trials`` ratios of mean 0 and the given deviation."""
    return spread * ((1 - EULER) * N.inv_cdf(1 - 1 / trials) + EULER * N.inv_cdf(1 - 1 / (trials * math.e)))


def deflated_sharpe(observed: float, estimates: list[float], n: int, skewness=0.0, kurtosis=3.0, parameters=False, benchmark_only=False) -> float | None:
    """The probabilistic ratio against the best of many trials. estimates: their ratios, or (deviation, number) if parameters."""
    spread, trials = estimates if parameters else (float(np.std(estimates)), len(estimates))
    level = expected_maximum(spread, trials)
    return level if benchmark_only else probabilistic_sharpe(observed, level, n, skewness, kurtosis)


def minimum_track_record(observed: float, benchmark: float, skewness=0.0, kurtosis=3.0, alpha=0.05) -> float:
    return 1 + (1 - skewness * observed + (kurtosis - 1) / 4 * observed**2) * (N.inv_cdf(1 - alpha) / (observed - benchmark)) ** 2


def _hhi(total, square, n):
    return F.when(n > 2, (F.try_divide(square, total * total) - 1 / n) / (1 - 1 / n))


def bets_concentration(returns: DataFrame, unit: str = "month", column="ret") -> DataFrame:
    """symbol, all_bets, positive, negative, in_time: Herfindahl indices of returns (all, those >= 0, those < 0) and of the
    counts per calendar unit, empty units included; null for two bets or fewer."""
    x = F.col(column)

    def part(cond, name):
        y = F.when(cond, x)
        return [F.sum(y).alias(f"t_{name}"), F.sum(y * y).alias(f"q_{name}"), F.count(y).alias(f"n_{name}")]

    s = returns.groupBy("symbol").agg(*part(F.lit(True), "a"), *part(x >= 0, "p"), *part(x < 0, "m"))
    c = returns.groupBy("symbol", F.date_trunc(unit, "ts").alias("u")).agg(F.count(x).alias("n"))
    months = F.months_between(F.max("u"), F.min("u")) if unit == "month" else F.datediff(F.max("u"), F.min("u"))
    c = c.groupBy("symbol").agg(F.sum("n").alias("t"), F.sum(F.col("n") * F.col("n")).alias("q"), (F.round(months) + 1).alias("k"))
    return s.join(c, "symbol").select(
        "symbol", *[_hhi(F.col(f"t_{k}"), F.col(f"q_{k}"), F.col(f"n_{k}")).alias(name) for k, name in (("a", "all_bets"), ("p", "positive"), ("m", "negative"))],
        _hhi(F.col("t"), F.col("q"), F.col("k")).alias("in_time"),
    )


#: Mean correlation -> (number of tests, share of true nulls, mean of the alternatives).
TRIALS = {0.0: (1295, 0.39660, 0.0054995), 0.2: (1377, 0.44589, 0.0055508), 0.4: (1476, 0.48604, 0.0055413), 0.6: (1773, 0.59902, 0.0055512), 0.8: (3109, 0.83901, 0.0055956)}


def trial_parameters(rho: float) -> tuple[float, float, float]:
    """Interpolated between the levels of TRIALS; outside [0, 1) the level 0.2 holds."""
    if not 0 <= rho < 1:
        return TRIALS[0.2]
    levels = sorted(TRIALS)
    k = min(int(rho / 0.2), 3)
    share = (rho - levels[k]) / 0.2
    return tuple(a + share * (b - a) for a, b in zip(TRIALS[levels[k]], TRIALS[levels[k + 1]]))


def simulated_t(rho: float, trials: int, null_share: float, mean: float, simulations: int, volatility=0.15, n=240, seed=0) -> np.ndarray:
    """t ratios of ``trials`` strategies in each simulation, with a common shock of correlation rho."""
    rng = np.random.default_rng(seed)
    sigma = volatility / math.sqrt(12)
    out = np.zeros((simulations, trials))
    for k in range(simulations):
        shock = rng.standard_normal((n, 1)) * math.sqrt(rho) + rng.standard_normal((n, trials)) * math.sqrt(1 - rho)
        shock = (shock - shock.mean(0)) * sigma
        mu = np.where(rng.uniform(size=trials) > null_share, rng.exponential(mean, trials), 0.0)
        r = shock + mu + rng.standard_normal(trials) * sigma / math.sqrt(n)
        out[k] = np.abs(r.mean(0) / r.std(0)) * math.sqrt(n)
    return out


def t_cdf(t: float, df: float) -> float:
    """Student's distribution function, by the incomplete beta function's continued fraction."""
    x = df / (df + t * t)
    a, b = df / 2, 0.5

    def fraction(a, b, x):
        c, d = 1.0, 1 - (a + b) * x / (a + 1)
        d = 1 / (d or 1e-300)
        h = d
        for m in range(1, 500):
            for up in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
                d = 1 / ((1 + up * d) or 1e-300)
                c = (1 + up / c) or 1e-300
                h *= d * c
            if abs(d * c - 1) < 1e-15:
                break
        return h

    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) if 0 < x < 1 else 0.0
    if x >= 1:
        return 0.5
    inside = front * fraction(a, b, x) / a if x < (a + 1) / (a + b + 2) else 1 - front * fraction(b, a, 1 - x) / b
    return 1 - inside / 2 if t > 0 else inside / 2


def t_quantile(p: float, df: float) -> float:
    low, high = -1e3, 1e3
    for _ in range(200):
        middle = (low + high) / 2
        low, high = (middle, high) if t_cdf(middle, df) < p else (low, middle)
    return (low + high) / 2


def haircut(frequency: str, n: int, sharpe: float, annualised: bool, adjusted: bool, rho_a: float, tests: int, rho: float, simulations: int = 2000, seed: int = 0) -> dict[str, tuple[float, float, float]]:
    """method -> (adjusted p, haircut ratio, haircut in %), for Bonferroni, Holm, BHY and their mean."""
    year = {"D": 360, "W": 52, "M": 12, "Q": 4, "A": 1}[frequency]
    sr = sharpe if annualised else sharpe * math.sqrt(year)
    if not adjusted and rho_a:
        sr *= (1 + 2 * rho_a / (1 - rho_a) * (1 - (1 - rho_a**year) / (year * (1 - rho_a)))) ** -0.5
    months = n * 12 / year
    t = sr / math.sqrt(12) * math.sqrt(months)
    single = 2 * (1 - t_cdf(t, months - 1))
    found, p0, mean = trial_parameters(rho)
    ts = simulated_t(rho, math.floor(found) + 1, p0, mean, simulations, seed=seed)
    rng = np.random.default_rng(seed + 1)
    holm, bhy = [], []
    for row in ts:
        other = np.sort([2 * (1 - N.cdf(x)) for x in rng.choice(row, min(tests, len(row)), replace=False)])
        p = np.sort(np.append(other, single))
        at, m = int(np.searchsorted(p, single)), len(p)
        holm.append(min(1.0, float(np.maximum.accumulate((m - np.arange(m)) * p)[at])))
        c = (1 / np.arange(1, m + 1)).sum()
        back = np.minimum.accumulate((m * c / np.arange(m, 0, -1.0)) * p[::-1])[::-1]
        bhy.append(min(1.0, float(back[at])))
    ps = {"bonferroni": min(1.0, tests * single), "holm": float(np.median(holm)), "bhy": float(np.median(bhy))}
    ps["average"] = sum(ps.values()) / 3

    def cut(p):
        z = t_quantile(1 - p / 2, months - 1)
        s = z / math.sqrt(months) * math.sqrt(12)
        return p, s, (sr - s) / sr * 100

    return {k: cut(p) for k, p in ps.items()}


def profit_hurdle(tests: int, n: int, alpha: float, volatility: float, rho: float, simulations: int = 2000, seed: int = 0) -> dict[str, float]:
    """The least monthly mean return, in %, that is significant: alone, and under each correction and their mean."""
    sigma = volatility / math.sqrt(12)
    found, p0, mean = trial_parameters(rho)
    ts = simulated_t(rho, math.floor(found) + 1, p0, mean, simulations, n=n, seed=seed)
    rng = np.random.default_rng(seed + 1)
    single = N.inv_cdf(1 - alpha / 2)
    bonferroni = N.inv_cdf(1 - alpha / (2 * tests))
    holm, bhy = [], []
    for row in ts:
        p = np.sort([2 * (1 - N.cdf(x)) for x in rng.choice(row, min(tests, len(row)), replace=False)])
        m = len(p)
        fail = np.flatnonzero(p > alpha / (m - np.arange(m)))
        holm.append(N.inv_cdf(1 - alpha / (m - (int(fail[0]) if len(fail) else m - 1)) / 2))
        c = (1 / np.arange(1, m + 1)).sum()
        good = np.flatnonzero(p <= np.arange(1, m + 1) / (m * c) * alpha)
        bhy.append(N.inv_cdf(1 - max(1, (int(good[-1]) + 1 if len(good) else 1)) / (m * c) * alpha / 2))
    levels = {"independent": single, "bonferroni": bonferroni, "holm": float(np.median(holm)), "bhy": float(np.median(bhy))}
    out = {k: v * sigma / math.sqrt(n) * 100 for k, v in levels.items()}
    out["average"] = (out["bonferroni"] + out["holm"] + out["bhy"]) / 3
    return out
