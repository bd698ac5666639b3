"""Bars from ticks: tick, volume, dollar, time, imbalance and run bars; futures rolls and the ETF trick.

A bar's trailing partial is never emitted. Tick bars of a constant size and time bars are closed forms
of ranks and times; those whose counters are reset with the overshoot discarded are ordered folds.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tickforge.functions.kernels import ewma_last
from tickforge.functions.rolling import ordered, tick_sign
from tickforge.operators.fold import fold, same_key

BARS = (
    "symbol string, bar_id long, date_time timestamp_ntz, tick_num long, open double, high double, low double, close double, "
    "volume double, cum_buy_volume double, cum_ticks long, cum_dollar_value double"
)
METRICS = ("ticks", "volume", "dollar")


def _check(metric: str) -> None:
    if metric not in METRICS:
        raise ValueError(f"metric is one of {', '.join(METRICS)}, not {metric}")


def signed(ticks: DataFrame) -> DataFrame:
    return ticks.withColumn("sign", tick_sign(F.col("price"), ordered()))


def summarised(ticks: DataFrame, keys: list[str]) -> DataFrame:
    """One bar per symbol and ``keys`` of signed, numbered ticks (tick_num from 1)."""
    at = F.struct("ts", "seq")
    return ticks.groupBy("symbol", *keys).agg(
        F.max("ts").alias("date_time"), F.max("tick_num").alias("tick_num"),
        F.min_by("price", at).alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", at).alias("close"),
        F.sum("volume").alias("volume"), F.sum(F.when(F.col("sign") > 0, F.col("volume")).otherwise(0.0)).alias("cum_buy_volume"),
        F.count(F.lit(1)).alias("cum_ticks"), F.sum(F.col("price") * F.col("volume")).alias("cum_dollar_value"),
    )


def tick_bars(ticks: DataFrame, threshold: float) -> DataFrame:
    """A bar per ceil(threshold) ticks, by rank alone."""
    size = int(np.ceil(threshold))
    t = signed(ticks).withColumn("tick_num", F.row_number().over(ordered()).cast("long"))
    t = t.withColumn("bar_id", F.floor((F.col("tick_num") - 1) / size))
    return summarised(t, ["bar_id"]).where(F.col("cum_ticks") == size)


def time_bars(ticks: DataFrame, resolution: str = "D", units: int = 1) -> DataFrame:
    """A bar per time slot with ticks, stamped at the slot's right edge; a symbol's last slot is left out."""
    seconds = {"D": 86_400, "H": 3_600, "MIN": 60, "S": 1}
    if resolution not in seconds:
        raise ValueError(f"resolution is one of {', '.join(seconds)}, not {resolution}")
    step = seconds[resolution] * units
    slot = F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / (step * 1_000_000))
    t = signed(ticks).withColumns({"tick_num": F.row_number().over(ordered()).cast("long"), "slot": slot})
    bars = summarised(t, ["slot"])
    bars = bars.withColumn("last", F.max("slot").over(Window.partitionBy("symbol"))).where("slot < last")
    number = F.row_number().over(Window.partitionBy("symbol").orderBy("slot")).cast("long") - 1
    return bars.withColumns({"bar_id": number, "date_time": F.timestamp_seconds((F.col("slot") + 1) * step).cast("timestamp_ntz")}).drop("slot", "last")


class _Bars:
    """Cuts a symbol's stream of ticks into bars; ``end(m)`` of a subclass says where the open one ends."""

    def __init__(self):
        self.held: dict[str, np.ndarray] = {}
        self.done, self.number = 0, 0

    def feed(self, key, c):
        c = {k: v for k, v in c.items() if k != "symbol"}
        c = {k: np.concatenate([self.held[k], v]) if self.held else v for k, v in c.items()}
        out, at, n = {k: [] for k in ("date_time", "tick_num", "open", "high", "low", "close", "volume", "cum_buy_volume", "cum_ticks", "cum_dollar_value")}, 0, len(c["price"])
        while at < n and (end := self.find(c, at, n)) is not None:
            p, v, s = c["price"][at:end], c["volume"][at:end], c["sign"][at:end]
            for k, x in zip(out, (c["ts"][end - 1], self.done + end - at, p[0], p.max(), p.min(), p[-1], v.sum(), v[s > 0].sum(), end - at, (p * v).sum())):
                out[k].append(x)
            self.done += end - at
            at = end
        self.held = {k: v[at:] for k, v in c.items()}
        made = len(out["open"])
        out["date_time"] = np.array(out["date_time"], "datetime64[us]")
        first, self.number = self.number, self.number + made
        return {"symbol": same_key(key, made), "bar_id": np.arange(first, self.number), **{k: np.array(v) for k, v in out.items()}}


class _Standard(_Bars):
    def __init__(self, metric, threshold):
        super().__init__()
        self.metric, self.threshold, self.seen = metric, threshold, 64

    def find(self, c, at, n):
        """The first place where the metric summed from ``at`` reaches the threshold of its tick."""
        size = self.seen
        while True:
            part = slice(at, min(n, at + size))
            m = {"ticks": lambda: np.ones(part.stop - at), "volume": lambda: c["volume"][part], "dollar": lambda: c["price"][part] * c["volume"][part]}[self.metric]()
            t = self.threshold
            if isinstance(t, tuple):  # the last step at or before the tick
                t = t[1][np.searchsorted(t[0], c["ts"][part].astype("datetime64[us]"), "right")]
            hit = np.flatnonzero(np.cumsum(m) >= t)
            if len(hit):
                self.seen = max(16, 2 * int(hit[0]))
                return at + int(hit[0]) + 1
            if part.stop == n:
                return None
            size *= 4


def standard_bars(ticks: DataFrame, metric: str, threshold) -> DataFrame:
    """Bars that end when the metric reaches ``threshold``: a number, or a DataFrame of steps (ts, threshold)."""
    _check(metric)
    if isinstance(threshold, DataFrame):  # a step function, whose few steps go along with the fold
        steps = threshold.select(F.col("ts").cast("timestamp_ntz").alias("ts"), F.col("threshold").cast("double").alias("threshold")).orderBy("ts").toPandas()
        threshold = (steps["ts"].to_numpy("datetime64[us]"), np.r_[np.inf, steps["threshold"].to_numpy()])
    elif metric == "ticks":
        return tick_bars(ticks, threshold)
    t = signed(ticks).select("symbol", "ts", "seq", "price", "volume", "sign")
    return fold(t, "symbol", ["ts", "seq"], lambda: _Standard(metric, threshold), BARS)


def _imbalance(c, part, metric):
    x = c["sign"][part]
    return x if metric == "ticks" else x * c["volume"][part] if metric == "volume" else x * c["volume"][part] * c["price"][part]


class _Information(_Bars):
    def __init__(self, metric, expected_ticks, window, previous, limits):
        super().__init__()
        self.metric, self.ticks, self.window, self.previous, self.limits = metric, float(expected_ticks), window, previous, limits
        self.lengths: list[int] = []

    def next_length(self, n):
        self.lengths.append(n)
        if self.previous:  # exponential; else constant
            self.lengths = self.lengths[-self.previous:]
            self.ticks = ewma_last(self.lengths, self.previous)
            if self.limits:
                self.ticks = min(max(self.ticks, self.limits[0]), self.limits[1])

    def estimate(self, history, length_test=True):
        if not history or length_test and len(history) < self.ticks:
            return np.nan
        m = min(len(history), self.window)
        return ewma_last(history[-m:], m)

    def keep(self, history):
        """All that estimates ever read is the last window and whether there are enough."""
        most = int(max(self.window, self.ticks, (self.limits or [0, 0])[1] or 0)) + 1
        if len(history) > 4 * most:
            del history[:-2 * most]


class _Imbalance(_Information):
    def __init__(self, *args):
        super().__init__(*args)
        self.history, self.expected, self.theta, self.read = [], np.nan, 0.0, 0

    def find(self, c, at, n):
        k = at + self.read
        x = _imbalance(c, slice(k, n), self.metric)
        while k < n:
            i = k - at - self.read
            if np.isnan(self.expected):  # warm-up: one by one
                self.theta += x[i]
                self.history.append(float(x[i]))
                self.expected = self.estimate(self.history)
                k += 1
                hit = abs(self.theta) > self.ticks * abs(self.expected)
            else:
                sums = self.theta + np.cumsum(x[i:])
                over = np.flatnonzero(np.abs(sums) > self.ticks * abs(self.expected))
                m = int(over[0]) + 1 if len(over) else len(sums)
                self.history += x[i:i + m].tolist()
                self.theta, hit = float(sums[m - 1]), bool(len(over))
                k += m
            if hit:
                self.next_length(k - at)
                self.expected, self.theta, self.read = self.estimate(self.history), 0.0, 0
                self.keep(self.history)
                return k
        self.read = n - at
        self.keep(self.history)
        return None


class _Run(_Information):
    def __init__(self, *args):
        super().__init__(*args)
        self.sides = {1: [], -1: []}
        self.expected = {1: np.nan, -1: np.nan}
        self.buys: list[float] = []
        self.share, self.theta, self.n_buy, self.read = np.nan, {1: 0.0, -1: 0.0}, 0, 0

    def find(self, c, at, n):
        k = at + self.read
        x = _imbalance(c, slice(k, n), self.metric)
        begin = k
        while k < n:
            if np.isnan(self.expected[1]) or np.isnan(self.expected[-1]):
                v = float(x[k - begin])
                if v:
                    side = 1 if v > 0 else -1
                    self.sides[side].append(abs(v))
                    self.theta[side] += abs(v)
                    self.n_buy += side > 0
                for side in (1, -1):
                    self.expected[side] = self.estimate(self.sides[side])
                k += 1
                if not (np.isnan(self.expected[1]) or np.isnan(self.expected[-1])) and np.isnan(self.share):
                    self.share = self.n_buy / (k - at)
                level = self.level()
                hit = max(self.theta.values()) > level
            else:
                rest, level = x[k - begin:], self.level()
                up = self.theta[1] + np.cumsum(np.where(rest > 0, rest, 0))
                down = self.theta[-1] + np.cumsum(np.where(rest < 0, -rest, 0))
                over = np.flatnonzero(np.maximum(up, down) > level)
                m = int(over[0]) + 1 if len(over) else len(rest)
                self.sides[1] += rest[:m][rest[:m] > 0].tolist()
                self.sides[-1] += (-rest[:m][rest[:m] < 0]).tolist()
                self.n_buy += int((rest[:m] > 0).sum())
                self.theta = {1: float(up[m - 1]), -1: float(down[m - 1])}
                k, hit = k + m, bool(len(over))
            if hit:
                self.buys = [*self.buys, self.n_buy / (k - at)][-max(1, self.previous or self.share_window):]
                self.next_length(k - at)
                self.share = ewma_last(self.buys, self.previous or self.share_window)
                for side in (1, -1):
                    self.expected[side] = self.estimate(self.sides[side], length_test=False)
                    self.keep(self.sides[side])
                self.theta, self.n_buy, self.read = {1: 0.0, -1: 0.0}, 0, 0
                return k
        self.read = n - at
        return None

    share_window = 3

    def level(self):
        both = self.expected[1] * self.share, self.expected[-1] * (1 - self.share)
        return np.nan if np.isnan(both).any() else self.ticks * max(both)


def imbalance_bars(ticks: DataFrame, metric: str, kind: str = "ema", num_prev_bars: int = 3, expected_imbalance_window: int = 10_000,
                   exp_num_ticks_init: int = 20_000, exp_num_ticks_constraints: list[float] | None = None) -> DataFrame:
    """Bars that end when the imbalance exceeds what is expected; kind ``ema`` re-estimates the bar length, ``const`` keeps it."""
    _check(metric)
    args = (metric, exp_num_ticks_init, expected_imbalance_window, num_prev_bars if kind == "ema" else 0, exp_num_ticks_constraints)
    return fold(signed(ticks).select("symbol", "ts", "seq", "price", "volume", "sign"), "symbol", ["ts", "seq"], lambda: _Imbalance(*args), BARS)


def run_bars(ticks: DataFrame, metric: str, kind: str = "ema", num_prev_bars: int = 3, expected_imbalance_window: int = 10_000,
             exp_num_ticks_init: int = 20_000, exp_num_ticks_constraints: list[float] | None = None) -> DataFrame:
    """Bars that end when the larger of the buying and selling sums exceeds what is expected of it."""
    _check(metric)
    args = (metric, exp_num_ticks_init, expected_imbalance_window, num_prev_bars if kind == "ema" else 0, exp_num_ticks_constraints)

    def make():
        run = _Run(*args)
        run.share_window = num_prev_bars
        return run

    return fold(signed(ticks).select("symbol", "ts", "seq", "price", "volume", "sign"), "symbol", ["ts", "seq"], make, BARS)


def futures_roll(data: DataFrame, method: str = "absolute", backward: bool = False) -> DataFrame:
    """ts, gap of rows (ts, security, current_security, open, close): the running sum (absolute) or product (relative) of roll gaps.

    A roll is the first row of a contract among those in force; its gap compares its open with the close before.
    """
    if method not in ("absolute", "relative"):
        raise ValueError("method is absolute or relative")
    w = Window.orderBy("ts")  # one instrument's days
    d = data.where("security = current_security")
    first = (F.row_number().over(Window.partitionBy("security").orderBy("ts")) == 1) & F.lag("close").over(w).isNotNull()
    running = w.rowsBetween(Window.unboundedPreceding, 0)
    if method == "absolute":
        gap = F.sum(F.when(F.col("first"), F.col("open") - F.col("before")).otherwise(0.0)).over(running)
    else:
        gap = F.exp(F.sum(F.when(F.col("first"), F.ln(F.col("open") / F.col("before"))).otherwise(0.0)).over(running))
    d = d.withColumns({"first": first, "before": F.lag("close").over(w)}).withColumn("gap", gap)
    if backward:
        last = F.last("gap").over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
        d = d.withColumn("gap", F.col("gap") - last if method == "absolute" else F.col("gap") / last)
    return d.select("ts", "gap")
