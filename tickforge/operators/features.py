"""Rolling features of bars: volatility, spreads, price impact, volume classes, fractional differencing.

Bars are symbol, ts, seq, open, high, low, close, volume, dollar and more; windows are full or null.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickforge.functions.kernels import EwmStd
from tickforge.functions.rolling import change, full, log_return, normal_cdf, ordered
from tickforge.operators.breaks import ols
from tickforge.operators.fold import fold, same_key


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def parkinson_vol(high="high", low="low", window=20, w=None) -> Column:
    r = F.ln(col(high) / col(low))
    return F.sqrt(full(F.avg, r * r / (4 * math.log(2)), w or ordered(), window))


def garman_klass_vol(open="open", high="high", low="low", close="close", window=20, w=None) -> Column:
    r, m = F.ln(col(high) / col(low)), F.ln(col(close) / col(open))
    return F.sqrt(full(F.avg, r * r / 2 - (2 * math.log(2) - 1) * m * m, w or ordered(), window))


def yang_zhang_vol(open="open", high="high", low="low", close="close", window=20, w=None) -> Column:
    """Overnight, open-to-close and Rogers-Satchell parts; the second uses the close over the previous open."""
    w = w or ordered()
    o, h, lo, c = map(col, (open, high, low, close))
    k = 0.34 / (1.34 + (window + 1) / (window - 1))
    night, day = F.ln(o / F.lag(c).over(w)), F.ln(c / F.lag(o).over(w))
    inside = F.ln(h / c) * F.ln(h / o) + F.ln(lo / c) * F.ln(lo / o)
    part = lambda x: full(F.sum, x, w, window) / (window - 1)
    return F.sqrt(part(night * night) + k * part(day * day) + (1 - k) * part(inside))


def with_roll(df: DataFrame, window=20) -> DataFrame:
    """Adds roll_measure and roll_impact (per dollar traded)."""
    w = ordered()
    df = df.withColumn("_d", change(F.col("close"), w)).withColumn("_p", F.lag("_d").over(w))
    last = w.rowsBetween(-(window - 1), 0)
    enough = F.count(F.col("_d") + F.col("_p")).over(last) >= window
    measure = 2 * F.sqrt(F.abs(F.when(enough, F.covar_samp("_d", "_p").over(last))))
    return df.withColumn("roll_measure", measure).withColumn("roll_impact", F.try_divide("roll_measure", "dollar")).drop("_d", "_p")


def with_corwin_schultz(df: DataFrame, window=20) -> DataFrame:
    """Adds corwin_schultz (the spread) and bekker_parkinson (the volatility), both from highs and lows."""
    w = ordered()
    two, den = w.rowsBetween(-1, 0), 3 - 2 * math.sqrt(2)
    r = F.ln(F.col("high") / F.col("low"))
    df = df.withColumn("_r", r * r)
    df = df.withColumn("_two", F.when(F.count("_r").over(two) == 2, F.sum("_r").over(two)))
    df = df.withColumn("_g", F.when(F.count("_r").over(two) == 2, F.pow(F.ln(F.max("high").over(two) / F.min("low").over(two)), 2)))
    df = df.withColumn("_b", full(F.avg, F.col("_two"), w, window))
    alpha = (math.sqrt(2) - 1) * F.sqrt("_b") / den - F.sqrt(F.col("_g") / den)
    alpha = F.when(F.col("_b").isNotNull(), F.greatest(alpha, F.lit(0.0)))
    k2 = math.sqrt(8 / math.pi)
    sigma = (2**-0.5 - 1) * F.sqrt("_b") / (k2 * den) + F.sqrt(F.col("_g") / (k2**2 * den))
    sigma = F.when(F.col("_b").isNotNull(), F.greatest(sigma, F.lit(0.0)))
    return df.withColumns({"corwin_schultz": 2 * (F.exp(alpha) - 1) / (1 + F.exp(alpha)), "bekker_parkinson": sigma}).drop("_r", "_two", "_g", "_b")


def with_lambdas(df: DataFrame, window=20) -> DataFrame:
    """Adds the bar-based kyle_lambda, amihud_lambda and hasbrouck_lambda."""
    w = ordered()
    back = w.rowsBetween(Window.unboundedPreceding, 0)
    df = df.withColumns({"_d": change(F.col("close"), w), "_r": log_return(F.col("close"), w)})
    sign = lambda c: F.last(F.when(F.col(c) != 0, F.signum(c)), ignorenulls=True).over(back)
    df = df.withColumns({"_sd": sign("_d"), "_sr": sign("_r")})
    ratio = lambda a, b: F.try_divide(a, b)
    return df.withColumns({
        "kyle_lambda": full(F.avg, ratio(F.col("_d"), F.col("volume") * F.col("_sd")), w, window),
        "amihud_lambda": full(F.avg, ratio(F.abs("_r"), F.col("dollar")), w, window),
        "hasbrouck_lambda": full(F.avg, ratio(F.col("_r"), F.col("_sr") * F.sqrt("dollar")), w, window),
    }).drop("_d", "_r", "_sd", "_sr")


def with_vpin(df: DataFrame, window=1) -> DataFrame:
    """Adds vpin: the mean of |buys - sells| over the window, per volume of the bar itself."""
    gap = F.abs(2 * F.col("cum_buy_volume") - F.col("volume"))
    return df.withColumn("vpin", F.try_divide(full(F.avg, gap, ordered(), window), F.col("volume")))


def with_bulk_volume(df: DataFrame, window=20) -> DataFrame:
    """Adds bvc_buy_volume: volume times the normal probability of the standardised price change."""
    w = ordered()
    df = df.withColumn("_d", change(F.col("close"), w))
    z = F.try_divide(F.col("_d"), full(F.stddev_samp, F.col("_d"), w, window))
    return df.withColumn("bvc_buy_volume", F.col("volume") * normal_cdf(z)).drop("_d")


def trade_lambdas(ticks: DataFrame, keys: list[str]) -> DataFrame:
    """Per group of signed ticks (price, volume, sign): slope and t value through the origin of three regressions.

    kyle: price change on signed volume; amihud: |log return| on dollars; hasbrouck: |log return| on
    signed root dollars. The t value is the slope over its standard error.
    """
    w = ordered()
    dollars = F.col("price") * F.col("volume")
    t = ticks.withColumns({"_d": change(F.col("price"), w), "_r": F.abs(log_return(F.col("price"), w))})
    t = t.withColumns({"_x1": F.col("volume") * F.col("sign"), "_x2": dollars, "_x3": F.sqrt(dollars) * F.col("sign")}).where("_d is not null and _r is not null")
    out, sums = {}, []
    for k, (name, y) in enumerate((("kyle", "_d"), ("amihud", "_r"), ("hasbrouck", "_r")), 1):
        x, y = F.col(f"_x{k}"), F.col(y)
        sums += [F.sum(x * x).alias(f"xx{k}"), F.sum(x * y).alias(f"xy{k}"), F.sum(y * y).alias(f"yy{k}")]
        beta = F.try_divide(F.col(f"xy{k}"), F.col(f"xx{k}"))
        rest = F.greatest(F.col(f"yy{k}") - beta * F.col(f"xy{k}"), F.lit(0.0))
        out[f"{name}_lambda"] = beta
        out[f"{name}_t"] = F.try_divide(beta, F.sqrt(F.try_divide(rest, (F.col("n") - 1) * F.col(f"xx{k}"))))
    t = t.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), *sums)
    return t.select(*keys, *[v.alias(k) for k, v in out.items()])


def vwap(df: DataFrame, keys: list[str]) -> DataFrame:
    """vwap and avg_tick_size per group of ticks."""
    return df.groupBy(*keys).agg(
        F.try_divide(F.sum(F.col("price") * F.col("volume")), F.sum("volume")).alias("vwap"), F.avg("volume").alias("avg_tick_size")
    )


def ffd_weights(d: float, threshold: float = 1e-5, limit: int = 10_000) -> list[float]:
    """w_0 = 1, w_k = -w_(k-1) (d - k + 1) / k, cut below the threshold; the newest value's weight first."""
    out = [1.0]
    while len(out) < limit:
        w = -out[-1] * (d - len(out) + 1) / len(out)
        if abs(w) < threshold:
            break
        out.append(w)
    return out


def frac_diff_ffd(df: DataFrame, d: float, threshold: float = 1e-5, column="close", out="frac_diff") -> DataFrame:
    """Adds the fixed-width fractional difference; gaps are filled forward, the first width - 1 rows are null."""
    weights, w = ffd_weights(d, threshold), ordered()
    filled = F.last(column, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    width = len(weights)
    df = df.withColumn("_x", filled)
    past = F.collect_list("_x").over(w.rowsBetween(-(width - 1), 0))
    total = F.aggregate(F.zip_with(past, F.array(*map(F.lit, weights[::-1])), lambda x, k: x * k), F.lit(0.0), lambda a, x: a + x)
    return df.withColumn(out, F.when(F.size(past) == width, total)).drop("_x")


def frac_diff(df: DataFrame, d: float, threshold: float = 0.01, column="close", out="frac_diff") -> DataFrame:
    """Adds the expanding-window fractional difference y_t = sum w_k x_(t-k), null for the first rows, whose
    lost weight share is above the threshold."""
    class Expanding:
        def __init__(self):
            self.x, self.rows = np.zeros(0), 0

        def feed(self, key, c):
            x = c[column].astype(float)
            before, self.x = len(self.x), np.concatenate([self.x, x])
            for k in range(before, len(self.x)):
                if np.isnan(self.x[k]) and k:
                    self.x[k] = self.x[k - 1]
            w = [1.0]
            for k in range(1, len(self.x)):
                w.append(-w[-1] * (d - k + 1) / k)
            w = np.array(w)
            y = np.array([w[:k + 1] @ self.x[k::-1] for k in range(before, len(self.x))])
            return {"symbol": same_key(key, len(x)), "ts": c["ts"], "seq": c["seq"], "n": np.arange(before, len(self.x)), out: y}

    folded = fold(df.select("symbol", "ts", "seq", column), "symbol", ["ts", "seq"], Expanding, f"symbol string, ts timestamp_ntz, seq long, n long, {out} double")
    size = folded.groupBy("symbol").agg(F.max("n").alias("last"))

    # A row is skipped while the share of absolute weight that it lacks is above the threshold.
    def skipped(n: int) -> int:
        w = [1.0]
        for k in range(1, n):
            w.append(-w[-1] * (d - k + 1) / k)
        share = np.cumsum(np.abs(w[::-1]))
        return int((share / share[-1] > threshold).sum())

    sizes = {r["symbol"]: skipped(r["last"] + 1) for r in size.collect()}
    first = folded.sparkSession.createDataFrame(list(sizes.items()) or [("", 0)], "symbol string, first long")
    return folded.join(F.broadcast(first), "symbol").withColumn(out, F.when(F.col("n") >= F.col("first"), F.col(out))).drop("n", "first")


def daily_vol(df: DataFrame, lookback: int = 100, column="close") -> DataFrame:
    """symbol, ts, seq, daily_return, daily_vol: the return since the last row over a day older, and its ewm deviation."""
    day = np.timedelta64(1, "D")

    class Daily:
        def __init__(self):
            self.ts, self.p, self.std = np.zeros(0, "datetime64[us]"), np.zeros(0), EwmStd(lookback)

        def feed(self, key, c):
            ts, p = c["ts"].astype("datetime64[us]"), c[column].astype(float)
            all_ts, all_p = np.concatenate([self.ts, ts]), np.concatenate([self.p, p])
            at = np.searchsorted(all_ts, ts - day, "left") - 1  # strictly before
            r = np.where(at >= 0, p / np.where(at >= 0, all_p[at], 1) - 1, np.nan)
            vol = np.array([np.nan if np.isnan(x) else self.std.push(x) for x in r])
            keep = max(0, int(at[-1])) if len(at) else 0  # what a later row can still look up
            self.ts, self.p = all_ts[keep:], all_p[keep:]
            some = ~np.isnan(r)
            return {"symbol": same_key(key, int(some.sum())), "ts": ts[some], "seq": c["seq"][some], "daily_return": r[some], "daily_vol": vol[some]}

    return fold(df.select("symbol", "ts", "seq", column), "symbol", ["ts", "seq"], Daily, "symbol string, ts timestamp_ntz, seq long, daily_return double, daily_vol double")


def bar_features(ticks: DataFrame, ends: DataFrame, volume_letters: dict | None = None, return_letters: dict | None = None) -> DataFrame:
    """symbol, bar_id and the microstructural features of each bar that ends at tick number ``tick_num`` of ``ends``.

    ticks: signed, with tick_num from 1. A tick belongs to the first bar that ends at or after it; later
    ticks are left out. Means, lambdas and t values come from one aggregation; messages of tick signs (and of
    volumes and log returns, if letters are given) are encoded per bar and their four entropies added.
    """
    from tickforge.operators.entropy import encode, encode_signs, entropies

    marks = ends.select("symbol", F.col("tick_num").alias("_at"), F.lit(1).alias("_k"), F.col("bar_id").alias("_bar"))
    rows = ticks.withColumns({"_at": F.col("tick_num"), "_k": F.lit(0), "_bar": F.lit(None).cast("long")})
    blank = [F.col(c) if c in marks.columns else F.lit(None).cast(t).alias(c) for c, t in rows.dtypes]
    # Backwards: a frame to its unbounded end is evaluated anew for each row.
    ahead = Window.partitionBy("symbol").orderBy(F.desc("_at"), F.desc("_k")).rowsBetween(Window.unboundedPreceding, 0)
    t = rows.unionByName(marks.select(*blank)).withColumn("bar_id", F.last("_bar", ignorenulls=True).over(ahead)).where("_k = 0 and bar_id is not null").drop("_at", "_k", "_bar")
    w = ordered()
    t = t.withColumns({"_r": log_return(F.col("price"), w)})
    in_order = lambda c: F.transform(F.array_sort(F.collect_list(F.struct("ts", "seq", F.col(c).alias("x")))), lambda s: s["x"])
    base = t.groupBy("symbol", "bar_id").agg(
        F.max("ts").alias("date_time"), F.avg("volume").alias("avg_tick_size"), F.sum("sign").alias("tick_rule_sum"),
        F.try_divide(F.sum(F.col("price") * F.col("volume")), F.sum("volume")).alias("vwap"),
        in_order("sign").alias("_signs"), in_order("volume").alias("_volumes"), in_order("_r").alias("_returns"),
    )
    out = base.join(trade_lambdas(t, ["symbol", "bar_id"]), ["symbol", "bar_id"], "left")
    messages = {"tick_rule": encode_signs(F.col("_signs"))}
    if volume_letters:
        messages["volume"] = encode(F.col("_volumes"), volume_letters)
    if return_letters:
        messages["pct"] = encode(F.filter("_returns", lambda x: x.isNotNull()), return_letters)
    for name, message in messages.items():
        out = entropies(out.withColumn("_m", message), "_m")
        out = out.withColumnsRenamed({k: f"{k}_entropy_{name}" for k in ("shannon", "plug_in", "lempel_ziv", "konto")}).drop("_m")
    return out.drop("_signs", "_volumes", "_returns")


def adf(y: np.ndarray) -> tuple[float, int]:
    """(t value of the level, rows) of the Dickey-Fuller regression with a constant and one lag."""
    d = np.diff(y)
    if len(d) < 6:
        return float("nan"), max(0, len(d) - 1)
    x = np.stack([y[1:-1], d[:-1], np.ones(len(d) - 1)], 1)
    beta, cov = ols(x, d[1:])
    return float(beta[0] / np.sqrt(cov[0, 0])) if cov[0, 0] > 0 else float("nan"), len(x)


def least_difference(df: DataFrame, threshold: float = 0.01, column: str = "close") -> DataFrame:
    """symbol, d, adf, n, corr for d = 0, 0.1, ..., 1: the daily log closes differenced, their unit-root statistic, and
    their correlation with the undifferenced series."""
    daily = df.where(F.col(column) > 0).groupBy("symbol", F.to_date("ts").alias("day")).agg(F.log(F.max_by(column, F.struct("ts", "seq"))).alias("x"))

    def run(key, pdf):
        import pandas as pd

        x, out = pdf.sort_values("day")["x"].to_numpy(float), []
        for k in range(11):
            w = np.array(ffd_weights(k / 10, threshold))
            if len(x) >= len(w) + 6:
                y = np.convolve(x, w, "valid")
                t, n = adf(y)
                c = np.corrcoef(y, x[len(w) - 1:])[0, 1] if y.std() > 0 else np.nan
                out.append((key[0], k / 10, t, n, c))
        return pd.DataFrame(out, columns=["symbol", "d", "adf", "n", "corr"])

    return daily.groupBy("symbol").applyInPandas(run, "symbol string, d double, adf double, n long, corr double")
