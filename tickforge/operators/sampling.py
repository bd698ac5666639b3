"""Concurrency, uniqueness, sample weights, bootstraps and purged folds of label intervals (symbol, label_id, t0, t1)."""

from __future__ import annotations

from itertools import combinations
from math import comb

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tickforge.functions.prefix import running_last, running_sum
from tickforge.functions.rolling import log_return, ordered


def _closed(labels: DataFrame, close: DataFrame) -> DataFrame:
    last = close.groupBy("symbol").agg(F.max("ts").alias("_end"))
    return labels.join(last, "symbol").withColumn("t1", F.coalesce("t1", "_end")).drop("_end")


def concurrency(close: DataFrame, labels: DataFrame, slot: int | None = None) -> DataFrame:
    """symbol, ts, n: how many labels are open at each row, ends included. A sweep: +1 at starts, -1 after ends.

    slot: here and below, seconds of the time slots in which a symbol is cut when one symbol may hold
    much of the data; by default a symbol is one window.
    """
    e = _closed(labels, close)
    at = lambda c, kind, step: e.select("symbol", F.col(c).alias("ts"), F.lit(kind).alias("k"), F.lit(step).alias("s"))
    rows = close.select("symbol", "ts", F.lit(1).alias("k"), F.lit(0).alias("s")).distinct()
    both = at("t0", 0, 1).unionByName(rows).unionByName(at("t1", 2, -1))
    return running_sum(both, ["symbol"], "ts", ["k"], {"n": "s"}, slot).where("k = 1").select("symbol", "ts", "n")


def _between(labels: DataFrame, rows: DataFrame, value: str, out: str, slot: int | None = None) -> DataFrame:
    """Adds the sum and number of ``value`` over the rows (symbol, ts) in [t0, t1], from prefix sums met by two as-of sweeps."""
    pre = rows.select("symbol", "ts", F.coalesce(value, F.lit(0.0)).alias("_x"), F.lit(1).alias("_one"))
    pre = running_sum(pre, ["symbol"], "ts", [], {"s": "_x", "n": "_one"}, slot)
    pre = pre.select("symbol", "ts", F.struct(F.col("s").cast("double").alias("s"), F.col("n").cast("long").alias("n")).alias("p"))

    def as_of(e: DataFrame, at: str, strict: bool, name: str) -> DataFrame:
        left = e.select("*", F.col(at).alias("_at"), F.lit(0 if strict else 2).alias("_k"), F.lit(None).cast("struct<s:double,n:bigint>").alias("_p"))
        right = pre.select(*[F.col(c) if c == "symbol" else F.lit(None).cast(t).alias(c) for c, t in e.dtypes], F.col("ts").alias("_at"), F.lit(1).alias("_k"), F.col("p").alias("_p"))
        both = running_last(left.unionByName(right), ["symbol"], "_at", ["_k"], "_p", "_v", slot).where("_k <> 1")
        zero = F.struct(F.lit(0.0).alias("s"), F.lit(0).cast("long").alias("n"))
        return both.select(*e.columns, F.coalesce("_v", zero).alias(name))

    e = as_of(as_of(labels, "t0", True, "_before"), "t1", False, "_until")
    return e.withColumns({f"{out}_sum": F.col("_until.s") - F.col("_before.s"), f"{out}_n": F.col("_until.n") - F.col("_before.n")}).drop("_before", "_until")


def average_uniqueness(close: DataFrame, labels: DataFrame, slot: int | None = None) -> DataFrame:
    """symbol, label_id, uniqueness: the mean of 1 / concurrency over the label's rows."""
    rows = concurrency(close, labels, slot).where("n > 0").withColumn("inverse", 1 / F.col("n"))
    e = _between(_closed(labels, close).select("symbol", "label_id", "t0", "t1"), rows, "inverse", "u", slot)
    return e.select("symbol", "label_id", F.try_divide("u_sum", "u_n").alias("uniqueness"))


def weights_by_return(close: DataFrame, labels: DataFrame, slot: int | None = None) -> DataFrame:
    """symbol, label_id, weight: |sum of log returns over concurrency|, scaled so that a symbol's weights sum to their number.

    One sweep over closes, starts and ends: the return that a label has is the sum at its end less the one before its start.
    """
    edge = lambda c, kind, step: F.struct(F.col(c).alias("ts"), F.lit(kind).alias("k"), F.lit(step).alias("s"))
    e = _closed(labels, close).select("symbol", "label_id", "t0", "t1").withColumn("_row", F.monotonically_increasing_id())
    e = e.select("symbol", "label_id", "_row", F.inline(F.array(edge("t0", 0, 1), edge("t1", 2, -1))))
    c = close.select("symbol", "ts", F.lit(1).alias("k"), F.lit(0).alias("s"), log_return(F.col("close"), ordered()).alias("r"))
    both = running_sum(c.unionByName(e, allowMissingColumns=True), ["symbol"], "ts", ["k"], {"n": "s"}, slot)
    both = both.withColumn("part", F.when(F.col("k") == 1, F.try_divide("r", "n")))
    both = running_sum(both, ["symbol"], "ts", ["k"], {"sum": "part"}, slot).where("k <> 1")
    e = both.groupBy("symbol", "label_id", "_row").agg(F.sum(F.when(F.col("k") == 2, F.col("sum")).otherwise(-F.col("sum"))).alias("r_sum"))
    all_ = Window.partitionBy("symbol")
    x = F.abs("r_sum")
    return e.select("symbol", "label_id", (x * F.count(F.lit(1)).over(all_) / F.nullif(F.sum(x).over(all_), F.lit(0.0))).alias("weight"))


def weights_by_time_decay(uniqueness: DataFrame, order: str, decay: float = 1.0) -> DataFrame:
    """Adds weight: linear in the cumulated uniqueness, 1 at the newest; decay in (-1, 1] is the oldest's, below 0 cut to 0."""
    if not -1 < decay <= 1:
        raise ValueError("decay lies in (-1, 1]")
    w = Window.partitionBy("symbol").orderBy(order)
    u = uniqueness.withColumn("_c", F.sum("uniqueness").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    u = u.withColumn("_last", F.last("_c").over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    slope = (1 - decay) / F.col("_last") if decay >= 0 else 1 / ((decay + 1) * F.col("_last"))
    return u.withColumn("weight", F.greatest(F.lit(0.0), 1 - slope * F.col("_last") + slope * F.col("_c"))).drop("_c", "_last")


def indicator_matrix(t0, t1, bars) -> np.ndarray:
    """bars by labels, 1 where the label covers the bar. For one symbol's labels at a time."""
    t0, t1, at = np.asarray(t0), np.asarray(t1), np.unique(np.concatenate([bars, t0, t1]))
    return ((at[:, None] >= t0) & (at[:, None] <= t1)).astype(float)


def matrix_uniqueness(ind: np.ndarray) -> tuple[np.ndarray, float]:
    """The uniqueness of each cell, and the mean of those above 0."""
    c = ind.sum(1, keepdims=True)
    u = np.divide(ind, c, out=np.zeros_like(ind), where=c > 0)
    return u, float(u[u > 0].mean()) if (u > 0).any() else float("nan")


def sequential_bootstrap(ind: np.ndarray, size: int | None = None, warmup: list[int] | None = None, seed: int = 0) -> list[int]:
    """Draws labels one by one, each with a probability in proportion to its mean uniqueness given those drawn."""
    rng, drawn, seen = np.random.default_rng(seed), [], np.zeros(len(ind))
    warmup, bars = list(warmup or []), np.maximum(ind.sum(0), 1)
    while len(drawn) < (size or ind.shape[1]):
        p = (ind / (1 + seen)[:, None]).sum(0) / bars
        k = warmup.pop(0) if warmup else int(rng.choice(ind.shape[1], p=p / p.sum()))
        drawn.append(k)
        seen += ind[:, k]
    return drawn


def bootstrap_intervals(a: np.ndarray, b: np.ndarray, size: int | None = None, warmup: list[int] | None = None, seed: int = 0) -> list[int]:
    """The draws of sequential_bootstrap for labels that cover the bars a to b - 1, sorted by a, without a matrix.

    A draw changes the uniqueness of the labels that overlap it alone; probabilities are summed by blocks.
    """
    n, rng, drawn, warmup = len(a), np.random.default_rng(seed), [], list(warmup or [])
    reach, length, block = np.maximum.accumulate(b), np.maximum(b - a, 1), max(16, int(n**0.5))
    inverse, p = np.ones(int(reach[-1])), (b > a).astype(float)
    starts = np.arange(0, n, block)
    sums, seen = np.add.reduceat(p, starts), np.zeros(len(inverse))
    while len(drawn) < (size or n):
        if warmup:
            k = warmup.pop(0)
        else:
            total = np.cumsum(sums)
            u = rng.random() * total[-1]
            j = min(int(np.searchsorted(total, u, "right")), len(sums) - 1)
            inside = np.cumsum(p[starts[j]: starts[j] + block])
            k = int(starts[j]) + min(int(np.searchsorted(inside, u - (total[j - 1] if j else 0.0), "right")), len(inside) - 1)
        drawn.append(k)
        if a[k] == b[k]:
            continue
        seen[a[k]: b[k]] += 1
        inverse[a[k]: b[k]] = 1 / (1 + seen[a[k]: b[k]])
        low, high = int(np.searchsorted(reach, a[k], "right")), int(np.searchsorted(a, b[k], "left"))
        first = a[low]
        upto = np.r_[0.0, np.cumsum(inverse[first: reach[high - 1]])]
        p[low:high] = (upto[b[low:high] - first] - upto[a[low:high] - first]) / length[low:high]
        i, j = low // block, (high - 1) // block + 1
        sums[i:j] = np.add.reduceat(p[i * block: j * block], starts[i:j] - i * block)
    return drawn


def bootstrap_by_symbol(labels: DataFrame, close: DataFrame, seed: int = 0) -> DataFrame:
    """symbol, draw, label_id: a sequential bootstrap of each symbol's labels, its bars being its closes."""
    def draw(key, left, right):
        import pandas as pd

        left = left.sort_values(["t0", "label_id"])
        ids = left["label_id"].to_numpy()
        t0, t1, bars = left["t0"].to_numpy("datetime64[us]"), left["t1"].to_numpy("datetime64[us]"), right["ts"].to_numpy("datetime64[us]")
        at = np.unique(np.concatenate([bars, t0, t1]))
        at = at[~np.isnat(at)]
        a = np.searchsorted(at, t0, "left")
        b = np.where(np.isnat(t1), a, np.maximum(a, np.searchsorted(at, t1, "right")))
        got = bootstrap_intervals(a, b, seed=seed) if len(ids) else []
        return pd.DataFrame({"symbol": [key[0]] * len(got), "draw": range(len(got)), "label_id": ids[got] if got else []})

    return labels.groupBy("symbol").cogroup(close.select("symbol", "ts").groupBy("symbol")).applyInPandas(draw, "symbol string, draw long, label_id long")


def fold_bounds(n: int, k: int) -> list[tuple[int, int]]:
    """Contiguous folds of 0 .. n - 1, the first ones longer by one."""
    size, more = divmod(n, k)
    ends = np.cumsum([size + (i < more) for i in range(k)]).tolist()
    return list(zip([0, *ends[:-1]], ends))


def purged_folds(info: DataFrame, folds: int, test_folds: int = 1, embargo: float = 0.0, strict_start: bool = False) -> DataFrame:
    """split, row_id, part: every choice of test_folds of the folds as test rows, with the rows of info that may train.

    info: row_id (0, 1, ... in time), t0, t1. A train row is dropped when [t0, t1] meets a test interval:
    from the first test row's t1 (t0 if strict_start) to the t1 of the last, moved on by the embargo.
    """
    n = info.count()
    bounds = fold_bounds(n, folds)
    skip = int(n * embargo)
    wanted = sorted({x for a, b in bounds for x in (a, min(n - 1, b - 1 + (skip if b < n else 0)))})
    at = {r["row_id"]: r for r in info.where(F.col("row_id").isin(wanted)).collect()}  # two rows a fold
    out = None
    for k, chosen in enumerate(combinations(range(folds), test_folds)):
        test, meets = F.lit(False), F.lit(False)
        for f in chosen:
            a, b = bounds[f]
            first, last = at[a], at[min(n - 1, b - 1 + (skip if b < n else 0))]
            test = test | F.col("row_id").between(a, b - 1)
            meets = meets | ((F.col("t0") <= F.lit(last["t1"])) & (F.col("t1") >= F.lit(first["t0"] if strict_start else first["t1"])))
        part = info.select(F.lit(k).alias("split"), "row_id", F.when(test, "test").when(~meets, "train").alias("part")).where("part is not null")
        out = part if out is None else out.unionByName(part)
    return out


def backtest_paths(folds: int, test_folds: int) -> int:
    return comb(folds, folds - test_folds) * test_folds // folds
