"""Labels: barriers, fixed horizons, excess returns, trends, tail sets and chart patterns.

close tables are symbol, ts, seq, close; panels are ts, asset, price; events are symbol, event_id, t0, t1,
trgt and more.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickforge.functions.rolling import full, ratio
from tickforge.operators.fold import fold, same_key

#: Published flag templates, upper row first. The bearish ones are these upside down.
LEIGH_BULL = [
    [0.5, 0, -1, -1, -1, -1, -1, -1, -1, 0],
    [1, 0.5, 0, -0.5, -1, -1, -1, -1, -0.5, 0],
    [1, 1, 0.5, 0, -0.5, -0.5, -0.5, -0.5, 0, 0.5],
    [0.5, 1, 1, 0.5, 0, -0.5, -0.5, -0.5, 0, 1],
    [0, 0.5, 1, 1, 0.5, 0, 0, 0, 0.5, 1],
    [0, 0, 0.5, 1, 1, 0.5, 0, 0, 1, 1],
    [-0.5, 0, 0, 0.5, 1, 1, 0.5, 0.5, 1, 1],
    [-0.5, -1, 0, 0, 0.5, 1, 1, 1, 1, 0],
    [-1, -1, -1, -0.5, 0, 0.5, 1, 1, 0, -2],
    [-1, -1, -1, -1, -1, 0, 0.5, 0.5, -2, -2.5],
]
CERVELLOROYO_BULL = [
    [0, 0, 0, 0, 0, 0, 0, 0, 0, 0],
    [0, 0, 0, 0, 0, 0, 0, 0, 0, 0],
    [0, 0, 0, 0, 0, 0, 0, 0, 0, 0],
    [0, 0, 0, 0, -1, -1, -1, -1, -1, -1],
    [0, 0, 0, -1, -2, -2, -2, -2, -2, -2],
    [0, 0, -1, -3, -3, -3, -3, -3, -3, -3],
    [0, -1, -3, -5, -5, -5, -5, -5, -5, -5],
    [0, -1, -5, -5, -5, -5, -5, -5, -5, -5],
    [0, -1, -5, -5, -5, -5, -5, -5, -5, -5],
    [5, -1, -5, -5, -5, -5, -5, -5, -5, -5],
]
TEMPLATES = {
    "leigh_bull": LEIGH_BULL, "leigh_bear": LEIGH_BULL[::-1], "cervelloroyo_bull": CERVELLOROYO_BULL, "cervelloroyo_bear": CERVELLOROYO_BULL[::-1],
}


def first_at_or_after(events: DataFrame, close: DataFrame, at: str, out: dict[str, str]) -> DataFrame:
    """Forward as-of join: adds to each event the columns ``out`` (name -> close's column) of the first row with ts >= at.

    One union and one ordered window per symbol, with no join. The window runs backwards: a frame to its
    unbounded end is evaluated anew for each row. Of rows at one time, the one with the least seq is taken.
    """
    e = events.select("*", F.col(at).alias("_at"), F.lit(0).alias("_is_close"), F.lit(None).cast("struct<" + ",".join(f"{n}:{dict(close.dtypes)[c]}" for n, c in out.items()) + ">").alias("_v"))
    back = F.col("seq") if "seq" in close.columns else F.lit(0)
    rows = close.select(F.col("symbol").alias("_s"), F.col("ts").alias("_at"), back.cast("long").alias("_seq"), F.struct(*[F.col(c).alias(n) for n, c in out.items()]).alias("_v"))
    c = rows.select(*[F.col("_s").alias(c) if c == "symbol" else F.lit(None).cast(t).alias(c) for c, t in events.dtypes], "_at", F.lit(1).alias("_is_close"), "_v", "_seq")
    w = Window.partitionBy("symbol").orderBy(F.desc_nulls_last("_at"), F.desc("_is_close"), F.desc("_seq")).rowsBetween(Window.unboundedPreceding, 0)
    both = e.withColumn("_seq", F.lit(None).cast("long")).unionByName(c).withColumn("_next", F.last("_v", ignorenulls=True).over(w)).where("_is_close = 0")
    return both.select(*events.columns, *[F.when(F.col("_at").isNotNull(), F.col(f"_next.{n}")).alias(n) for n in out])


def add_vertical_barrier(events: DataFrame, close: DataFrame, days=0, hours=0, minutes=0, seconds=0) -> DataFrame:
    """events (symbol, event_id, t0) with t1, the first close at least the offset later; events past the end are dropped."""
    total = ((days * 24 + hours) * 60 + minutes) * 60 + seconds
    e = events.withColumn("_until", F.col("t0") + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.lit(total)))
    return first_at_or_after(e, close, "_until", {"t1": "ts"}).drop("_until").where("t1 is not null")


def _levels(p0, trgt, side, width, above: bool) -> tuple[np.ndarray, np.ndarray]:
    """(sign, level): the return from p0 is past ``width`` targets just where sign * close >= level, a level of NaN never.

    The level is found by bisection over the bits of doubles, so that it agrees with the division to the last bit.
    """
    def past(c):
        r = (c / p0 - 1) * side
        bound = width * trgt if above else -width * trgt
        return ((r > bound) | np.isnan(r)) & ~np.isnan(bound) if above else (r < bound) | (np.isnan(bound) & ~np.isnan(r))  # a NaN is above all numbers

    flip = lambda b: b ^ ((b >> 63) & np.int64(0x7FFF_FFFF_FFFF_FFFF))  # noqa: E731  bits in the order of the numbers, and back
    rises = np.where(side < 0, -1.0, 1.0) * np.where(p0 < 0, -1.0, 1.0)
    sign = rises if above else -rises
    with np.errstate(all="ignore"):
        low, high = (flip(np.full(len(p0), x).view(np.int64)) for x in (-np.inf, np.inf))
        never = ~past(sign * np.inf) & ~past(sign * np.finfo(float).max)
        for _ in range(65):
            mid = (low >> 1) + (high >> 1) + (low & high & 1)
            hit = past(sign * flip(mid).view(float))
            low, high = np.where(hit | (low >= high), low, mid + 1), np.where(hit & (low < high), mid, high)
    return sign, np.where(never | (width <= 0), np.nan, flip(high).view(float))


class _Touches:
    """The first close past each open event's upper (0) and lower (1) barrier. Open events wait in two heaps by the
    close that reaches them, one for rising and one for falling closes, so a close meets only events that it ends."""

    def __init__(self):
        self.heaps, self.limit, self.n = {1.0: [], -1.0: []}, 1024, 0

    def feed(self, key, c):
        from heapq import heapify, heappop, heappush

        at, to = (c[k].astype("datetime64[us]").astype(np.int64).tolist() for k in ("_at", "_to"))
        is_close, close, ids = c["_is_close"].tolist(), c["close"].astype(float).tolist(), c["_id"]
        opens, barriers = np.flatnonzero(c["_is_close"] == 0), []
        for which, name in enumerate(("_upper", "_lower")):
            sign, level = np.ones(len(at)), np.full(len(at), np.nan)
            sign[opens], level[opens] = _levels(*(c[k][opens].astype(float) for k in ("_p0", "trgt", "_side", name)), which == 0)
            barriers.append((which, sign.tolist(), level.tolist()))
        hits = []
        for k, now in enumerate(at):
            if not is_close[k]:
                for which, sign, level in barriers:
                    if level[k] == level[k]:
                        self.n += 1
                        heappush(self.heaps[sign[k]], (level[k], self.n, to[k], which, ids[k]))
                continue
            x = close[k]
            for sign, heap in self.heaps.items():
                if x != x:  # above all numbers: past every upper barrier
                    hits += [(i, w, now) for _, _, t, w, i in heap if w == 0 and t >= now]
                    heap[:] = [h for h in heap if h[3] == 1]
                    heapify(heap)
                while heap and heap[0][0] <= sign * x:
                    _, _, t, w, i = heappop(heap)
                    if t >= now:
                        hits.append((i, w, now))
            if sum(map(len, self.heaps.values())) > self.limit:  # without those whose time is up
                for heap in self.heaps.values():
                    heap[:] = [h for h in heap if h[2] >= now]
                    heapify(heap)
                self.limit = max(1024, 2 * sum(map(len, self.heaps.values())))
        ids, which, when = zip(*hits) if hits else ((), (), ())
        return {"symbol": same_key(key, len(hits)), "_id": np.array(ids, object), "which": np.array(which, np.int32), "at": np.array(when, np.int64).view("datetime64[us]")}


def triple_barrier(events: DataFrame, close: DataFrame, pt: float, sl: float, min_ret: float = 0.0) -> DataFrame:
    """events (symbol, event_id, t0, t1, trgt, side) with trgt > min_ret, t1 the first barrier touched and its kind.

    The upper barrier is at return > pt * trgt, the lower at return < -sl * trgt; a width of 0 turns one
    off. Without a side (null) both use pt. A null t1 means the last close. One ordered fold over events and
    closes of a symbol, which holds its open events.
    """
    e = events.where(F.col("trgt") > min_ret)
    last = close.groupBy("symbol").agg(F.max("ts").alias("_end"))
    e = e.join(last, "symbol").withColumn("_to", F.coalesce("t1", "_end"))
    start = close.groupBy("symbol", "ts").agg(F.max_by("close", "seq").alias("_p0")).withColumnRenamed("ts", "t0")
    e = e.join(start, ["symbol", "t0"])
    kinds = dict(close.dtypes)
    lower = F.when(F.col("side").isNull(), F.lit(float(pt))).otherwise(F.lit(float(sl)))
    number = lambda x: x.cast("double")
    opened = e.where("_p0 is not null").select(
        "symbol", F.col("t0").cast(kinds["ts"]).alias("_at"), F.lit(0).alias("_is_close"), F.col("event_id").cast("string").alias("_id"), F.col("_to").cast(kinds["ts"]).alias("_to"),
        number(F.col("_p0")).alias("_p0"), number(F.col("trgt")).alias("trgt"), number(F.coalesce("side", F.lit(1.0))).alias("_side"), F.lit(float(pt)).alias("_upper"), lower.alias("_lower"),
        F.lit(0.0).alias("close"),
    )
    none = F.lit(0.0)
    closes = close.where("close is not null").select(
        "symbol", F.col("ts").alias("_at"), F.lit(1).alias("_is_close"), F.lit("").alias("_id"), F.col("ts").alias("_to"),
        *[none.alias(c) for c in ("_p0", "trgt", "_side", "_upper", "_lower")], number(F.col("close")).alias("close"),
    )
    met = fold(opened.unionByName(closes), "symbol", ["_at", "_is_close"], _Touches, f"symbol {kinds['symbol']}, _id string, which int, at {kinds['ts']}")
    touched = met.groupBy("symbol", F.col("_id").cast(dict(events.dtypes)["event_id"]).alias("event_id")).agg(
        F.min(F.when(F.col("which") == 0, F.col("at"))).alias("pt_at"), F.min(F.when(F.col("which") == 1, F.col("at"))).alias("sl_at"),
    )
    e = e.join(touched, ["symbol", "event_id"], "left").withColumn("t1", F.least("t1", "pt_at", "sl_at"))
    return e.select("symbol", "event_id", "t0", "t1", "trgt", "side", F.lit(float(pt)).alias("pt"), F.lit(float(sl)).alias("sl"), "pt_at", "sl_at")


def get_bins(events: DataFrame, close: DataFrame) -> DataFrame:
    """symbol, event_id, ret, trgt, bin, side: the return to the barrier touched, and its label.

    bin is 1 or -1 past the scaled log barrier, else 0; with a side, a return not above 0 is 0.
    """
    e = events.where("t1 is not null")
    e = first_at_or_after(e, close, "t0", {"_a": "close"})
    e = first_at_or_after(e, close, "t1", {"_b": "close"})
    r = (F.ln("_b") - F.ln("_a")) * F.coalesce("side", F.lit(1.0))
    up, down = F.ln(1 + F.col("trgt")) * F.col("pt"), -F.ln(1 + F.col("trgt")) * F.col("sl")
    label = F.when((r > 0) & (r > up), 1).when((r < 0) & (r < down), -1).otherwise(0)
    label = F.when(F.col("side").isNotNull() & (r <= 0), 0).otherwise(label)
    return e.select("symbol", "event_id", (F.exp(r) - 1).alias("ret"), "trgt", label.alias("bin"), "side")


def by_asset() -> object:
    return Window.partitionBy("asset").orderBy("ts")


def resampled(panel: DataFrame, unit: str) -> DataFrame:
    """The last price of each asset in each ``unit`` (as date_trunc names it)."""
    return panel.groupBy(F.date_trunc(unit, "ts").cast("timestamp_ntz").alias("ts"), "asset").agg(F.max_by("price", "ts").alias("price"))


def raw_return(panel: DataFrame, logarithmic=False, binary=False, lag=True, resample_by: str | None = None) -> DataFrame:
    """ts, asset, ret: the return to the next row (lag) or from the last; binary gives its sign."""
    p, w = resampled(panel, resample_by) if resample_by else panel, by_asset()
    x = F.col("price")
    ratio = F.lead(x).over(w) / x if lag else x / F.lag(x).over(w)
    r = F.ln(ratio) if logarithmic else ratio - 1
    return p.select("ts", "asset", (F.signum(r) if binary else r).alias("ret"))


def fixed_time_horizon(panel: DataFrame, threshold: float = 0.0, window: int | None = None, lag=True, resample_by=None) -> DataFrame:
    """ts, asset, label: 1, 0 or -1 against the threshold; with a window, of returns standardised over it."""
    r = raw_return(panel, lag=lag, resample_by=resample_by)
    x = F.col("ret")
    if window:
        r = r.withColumn("ret", (x - full(F.avg, x, by_asset(), window)) / full(F.stddev_samp, x, by_asset(), window))
    return r.select("ts", "asset", F.when(x > threshold, 1).when(x < -threshold, -1).when(x.isNotNull(), 0).alias("label"))


def excess(panel: DataFrame, over="mean", binary=False, lag=True, resample_by=None) -> DataFrame:
    """ts, asset, ret: the return less the mean or median of all assets at that time."""
    r = raw_return(panel, lag=lag, resample_by=resample_by)
    at = Window.partitionBy("ts")
    level = F.avg("ret").over(at) if over == "mean" else F.median("ret").over(at)
    x = F.col("ret") - level
    return r.select("ts", "asset", (F.signum(x) if binary else x).alias("ret"))


def over_benchmark(panel: DataFrame, benchmark: float | DataFrame = 0.0, binary=False, lag=True, resample_by=None) -> DataFrame:
    """ts, asset, ret: the return less a number, or less ``value`` of a table (ts, value)."""
    r = raw_return(panel, lag=lag, resample_by=resample_by)
    if isinstance(benchmark, DataFrame):
        r = r.join(benchmark.select("ts", F.col("value").alias("_b")), "ts", "left")
        x = F.col("ret") - F.col("_b")
    else:
        x = F.col("ret") - benchmark
    return r.select("ts", "asset", (F.signum(x) if binary else x).alias("ret"))


def trend_scanning(close: DataFrame, look_forward: int = 20, min_length: int = 5, step: int = 1) -> DataFrame:
    """symbol, ts, seq, t1, tvalue, ret, bin: the stretch ahead with the largest slope t value, and its sign.

    Slopes come from closed-form sums over the rows ahead, arrays of look_forward values that are scored in
    Arrow batches; a stretch that a line fits exactly has no t value.
    """
    w = Window.partitionBy("symbol").orderBy("ts", "seq").rowsBetween(0, look_forward - 1)
    rows = close.withColumns({"_y": F.collect_list("close").over(w), "_t": F.collect_list("ts").over(w)}).where(F.size("_y") == look_forward)

    @F.pandas_udf("k int, t double")
    def best(series: pd.Series) -> pd.DataFrame:
        y = np.stack(series.to_list()) if len(series) else np.zeros((0, look_forward))
        length, found = np.zeros(len(y), np.int32), np.full(len(y), np.nan)
        for k in range(min_length, look_forward, step):
            d, x, sxx = y[:, :k] - y[:, :k].mean(1, keepdims=True), np.arange(k) - (k - 1) / 2, k * (k * k - 1) / 12
            xy, yy = d @ x, (d * d).sum(1)
            sse = yy - xy * xy / sxx
            some = sse > 1e-12 * yy
            t = np.where(some, xy / sxx / np.sqrt(np.where(some, sse, 1) / (k - 2) / sxx), np.nan)
            better = some & ~(np.abs(found) >= np.abs(t))
            length[better], found[better] = k, t[better]
        return pd.DataFrame({"k": length, "t": found})

    rows = rows.withColumn("_best", best("_y")).where(F.col("_best.k") > 0)
    end = F.col("_best.k")
    return rows.select(
        "symbol", "ts", "seq", F.element_at("_t", end).alias("t1"), F.col("_best.t").alias("tvalue"),
        (ratio(F.element_at("_y", end), F.col("close")) - 1).alias("ret"), F.signum("_best.t").cast("int").alias("bin"),
    )


def tail_sets(panel: DataFrame, n_bins: int, window: int | None = None) -> DataFrame:
    """ts, asset, label: 1 in the top of n_bins by the day's log return (over its rolling deviation), -1 in the bottom, else 0."""
    w = by_asset()
    x = F.ln(F.col("price") / F.lag("price").over(w))
    p = panel.withColumn("_x", x)
    if window:
        p = p.withColumn("_x", F.col("_x") / full(F.stddev_samp, F.col("_x"), w, window))
    p = p.where("_x is not null")
    at = Window.partitionBy("ts")
    rank, n = F.row_number().over(at.orderBy("_x", "asset")), F.count(F.lit(1)).over(at)
    label = F.when(rank > 1 + (n - 1) * (n_bins - 1) / n_bins, 1).when(rank <= 1 + (n - 1) / n_bins, -1).otherwise(0)
    return p.select("ts", "asset", label.alias("label"))


def tail_set_members(labels: DataFrame) -> DataFrame:
    """ts, positive, negative: the assets of each tail."""
    side = lambda k: F.array_sort(F.collect_list(F.when(F.col("label") == k, F.col("asset"))))
    return labels.groupBy("ts").agg(side(1).alias("positive"), side(-1).alias("negative"))


def matrix_flag(close: DataFrame, window: int, template: str | list[list[float]], threshold: float | None = None) -> DataFrame:
    """symbol, ts, seq, score: how the previous ``window`` closes, as a 10 by 10 picture, fit a template.

    Row r of the picture is decile 9 - r of the prices, column c the c-th tenth of the time. With a
    threshold the label is added: 1 for a score that reaches it, else -1. The template is a name in TEMPLATES, or a 10 by 10 table with its upper row first.
    """
    if isinstance(template, str) and template not in TEMPLATES:
        raise ValueError(f"template is one of {', '.join(TEMPLATES)}, or a table")
    grid = np.asarray(TEMPLATES[template] if isinstance(template, str) else template, float)
    if grid.shape != (10, 10):
        raise ValueError("the template has 10 rows of 10 weights")
    w = Window.partitionBy("symbol").orderBy("ts", "seq").rowsBetween(-window, -1)
    rows = close.withColumn("_y", F.collect_list("close").over(w)).where(F.size("_y") == window).select("symbol", "ts", "seq", "_y")
    tenth = np.repeat(np.arange(10), [len(a) for a in np.array_split(np.arange(window), 10)])
    share = 1 / np.bincount(tenth, minlength=10)[tenth]

    @F.pandas_udf("double")
    def score(series: pd.Series) -> pd.Series:
        y = np.stack(series.to_list()) if len(series) else np.zeros((0, window))
        cuts = np.percentile(y, np.arange(10, 101, 10), axis=1).T
        row = 9 - np.minimum(9, (cuts[:, None, :] < y[:, :, None]).sum(2))
        return pd.Series((grid[row, tenth[None, :]] * share).sum(1))

    scored = rows.withColumn("score", score("_y")).drop("_y")
    if threshold is not None:
        scored = scored.withColumn("label", F.when(F.col("score") >= threshold, 1).otherwise(-1))
    return scored
