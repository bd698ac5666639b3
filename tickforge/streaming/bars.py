"""Streams of ticks: event-time bars with late data, and resumable volume and dollar bars."""

from __future__ import annotations

import pickle

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tickforge.operators.bars import BARS, _check, _Standard


def streaming_time_bars(ticks: DataFrame, width: str = "1 minute", delay: str = "10 minutes") -> DataFrame:
    """Bars per symbol and window of event time (ts a timestamp); ticks later than ``delay`` are dropped, a bar closes after it."""
    at = F.struct("ts", "seq")
    return ticks.withWatermark("ts", delay).groupBy(F.window("ts", width), "symbol").agg(
        F.min_by("price", at).alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", at).alias("close"),
        F.sum("volume").alias("volume"), F.count(F.lit(1)).alias("cum_ticks"), F.sum(F.col("price") * F.col("volume")).alias("cum_dollar_value"),
    ).select("symbol", F.col("window.end").alias("date_time"), "open", "high", "low", "close", "volume", "cum_ticks", "cum_dollar_value")


def streaming_standard_bars(ticks: DataFrame, metric: str, threshold: float) -> DataFrame:
    """Tick, volume or dollar bars whose open bar is kept from batch to batch, per symbol.

    Each micro-batch holds later ticks than the one before; within it they are put in order by (ts, seq).
    """
    _check(metric)

    def step(key, frames, state: GroupState):
        import pandas as pd

        kernel, price, sign = _Standard(metric, float(threshold)), None, 0.0
        if state.exists:
            held, price, sign = pickle.loads(state.get[0])
            kernel.__dict__.update(held)
        pdf = pd.concat(list(frames)).sort_values(["ts", "seq"])
        p = pdf["price"].to_numpy(float)
        d = np.diff(p, prepend=p[0] if price is None else price)
        signs = np.zeros(len(p))
        for k, x in enumerate(np.sign(d)):
            sign = float(x) if x else sign
            signs[k] = sign
        out = kernel.feed(key[0], {"ts": pdf["ts"].to_numpy("datetime64[us]"), "seq": pdf["seq"].to_numpy(), "price": p, "volume": pdf["volume"].to_numpy(float), "sign": signs})
        state.update((pickle.dumps((kernel.__dict__, float(p[-1]), sign)),))
        yield pd.DataFrame(out)

    return ticks.groupBy("symbol").applyInPandasWithState(step, BARS.replace("timestamp_ntz", "timestamp"), "held binary", "append", GroupStateTimeout.NoTimeout)
