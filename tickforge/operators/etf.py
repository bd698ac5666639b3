"""The ETF trick: one investable series from many instruments with changing weights, carry and costs."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def etf_trick(rows: DataFrame, start: float = 1.0) -> DataFrame:
    """ts, value of rows (ts, asset, open, close, alloc, cost, rate); a null cost or rate is 0 or 1.

    The value moves by sum h * rate * (gain + cost). On the row after a change of weights (the first ones
    count as a change) the holdings h are set to value * weight / sum |weight| over the next open times
    rate, and the gain is close less open; on others h stays and the gain is the change of the close. The series starts at the second date with ``start``.
    Per date the sums need only holdings fixed at the last change, so the dates come one by one.
    """
    w = Window.partitionBy("asset").orderBy("ts")
    at = Window.partitionBy("ts")
    r = rows.withColumns({"rate": F.coalesce("rate", F.lit(1.0)), "cost": F.coalesce("cost", F.lit(0.0))})
    r = r.withColumns({
        "_unit": F.col("alloc") / F.sum(F.abs("alloc")).over(at) / (F.lead("open").over(w) * F.col("rate")),
        "_day": F.col("close") - F.col("open"), "_step": F.col("close") - F.lag("close").over(w),
    })
    days = r.groupBy("ts").agg(F.sort_array(F.collect_list(F.struct("asset", "alloc", "_unit", "_day", "_step", "cost", "rate"))).alias("row"))

    def run(batches):
        import pandas as pd

        value, held, before, changed, first = start, None, None, False, True
        for pdf in batches:
            ts, out = [], []
            for t, row in zip(pdf["ts"], pdf["row"]):
                a = np.array([[x["alloc"], x["_unit"] if x["_unit"] is not None else np.nan, x["_day"], x["_step"] if x["_step"] is not None else np.nan, x["cost"], x["rate"]] for x in row], float)
                if np.isnan(a[:, 3]).any():
                    continue  # the first date has no change of the close
                alloc, unit = a[:, 0], a[:, 1]
                if first:
                    before, first, held = np.zeros(len(row)), False, unit * value
                else:
                    if changed:
                        held = unit * value
                    gain = a[:, 2] if changed else a[:, 3]
                    value += float(np.nansum(held * a[:, 5] * (gain + a[:, 4])))
                    alloc = np.nan_to_num(alloc)
                    changed, before = bool((alloc != before).any()), alloc
                ts.append(t)
                out.append(value)
            yield pd.DataFrame({"ts": ts, "value": out})

    # One series: a row of numbers a date, in order, streamed through one task.
    return days.repartition(1).sortWithinPartitions("ts").mapInPandas(run, "ts timestamp_ntz, value double")
