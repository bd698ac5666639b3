"""Running sums and last values over time without a task that holds a whole key.

A key's rows are cut into slots of time. Sums (or last values) of whole slots are few and run in one window per key; inside
a slot a window runs over the slot's own rows, and the slot's start is joined on.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

SLOT = 86_400


def slotted(df: DataFrame, ts: str, seconds: int = SLOT) -> DataFrame:
    return df.withColumn("_slot", F.floor(F.unix_micros(F.col(ts).cast("timestamp")) / (seconds * 1_000_000)))


def _joined(df: DataFrame, starts: DataFrame, keys: list[str]) -> DataFrame:
    same = df["_slot"] == starts["_slot"]
    for k in keys:
        same = same & df[k].eqNullSafe(starts[k])
    return df.join(starts, same).drop(*[starts[k] for k in keys], starts["_slot"])


def running_sum(df: DataFrame, keys: list[str], ts: str, order: list[str], values: dict[str, str], seconds: int | None = SLOT) -> DataFrame:
    """Adds values' keys: the sums of the columns named, up to and with the row, by ts and then ``order``.

    seconds: the length of a slot; None for one window per key, which reads ``df`` once and suits keys of bounded size.
    """
    if seconds is None:
        w = Window.partitionBy(*keys).orderBy(ts, *order).rowsBetween(Window.unboundedPreceding, 0)
        return df.withColumns({out: F.coalesce(F.sum(c).over(w), F.lit(0)) for out, c in values.items()})
    df = slotted(df, ts, seconds)
    slots = df.groupBy(*keys, "_slot").agg(*[F.sum(c).alias(f"_s_{out}") for out, c in values.items()])
    before = Window.partitionBy(*keys).orderBy("_slot").rowsBetween(Window.unboundedPreceding, -1)
    starts = slots.select(*keys, "_slot", *[F.coalesce(F.sum(f"_s_{out}").over(before), F.lit(0)).alias(f"_b_{out}") for out in values])
    inside = Window.partitionBy(*keys, "_slot").orderBy(ts, *order).rowsBetween(Window.unboundedPreceding, 0)
    df = df.withColumns({f"_w_{out}": F.coalesce(F.sum(c).over(inside), F.lit(0)) for out, c in values.items()})
    df = _joined(df, starts, keys)
    return df.withColumns({out: F.col(f"_b_{out}") + F.col(f"_w_{out}") for out in values}).drop("_slot", *[f"_{p}_{out}" for p in "bw" for out in values])


def running_last(df: DataFrame, keys: list[str], ts: str, order: list[str], value: str, out: str, seconds: int | None = SLOT) -> DataFrame:
    """Adds ``out``: the last value not null up to and with the row, by ts and then ``order``. seconds as for running_sum."""
    if seconds is None:
        w = Window.partitionBy(*keys).orderBy(ts, *order).rowsBetween(Window.unboundedPreceding, 0)
        return df.withColumn(out, F.last(value, ignorenulls=True).over(w))
    df = slotted(df, ts, seconds)
    slots = df.where(F.col(value).isNotNull()).groupBy(*keys, "_slot").agg(F.max_by(value, F.struct(ts, *order)).alias("_l"))
    every = df.select(*keys, "_slot").distinct()
    both = every.alias("e").join(slots.alias("s"), [F.col(f"e.{k}").eqNullSafe(F.col(f"s.{k}")) for k in [*keys, "_slot"]], "left").select(*[F.col(f"e.{k}").alias(k) for k in [*keys, "_slot"]], "s._l")
    before = Window.partitionBy(*keys).orderBy("_slot").rowsBetween(Window.unboundedPreceding, -1)
    starts = both.select(*keys, "_slot", F.last("_l", ignorenulls=True).over(before).alias("_b"))
    inside = Window.partitionBy(*keys, "_slot").orderBy(ts, *order).rowsBetween(Window.unboundedPreceding, 0)
    df = _joined(df.withColumn("_w", F.last(value, ignorenulls=True).over(inside)), starts, keys)
    return df.withColumn(out, F.coalesce("_w", "_b")).drop("_slot", "_w", "_b")
