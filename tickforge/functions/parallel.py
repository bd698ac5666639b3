"""Running a function over parts of a table: the user-facing hook, on Spark tasks instead of process pools."""

from __future__ import annotations

import math
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def linear_parts(n: int, parts: int) -> list[int]:
    """Bounds of even contiguous parts of n items, 0 and n included."""
    k = max(1, min(parts, n))
    return [math.ceil(n * i / k) for i in range(k + 1)]


def nested_parts(n: int, parts: int, upper: bool = False) -> list[int]:
    """Bounds of parts of n items whose i-th costs i + 1 (n - i if upper), with even cost."""
    k, bounds = max(1, min(parts, n)), [0]
    for _ in range(k):
        at = 1 + 4 * (bounds[-1] ** 2 + bounds[-1] + n * (n + 1) / k)
        bounds.append(round((-1 + at**0.5) / 2))
    bounds[-1] = n
    return [n - b for b in reversed(bounds)] if upper else bounds


def map_parts(df: DataFrame, func: Callable[[pd.DataFrame], pd.DataFrame], schema: str, key: str, parts: int) -> DataFrame:
    """func over each of ``parts`` hashed parts of df's keys; errors surface as the task's own."""
    part = df.withColumn("_part", F.pmod(F.xxhash64(key), F.lit(parts)).cast("int"))
    return part.groupBy("_part").applyInPandas(lambda pdf: func(pdf.drop(columns="_part")), schema)


def map_jobs(spark, jobs: list[dict], func: Callable[..., dict], schema: str) -> DataFrame:
    """func(**job) for each of the driver's jobs, a task each; func returns a row as a dict."""
    import pickle

    table = spark.createDataFrame([(k, bytearray(pickle.dumps(j))) for k, j in enumerate(jobs)], "k long, job binary")

    def run(batches):
        for b in batches:
            yield pd.DataFrame([func(**pickle.loads(bytes(j))) for j in b["job"]])

    return table.repartition(max(1, len(jobs)), "k").mapInPandas(run, schema)
