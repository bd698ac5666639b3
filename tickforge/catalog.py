"""The registered queries of the time-series operators and their oracle SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tickforge.plans import queries
from tickforge.plans.queries import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES", "flagship"]


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dollar bars of the event ticks."""
    return queries.dollar_bars(spark, sf_dir)
