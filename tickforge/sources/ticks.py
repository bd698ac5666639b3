"""Trades: reading, checking and writing them. A tick is symbol, ts, seq, price, volume; (ts, seq) orders a symbol's ticks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The accepted time formats, tried in order.
TIME_FORMATS = [
    f"{date} HH:mm:ss{fraction}" for date in ("yyyy/MM/dd", "yyyy-MM-dd") for fraction in (".SSSSSSSSS", ".SSSSSS", ".SSS", "")
]


def parsed_time(text):
    """The time in the first format that fits, else null."""
    return F.coalesce(*[F.try_to_timestamp(text, F.lit(f)) for f in TIME_FORMATS]).cast("timestamp_ntz")


def check_ticks(df: DataFrame, date_col: str, price_col: str, volume_col: str) -> None:
    """Raises ValueError unless the three columns are there and price and volume are numbers."""
    kinds = {f.name: f.dataType for f in df.schema}
    for c in (date_col, price_col, volume_col):
        if c not in kinds:
            raise ValueError(f"no column {c}; there are {', '.join(kinds)}")
    for c in (price_col, volume_col):
        if not isinstance(kinds[c], T.NumericType):
            raise ValueError(f"{c} is {kinds[c].simpleString()}, not a number")
    if not isinstance(kinds[date_col], (T.StringType, T.TimestampType, T.TimestampNTZType, T.DateType)):
        raise ValueError(f"{date_col} is {kinds[date_col].simpleString()}, not a time")


def to_ticks(df: DataFrame, date_col="date_time", price_col="price", volume_col="volume", symbol_col: str | None = None, seq_col: str | None = None) -> DataFrame:
    """The canonical ticks of any table with a time, a price and a volume. Times that fit no format raise on use."""
    check_ticks(df, date_col, price_col, volume_col)
    text = isinstance(df.schema[date_col].dataType, T.StringType)
    ts = parsed_time(F.col(date_col)) if text else F.col(date_col).cast("timestamp_ntz")
    ts = F.when(F.col(date_col).isNotNull() & ts.isNull(), F.raise_error(F.concat(F.lit("no time format fits "), F.col(date_col).cast("string")))).otherwise(ts)
    return df.select(
        (F.col(symbol_col) if symbol_col else F.lit("")).alias("symbol"), ts.alias("ts"),
        (F.col(seq_col) if seq_col else F.monotonically_increasing_id()).cast("long").alias("seq"),
        F.col(price_col).cast("double").alias("price"), F.col(volume_col).cast("double").alias("volume"),
    )


def read_ticks(spark: SparkSession, paths: str | list[str], date_col="date_time", price_col="price", volume_col="volume", symbol: str = "") -> DataFrame:
    """CSV files with a header and three columns, in the order of ``paths``; the place in them is seq."""
    if not isinstance(paths, (str, list, tuple)):
        raise ValueError("a path or a list of paths is needed")
    many = [paths] if isinstance(paths, str) else list(paths)
    parts = []
    for k, path in enumerate(many):
        df = spark.read.csv(path, header=True, schema=f"`{date_col}` string, `{price_col}` double, `{volume_col}` double", enforceSchema=False)
        parts.append(to_ticks(df, date_col, price_col, volume_col).withColumn("seq", F.col("seq") + (k << 50)))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.withColumn("symbol", F.lit(symbol))


def write_table(df: DataFrame, path: str, kind: str = "parquet") -> None:
    """Writes bars or any table as parquet, csv, json or orc, replacing what is there."""
    writer = df.write.mode("overwrite")
    writer.csv(path, header=True) if kind == "csv" else writer.format(kind).save(path)


def event_ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    return e.select(
        F.col("event_type").alias("symbol"), F.col("ts").cast("timestamp_ntz").alias("ts"), F.col("event_id").cast("long").alias("seq"),
        F.col("value").cast("double").alias("price"), F.get_json_object("props", "$.k").cast("double").alias("volume"),
    )


#: The same ticks, as DuckDB SQL.
EVENT_TICKS = """ticks as (
  select event_type as symbol, ts::timestamp as ts, event_id::bigint as seq, value::double as price,
    json_extract_string(props, '$.k')::double as volume
  from events)"""


def panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ts, asset, price: the mean order value of each priority and week."""
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    week = F.date_trunc("week", F.col("o_orderdate").cast("timestamp_ntz")).cast("timestamp_ntz")
    return o.groupBy(week.alias("ts"), F.col("o_orderpriority").alias("asset")).agg(F.avg("o_totalprice").alias("price"))


PANEL = """panel as (
  select date_trunc('week', o_orderdate::timestamp)::timestamp as ts, o_orderpriority as asset, avg(o_totalprice) as price
  from orders group by all)"""


def classification_data(spark: SparkSession, rows=10_000, features=100, informative=25, redundant=25, sigma=0.0, seed=0) -> DataFrame:
    """row_id, I_*, N_*, R_*, y: informative, noise and redundant features (informative plus noise of sigma), and a class."""
    df = spark.range(rows).withColumnRenamed("id", "row_id")
    df = df.withColumns({f"I_{k}": F.randn(seed * 1000 + k) for k in range(informative)})
    df = df.withColumns({f"N_{k}": F.randn(seed * 1000 + 500 + k) for k in range(features - informative - redundant)})
    df = df.withColumns({f"R_{k}": F.col(f"I_{k % informative}") + sigma * F.randn(seed * 1000 + 800 + k) for k in range(redundant)})
    return df.withColumn("y", (sum(F.col(f"I_{k}") for k in range(informative)) > 0).cast("int"))
