"""Reading ticks, thresholds that change, folds across batches, and streams that equal their batch counterparts."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tickforge.operators import bars, sampling
from tickforge.operators.etf import etf_trick
from tickforge.sources import ticks as T
from tickforge.streaming.bars import streaming_standard_bars, streaming_time_bars


def make_ticks(spark, n=3000, symbols=2, seed=0):
    rng = np.random.default_rng(seed)
    rows = pd.DataFrame({
        "symbol": [f"s{k % symbols}" for k in range(n)], "ts": pd.Timestamp("2024-01-01") + pd.to_timedelta(np.cumsum(rng.integers(1, 40, n)), "s"),
        "seq": np.arange(n), "price": np.round(100 + np.cumsum(rng.normal(size=n)) * 0.1, 2), "volume": rng.integers(1, 50, n).astype(float),
    })
    return rows, spark.createDataFrame(rows).withColumn("ts", F.col("ts").cast("timestamp_ntz"))


def loop_bars(rows, metric, threshold):
    """Bars one tick at a time."""
    out = []
    for symbol, g in rows.sort_values(["ts", "seq"]).groupby("symbol"):
        held, acc, sign, last, number = [], 0.0, 0.0, None, 0
        for r in g.itertuples():
            d = 0.0 if last is None else r.price - last
            sign, last = (np.sign(d) if d else sign), r.price
            held.append((r, sign))
            acc += {"ticks": 1, "volume": r.volume, "dollar": r.price * r.volume}[metric]
            if acc >= threshold(r.ts):
                p = [x.price for x, _ in held]
                out.append((symbol, number, r.ts, p[0], max(p), min(p), p[-1], sum(x.volume for x, _ in held), float(sum(x.volume for x, s in held if s > 0)), len(held)))
                held, acc, number = [], 0.0, number + 1
    return out


def table(df):
    got = df.select("symbol", "bar_id", "date_time", "open", "high", "low", "close", "volume", "cum_buy_volume", "cum_ticks").toPandas().sort_values(["symbol", "bar_id"])
    return list(got.itertuples(index=False, name=None))


@pytest.mark.parametrize("metric,size", [("ticks", 7.5), ("volume", 333), ("dollar", 40_000)])
def test_standard_bars(spark, metric, size):
    rows, t = make_ticks(spark)
    want = loop_bars(rows, metric, lambda ts: size)
    got = table(bars.standard_bars(t, metric, size))
    assert [tuple(map(str, r)) for r in got] == [tuple(map(str, r)) for r in want]


def test_stepped_threshold(spark):
    rows, t = make_ticks(spark)
    turn = rows["ts"].iloc[1500]
    first = rows["ts"].iloc[100]
    steps = spark.createDataFrame([(first.to_pydatetime(), 500.0), (turn.to_pydatetime(), 200.0)], "ts timestamp, threshold double")
    want = loop_bars(rows, "volume", lambda ts: np.inf if ts < first else 500.0 if ts < turn else 200.0)
    got = table(bars.standard_bars(t, "volume", steps.withColumn("ts", F.col("ts").cast("timestamp_ntz"))))
    assert [tuple(map(str, r)) for r in got] == [tuple(map(str, r)) for r in want]


@pytest.mark.parametrize("make", [bars.imbalance_bars, bars.run_bars])
@pytest.mark.parametrize("kind", ["ema", "const"])
def test_information_bars_do_not_depend_on_batches(spark, make, kind):
    _, t = make_ticks(spark)
    how = dict(num_prev_bars=3, expected_imbalance_window=100, exp_num_ticks_init=30, exp_num_ticks_constraints=[10, 200])
    whole = table(make(t, "volume", kind, **how))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 97)
    try:
        assert table(make(t, "volume", kind, **how)) == whole and len(whole) > 3
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_bad_arguments(spark):
    _, t = make_ticks(spark, 10)
    with pytest.raises(ValueError):
        bars.standard_bars(t, "weight", 1)
    with pytest.raises(ValueError):
        bars.time_bars(t, "W")
    with pytest.raises(ValueError):
        T.to_ticks(t, "when", "price", "volume")
    with pytest.raises(ValueError):
        T.to_ticks(t, "ts", "symbol", "volume")
    with pytest.raises(ValueError):
        T.read_ticks(spark, 5)


def test_read_and_write(spark, tmp_path):
    for k, text in enumerate(["2011/07/31 22:38:45.108", "2011-07-31 22:38:45"]):
        (tmp_path / f"{k}.csv").write_text(f"Date and Time,Price,Volume\n{text},1205,5\n")
    t = T.read_ticks(spark, [str(tmp_path / "0.csv"), str(tmp_path / "1.csv")], "Date and Time", "Price", "Volume", "x").orderBy("seq").collect()
    assert [str(r["ts"]) for r in t] == ["2011-07-31 22:38:45.108000", "2011-07-31 22:38:45"] and t[0]["seq"] < t[1]["seq"]
    (tmp_path / "bad.csv").write_text("Date and Time,Price,Volume\nyesterday,1,1\n")
    with pytest.raises(Exception, match="no time format fits"):
        T.read_ticks(spark, str(tmp_path / "bad.csv"), "Date and Time", "Price", "Volume").collect()
    for kind in ("csv", "parquet"):
        T.write_table(spark.range(3), str(tmp_path / kind), kind)
        assert spark.read.format(kind).option("header", True).load(str(tmp_path / kind)).count() == 3
    assert T.classification_data(spark, 50, 6, 2, 2).count() == 50


def test_etf_trick_of_one_constant_asset(spark):
    rows = [(pd.Timestamp("2024-01-01") + pd.Timedelta(days=k), "a", 10.0 + k, 10.0 + k, 1.0, 0.0, 1.0) for k in range(6)]
    df = spark.createDataFrame(pd.DataFrame(rows, columns=["ts", "asset", "open", "close", "alloc", "cost", "rate"])).withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    v = etf_trick(df).toPandas().sort_values("ts")["value"].tolist()
    assert v[0] == 1.0 and v[1] == pytest.approx(1 + 1 / 12) and len(v) == 5


def test_streams_equal_batches(spark, tmp_path):
    rows, t = make_ticks(spark, 600)
    for k in range(3):
        t.where((F.col("seq") >= 200 * k) & (F.col("seq") < 200 * (k + 1))).coalesce(1).write.parquet(f"{tmp_path}/in/{k}")
    schema = t.schema
    stream = lambda: spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(f"{tmp_path}/in")
    q = streaming_standard_bars(stream(), "volume", 333.0).writeStream.format("memory").queryName("held").outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    want = [r[:2] + r[3:] for r in table(bars.standard_bars(t, "volume", 333.0))]
    got = [r[:2] + r[3:] for r in table(spark.table("held"))]
    assert got == want
    timed = streaming_time_bars(stream().withColumn("ts", F.col("ts").cast("timestamp")), "10 minutes", "1 minute")
    q = timed.writeStream.format("memory").queryName("timed").outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    closed = spark.table("timed").toPandas()
    assert len(closed) and closed["cum_ticks"].sum() <= 600


def test_mixed_folds():
    assert sampling.fold_bounds(10, 3) == [(0, 4), (4, 7), (7, 10)]
