"""Every registered query runs, and equals its SQL where it has one."""

import pytest
from pyspark.sql import functions as F

from tickforge.catalog import ORACLES, QUERIES


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(name, spark, sf, same_as_sql):
    frame = QUERIES[name](spark, sf).toPandas()
    if name in ORACLES:
        same_as_sql(frame, ORACLES[name])
    elif name not in {"bets_concentration"}:
        assert len(frame)


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).limit(1).count() == 1
    assert set(e.oracle_sql()) <= set(e.queries())


def test_sadf_takes_every_week(spark, sf):
    from tickforge.sources.ticks import panel

    got = {r["symbol"]: r["n"] for r in QUERIES["sadf"](spark, sf).groupBy("symbol").agg(F.count("*").alias("n")).collect()}
    weeks = {r["asset"]: r["n"] for r in panel(spark, sf).groupBy("asset").agg(F.count("*").alias("n")).collect()}
    assert got == {k: n - 2 - 11 for k, n in weeks.items()}  # a lag and a difference are lost, and 11 rows short of min_length


def test_online_selection_takes_every_strategy_and_week(spark, sf):
    from tickforge.operators import online
    from tickforge.sources.ticks import panel

    p = panel(spark, sf)
    whole = p.groupBy("ts").count().where(F.col("count") == p.select("asset").distinct().count()).count()
    got = QUERIES["online_selection"](spark, sf).collect()
    assert {r["strategy"] for r in got} == set(online.STRATEGIES)
    assert {r["dates"] for r in got} == {whole}


def test_sequential_bootstrap_draws_from_every_bar(spark, sf):
    labels = QUERIES["vertical_barrier"](spark, sf).count()
    assert QUERIES["sequential_bootstrap"](spark, sf).count() == labels


def test_features_are_all_components(spark, sf):
    import numpy as np

    n = 64
    assert {r["feature"] for r in QUERIES["feature_clusters"](spark, sf).collect()} == {f"f{j}" for j in range(n)}
    e = spark.read.parquet(f"{sf}/embeddings.parquet").orderBy("vec_id").toPandas()
    z = np.stack(e["embedding"].to_numpy()).astype(float)
    z = (z - z.mean(0)) / z.std(0, ddof=1)
    top = np.linalg.eigh(np.corrcoef(z.T))[0][::-1][:3]
    got = QUERIES["orthogonal_features"](spark, sf).select("PC_0", "PC_1", "PC_2").toPandas()
    assert np.allclose(got.var(ddof=1), top)  # a loading on fewer components has another variance


@pytest.fixture()
def zero_prices(tmp_path):
    """A folder with events of one symbol whose prices are 0 for a bar, for two bars in a row, and rise along a line."""
    import duckdb

    prices = [5.0] * 10 + [7.0] * 10 + [0.0] * 10 + [3.0] * 10 + [0.0] * 20 + [4.0] * 10 + [float(k * k % 17) for k in range(200)]
    duckdb.sql(f"""copy (select i::bigint as event_id, timestamp '2024-01-01' + to_minutes(i::int) as ts, 0::bigint as user_id, 'view' as event_type,
      ({prices})[i + 1]::double as value, '{{"k": 2}}' as props from range({len(prices)}) t(i)) to '{tmp_path}/events.parquet'""")
    return str(tmp_path)


@pytest.mark.parametrize("name", ["cusum_filter", "trend_scanning"])
def test_closes_of_zero(name, spark, zero_prices):
    import duckdb
    from conftest import rows

    c = duckdb.connect()
    c.sql("set timezone = 'UTC'")
    c.sql(f"create view events as select * from '{zero_prices}/events.parquet'")
    assert rows(QUERIES[name](spark, zero_prices).toPandas()) == rows(c.sql(ORACLES[name]).df())


def plan_of(frame):
    return frame._jdf.queryExecution().optimizedPlan().toString()


def test_nothing_is_evaluated_anew_to_the_end_of_a_symbol(spark, sf):
    """Frames from a row to the unbounded end cost the square of a symbol's rows, and an exploded join the labels' lengths."""
    from tickforge.operators import labeling
    from tickforge.plans.queries import barrier_events

    e, close = barrier_events(spark, sf)
    assert "unboundedfollowing" not in plan_of(e)
    assert "unboundedfollowing" not in plan_of(QUERIES["bar_features"](spark, sf))
    assert "explode" not in plan_of(labeling.triple_barrier(e, close, 1.0, 1.0))


def test_triple_barrier_by_brute_force(spark):
    import numpy as np
    from tickforge.operators import labeling

    rng = np.random.default_rng(5)
    t = lambda k: np.datetime64("2024-01-01", "us") + np.timedelta64(int(k), "h")
    closes = [("ab"[k % 2], t(k // 3), k, float(x)) for k, x in enumerate(rng.integers(1, 40, 300))]
    first = {}
    for s, ts, k, x in closes:
        first[s, ts] = x  # the last by seq
    events = []
    for n, ((s, ts), p) in enumerate(sorted(first.items())):
        events.append((s, n, ts, None if n % 9 == 0 else ts + np.timedelta64(int(rng.integers(0, 30)), "h"), [0.5, 0.25, 1.0][n % 3], [None, 1.0, -1.0, 0.5][n % 4]))
    schema = "symbol string, ts timestamp_ntz, seq long, close double"
    close = spark.createDataFrame([(s, ts.item(), k, x) for s, ts, k, x in closes], schema)
    e = spark.createDataFrame([(s, n, a.item(), b if b is None else b.item(), w, side) for s, n, a, b, w, side in events], "symbol string, event_id long, t0 timestamp_ntz, t1 timestamp_ntz, trgt double, side double")
    want = {}
    for s, n, a, b, w, side in events:
        path = [(ts, (x / first[s, a] - 1) * (1.0 if side is None else side)) for q, ts, _, x in closes if q == s and ts >= a and (b is None or ts <= b)]
        up, down = [ts for ts, r in path if r > 1.0 * w], [ts for ts, r in path if r < -(1.0 if side is None else 0.5) * w]
        want[n] = (min(up).item() if up else None, min(down).item() if down else None)
    got = {r["event_id"]: (r["pt_at"], r["sl_at"]) for r in labeling.triple_barrier(e, close, 1.0, 0.5).collect()}
    assert got == want


def test_reserve_bets_refines_a_grid_that_holds_no_mixture(spark, monkeypatch):
    from tickforge.operators import bet_sizing

    tried = []

    def fits(spark, moments, runs, epsilon, **how):
        tried.append(epsilon)
        found = [] if epsilon > 0.001 else [(-1.0, 4.0, 2.0, 1.0, 0.4, 0.0)] * runs
        return spark.createDataFrame(found, "mu1 double, mu2 double, s1 double, s2 double, p double, error double")

    assert bet_sizing.fit_mixtures(spark, [109.28, 12094.5, 1.34299e6, 1.49372e8, 1.66316e10], 4, epsilon=0.02, variant=1, max_iter=200).count() == 0
    monkeypatch.setattr(bet_sizing, "fit_mixtures", fits)
    e = spark.sql("""select timestamp_ntz '2024-01-01' + make_dt_interval(0, 0, id) as t0, timestamp_ntz '2024-01-02' + make_dt_interval(0, 0, id) as t1,
      if(id % 3 = 0, -1.0D, 1.0D) as side from (select cast(id as int) as id from range(60))""")
    got = bet_sizing.reserve_sizes(e, runs=2, epsilon=0.02, variant=1, max_iter=200).collect()
    assert tried == pytest.approx([0.02, 0.002, 0.0002])
    assert len(got) == 60 and all(r["bet_size"] is not None for r in got)
