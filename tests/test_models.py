"""Feature importance, fingerprints, bagging, part maps: on data whose structure is known."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.regression import LinearRegression
from pyspark.sql import functions as F

from tickforge.functions import parallel
from tickforge.operators import filters, importance, portfolio, sampling
from tickforge.sources.ticks import classification_data


@pytest.fixture(scope="module")
def data(spark):
    df = classification_data(spark, 600, 4, 1, 1, seed=3).cache()
    return df, ["I_0", "N_0", "N_1", "R_0"]


def folds_of(df):
    h = df.select("row_id", F.pmod(F.xxhash64("row_id"), F.lit(2)).cast("int").alias("h"))
    return h.select(F.explode(F.array(F.lit(0), F.lit(1))).alias("split"), "row_id", "h").select("split", "row_id", F.when(F.col("h") == F.col("split"), "test").otherwise("train").alias("part"))


def test_importances_find_the_informative_feature(data):
    df, names = data
    forest = RandomForestClassifier(labelCol="y", featuresCol="features", numTrees=6, maxDepth=4, seed=1)
    mdi = importance.mean_decrease_impurity(forest.fit(importance.assembled(df, names)), names)
    assert sum(m for m, _ in mdi.values()) == pytest.approx(1) and mdi["I_0"][0] + mdi["R_0"][0] > 0.8
    few = ["I_0", "N_0"]
    model = LogisticRegression(labelCol="y", featuresCol="features")
    mda = importance.mean_decrease_accuracy(model, df, few, "y", folds_of(df), scoring="accuracy")
    assert mda["I_0"][0] > mda["N_0"][0]
    sfi = importance.single_feature_importance(model, df, few, "y", folds_of(df))
    assert sfi["I_0"][0] > sfi["N_0"][0]


def test_orthogonal_features_are_uncorrelated(data):
    df, names = data
    out, value, vector = importance.orthogonal_features(df, names[:3], number=3)
    c = np.corrcoef(out.select("PC_0", "PC_1", "PC_2").toPandas().T)
    assert np.abs(c - np.eye(3)).max() < 1e-8
    got = importance.pca_analysis(dict(zip(names, [0.5, 0.3, 0.2])), value, vector, names[:3])
    assert set(got) == {"pearson", "spearman", "kendall", "weighted_kendall"}


def test_fingerprint_of_a_linear_model(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(200, 2))
    df = spark.createDataFrame(pd.DataFrame({"a": x[:, 0], "b": x[:, 1], "y": 3 * x[:, 0] + x[:, 1]}))
    model = LinearRegression(labelCol="y", featuresCol="features").fit(importance.assembled(df, ["a", "b"]))
    got = importance.fingerprint(model, df, ["a", "b"], 10, [("a", "b")])
    assert got["linear"]["norm"]["a"] > 0.6 and max(got["non_linear"]["raw"].values()) < 1e-6 and got["pairwise"]["raw"]["a+b"] < 1e-6


def test_bagging_by_sequential_bootstrap(spark):
    rng = np.random.default_rng(1)
    n = 80
    t0 = np.arange(n)
    frame = pd.DataFrame({"row_id": t0, "t0": pd.Timestamp("2024-01-01") + pd.to_timedelta(t0, "D"), "x": rng.normal(size=n), "z": rng.normal(size=n)})
    frame["t1"], frame["y"] = frame["t0"] + pd.Timedelta(days=2), (frame["x"] > 0).astype(int)
    df = spark.createDataFrame(frame)
    bag = importance.SequentialBagging("y", ["x", "z"], estimators=3, depth=3, seed=2).fit(df, frame["t0"].to_numpy("datetime64[us]"))
    got = bag.predict(df).toPandas()
    assert (got["prediction"] == got["y"]).mean() > 0.8 and len(got) == n


def test_residuals_and_clusters(spark):
    rng = np.random.default_rng(2)
    a = rng.normal(size=300)
    df = spark.createDataFrame(pd.DataFrame({"a": a, "b": a + 0.1 * rng.normal(size=300), "c": rng.normal(size=300)}))
    out = importance.residualised(df, [["a", "b"], ["c"]], ["c"]).toPandas()
    assert abs(np.corrcoef(out["c"], out["a"])[0, 1]) < 0.05
    long = df.withColumn("ts", F.monotonically_increasing_id()).select("ts", F.explode(F.array(*[F.struct(F.lit(n).alias("asset"), F.col(n).alias("value")) for n in "abc"])).alias("s")).select("ts", "s.*")
    groups = importance.feature_clusters(long, "correlation", "angular", "single", 2)
    assert sorted(map(sorted, groups)) == [["a", "b"], ["c"]]
    assert portfolio.optimal_clusters(np.array([[1, 0.95, 0, 0], [0.95, 1, 0, 0], [0, 0, 1, 0.95], [0, 0, 0.95, 1]])) in ([[0, 1], [2, 3]], [[2, 3], [0, 1]])


def test_parts_and_maps(spark):
    assert parallel.linear_parts(10, 3) == [0, 4, 7, 10] and parallel.linear_parts(2, 5) == [0, 1, 2]
    b = parallel.nested_parts(100, 4)
    cost = [sum(range(i + 1, j + 1)) for i, j in zip(b, b[1:])]
    assert b[0] == 0 and b[-1] == 100 and max(cost) < 1.2 * min(cost)
    assert parallel.nested_parts(100, 4, True)[0] == 0
    got = parallel.map_parts(spark.range(100), lambda p: pd.DataFrame({"n": [len(p)]}), "n long", "id", 7).toPandas()
    assert got["n"].sum() == 100
    jobs = parallel.map_jobs(spark, [{"x": 2}, {"x": 5}], lambda x: {"y": x * x}, "y long").toPandas()
    assert sorted(jobs["y"]) == [4, 25]


def test_drop_labels_and_purge(spark):
    df = spark.createDataFrame([(0,)] * 90 + [(1,)] * 8 + [(2,)] * 2, "bin int")
    assert {r["bin"] for r in filters.drop_labels(df).distinct().collect()} == {0, 1}
    train = spark.createDataFrame([(k, k + 2) for k in range(20)], "t0 long, t1 long")
    test = spark.createDataFrame([(5, 6), (6, 9), (15, 15)], "t0 long, t1 long")
    kept = sorted(r["t0"] for r in filters.purge(train, test).collect())
    assert kept == [k for k in range(20) if not any(k <= b and k + 2 >= a for a, b in ((5, 6), (6, 9), (15, 15)))]
    info = spark.createDataFrame([(k, k, k + 2) for k in range(20)], "row_id long, t0 long, t1 long")
    got = sampling.purged_folds(info, 4).toPandas()
    for k in range(4):
        g = got[got["split"] == k]
        assert set(g[g["part"] == "test"]["row_id"]) == set(range(5 * k, 5 * k + 5))
        lo, hi = 5 * k + 2, 5 * k + 4 + 2
        assert set(g[g["part"] == "train"]["row_id"]) == {r for r in range(20) if not (5 * k <= r < 5 * k + 5) and not (r <= hi and r + 2 >= lo)}


def test_slots_change_nothing(spark, sf):
    from tickforge.plans.queries import intervals

    labels, close = (x.cache() for x in intervals(spark, sf))
    for f in (sampling.concurrency, sampling.average_uniqueness, sampling.weights_by_return):
        a, b = (f(close, labels, s).toPandas() for s in (None, 86_400 * 3))
        order = list(a.columns[:2])
        a, b = (x.sort_values(order).reset_index(drop=True) for x in (a, b))
        pd.testing.assert_frame_equal(a, b, check_dtype=False, rtol=1e-9)


def test_matrix_flag_against_a_loop(spark):
    from tickforge.operators import labeling

    y = np.random.default_rng(5).normal(size=40).cumsum() + 50
    df = spark.createDataFrame(pd.DataFrame({"symbol": "s", "ts": pd.date_range("2024-01-01", periods=40), "seq": range(40), "close": y})).withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    got = labeling.matrix_flag(df, 23, "leigh_bear", 0.0).toPandas().set_index("seq")
    grid = np.array(labeling.TEMPLATES["leigh_bear"])
    for k in range(23, 40):
        part, score = y[k - 23:k], 0.0
        cuts = np.percentile(part, range(10, 101, 10))
        for c, chunk in enumerate(np.array_split(part, 10)):
            for v in chunk:
                score += grid[9 - int((cuts < v).sum()), c] / len(chunk)
        assert got.loc[k, "score"] == pytest.approx(score) and got.loc[k, "label"] == (1 if score > 0 else -1)
    assert len(got) == 17
    with pytest.raises(ValueError):
        labeling.matrix_flag(df, 10, "triangle")


def test_holding_periods(spark):
    from tickforge.operators import backtest

    rows = [(name, f"2020-01-{k + 1:02d}", float(x)) for name, xs in {
        "a": [1, 1, 0, -1, -1, -1, 0, 0], "open": [0, 1, 1], "flat": [0, 0], "turned": [1, 1.5, 0.5, 0, -0.5, -1, 0.5, 1.5, 1.5, 0],
    }.items() for k, x in enumerate(xs)]
    df = spark.createDataFrame(rows, "symbol string, ts string, position double").selectExpr("symbol", "cast(ts as timestamp) ts", "position")
    got = {r["symbol"]: r["days"] for r in backtest.average_holding_period(df).collect()}
    assert got == {"a": 2.5, "open": None, "flat": None, "turned": (1 + 1 + 1 + 1 + 1 + 1 + 2) / 7}


def test_matrix_flag_label_takes_ties(spark):
    from tickforge.operators import labeling

    df = spark.createDataFrame([("s", k, k, float(k % 7)) for k in range(60)], "symbol string, ts int, seq int, close double")
    scores = {r["seq"]: r["score"] for r in labeling.matrix_flag(df, 10, "leigh_bull").collect()}
    cut = sorted(scores.values())[len(scores) // 2]
    got = {r["seq"]: r["label"] for r in labeling.matrix_flag(df, 10, "leigh_bull", cut).collect()}
    assert got == {k: 1 if v >= cut else -1 for k, v in scores.items()} and any(v == cut for v in scores.values())


def test_shuffled_scores_are_those_of_shuffled_tables(data):
    from pyspark.sql import Window

    df, names = data
    df = df.withColumn("N_1", F.when(F.col("row_id") % 50 == 0, None).otherwise(F.col("N_1")))  # rows with a null are skipped
    model = RandomForestClassifier(labelCol="y", featuresCol="features", numTrees=4, maxDepth=3, seed=1).fit(importance.assembled(df, names))
    subsets = [["I_0"], ["N_1"], ["I_0", "R_0"]]
    for scoring in ("accuracy", "log_loss"):
        want = [importance.scored(model, importance.assembled(df, names), "y", scoring)]
        for s in subsets:
            left = df.drop(*s).withColumn("_k", F.row_number().over(Window.orderBy("row_id")))
            right = df.select(*s, F.row_number().over(Window.orderBy(F.xxhash64("row_id", F.lit(42)), "row_id")).alias("_k"))
            want.append(importance.scored(model, importance.assembled(left.join(right, "_k"), names), "y", scoring))
        got = importance.shuffled_scores(model, df, names, subsets, "y", scoring, 42)
        assert got == pytest.approx(want)


def test_weights_by_return_sweeps_once(spark):
    from datetime import datetime, timedelta

    at = lambda k: datetime(2024, 1, 1) + timedelta(minutes=k)
    close = spark.createDataFrame([("a", at(k // 2), k, 10.0 + k * k % 7) for k in range(12)], "symbol string, ts timestamp_ntz, seq long, close double")
    labels = spark.createDataFrame([("a", 1, at(0), at(2)), ("a", 1, at(0), at(2)), ("a", 2, at(1), at(5)), ("a", 3, at(3), None)], "symbol string, label_id long, t0 timestamp_ntz, t1 timestamp_ntz")
    out = sampling.weights_by_return(close, labels)
    assert out._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") <= 5
    r = [0.0] + [math.log((10.0 + k * k % 7) / (10.0 + (k - 1) * (k - 1) % 7)) for k in range(1, 12)]
    spans = [(0, 2), (0, 2), (1, 5), (3, 5)]
    n = [sum(a <= k // 2 <= b for a, b in spans) for k in range(12)]
    raw = [abs(sum(r[k] / n[k] for k in range(12) if a <= k // 2 <= b)) for a, b in spans]
    got = sorted((x["label_id"], x["weight"]) for x in out.collect())
    assert [k for k, _ in got] == [1, 1, 2, 3]
    assert np.allclose([w for _, w in got], [4 * x / sum(raw) for x in raw])
