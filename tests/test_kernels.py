"""Published formulas against known values and brute force."""

import math

import numpy as np
import pandas as pd
import pytest

from tickforge.functions import kernels, linear
from tickforge.operators import backtest, bet_sizing, breaks, codependence, entropy, features, importance, online, portfolio, sampling


def test_entropies():
    m = "11100001"
    assert entropy.shannon(m) == pytest.approx(1.0)
    assert entropy.lempel_ziv(m) == pytest.approx(0.625)
    assert entropy.plug_in(m, 1) == pytest.approx(0.985, abs=1e-3)
    assert entropy.kontoyiannis(m) == pytest.approx(0.9682, abs=1e-4)
    assert entropy.kontoyiannis(m, 2) == pytest.approx(0.8453, abs=1e-4)
    assert entropy.kontoyiannis("a") == 0
    q = entropy.quantile_letters(list(range(1000)), 10)
    assert len(q) == 10 and any(abs(k - 229.77) < 1e-6 and v == "\x02" for k, v in q.items())
    with pytest.raises(ValueError):
        entropy.sigma_letters(list(range(1000)), 1)


def test_sharpe_family():
    assert backtest.probabilistic_sharpe(1.14, 1, 250) == pytest.approx(0.957278, abs=1e-5)
    assert backtest.deflated_sharpe(1.14, [0.4, 100], 250, parameters=True, benchmark_only=True) == pytest.approx(1.012241, abs=1e-5)
    assert backtest.deflated_sharpe(1.14, [0.4, 100], 250, parameters=True) == pytest.approx(0.941740, abs=1e-5)
    assert backtest.deflated_sharpe(1.14, [3.5, 1.01, 1.02], 250) == pytest.approx(0.958366, abs=1e-5)
    assert backtest.minimum_track_record(1.14, 1) == pytest.approx(228.734979, abs=1e-5)
    assert backtest.probabilistic_sharpe(2, 1.0, 1, 0.5, 1) is None


def test_student():
    assert backtest.t_cdf(2.0, 10) == pytest.approx(0.963306, abs=1e-6)
    assert backtest.t_quantile(0.975, 5) == pytest.approx(2.570582, abs=1e-5)


def test_ewma_and_ewm_std():
    assert kernels.ewma([1205, 1005], 20)[1] == pytest.approx(1100.0)
    x = np.random.default_rng(0).normal(size=50)
    assert np.allclose(kernels.ewma(x, 7), pd.Series(x).ewm(span=7).mean())
    s = kernels.EwmStd(7)
    assert np.allclose([s.push(v) for v in x], pd.Series(x).ewm(span=7).std(), equal_nan=True)
    assert kernels.ewma_last(x, 7) == pytest.approx(kernels.ewma(x, 7)[-1])


def test_fractional_weights():
    assert len(features.ffd_weights(0.9, 1e-3)) == 12
    assert features.ffd_weights(1.0, 1e-9)[:2] == [1.0, -1.0]


def test_normal_cdf(spark):
    from pyspark.sql import functions as F

    from tickforge.functions.rolling import normal_cdf

    z = [-40.0, -8.0, -3.0, -1.0, 0.0, 0.5, 2.0, 7.5]
    got = spark.createDataFrame([(v,) for v in z], "z double").select(normal_cdf(F.col("z"))).toPandas().iloc[:, 0]
    assert np.allclose(got, [backtest.N.cdf(v) for v in z], atol=1e-14)


def test_moments_round_trip():
    m = bet_sizing.mixture_moments(-2, 1, 2, 1, 0.1)
    assert bet_sizing.raw_moment([bet_sizing.centered_moment(m, k) for k in range(1, 6)], m[0]) == pytest.approx(m)
    fits = [bet_sizing.fit_mixture(m, epsilon=1e-2, variant=2, seed=s, max_iter=1000) for s in range(8)]
    best = min((f for f in fits if f), key=lambda f: f[-1])
    assert np.allclose(best[:5], (-2, 1, 2, 1, 0.1), atol=0.2)
    assert bet_sizing.width(10, 0.95, "sigmoid") == pytest.approx(100 * (0.95**-2 - 1))


def test_simplex_and_quadratic():
    v = np.random.default_rng(1).normal(size=6)
    w = linear.simplex_projection(v)
    assert w.sum() == pytest.approx(1) and (w >= 0).all()
    assert np.allclose(w, linear.box_projection(v, np.zeros(6), np.ones(6)), atol=1e-9)


@pytest.fixture(scope="module")
def moments():
    x = np.random.default_rng(3).normal(size=(300, 6)) @ np.random.default_rng(4).normal(size=(6, 6)) * 0.01
    return x, x.mean(0) + 0.001, np.cov(x.T)


def test_mean_variance(moments):
    _, mu, cov = moments
    w = portfolio.mean_variance("min_volatility", cov, mu)
    q = linear.quadratic(2 * cov, np.zeros(6))
    assert w @ cov @ w == pytest.approx(q @ cov @ q, rel=1e-5)
    for s in ("inverse_variance", "max_return_min_volatility", "max_sharpe", "efficient_risk", "efficient_return", "max_diversification", "max_decorrelation"):
        w = portfolio.mean_variance(s, cov, mu, target_return=float(mu.mean()), target_risk=float(np.diag(cov).mean()))
        assert w.sum() == pytest.approx(1) and (w >= -1e-9).all()
    best = portfolio.mean_variance("max_sharpe", cov, mu)
    rng = np.random.default_rng(5)
    for _ in range(2000):
        v = rng.dirichlet(np.ones(6))
        assert best @ mu / math.sqrt(best @ cov @ best) >= v @ mu / math.sqrt(v @ cov @ v) - 1e-9


def test_hierarchies(moments):
    x, _, cov = moments
    for w in (portfolio.hierarchical_risk_parity(cov), portfolio.hierarchical_equal_risk(cov, 3, "variance"), portfolio.nested_clusters(cov)):
        assert w.sum() == pytest.approx(1)
    side = portfolio.hierarchical_risk_parity(cov, side=np.array([1, 1, -1, 1, -1, 1]))
    assert side[[2, 4]].sum() == pytest.approx(-0.5) and side.sum() == pytest.approx(0)
    assert 1 <= portfolio.gap_clusters(portfolio.cov_to_corr(cov), x) <= 6


def test_linkage_matches_brute_force():
    p = np.random.default_rng(6).normal(size=(8, 2))
    d = np.sqrt(((p[:, None] - p[None]) ** 2).sum(2))
    for method, of in (("single", np.min), ("complete", np.max), ("average", np.mean)):
        merges, groups = linear.linkage(d, method), {k: [k] for k in range(8)}
        for step, (a, b, h, n) in enumerate(merges):
            pairs = [(of(d[np.ix_(groups[i], groups[j])]), i, j) for i in groups for j in groups if i < j]
            assert h == pytest.approx(min(pairs)[0])
            groups[8 + step] = groups.pop(int(a)) + groups.pop(int(b))
            assert len(groups[8 + step]) == n


def test_denoise_and_blocks():
    mu, cov = portfolio.block_matrix(3, 4, 0.6)
    x = np.random.default_rng(7).multivariate_normal(mu, cov, 400)
    out = portfolio.denoised(np.cov(x.T), 400 / 12)
    assert np.allclose(np.diag(out), np.diag(np.cov(x.T)))
    true = portfolio.cov_to_corr(cov)
    assert np.abs(portfolio.cov_to_corr(out) - true).mean() <= np.abs(np.corrcoef(x.T) - true).mean() + 0.02
    assert portfolio.correlation_distance(true, true) == pytest.approx(0)


@pytest.mark.parametrize("name", [s for s in online.STRATEGIES if not s.endswith("_k")])
def test_online_weights_lie_on_the_simplex(name):
    x = np.random.default_rng(8).lognormal(0, 0.02, size=(25, 4))
    w = online.STRATEGIES[name]().run(x)
    assert w.shape == x.shape and np.allclose(w.sum(1), 1) and (w >= 0).all()


def test_hindsight_beats_the_parts():
    x = np.random.default_rng(9).lognormal(0, 0.05, size=(60, 3))
    wealth = lambda n: (online.STRATEGIES[n]().run(x) * x).sum(1).prod()
    assert wealth("bcrp") >= max(wealth("crp"), x.prod(0).max()) - 1e-6
    assert wealth("best_stock") == pytest.approx(x.prod(0).max())


def test_indicator_and_bootstrap():
    ind = sampling.indicator_matrix([0, 2, 4], [2, 3, 5], np.arange(6))
    assert ind.sum(0).tolist() == [3, 2, 2]
    assert sampling.matrix_uniqueness(ind)[1] == pytest.approx((1 + 1 + 0.5 + 0.5 + 1 + 1 + 1) / 7)
    drawn = [sampling.sequential_bootstrap(ind, 3, [1], seed=s) for s in range(300)]
    assert all(d[0] == 1 for d in drawn)
    assert np.mean([d[1] == 2 for d in drawn]) > np.mean([d[1] == 1 for d in drawn])
    assert sampling.backtest_paths(6, 2) == 5


def test_distance_correlation_and_ranks():
    x = np.random.default_rng(10).normal(size=200)
    assert codependence.distance_correlation(x, x) == pytest.approx(1)
    assert codependence.distance_correlation(x, 2 * x + 1) == pytest.approx(1)
    assert codependence.distance_correlation(x, np.random.default_rng(11).normal(size=200)) < 0.3
    assert importance.ranks([3, 1, 3]).tolist() == [2.5, 1, 2.5]
    assert importance.kendall([1, 2, 3], [1, 2, 3]) == 1 and importance.kendall([1, 2, 3], [3, 2, 1], True) == -1


def test_sadf_grows_with_a_bubble():
    rng = np.random.default_rng(12)
    calm = np.cumsum(rng.normal(size=80))
    bubble = np.concatenate([calm[:60], calm[59] + 1.15 ** np.arange(20)])
    at = lambda y: breaks.sadf_at(*breaks.design(y, "linear", 1, True)[:2], end=len(y) - 2, min_length=20, phi=0, sm=False)
    assert at(bubble) > at(calm)
    x, y, _ = breaks.design(calm, "quadratic", 2, True)
    beta, var = breaks.ols(x, y)
    assert np.allclose(beta, np.linalg.lstsq(x, y, rcond=None)[0]) and (np.diag(var) > 0).all()


def test_bootstrap_of_intervals_draws_as_from_the_matrix():
    from tickforge.operators import sampling

    for seed in range(20):
        rng = np.random.default_rng(seed)
        a = np.sort(rng.integers(0, 60, 80))
        b = a + rng.integers(0 if seed % 2 else 1, 12, 80)
        ind = ((np.arange(72)[:, None] >= a) & (np.arange(72)[:, None] < b)).astype(float)
        if seed % 2:  # labels without bars are drawn by neither
            a[0], b[0] = 0, 3
            a, b = a[np.argsort(a, kind="stable")], b[np.argsort(a, kind="stable")]
            ind = ((np.arange(72)[:, None] >= a) & (np.arange(72)[:, None] < b)).astype(float)
        assert sampling.bootstrap_intervals(a, b, seed=seed) == sampling.sequential_bootstrap(ind, seed=seed)
