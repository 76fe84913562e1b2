"""Block sums, full-covariance mixtures and the robust envelope against numpy."""

import math

import numpy as np
import pytest

from constella.functions.moments import chi2_quantile, moments
from constella.operators import anomaly as A
from constella.operators import mixture as MX
from constella.operators import reduce as D
from test_density import frame

XYZ = ["x", "y", "z"]


def test_moments_of_many_columns(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(1e6, 1, (300, 70)) @ rng.normal(0, 1, (70, 70)) * 1e-3
    cols = [f"c{i}" for i in range(70)]
    df = frame(spark, x, cols).repartition(5)
    n, mean, squares = moments(df, cols)
    assert n == 300
    assert np.allclose(mean, x.mean(0), rtol=1e-12)
    assert np.allclose(squares / 299, np.cov(x.T), rtol=1e-7, atol=1e-9)
    assert moments(df.limit(0), cols)[0] == 0


def test_wide_pca_and_whitening(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(200, 64)) * np.linspace(5, 0.1, 64)
    cols = [f"c{i}" for i in range(64)]
    coords, model = D.pca(frame(spark, x, cols), cols, 3, whiten=True)
    values = np.sort(np.linalg.eigvalsh(np.cov(x.T)))[::-1]
    assert np.allclose(model.variances, values[:3])
    got = np.array([r[1:4] for r in coords.collect()], float)
    assert np.allclose(got.std(0, ddof=1), 1.0, atol=1e-6)


@pytest.mark.parametrize("freedom", [1, 2, 3, 10, 64])
def test_chi_square_quantiles(freedom):
    if freedom == 2:  # closed form
        assert chi2_quantile(0.975, 2) == pytest.approx(-2 * math.log(0.025), rel=1e-12)
    draws = (np.random.default_rng(freedom).normal(size=(100_000, freedom)) ** 2).sum(1)
    assert chi2_quantile(0.5, freedom) == pytest.approx(np.quantile(draws, 0.5), rel=0.02)
    assert chi2_quantile(0.975, freedom) == pytest.approx(np.quantile(draws, 0.975), rel=0.03)


def log_density(x, weights, means, covs):
    out = []
    for w, m, c in zip(weights, means, covs):
        off = x - m
        out.append(np.log(w) - 0.5 * (len(m) * np.log(2 * np.pi) + np.linalg.slogdet(c)[1]
                                      + np.einsum("ij,jk,ik->i", off, np.linalg.inv(c), off)))
    return np.stack(out, 1)


def test_full_mixture_is_the_one_that_was_fitted(spark):
    rng = np.random.default_rng(4)
    skew = np.array([[1.0, 0.95, 0.0], [0.0, 0.3, 0.0], [0.0, 0.4, 0.5]])
    x = np.concatenate([rng.normal(size=(300, 3)) @ skew, rng.normal(size=(250, 3)) @ skew.T + [4, -3, 0]])
    df = frame(spark, x)
    mix = MX.gaussian_mixture(df, XYZ, k=2, covariance="full", tol=1e-7)
    logs = log_density(x, mix.weights, mix.means, mix.covariances)
    rows = np.log(np.exp(logs - logs.max(1, keepdims=True)).sum(1)) + logs.max(1)
    assert mix.log_likelihood == pytest.approx(rows.sum(), rel=1e-9)
    c = MX.criteria(df, mix).first()
    params = 1 + 2 * 3 + 2 * 6
    assert (c["log_likelihood"], c["aic"], c["bic"]) == pytest.approx(
        (rows.sum(), 2 * params - 2 * rows.sum(), params * math.log(550) - 2 * rows.sum()), rel=1e-9)
    got = {r["row_id"]: r["cluster"] for r in mix.e_step(df).collect()}
    assert [got[i] for i in range(550)] == logs.argmax(1).tolist()
    # a fixed point of EM, and better than any diagonal mixture
    share = np.exp(logs - rows[:, None])
    for j in range(2):
        mean = (share[:, j, None] * x).sum(0) / share[:, j].sum()
        assert np.allclose(mean, mix.means[j], atol=1e-3)
    assert mix.log_likelihood > MX.gaussian_mixture(df, XYZ, k=2, covariance="diag").log_likelihood + 100


def test_envelope_finds_a_large_group_of_outliers(spark):
    rng = np.random.default_rng(6)
    good = rng.normal(size=(700, 3)) @ np.array([[2.0, 0, 0], [0.5, 1, 0], [0, 0.2, 0.5]])
    bad = rng.normal(0, 0.5, (300, 3)) + [15, 15, -9]  # 30 % in one place
    flagged, info = A.elliptic_envelope(frame(spark, np.concatenate([good, bad])), XYZ, contamination=0.3)
    rows = {r["row_id"] for r in flagged.collect() if r["is_anomaly"]}
    assert len(rows & set(range(700, 1000))) == 300 and len(rows) <= 301
    assert np.allclose(info["location"], good.mean(0), atol=0.3)
    assert np.allclose(info["covariance"], np.cov(good.T), rtol=0.2, atol=0.2)
    assert info["passes"] <= 10


def test_envelope_of_clean_empty_and_null_rows(spark):
    rng = np.random.default_rng(7)
    x = rng.normal(size=(60, 2))
    df = frame(spark, x).union(spark.createDataFrame([(900, None, 1.0)], "row_id long, x double, y double"))
    flagged, info = A.elliptic_envelope(df, ["x", "y"], 0.1)
    assert flagged.count() == 60 and sum(r["is_anomaly"] for r in flagged.collect()) == 6
    assert A.elliptic_envelope(df.limit(0), ["x", "y"], 0.1)[0].count() == 0
