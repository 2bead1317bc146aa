"""B-splines and smooths under a difference penalty against plain numpy."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from emberfield.model.design import design, terms
from emberfield.model.fit import fit_lognormal, fit_student
from emberfield.model.sites import fit_sites
from emberfield.model.splines import bends, bspline_columns, learn_psplines

FLAT = float("inf")


def plain_basis(x, low, high, segments):
    """Cox-de Boor recursion over the extended knots, clamped to the range."""
    h = (high - low) / segments
    knots = low + h * np.arange(-3, segments + 4)
    x = np.clip(x, low, high)
    inner = np.minimum(np.floor((x - low) / h).astype(int), segments - 1) + 3
    B = np.zeros((len(x), len(knots) - 1))
    B[np.arange(len(x)), inner] = 1.0
    for d in range(1, 4):
        up = np.zeros((len(x), B.shape[1] - 1))
        for i in range(up.shape[1]):
            up[:, i] = (x - knots[i]) / (knots[i + d] - knots[i]) * B[:, i] + (knots[i + d + 1] - x) / (knots[i + d + 1] - knots[i + 1]) * B[:, i + 1]
        B = up
    return B


def wavy(spark, n=3000, seed=3):
    rng = np.random.default_rng(seed)
    x = rng.uniform(-2, 5, n)
    pdf = pd.DataFrame({"i": np.arange(n), "x": x, "site": rng.integers(0, 40, n), "y": 0.4 * x + np.sin(2 * x) + 0.3 * rng.normal(size=n)})
    pdf["v"] = np.exp(pdf.y)
    return spark.createDataFrame(pdf).repartition(5), pdf


@pytest.mark.parametrize("segments", [1, 2, 7, 30])
def test_basis(spark, segments):
    _, pdf = wavy(spark, 200)
    x = np.concatenate([pdf.x, [-2.0, 5.0, -50.0, 50.0]])
    df = spark.createDataFrame([(i, float(v)) for i, v in enumerate(x)] + [(len(x), None)], "i int, x double")
    spec = {"lower": -2.0, "upper": 5.0, "segments": segments}
    rows = df.select("i", F.array(*bspline_columns(F.col("x"), spec)).alias("b")).orderBy("i").collect()
    got = np.array([r["b"] for r in rows[:-1]])
    assert got.shape[1] == segments + 3 and np.allclose(got, plain_basis(x, -2.0, 5.0, segments), atol=1e-12)
    assert rows[-1]["b"] == [None] * (segments + 3)
    assert np.allclose(got.sum(axis=1), 1.0)


def test_bends_are_second_differences():
    U = bends(9)
    assert U.shape == (12, 10) and np.allclose(np.diff(U, 2, axis=0), np.eye(10), atol=1e-10)


def test_ranges(spark):
    df = spark.createDataFrame([(1.0, 3.0, None), (4.0, 3.0, None), (None, 3.0, None)], "a double, b double, c double")
    got = learn_psplines(df, ["a", "b", "c"], segments=4)
    assert got["a"] == {"lower": 1.0, "upper": 4.0, "segments": 4, "center": 2.5, "scale": pytest.approx(2.1213203)}
    assert (got["b"]["lower"], got["b"]["upper"], got["b"]["scale"]) == (3.0, 4.0, 1.0)
    assert got["c"] == {"lower": 0.0, "upper": 1.0, "segments": 4, "center": 0.0, "scale": 1.0}
    with pytest.raises(ValueError):
        learn_psplines(df, ["a"], segments=0)


def test_missing_values_are_dropped(spark):
    df = spark.createDataFrame([(1.0, 1.0), (None, 1.0), (2.0, 3.0), (4.0, 2.0)], "a double, v double")
    spec = {"psplines": learn_psplines(df, ["a"], segments=3)}
    assert design(df, spec).count() == 3 and fit_lognormal(df, "v", spec).dropped == 1


@pytest.mark.parametrize("segments", [6, 20])
def test_fit_with_given_smoothing_equals_numpy(spark, segments):
    """Penalised least squares on the basis itself, where the penalty is on its second differences."""
    df, pdf = wavy(spark)
    spec = {"psplines": learn_psplines(df, ["x"], segments=segments)}
    sigma, sd = 0.3, 0.2
    fit = fit_lognormal(df, "v", spec, prior_sd=FLAT, fixed={"sigma": sigma, "smooth:x": sd})
    B = plain_basis(pdf.x.values, pdf.x.min(), pdf.x.max(), segments)
    D = np.diff(np.eye(segments + 3), 2, axis=0)
    coef = np.linalg.solve(B.T @ B / sigma**2 + D.T @ D / sd**2, B.T @ pdf.y.values / sigma**2)
    X = np.array([r["x"] for r in design(df, spec).orderBy("i").select("x").collect()])
    assert np.allclose(X @ fit.beta, B @ coef, atol=1e-6)
    assert len(fit.names) == len(terms(spec)) == segments + 3


def test_smoothing_is_at_the_mode_of_its_likelihood(spark):
    """Noise and spread found from the sums are stationary points of the marginal likelihood of all rows, line and level integrated out, and the prior of the spread."""
    df, pdf = wavy(spark, 600)
    spec = {"psplines": learn_psplines(df, ["x"], segments=12)}
    fit = fit_lognormal(df, "v", spec, prior_sd=FLAT)
    assert fit.converged
    B = plain_basis(pdf.x.values, pdf.x.min(), pdf.x.max(), 12)
    X, Z, y = np.column_stack([np.ones(600), pdf.x]), B @ bends(12), pdf.y.values

    def log_posterior(log_sigma, log_sd):
        V = np.exp(2 * log_sigma) * np.eye(600) + np.exp(2 * log_sd) * Z @ Z.T
        W = np.linalg.solve(V, np.column_stack([X, y]))
        A, c = X.T @ W[:, :2], X.T @ W[:, 2]
        fitted = y @ W[:, 2] - c @ np.linalg.solve(A, c)
        return -0.5 * (np.linalg.slogdet(V)[1] + np.linalg.slogdet(A)[1] + fitted) - 0.5 * np.exp(2 * log_sd)

    at = np.log([fit.sigma, fit.sds["smooth:x"]])
    for step in (np.array([1e-3, 0]), np.array([0, 1e-3])):
        slope = (log_posterior(*(at + step)) - log_posterior(*(at - step))) / 2e-3
        assert abs(slope) < 0.05  # a spread off by one per cent gives slopes of about 0.1, a noise so 12
    grid = np.linspace(-2, 5, 50)
    shape = plain_basis(grid, pdf.x.min(), pdf.x.max(), 12) @ bends(12) @ fit.slopes[1:] + (grid - spec["psplines"]["x"]["center"]) / spec["psplines"]["x"]["scale"] * fit.slopes[0] + fit.beta[0]
    inside = (grid > pdf.x.min()) & (grid < pdf.x.max())
    assert np.abs(shape - 0.4 * grid - np.sin(2 * grid))[inside].max() < 0.25


def test_other_fits_take_them(spark):
    df, pdf = wavy(spark)
    spec = {"psplines": learn_psplines(df, ["x"], segments=12)}
    plain = fit_lognormal(df, "v", spec)
    student = fit_student(df, "y", spec, nu=500.0)
    sites = fit_sites(df, "v", spec, "site")
    assert plain.converged and student.converged and sites.converged
    X = np.array([r["x"] for r in design(df, spec).orderBy("i").select("x").collect()])
    for other in (student, sites):
        assert np.abs(X @ (np.asarray(other.beta) - plain.beta)).max() < 0.05
