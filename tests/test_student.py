"""Accelerated Student-t fits against a plain optimiser, and the pieces they are made of."""

import math
import warnings

import numpy as np
import pandas as pd
import pytest

from emberfield.model.accelerate import Anderson
from emberfield.model.fit import _polygamma, _tail_step, _tail_sums, fit_student

SPEC = {"linear": ["a"], "factors": {"impact": ["zero", "high"]}}
SITE = {**SPEC, "site": {"column": "site", "levels": list(range(10))}}


def simulated(spark, n=3000, nu=4.0, sd=0.4, seed=0):
    rng = np.random.default_rng(seed)
    a, impact, site = rng.normal(3, 2, n), rng.choice(["zero", "high"], n), rng.integers(0, 10, n)
    y = 1 + 0.5 * a - 0.7 * (impact == "high") + rng.normal(0, sd, 10)[site] + 0.3 * rng.standard_t(nu, n)
    pdf = pd.DataFrame({"a": a, "impact": impact, "site": site, "y": y})
    return spark.createDataFrame(pdf).repartition(3), pdf


def test_anderson_on_a_slow_map():
    """A linear map of rate 0.999 settles in a few steps, and never worse than plain rounds on a rotation."""
    rng = np.random.default_rng(1)
    q = np.linalg.qr(rng.normal(size=(5, 5)))[0]
    A, c = q @ np.diag([0.999, 0.9, 0.5, -0.3, 0.0]) @ q.T, rng.normal(size=5)
    x, mixing = np.zeros(5), Anderson()
    for _ in range(15):
        x = mixing.next(x, A @ x + c)
    assert np.allclose(x, np.linalg.solve(np.eye(5) - A, c), atol=1e-6)
    with pytest.raises(ValueError):
        Anderson().next(np.zeros(1), np.array([np.nan]))


def test_polygamma():
    for x in (0.3, 1.0, 2.5, 40.0):
        h = 1e-4 * max(x, 1)
        one = (math.lgamma(x + h) - math.lgamma(x - h)) / (2 * h)
        two = (math.lgamma(x + h) - 2 * math.lgamma(x) + math.lgamma(x - h)) / h**2
        assert _polygamma(x) == pytest.approx((one, two), rel=2e-5)
    assert _polygamma(1.0) == pytest.approx((-0.5772156649015329, math.pi**2 / 6), rel=1e-12)


def height(e, sigma, nu):
    n = len(e)
    return n * (math.lgamma((nu + 1) / 2) - math.lgamma(nu / 2) - 0.5 * math.log(nu) - math.log(sigma)) - (nu + 1) / 2 * np.log1p((e / sigma) ** 2 / nu).sum() + math.log(nu) - 0.1 * nu


@pytest.mark.parametrize("free", [(False, True), (True, True), (True, False)])
def test_newton_for_level_noise_and_degrees_of_freedom(free):
    """From near and far, and for skewed residuals, the steps end where no move uphill is left."""
    rng = np.random.default_rng(2)
    for e in (0.7 * rng.standard_t(5, 4000), np.log10(rng.uniform(0, 10_000, 4000)) - 3.6):
        for sigma, nu in ((0.7, 1.2), (0.8, 7.0), (0.5, 300.0)):
            level = 0.0
            for _ in range(60):
                move, sigma, nu, curve = _tail_step(sigma, nu, len(e), 0.0, _tail_sums((e - level) / sigma, nu), free)
                r2 = ((e - level) / sigma) ** 2
                level += move if abs(move) < sigma else np.average(e, weights=(nu + 1) / (nu + r2)) - level
            top = height(e - level, sigma, nu)
            assert free[1] is False or curve < 0
            for d, s, v in ((0.01, 1, 1), (-0.01, 1, 1), (0, 1.01, 1), (0, 0.99, 1), (0, 1, 1.02), (0, 1, 0.98), (0.01, 1.01, 1.02), (-0.01, 0.99, 0.98)):
                if (free[0] or s == 1) and (free[1] or v == 1):
                    assert height(e - level - d, sigma * s, nu * v) < top


def plain_fit(pdf, dense, nu=None, rounds=20_000):
    """Slow unaccelerated rounds in numpy from another start, to their end."""
    X = np.column_stack([pdf.a, pdf.impact == "high", *([pdf.site == k for k in range(10)] if dense else [])]).astype(float)
    y, n = pdf.y.to_numpy(), len(pdf)
    p = X.shape[1]
    b, mid, sigma, dof, sd = np.zeros(p), 0.0, 2.0, nu or 30.0, 0.5
    center = X.mean(axis=0)
    for _ in range(rounds):
        r2 = ((y - mid - (X - center) @ b) / sigma) ** 2
        w = (dof + 1) / (dof + r2)
        m, ybar = w @ X / w.sum(), w @ y / w.sum()
        S, c = (X - m).T @ ((X - m) * w[:, None]), (X - m).T @ (w * (y - ybar))
        P = np.r_[1.0, 1.0, np.full(p - 2, sd**-2)]
        V = np.linalg.inv(S / sigma**2 + np.diag(P))
        new = V @ c / sigma**2
        a = (w.sum() * ybar / sigma**2) / (w.sum() / sigma**2 + 1.0)
        edf = 1 + np.trace(V @ S) / sigma**2
        rss = w @ ((y - ybar - (X - m) @ new) ** 2) + w.sum() * (ybar - a) ** 2
        fresh = np.sqrt((n + edf / dof) / w.sum() * rss / (n - edf))
        if dense:
            size = (new[2:] ** 2).sum() + np.diag(V)[2:].sum()
            sd_new = np.sqrt((-10 + np.sqrt(100 + 4 * size)) / 2)
        else:
            sd_new = sd
        if nu is None:
            dof_new = _tail_step(1.0, dof, n, 0.0, _tail_sums(np.sqrt(r2), dof) * [1, 1, 1, 1, 0, 0, 0], (False, True))[2]
        else:
            dof_new = dof
        mid_new = a + (center - m) @ new
        moved = max(np.abs(new - b).max(), abs(fresh - sigma), abs(dof_new - dof), abs(sd_new - sd), abs(mid_new - mid))
        b, sigma, dof, sd, mid = new, fresh, dof_new, sd_new, mid_new
        if moved < 1e-12:
            break
    return np.r_[mid - center @ b, b], sigma, dof, sd


@pytest.mark.parametrize("spec,nu,sd", [(SPEC, 4.0, 0.0), (SPEC, None, 0.0), (SITE, None, 0.4)])
def test_agrees_with_plain_rounds(spark, spec, nu, sd):
    df, pdf = simulated(spark, sd=sd)
    with warnings.catch_warnings():
        warnings.simplefilter("error", RuntimeWarning)
        fit = fit_student(df, "y", spec, nu=nu, tol=1e-9)
    beta, sigma, dof, spread = plain_fit(pdf, "site" in spec, nu)
    assert fit.beta == pytest.approx(beta, abs=1e-5) and fit.sigma == pytest.approx(sigma, rel=1e-5) and fit.nu == pytest.approx(dof, rel=1e-4)
    if "site" in spec:
        assert fit.sds["site"] == pytest.approx(spread, rel=1e-4)
    assert fit.converged and fit.rounds <= 25, fit.rounds
    if nu is None:
        assert 3 < fit.nu < 6 and 0 < fit.nu_sd < 0.3
        nus = fit.draws(2000, seed=1).nu
        assert np.log(nus).std() == pytest.approx(fit.nu_sd, rel=0.1) and np.median(nus) == pytest.approx(fit.nu, rel=0.02)


@pytest.mark.parametrize("nu", [30.0, 1.2])
def test_settles_without_a_site_effect(spark, nu):
    """Effects that are none, almost normal and very heavy tails: the rounds end."""
    df, _ = simulated(spark, nu=nu, sd=0.0, seed=3)
    with warnings.catch_warnings():
        warnings.simplefilter("error", RuntimeWarning)
        fit = fit_student(df, "y", SITE)
    assert fit.converged and fit.rounds <= 25 and fit.sds["site"] < 0.1
