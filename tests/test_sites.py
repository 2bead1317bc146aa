"""Fits and predictions with an effect for each of many sites."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from emberfield.model import predict as predict_module
from emberfield.model.design import design, learn_levels
from emberfield.model.fit import Draws, fit_lognormal
from emberfield.model.predict import predict_draws, predict_packed
from emberfield.model.sites import fit_sites, site_sums
from emberfield.plans.contrast import predict_fitted

FLAT = float("inf")
SPEC = {"linear": ["a"], "factors": {"impact": ["zero", "high"]}}


def simulated(spark, sites, each, seed=0, sigma=0.3, sd=0.5, hot=0):
    rng = np.random.default_rng(seed)
    site = np.concatenate([np.repeat(np.arange(sites), rng.poisson(each, sites) + 1), np.zeros(hot, dtype=int)])
    n = len(site)
    effect = rng.normal(0, sd, sites)
    a, impact = rng.normal(50, 2, n), rng.choice(["zero", "high"], n)
    y = np.exp(1.0 + 0.4 * (a - 50) - 0.5 * (impact == "high") + effect[site] + rng.normal(0, sigma, n))
    pdf = pd.DataFrame({"i": np.arange(n), "site": site, "a": a, "impact": impact, "y": y, "date": pd.Timestamp("2020-03-01").date()})
    return spark.createDataFrame(pdf).repartition(4), pdf, effect


@pytest.mark.parametrize("fixed", [{"sigma": 0.4, "site": 0.3}, {"site": 0.3}, {}])
def test_equals_dense(spark, fixed):
    """The elimination changes nothing: coefficients, effects, noise and spread equal those of dense site terms."""
    df, _, _ = simulated(spark, 12, 60)
    df = df.unionByName(df.limit(5).withColumn("site", F.lit(None).cast("long")))
    dense = fit_lognormal(df, "y", {**SPEC, "site": {"column": "site", "levels": learn_levels(df, "site")}}, prior_sd=FLAT, fixed=fixed)
    fit = fit_sites(df, "y", SPEC, "site", prior_sd=FLAT, fixed=fixed)
    assert fit.beta == pytest.approx(dense.beta[:3], abs=2e-6) and fit.sigma == pytest.approx(dense.sigma, rel=1e-6)
    effects = {r["site"]: r for r in fit.effects().collect()}
    assert [effects[s]["effect"] for s in range(12)] == pytest.approx(list(dense.beta[3:]), abs=2e-6)
    assert fit.sd_site == pytest.approx(fixed.get("site", dense.sds["site"]), rel=1e-5) and fit.edf == pytest.approx(dense.edf, rel=1e-5)
    assert fit.cov[1:, 1:] == pytest.approx(dense.slopes_cov[:2, :2], rel=1e-5, abs=1e-12)
    assert fit.rows == dense.rows and fit.sites == 12 and fit.converged


def test_twenty_thousand_sites(spark):
    """No term, and no number on the driver, belongs to a site; one site holds a third of the rows."""
    df, pdf, effect = simulated(spark, 20_000, 4, hot=40_000)
    fit = fit_sites(df, "y", SPEC, "site")
    assert fit.sites == 20_000 and fit.converged and fit.rounds <= 25 and len(fit.beta) == 3
    assert fit.beta[1] == pytest.approx(0.4, abs=0.01) and fit.beta[2] == pytest.approx(-0.5, abs=0.02)
    assert fit.sigma == pytest.approx(0.3, abs=0.01) and fit.sd_site == pytest.approx(0.5, abs=0.02)
    got = fit.effects().toPandas().set_index("site").sort_index()
    assert np.corrcoef(got["effect"], effect)[0, 1] > 0.95 and got["sd"].between(0, 0.5).all()
    covered = np.abs(got["effect"] - effect) < 1.96 * got["sd"] + 0.02
    assert 0.92 < covered.mean() < 0.99


def test_no_sites_and_few_rows(spark):
    df, _, _ = simulated(spark, 3, 40)
    bare = df.withColumn("site", F.lit(None).cast("long"))
    fit, plain = fit_sites(bare, "y", SPEC, "site", prior_sd=FLAT), fit_lognormal(bare, "y", SPEC, prior_sd=FLAT)
    assert fit.beta == pytest.approx(plain.beta, abs=1e-6) and fit.sigma == pytest.approx(plain.sigma, rel=1e-6) and fit.effects().count() == 0
    with pytest.raises(ValueError):
        fit_sites(df.filter("false"), "y", SPEC, "site")
    with pytest.raises(ValueError):
        fit_sites(df, "y", {**SPEC, "site": {"column": "site", "levels": [0]}}, "site")


def predicted(df, sums, shift, draws, family, packed, **rest):
    rows = design(df, SPEC).select("i", "site", "x")
    run = predict_packed if packed else predict_draws
    return run(rows, draws, family, ["i"], seed=3, site="site", sums=sums, shift=shift, **rest)


@pytest.mark.parametrize("family", ["student", "lognormal", "hurdle_lognormal"])
def test_long_equals_packed(spark, family, monkeypatch):
    """Known, new and missing sites, two places to measure from, and draws too large to broadcast: the same numbers."""
    df, _, _ = simulated(spark, 8, 10)
    shift = [0.0, 50.0, 0.5, 1.0]
    past = design(df.filter("site < 5"), SPEC).withColumn("ly", F.log("y"))
    m = 7
    beta = np.column_stack([np.linspace(0.5, 1, m), np.linspace(0.3, 0.5, m), np.linspace(-0.6, -0.4, m)])
    draws = Draws(beta, np.linspace(0.2, 0.4, m), np.full(m, 5.0), np.full(m, 0.1), np.r_[0.0, np.linspace(0.1, 0.6, m - 1)])
    rows = df.withColumn("site", F.when(F.col("i") % 11 != 0, F.col("site")))
    long = {(r["i"], r["draw_id"]): r["value"] for r in predicted(rows, site_sums(past, "x", "ly", "site", shift), shift, draws, family, False).collect()}
    other = site_sums(past, "x", "ly", "site", [0.0] * 4)
    for limit in (predict_module.BROADCAST_BYTES, 8):
        monkeypatch.setattr(predict_module, "BROADCAST_BYTES", limit)
        for r in predicted(rows, other, None, draws, family, True).collect():
            assert r["draws"] == pytest.approx([long[r["i"], d] for d in range(m)], rel=1e-7, abs=1e-9)


def test_effects_of_draws(spark):
    """With many draws the effects of a site scatter around its mode with its deviation; a new site has the spread of the sites."""
    df, _, _ = simulated(spark, 30, 20)
    fit = fit_sites(df, "y", SPEC, "site")
    draws = fit.draws(4000, seed=1)
    tight = Draws(np.tile(fit.beta, (4000, 1)), np.full(4000, fit.sigma), sd_site=np.full(4000, fit.sd_site))
    grid = spark.createDataFrame([(i, i, 50.0, "zero") for i in range(3)] + [(99, -1, 50.0, "zero")], "i long, site long, a double, impact string")
    got = predicted(grid, fit.sums, fit.shift, tight, "lognormal", True).collect()
    effects = {r["site"]: r for r in fit.effects().collect()}
    base = fit.beta @ [1.0, 50.0, 0.0]
    for r in got:
        logs = np.log(r["draws"])
        mode, sd = (effects[r["site"]]["effect"], effects[r["site"]]["sd"]) if r["site"] >= 0 else (0.0, fit.sd_site)
        assert logs.mean() - base == pytest.approx(mode, abs=0.03) and logs.std() == pytest.approx(np.hypot(sd, fit.sigma), rel=0.06)
    both = predict_fitted(df.limit(20), fit, draws, "i", "impact", "date")
    assert both.count() == 40
