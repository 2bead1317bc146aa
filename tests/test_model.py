import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from emberfield.model.design import complete_rows, design, learn_levels, learn_smooths, terms
from emberfield.model.effects import conditional_effects, effect_grid
from emberfield.model.fit import Draws, fit_hurdle_lognormal, fit_lognormal, fit_student
from emberfield.model.gram import gram, gram_matrix, gram_sql
from emberfield.model.predict import expected_draws, predict_draws, predict_packed
from emberfield.operators.reshape import explode_draws, scenarios

FLAT = float("inf")


def simulated(spark, n=4000, seed=0, noise="normal", partitions=4):
    rng = np.random.default_rng(seed)
    a, b = rng.normal(size=n), rng.uniform(0, 3, size=n)
    impact = rng.choice(["zero", "low", "high"], n)
    site = rng.integers(0, 8, n)
    effects = rng.normal(0, 0.4, 8)
    step = {"zero": 0.0, "low": 0.3, "high": -0.6}
    eta = 0.5 + 0.8 * a + np.sin(b) + np.array([step[i] for i in impact]) + effects[site]
    e = rng.standard_t(3, n) if noise == "t" else rng.normal(size=n)
    pdf = pd.DataFrame({"i": np.arange(n), "a": a, "b": b, "impact": impact, "site": site, "y": eta + 0.3 * e})
    return spark.createDataFrame(pdf).repartition(partitions), pdf, effects


SPEC = {
    "linear": ["a"], "factors": {"impact": ["zero", "low", "high"]},
    "smooths": {"b": {"center": 1.5, "scale": 0.87, "knots": [-1.0, 0.0, 1.0]}},
}
SITE = {**SPEC, "site": {"column": "site", "levels": list(range(8))}}


def matrix(pdf):
    t = (pdf.b - 1.5) / 0.87
    cols = [np.ones(len(pdf)), pdf.a, pdf.impact == "low", pdf.impact == "high", t]
    cols += [np.maximum(t - k, 0) ** 3 for k in (-1.0, 0.0, 1.0)]
    return np.column_stack([np.asarray(c, dtype=float) for c in cols])


def test_design(spark):
    df, pdf, _ = simulated(spark, 200)
    rows = design(df, SPEC).orderBy("i").select("x").collect()
    assert np.allclose(np.array([r["x"] for r in rows]), matrix(pdf))
    assert [t.name for t in terms(SPEC)][:4] == ["intercept", "a", "impact=low", "impact=high"]
    bad = df.withColumn("impact", F.when(F.col("i") < 10, F.lit("odd")).otherwise(F.col("impact")))
    bad = bad.withColumn("a", F.when(F.col("i") != 20, F.col("a")))
    assert complete_rows(bad, SPEC).count() == 189


def test_learned_specification(spark):
    df, pdf, _ = simulated(spark, 500)
    smooth = learn_smooths(df, ["b", "a"], knots=3)
    assert smooth["b"]["center"] == pytest.approx(pdf.b.mean()) and smooth["a"]["scale"] == pytest.approx(pdf.a.std())
    z = (np.quantile(pdf.b, [0.25, 0.5, 0.75]) - pdf.b.mean()) / pdf.b.std()
    assert smooth["b"]["knots"] == pytest.approx(list(z))
    assert learn_levels(df, "impact", "zero") == ["zero", "high", "low"]
    with pytest.raises(ValueError):
        learn_levels(df, "i", max_levels=100)


@pytest.mark.parametrize("partitions", [1, 4, 13])
def test_gram(spark, partitions):
    df, pdf, _ = simulated(spark, 1000, partitions=partitions)
    Z = np.column_stack([matrix(pdf), pdf.y])
    rows = design(df, SPEC)
    assert np.allclose(gram_matrix(rows), Z.T @ Z)
    long = gram(rows).toPandas()
    assert len(long) == 45 and np.allclose(long.value, (Z.T @ Z)[long.i, long.j])


def test_gram_sql(spark):
    df, pdf, _ = simulated(spark, 300)
    got = gram_sql(df.withColumn("one", F.lit(1.0)), ["one", "a", "y"]).toPandas()
    Z = np.column_stack([np.ones(300), pdf.a, pdf.y])
    assert np.allclose(got.value, (Z.T @ Z)[got.i, got.j])
    with pytest.raises(ValueError):
        gram_sql(df, ["a"] * 13)


def test_empty_fit_is_refused(spark):
    df, _, _ = simulated(spark, 10)
    with pytest.raises(ValueError, match="no complete rows"):
        fit_lognormal(df.filter("a > 100"), "y", {"linear": ["a"]})


def test_lognormal_equals_least_squares(spark):
    df, pdf, _ = simulated(spark)
    spec = {k: v for k, v in SPEC.items() if k != "smooths"}
    fit = fit_lognormal(df.withColumn("v", F.exp("y")), "v", spec, prior_sd=FLAT)
    X = matrix(pdf)[:, :4]
    b, rss = np.linalg.lstsq(X, pdf.y, rcond=None)[:2]
    assert fit.beta == pytest.approx(b, abs=1e-8)
    assert fit.sigma == pytest.approx(np.sqrt(rss[0] / (len(pdf) - 4)), rel=1e-6)
    assert fit.response == "v" and fit.rows == 4000


def test_prior_shrinks(spark):
    df, _, _ = simulated(spark, 30)
    wide, tight = (fit_lognormal(df.withColumn("v", F.exp("y")), "v", {"linear": ["a"]}, prior_sd=s) for s in (FLAT, 0.1))
    assert abs(tight.beta[1]) < abs(wide.beta[1])


def test_dropped_values_are_counted(spark):
    df, _, _ = simulated(spark, 400)
    df = df.withColumn("v", F.when(F.col("i") < 50, -1.0).when(F.col("i") < 150, 0.0).otherwise(F.exp("y")))
    assert fit_lognormal(df, "v", {"linear": ["a"]}).dropped == 150
    fit = fit_hurdle_lognormal(df, "v", {"linear": ["a"]})
    assert (fit.dropped, fit.zeros, fit.rows) == (50, 100, 250)


def test_hurdle_zero_probability(spark):
    df = spark.createDataFrame([(float(max(i - 3, 0)), float(i)) for i in range(10)], "v double, a double")
    fit = fit_hurdle_lognormal(df, "v", {"linear": ["a"]})
    assert (fit.zeros, fit.rows) == (4, 6)
    assert fit.draws(20000).hu.mean() == pytest.approx(5 / 12, abs=0.01)


def test_recovery_and_coverage(spark):
    df, pdf, effects = simulated(spark)
    fit = fit_student(df, "y", SITE)
    names = dict(zip(fit.names, fit.beta))
    assert names["a"] == pytest.approx(0.8, abs=0.03)
    assert names["impact=high"] == pytest.approx(-0.6, abs=0.05)
    found = np.array([names[f"site={s}"] for s in range(8)])
    assert np.corrcoef(found, effects)[0, 1] > 0.98
    assert fit.sds["site"] == pytest.approx(effects.std(), abs=0.25)
    draws = fit.draws(2000, seed=1)
    lo, hi = np.quantile(draws.beta[:, 1], [0.025, 0.975])
    assert lo < 0.8 < hi and draws.beta.shape == (2000, len(fit.names))
    assert draws.sd_site is not None and fit.nu >= 20


def test_student_resists_outliers(spark):
    df, _, _ = simulated(spark, noise="t")
    wild = df.withColumn("y", F.when(F.col("i") % 50 == 0, F.lit(60.0)).otherwise(F.col("y")))
    fit = fit_student(wild, "y", SPEC)
    plain = fit_lognormal(wild.withColumn("v", F.exp("y")), "v", SPEC)
    truth = -0.6
    at = fit.names.index("impact=high")
    assert abs(fit.beta[at] - truth) < 0.1 and fit.nu <= 4
    assert abs(fit.beta[at] - truth) < abs(plain.beta[at] - truth) + 0.05 and fit.sigma < plain.sigma / 3


@pytest.mark.parametrize("partitions", [1, 13])
def test_fit_does_not_depend_on_partitions(spark, partitions):
    df, _, _ = simulated(spark, 500, partitions=partitions)
    base = fit_student(simulated(spark, 500, partitions=4)[0], "y", SPEC)
    assert fit_student(df, "y", SPEC).beta == pytest.approx(base.beta, abs=1e-8)


def some_draws(m=30, p=8):
    rng = np.random.default_rng(9)
    return Draws(rng.normal(0, 0.3, (m, p)), np.linspace(0.2, 0.5, m), np.linspace(3, 8, m), np.linspace(0.1, 0.4, m), np.full(m, 0.5))


@pytest.mark.parametrize("family", ["student", "lognormal", "hurdle_lognormal"])
def test_long_and_packed_predictions_agree(spark, family):
    df, _, _ = simulated(spark, 60)
    rows = design(scenarios(df, "impact"), SPEC)
    keys, kw = ["i", "scenario"], {"seed": 4, "site": "site", "known_sites": [0, 1, 2]}
    a = predict_draws(rows, some_draws(), family, keys, **kw).orderBy("i", "scenario", "draw_id").toPandas()
    packed = predict_packed(rows.repartition(7), some_draws(), family, keys, **kw)
    b = explode_draws(packed, "draws").orderBy("i", "scenario", "draw_id").toPandas()
    assert len(a) == 60 * 2 * 30 and (a.site == b.site).all()
    assert np.allclose(a.value, b.value, rtol=1e-10, atol=1e-12)
    if family == "hurdle_lognormal":
        assert (a.value == 0).mean() == pytest.approx(0.25, abs=0.05)
    with pytest.raises(ValueError):
        predict_draws(rows, some_draws(), "poisson", keys)


def test_new_site_shares_its_effect_within_a_draw(spark):
    df = spark.createDataFrame([(1, 0.0, "new"), (2, 0.0, "new"), (3, 0.0, "old")], "i int, a double, site string")
    m = 200
    draws = Draws(np.zeros((m, 2)), np.full(m, 1e-9), np.full(m, 5.0), None, np.full(m, 1.0))
    out = predict_draws(design(df, {"linear": ["a"]}), draws, "student", ["i"], site="site", known_sites=["old"]).toPandas()
    wide = out.pivot(index="draw_id", columns="i", values="value")
    assert np.allclose(wide[1], wide[2], atol=1e-6) and wide[1].std() == pytest.approx(1.0, abs=0.15)
    assert np.allclose(wide[3], 0.0, atol=1e-6)


def test_no_effect_means_no_contrast(spark):
    df, _, _ = simulated(spark, 50)
    draws = some_draws()
    draws.beta[:, 2:4] = 0.0
    e = expected_draws(design(scenarios(df, "impact"), SPEC), draws, "student")
    gap = e.groupBy("i", "draw_id").agg((F.max("value") - F.min("value")).alias("gap")).agg(F.max("gap")).first()[0]
    assert gap == 0.0


def test_expected_values(spark):
    df = spark.createDataFrame([(1, 1.0)], "i int, a double")
    draws = Draws(np.array([[0.5, 0.2]]), np.array([0.4]), np.array([5.0]), np.array([0.25]))
    rows = design(df, {"linear": ["a"]})
    got = {f: expected_draws(rows, draws, f).first()["value"] for f in ("student", "lognormal", "hurdle_lognormal")}
    assert got["student"] == pytest.approx(0.7)
    assert got["lognormal"] == pytest.approx(np.exp(0.7 + 0.08))
    assert got["hurdle_lognormal"] == pytest.approx(0.75 * np.exp(0.78))


def test_many_terms_take_the_array_fold(spark):
    p = 70
    rng = np.random.default_rng(3)
    x = rng.normal(size=(5, p))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "i int, x array<double>")
    beta = rng.normal(size=(4, p))
    out = expected_draws(df, Draws(beta, np.ones(4)), "student").toPandas().pivot(index="i", columns="draw_id", values="value")
    assert np.allclose(out.values, x @ beta.T)


def test_draws_are_broadcast_and_rows_stay_put(spark):
    df, _, _ = simulated(spark, 50)
    rows = design(df, SPEC).repartition(4, "i")
    out = predict_draws(rows, some_draws(), "student", ["i"]).groupBy("i", "draw_id").agg(F.max("value"))
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and plan.count("Exchange hashpartitioning") == 1
    assert "NestedLoop" not in plan and "CartesianProduct" not in plan


def test_conditional_effects(spark):
    df, pdf, _ = simulated(spark, 300)
    grid = effect_grid(df, ["a", "b"], {"impact": ["zero", "low", "high"]}, points=11)
    assert grid.count() == 25
    m = 400
    rng = np.random.default_rng(6)
    draws = Draws(np.column_stack([rng.normal(c, 0.01, m) for c in (1.0, 2.0, -0.5, 0.3, 0.7)]), np.full(m, 0.1))
    spec = {"linear": ["a", "b"], "factors": {"impact": ["zero", "low", "high"]}}
    out = conditional_effects(grid, draws, "student", spec).toPandas()
    line = out[out.effect == "a"].sort_values("x_value")
    slope = np.polyfit(line.x_value, line.value, 1)[0]
    assert slope == pytest.approx(2.0, abs=0.02)
    assert line.x_value.iloc[0] == pytest.approx(pdf.a.min()) and line.x_value.iloc[-1] == pytest.approx(pdf.a.max())
    levels = out[out.effect == "impact"].set_index("level").value
    assert levels["high"] - levels["zero"] == pytest.approx(0.7, abs=0.02)
    assert ((out.lower <= out.value) & (out.value <= out.upper)).all()


def test_collinear_columns_do_not_break_the_fit(spark):
    df, pdf, _ = simulated(spark, 400)
    fit = fit_lognormal(df.withColumns({"v": F.exp("y"), "a2": F.col("a")}), "v", {"linear": ["a", "a2"]}, prior_sd=FLAT)
    slope = np.polyfit(pdf.a, pdf.y, 1)[0]
    assert fit.beta[1] + fit.beta[2] == pytest.approx(slope, abs=1e-6)
    assert np.isfinite(fit.draws(50).beta).all()


def test_large_means_keep_their_digits(spark):
    """A column far from zero gives the slope of the same column about zero."""
    rng = np.random.default_rng(11)
    n = 20_000
    x, noise = rng.standard_normal(n), 0.1 * rng.standard_normal(n)
    fits = {}
    for mean in (0.0, 1e5, 1e7):
        rows = spark.createDataFrame([(float(a), float(b)) for a, b in zip(x + mean, 1 + 0.5 * x + noise)], "a double, y double")
        rows = rows.withColumn("v", F.exp("y")).repartition(3)
        fits[mean] = (fit_lognormal(rows, "v", {"linear": ["a"]}), fit_student(rows, "y", {"linear": ["a"]}, nu=5.0))
    for mean in (1e5, 1e7):
        for one, far in zip(fits[0.0], fits[mean]):
            assert far.slopes[0] == pytest.approx(one.slopes[0], abs=1e-6) and far.sigma == pytest.approx(one.sigma, abs=1e-6)
            assert far.center_intercept == pytest.approx(one.center_intercept, abs=1e-6) and far.converged


def test_unsettled_fits_say_so(spark):
    rows = spark.createDataFrame([(float(i % 7), float(i % 5) ** 3) for i in range(200)], "a double, y double")
    with pytest.warns(RuntimeWarning):
        fit = fit_student(rows, "y", {"linear": ["a"]}, rounds=1)
    assert not fit.converged and fit.moved > 0


def test_incomplete_rows_are_counted(spark):
    rows = [(1.0, "x", 1.0), (None, "x", 2.0), (2.0, "other", 3.0), (3.0, "y", 4.0), (4.0, "y", 5.0), (1.0, None, 1.0), (1.0, "x", None)]
    df = spark.createDataFrame(rows, "a double, f string, v double")
    spec = {"linear": ["a"], "factors": {"f": ["x", "y"]}}
    for fit in (fit_lognormal, fit_hurdle_lognormal, fit_student):
        got = fit(df, "v", spec)
        assert (got.rows, got.dropped) == (3, 4)
