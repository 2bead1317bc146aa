import datetime as dt
from dataclasses import replace

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from emberfield.model.fit import fit_hurdle_lognormal, fit_student
from emberfield.operators.reshape import explode_draws
from emberfield.operators.summary import ACTION_LEVELS
from emberfield.plans.contrast import (
    ccdf_table, difference_curve, exceedance_table, interval_table, keep_predictions, level_table, predict_scenarios, prediction_curve,
)
from emberfield.plans.features import RAIN_COLUMNS, bay_features, harvest_features, rain_daily, solar_daily, station_features


def test_rain_sheet(spark):
    """One row per day of month; every month column goes with its own year."""
    def row(day, first):
        cells = [day]
        for m in range(12):
            cells += [str(first + m), "2019"]
        return tuple(cells)

    heading = tuple(["Day"] + ["mm", "Year"] * 12)
    raw = spark.createDataFrame([heading, row("1", 1), row("30", 100)], ", ".join(f"c{i} string" for i in range(len(RAIN_COLUMNS))))
    rain = {r["date"]: r["rainfall"] for r in rain_daily(raw).collect()}
    assert len(rain) == 23  # there is no 30 February
    assert rain[dt.date(2019, 1, 1)] == 2.5 and rain[dt.date(2019, 12, 30)] == 111 * 2.5


def test_solar(spark):
    rows = [("Year", "Month", "Day", "GHI"), ("2019", "1", "2", "10"), ("2019", "1", "2", "20"), ("2019", "2", "30", "5")]
    df = spark.createDataFrame(rows, "Source string, `Location ID` string, City string, Latitude string")
    out = solar_daily(df, "Source", "Location ID", "City", "Latitude").collect()
    assert [(r["date"], r["solar_exposure"]) for r in out] == [(dt.date(2019, 1, 2), 15.0)]


def bay(spark):
    days = [dt.date(2018, 7, 10) + dt.timedelta(days=i) for i in range(12)]
    samples = spark.createDataFrame([(d, t, 10.0 ** (i % 4), i) for i, d in enumerate(days) for t in ("x", "y")],
                                    "date date, taxon string, total_phytoplankton double, n int")
    solar = spark.createDataFrame([(d, float(i)) for i, d in enumerate(days)], "date date, solar_exposure double")
    rain = spark.createDataFrame([(days[3], 4.0), (days[8], 9.0)], "date date, rainfall double")
    return samples, solar, rain


@pytest.mark.parametrize("method", ["window", "ranges"])
def test_bay_features(spark, method):
    windows = {"impact": ("2018-07-14", "2018-11-30"), "late": ("2018-12-01", "2019-01-31")}
    samples, solar, rain = bay(spark)
    out = bay_features(samples, solar, rain, windows, ["date", "taxon"], method=method).orderBy("date", "taxon").toPandas()
    assert len(out) == 24 and list(out.rainfall) == [4.0] * 16 + [9.0] * 8
    assert list(out.impact[:8]) == ["zero"] * 8 and set(out.impact[8:]) == {"high"} and set(out.late) == {"zero"}
    assert out.rainfall48[15] == 6.5 and np.isnan(out.rainfall72[0]) and out.rainfall72[16] == pytest.approx(22 / 3)
    assert np.isnan(out.rainfall48.iloc[-1]) and set(out.month_of_year) == {7} and set(out.location) == {"San Francisco"}


def test_bay_features_refuse_a_doubled_day(spark):
    samples, solar, rain = bay(spark)
    with pytest.raises(ValueError, match="not unique"):
        bay_features(samples, solar.unionByName(solar), rain, {}, ["date", "taxon"])


def test_station_features(spark):
    df = spark.createDataFrame([(dt.date(2020, 4, 18), 100.0, 50.0), (dt.date(2020, 8, 1), 0.0, 100.0), (dt.date(2020, 8, 2), None, 500.0)],
                               "date date, total_phytoplankton double, pseudo double")
    out = station_features(df, "2020-04-07", "2020-06-07", scaled=["pseudo"]).orderBy("date").collect()
    assert [r["impact"] for r in out] == ["low", "zero"] and [r["log10_phytoplankton"] for r in out] == [2.0, None]
    assert [r["pseudo_scaled"] for r in out] == [0.5, 1.0]


def test_harvest_features(spark):
    rows = [("2020-02-01", None, "Lake", 5.0), ("2020-03-05", "Wallis", "Lake", 10.0), ("2020-03-20", "Hastings", "River", 0.0)]
    samples = spark.createDataFrame(rows, "date string, area string, area2 string, pseudo double").withColumn("date", F.to_date("date"))
    impacts = spark.createDataFrame([("Pambula", "low"), ("Wallis Lake", "low"), ("Hastings River", "med")], "location string, impact string")
    cov = samples.limit(0).select("date", F.lit("x").alias("location"), F.lit(1.0).alias("rainfall72"))
    out = harvest_features(samples, impacts, cov, scaled=["pseudo"]).orderBy("date").collect()
    assert [r["location"] for r in out] == ["Pambula", "Wallis Lake", "Hastings River"]
    assert [r["impact"] for r in out] == ["zero", "high", "med"]
    assert [r["week"] for r in out] == [0, 4, 6] and out[0]["latitude"] == -36.96522 and out[1]["pseudo_scaled"] == 1.0


@pytest.fixture(scope="module")
def observed(spark):
    rng = np.random.default_rng(8)
    n = 1500
    date = pd.to_datetime("2020-01-01") + pd.to_timedelta(rng.integers(0, 200, n), unit="D")
    site = rng.choice(["A", "B", "C"], n)
    impact = np.where(date < "2020-03-01", "zero", np.where(site == "A", "high", np.where(site == "B", "low", "zero")))
    rain = rng.gamma(2, 2, n)
    eta = 4 + 0.05 * rain + np.where(impact == "high", 0.8, np.where(impact == "low", 0.2, 0.0))
    y = eta + 0.2 * rng.standard_t(5, n)
    count = np.where(rng.random(n) < 0.25, 0.0, 10**y)
    pdf = pd.DataFrame({"obs_id": np.arange(n), "date": date.date, "site": site, "impact": impact, "rain": rain, "y": y, "count": count / count.max()})
    return spark.createDataFrame(pdf).withColumn("count_max", F.lit(float(count.max())))


SPEC = {"linear": ["rain"], "factors": {"impact": ["zero", "low", "high"]}}


def test_total_count_contrast(spark, observed, tmp_path):
    """Fit, predict with and without the event, write once, summarise."""
    fit = fit_student(observed, "y", SPEC)
    draws = fit.draws(100, seed=2)
    packed = predict_scenarios(observed, SPEC, draws, fit.family, "obs_id", "impact", "date", start="2020-03-01")
    packed = keep_predictions(packed, str(tmp_path / "pred"))
    window = observed.filter("date >= '2020-03-01'")
    assert packed.count() == 2 * window.count()
    long = explode_draws(packed, "draws")
    table = interval_table(window, long, "y", "impact", F.pow(F.lit(10.0), "value")).toPandas().set_index(["type", "impact"])
    assert set(table.index) == {("Observed", "high"), ("Observed", "low"), ("Observed", "zero"),
                                ("Predicted", "high"), ("Predicted", "low"), ("Predicted", "zero")}
    ratio = table.value[("Predicted", "high")] / table.value[("Observed", "high")]
    assert ratio == pytest.approx(1.0, abs=0.25)
    assert (table.lower <= table.value).all() and (table.value <= table.upper).all()
    levels = level_table(long, "impact").toPandas().set_index("impact").value
    assert levels["high"] - levels["zero"] == pytest.approx(0.8, abs=0.1)
    curve = ccdf_table(packed, ["obs_id", "scenario"], "impact").toPandas()
    assert set(curve.impact) == {"high", "low", "zero"} and curve.ccdf.max() == 1.0
    diff = difference_curve(long, ["obs_id"], ["site"]).toPandas()
    for site, truth in (("A", 0.8), ("C", 0.0)):
        part = diff[diff.site == site].sort_values("x")
        mean = np.trapezoid(part.x * part.density, part.x)
        assert mean == pytest.approx(truth, abs=0.08)
    shown = prediction_curve(long, ["impact"], clip=(3.0, 8.0)).toPandas()
    assert len(shown) == 3 * 256


def test_bloom_exceedance(spark, observed):
    fit = fit_hurdle_lognormal(observed, "count", SPEC)
    packed = predict_scenarios(observed, SPEC, fit.draws(200, seed=3), fit.family, "obs_id", "impact", "date", "2020-03-01", "2020-06-30")
    out = {r["impact"]: r["exceedance"] for r in exceedance_table(packed, ["impact"], "count_max", 50_000.0).collect()}
    assert 0.0 <= out["zero"] < out["high"] <= 1.0
    seen = observed.filter("date >= '2020-03-01' and impact = 'high'").agg(F.avg((F.col("count") * F.col("count_max") >= 50_000).cast("int"))).first()[0]
    assert out["high"] == pytest.approx(seen, abs=0.1)
    assert set(ACTION_LEVELS.values()) == {50_000.0, 200.0}


def test_scenario_needs_the_factor_in_the_model(observed):
    with pytest.raises(ValueError, match="no factor"):
        predict_scenarios(observed, {"linear": ["rain"]}, None, "student", "obs_id", "impact", "date")


def test_fit_drives_the_prediction(spark):
    """Sites of the fit are known without being named; both scenarios hold the same complete rows."""
    from emberfield.model.fit import fit_student
    from emberfield.plans.contrast import predict_fitted

    rows = [(i, f"s{i % 4}", ["zero", "high"][i % 2], float(i % 7) + i % 4, "2020-03-05") for i in range(200)]
    df = spark.createDataFrame(rows, "i long, site string, impact string, y double, d string").withColumn("d", F.to_date("d"))
    fit = fit_student(df, "y", {"factors": {"impact": ["zero", "high"]}, "site": {"column": "site", "levels": ["s0", "s1", "s2", "s3"]}}, nu=5.0)
    draws = fit.draws(50, seed=1)
    assert len(set(draws.sd_site)) > 1
    window = spark.createDataFrame([(1, "s1", "high"), (2, "new", "high"), (3, "s2", "odd"), (4, "s2", None)], "i long, site string, impact string").withColumn("d", F.to_date(F.lit("2020-03-05")))
    out = predict_fitted(window, fit, draws, "i", "impact", "d").collect()
    assert sorted((r["i"], r["scenario"]) for r in out) == [(i, s) for i in (1, 2) for s in ("actual", "counterfactual")]
    pairs = predict_fitted(window, fit, draws, "i", "impact", "d", pairs=True).collect()
    want = {r["i"]: r["draws"] for r in out if r["scenario"] == "actual"}
    assert len(pairs) == len(want) == 2 and all(np.allclose(r["actual"], want[r["i"]]) for r in pairs)
    with pytest.raises(ValueError, match="not a level"):
        predict_fitted(window, replace(fit, spec={"factors": {"impact": ["low", "high"]}}), draws, "i", "impact", "d")
