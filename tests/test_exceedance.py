"""Exceedance at many levels against plain counting."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from emberfield.operators.summary import exceedance, exceedance_curve
from emberfield.plans.contrast import exceedance_levels


@pytest.mark.parametrize("count", [1, 2, 1000])
def test_equals_counting(spark, count):
    rng = np.random.default_rng(1)
    pdf = pd.DataFrame({"g": rng.choice(["a", "b", "c"], 3000, p=[0.8, 0.19, 0.01]), "level": np.round(rng.normal(size=3000), 2)})
    levels = np.round(np.linspace(-2, 5, count), 2)  # many values lie on a level, some levels are equal
    got = exceedance_curve(spark.createDataFrame(pdf).repartition(5), ["g"], "level", levels.tolist()).toPandas()
    assert len(got) == 3 * len(set(levels)) and not got.duplicated(["g", "level"]).any()
    for g, rows in got.groupby("g"):
        v = pdf.level[pdf.g == g].values
        assert np.allclose(rows.exceedance, (v[None, :] >= rows.level.values[:, None]).mean(axis=1), atol=1e-12)


def test_one_level_equals_exceedance(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 2.0), ("a", None), ("b", 0.5), ("c", None)], "g string, v double")
    one = {r["g"]: r["exceedance"] for r in exceedance(df, ["g"], "v", 2.0).collect()}
    assert {r["g"]: r["exceedance"] for r in exceedance_curve(df, ["g"], "v", [2.0]).collect()} == one == {"a": 0.5, "b": 0.0, "c": None}


def test_odd_values(spark):
    inf = float("inf")
    df = spark.createDataFrame([(None, float("nan")), (None, inf), (None, -inf), (None, 3.0), ("x", 3.0)], "`_place` string, v double")
    got = {(r["_place"], r["level"]): r["share"] for r in exceedance_curve(df, ["_place"], "v", [3, 3.0, 4.0], name="share").collect()}
    assert got == {(None, 3.0): 0.75, (None, 4.0): 0.5, ("x", 3.0): 1.0, ("x", 4.0): 0.0}
    assert exceedance_curve(df, [], "v", [3.0]).collect()[0]["exceedance"] == 0.8
    assert exceedance_curve(df.limit(0), ["_place"], "v", [3.0]).count() == 0
    for levels in ([], [1.0, inf], [float("nan")]):
        with pytest.raises(ValueError):
            exceedance_curve(df, [], "v", levels)


def test_packed_draws(spark):
    rows = [(1, "a", 10.0, [0.1, 0.5, None]), (2, "a", None, [0.9]), (3, "b", 10.0, []), (4, "b", 2.0, None), (5, "c", 2.0, [0.5])]
    df = spark.createDataFrame(rows, "i int, g string, top double, draws array<double>")
    got = {(r["g"], r["level"]): r["exceedance"] for r in exceedance_levels(df, ["g"], "top", [1.0, 2.0]).collect()}
    assert got == {("a", 1.0): 1.0, ("a", 2.0): 0.5, ("b", 1.0): None, ("b", 2.0): None, ("c", 1.0): 1.0, ("c", 2.0): 0.0}


def test_values_are_counted_before_the_shuffle(spark):
    df = spark.range(1000).select((F.col("id") % 3).alias("g"), F.rand(1).alias("v"))
    plan = exceedance_curve(df, ["g"], "v", [0.1 * i for i in range(10)])._jdf.queryExecution().executedPlan().toString()
    assert "partial_count" in plan and "Python" not in plan
