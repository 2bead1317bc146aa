import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from emberfield.functions import (
    as_number, build_date, build_date_named, is_finite_log, ln_positive, log10_positive, month_number, paste, pow10, scale_units,
    standard_normal, noise_words, student_t, uniform, week_index,
)
from emberfield.functions.rng import standard_normal_np, student_t_np, uniform_np


def column(spark, rows, schema, expr):
    df = spark.createDataFrame(rows, schema).coalesce(1)
    return [r[0] for r in df.select(expr).collect()]


def test_lenient_number(spark):
    got = column(spark, [("12.8",), (",",), (None,), ("-3",)], "a string", as_number("a"))
    assert got == [12.8, None, None, -3.0]


def test_logs_have_no_infinity(spark):
    rows = [(100.0,), (0.0,), (-1.0,), (None,)]
    assert column(spark, rows, "a double", log10_positive("a")) == [2.0, None, None, None]
    assert column(spark, rows, "a double", ln_positive("a"))[1:] == [None, None, None]
    assert column(spark, rows, "a double", is_finite_log("a")) == [True, False, False, False]
    assert column(spark, [(2.0,)], "a double", pow10("a")) == [100.0]
    assert column(spark, [(2.0,)], "a double", scale_units("a", 2.5)) == [5.0]


def test_paste_reads_missing_as_na(spark):
    got = column(spark, [(None, "Lake"), ("Maning", "River")], "a string, b string", paste("a", "b", sep=" "))
    assert got == ["NA Lake", "Maning River"]
    assert column(spark, [(None, "x")], "a string, b string", paste("a", "b")) == ["NAx"]


def test_dates(spark):
    got = column(spark, [(2019, 2, 30), (2016, 9, 1), (2020, None, 1)], "y int, m int, d int", build_date("y", "m", "d"))
    assert got == [None, dt.date(2016, 9, 1), None]
    rows = [("2019", "Feb", "30"), ("2016", "Sept", "1"), ("2016", "Sep", "1"), ("x", "Jan", "1")]
    assert column(spark, rows, "y string, m string, d string", build_date_named("y", "m", "d")) == [None, dt.date(2016, 9, 1), None, None]
    assert column(spark, [("Jan",), ("Dec",), ("?",), (None,)], "m string", month_number("m")) == [1, 12, None, None]


def test_week_index(spark):
    days = [(dt.date(2020, 1, d),) for d in (1, 7, 8, 15)]
    assert column(spark, days, "d date", week_index("d", F.lit(dt.date(2020, 1, 1)))) == [0, 0, 1, 2]


def test_noise_equals_its_numpy_twin(spark):
    df = spark.range(50).withColumn("w", noise_words(F.col("id"), F.lit("actual"), seed=3))
    df = df.withColumn("d", F.explode(F.sequence(F.lit(0), F.lit(39))))
    nu = F.lit(4.5)
    rows = df.select("id", "w", "d", uniform(F.col("w.c"), F.col("d")).alias("u"), standard_normal(F.col("w"), F.col("d")).alias("z"),
                     student_t(F.col("w"), F.col("d"), nu).alias("t")).orderBy("id", "d").collect()
    first = rows[::40]
    a, b, c = (np.array([r["w"][k] for r in first]) for k in "abc")
    draws = np.arange(40)
    assert np.array_equal(uniform_np(c, draws).ravel(), [r["u"] for r in rows])
    assert np.allclose(standard_normal_np(a, b, draws).ravel(), [r["z"] for r in rows], rtol=1e-12, atol=1e-13)
    assert np.allclose(student_t_np(a, b, draws, np.full(40, 4.5)).ravel(), [r["t"] for r in rows], rtol=1e-11, atol=1e-12)


def test_noise_has_the_right_shape():
    rng = np.random.default_rng(0)
    a, b = rng.integers(0, 2**32, 400), rng.integers(0, 2**32, 400)
    u = uniform_np(a, np.arange(500))
    assert abs(u.mean() - 0.5) < 0.003 and abs(u.var() - 1 / 12) < 0.001
    assert abs(np.corrcoef(u[:, :-1].ravel(), u[:, 1:].ravel())[0, 1]) < 0.01
    z = standard_normal_np(a, b, np.arange(500))
    assert abs(z.mean()) < 0.01 and abs(z.std() - 1) < 0.01
    t = student_t_np(a, b, np.arange(500), np.full(500, 5.0))
    assert abs(t.var() - 5 / 3) < 0.05
    # Quantile of the t distribution with five degrees of freedom.
    assert np.quantile(t, 0.975) == pytest.approx(2.5706, abs=0.04)
