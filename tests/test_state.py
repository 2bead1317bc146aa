"""Fits from kept sums against fits of all rows."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from emberfield.model import state as st
from emberfield.model.fit import fit_hurdle_lognormal, fit_lognormal
from emberfield.model.splines import learn_psplines

SPEC = {"linear": ["a"], "factors": {"f": ["x", "y", "z"]}}


def yearly(spark, n=2000, seed=5, far=0.0):
    rng = np.random.default_rng(seed)
    year = rng.choice([2018, 2019, 2020, 2021], n, p=[0.1, 0.1, 0.7, 0.1])
    a = rng.normal(size=n) + far + (year - 2019)
    f = rng.choice(["x", "y", "z"], n)
    v = np.exp(0.5 + 0.3 * (a - far) + (f == "y") + 0.2 * rng.normal(size=n))
    v[rng.uniform(size=n) < 0.1] = 0.0
    pdf = pd.DataFrame({"year": year, "a": a, "f": f, "v": v})
    return spark.createDataFrame(pdf).repartition(7), pdf


def same(one, two, tol=1e-9):
    assert one.beta == pytest.approx(two.beta, rel=tol, abs=tol) and one.sigma == pytest.approx(two.sigma, rel=tol)
    assert np.allclose(one.slopes_cov, two.slopes_cov, rtol=1e-7, atol=1e-12)
    assert (one.rows, one.zeros, one.dropped, one.names) == (two.rows, two.zeros, two.dropped, two.names)


@pytest.mark.parametrize("far", [0.0, 1e6])
def test_add_and_take_back(spark, tmp_path, far):
    df, _ = yearly(spark, far=far)
    df = df.withColumn("f", F.when(F.rand(1) < 0.05, F.lit("odd")).otherwise(F.col("f")))
    df = spark.createDataFrame(df.toPandas()).repartition(5)
    path = str(tmp_path / "state")
    st.save_state(st.fit_state(df.filter("year < 2021"), "v", SPEC, "year"), path)
    early = st.fit_from_state(st.read_state(spark, path), "v", SPEC, hurdle=True)
    same(early, fit_hurdle_lognormal(df.filter("year < 2021"), "v", SPEC), 1e-9 if not far else 1e-7)
    st.save_state(st.fit_state(df.filter("year = 2021"), "v", SPEC, "year"), path)
    assert st.read_state(spark, path).count() == 4
    same(st.fit_from_state(st.read_state(spark, path), "v", SPEC), fit_lognormal(df, "v", SPEC), 1e-9 if not far else 1e-7)
    back = st.fit_from_state(st.read_state(spark, path, without=["2021"]), "v", SPEC, hurdle=True)
    # The same sums, in whichever order the tasks came.
    same(back, early, 1e-9 if not far else 1e-7)
    again = st.fit_from_state(st.read_state(spark, path, without=["2020", "2018"]), "v", SPEC)
    same(again, fit_lognormal(df.filter("year IN (2019, 2021)"), "v", SPEC), 1e-9 if not far else 1e-7)


def test_a_part_is_replaced(spark, tmp_path):
    df, _ = yearly(spark)
    path = str(tmp_path / "state")
    st.save_state(st.fit_state(df, "v", SPEC, "year"), path)
    st.save_state(st.fit_state(df.filter("year = 2020 AND a > 1"), "v", SPEC, "year"), path)
    same(st.fit_from_state(st.read_state(spark, path), "v", SPEC), fit_lognormal(df.filter("year <> 2020 OR a > 1"), "v", SPEC))


def test_parts_left_out_are_not_opened(spark, tmp_path):
    df, _ = yearly(spark)
    path = str(tmp_path / "state")
    st.save_state(st.fit_state(df, "v", SPEC, "year"), path)
    plan = st.read_state(spark, path, without=["2020"])._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and "p2020" in plan.split("PartitionFilters")[1].split("]")[0]


def test_merged_in_any_way(spark, monkeypatch):
    """One part per row, more parts than a task holds: nothing is lost, and every part ends as one row."""
    monkeypatch.setattr(st, "HELD", 3)
    df, pdf = yearly(spark, 300)
    df = df.withColumn("part", F.pmod(F.xxhash64("a"), F.lit(37)))
    state = st.fit_state(df, "v", SPEC, "part")
    parts = [r["part"] for r in state.select("part").collect()]
    assert len(parts) == len(set(parts)) == df.select("part").distinct().count()
    same(st.fit_from_state(state, "v", SPEC), fit_lognormal(df, "v", SPEC))
    halves = [st.fit_state(df.filter(c), "v", SPEC, "part") for c in ("a < 0", "a >= 0")]
    both = st.merge_states(*halves)
    assert both.count() == len(parts)
    same(st.fit_from_state(both, "v", SPEC), fit_lognormal(df, "v", SPEC))


def test_moments_equal_numpy(spark):
    df, pdf = yearly(spark)
    got = st.moments(st.fit_state(df, "v", {"linear": ["a"]}, "year")).toPandas().set_index(["part", "i", "j"])
    for year, rows in pdf[pdf.v > 0].groupby("year"):
        Z = np.column_stack([rows.a, np.log(rows.v)])
        C = Z - Z.mean(axis=0)
        for i, j in ((0, 0), (0, 1), (1, 1)):
            cell = got.loc[(str(year), i, j)]
            assert cell["rows"] == len(rows) and cell["product"] == pytest.approx((C.T @ C)[i, j], rel=1e-9)
            assert (cell.mean_i, cell.mean_j) == (pytest.approx(Z[:, i].mean()), pytest.approx(Z[:, j].mean()))


def test_odd_rows(spark):
    """Missing parts, parts without a used row, missing responses, an empty table, another design, and columns named as those of a state."""
    rows = [("p", 1.0, "x", 2.0), ("p", 2.0, "y", 3.0), (None, 3.0, "z", 4.0), (None, 5.0, "x", 1.0), ("q", None, "x", 1.0), ("q", 1.0, "x", 0.0), ("q", 1.0, "x", None), ("q", 1.0, "x", -1.0)]
    df = spark.createDataFrame(rows, "part string, a double, f string, v double").withColumns({"rows": F.lit(1), "kind": F.lit("k"), "z": F.lit(9), "mean": F.lit(0)})
    state = st.fit_state(df, "v", {"linear": ["a"]}, "part")
    found = {r["part"]: (r["rows"], r["zeros"], r["dropped"]) for r in state.collect()}
    assert found == {"p": (2, 0, 0), None: (2, 0, 0), "q": (0, 1, 3)}
    same(st.fit_from_state(state, "v", {"linear": ["a"]}, hurdle=True), fit_hurdle_lognormal(df, "v", {"linear": ["a"]}))
    empty = st.fit_state(df.limit(0), "v", {"linear": ["a"]}, "part")
    assert empty.count() == 0
    for nothing in (empty, state.filter("part = 'q'")):
        with pytest.raises(ValueError, match="no complete rows"):
            st.fit_from_state(nothing, "v", {"linear": ["a"]})
    with pytest.raises(ValueError, match="another design"):
        st.fit_from_state(state, "v", SPEC)


def test_smooths_settle_from_the_state(spark):
    df, _ = yearly(spark)
    spec = {"psplines": learn_psplines(df, ["a"], segments=8), "factors": {"f": ["x", "y", "z"]}}
    one, two = st.fit_from_state(st.fit_state(df, "v", spec, "year"), "v", spec), fit_lognormal(df, "v", spec)
    assert one.beta == pytest.approx(two.beta, abs=1e-7) and one.sds["smooth:a"] == pytest.approx(two.sds["smooth:a"], rel=1e-6)
