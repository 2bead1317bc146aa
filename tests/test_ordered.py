import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from emberfield.operators.ordered import row_rank, split_ranges
from emberfield.operators.windows import ccdf, fill_down_up, rolling_mean, row_id


def series(spark, values):
    return spark.createDataFrame(list(enumerate(values)), "i int, v double")


def in_order(df, name, key="i"):
    return [r[0] for r in df.orderBy(key).select(name).collect()]


@pytest.mark.parametrize("method", ["window", "ranges"])
def test_rolling_edges_and_gaps(spark, method):
    df = series(spark, [1.0, None, 3.0, 4.0, 5.0])
    out = rolling_mean(df, {"m3": ("v", 3), "m2": ("v", 2)}, ["i"], method=method)
    assert in_order(out, "m3") == [None, None, None, 4.0, None]
    assert in_order(out, "m2") == [None, None, 3.5, 4.5, None]


def test_rolling_alignment(spark):
    df = series(spark, [1.0, 2.0, 3.0])
    assert in_order(rolling_mean(df, {"m": ("v", 2)}, ["i"], align="right"), "m") == [None, 1.5, 2.5]
    assert in_order(rolling_mean(df, {"m": ("v", 3)}, ["i"], align="left"), "m") == [2.0, None, None]
    with pytest.raises(ValueError):
        rolling_mean(df, {"m": ("v", 2)}, ["i"], align="up")


@pytest.mark.parametrize("method", ["window", "ranges"])
def test_fill(spark, method):
    out = fill_down_up(series(spark, [None, None, 3.0, None, 5.0]), ["v"], ["i"], method=method)
    assert in_order(out, "v") == [3.0, 3.0, 3.0, 3.0, 5.0]
    out = fill_down_up(series(spark, [None, None]), ["v"], ["i"], method=method)
    assert in_order(out, "v") == [None, None]


@pytest.mark.parametrize("method", ["window", "ranges"])
def test_ccdf_ties(spark, method):
    df = spark.createDataFrame([(1, 10.0), (2, 20.0), (3, 20.0), (4, 40.0)], "i int, v double")
    assert in_order(ccdf(df, [], "v", ["i"], method=method), "ccdf") == [1.0, 0.75, 0.5, 0.25]


def skewed(spark, partitions=4):
    """One group with a third of the rows, one value with a third of that, gaps, many small groups."""
    rng = np.random.default_rng(1)
    n = 6000
    group = np.where(rng.random(n) < 0.34, 0, rng.integers(1, 400, n))
    value = np.where(rng.random(n) < 0.33, 0.0, rng.integers(0, 500, n) / 4.0)
    pdf = pd.DataFrame({"i": np.arange(n), "g": group, "t": rng.integers(0, 50, n), "v": value})
    pdf.loc[rng.random(n) < 0.4, "v"] = np.nan
    df = spark.createDataFrame(pdf).withColumn("v", F.when(~F.isnan("v"), F.col("v")))
    df = df.withColumn("g", F.when(F.col("g") != 7, F.col("g")))
    return df.repartition(partitions)


@pytest.mark.parametrize("by", [[], ["g"]])
@pytest.mark.parametrize("partitions,ranges", [(1, 13), (13, 40)])
def test_ranges_equal_windows(spark, by, partitions, ranges):
    df = skewed(spark, partitions)
    order = ["t", "i"]
    columns = {"m2": ("v", 2), "m3": ("v", 3), "m7": ("v", 7)}
    pairs = [
        (rolling_mean(df, columns, order, by, method="window"), rolling_mean(df, columns, order, by, method="ranges", ranges=ranges)),
        (fill_down_up(df, ["v"], order, by, method="window"), fill_down_up(df, ["v"], order, by, method="ranges", ranges=ranges)),
        (ccdf(df, by, "v", ["i"], method="window"), ccdf(df, by, "v", ["i"], method="ranges", ranges=ranges)),
    ]
    for whole, cut in pairs:
        names = whole.columns
        rounded = [F.round(c, 9).alias(c) if c.startswith("m") else F.col(c) for c in names]
        a, b = whole.select(rounded), cut.select(rounded)
        assert a.count() == b.count() == 6000
        assert a.exceptAll(b).count() == 0


def test_fewer_rows_in_a_range_than_the_window_reaches(spark):
    df = series(spark, [float(i) for i in range(30)])
    a = in_order(rolling_mean(df, {"m": ("v", 9)}, ["i"], method="window"), "m")
    b = in_order(rolling_mean(df, {"m": ("v", 9)}, ["i"], method="ranges", ranges=25), "m")
    assert a == b


def test_ranges_split_a_hot_group(spark):
    cut = split_ranges(skewed(spark), ["g"], ["t", "i"], ranges=12)
    pieces = cut.rows.filter("g = 0").select("_range").distinct().count()
    assert pieces >= 3


def test_ranges_have_no_single_task_stage(spark):
    out = rolling_mean(skewed(spark), {"m": ("v", 3)}, ["t", "i"], method="ranges")
    plan = out._jdf.queryExecution().executedPlan().toString()
    main = [line for line in plan.splitlines() if "SinglePartition" in line]
    assert not main


def test_auto_cuts_hot_groups_only(spark, monkeypatch):
    from emberfield.operators import ordered, windows

    cuts = []
    real = ordered.split_ranges

    def spy(df, *a, **k):
        cuts.append(df.select("g").distinct().count())
        return real(df, *a, **k)

    monkeypatch.setattr(ordered, "split_ranges", spy)
    monkeypatch.setattr(windows, "split_ranges", spy)
    df = skewed(spark)
    row_rank(df, ["g"], ["t", "i"]).count()
    assert not cuts
    monkeypatch.setattr(ordered, "MAX_GROUP_ROWS", 1000)
    columns = {"m": ("v", 3)}
    for run in (
        lambda m: row_rank(df, ["g"], ["t", "i"], method=m),
        lambda m: fill_down_up(df, ["v"], ["t", "i"], ["g"], method=m),
        lambda m: rolling_mean(df, columns, ["t", "i"], ["g"], method=m),
    ):
        mixed, plain = run("auto"), run("window")
        assert mixed.columns == plain.columns and mixed.count() == 6000
        assert mixed.exceptAll(plain).count() == 0
    assert set(cuts) == {1}
    cuts.clear()
    row_rank(df, ["g"], ["t", "i"], largest=900).count()
    assert not cuts
    with pytest.raises(ValueError):
        row_rank(df, ["g"], ["t"], method="other")


def test_curve_properties(spark):
    rows = ccdf(skewed(spark).filter("v is not null"), ["g"], "v", ["i"], method="ranges", ranges=9).toPandas()
    for _, part in rows.groupby("g"):
        part = part.sort_values(["v", "i"])
        assert part.ccdf.iloc[0] == 1.0 and np.isclose(part.ccdf.iloc[-1], 1 / len(part))
        assert (np.diff(part.ccdf) < 0).all()


def test_row_id(spark):
    df = skewed(spark)
    ids = row_id(df, ["t", "i"], method="ranges").orderBy("t", "i").select("id").toPandas()["id"]
    assert list(ids) == list(range(1, 6001))


@pytest.mark.parametrize("method", ["window", "ranges"])
def test_display_order(spark, method):
    from emberfield.operators.ordered import display_order

    rows = [("high", "2020-01-02", 1), ("zero", None, 2), ("zero", "2020-01-05", 3), (None, "2019-01-01", 4), ("odd", "2020-01-01", 5), ("high", "2020-01-01", 6)]
    df = spark.createDataFrame(rows, "level string, day string, i int")
    got = display_order(df, [("level", ["zero", "high"]), "day", "i"], method=method).collect()
    assert [r["i"] for r in got] == [3, 2, 6, 1, 4, 5] and [r["position"] for r in got] == [1, 2, 3, 4, 5, 6]
