import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from emberfield.operators.categorical import (
    SITE_ALIASES, binary_recode, canonicalise, impact_since, impact_window, label, level_rank, lookup, order_levels_by, relevel, with_levels,
)
from emberfield.operators.clean import clip_range, filter_window
from emberfield.operators.curves import density_curve
from emberfield.operators.joins import assert_unique, join_daily, join_dimension, packed_contrast, paired_contrast
from emberfield.operators.quantiles import group_quantiles
from emberfield.operators.reshape import paired_unpivot, scenarios, stack_observed_predicted, to_long, union_by_name
from emberfield.operators.summary import coef_summary, exceedance, exceedance_packed, median_qi, median_qi_packed, scale_by_max


def test_quantiles_interpolate(spark):
    df = spark.createDataFrame([(1.0,), (2.0,), (9.0,)], "v double")
    for method in ("exact", "bracketed", "auto"):
        q = group_quantiles(df, [], "v", [0.5, 0.025, 0.975], method).first()
        assert q["n"] == 3 and q["q"] == pytest.approx([2.0, 1.05, 8.65])


@pytest.mark.parametrize("accuracy", [20, 100, 1000])
def test_bracketed_quantiles_are_exact(spark, accuracy):
    """Hot group, heavy ties, groups below and above the bracket threshold, missing values and keys."""
    rng = np.random.default_rng(2)
    n = 30000
    g = np.where(rng.random(n) < 0.4, 0, rng.integers(1, 60, n))
    v = np.where(rng.random(n) < 0.35, 0.0, np.round(rng.lognormal(2, 1.5, n), 3))
    pdf = pd.DataFrame({"g": g, "v": v})
    df = spark.createDataFrame(pdf).withColumn("g", F.when(F.col("g") != 5, F.col("g")))
    df = df.unionByName(df.limit(50).withColumn("v", F.lit(None).cast("double"))).repartition(7)
    probs = [0.0, 0.025, 0.3, 0.5, 0.975, 1.0]
    got = {r["g"]: (r["n"], r["q"]) for r in group_quantiles(df, ["g"], "v", probs, "bracketed", accuracy=accuracy).collect()}
    for key, part in pdf.groupby(pdf.g.where(pdf.g != 5), dropna=False):
        size, q = got[None if math.isnan(key) else int(key)]
        assert size == len(part)
        assert q == pytest.approx(list(np.quantile(part.v, probs)), rel=1e-12, abs=1e-12)


def test_extra_aggregates_ride_along(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 3.0), ("b", None)], "g string, v double")
    for method in ("exact", "bracketed", "approximate"):
        rows = {r["g"]: r for r in group_quantiles(df, ["g"], "v", [0.5], method, extra={"m": F.avg("v")}).collect()}
        assert rows["a"]["m"] == 2.0


def test_median_qi(spark):
    df = spark.createDataFrame([("a", 1.0, 1), ("a", 2.0, 1), ("a", 9.0, 2), ("b", None, 1), ("b", 4.0, 1)], "g string, v double, k int")
    rows = {r["g"]: r for r in median_qi(df, ["g"], "v").collect()}
    assert rows["a"]["lower"] == pytest.approx(1.05) and rows["a"]["upper"] == pytest.approx(8.65)
    assert rows["a"]["point"] == "median" and rows["a"]["interval"] == "qi" and rows["a"]["width"] == 0.95
    assert rows["b"]["value"] == 4.0
    strict = {r["g"]: r["value"] for r in median_qi(df, ["g"], "v", strict_nulls=True).collect()}
    assert strict == {"a": 2.0, "b": None}
    weighted = {r["g"]: r["value"] for r in median_qi(df, ["g"], "v", frequency="k").collect()}
    assert weighted["a"] == 5.5
    scaled = {r["g"]: r["value"] for r in median_qi(df, ["g"], F.pow(F.lit(10.0), "v")).collect()}
    assert scaled["a"] == pytest.approx(100.0)


def test_packed_forms(spark):
    rng = np.random.default_rng(3)
    draws = [rng.normal(size=k).tolist() for k in (1, 2, 7, 40)]
    df = spark.createDataFrame(list(enumerate(draws)), "id int, d array<double>")
    out = median_qi_packed(df, "d", scale=lambda v: F.exp(v)).orderBy("id").collect()
    for r, d in zip(out, draws):
        assert [r["value"], r["lower"], r["upper"]] == pytest.approx(list(np.quantile(np.exp(d), [0.5, 0.025, 0.975])))
    empty = spark.createDataFrame([(1, []), (2, None)], "id int, d array<double>")
    assert [r["value"] for r in median_qi_packed(empty, "d").collect()] == [None, None]
    share = exceedance_packed(spark.createDataFrame([([0.0, 199.0, 200.0, 500.0],)], "d array<double>"), "d", 200)
    assert share.first()["exceedance"] == 0.5


def test_exceedance(spark):
    df = spark.createDataFrame([("a", v) for v in (0.0, 199.0, 200.0, 500.0)] + [("a", None), ("b", 10.0)], "g string, v double")
    assert {r[0]: r[1] for r in exceedance(df, ["g"], "v", 200).collect()} == {"a": 0.5, "b": 0.0}
    got = {r[0]: r[1] for r in exceedance(df, ["g"], "v", {"a": 500.0, "b": 10.0}, "g").collect()}
    assert got == {"a": 0.25, "b": 1.0}
    shares = [exceedance(df, ["g"], "v", t).filter("g = 'a'").first()[1] for t in (0, 100, 200, 400, 600)]
    assert shares == sorted(shares, reverse=True)


def test_scale_by_max(spark):
    df = spark.createDataFrame([(0.0, 0.0, 1.0), (50.0, 0.0, None), (100.0, 0.0, 2.0)], "a double, z double, n double")
    out = scale_by_max(df, ["a", "z", "n"]).orderBy("a").collect()
    assert [r["a_scaled"] for r in out] == [0.0, 0.5, 1.0] and out[0]["a_max"] == 100.0
    assert [r["z_scaled"] for r in out] == [None] * 3
    assert [r["n_scaled"] for r in out] == [0.5, None, 1.0]
    assert [r["n_scaled"] for r in scale_by_max(df, ["n"], strict_nulls=True).collect()] == [None] * 3


def test_coef_summary(spark):
    rng = np.random.default_rng(4)
    beta = rng.normal(size=(200, 3))
    df = spark.createDataFrame([(b.tolist(),) for b in beta], "beta array<double>")
    for r in coef_summary(df, "beta", ["p", "q", "r"]).collect():
        col = beta[:, "pqr".index(r["term"])]
        assert [r["estimate"], r["error"]] == pytest.approx([col.mean(), col.std(ddof=1)])
        assert [r["lower"], r["upper"]] == pytest.approx(list(np.quantile(col, [0.025, 0.975])))


def test_density(spark):
    rng = np.random.default_rng(5)
    v = np.concatenate([rng.normal(0, 1, 3000), rng.normal(4, 0.5, 1000)])
    df = spark.createDataFrame(pd.DataFrame({"g": "a", "v": v})).unionByName(
        spark.createDataFrame([("c", 2.0), ("c", 2.0), ("one", 5.0)], "g string, v double"))
    curve = density_curve(df, ["g"], "v").toPandas()
    assert set(curve.g) == {"a", "c"}
    a = curve[curve.g == "a"].sort_values("x")
    assert len(a) == 256 and np.trapezoid(a.density, a.x) == pytest.approx(1.0, abs=2e-3)
    h = 0.9 * min(v.std(ddof=1), np.subtract(*np.quantile(v, [0.75, 0.25])) / 1.34) * len(v) ** -0.2
    direct = np.exp(-0.5 * ((a.x.values[:, None] - v) / h) ** 2).sum(axis=1) / (len(v) * h * math.sqrt(2 * math.pi))
    assert np.abs(a.density.values - direct).max() < 5e-4
    assert np.isfinite(curve.density).all()
    whole = density_curve(df.filter("g = 'a'"), [], "v").toPandas()
    assert np.allclose(np.sort(whole.density), np.sort(a.density))


def test_density_clip(spark):
    df = spark.createDataFrame([(float(i),) for i in range(100)], "v double")
    inside = density_curve(df, [], "v", clip=(20.0, None)).toPandas()
    kept = density_curve(df.filter("v >= 20"), [], "v").toPandas()
    assert np.allclose(np.sort(inside.x), np.sort(kept.x)) and clip_range(df, "v", 5, 8).count() == 4


def test_joins(spark):
    obs = spark.createDataFrame([(1, "a"), (2, None), (3, "x")], "id int, k string")
    dim = spark.createDataFrame([("a", 10), (None, 20)], "name string, v int")
    got = {r["id"]: r["v"] for r in join_dimension(obs, dim, "k", "name").collect()}
    assert got == {1: 10, 2: None, 3: None}
    got = {r["id"]: r["v"] for r in join_daily(obs, dim, [("k", "name")], null_safe=True).collect()}
    assert got == {1: 10, 2: 20, 3: None}
    with pytest.raises(ValueError, match="not unique"):
        join_daily(obs, dim.unionByName(dim), [("k", "name")])
    assert assert_unique(dim, ["name"]) is dim
    assert join_daily(obs, dim.withColumnRenamed("name", "k"), ["k"], check_size=False).columns == ["id", "k", "v"]


def test_contrasts(spark):
    rows = [(1, 0, "actual", 5.0), (1, 0, "counterfactual", 3.0), (1, 1, "actual", 2.0), (1, 1, "counterfactual", 2.5), (2, 0, "actual", 1.0)]
    df = spark.createDataFrame(rows, "id int, draw_id int, scenario string, value double")
    got = {(r["id"], r["draw_id"]): r["difference"] for r in paired_contrast(df, ["id", "draw_id"]).collect()}
    assert got == {(1, 0): 2.0, (1, 1): -0.5}
    packed = spark.createDataFrame([([5.0, 2.0], [3.0, 2.5])], "a array<double>, b array<double>")
    assert packed_contrast(packed, "a", "b").first()["difference"] == [2.0, -0.5]


def test_categories(spark):
    names = spark.createDataFrame([("NA Lake",), ("Maning River",), ("Wallis Lake",)], "s string")
    aliases = spark.createDataFrame(list(SITE_ALIASES.items()), "alias string, canonical string")
    assert sorted(r[0] for r in canonicalise(names, "s", aliases).collect()) == ["Manning River", "Pambula", "Wallis Lake"]
    codes = spark.createDataFrame([("high",), ("none",), (None,)], "c string")
    assert [r[0] for r in codes.select(label("c", {"high": "High"})).collect()] == ["High", None, None]
    assert [r[0] for r in codes.select(with_levels("c", ["high"])).collect()] == ["high", None, None]
    assert [r[0] for r in codes.select(level_rank("c", ["low", "high"])).collect()] == [1, None, None]
    assert [r[0] for r in codes.select(binary_recode("c", "high", "High", "Zero")).collect()] == ["High", "Zero", None]
    assert relevel(["a", "b", "c"], "b") == ["b", "a", "c"]
    with pytest.raises(ValueError):
        relevel(["a"], "z")
    sites = spark.createDataFrame([("s", -1.0), ("s", -3.0), ("t", -5.0), ("u", None)], "site string, lat double")
    ranks = {r["site"]: r["level_rank"] for r in order_levels_by(sites, "site", "lat", desc=True).collect()}
    assert ranks["s"] < ranks["t"]
    dim = spark.createDataFrame([("s", 1)], "site string, v int")
    assert sorted((r["site"], r["v"]) for r in lookup(sites, "site", dim, "site", ["v"]).collect())[0] == ("s", 1)


def test_impact(spark):
    days = spark.sql("SELECT explode(array(date'2020-04-06', date'2020-04-07', date'2020-06-07', date'2020-06-08')) AS d").coalesce(1)
    got = [r[0] for r in days.select(impact_window("d", "2020-04-07", "2020-06-07", "low")).collect()]
    assert got == ["zero", "low", "low", "zero"]
    stamps = days.select((F.col("d").cast("timestamp") + F.expr("interval 23 hours")).alias("d"))
    got = [r[0] for r in stamps.select(impact_window("d", "2020-04-07", "2020-06-07", "low")).collect()]
    assert got == ["zero", "low", "low", "zero"]
    df = spark.createDataFrame([("A", "2020-02-29", "med"), ("A", "2020-03-01", "med"), ("B", "2020-03-01", "med"), ("C", "2020-03-02", None)],
                               "site string, d string, base string").withColumn("d", F.to_date("d"))
    got = [r[0] for r in df.coalesce(1).select(impact_since("d", "2020-03-01", "base", "site", {"B": "high"})).collect()]
    assert got == ["zero", "med", "high", None]


def test_window_filter_reaches_the_scan(spark, tmp_path):
    path = str(tmp_path / "p")
    spark.sql("SELECT id, timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(id) AS ts FROM range(40)").write.parquet(path)
    df = filter_window(spark.read.parquet(path), "ts", "2024-01-10", "2024-01-20")
    assert df.count() == 11
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(ts" in plan and "LessThan(ts" in plan


def test_reshape(spark):
    df = spark.createDataFrame([(1, 1.0, 2016, 2.0, 2017)], "day int, jan double, jy int, feb double, fy int")
    rows = paired_unpivot(df, ["day"], [("Jan", "jan", "jy"), ("Feb", "feb", "fy")], "month", "rain", "year").collect()
    assert sorted((r["month"], r["rain"], r["year"]) for r in rows) == [("Feb", 2.0, 2017), ("Jan", 1.0, 2016)]
    assert to_long(df, ["day"], ["jan", "feb"]).count() == 2
    stacked = union_by_name(df.select("day", "jan"), df.select("day", "feb"))
    assert stacked.columns == ["day", "jan", "feb"] and stacked.count() == 2


def test_scenarios(spark):
    df = spark.createDataFrame([(1, "high", "k1"), (2, "low", "k2"), (3, None, "k3")], "id int, impact string, key string")
    out = scenarios(df, "impact")
    assert out.count() == 6 and out.filter("scenario = 'counterfactual' and impact = 'zero'").count() == 3
    assert out.filter("key is null").count() == 0
    with pytest.raises(ValueError):
        scenarios(df, "fire")


def test_scenarios_scan_once(spark, tmp_path):
    path = str(tmp_path / "s")
    spark.createDataFrame([(1, "high")], "id int, impact string").write.parquet(path)
    plan = scenarios(spark.read.parquet(path), "impact")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1


def test_stack(spark):
    obs = spark.createDataFrame([(1, 2.0)], "id int, y double")
    pred = spark.createDataFrame([(1, 0, 3.0), (1, 1, 4.0)], "id int, draw_id int, value double")
    rows = stack_observed_predicted(obs, pred, "y", ["id"]).collect()
    assert sorted((r["type"], r["value"]) for r in rows) == [("Observed", 2.0), ("Predicted", 3.0), ("Predicted", 4.0)]


def test_large_sides_are_not_broadcast(spark):
    from emberfield.session import broadcast_if_small

    small, large = spark.range(10), spark.range(1000)
    assert "broadcast" in broadcast_if_small(small, 100)._jdf.queryExecution().logical().toString().lower()
    assert "broadcast" not in broadcast_if_small(large, 100)._jdf.queryExecution().logical().toString().lower()


def test_sides_beyond_the_bound_give_the_same_rows(spark, monkeypatch):
    """Without any broadcast, hot keys and missing keys join as before."""
    from emberfield import session
    from emberfield.operators import joins, quantiles

    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plain = lambda df, *a: df
        monkeypatch.setattr(joins, "broadcast_if_small", plain)
        monkeypatch.setattr(quantiles, "broadcast_if_small", plain)
        obs = spark.range(3000).select("id", F.when(F.col("id") % 3 == 0, "hot").otherwise(F.col("id").cast("string")).alias("k"))
        dim = obs.groupBy("k").agg(F.max("id").alias("v"))
        out = join_daily(obs, dim, ["k"])
        assert out.count() == 3000 and out.filter("k = 'hot'").agg(F.min("v")).first()[0] == 2997
        q = group_quantiles(obs, ["k"], "id", [0.5], "bracketed", accuracy=50).filter("k = 'hot'").first()["q"][0]
        assert q == pytest.approx(1498.5)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert session.BROADCAST_CELLS > 0


@pytest.mark.parametrize("frequency", [None, "w"])
def test_quantile_methods_agree_on_odd_values(spark, frequency):
    """Infinite and missing values, NaN, weights of zero, below zero and missing: both methods, one answer."""
    from emberfield.operators.quantiles import group_quantiles

    inf, nan = float("inf"), float("nan")
    rows = [
        ("a", 2.0, 1), ("a", 3.0, 1), ("a", inf, 1), ("b", 2.0, 1), ("b", 3.0, 1), ("b", nan, 1), ("c", 1.0, 3), ("c", 5.0, 4), ("c", 9.0, 0),
        ("d", 1.0, 0), ("e", None, 2), ("f", 4.0, -1), ("f", 6.0, None), ("g", inf, 1), ("g", inf, 1), ("h", 1.0, 1), ("h", None, 5),
    ]
    df = spark.createDataFrame(rows, "k string, v double, w int")
    got = {
        m: {r["k"]: (r["n"], r["q"]) for r in group_quantiles(df, ["k"], "v", [0.5, 0.25], method=m, frequency=frequency).collect()}
        for m in ("exact", "bracketed")
    }
    assert got["exact"] == got["bracketed"] and len(got["exact"]) == 8
    assert got["exact"]["a"] == (3, [3.0, 2.5]) and got["exact"]["e"] == (0, None)
    assert got["exact"]["c"] == ((7, [5.0, 1.0]) if frequency else (3, [5.0, 3.0]))


def weighted_quantile(pairs, p):
    """By fractions over the sorted values, without unfolding."""
    from fractions import Fraction

    n = sum(w for _, w in pairs)
    place = (n - 1) * Fraction(str(p))
    low, found = int(place), []
    for rank in (low + 1, min(low + 2, n)):
        seen = 0
        for v, w in sorted(pairs):
            seen += w
            if seen >= rank:
                found.append(v)
                break
    a, b = found
    return a if a == b else float((1 - (place - low)) * Fraction(a) + (place - low) * Fraction(b))


@pytest.mark.parametrize("most,cells", [(1_000_000, 256), (50, 4), (3, 2)])
def test_weighted_quantiles_of_large_weights(spark, monkeypatch, most, cells):
    """Weights up to 10^12, ties, one value with most of the weight, brackets cut many times: exact."""
    import random

    from emberfield.operators import quantiles

    monkeypatch.setattr(quantiles, "CELLS", cells)
    rng = random.Random(4)
    groups = {
        "small": [(1.0, 10**9), (2.0, 10**9)], "one": [(5.0, 10**12)], "even": [(float(i), 10**12 + i) for i in range(200)],
        "ties": [(float(rng.randrange(5)), rng.randrange(1, 10**9)) for _ in range(300)], "hot": [(float(i), 1) for i in range(150)] + [(75.5, 10**12)] * 100,
        "wide": [(rng.choice([-1, 1]) * 10.0 ** rng.uniform(-200, 200), rng.randrange(1, 10**12)) for _ in range(200)], None: [(3.0, 7), (9.0, 2)],
    }
    df = spark.createDataFrame([(g, v, w) for g, rows in groups.items() for v, w in rows] + [("empty", None, 4), ("none", 1.0, 0)], "g string, v double, w long")
    probs = [0.5, 0.025, 0.975, 0.0, 1.0, 0.333]
    got = {r["g"]: r for r in quantiles.group_quantiles(df, ["g"], "v", probs, method="bracketed", frequency="w", max_exact_rows=most).collect()}
    assert set(got) == {*groups, "empty", "none"} and got["empty"]["n"] == got["none"]["n"] == 0 and got["empty"]["q"] is None
    for g, rows in groups.items():
        assert got[g]["n"] == sum(w for _, w in rows)
        assert got[g]["q"] == pytest.approx([weighted_quantile(rows, p) for p in probs], rel=1e-9)
    all_rows = [x for rows in groups.values() for x in rows]
    whole = quantiles.group_quantiles(df, [], "v", [0.5], method="bracketed", frequency="w", max_exact_rows=most).collect()
    assert len(whole) == 1 and whole[0]["q"] == pytest.approx([weighted_quantile(all_rows, 0.5)])


def test_weighted_intervals_beyond_long_totals(spark):
    """Totals of 10^20 to 10^23, beyond 64 bits and 20 digits: ranks and shares between neighbours stay exact."""
    from emberfield.operators import quantiles

    big = 4 * 10**18
    groups = {
        "even": [(float(i), big) for i in range(30)], "many": [(float(i % 1000), big + i) for i in range(30_000)],
        # The median falls between the two halves of the weight, so the share between neighbours shows.
        "halves": [(float(i), big) for i in range(50)] + [(100.0 + i, big) for i in range(50)], "light": [(1.0, 1), (2.0, 1), (4.0, 2)],
    }
    df = spark.createDataFrame([(g, v, w) for g, rows in groups.items() for v, w in rows], "g string, v double, w long")
    for most in (1_000_000, 20):
        got = {r["g"]: r["q"] for r in quantiles.group_quantiles(df, ["g"], "v", [0.5, 0.025, 0.975, 0.0, 1.0, 1 / 3], method="bracketed", frequency="w", max_exact_rows=most).drop("n").collect()}
        for g, rows in groups.items():
            assert got[g] == pytest.approx([weighted_quantile(rows, p) for p in (0.5, 0.025, 0.975, 0.0, 1.0, 1 / 3)], rel=1e-12)
    cells = {r["g"]: (r["value"], r["lower"], r["upper"]) for r in median_qi(df, ["g"], "v", frequency="w", method="bracketed").collect()}
    assert cells["even"] == (14.5, 0.0, 29.0) and cells["halves"] == (74.5, 2.0, 147.0)


@pytest.mark.parametrize("most,passes", [(10_000, 2), (5, 3)])
def test_weighted_quantiles_read_the_rows_few_times(spark, monkeypatch, most, passes):
    """The rows may be predictions made anew by each pass: however many levels of brackets, they are read at most three times."""
    from emberfield.operators import quantiles

    monkeypatch.setattr(quantiles, "CELLS", 4)
    seen, n = spark.sparkContext.accumulator(0), 2000

    def count(batches):
        for b in batches:
            seen.add(len(b))
            yield b

    rows = [("ab"[i % 2], float(i * 7919 % n), 1 + i % 3) for i in range(n)]
    df = spark.createDataFrame(rows, "g string, v double, w int").mapInPandas(count, "g string, v double, w int")
    got = {r["g"]: r["q"] for r in quantiles.group_quantiles(df, ["g"], "v", [0.5, 0.025], "bracketed", "w", max_exact_rows=most).collect()}
    for g in "ab":
        pairs = [(v, w) for k, v, w in rows if k == g]
        assert got[g] == pytest.approx([weighted_quantile(pairs, p) for p in (0.5, 0.025)])
    assert seen.value <= passes * n


def test_packed_forms_skip_missing_draws(spark):
    df = spark.createDataFrame([(1, [None, 1.0, 2.0, 9.0]), (2, [None]), (3, [])], "i int, d array<double>")
    long = df.select("i", F.explode_outer("d").alias("v"))
    packed = {r["i"]: (r["value"], r["lower"], r["upper"]) for r in median_qi_packed(df, "d").collect()}
    assert packed[1] == pytest.approx((2.0, 1.05, 8.65)) and packed[2] == packed[3] == (None, None, None)
    want = {r["i"]: r["exceedance"] for r in exceedance(long, ["i"], "v", 2.0).collect()}
    assert {r["i"]: r["exceedance"] for r in exceedance_packed(df, "d", 2.0).collect()} == pytest.approx(want)


def test_missing_dates_and_codes_stay_missing(spark):
    from emberfield.operators.categorical import binary_recode, impact_since, impact_window

    df = spark.createDataFrame([(None, "x"), ("2024-01-01", None), ("2024-02-01", "y")], "d string, c string").withColumn("d", F.to_date("d"))
    got = df.select(impact_since("d", "2024-01-15", "c").alias("a"), impact_window("d", "2024-01-15", None).alias("b"), binary_recode("c", "x", "yes", "no").alias("e")).collect()
    assert [tuple(r) for r in got] == [(None, None, "yes"), ("zero", "zero", None), ("y", "high", "no")]


@pytest.mark.parametrize("method", ["window", "ranges"])
def test_missing_values_have_no_share(spark, method):
    from emberfield.operators.windows import ccdf

    df = spark.createDataFrame([("a", None, 1), ("a", 5.0, 2), ("a", 7.0, 3), ("b", None, 4)], "g string, v double, i int")
    got = {r["i"]: r["ccdf"] for r in ccdf(df, ["g"], "v", ["i"], method=method).collect()}
    assert got == {1: None, 2: 1.0, 3: 0.5, 4: None}
