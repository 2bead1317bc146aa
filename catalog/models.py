"""Queries for designs, fits, predictions and the scenario contrast."""

from __future__ import annotations

import datetime as dt

import numpy as np
from pyspark.sql import functions as F

from emberfield.functions import pow10
from emberfield.functions.rng import MASK, MULTIPLIER, STEP
from emberfield.model.design import design, learn_levels, learn_smooths, terms
from emberfield.model.effects import conditional_effects, effect_grid
from emberfield.model.fit import Draws, fit_hurdle_lognormal, fit_lognormal, fit_student
from emberfield.model.gram import gram, gram_sql
from emberfield.model.sites import fit_sites, site_sums
from emberfield.model.splines import bspline_columns, learn_psplines
from emberfield.model.state import fit_from_state, fit_state, moments
from emberfield.operators.categorical import impact_window, lookup
from emberfield.operators.clean import filter_window
from emberfield.operators.joins import paired_contrast, packed_contrast
from emberfield.operators.ordered import display_order, largest_group
from emberfield.operators.reshape import explode_draws
from emberfield.operators.summary import back_transform, median_qi, median_qi_packed, scale_by_max
from emberfield.plans.contrast import ccdf_table, difference_curve, exceedance_levels, exceedance_table, interval_table, level_table, predict_pairs, predict_scenarios, prediction_curve
from emberfield.session import durable

from .common import IMPACT_ORDER, KIND_IMPACT, SAMPLES_SQL, WINDOW_END, WINDOW_START, case_sql, kinds, query, r, rq, samples, table
from .summaries import density_sql, interval_sql, rounded

# ---------------------------------------------------------------- predictions with given draws

SEED = 7
SPEC = {"linear": ["day_part"], "factors": {"impact": IMPACT_ORDER}}
# A set of draws by formula, so that SQL can state the same ones: base and slope in draw number.
BETA = [(1.2, 0.001), (0.3, -0.002), (0.1, 0.001), (0.25, 0.002), (0.5, 0.004)]
SIGMA, NU, HU, SD_SITE = (0.4, 0.001), (4.0, 0.1), (0.1, 0.001), (0.3, 0.001)
KNOWN = ["click", "error", "view"]


def given_draws(m: int) -> Draws:
    n = np.arange(m, dtype=np.float64)
    line = lambda ab: ab[0] + ab[1] * n
    return Draws(np.column_stack([line(ab) for ab in BETA]), line(SIGMA), line(NU), line(HU), line(SD_SITE))


def impacted(spark, d):
    """Samples with the impact level of their kind and the time of day."""
    s = lookup(samples(spark, d), "kind", kinds(spark), "kind_name", ["kind_impact"])
    return s.withColumnsRenamed({"kind_impact": "impact"}).withColumn("day_part", F.hour("ts") / F.lit(24.0))


def predicted(spark, d, family: str, m: int, packed: bool, site: bool = False, extra=None):
    obs = impacted(spark, d) if extra is None else extra
    # The file column carries the window, so the filter reaches the scan.
    obs = filter_window(obs, "ts", WINDOW_START, WINDOW_END)
    keep = [c for c in ("obs_id", "date", "kind", "impact", "day_part", "count_max") if c in obs.columns]
    return predict_scenarios(
        obs.select(*keep), SPEC, given_draws(m), family, "obs_id", "impact", "date", seed=SEED,
        site="kind" if site else None, known_sites=KNOWN, packed=packed)


def value_range(spark, d, by: list[str], m: int) -> int:
    """Predicted values in the largest group, without making them."""
    obs = filter_window(impacted(spark, d), "ts", WINDOW_START, WINDOW_END)
    return m * (obs.count() if by == ["impact"] else largest_group(obs, by))


def line_sql(ab, d="d") -> str:
    return f"({ab[0]}e0 + {ab[1]}e0 * CAST({d} AS DOUBLE))"


def mix_sql(word: str, name: str, draw: str = "draw_id") -> str:
    """Lateral aliases that end in the uniform number ``name``."""
    step = lambda x: f"(xor({x}, {x} >> 16) * {MULTIPLIER}) & {MASK}"
    return (f"({word} + {draw} * {STEP}) & {MASK} AS {name}0, {step(name + '0')} AS {name}1, {step(name + '1')} AS {name}2, "
            f"(CAST(xor({name}2, {name}2 >> 16) AS DOUBLE) + 0.5e0) / 4294967296e0 AS {name}")


def word_sql(text: str, i: int) -> str:
    return f"CAST('0x' || substr(md5({text}), {1 + 8 * i}, 8) AS BIGINT)"


NORMAL = "sqrt(-2e0 * ln({u})) * cos(2e0 * pi() * {v})"


def prediction_sql(family: str, m: int, site: bool = False) -> str:
    """CTEs ending in ``p``: obs_id, date, kind, scenario, impact, draw_id, value."""
    key = f"CAST(obs_id AS VARCHAR) || ':' || scenario || ':{SEED}'"
    place = f"'site:' || kind || ':{SEED}'"
    eta = "b0 + day_part * b1 + (CASE WHEN impact = 'low' THEN b2 WHEN impact = 'med' THEN b3 WHEN impact = 'high' THEN b4 ELSE 0e0 END)"
    if site:
        known = ", ".join(f"'{k}'" for k in KNOWN)
        eta += f" + (CASE WHEN kind NOT IN ({known}) THEN sd_site * {NORMAL.format(u='us', v='vs')} ELSE 0e0 END)"
    normal = NORMAL.format(u="ua", v="ub")
    if family == "student":
        value = f"{eta} + sigma * sqrt(nu * (pow(ua, -2e0 / nu) - 1)) * cos(2e0 * pi() * ub)"
    elif family == "lognormal":
        value = f"exp({eta} + sigma * {normal})"
    else:
        value = f"CASE WHEN uc < hu THEN 0e0 ELSE exp({eta} + sigma * {normal}) END"
    betas = ", ".join(f"{line_sql(ab)} AS b{i}" for i, ab in enumerate(BETA))
    return f"""o AS (SELECT obs_id, date, kind, {case_sql('kind', KIND_IMPACT)} AS impact, hour(ts) / 24e0 AS day_part
  FROM ({SAMPLES_SQL}) WHERE date BETWEEN DATE '{WINDOW_START}' AND DATE '{WINDOW_END}'),
sc AS (SELECT *, 'actual' AS scenario FROM o UNION ALL SELECT obs_id, date, kind, 'zero', day_part, 'counterfactual' FROM o),
dr AS (SELECT CAST(d AS BIGINT) AS draw_id, {betas}, {line_sql(SIGMA)} AS sigma, {line_sql(NU)} AS nu, {line_sql(HU)} AS hu, {line_sql(SD_SITE)} AS sd_site
  FROM range({m}) t(d)),
wd AS (SELECT *, {word_sql(key, 0)} AS wa, {word_sql(key, 1)} AS wb, {word_sql(key, 2)} AS wc, {word_sql(place, 0)} AS sa, {word_sql(place, 1)} AS sb FROM sc),
un AS (SELECT wd.*, dr.*, {mix_sql('wa', 'ua')}, {mix_sql('wb', 'ub')}, {mix_sql('wc', 'uc')}, {mix_sql('sa', 'us')}, {mix_sql('sb', 'vs')} FROM wd, dr),
p AS (SELECT obs_id, date, kind, scenario, impact, draw_id, {value} AS value FROM un)"""


PREDICTED = f"SELECT obs_id, scenario, draw_id, {rq('value')} AS value FROM p"


def long_rows(df):
    return df.select("obs_id", "scenario", F.col("draw_id").cast("bigint"), r("value").alias("value"))


@query("predict_draws", f"WITH {prediction_sql('student', 20)} {PREDICTED}")
def student_long(spark, d):
    return long_rows(predicted(spark, d, "student", 20, packed=False))


@query("predict_draws_lognormal", f"WITH {prediction_sql('lognormal', 20)} {PREDICTED}")
def lognormal_long(spark, d):
    return long_rows(predicted(spark, d, "lognormal", 20, packed=False))


@query("predict_draws_hurdle", f"WITH {prediction_sql('hurdle_lognormal', 20)} {PREDICTED}")
def hurdle_long(spark, d):
    return long_rows(predicted(spark, d, "hurdle_lognormal", 20, packed=False))


@query("predict_packed", f"WITH {prediction_sql('student', 20)} {PREDICTED}")
def student_packed(spark, d):
    return long_rows(explode_draws(predicted(spark, d, "student", 20, packed=True), "draws"))


@query("predict_packed_hurdle", f"WITH {prediction_sql('hurdle_lognormal', 20)} {PREDICTED}")
def hurdle_packed(spark, d):
    return long_rows(explode_draws(predicted(spark, d, "hurdle_lognormal", 20, packed=True), "draws"))


@query("predict_new_level", f"WITH {prediction_sql('student', 20, site=True)} {PREDICTED}")
def new_level_long(spark, d):
    return long_rows(predicted(spark, d, "student", 20, packed=False, site=True))


@query("predict_new_level_packed", f"WITH {prediction_sql('lognormal', 20, site=True)} {PREDICTED}")
def new_level_packed(spark, d):
    return long_rows(explode_draws(predicted(spark, d, "lognormal", 20, packed=True, site=True), "draws"))


PAIRS_SQL = """SELECT obs_id, kind, draw_id, max(CASE WHEN scenario = 'actual' THEN value END) - max(CASE WHEN scenario = 'counterfactual' THEN value END) AS difference
FROM p GROUP BY obs_id, kind, draw_id"""


@query("paired_contrast", f"WITH {prediction_sql('student', 20)} SELECT obs_id, draw_id, {rq('difference')} AS difference FROM ({PAIRS_SQL})")
def contrast(spark, d):
    pairs = paired_contrast(predicted(spark, d, "student", 20, packed=False), ["obs_id", "draw_id"])
    return pairs.select("obs_id", F.col("draw_id").cast("bigint"), r("difference").alias("difference"))


@query("packed_contrast", f"WITH {prediction_sql('student', 20)} SELECT obs_id, draw_id, {rq('difference')} AS difference FROM ({PAIRS_SQL})")
def contrast_packed(spark, d):
    """Both scenarios of an observation in one row, so the difference is row-local."""
    obs = filter_window(impacted(spark, d), "ts", WINDOW_START, WINDOW_END).select("obs_id", "date", "impact", "day_part")
    pairs = predict_pairs(obs, SPEC, given_draws(20), "student", "obs_id", "impact", "date", seed=SEED)
    long = explode_draws(packed_contrast(pairs, "actual", "counterfactual").select("obs_id", "difference"), "difference")
    return long.select("obs_id", F.col("draw_id").cast("bigint"), r("value").alias("difference"))


@query("back_transform", f"WITH {prediction_sql('student', 20)} SELECT obs_id, scenario, draw_id, {rq('pow(10, value) * 3', 4)} AS value FROM p")
def counts(spark, d):
    p = predicted(spark, d, "student", 20, packed=False)
    v = back_transform("value", F.lit(3.0), log10=True)
    return p.select("obs_id", "scenario", F.col("draw_id").cast("bigint"), r(v, 4).alias("value"))


# ---------------------------------------------------------------- summaries of predictions

BY_OBS = f"WITH {prediction_sql('student', 50)} {interval_sql('p', 'obs_id, scenario', 'value')}"


@query("median_qi_by_obs", BY_OBS)
def intervals_long(spark, d):
    """A group holds one value per draw, so the exact aggregate is bounded."""
    p = predicted(spark, d, "student", 50, packed=False)
    return rounded(median_qi(p, ["obs_id", "scenario"], "value", method="exact"))


@query("median_qi_by_obs_packed", BY_OBS)
def intervals_packed(spark, d):
    p = predicted(spark, d, "student", 50, packed=True)
    return rounded(median_qi_packed(p, "draws").select("obs_id", "scenario", "value", "lower", "upper", "width", "point", "interval"))


@query("impact_contrast", f"""WITH {prediction_sql('student', 50)},
st AS (SELECT 'Predicted' AS type, impact, value FROM p UNION ALL
  SELECT 'Observed', {case_sql('kind', KIND_IMPACT)}, log10(count) FROM ({SAMPLES_SQL}) WHERE date BETWEEN DATE '{WINDOW_START}' AND DATE '{WINDOW_END}' AND count > 0)
{interval_sql('st', 'type, impact', 'pow(10, value)', 4)}""")
def impact_contrast(spark, d):
    """Counts observed and predicted by impact level, with the event and without it."""
    obs = filter_window(impacted(spark, d), "ts", WINDOW_START, WINDOW_END).filter(F.col("count") > 0)
    p = predicted(spark, d, "student", 50, packed=False)
    out = interval_table(obs, p, F.log10("count"), "impact", pow10("value"), largest=value_range(spark, d, ["impact"], 50))
    return rounded(out, 4)


@query("impact_contrast_copied", f"""WITH {prediction_sql('student', 20)},
ob AS (SELECT log10(count) AS value, {case_sql('kind', KIND_IMPACT)} AS impact FROM ({SAMPLES_SQL}) WHERE date BETWEEN DATE '{WINDOW_START}' AND DATE '{WINDOW_END}' AND count > 0),
st AS (SELECT 'Predicted' AS type, impact, value FROM p UNION ALL SELECT 'Observed', impact, value FROM ob, range(20) UNION ALL SELECT 'Observed', 'zero', value FROM ob, range(20))
{interval_sql('st', 'type, impact', 'value')}""")
def impact_contrast_copied(spark, d):
    """Each observation once per draw, and once more under the level zero."""
    obs = filter_window(impacted(spark, d), "ts", WINDOW_START, WINDOW_END).filter(F.col("count") > 0)
    p = predicted(spark, d, "student", 20, packed=False)
    out = interval_table(obs, p, F.log10("count"), "impact", largest=value_range(spark, d, ["impact"], 20), observed_copies=20)
    return rounded(out)


@query("level_intervals", f"WITH {prediction_sql('student', 50)} {interval_sql('p', 'impact', 'value')}")
def level_intervals(spark, d):
    p = predicted(spark, d, "student", 50, packed=False)
    return rounded(level_table(p, "impact", largest=value_range(spark, d, ["impact"], 50)))


CCDF_OF_MEDIANS = f"""WITH {prediction_sql('student', 50)},
md AS (SELECT obs_id, scenario, impact, quantile_cont(pow(10, value), CAST(0.5 AS DOUBLE)) AS value FROM p GROUP BY 1, 2, 3)
SELECT obs_id, scenario, impact, {rq('value', 4)} AS value,
{rq('CAST(count(*) OVER (PARTITION BY impact) - row_number() OVER (PARTITION BY impact ORDER BY value, obs_id, scenario) + 1 AS DOUBLE) / count(*) OVER (PARTITION BY impact)', 9)} AS ccdf FROM md"""


@query("ccdf_of_medians", CCDF_OF_MEDIANS)
def ccdf_of_medians(spark, d):
    p = predicted(spark, d, "student", 50, packed=True)
    out = ccdf_table(p, ["obs_id", "scenario"], "impact", largest=value_range(spark, d, ["impact"], 1))
    return out.select("obs_id", "scenario", "impact", r("value", 4).alias("value"), r("ccdf", 9).alias("ccdf"))


@query("predicted_density", f"WITH {prediction_sql('student', 20)} {density_sql('p', 'impact', 'value', 9)}")
def predicted_density(spark, d):
    p = predicted(spark, d, "student", 20, packed=False)
    out = prediction_curve(p, ["impact"], largest=value_range(spark, d, ["impact"], 20))
    return out.select("impact", r("x").alias("x"), r("density", 9).alias("density"))


@query("difference_density", f"WITH {prediction_sql('student', 20)}, df AS ({PAIRS_SQL}) {density_sql('df', 'kind', 'difference', 9)}")
def difference_density(spark, d):
    p = predicted(spark, d, "student", 20, packed=False)
    out = difference_curve(p, ["obs_id"], ["kind"], largest=value_range(spark, d, ["kind"], 20))
    return out.select("kind", r("x").alias("x"), r("density", 9).alias("density"))


HIT_SQL = PAIRS_SQL.replace("FROM p", "FROM p WHERE scenario <> 'actual' OR impact <> 'zero'", 1)


@query("difference_density_hit", f"WITH {prediction_sql('student', 20)}, df AS (SELECT * FROM ({HIT_SQL}) WHERE difference IS NOT NULL) {density_sql('df', 'kind', 'difference', 9)}")
def difference_density_hit(spark, d):
    """Only samples that were really hit."""
    p = predicted(spark, d, "student", 20, packed=False)
    out = difference_curve(p, ["obs_id"], ["kind"], largest=value_range(spark, d, ["kind"], 20), hit="impact")
    return out.select("kind", r("x").alias("x"), r("density", 9).alias("density"))


THRESHOLDS = {"click": 0.1, "purchase": 0.02, "signup": 0.02, "view": 0.1, "error": 0.02}


@query("bloom_exceedance", f"""WITH {prediction_sql('hurdle_lognormal', 50)}, m AS (SELECT max(reading) AS top FROM ({SAMPLES_SQL}))
SELECT date, kind, impact, {rq(f'''avg(CASE WHEN value * top >= top * CASE kind {' '.join(f"WHEN '{k}' THEN {v * 30}e0" for k, v in THRESHOLDS.items())} END
THEN 1.0 ELSE 0.0 END)''', 9)} AS exceedance FROM p, m GROUP BY 1, 2, 3""")
def bloom_exceedance(spark, d):
    """Scaled counts are predicted, put back on the count scale and held against a level."""
    obs = impacted(spark, d)
    top = obs.agg(F.max("reading")).first()[0]
    scaled = scale_by_max(obs.withColumn("count", F.col("reading")), ["count"])
    p = predicted(spark, d, "hurdle_lognormal", 50, packed=True, extra=scaled)
    levels = {k: top * (v * 30) for k, v in THRESHOLDS.items()}
    out = exceedance_table(p, ["date", "kind", "impact"], "count_max", levels, "kind")
    return out.withColumn("exceedance", r("exceedance", 9))


LEVELS = 200


@query("exceedance_levels", f"""WITH {prediction_sql('hurdle_lognormal', 50)}, m AS (SELECT max(reading) AS top FROM ({SAMPLES_SQL})), l AS (SELECT (i + 1) * top / {LEVELS}e0 AS level FROM m, range({LEVELS}) t(i))
SELECT kind, impact, {rq('level')} AS level, {rq('avg(CASE WHEN value * top >= level THEN 1.0 ELSE 0.0 END)', 9)} AS exceedance FROM p, m, l GROUP BY kind, impact, level""")
def bloom_levels(spark, d):
    """The whole curve of exceedance by kind and impact: 200 levels in the pass that one takes."""
    obs = impacted(spark, d)
    top = obs.agg(F.max("reading")).first()[0]
    scaled = scale_by_max(obs.withColumn("count", F.col("reading")), ["count"])
    p = predicted(spark, d, "hurdle_lognormal", 50, packed=True, extra=scaled)
    out = exceedance_levels(p, ["kind", "impact"], "count_max", [(i + 1) * top / LEVELS for i in range(LEVELS)])
    return out.withColumns({"level": r("level"), "exceedance": r("exceedance", 9)})


SORTED = "CASE kind WHEN 'view' THEN 1 WHEN 'click' THEN 2 WHEN 'error' THEN 3 END"


@query("exceedance_sorted", f"""WITH {prediction_sql('hurdle_lognormal', 50)}, m AS (SELECT max(reading) AS top FROM ({SAMPLES_SQL})),
x AS (SELECT date, kind, impact, {rq(f'''avg(CASE WHEN value * top >= top * CASE kind {' '.join(f"WHEN '{k}' THEN {v * 30}e0" for k, v in THRESHOLDS.items())} END
THEN 1.0 ELSE 0.0 END)''', 9)} AS exceedance FROM p, m GROUP BY 1, 2, 3)
SELECT *, row_number() OVER (ORDER BY {SORTED} NULLS LAST, date, kind, impact) AS position FROM x""")
def exceedance_sorted(spark, d):
    """The same table in reading order: kinds by a list, others last, then the date."""
    return display_order(bloom_exceedance(spark, d), [("kind", ["view", "click", "error"]), "date", "kind", "impact"])


# ---------------------------------------------------------------- designs, sums and fits

LINES = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]


def line_spec(spark, d):
    li = table(spark, d, "lineitem")
    return li, {
        "linear": ["l_tax"], "factors": {"l_returnflag": learn_levels(li, "l_returnflag", "N")},
        "smooths": learn_smooths(li, ["l_quantity"], knots=3),
    }


@query("design_matrix", f"""WITH k AS (SELECT avg(l_quantity) AS mid, stddev_samp(l_quantity) AS sd, quantile_cont(l_quantity, 0.25) AS k1,
  quantile_cont(l_quantity, 0.5) AS k2, quantile_cont(l_quantity, 0.75) AS k3 FROM lineitem),
t AS (SELECT l.*, (l_quantity - mid) / sd AS z, (k1 - mid) / sd AS z1, (k2 - mid) / sd AS z2, (k3 - mid) / sd AS z3 FROM lineitem l, k)
SELECT {', '.join(LINES)}, 1e0 AS x0, l_tax AS x1, CASE WHEN l_returnflag = 'A' THEN 1e0 ELSE 0e0 END AS x2, CASE WHEN l_returnflag = 'R' THEN 1e0 ELSE 0e0 END AS x3,
{rq('z')} AS x4, {rq('pow(greatest(z - z1, 0), 3)')} AS x5, {rq('pow(greatest(z - z2, 0), 3)')} AS x6, {rq('pow(greatest(z - z3, 0), 3)')} AS x7 FROM t""")
def design_matrix(spark, d):
    li, spec = line_spec(spark, d)
    out = design(li, spec)
    return out.select(*LINES, *[r(F.get("x", F.lit(i))).alias(f"x{i}") for i in range(len(terms(spec)))])


SEGMENTS = 6
# A basis function as four-fold truncated cubics, apart from the way it is computed.
BASIS = ", ".join(
    rq("(" + " ".join(f"{'-' if k % 2 else '+'} {c}e0 * pow(greatest(t - {i - 3 + k}, 0), 3)" for k, c in enumerate((1, 4, 6, 4, 1))) + ") / 6e0", 8) + f" AS b{i}"
    for i in range(SEGMENTS + 3))


@query("bspline_basis", f"""WITH e AS (SELECT min(l_quantity) AS low, max(l_quantity) AS high FROM lineitem),
t AS (SELECT l.*, CAST(l_quantity - low AS DOUBLE) * {SEGMENTS} / (high - low) AS t FROM lineitem l, e) SELECT {', '.join(LINES)}, {BASIS} FROM t""")
def bspline_basis(spark, d):
    """Cubic B-splines of the quantity on equal segments of its range."""
    li = table(spark, d, "lineitem")
    spec = learn_psplines(li, ["l_quantity"], segments=SEGMENTS)["l_quantity"]
    return li.select(*LINES, *[r(b, 8).alias(f"b{i}") for i, b in enumerate(bspline_columns(F.col("l_quantity"), spec))])


@query("fit_pspline")
def pspline_fit(spark, d):
    """Price by a smooth of the quantity under a difference penalty, smoothing found from the sums; rows are coefficients."""
    li = table(spark, d, "lineitem")
    spec = {"factors": {"l_returnflag": learn_levels(li, "l_returnflag", "N")}, "psplines": learn_psplines(li, ["l_quantity"])}
    fit = fit_lognormal(li, "l_extendedprice", spec)
    rows = [(n, float(b)) for n, b in zip(fit.names, fit.beta)] + [("sigma", fit.sigma), ("spread", fit.sds["smooth:l_quantity"])]
    return spark.createDataFrame(rows, "term string, estimate double")


GRAM_COLUMNS = ["one", "l_quantity", "l_discount", "l_tax", "y"]
GRAM_SQL = "WITH g AS (SELECT 1e0 AS one, l_quantity, l_discount, l_tax, ln(l_extendedprice) AS y FROM lineitem WHERE l_extendedprice > 0)\n" + "\nUNION ALL\n".join(
    f"SELECT CAST({i} AS BIGINT) AS i, CAST({j} AS BIGINT) AS j, {rq(f'sum({GRAM_COLUMNS[i]} * {GRAM_COLUMNS[j]})', 4)} AS value FROM g"
    for i in range(5) for j in range(i, 5))


def gram_rows(df):
    return df.select(F.col("i").cast("bigint"), F.col("j").cast("bigint"), r("value", 4).alias("value"))


@query("gram_sums", GRAM_SQL)
def gram_sums(spark, d):
    li = table(spark, d, "lineitem").filter(F.col("l_extendedprice") > 0)
    rows = design(li, {"linear": ["l_quantity", "l_discount", "l_tax"]}).withColumn("y", F.log("l_extendedprice"))
    return gram_rows(gram(rows))


@query("gram_sums_sql", GRAM_SQL)
def gram_by_sql(spark, d):
    li = table(spark, d, "lineitem").filter(F.col("l_extendedprice") > 0)
    return gram_rows(gram_sql(li.withColumns({"one": F.lit(1.0), "y": F.log("l_extendedprice")}), GRAM_COLUMNS))


def fit_row(spark, fit, **more):
    values = {"intercept": float(fit.beta[0]), "slope": float(fit.beta[1]), "n": fit.rows, **more}
    schema = ", ".join(f"{k} {'bigint' if isinstance(v, int) else 'double'}" for k, v in values.items())
    out = spark.createDataFrame([tuple(values.values())], schema)
    return out.select(*[r(c, 5).alias(c) if t == "double" else F.col(c) for c, t in out.dtypes])


@query("fit_lognormal", f"""SELECT {rq('regr_intercept(ln(l_extendedprice), l_quantity)', 5)} AS intercept, {rq('regr_slope(ln(l_extendedprice), l_quantity)', 5)} AS slope,
count(*) AS n FROM lineitem WHERE l_extendedprice > 0""")
def lognormal_flat(spark, d):
    """One covariate and flat priors, where the fit is least squares."""
    return fit_row(spark, fit_lognormal(table(spark, d, "lineitem"), "l_extendedprice", {"linear": ["l_quantity"]}, prior_sd=float("inf")))


@query("fit_lognormal_shifted", f"""SELECT {rq('regr_slope(ln(l_extendedprice), l_quantity)', 5)} AS slope, {rq('avg(ln(l_extendedprice))', 5)} AS center,
count(*) AS n FROM lineitem WHERE l_extendedprice > 0""")
def lognormal_shifted(spark, d):
    """The same with a covariate far from zero: slope, and the fit at the mean of the covariate."""
    li = table(spark, d, "lineitem").withColumn("far", F.col("l_quantity") + 1e7)
    fit = fit_lognormal(li, "l_extendedprice", {"linear": ["far"]}, prior_sd=float("inf"))
    return spark.createDataFrame([(float(fit.slopes[0]), float(fit.center_intercept), fit.rows)], "slope double, center double, n bigint").select(
        r("slope", 5).alias("slope"), r("center", 5).alias("center"), "n")


SITE_SIGMA, SITE_SD = 0.5, 0.2


@query("fit_site_intercept", f"""WITH g AS (SELECT c_nationkey AS site, count(*) AS n, avg(ln(c_acctbal)) AS m FROM customer WHERE c_acctbal > 0 GROUP BY 1),
w AS (SELECT *, n / (n + {SITE_SIGMA}e0 * {SITE_SIGMA}e0 / ({SITE_SD}e0 * {SITE_SD}e0)) AS w FROM g), b AS (SELECT sum(w * m) / sum(w) AS base FROM w)
SELECT 'site=' || site AS term, {rq('w * (m - base)', 5)} AS estimate FROM w, b UNION ALL SELECT 'intercept', {rq('base', 5)} FROM b""")
def site_intercept(spark, d):
    """Site effects with the noise and their spread given: group means, shrunk by their row counts."""
    c = table(spark, d, "customer").filter(F.col("c_acctbal") > 0)
    spec = {"site": {"column": "c_nationkey", "levels": learn_levels(c, "c_nationkey")}}
    fit = fit_lognormal(c, "c_acctbal", spec, prior_sd=float("inf"), fixed={"sigma": SITE_SIGMA, "site": SITE_SD})
    rows = [(n, float(b)) for n, b in zip(fit.names, fit.beta)]
    return spark.createDataFrame(rows, "term string, estimate double").select("term", r("estimate", 5).alias("estimate"))


# ---------------------------------------------------------------- fits from sums kept by year

YEARLY = "g AS (SELECT year(l_shipdate) AS part, l_quantity AS x, ln(l_extendedprice) AS y FROM lineitem WHERE l_extendedprice > 0 AND l_quantity IS NOT NULL)"


def yearly_state(spark, d):
    return fit_state(table(spark, d, "lineitem"), "l_extendedprice", {"linear": ["l_quantity"]}, F.year("l_shipdate"))


@query("fit_state_sums", f"""WITH {YEARLY}, m AS (SELECT CAST(part AS VARCHAR) AS part, count(*) AS n, avg(x) AS mx, avg(y) AS my, var_pop(x) AS xx, covar_pop(y, x) AS xy, var_pop(y) AS yy FROM g GROUP BY 1)
SELECT part, n, CAST(0 AS BIGINT) AS i, CAST(0 AS BIGINT) AS j, {rq('mx')} AS mean_i, {rq('mx')} AS mean_j, {rq('xx')} AS product FROM m
UNION ALL SELECT part, n, 0, 1, {rq('mx')}, {rq('my')}, {rq('xy')} FROM m UNION ALL SELECT part, n, 1, 1, {rq('my')}, {rq('my')}, {rq('yy')} FROM m""")
def state_sums(spark, d):
    """The state itself: means, and products about them per row, by year."""
    long = F.col("i").cast("bigint"), F.col("j").cast("bigint")
    return moments(yearly_state(spark, d)).select("part", F.col("rows").alias("n"), *[c.alias(k) for c, k in zip(long, "ij")], r("mean_i").alias("mean_i"), r("mean_j").alias("mean_j"), r(F.col("product") / F.col("rows")).alias("product"))


@query("fit_state_without_year", f"""WITH {YEARLY}, p AS (SELECT DISTINCT part FROM g)
SELECT CAST(p.part AS VARCHAR) AS left_out, count(*) AS n, {rq('regr_intercept(y, x)', 5)} AS intercept, {rq('regr_slope(y, x)', 6)} AS slope FROM p JOIN g ON g.part <> p.part GROUP BY 1""")
def without_year(spark, d):
    """A fit without each year in turn: the rows are read once, each fit reads the state only."""
    state = durable(yearly_state(spark, d))
    rows = []
    for part in sorted(row["part"] for row in state.filter("rows > 0").select("part").collect()):
        fit = fit_from_state(state.filter(F.col("part") != part), "l_extendedprice", {"linear": ["l_quantity"]}, prior_sd=float("inf"))
        rows.append((part, fit.rows, float(fit.beta[0]), float(fit.beta[1])))
    out = spark.createDataFrame(rows, "left_out string, n bigint, intercept double, slope double")
    return out.withColumns({"intercept": r("intercept", 5), "slope": r("slope", 6)})


# ---------------------------------------------------------------- effects of any number of sites

MANY = """g AS (SELECT o_custkey AS site, count(*) AS n, avg(ln(o_totalprice)) AS m FROM orders WHERE o_totalprice > 0 AND o_custkey IS NOT NULL GROUP BY 1),
w AS (SELECT *, n / (n + {s}e0 * {s}e0 / ({d}e0 * {d}e0)) AS w FROM g), b AS (SELECT sum(w * m) / sum(w) AS base FROM w)""".format(s=SITE_SIGMA, d=SITE_SD)


@query("fit_many_sites", f"""WITH {MANY} SELECT CAST(site AS VARCHAR) AS site, n, {rq('w * (m - base)', 5)} AS effect, {rq(f'sqrt({SITE_SIGMA}e0 * {SITE_SIGMA}e0 * w / n)', 6)} AS sd FROM w, b
UNION ALL SELECT 'intercept', (SELECT sum(n)::BIGINT FROM g), {rq('base', 5)}, NULL FROM b""")
def many_sites(spark, d):
    """An effect for each customer with orders, noise and spread given: the site block is eliminated, no term is dense."""
    fit = fit_sites(table(spark, d, "orders"), "o_totalprice", {}, "o_custkey", prior_sd=float("inf"), fixed={"sigma": SITE_SIGMA, "site": SITE_SD})
    effects = fit.effects().select(F.col("site").cast("string").alias("site"), "n", r("effect", 5).alias("effect"), r("sd").alias("sd"))
    base = spark.createDataFrame([("intercept", fit.rows, float(fit.beta[0]), None)], "site string, n bigint, effect double, sd double")
    return effects.unionByName(base.withColumn("effect", r("effect", 5)))


@query("fit_many_sites_slope", f"""WITH o AS (SELECT l_suppkey AS site, l_quantity - 25 AS x, ln(l_extendedprice) - 10 AS y FROM lineitem WHERE l_extendedprice > 0),
g AS (SELECT site, count(*) AS n, sum(x) AS sx, sum(y) AS sy, sum(x * x) AS sxx, sum(x * y) AS sxy, 1e0 / (count(*) + {SITE_SIGMA}e0 * {SITE_SIGMA}e0 / ({SITE_SD}e0 * {SITE_SD}e0)) AS w FROM o GROUP BY 1),
a AS (SELECT sum(n - w * n * n) AS a11, sum(sx - w * n * sx) AS a12, sum(sxx - w * sx * sx) AS a22, sum(sy - w * n * sy) AS b1, sum(sxy - w * sx * sy) AS b2 FROM g),
f AS (SELECT (a22 * b1 - a12 * b2) / (a11 * a22 - a12 * a12) AS base, (a11 * b2 - a12 * b1) / (a11 * a22 - a12 * a12) AS slope FROM a)
SELECT CAST(site AS VARCHAR) AS term, {rq('w * (sy - n * base - sx * slope)', 5)} AS estimate FROM g, f
UNION ALL SELECT 'intercept', {rq('base + 10 - 25 * slope', 5)} FROM f UNION ALL SELECT 'slope', {rq('slope', 6)} FROM f""")
def many_sites_slope(spark, d):
    """The same with a covariate: slope and intercept from the small block that is left."""
    fit = fit_sites(table(spark, d, "lineitem"), "l_extendedprice", {"linear": ["l_quantity"]}, "l_suppkey", prior_sd=float("inf"), fixed={"sigma": SITE_SIGMA, "site": SITE_SD})
    effects = fit.effects().select(F.col("site").cast("string").alias("term"), r("effect", 5).alias("estimate"))
    rest = [("intercept", float(np.round(fit.beta[0], 5))), ("slope", float(np.round(fit.beta[1], 6)))]
    return effects.unionByName(spark.createDataFrame(rest, "term string, estimate double"))


def site_prediction_sql(m: int) -> str:
    """CTEs ending in ``p``: predictions whose site effects follow from the sums of all samples of the site before the window."""
    key = f"CAST(obs_id AS VARCHAR) || ':' || scenario || ':{SEED}'"
    place = f"'site:' || CAST(site AS VARCHAR) || ':{SEED}'"
    dummies = ["1e0", "day_part", *[f"CASE WHEN impact = '{v}' THEN 1e0 ELSE 0e0 END" for v in IMPACT_ORDER[1:]]]
    dot = " + ".join(f"b{i} * ({x})" for i, x in enumerate(dummies))
    betas = ", ".join(f"{line_sql(ab)} AS b{i}" for i, ab in enumerate(BETA))
    return f"""a AS (SELECT obs_id, date, site, {case_sql('kind', KIND_IMPACT)} AS impact, hour(ts) / 24e0 AS day_part, count FROM ({SAMPLES_SQL})),
g AS (SELECT site, count(*) AS n, {', '.join(f'sum({x}) AS s{i}' for i, x in enumerate(dummies))}, sum(log10(count)) AS sy FROM a
  WHERE date < DATE '{WINDOW_START}' AND count > 0 AND impact IS NOT NULL AND site % 3 <> 0 GROUP BY site),
o AS (SELECT * FROM a WHERE date BETWEEN DATE '{WINDOW_START}' AND DATE '{WINDOW_END}' AND impact IS NOT NULL),
sc AS (SELECT obs_id, site, day_part, impact, 'actual' AS scenario FROM o UNION ALL SELECT obs_id, site, day_part, 'zero', 'counterfactual' FROM o),
dr AS (SELECT CAST(d AS BIGINT) AS draw_id, {betas}, {line_sql(SIGMA)} AS sigma, {line_sql(NU)} AS nu, {line_sql(SD_SITE)} AS sd_site FROM range({m}) t(d)),
wd AS (SELECT *, {word_sql(key, 0)} AS wa, {word_sql(key, 1)} AS wb, {word_sql(place, 0)} AS sa, {word_sql(place, 1)} AS sb FROM sc LEFT JOIN g USING (site)),
un AS (SELECT wd.*, dr.*, {mix_sql('wa', 'ua')}, {mix_sql('wb', 'ub')}, {mix_sql('sa', 'us')}, {mix_sql('sb', 'vs')},
  1e0 / (coalesce(n, 0) + pow(sigma / sd_site, 2)) AS w, coalesce(sy - ({' + '.join(f'b{i} * s{i}' for i in range(len(dummies)))}), 0e0) AS res FROM wd, dr),
p AS (SELECT obs_id, scenario, draw_id, {dot} + CASE WHEN site IS NULL THEN 0e0 ELSE w * res + sigma * sqrt(w) * {NORMAL.format(u='us', v='vs')} END
  + sigma * sqrt(nu * (pow(ua, -2e0 / nu) - 1)) * cos(2e0 * pi() * ub) AS value FROM un)"""


def site_predictions(spark, d, m: int, packed: bool):
    """Effects of two thirds of the sites follow from their samples before the window; the other sites are new."""
    obs = impacted(spark, d)
    past = design(obs.filter((F.col("ts") < F.lit(dt.date.fromisoformat(WINDOW_START))) & (F.col("count") > 0) & (F.col("site") % 3 != 0)), SPEC)
    shift = [0.0, 0.5, 0.0, 0.0, 0.0, 1.0]  # any place to measure from gives the same effects
    sums = site_sums(past.withColumn("y", F.log10("count")), "x", "y", "site", shift)
    window = filter_window(obs, "ts", WINDOW_START, WINDOW_END).select("obs_id", "date", "site", "impact", "day_part")
    return predict_scenarios(window, SPEC, given_draws(m), "student", "obs_id", "impact", "date", seed=SEED, site="site", packed=packed, sums=sums, shift=shift)


@query("predict_many_sites", f"WITH {site_prediction_sql(20)} {PREDICTED}")
def many_sites_long(spark, d):
    return long_rows(site_predictions(spark, d, 20, packed=False))


@query("predict_many_sites_packed", f"WITH {site_prediction_sql(20)} {PREDICTED}")
def many_sites_packed(spark, d):
    return long_rows(explode_draws(site_predictions(spark, d, 20, packed=True), "draws"))


@query("fit_hurdle_lognormal", f"""SELECT {rq('regr_intercept(CASE WHEN l_discount > 0 THEN ln(l_discount) END, l_quantity)', 5)} AS intercept,
{rq('regr_slope(CASE WHEN l_discount > 0 THEN ln(l_discount) END, l_quantity)', 5)} AS slope, count(*) FILTER (WHERE l_discount > 0) AS n,
{rq('(1e0 + count(*) FILTER (WHERE l_discount = 0)) / (2e0 + count(*))', 5)} AS zero_share FROM lineitem WHERE l_discount >= 0""")
def hurdle_flat(spark, d):
    fit = fit_hurdle_lognormal(table(spark, d, "lineitem"), "l_discount", {"linear": ["l_quantity"]}, prior_sd=float("inf"))
    return fit_row(spark, fit, zero_share=(1.0 + fit.zeros) / (2.0 + fit.zeros + fit.rows))


@query("fit_student", f"""WITH RECURSIVE g AS (SELECT l_quantity AS x, log10(l_extendedprice) AS y FROM lineitem WHERE l_extendedprice > 0),
it AS (SELECT 0 AS k, regr_intercept(y, x) AS a, regr_slope(y, x) AS b, sqrt(regr_syy(y, x) / count(*)) AS s FROM g
UNION ALL SELECT k, (sy - b * sx) / sw, b, sqrt((swyy - 2 * b * swxy + b * b * swxx) / (n - 2)) FROM
 (SELECT k, n, sw, sx, sy, sxy - sx * sy / sw AS swxy, sxx - sx * sx / sw AS swxx, syy - sy * sy / sw AS swyy, (sxy - sx * sy / sw) / (sxx - sx * sx / sw) AS b FROM
  (SELECT k, count(*) AS n, sum(w) AS sw, sum(w * x) AS sx, sum(w * y) AS sy, sum(w * x * y) AS sxy, sum(w * x * x) AS sxx, sum(w * y * y) AS syy FROM
   (SELECT it.k + 1 AS k, x, y, 5e0 / (4e0 + pow((y - it.a - it.b * x) / it.s, 2)) AS w FROM it, g WHERE it.k < 60) GROUP BY k)))
SELECT {rq('a', 5)} AS intercept, {rq('b', 5)} AS slope, {rq('s', 5)} AS sigma, (SELECT count(*) FROM g) AS n FROM it ORDER BY k DESC LIMIT 1""")
def student_flat(spark, d):
    """Re-weighted sums to convergence, four degrees of freedom, flat priors."""
    li = table(spark, d, "lineitem").filter(F.col("l_extendedprice") > 0).withColumn("log_price", F.log10("l_extendedprice"))
    fit = fit_student(li, "log_price", {"linear": ["l_quantity"]}, prior_sd=float("inf"), nu=4.0, tol=1e-10)
    return fit_row(spark, fit, sigma=fit.sigma)


GIVEN_NU = 4


@query("fit_site_effects_given", f"""WITH RECURSIVE g AS (SELECT c_nationkey AS site, log10(c_acctbal) AS y FROM customer WHERE c_acctbal > 0),
it AS (SELECT 0 AS k, site, avg(avg(y)) OVER () AS a, 0e0 AS u FROM g GROUP BY site
UNION ALL SELECT k, site, a, (swy - sw * a) / (sw + {SITE_SIGMA}e0 * {SITE_SIGMA}e0 / ({SITE_SD}e0 * {SITE_SD}e0)) FROM
 (SELECT *, sum(swy * h) OVER () / sum(sw * h) OVER () AS a FROM
  (SELECT *, 1 - sw / (sw + {SITE_SIGMA}e0 * {SITE_SIGMA}e0 / ({SITE_SD}e0 * {SITE_SD}e0)) AS h FROM
   (SELECT k, site, sum(w) AS sw, sum(w * y) AS swy FROM
    (SELECT it.k + 1 AS k, g.site, y, {GIVEN_NU + 1}e0 / ({GIVEN_NU}e0 + pow((y - a - u) / {SITE_SIGMA}e0, 2)) AS w FROM it JOIN g ON g.site = it.site WHERE it.k < 60) GROUP BY k, site))))
SELECT 'site=' || site AS term, {rq('u', 5)} AS estimate FROM it WHERE k = 60 UNION ALL SELECT 'intercept', {rq('any_value(a)', 5)} FROM it WHERE k = 60""")
def site_effects_given(spark, d):
    """Student fit with noise, degrees of freedom and spread given: re-weighted, shrunk means of the sites."""
    c = table(spark, d, "customer").filter(F.col("c_acctbal") > 0).withColumn("log_balance", F.log10("c_acctbal"))
    spec = {"site": {"column": "c_nationkey", "levels": learn_levels(c, "c_nationkey")}}
    fit = fit_student(c, "log_balance", spec, prior_sd=float("inf"), nu=float(GIVEN_NU), tol=1e-10, fixed={"sigma": SITE_SIGMA, "site": SITE_SD})
    return spark.createDataFrame([(n, float(b)) for n, b in zip(fit.names, fit.beta)], "term string, estimate double").select("term", r("estimate", 5).alias("estimate"))


@query("fit_site_effects")
def site_effects(spark, d):
    """Student fit with impact, time of day and a shrunk effect per nation; rows are coefficients."""
    c = table(spark, d, "customer").filter(F.col("c_acctbal") > 0).withColumn("log_balance", F.log10("c_acctbal"))
    spec = {"factors": {"c_mktsegment": learn_levels(c, "c_mktsegment")}, "site": {"column": "c_nationkey", "levels": learn_levels(c, "c_nationkey")}}
    fit = fit_student(c, "log_balance", spec)
    rows = [(n, float(b)) for n, b in zip(fit.names, fit.beta)]
    return spark.createDataFrame(rows, "term string, estimate double")


@query("fitted_contrast")
def fitted_contrast(spark, d):
    """Fit, draw, predict the window with and without the event, and summarise by impact level."""
    obs = impacted(spark, d).filter(F.col("count") > 0).withColumn("y", F.log10("count"))
    before = F.col("ts") < F.lit(dt.date.fromisoformat(WINDOW_START))
    obs = obs.withColumn("impact", F.when(before, F.lit("zero")).otherwise(F.col("impact")))
    draws = fit_student(obs, "y", SPEC).draws(50, seed=SEED)
    window = filter_window(obs, "ts", WINDOW_START, WINDOW_END)
    p = predict_scenarios(window.select("obs_id", "date", "impact", "day_part"), SPEC, draws, "student", "obs_id", "impact", "date", seed=SEED, packed=False)
    return interval_table(window, p, "y", "impact", pow10("value"), largest=50 * window.count())


@query("fitted_exceedance")
def fitted_exceedance(spark, d):
    """Hurdle fit on scaled discounts with a smooth; share of draws over a level by month and impact."""
    li = scale_by_max(table(spark, d, "lineitem"), ["l_discount"])
    li = li.withColumns({
        "obs_id": F.concat_ws("-", *LINES), "date": F.col("l_shipdate").cast("date"),
        "impact": impact_window("l_shipdate", "1998-07-14", "1998-11-30"),
    })
    spec = {"linear": ["l_tax"], "factors": {"impact": ["zero", "high"]}, "smooths": learn_smooths(li, ["l_quantity"], knots=3)}
    fit = fit_hurdle_lognormal(li, "l_discount_scaled", spec)
    window = filter_window(li, "l_shipdate", "1998-07-14", "1998-11-30")
    obs = window.select("obs_id", "date", "impact", "l_tax", "l_quantity", "l_discount_max", F.month("date").alias("month"))
    p = predict_scenarios(obs, spec, fit.draws(100, seed=SEED), fit.family, "obs_id", "impact", "date", seed=SEED)
    return exceedance_table(p, ["month", "impact"], "l_discount_max", 0.08)


# ---------------------------------------------------------------- conditional effects

EFFECT_SPEC = {"linear": ["l_quantity", "l_tax"], "factors": {"l_returnflag": ["N", "A", "R"]}}
EFFECT_BETA = [(0.5, 0.001), (0.01, 0.0001), (0.3, -0.002), (0.2, 0.001), (-0.1, 0.002)]


def effect_draws(m: int) -> Draws:
    n = np.arange(m, dtype=np.float64)
    return Draws(np.column_stack([a + b * n for a, b in EFFECT_BETA]), 0.3 + 0.001 * n)


def effect_sql(m: int, points: int) -> str:
    betas = ", ".join(f"{line_sql(ab)} AS b{i}" for i, ab in enumerate(EFFECT_BETA))
    last = points - 1
    return f"""WITH st AS (SELECT min(l_quantity) AS q0, max(l_quantity) AS q1, avg(l_quantity) AS q, min(l_tax) AS t0, max(l_tax) AS t1, avg(l_tax) AS t FROM lineitem),
gr AS (SELECT 'l_quantity' AS effect, i AS grid_point, q0 + i * (q1 - q0) / {last}e0 AS x_value, CAST(NULL AS VARCHAR) AS level, q0 + i * (q1 - q0) / {last}e0 AS lq, t AS lt, 'N' AS lf FROM st, range({points}) g(i)
UNION ALL SELECT 'l_tax', i, t0 + i * (t1 - t0) / {last}e0, NULL, q, t0 + i * (t1 - t0) / {last}e0, 'N' FROM st, range({points}) g(i)
UNION ALL SELECT 'l_returnflag', i, NULL, ['N', 'A', 'R'][i + 1], q, t, ['N', 'A', 'R'][i + 1] FROM st, range(3) g(i)),
dr AS (SELECT {betas}, {line_sql((0.3, 0.001))} AS sigma FROM range({m}) t(d)),
ex AS (SELECT effect, CAST(grid_point AS INTEGER) AS grid_point, {rq('x_value')} AS x_value, level, exp(b0 + lq * b1 + lt * b2 + CASE lf WHEN 'A' THEN b3 WHEN 'R' THEN b4 ELSE 0e0 END + sigma * sigma / 2) AS value FROM gr, dr)
{interval_sql('ex', 'effect, grid_point, x_value, level', 'value')}"""


@query("conditional_effects_site", effect_sql(100, 50))
def effects_of_sites(spark, d):
    """A model with site effects, at the level of the population: the same numbers as without them."""
    grid = effect_grid(table(spark, d, "lineitem"), ["l_quantity", "l_tax"], {"l_returnflag": ["N", "A", "R"]}, points=50)
    draws = effect_draws(100)
    draws.beta = np.column_stack([draws.beta, np.full((100, 2), 0.7)])
    out = conditional_effects(grid, draws, "lognormal", {**EFFECT_SPEC, "site": {"column": "l_shipmode", "levels": ["AIR", "SHIP"]}})
    return rounded(out).withColumn("x_value", r("x_value"))


@query("conditional_effects", effect_sql(100, 50))
def effects(spark, d):
    li = table(spark, d, "lineitem")
    grid = effect_grid(li, ["l_quantity", "l_tax"], {"l_returnflag": ["N", "A", "R"]}, points=50)
    out = conditional_effects(grid, effect_draws(100), "lognormal", EFFECT_SPEC)
    return rounded(out).withColumn("x_value", r("x_value"))
