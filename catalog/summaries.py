"""Queries for aggregates, intervals, exceedance and density curves over the tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from emberfield.operators.curves import density_curve
from emberfield.operators.summary import coef_summary, daily_mean, exceedance, exceedance_packed, median_qi, median_qi_packed, scale_by_max

from .common import query, r, rq, table


@query("agg_daily_mean", f"SELECT CAST(l_shipdate AS DATE) AS date, {rq('avg(l_quantity)', 9)} AS mean_quantity FROM lineitem GROUP BY 1")
def agg_daily_mean(spark, d):
    li = table(spark, d, "lineitem").select(F.col("l_shipdate").cast("date").alias("date"), "l_quantity")
    return daily_mean(li, "date", "l_quantity", "mean_quantity").select("date", r("mean_quantity", 9).alias("mean_quantity"))


@query("scale_by_max", f"""WITH m AS (SELECT max(l_quantity) AS q, max(l_extendedprice) AS p FROM lineitem)
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, {rq('l_quantity / nullif(m.q, 0)', 9)} AS l_quantity_scaled,
{rq('l_extendedprice / nullif(m.p, 0)', 9)} AS l_extendedprice_scaled, m.p AS l_extendedprice_max FROM lineitem, m""")
def scaled(spark, d):
    out = scale_by_max(table(spark, d, "lineitem"), ["l_quantity", "l_extendedprice"])
    return out.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", r("l_quantity_scaled", 9).alias("l_quantity_scaled"),
                      r("l_extendedprice_scaled", 9).alias("l_extendedprice_scaled"), "l_extendedprice_max")


def interval_sql(source: str, by: str, value: str, digits: int = 6) -> str:
    return f"""SELECT {by}, {rq(f'quantile_cont({value}, CAST(0.5 AS DOUBLE))', digits)} AS value,
{rq(f'quantile_cont({value}, CAST(0.025 AS DOUBLE))', digits)} AS lower, {rq(f'quantile_cont({value}, CAST(0.975 AS DOUBLE))', digits)} AS upper,
CAST(0.95 AS DOUBLE) AS width, 'median' AS point, 'qi' AS interval FROM {source} GROUP BY {by}"""


def rounded(df, digits: int = 6):
    return df.withColumns({c: r(c, digits) for c in ("value", "lower", "upper")})


PRICE_SQL = interval_sql("lineitem", "l_returnflag", "l_extendedprice")


@query("median_qi", PRICE_SQL)
def interval(spark, d):
    return rounded(median_qi(table(spark, d, "lineitem"), ["l_returnflag"], "l_extendedprice"))


@query("median_qi_bracketed", PRICE_SQL)
def interval_bracketed(spark, d):
    return rounded(median_qi(table(spark, d, "lineitem"), ["l_returnflag"], "l_extendedprice", method="bracketed"))


@query("median_qi_by_order", interval_sql("lineitem", "l_orderkey", "l_extendedprice"))
def interval_by_order(spark, d):
    return rounded(median_qi(table(spark, d, "lineitem"), ["l_orderkey"], "l_extendedprice"))


@query("median_qi_by_level", interval_sql("lineitem", "l_linestatus", "ln(l_extendedprice)"))
def interval_by_level(spark, d):
    return rounded(median_qi(table(spark, d, "lineitem"), ["l_linestatus"], F.log("l_extendedprice")))


@query("median_qi_weighted", f"""WITH x AS (SELECT l_returnflag, l_extendedprice FROM lineitem, range(CAST(l_quantity AS BIGINT)))
{interval_sql('x', 'l_returnflag', 'l_extendedprice')}""")
def interval_weighted(spark, d):
    """A row counts as often as its quantity says."""
    li = table(spark, d, "lineitem").withColumn("times", F.col("l_quantity").cast("bigint"))
    return rounded(median_qi(li, ["l_returnflag"], "l_extendedprice", frequency="times"))


def weighted_sql(p: str, name: str) -> str:
    """Value at a share of the cumulative weight, between the two neighbours."""
    place = f"CAST(n - 1 AS DECIMAL(20,0)) * CAST({p} AS DECIMAL(4,3))"
    low, share = f"floor({place})", f"CAST({place} - floor({place}) AS DOUBLE)"
    a, b = f"min(v) FILTER (WHERE upto >= {low} + 1)", f"min(v) FILTER (WHERE upto >= {low} + 2)"
    return rq(f"any_value(1 - {share}) * {a} + any_value({share}) * coalesce({b}, {a})") + f" AS {name}"


@query("median_qi_heavy", f"""WITH x AS (SELECT l_returnflag, l_extendedprice AS v, sum(CAST(l_quantity AS HUGEINT) * 1000000000000) AS w FROM lineitem GROUP BY 1, 2),
c AS (SELECT l_returnflag, v, sum(w) OVER (PARTITION BY l_returnflag ORDER BY v) AS upto, sum(w) OVER (PARTITION BY l_returnflag) AS n FROM x)
SELECT l_returnflag, {weighted_sql('0.5', 'value')}, {weighted_sql('0.025', 'lower')}, {weighted_sql('0.975', 'upper')}, CAST(0.95 AS DOUBLE) AS width, 'median' AS point, 'qi' AS interval
FROM c GROUP BY l_returnflag""")
def interval_heavy(spark, d):
    """Weights of 10^12 and more: values are selected by cumulative weight, no row is unfolded."""
    li = table(spark, d, "lineitem").withColumn("times", F.col("l_quantity").cast("bigint") * 1_000_000_000_000)
    return rounded(median_qi(li, ["l_returnflag"], "l_extendedprice", frequency="times", method="bracketed"))


VECTOR_SQL = """(SELECT vec_id, CAST(unnest(embedding) AS DOUBLE) AS v FROM embeddings)"""


@query("median_qi_packed", interval_sql(VECTOR_SQL, "vec_id", "v"))
def interval_packed(spark, d):
    e = table(spark, d, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("draws"))
    return rounded(median_qi_packed(e, "draws").drop("draws"))


@query("exceedance_packed", f"""SELECT vec_id, {rq('avg(CASE WHEN v >= CAST(0.1 AS DOUBLE) THEN 1.0 ELSE 0.0 END)')} AS exceedance
FROM {VECTOR_SQL} GROUP BY vec_id""")
def share_packed(spark, d):
    e = table(spark, d, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("draws"))
    return exceedance_packed(e, "draws", 0.1).select("vec_id", r("exceedance").alias("exceedance"))


FLAG_LEVELS = {"A": 40_000.0, "N": 20_000.0, "R": 60_000.0}


@query("exceedance", f"""SELECT CAST(l_shipdate AS DATE) AS date, l_returnflag, {rq('''avg(CASE WHEN l_extendedprice >=
CASE l_returnflag WHEN 'A' THEN 40000 WHEN 'N' THEN 20000 WHEN 'R' THEN 60000 END THEN 1.0 ELSE 0.0 END)''', 9)} AS exceedance
FROM lineitem GROUP BY 1, 2""")
def share(spark, d):
    li = table(spark, d, "lineitem").withColumn("date", F.col("l_shipdate").cast("date"))
    return exceedance(li, ["date", "l_returnflag"], "l_extendedprice", FLAG_LEVELS, "l_returnflag").withColumn("exceedance", r("exceedance", 9))


TERMS_SQL = """(SELECT 't' || CAST(i AS VARCHAR) AS term, CAST(embedding[i + 1] AS DOUBLE) AS b
FROM (SELECT embedding, unnest(range(0, len(embedding))) AS i FROM embeddings))"""


@query("coef_summary", f"""SELECT term, {rq('avg(b)')} AS estimate, {rq('stddev_samp(b)')} AS error, {rq('quantile_cont(b, CAST(0.025 AS DOUBLE))')} AS lower,
{rq('quantile_cont(b, CAST(0.975 AS DOUBLE))')} AS upper FROM {TERMS_SQL} GROUP BY term""")
def coefficients(spark, d):
    """Vectors read as coefficient draws."""
    e = table(spark, d, "embeddings").select(F.col("embedding").cast("array<double>").alias("beta"))
    size = e.select(F.max(F.size("beta"))).first()[0]
    out = coef_summary(e, "beta", [f"t{i}" for i in range(size)])
    return out.select("term", *[r(c).alias(c) for c in ("estimate", "error", "lower", "upper")])


@query("hurdle_counts", """SELECT l_returnflag, count(*) FILTER (WHERE l_discount = 0) AS zeros, count(*) FILTER (WHERE l_discount > 0) AS positives
FROM lineitem GROUP BY 1""")
def hurdle_counts(spark, d):
    return table(spark, d, "lineitem").groupBy("l_returnflag").agg(
        F.count_if(F.col("l_discount") == 0).alias("zeros"), F.count_if(F.col("l_discount") > 0).alias("positives"))


def density_sql(source: str, by: str, value: str, digits: int, grid: int = 256) -> str:
    """Binned Gaussian density in SQL; ``by`` is one column."""
    return f"""SELECT {by}, {rq('lo + i * step')} AS x, {rq('sum(c * exp(-0.5 * pow((lo + i * step - mn - bin * h / 8) / h, 2))) / (n * h * sqrt(2 * pi()))', digits)} AS density
FROM (SELECT {by}, n, h, mn, lo, step, floor((v - mn) / (h / 8) + 0.5) AS bin, count(*) AS c FROM
  (SELECT s.{by}, s.v, n, h, mn, mn - 3 * h AS lo, (mx - mn + 6 * h) / {grid - 1} AS step FROM (SELECT {by}, {value} AS v FROM {source}) s JOIN
    (SELECT {by}, n, mn, mx, 0.9e0 * least(sd, iqr / 1.34e0) * pow(n, -0.2e0) AS h FROM
      (SELECT {by}, count({value}) AS n, min({value}) AS mn, max({value}) AS mx, stddev_samp({value}) AS sd,
       quantile_cont({value}, 0.75) - quantile_cont({value}, 0.25) AS iqr FROM {source} GROUP BY {by})) k ON s.{by} = k.{by})
  GROUP BY ALL), range({grid}) g(i)
GROUP BY {by}, n, h, mn, lo, step, i"""


@query("density_curve", density_sql("lineitem", "l_returnflag", "l_extendedprice", 12))
def density(spark, d):
    out = density_curve(table(spark, d, "lineitem"), ["l_returnflag"], "l_extendedprice")
    return out.select("l_returnflag", r("x").alias("x"), r("density", 12).alias("density"))


@query("density_curve_clipped", density_sql("(SELECT * FROM lineitem WHERE l_extendedprice >= 5000 AND l_extendedprice <= 80000)",
                                            "l_returnflag", "l_extendedprice", 12))
def density_clipped(spark, d):
    out = density_curve(table(spark, d, "lineitem"), ["l_returnflag"], "l_extendedprice", clip=(5_000.0, 80_000.0))
    return out.select("l_returnflag", r("x").alias("x"), r("density", 12).alias("density"))
