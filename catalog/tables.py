"""Queries for joins, reshaping, unions and the feature table."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from emberfield.operators.joins import align_by_key, join_daily, join_dimension
from emberfield.operators.reshape import explode_draws, paired_unpivot, scenarios, stack_observed_predicted, to_long, union_by_name
from emberfield.operators.clean import filter_window
from emberfield.operators.summary import daily_mean
from emberfield.plans.features import bay_features, harvest_features, station_features
from emberfield.session import ensure_checkpoint_dir
from emberfield.sources.stages import read_dated, write_clustered, write_dated

from .common import SAMPLES_SQL, WINDOW_END, WINDOW_START, query, r, rq, samples, table


@query("join_left_dim", "SELECT c.c_custkey, n.n_name, n.n_regionkey FROM customer c LEFT JOIN nation n ON c.c_nationkey = n.n_nationkey")
def join_left_dim(spark, d):
    out = join_dimension(table(spark, d, "customer"), table(spark, d, "nation"), "c_nationkey", "n_nationkey")
    return out.select("c_custkey", "n_name", "n_regionkey")


@query("join_left_daily", f"""WITH day AS (SELECT CAST(l_shipdate AS DATE) AS date, avg(l_quantity) AS mean_quantity FROM lineitem GROUP BY 1)
SELECT o.o_orderkey, {rq('day.mean_quantity', 9)} AS mean_quantity FROM orders o LEFT JOIN day ON CAST(o.o_orderdate AS DATE) = day.date""")
def join_left_daily(spark, d):
    li = table(spark, d, "lineitem").withColumn("date", F.col("l_shipdate").cast("date"))
    day = daily_mean(li, "date", "l_quantity", "mean_quantity")
    orders = table(spark, d, "orders").withColumn("date", F.col("o_orderdate").cast("date"))
    return join_daily(orders, day, ["date"], check_unique=False).select("o_orderkey", r("mean_quantity", 9).alias("mean_quantity"))


@query("join_left_composite", f"""WITH s AS ({SAMPLES_SQL}), m AS (SELECT date, site, count(*) AS n, min(count) AS least FROM s WHERE kind = 'view' GROUP BY 1, 2)
SELECT s.obs_id, m.n, m.least FROM s LEFT JOIN m ON s.date = m.date AND s.site = m.site""")
def join_left_composite(spark, d):
    s = samples(spark, d)
    views = s.filter(F.col("kind") == "view").groupBy(F.col("date").alias("day"), "site").agg(
        F.count(F.lit(1)).alias("n"), F.min("count").alias("least"))
    return join_daily(s, views, [("date", "day"), ("site", "site")], check_unique=False).select("obs_id", "n", "least")


@query("join_null_safe", f"""WITH s AS (SELECT obs_id, count, CASE WHEN kind <> 'error' THEN kind END AS kind FROM ({SAMPLES_SQL})),
m AS (SELECT kind, count(*) AS n, max(count) AS most FROM s GROUP BY kind)
SELECT s.obs_id, m.n, m.most FROM s LEFT JOIN m ON s.kind IS NOT DISTINCT FROM m.kind""")
def join_null_safe(spark, d):
    s = samples(spark, d).withColumn("kind", F.when(F.col("kind") != "error", F.col("kind")))
    m = s.groupBy("kind").agg(F.count(F.lit(1)).alias("n"), F.max("count").alias("most"))
    return join_daily(s, m, ["kind"], null_safe=True, check_unique=False).select("obs_id", "n", "most")


DRAWS_SQL = """SELECT vec_id, CAST(i - 1 AS BIGINT) AS draw_id, CAST(embedding[i] AS DOUBLE) AS value
FROM (SELECT vec_id, embedding, unnest(range(1, len(embedding) + 1)) AS i FROM embeddings)"""


def packed_vectors(spark, d):
    return table(spark, d, "embeddings").withColumn("embedding", F.col("embedding").cast("array<double>"))


@query("explode_draws", f"SELECT vec_id, draw_id, {rq('value')} AS value FROM ({DRAWS_SQL})")
def draws_long(spark, d):
    long = explode_draws(packed_vectors(spark, d).select("vec_id", "embedding"), "embedding")
    return long.select("vec_id", F.col("draw_id").cast("bigint"), r("value").alias("value"))


@query("align_by_key", f"SELECT x.vec_id, x.draw_id, {rq('x.value')} AS value, CAST(e.label AS BIGINT) AS label FROM ({DRAWS_SQL}) x JOIN embeddings e USING (vec_id)")
def aligned(spark, d):
    e = packed_vectors(spark, d)
    long = explode_draws(e.select("vec_id", "embedding"), "embedding")
    out = align_by_key(long, e, ["vec_id"], ["label"])
    return out.select("vec_id", F.col("draw_id").cast("bigint"), r("value").alias("value"), F.col("label").cast("bigint"))


KEYS = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
MEASURES = ["l_quantity", "l_discount", "l_tax"]


@query("unpivot_long", "\nUNION ALL\n".join(
    f"SELECT {', '.join(KEYS)}, '{m}' AS name, {m} AS value FROM lineitem" for m in MEASURES))
def unpivot_long(spark, d):
    return to_long(table(spark, d, "lineitem"), KEYS, MEASURES)


@query("unpivot_paired", f"""SELECT {', '.join(KEYS)}, 'rate' AS name, l_discount AS first, l_quantity AS second FROM lineitem
UNION ALL SELECT {', '.join(KEYS)}, 'levy', l_tax, l_extendedprice FROM lineitem""")
def unpivot_paired(spark, d):
    return paired_unpivot(table(spark, d, "lineitem"), KEYS,
                          [("rate", "l_discount", "l_quantity"), ("levy", "l_tax", "l_extendedprice")])


@query("union_by_name", """SELECT c_custkey AS key, c_name AS name, c_acctbal AS balance, c_mktsegment AS segment FROM customer
UNION ALL SELECT s_suppkey, s_name, s_acctbal, NULL FROM supplier""")
def stacked(spark, d):
    c = table(spark, d, "customer").select(
        F.col("c_custkey").alias("key"), F.col("c_name").alias("name"), F.col("c_acctbal").alias("balance"), F.col("c_mktsegment").alias("segment"))
    s = table(spark, d, "supplier").select(F.col("s_acctbal").alias("balance"), F.col("s_name").alias("name"), F.col("s_suppkey").alias("key"))
    return union_by_name(c, s)


@query("scenario_expand", f"""WITH w AS (SELECT obs_id, date, kind FROM ({SAMPLES_SQL}) WHERE date BETWEEN DATE '{WINDOW_START}' AND DATE '{WINDOW_END}')
SELECT obs_id, date, 'actual' AS scenario, kind AS impact FROM w UNION ALL SELECT obs_id, date, 'counterfactual', 'zero' FROM w""")
def scenario_expand(spark, d):
    s = filter_window(samples(spark, d), "ts", WINDOW_START, WINDOW_END)
    return scenarios(s.select("obs_id", "date", F.col("kind").alias("impact")), "impact").select("obs_id", "date", "scenario", "impact")


@query("stack_observed_predicted", f"""WITH x AS ({DRAWS_SQL}) SELECT vec_id, 'Observed' AS type, CAST(label AS DOUBLE) AS value FROM embeddings
UNION ALL SELECT vec_id, 'Predicted', {rq('value')} FROM x""")
def stack_types(spark, d):
    e = packed_vectors(spark, d)
    long = explode_draws(e.select("vec_id", "embedding"), "embedding").withColumn("value", r("value"))
    return stack_observed_predicted(e, long, F.col("label").cast("double"), ["vec_id"])


# The feature table on these tables: line items are the samples, orders the daily weather. Days
# without an urgent order have no rainfall, so the filled column has real gaps.
WEATHER_SQL = f"""WITH s AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(l_shipdate AS DATE) AS date, l_extendedprice AS total
  FROM lineitem WHERE l_extendedprice IS NOT NULL),
sun AS (SELECT CAST(o_orderdate AS DATE) AS date, count(*) AS solar_exposure FROM orders GROUP BY 1),
wet AS (SELECT CAST(o_orderdate AS DATE) AS date, CAST(max(o_custkey) AS DOUBLE) AS rainfall FROM orders WHERE o_orderpriority = '1-URGENT' GROUP BY 1),
j AS (SELECT s.*, sun.solar_exposure, wet.rainfall FROM s LEFT JOIN sun ON s.date = sun.date LEFT JOIN wet ON s.date = wet.date),
f AS (SELECT * EXCLUDE (rainfall), coalesce(last_value(rainfall IGNORE NULLS) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
  first_value(rainfall IGNORE NULLS) OVER (w ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS rainfall
  FROM j WINDOW w AS (ORDER BY date, l_orderkey, l_linenumber, l_partkey, l_suppkey))
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, date, solar_exposure, rainfall, {rq('log10(total)')} AS log10_phytoplankton,
CASE WHEN date BETWEEN DATE '1998-07-14' AND DATE '1998-11-30' THEN 'high' ELSE 'zero' END AS impact,
CASE WHEN date BETWEEN DATE '1998-12-01' AND DATE '1999-01-31' THEN 'high' ELSE 'zero' END AS impact_late,
CAST(month(date) AS BIGINT) AS month_of_year,
{rq('CASE WHEN count(rainfall) OVER (w ROWS BETWEEN CURRENT ROW AND 1 FOLLOWING) = 2 THEN avg(rainfall) OVER (w ROWS BETWEEN CURRENT ROW AND 1 FOLLOWING) END')} AS rainfall48,
{rq('CASE WHEN count(rainfall) OVER (w ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) = 3 THEN avg(rainfall) OVER (w ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) END')} AS rainfall72
FROM f WINDOW w AS (ORDER BY date, l_orderkey, l_linenumber, l_partkey, l_suppkey)"""


@query("weather_features", WEATHER_SQL)
def weather_features(spark, d, method="auto"):
    li = table(spark, d, "lineitem").select(*KEYS, F.col("l_shipdate").cast("date").alias("date"), F.col("l_extendedprice").alias("total_phytoplankton"))
    orders = table(spark, d, "orders").withColumn("date", F.col("o_orderdate").cast("date"))
    sun = orders.groupBy("date").agg(F.count(F.lit(1)).alias("solar_exposure"))
    wet = orders.filter(F.col("o_orderpriority") == "1-URGENT").groupBy("date").agg(F.max("o_custkey").cast("double").alias("rainfall"))
    windows = {"impact": ("1998-07-14", "1998-11-30"), "impact_late": ("1998-12-01", "1999-01-31")}
    out = bay_features(li, sun, wet, windows, ["date", *KEYS], check_unique=False, method=method)
    return out.select(
        *KEYS, "date", "solar_exposure", "rainfall", r("log10_phytoplankton").alias("log10_phytoplankton"), "impact", "impact_late",
        F.col("month_of_year").cast("bigint"), r("rainfall48").alias("rainfall48"), r("rainfall72").alias("rainfall72"))


@query("weather_features_ranges", WEATHER_SQL)
def weather_ranges(spark, d):
    return weather_features(spark, d, method="ranges")


BAY_SQL = f"""WITH s AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(l_shipdate AS DATE) AS date, l_extendedprice AS total,
  CASE WHEN l_partkey % 5 <> 0 THEN l_quantity END AS temp, CASE WHEN l_suppkey % 7 <> 0 THEN l_tax END AS chlorophyll, l_discount AS pseudo FROM lineitem),
wet AS (SELECT CAST(o_orderdate AS DATE) AS date, CAST(max(o_custkey) AS DOUBLE) AS rainfall FROM orders GROUP BY 1),
j AS (SELECT s.*, wet.rainfall FROM s LEFT JOIN wet ON s.date = wet.date),
f AS (SELECT * REPLACE (coalesce(last_value(temp IGNORE NULLS) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
  first_value(temp IGNORE NULLS) OVER (w ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS temp)
  FROM j WINDOW w AS (ORDER BY date, l_orderkey, l_linenumber, l_partkey, l_suppkey))
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, temp, chlorophyll, {rq('pseudo / max(pseudo) OVER ()')} AS pseudo_scaled,
{rq('CASE WHEN count(temp) OVER (w ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) = 3 THEN avg(temp) OVER (w ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) END')} AS temp72,
{rq('CASE WHEN count(chlorophyll) OVER (w ROWS BETWEEN CURRENT ROW AND 1 FOLLOWING) = 2 THEN avg(chlorophyll) OVER (w ROWS BETWEEN CURRENT ROW AND 1 FOLLOWING) END')} AS chlorophyll48
FROM f WINDOW w AS (ORDER BY date, l_orderkey, l_linenumber, l_partkey, l_suppkey)"""


@query("bay_features_columns", BAY_SQL)
def bay_columns(spark, d):
    """Declared columns: one filled, two with rolling means, one read from text, one scaled."""
    li = table(spark, d, "lineitem").select(
        *KEYS, F.col("l_shipdate").cast("date").alias("date"), F.col("l_extendedprice").alias("total_phytoplankton"), F.col("l_discount").alias("pseudo"),
        F.when(F.col("l_partkey") % 5 != 0, F.col("l_quantity")).alias("temp"),
        F.when(F.col("l_suppkey") % 7 != 0, F.col("l_tax").cast("string")).otherwise("n.d.").alias("chlorophyll"))
    orders = table(spark, d, "orders").withColumn("date", F.col("o_orderdate").cast("date"))
    wet = orders.groupBy("date").agg(F.max("o_custkey").cast("double").alias("rainfall"))
    out = bay_features(
        li, orders.groupBy("date").agg(F.count(F.lit(1)).alias("solar_exposure")), wet, {}, ["date", *KEYS], check_unique=False,
        rolling={"temp72": ("temp", 3), "chlorophyll48": ("chlorophyll", 2)}, filled=["temp"], numbers=["chlorophyll"], scaled=["pseudo"])
    return out.select(*KEYS, "temp", "chlorophyll", *[r(c).alias(c) for c in ("pseudo_scaled", "temp72", "chlorophyll48")])


# Sites of the harvest query, dealt by number: area, second area, canonical name, impact in the table.
HARVEST_SITES = [
    ("Wagonga", "Inlet", "Wagonga", "zero"), ("Wonboyn", "Lake", "Wonboyn", "high"), (None, "Lake", "Pambula", "low"),
    ("Wallis", "Lake", "Wallis Lake", "low"), ("Far", "Away", "Far Away", None),
]
HARVEST_SQL = f"""WITH t(k, location, base, latitude) AS (VALUES (0, 'Wagonga', 'zero', -36.22161e0), (1, 'Wonboyn', 'high', -37.24121e0), (2, 'Pambula', 'low', -36.96522e0),
  (3, 'Wallis Lake', 'low', -32.18268e0), (4, 'Far Away', NULL, NULL)),
s AS (SELECT event_id, CAST(ts AS DATE) AS date, user_id, event_type, value, location, base, latitude FROM events JOIN t ON event_id % 5 = k),
c AS (SELECT date, location, count(*) AS views FROM s WHERE event_type = 'view' GROUP BY 1, 2)
SELECT event_id, location, latitude, CASE WHEN date < DATE '2024-01-15' THEN 'zero' WHEN location = 'Wagonga' THEN 'med' WHEN location = 'Wallis Lake' THEN 'high' ELSE base END AS impact,
CAST(floor(date_diff('day', (SELECT min(date) FROM s), date) / 7) AS BIGINT) AS week, CAST(month(date) AS BIGINT) AS month_of_year, views,
{rq('value / (SELECT max(value) FROM s)')} AS pseudo_scaled FROM s LEFT JOIN c USING (date, location)"""


@query("harvest_features", HARVEST_SQL)
def harvest(spark, d):
    """Many-site samples: names put right, impact since a day with overrides, latitude, daily covariates, scaled counts."""
    pick = lambda i: F.get(F.array(*[F.lit(site[i]) for site in HARVEST_SITES]), (F.col("event_id") % 5).cast("int"))
    e = table(spark, d, "events").withColumns({"date": F.col("ts").cast("date"), "area": pick(0), "area2": pick(1), "pseudo": F.col("value")})
    views = e.filter(F.col("event_type") == "view").groupBy("date", pick(2).alias("location")).agg(F.count(F.lit(1)).alias("views"))
    impacts = spark.createDataFrame([(s[2], s[3]) for s in HARVEST_SITES], "location string, impact string")
    out = harvest_features(e.select("event_id", "date", "area", "area2", "pseudo"), impacts, views, cutoff="2024-01-15", scaled=["pseudo"], check_unique=False)
    return out.select("event_id", "location", "latitude", "impact", "week", F.col("month_of_year").cast("bigint"), "views", r("pseudo_scaled").alias("pseudo_scaled"))


@query("station_features", f"""WITH s AS ({SAMPLES_SQL}), k AS (SELECT obs_id, date, reading FROM s WHERE reading IS NOT NULL)
SELECT obs_id, {rq('CASE WHEN reading > 0 THEN log10(reading) END')} AS log10_phytoplankton, CAST(month(date) AS BIGINT) AS month_of_year,
CASE WHEN date BETWEEN DATE '{WINDOW_START}' AND DATE '{WINDOW_END}' THEN 'low' ELSE 'zero' END AS impact,
{rq('reading / (SELECT max(reading) FROM k)')} AS pseudo_scaled, (SELECT max(reading) FROM k) AS pseudo_max FROM k""")
def station(spark, d):
    s = samples(spark, d).select("obs_id", "date", F.col("reading").alias("total_phytoplankton"), F.col("reading").alias("pseudo"))
    out = station_features(s, WINDOW_START, WINDOW_END, scaled=["pseudo"])
    return out.select("obs_id", r("log10_phytoplankton").alias("log10_phytoplankton"), F.col("month_of_year").cast("bigint"), "impact",
                      r("pseudo_scaled").alias("pseudo_scaled"), "pseudo_max")


# ---------------------------------------------------------------- stages laid out for their readers


def stage_path(spark) -> tuple[str, str]:
    """A fresh table name, and a folder for it in the shared checkpoint folder."""
    name = f"stage_{uuid.uuid4().hex}"
    return name, f"{ensure_checkpoint_dir(spark)}/stages/{name}"


@query("stage_clustered_join", f"""SELECT l_orderkey, l_linenumber, o_custkey, {rq('l_extendedprice / o_totalprice', 8)} AS share
FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE o_totalprice > 0""")
def clustered_join(spark, d):
    """Orders and their lines as stages clustered by order, joined where they lie."""
    orders = table(spark, d, "orders").select(F.col("o_orderkey").alias("key"), "o_custkey", "o_totalprice").filter("o_totalprice > 0")
    lines = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("key"), "l_linenumber", "l_extendedprice")
    one, two = (write_clustered(df, *stage_path(spark), ["key"]) for df in (orders, lines))
    share = F.col("l_extendedprice") / F.col("o_totalprice")
    return one.hint("merge").join(two, "key").select(F.col("key").alias("l_orderkey"), "l_linenumber", "o_custkey", r(share, 8).alias("share"))


@query("stage_dated_window", f"""SELECT date, kind, count(*) AS n, {rq('sum(count)', 4)} AS total FROM ({SAMPLES_SQL})
WHERE date BETWEEN DATE '{WINDOW_START}' AND DATE '{WINDOW_END}' AND (date <> DATE '{WINDOW_END}' OR kind <> 'error') GROUP BY date, kind""")
def dated_window(spark, d):
    """Samples in folders by day; the last day of the window is written anew without its errors, and the window read back."""
    s = samples(spark, d)
    _, path = stage_path(spark)
    write_dated(s, path, "date")
    write_dated(s.filter((F.col("date") == F.lit(WINDOW_END).cast("date")) & (F.col("kind") != "error")), path, "date")
    window = read_dated(spark, path, "date", WINDOW_START, WINDOW_END)
    return window.groupBy("date", "kind").agg(F.count("*").alias("n"), r(F.sum("count"), 4).alias("total"))
