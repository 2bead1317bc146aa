"""Queries for ordered-row operators, each as one window per group and as ranges."""

from __future__ import annotations

from pyspark.sql import functions as F

from emberfield.operators.windows import ccdf, fill_down_up, rolling_mean, row_id

from .common import SAMPLES_SQL, query, r, rq, samples, table

ORDER = ["ts", "obs_id"]
LINE = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]


def rolling_sql(k: int, frame: str, part: str) -> str:
    w = f"OVER ({part} ORDER BY ts, obs_id ROWS BETWEEN {frame})"
    return f"""SELECT obs_id, {rq(f'CASE WHEN count(reading) {w} = {k} THEN avg(reading) {w} END')} AS mean FROM ({SAMPLES_SQL})"""


def rolling(k: int, by: list[str], method: str):
    def run(spark, d):
        s = samples(spark, d).select("obs_id", "ts", "site", "reading")
        return rolling_mean(s, {"mean": ("reading", k)}, ORDER, by, method=method).select("obs_id", r("mean").alias("mean"))

    return run


SITE = "PARTITION BY site"
query("rolling_mean_3", rolling_sql(3, "1 PRECEDING AND 1 FOLLOWING", SITE))(rolling(3, ["site"], "auto"))
query("rolling_mean_2", rolling_sql(2, "CURRENT ROW AND 1 FOLLOWING", SITE))(rolling(2, ["site"], "auto"))
query("rolling_mean_3_ranges", rolling_sql(3, "1 PRECEDING AND 1 FOLLOWING", SITE))(rolling(3, ["site"], "ranges"))
query("rolling_mean_2_ungrouped", rolling_sql(2, "CURRENT ROW AND 1 FOLLOWING", ""))(rolling(2, [], "ranges"))


def fill_sql(part: str) -> str:
    w = f"{part} ORDER BY ts, obs_id ROWS BETWEEN"
    return f"""SELECT obs_id, coalesce(last_value(reading IGNORE NULLS) OVER ({w} UNBOUNDED PRECEDING AND CURRENT ROW),
first_value(reading IGNORE NULLS) OVER ({w} CURRENT ROW AND UNBOUNDED FOLLOWING)) AS filled FROM ({SAMPLES_SQL})"""


def filled(by: list[str], method: str):
    def run(spark, d):
        s = samples(spark, d).select("obs_id", "ts", "site", "reading")
        return fill_down_up(s, ["reading"], ORDER, by, method=method).select("obs_id", F.col("reading").alias("filled"))

    return run


query("fill_down_up", fill_sql(SITE))(filled(["site"], "auto"))
query("fill_down_up_ranges", fill_sql(SITE))(filled(["site"], "ranges"))
query("fill_down_up_ungrouped", fill_sql(""))(filled([], "ranges"))

CCDF_SQL = f"""SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_returnflag, l_quantity,
{rq('''CAST(count(*) OVER (PARTITION BY l_returnflag) - row_number() OVER
(PARTITION BY l_returnflag ORDER BY l_quantity, l_orderkey, l_linenumber, l_partkey, l_suppkey) + 1 AS DOUBLE)
/ count(*) OVER (PARTITION BY l_returnflag)''', 9)} AS ccdf FROM lineitem"""


def curve(method: str):
    def run(spark, d):
        li = table(spark, d, "lineitem").select(*LINE, "l_returnflag", "l_quantity")
        out = ccdf(li, ["l_returnflag"], "l_quantity", LINE, method=method)
        return out.withColumn("ccdf", r("ccdf", 9))

    return run


query("ccdf", CCDF_SQL)(curve("auto"))
query("ccdf_ranges", CCDF_SQL)(curve("ranges"))

CCDF_GAPS_SQL = f"""WITH g AS (SELECT * REPLACE (CASE WHEN l_orderkey % 97 <> 0 THEN l_quantity END AS l_quantity) FROM lineitem)
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_returnflag, l_quantity, CASE WHEN l_quantity IS NOT NULL THEN
{rq('''CAST(count(l_quantity) OVER (PARTITION BY l_returnflag) - row_number() OVER
(PARTITION BY l_returnflag ORDER BY l_quantity NULLS LAST, l_orderkey, l_linenumber, l_partkey, l_suppkey) + 1 AS DOUBLE)
/ count(l_quantity) OVER (PARTITION BY l_returnflag)''', 9)} END AS ccdf FROM g"""


def curve_gaps(method: str):
    def run(spark, d):
        li = table(spark, d, "lineitem").select(*LINE, "l_returnflag", F.when(F.col("l_orderkey") % 97 != 0, F.col("l_quantity")).alias("l_quantity"))
        out = ccdf(li, ["l_returnflag"], "l_quantity", LINE, method=method)
        return out.withColumn("ccdf", r("ccdf", 9))

    return run


query("ccdf_gaps", CCDF_GAPS_SQL)(curve_gaps("auto"))
query("ccdf_gaps_ranges", CCDF_GAPS_SQL)(curve_gaps("ranges"))

ROW_ID_SQL = "SELECT o_orderkey, row_number() OVER (ORDER BY o_orderdate, o_orderkey) AS id FROM orders"


def numbered(method: str):
    def run(spark, d):
        o = table(spark, d, "orders").select("o_orderkey", "o_orderdate")
        return row_id(o, ["o_orderdate", "o_orderkey"], method=method).select("o_orderkey", "id")

    return run


query("row_id", ROW_ID_SQL)(numbered("auto"))
query("row_id_ranges", ROW_ID_SQL)(numbered("ranges"))
