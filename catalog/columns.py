"""Queries for sources, projections, filters, recodes and scalar functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from emberfield.functions import (
    MONTH_NAMES, as_number, build_date, build_date_named, is_finite_log, ln_positive, log10_positive, month_of, paste, pow10,
    scale_units, week_index,
)
from emberfield.operators.categorical import (
    binary_recode, canonicalise, impact_since, impact_window, label, level_rank, lookup, order_levels_by, relevel, with_levels,
)
from emberfield.operators.clean import constant, filter_since, filter_window, in_window, keep_positive, keep_present, rename
from emberfield.operators.reshape import to_long, union_by_name
from emberfield.sources import drop_embedded_headers, rename_positional

from .common import IMPACT_ORDER, KIND_IMPACT, SAMPLES_SQL, WINDOW_END, WINDOW_START, case_sql, kinds, query, r, rq, samples, table

YEARS = [1995, 1996, 1997, 1998, 1999, 2000, 2001]


def year_bounds(y: int) -> tuple[str | None, str | None]:
    """First and last day of a slice; the outer slices are open, so that no day is lost."""
    return (None if y == YEARS[0] else f"{y}-01-01"), (None if y == YEARS[-1] else f"{y}-12-31")


def year_sql(y: int) -> str:
    first, last = year_bounds(y)
    return " AND ".join(["TRUE", *([f"o_orderdate >= DATE '{first}'"] if first else []), *([f"o_orderdate < DATE '{y + 1}-01-01'"] if last else [])])


@query("union_yearly", "\nUNION ALL\n".join(
    f"SELECT o_orderkey, CAST({y} AS BIGINT) AS year, o_totalprice, "
    + ("CAST(NULL AS VARCHAR)" if y == YEARS[-1] else "o_orderpriority") + " AS priority "
    f"FROM orders WHERE {year_sql(y)}" for y in YEARS))
def union_yearly(spark, d):
    """One slice per year, the first and the last one open; the last layout lacks a column."""
    orders = table(spark, d, "orders")
    parts = []
    for y in YEARS:
        part = filter_window(orders, "o_orderdate", *year_bounds(y))
        cols = ["o_orderkey", F.lit(y).cast("bigint").alias("year"), "o_totalprice"]
        if y != YEARS[-1]:
            cols.append(F.col("o_orderpriority").alias("priority"))
        parts.append(part.select(*cols))
    return union_by_name(*parts)


CUSTOMER_TEXT_SQL = """SELECT c_custkey, 'c_name' AS name, c_name AS value FROM customer
UNION ALL SELECT c_custkey, 'c_nationkey', CAST(c_nationkey AS VARCHAR) FROM customer
UNION ALL SELECT c_custkey, 'c_mktsegment', c_mktsegment FROM customer"""


def customer_text(spark, d):
    """Numbers and texts in one text column, as a sheet with embedded headings has them."""
    c = table(spark, d, "customer").withColumn("c_nationkey", F.col("c_nationkey").cast("string"))
    return to_long(c, ["c_custkey"], ["c_name", "c_nationkey", "c_mktsegment"])


@query("drop_header_rows", f"""SELECT c_custkey, name, value FROM ({CUSTOMER_TEXT_SQL})
WHERE TRY_CAST(value AS INTEGER) IS NOT NULL""")
def drop_header_rows(spark, d):
    return drop_embedded_headers(customer_text(spark, d), "value")


@query("try_cast_numeric", f"SELECT c_custkey, name, TRY_CAST(value AS DOUBLE) AS number FROM ({CUSTOMER_TEXT_SQL})")
def try_cast_numeric(spark, d):
    return customer_text(spark, d).select("c_custkey", "name", as_number("value").alias("number"))


@query("project_select", "SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem")
def project_select(spark, d):
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity")


@query("project_rename", "SELECT o_orderkey AS sample, o_custkey AS site, o_totalprice AS total FROM orders")
def project_rename(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_totalprice")
    return rename(o, {"o_orderkey": "sample", "o_custkey": "site", "o_totalprice": "total"})


@query("rename_positional", "SELECT n_nationkey AS id, n_name AS label, n_regionkey AS parent FROM nation")
def rename_by_position(spark, d):
    return rename_positional(table(spark, d, "nation"), ["id", "label", "parent"])


@query("derive_columns", f"""SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey,
{rq('l_extendedprice * (1 - l_discount)')} AS net, {rq('l_extendedprice * (1 - l_discount) * (1 + l_tax)')} AS gross
FROM lineitem""")
def derive_columns(spark, d):
    li = table(spark, d, "lineitem")
    net = F.col("l_extendedprice") * (1 - F.col("l_discount"))
    return li.withColumns({"net": r(net), "gross": r(net * (1 + F.col("l_tax")))}).select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "net", "gross")


@query("constant_column", "SELECT o_orderkey, 'San Francisco' AS location FROM orders")
def constant_column(spark, d):
    return constant(table(spark, d, "orders").select("o_orderkey"), location="San Francisco")


@query("unit_scale", f"SELECT l_orderkey, l_linenumber, l_partkey, {rq('l_quantity * CAST(2.5 AS DOUBLE)')} AS scaled FROM lineitem")
def unit_scale(spark, d):
    return table(spark, d, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", r(scale_units("l_quantity", 2.5)).alias("scaled"))


@query("filter_not_null", f"SELECT obs_id, reading FROM ({SAMPLES_SQL}) WHERE reading IS NOT NULL")
def filter_not_null(spark, d):
    return keep_present(samples(spark, d), "reading").select("obs_id", "reading")


@query("filter_since", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderdate >= DATE '1998-03-01'")
def since(spark, d):
    return filter_since(table(spark, d, "orders"), "o_orderdate", "1998-03-01").select("o_orderkey", "o_totalprice")


@query("filter_window", """SELECT event_id, user_id, value FROM events
WHERE CAST(ts AS DATE) BETWEEN DATE '2024-01-10' AND DATE '2024-01-20'""")
def window(spark, d):
    return filter_window(table(spark, d, "events"), "ts", WINDOW_START, WINDOW_END).select("event_id", "user_id", "value")


@query("filter_equals", "SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem WHERE l_returnflag = 'R' AND l_linestatus <> 'O'")
def filter_equals(spark, d):
    li = table(spark, d, "lineitem")
    return li.filter((F.col("l_returnflag") == "R") & (F.col("l_linestatus") != "O")).select(
        "l_orderkey", "l_linenumber", "l_partkey")


@query("filter_positive", "SELECT l_orderkey, l_linenumber, l_partkey, l_tax FROM lineitem WHERE l_tax > 0")
def filter_positive(spark, d):
    return keep_positive(table(spark, d, "lineitem"), "l_tax").select("l_orderkey", "l_linenumber", "l_partkey", "l_tax")


@query("filter_finite_log", f"""SELECT l_orderkey, l_linenumber, l_partkey, {rq('ln(l_discount)')} AS log_value
FROM lineitem WHERE l_discount > 0""")
def filter_finite_log(spark, d):
    li = table(spark, d, "lineitem").filter(is_finite_log("l_discount"))
    return li.select("l_orderkey", "l_linenumber", "l_partkey", r(F.log("l_discount")).alias("log_value"))


PRIORITY = {"1-URGENT": "Urgent", "2-HIGH": "High", "3-MEDIUM": "Medium", "5-LOW": "Low"}


@query("case_label", f"SELECT o_orderkey, {case_sql('o_orderpriority', PRIORITY)} AS label FROM orders")
def case_label(spark, d):
    return table(spark, d, "orders").select("o_orderkey", label("o_orderpriority", PRIORITY).alias("label"))


TYPE_ALIASES = {"ECONOMY": "BUDGET", "PROMO": "BUDGET", "LARGE": "BIG"}


@query("alias_canonicalise", f"SELECT p_partkey, coalesce({case_sql('p_type', TYPE_ALIASES)}, p_type) AS p_type FROM part")
def alias_canonicalise(spark, d):
    aliases = spark.createDataFrame(list(TYPE_ALIASES.items()), "alias string, canonical string")
    return canonicalise(table(spark, d, "part"), "p_type", aliases).select("p_partkey", "p_type")


SEGMENT_LATITUDES = {"AUTOMOBILE": -31.64478, "BUILDING": -34.02245, "FURNITURE": -31.40406, "MACHINERY": -33.5443}


@query("lookup_dim", "SELECT c_custkey, CAST(CASE c_mktsegment "
       + " ".join(f"WHEN '{k}' THEN {v}" for k, v in SEGMENT_LATITUDES.items()) + " END AS DOUBLE) AS latitude FROM customer")
def lookup_dim(spark, d):
    dim = spark.createDataFrame(list(SEGMENT_LATITUDES.items()), "segment string, latitude double")
    return lookup(table(spark, d, "customer"), "c_mktsegment", dim, "segment", ["latitude"]).select("c_custkey", "latitude")


@query("impact_since", f"""SELECT obs_id, CASE WHEN date < DATE '2024-01-15' THEN 'zero' WHEN kind = 'purchase' THEN 'high'
WHEN kind = 'view' THEN 'low' ELSE {case_sql('kind', KIND_IMPACT)} END AS impact FROM ({SAMPLES_SQL})""")
def impact_after(spark, d):
    df = lookup(samples(spark, d), "kind", kinds(spark), "kind_name", ["kind_impact"])
    impact = impact_since("date", "2024-01-15", "kind_impact", "kind", {"purchase": "high", "view": "low"})
    return df.select("obs_id", impact.alias("impact"))


@query("impact_window", f"""SELECT obs_id, CASE WHEN date BETWEEN DATE '2024-01-10' AND DATE '2024-01-20' THEN 'high' ELSE 'zero' END AS impact
FROM ({SAMPLES_SQL})""")
def impact_inside(spark, d):
    return samples(spark, d).select("obs_id", impact_window("date", WINDOW_START, WINDOW_END).alias("impact"))


# The same with gaps: a missing date or code stays missing.
GAP = "obs_id % 97 = 0"


def gapped(df, column: str, key: str = "obs_id"):
    return df.withColumn(column, F.when(F.col(key) % 97 != 0, F.col(column)))


@query("impact_since_gaps", f"""SELECT obs_id, CASE WHEN {GAP} THEN NULL WHEN date < DATE '2024-01-15' THEN 'zero' WHEN kind = 'purchase' THEN 'high'
WHEN kind = 'view' THEN 'low' ELSE {case_sql('kind', KIND_IMPACT)} END AS impact FROM ({SAMPLES_SQL})""")
def impact_after_gaps(spark, d):
    df = lookup(gapped(samples(spark, d), "date"), "kind", kinds(spark), "kind_name", ["kind_impact"])
    return df.select("obs_id", impact_since("date", "2024-01-15", "kind_impact", "kind", {"purchase": "high", "view": "low"}).alias("impact"))


@query("impact_window_gaps", f"""SELECT obs_id, CASE WHEN {GAP} THEN NULL WHEN date BETWEEN DATE '2024-01-10' AND DATE '2024-01-20' THEN 'high' ELSE 'zero' END AS impact
FROM ({SAMPLES_SQL})""")
def impact_inside_gaps(spark, d):
    return gapped(samples(spark, d), "date").select("obs_id", impact_window("date", WINDOW_START, WINDOW_END).alias("impact"))


@query("binary_recode_gaps", "SELECT o_orderkey, CASE WHEN o_orderkey % 97 = 0 THEN NULL WHEN o_orderstatus = 'F' THEN 'High' ELSE 'Zero' END AS impact FROM orders")
def recode_gaps(spark, d):
    return gapped(table(spark, d, "orders"), "o_orderstatus", "o_orderkey").select("o_orderkey", binary_recode("o_orderstatus", "F", "High", "Zero").alias("impact"))


LEVELS = ["SMALL", "MEDIUM", "LARGE"]


@query("factor_levels", """SELECT p_partkey, CASE WHEN p_type IN ('SMALL', 'MEDIUM', 'LARGE') THEN p_type END AS level,
CAST(CASE p_type WHEN 'SMALL' THEN 0 WHEN 'MEDIUM' THEN 1 WHEN 'LARGE' THEN 2 END AS BIGINT) AS level_rank FROM part""")
def factor_levels(spark, d):
    return table(spark, d, "part").select(
        "p_partkey", with_levels("p_type", LEVELS).alias("level"), level_rank("p_type", LEVELS).cast("bigint").alias("level_rank"))


@query("factor_relevel", """SELECT p_partkey, CAST(CASE p_type WHEN 'LARGE' THEN 0 WHEN 'SMALL' THEN 1 WHEN 'MEDIUM' THEN 2 END AS BIGINT)
AS level_rank FROM part""")
def factor_relevel(spark, d):
    levels = relevel(LEVELS, "LARGE")
    return table(spark, d, "part").select("p_partkey", level_rank("p_type", levels).cast("bigint").alias("level_rank"))


@query("factor_reorder", f"""WITH m AS (SELECT p_brand, quantile_cont(p_retailprice, 0.5) AS median FROM part GROUP BY p_brand)
SELECT p_brand, {rq('median')} AS median, row_number() OVER (ORDER BY median DESC, p_brand) AS level_rank FROM m""")
def factor_reorder(spark, d):
    ranked = order_levels_by(table(spark, d, "part"), "p_brand", "p_retailprice", desc=True)
    return ranked.select("p_brand", r("median").alias("median"), F.col("level_rank").cast("bigint"))


@query("binary_recode", "SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN 'High' ELSE 'Zero' END AS impact FROM orders")
def recode(spark, d):
    return table(spark, d, "orders").select("o_orderkey", binary_recode("o_orderstatus", "F", "High", "Zero").alias("impact"))


@query("date_month", "SELECT o_orderkey, CAST(month(o_orderdate) AS BIGINT) AS month FROM orders")
def date_month(spark, d):
    return table(spark, d, "orders").select("o_orderkey", month_of("o_orderdate").cast("bigint").alias("month"))


@query("week_index", """SELECT o_orderkey, CAST(floor(date_diff('day', (SELECT min(CAST(o_orderdate AS DATE)) FROM orders),
CAST(o_orderdate AS DATE)) / 7) AS BIGINT) AS week FROM orders""")
def weeks(spark, d):
    o = table(spark, d, "orders")
    first = o.agg(F.min("o_orderdate")).scalar()
    return o.select("o_orderkey", week_index("o_orderdate", first).alias("week"))


@query("build_date", """SELECT o_orderkey, TRY_CAST(printf('%04d-%02d-%02d', year(o_orderdate), month(o_orderdate), day(o_orderdate) + 2) AS DATE)
AS built FROM orders""")
def dates(spark, d):
    """Day plus two: past the end of a month there is no such date."""
    o = table(spark, d, "orders")
    return o.select("o_orderkey", build_date(F.year("o_orderdate"), F.month("o_orderdate"), F.day("o_orderdate") + 2).alias("built"))


@query("build_date_named", """SELECT o_orderkey, TRY_CAST(printf('%04d-%02d-%02d', year(o_orderdate), month(o_orderdate), day(o_orderdate) + 1) AS DATE)
AS built FROM orders""")
def named_dates(spark, d):
    o = table(spark, d, "orders")
    name = F.get(F.array(*[F.lit(m) for m in MONTH_NAMES]), F.month("o_orderdate") - 1)
    return o.select("o_orderkey", build_date_named(F.year("o_orderdate"), name, F.day("o_orderdate") + 1).alias("built"))


@query("math_log10", f"SELECT o_orderkey, {rq('CASE WHEN o_totalprice > 0 THEN log10(o_totalprice) END')} AS value FROM orders")
def math_log10(spark, d):
    return table(spark, d, "orders").select("o_orderkey", r(log10_positive("o_totalprice")).alias("value"))


@query("math_pow10", f"SELECT l_orderkey, l_linenumber, l_partkey, {rq('pow(10, l_discount)')} AS value FROM lineitem")
def math_pow10(spark, d):
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", r(pow10("l_discount")).alias("value"))


@query("math_log_exp", f"""SELECT l_orderkey, l_linenumber, l_partkey, {rq('CASE WHEN l_discount > 0 THEN ln(l_discount) END')} AS log_value,
{rq('exp(l_tax)')} AS exp_value FROM lineitem""")
def math_log_exp(spark, d):
    return table(spark, d, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", r(ln_positive("l_discount")).alias("log_value"), r(F.exp("l_tax")).alias("exp_value"))


@query("math_arith", f"""SELECT l_orderkey, l_linenumber, l_partkey, {rq('l_quantity + l_tax')} AS plus, {rq('l_quantity - l_tax')} AS minus,
{rq('l_quantity * l_tax')} AS times, {rq('l_tax / nullif(l_quantity, 0)')} AS ratio, (l_tax > 0 AND l_discount <= CAST(0.05 AS DOUBLE)) AS both_hold
FROM lineitem""")
def math_arith(spark, d):
    q, t = F.col("l_quantity"), F.col("l_tax")
    return table(spark, d, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", r(q + t).alias("plus"), r(q - t).alias("minus"), r(q * t).alias("times"),
        r(F.try_divide(t, q)).alias("ratio"), ((t > 0) & (F.col("l_discount") <= 0.05)).alias("both_hold"))


@query("str_paste", f"""SELECT obs_id, coalesce(CASE WHEN kind <> 'error' THEN kind END, 'NA') || ' ' || CAST(site AS VARCHAR) AS text
FROM ({SAMPLES_SQL})""")
def str_paste(spark, d):
    kind = F.when(F.col("kind") != "error", F.col("kind"))
    return samples(spark, d).select("obs_id", paste(kind, "site", sep=" ").alias("text"))
