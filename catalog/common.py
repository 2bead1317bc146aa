"""Registration, table access and the rounding used on both sides of a comparison."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

WINDOW_START, WINDOW_END = "2024-01-10", "2024-01-20"
# Impact level of each kind of event; the kind plays the part of the site in these tables.
KIND_IMPACT = {"click": "high", "purchase": "med", "signup": "low", "view": "high", "error": "zero"}
IMPACT_ORDER = ["zero", "low", "med", "high"]


def query(name: str, sql: str | None = None):
    """Register a query, with the SQL that must give the same rows."""

    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def r(col: Column | str, digits: int = 6) -> Column:
    """Rounded double without a negative zero."""
    col = F.col(col) if isinstance(col, str) else col
    return F.round(col.cast("double"), digits) + F.lit(0.0)


def rq(expr: str, digits: int = 6) -> str:
    """SQL twin of :func:`r`."""
    return f"(round(CAST({expr} AS DOUBLE), {digits}) + CAST(0 AS DOUBLE))"


def case_sql(column: str, mapping: dict[str, str]) -> str:
    whens = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in mapping.items())
    return f"CASE {column} {whens} END"


def kinds(spark: SparkSession) -> DataFrame:
    """Dimension: kind of event to impact level."""
    return spark.createDataFrame(list(KIND_IMPACT.items()), "kind_name string, kind_impact string")


def samples(spark: SparkSession, folder: str) -> DataFrame:
    """Events read as samples: an error event carries no reading."""
    e = table(spark, folder, "events")
    return e.select(
        F.col("event_id").alias("obs_id"), "ts", F.col("ts").cast("date").alias("date"), F.col("user_id").alias("site"),
        F.col("event_type").alias("kind"), F.col("value").alias("count"),
        F.when(F.col("event_type") != "error", F.col("value")).alias("reading"),
    )


SAMPLES_SQL = """SELECT event_id AS obs_id, ts, CAST(ts AS DATE) AS date, user_id AS site, event_type AS kind,
    value AS count, CASE WHEN event_type <> 'error' THEN value END AS reading FROM events"""
