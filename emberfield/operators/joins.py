"""Left joins of observations to dimensions and daily covariates, and draw alignment by key."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import BROADCAST_CELLS, broadcast_if_small


def assert_unique(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Raise when a key occurs twice; a join on such a side would repeat observations."""
    doubled = df.groupBy(*keys).count().filter("count > 1").limit(1).collect()
    if doubled:
        raise ValueError(f"key {list(keys)} is not unique, for example {doubled[0].asDict()}")
    return df


def dimension(dim: DataFrame, keys: Sequence[str]) -> DataFrame:
    """A table to look up by ``keys``: a key that occurs twice is an error, and a small table is marked for broadcasting.

    One small job over the table tells both. A missing key matches nothing, so it may repeat.
    """
    counts = dim.dropna(subset=list(keys)).groupBy(*keys).count()
    row = counts.agg(F.sum("count").alias("rows"), F.max_by(F.struct(*keys), "count").alias("key"), F.max("count").alias("most")).first()
    if (row["most"] or 0) > 1:
        raise ValueError(f"key {list(keys)} is not unique, for example {row['key'].asDict()}")
    return F.broadcast(dim) if (row["rows"] or 0) * len(dim.columns) <= BROADCAST_CELLS else dim


def join_dimension(df: DataFrame, dim: DataFrame, left_key: str, right_key: str) -> DataFrame:
    """Left join to a small dimension whose key has another name; that key is dropped."""
    side = dim.withColumnRenamed(right_key, "_right_key").filter("_right_key IS NOT NULL")
    return df.join(dimension(side, ["_right_key"]), F.col(left_key) == F.col("_right_key"), "left").drop("_right_key")


def join_daily(
    df: DataFrame, daily: DataFrame, on: Sequence[tuple[str, str]] | Sequence[str], null_safe: bool = False,
    check_unique: bool = True, check_size: bool = False,
) -> DataFrame:
    """Left join to a table with one row per key.

    ``on`` holds column names or (left, right) pairs. With ``null_safe`` a missing key matches a
    missing key. Pass ``check_unique=False`` for a side that was just grouped by its key: the join then starts no job.
    Spark broadcasts a side that turns out small, and splits hot keys of a large one; ``check_size`` counts the
    side beforehand, for one that costs little to count.
    """
    pairs = [(k, k) if isinstance(k, str) else k for k in on]
    if check_unique:
        assert_unique(daily, [right for _, right in pairs])
    side = daily.withColumnsRenamed({right: f"_r_{right}" for _, right in pairs})
    tests: list[Column] = []
    for left, right in pairs:
        l, r = F.col(left), F.col(f"_r_{right}")
        tests.append(l.eqNullSafe(r) if null_safe else l == r)
    if check_size:
        side = broadcast_if_small(side)
    joined = df.join(side, reduce(lambda a, b: a & b, tests), "left")
    return joined.drop(*[f"_r_{right}" for _, right in pairs])


def align_by_key(draws: DataFrame, obs: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Observation columns beside each draw, matched by key and never by row position."""
    return draws.join(obs.select(*keys, *columns), list(keys), "inner")


def paired_contrast(
    df: DataFrame, keys: Sequence[str], scenario: str = "scenario", value: str = "value",
    actual: str = "actual", counterfactual: str = "counterfactual",
) -> DataFrame:
    """Actual minus counterfactual for each key, by one aggregation and no self-join.

    ``keys`` identify a pair (observation and draw), so a group holds two rows.
    """
    pick = lambda s: F.max(F.when(F.col(scenario) == s, F.col(value)))
    out = df.groupBy(*keys).agg(pick(actual).alias(actual), pick(counterfactual).alias(counterfactual))
    out = out.filter(F.col(actual).isNotNull() & F.col(counterfactual).isNotNull())
    return out.withColumn("difference", F.col(actual) - F.col(counterfactual))


def packed_contrast(df: DataFrame, actual: str, counterfactual: str, out: str = "difference") -> DataFrame:
    """The same contrast for draws packed as arrays in one row: no shuffle at all."""
    return df.withColumn(out, F.zip_with(actual, counterfactual, lambda a, b: a - b))
