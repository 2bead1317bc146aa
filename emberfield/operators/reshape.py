"""Wide and long forms, unions, scenario copies."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def to_long(df: DataFrame, ids: Sequence[str], values: Sequence[str], name: str = "name", value: str = "value") -> DataFrame:
    return df.unpivot(list(ids), list(values), name, value)


def paired_unpivot(
    df: DataFrame, ids: Sequence[str], pairs: Sequence[tuple[str, str, str]],
    name: str = "name", first: str = "first", second: str = "second",
) -> DataFrame:
    """Rows from column pairs that belong together: (label, first column, second column)."""
    cells = F.array(*[
        F.struct(F.lit(text).alias(name), F.col(a).alias(first), F.col(b).alias(second)) for text, a, b in pairs
    ])
    return df.select(*ids, F.inline(cells))


def explode_draws(df: DataFrame, draws: str, value: str = "value", draw_id: str = "draw_id") -> DataFrame:
    """One row per element of a packed draw array."""
    rest = [c for c in df.columns if c != draws]
    return df.select(*rest, F.posexplode(draws).alias(draw_id, value))


def union_by_name(*frames: DataFrame) -> DataFrame:
    """Stack tables by column name; a missing column is filled with NULL."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def scenarios(
    df: DataFrame, impact: str, level: str = "zero", scenario: str = "scenario",
    actual: str = "actual", counterfactual: str = "counterfactual",
) -> DataFrame:
    """Every row twice: as it was, and with the impact column set to ``level``.

    All other columns are kept, and the input is scanned once.
    """
    if impact not in df.columns:
        raise ValueError(f"no impact column {impact!r}")
    copies = df.withColumn(scenario, F.explode(F.array(F.lit(actual), F.lit(counterfactual))))
    forced = F.when(F.col(scenario) == counterfactual, F.lit(level)).otherwise(F.col(impact))
    return copies.withColumn(impact, forced)


def stack_observed_predicted(
    observed: DataFrame, predicted: DataFrame, response: str | Column, keys: Sequence[str], value: str = "value",
) -> DataFrame:
    """Observed and predicted values in one column with a ``type`` tag; each observation once."""
    response = F.col(response) if isinstance(response, str) else response
    seen = observed.select(*keys, F.lit("Observed").alias("type"), response.alias(value))
    made = predicted.select(*keys, F.lit("Predicted").alias("type"), F.col(value))
    return seen.unionByName(made)
