"""Conditional effects: the response along one predictor with the others held fixed."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.summary import median_qi
from .design import design
from .fit import Draws
from .predict import expected_draws


def effect_grid(df: DataFrame, numeric: Sequence[str], factors: Mapping[str, Sequence], points: int = 100) -> DataFrame:
    """Grid rows per predictor: numeric ones from minimum to maximum, factors over their levels.

    The other numeric columns stand at their mean, the other factors at their first level.
    Columns: effect, grid_point, x_value (numeric), level (factor), then the predictors.
    """
    stats = df.agg(*[
        f(c).cast("double").alias(f"_{t}_{c}") for c in numeric for t, f in (("lo", F.min), ("hi", F.max), ("mid", F.avg))
    ])
    cells = [(c, points) for c in numeric] + [(c, len(levels)) for c, levels in factors.items()]
    rows = stats.select("*", F.inline(F.array(*[
        F.struct(F.lit(c).alias("effect"), F.sequence(F.lit(0), F.lit(n - 1)).alias("_points")) for c, n in cells
    ]))).withColumn("grid_point", F.explode("_points"))
    columns = {}
    for c in numeric:
        along = F.col(f"_lo_{c}") + F.col("grid_point") * (F.col(f"_hi_{c}") - F.col(f"_lo_{c}")) / F.lit(float(max(points - 1, 1)))
        columns[c] = F.when(F.col("effect") == c, along).otherwise(F.col(f"_mid_{c}"))
    for c, levels in factors.items():
        values = F.array(*[F.lit(v) for v in levels])
        columns[c] = F.when(F.col("effect") == c, F.get(values, F.col("grid_point"))).otherwise(F.lit(levels[0]))
    x_value = F.coalesce(*[F.when(F.col("effect") == c, columns[c]) for c in numeric], F.lit(None).cast("double"))
    level = F.coalesce(
        *[F.when(F.col("effect") == c, columns[c].cast("string")) for c in factors], F.lit(None).cast("string")
    )
    return rows.select("effect", "grid_point", x_value.alias("x_value"), level.alias("level"), *[v.alias(c) for c, v in columns.items()])


def conditional_effects(grid: DataFrame, draws: Draws, family: str, spec: Mapping, width: float = 0.95) -> DataFrame:
    """Median and interval of the expected response at each grid row.

    A model with site effects is taken at the level of the population, where they are zero, unless the grid names a site.
    """
    site = spec.get("site")
    if site and site["column"] not in grid.columns:
        grid = grid.withColumn(site["column"], F.lit(None))
    keys = ["effect", "grid_point", "x_value", "level"]
    parts = int(grid.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    grid = grid.repartition(parts, "effect", "grid_point")  # few rows, before the draws multiply them
    values = expected_draws(design(grid, spec), draws, family)
    # A group holds one value per draw, so the exact aggregate is bounded.
    return median_qi(values, keys, "value", width, method="exact")
