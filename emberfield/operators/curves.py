"""Density curves as tables: what a density plot draws."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import broadcast_if_small, durable
from .clean import clip_range
from .ordered import ALL
from .quantiles import group_quantiles


# Bandwidths beyond which a kernel is below 1e-17 of its height.
REACH = 9.0


def density_curve(
    df: DataFrame, by: Sequence[str], value: str, grid: int = 256, clip: tuple[float | None, float | None] = (None, None),
    method: str = "auto", largest: int | None = None,
) -> DataFrame:
    """Gaussian kernel density of each group on ``grid`` points from min - 3h to max + 3h.

    The bandwidth h is 0.9 min(sd, IQR/1.34) n^(-1/5). Values are first counted in bins of width h/8 centred at the
    minimum, so the kernel sum runs over a group's bins, never over its rows. A single value has no density, so
    groups of one are left out. Columns: keys, x, density.
    """
    grouped, by = bool(by), list(by)
    if not grouped:
        df, by = df.withColumn(ALL, F.lit(0)), [ALL]
    # Missing values fall out of the aggregates; a filter would evaluate the value expression twice.
    rows = clip_range(df, value, *clip).select(*by, F.col(value).alias("_v"))
    extra = {"_sd": F.stddev("_v"), "_min": F.min("_v"), "_max": F.max("_v")}
    moments = group_quantiles(rows, by, "_v", [0.25, 0.75], method, largest=largest, extra=extra)
    moments = moments.withColumnsRenamed({"n": "_n"}).withColumn("_iqr", F.col("q")[1] - F.col("q")[0])
    # A constant group has no spread of its own: its size, else one, sets the bandwidth.
    narrow = F.least("_sd", F.when(F.col("_iqr") > 0, F.col("_iqr") / F.lit(1.34)))
    spread = F.when(narrow > 0, narrow).when(F.abs("_min") > 0, F.abs("_min")).otherwise(F.lit(1.0))
    stats = (
        moments.withColumn("_h", F.lit(0.9) * spread * F.pow(F.col("_n").cast("double"), F.lit(-0.2)))
        .filter(F.col("_n") > 1)
        .select(
            *[F.col(c).alias(f"_s_{c}") for c in by], "_n", "_h", "_min",
            (F.col("_min") - 3 * F.col("_h")).alias("_lo"),
            ((F.col("_max") - F.col("_min") + 6 * F.col("_h")) / F.lit(float(grid - 1))).alias("_step"),
        )
    )
    # One row per group, kept so that the pass over the values runs once.
    stats = durable(stats)
    match = F.lit(True)
    for c in by:
        match = match & F.col(c).eqNullSafe(F.col(f"_s_{c}"))
    width = F.col("_h") / 8
    bins = (
        rows.join(broadcast_if_small(stats), match)
        .groupBy(*by, "_n", "_h", "_min", "_lo", "_step", F.floor((F.col("_v") - F.col("_min")) / width + 0.5).alias("_bin"))
        .agg(F.count(F.lit(1)).alias("_c"))
    )
    # A bin matters to the points within REACH bandwidths; each point also gets one empty bin, so that none is lost.
    center = F.col("_min") + F.col("_bin") * width
    reach = REACH * F.col("_h")
    first = F.greatest(F.lit(0), F.ceil((center - reach - F.col("_lo")) / F.col("_step"))).cast("int")
    last = F.least(F.lit(grid - 1), F.floor((center + reach - F.col("_lo")) / F.col("_step"))).cast("int")
    near = F.when(first <= last, F.sequence(first, last)).otherwise(F.array().cast("array<int>"))
    empty = stats.select(
        *[F.col(f"_s_{c}").alias(c) for c in by], "_n", "_h", "_min", "_lo", "_step", F.lit(0).cast("bigint").alias("_bin"), F.lit(0).cast("bigint").alias("_c"),
        F.explode(F.sequence(F.lit(0), F.lit(grid - 1))).alias("_i"),
    )
    points = bins.withColumn("_i", F.explode(near)).unionByName(empty)
    x = F.col("_lo") + F.col("_i") * F.col("_step")
    u = (x - center) / F.col("_h")
    kernel = F.sum(F.col("_c") * F.exp(-0.5 * u * u))
    norm = F.col("_n") * F.col("_h") * F.lit(math.sqrt(2 * math.pi))
    curve = points.groupBy(*by, "_n", "_h", "_lo", "_step", "_i").agg(kernel.alias("_k"))
    return curve.select(*(by if grouped else []), x.alias("x"), (F.col("_k") / norm).alias("density"))
