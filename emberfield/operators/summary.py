"""Aggregates over observations and draws: means, scaling, intervals, exceedance, coefficients."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .categorical import label
from .quantiles import group_quantiles

# Regulatory action levels in cells per litre.
ACTION_LEVELS = {"pseudo": 50_000.0, "alexandrium": 200.0, "dinophysis": 200.0}


def daily_mean(df: DataFrame, date: str | Column, value: str, name: str, by: Sequence[str] = ()) -> DataFrame:
    """Mean per day (and further keys); partial sums are combined before the shuffle."""
    return df.groupBy(date, *by).agg(F.avg(value).alias(name))


def scale_by_max(
    df: DataFrame, columns: Sequence[str], suffix: str = "_scaled", strict_nulls: bool = False
) -> DataFrame:
    """Columns divided by their global maximum, with the maximum kept beside them.

    The maxima come from one scalar subquery: one pass, one row, no join. An all-zero column
    scales to NULL. With ``strict_nulls`` a single missing value makes the whole column missing.
    """

    def top(c: str) -> Column:
        m = F.max(c)
        return F.when(F.count_if(F.col(c).isNull()) == 0, m) if strict_nulls else m

    tops = df.agg(F.struct(*[top(c).alias(c) for c in columns]).alias("tops")).scalar()
    out = df.withColumn("_tops", tops)
    out = out.withColumns({f"{c}_max": F.col(f"_tops.{c}") for c in columns}).drop("_tops")
    return out.withColumns({f"{c}{suffix}": F.try_divide(F.col(c), F.col(f"{c}_max")) for c in columns})


def median_qi(
    df: DataFrame, by: Sequence[str], value: str | Column, width: float = 0.95, method: str = "auto",
    frequency: str | None = None, strict_nulls: bool = False, largest: int | None = None,
) -> DataFrame:
    """Median and central interval of a column or expression per group.

    Columns: keys, value, lower, upper, width, point, interval. See
    :func:`~emberfield.operators.quantiles.group_quantiles` for ``method``.
    """
    expr = F.col(value) if isinstance(value, str) else value
    rows = df.withColumn("_value", expr)
    tail = (1.0 - width) / 2.0
    probs = [0.5, tail, 1.0 - tail]
    extra = {"_gaps": F.count_if(F.col("_value").isNull())} if strict_nulls else None
    q = group_quantiles(rows, by, "_value", probs, method, frequency, largest=largest, extra=extra)
    cells = {"value": F.col("q")[0], "lower": F.col("q")[1], "upper": F.col("q")[2]}
    if strict_nulls:
        cells = {k: F.when(F.col("_gaps") == 0, v) for k, v in cells.items()}
    return q.select(
        *by, *[v.alias(k) for k, v in cells.items()],
        F.lit(float(width)).alias("width"), F.lit("median").alias("point"), F.lit("qi").alias("interval"),
    )


def _packed_quantile(ordered: Column, p: float, scale: Callable[[Column], Column]) -> Column:
    place = (F.size(ordered) - 1) * F.lit(float(p))
    low = F.floor(place).cast("int")
    a = scale(F.get(ordered, low))
    b = F.coalesce(scale(F.get(ordered, low + 1)), a)
    return a + (place - low) * (b - a)


def median_qi_packed(
    df: DataFrame, draws: str, width: float = 0.95, scale: Callable[[Column], Column] = lambda v: v
) -> DataFrame:
    """The interval of draws packed as an array per row: row-local, so nothing is shuffled.

    ``scale`` is an increasing back-transform; only the order statistics go through it. Missing draws do not count.
    """
    tail = (1.0 - width) / 2.0
    rows = df.withColumn("_sorted", F.sort_array(F.filter(draws, lambda v: v.isNotNull())))
    cells = {
        name: F.when(F.size(F.col("_sorted")) > 0, _packed_quantile(F.col("_sorted"), p, scale))
        for name, p in (("value", 0.5), ("lower", tail), ("upper", 1.0 - tail))
    }
    return rows.withColumns({
        **cells, "width": F.lit(float(width)), "point": F.lit("median"), "interval": F.lit("qi")
    }).drop("_sorted")


def exceedance(
    df: DataFrame, by: Sequence[str], value: str, threshold: float | Mapping[str, float], genus: str | None = None,
    name: str = "exceedance",
) -> DataFrame:
    """Share of values at or above a threshold per group, on the count scale.

    ``threshold`` is a number, or a mapping by the ``genus`` column.
    """
    level = label(genus, threshold) if genus else F.lit(float(threshold))
    over = F.when(F.col(value) >= level, 1.0).when(F.col(value) < level, 0.0)
    return df.groupBy(*by).agg(F.avg(over).alias(name))


def exceedance_packed(df: DataFrame, draws: str, threshold: float, name: str = "exceedance") -> DataFrame:
    """Share of a row's packed draws at or above a threshold, without a shuffle. Missing draws do not count."""
    hits = F.size(F.filter(draws, lambda v: v >= F.lit(float(threshold))))
    return df.withColumn(name, F.try_divide(hits.cast("double"), F.size(F.filter(draws, lambda v: v.isNotNull()))))


def exceedance_curve(df: DataFrame, by: Sequence[str], value: str | Column, levels: Sequence[float], name: str = "exceedance") -> DataFrame:
    """Share of values at or above each of many levels, per group: rows (keys, level, ``name``), one per distinct level.

    Each value finds its place among the sorted levels by bisection, values are counted by place before the shuffle, and counts are added up
    from the top: the cost of a value hardly depends on the number of levels, and a group becomes at most one row per level.
    Missing values do not count; a group of such alone has a missing share. NaN is above every level.
    """
    levels = sorted({float(v) for v in levels})
    n = len(levels)
    if not n or any(v in (float("inf"), float("-inf")) or v != v for v in levels):
        raise ValueError("finite levels are needed")
    keys = [f"_k{i}" for i in range(len(by))]  # keys may be called like the columns made here
    values = df.select(*[F.col(b).alias(k) for b, k in zip(by, keys)], (F.col(value) if isinstance(value, str) else value).cast("double").alias("_value"))
    cuts = Bucketizer(splits=[float("-inf"), *levels, float("inf")], inputCol="_value", outputCol="_place", handleInvalid="keep")
    # The place is the number of levels at or below; the last one but one holds infinity, the last one NaN.
    place = F.when(F.col("_value").isNull(), 0).otherwise(F.least(F.col("_place").cast("int"), F.lit(n)))
    counts = cuts.transform(values).groupBy(*keys, place.alias("_place")).agg(F.count("_value").alias("_n"))
    down = Window.partitionBy(*keys).orderBy(F.desc("_place"))
    counts = counts.select(
        *keys, "_place", F.sum("_n").over(down).alias("_hits"), F.sum("_n").over(Window.partitionBy(*keys)).alias("_all"),
        F.lead("_place", 1, 0).over(down).alias("_below"), (F.row_number().over(down) == 1).alias("_top"),
    )
    # A row speaks for the levels between the next lower place and its own, the highest one also for those above, which nothing reaches.
    told = lambda start, length, hits: F.transform(F.slice(F.lit(levels), start, length), lambda v: F.struct(v.alias("level"), hits.alias("hits")))
    own = told(F.col("_below") + 1, F.col("_place") - F.col("_below"), F.col("_hits"))
    above = told(F.col("_place") + 1, F.when(F.col("_top"), n - F.col("_place")).otherwise(0), F.lit(0).cast("bigint"))
    rows = counts.select(*keys, "_all", F.explode(F.concat(own, above)).alias("_told"))
    return rows.select(*[F.col(k).alias(b) for b, k in zip(by, keys)], F.col("_told.level").alias("level"), F.try_divide(F.col("_told.hits").cast("double"), F.col("_all")).alias(name))


def coef_summary(
    draws: DataFrame, beta: str, terms: Sequence[str], width: float = 0.95, method: str = "auto"
) -> DataFrame:
    """Estimate, error and interval of each coefficient over its draws."""
    names = F.array(*[F.lit(t) for t in terms])
    long = draws.select(F.posexplode(beta).alias("_pos", "_b")).select(
        F.get(names, F.col("_pos")).alias("term"), F.col("_b").alias("b")
    )
    tail = (1.0 - width) / 2.0
    extra = {"estimate": F.avg("b"), "error": F.stddev("b")}
    return group_quantiles(long, ["term"], "b", [tail, 1.0 - tail], method, extra=extra).select(
        "term", "estimate", "error", F.col("q")[0].alias("lower"), F.col("q")[1].alias("upper")
    )


def back_transform(value: str | Column, maximum: str | Column | None = None, log10: bool = False) -> Column:
    """Count scale from a log10 value, or from a value scaled by its stored maximum."""
    value = F.col(value) if isinstance(value, str) else value
    if log10:
        value = F.pow(F.lit(10.0), value)
    if maximum is not None:
        value = value * (F.col(maximum) if isinstance(maximum, str) else maximum)
    return value
