"""Labels, level sets, spelling repair and the impact factor.

A level is text; its order is an explicit rank. The reference level has rank zero.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .clean import in_window
from .joins import dimension
from .ordered import row_rank
from .quantiles import group_quantiles

# Impact codes and their display labels.
IMPACT_LABELS = {"high": "High", "med": "Medium", "low": "Low", "zero": "Zero"}
IMPACT_LEVELS = ["high", "med", "low", "zero"]

# Spellings found in the harvest area file and the canonical site names.
SITE_ALIASES = {
    "Maning River": "Manning River",
    "NA Lake": "Pambula",
    "Pambula Lake": "Pambula",
    "Pambula River": "Pambula",
    "Port Stephen": "Port Stephens",
    "Port Stephes": "Port Stephens",
    "Shoahaven River": "Shoalhaven",
    "Shoalhaven Crookhaven": "Shoalhaven",
    "Shoalhaven River": "Shoalhaven",
    "Wagonga Inlet": "Wagonga",
    "Wapengo Lake": "Wapengo",
    "Wonboyn Lake": "Wonboyn",
    "Wonboyn River": "Wonboyn",
}

# Latitude of each site.
SITE_LATITUDES = {
    "Camden Haven": -31.64478,
    "Georges River": -34.02245,
    "Hastings River": -31.40406,
    "Hawkesbury River": -33.5443,
    "Manning River": -31.89088,
    "Pambula": -36.96522,
    "Port Stephens": -32.7196,
    "Shoalhaven": -34.9118,
    "Wagonga": -36.22161,
    "Wallis Lake": -32.18268,
    "Wapengo": -36.60182,
    "Wonboyn": -37.24121,
}

# Sites whose impact differs from the table.
IMPACT_OVERRIDES = {"Camden Haven": "med", "Wallis Lake": "high", "Wagonga": "med"}


def label(col: str | Column, mapping: Mapping, default: Column | None = None) -> Column:
    """Display label of a code; NULL (or ``default``) where the mapping has none."""
    col = F.col(col) if isinstance(col, str) else col
    out = None
    for code, text in mapping.items():
        out = F.when(col == F.lit(code), F.lit(text)) if out is None else out.when(col == F.lit(code), F.lit(text))
    return out if default is None else out.otherwise(default)


def binary_recode(col: str, code: str, yes: str, no: str) -> Column:
    """``yes`` for the code, ``no`` for any other; a missing code stays missing."""
    return F.when(F.col(col) == code, yes).when(F.col(col) != code, no)


def lookup(df: DataFrame, col: str, dim: DataFrame, key: str, values: Sequence[str]) -> DataFrame:
    """Columns of a dimension table by key; NULL where the key is unknown."""
    side = dimension(dim.select(F.col(key).alias("_key"), *values).filter("_key IS NOT NULL"), ["_key"])
    return df.join(side, F.col(col) == F.col("_key"), "left").drop("_key")


def canonicalise(df: DataFrame, col: str, aliases: DataFrame, raw: str = "alias", canon: str = "canonical") -> DataFrame:
    """Replace known misspellings through an alias table; unknown names stay as they are."""
    side = dimension(aliases.select(F.col(raw).alias("_raw"), F.col(canon).alias("_canon")).filter("_raw IS NOT NULL"), ["_raw"])
    joined = df.join(side, F.col(col) == F.col("_raw"), "left")
    return joined.withColumn(col, F.coalesce("_canon", col)).drop("_raw", "_canon")


def impact_since(
    date: str, cutoff: str | dt.date, base: str, site: str | None = None, overrides: Mapping[str, str] | None = None,
    zero: str = "zero",
) -> Column:
    """``zero`` before the cut-off; afterwards the site's override, else its table value. A missing date gives NULL."""
    value = F.col(base)
    if site and overrides:
        value = label(site, overrides, default=value)
    before = F.col(date) < F.lit(cutoff if isinstance(cutoff, dt.date) else dt.date.fromisoformat(cutoff))
    return F.when(before, F.lit(zero)).when(~before, value)


def impact_window(date: str | Column, start, end, level: str = "high", zero: str = "zero") -> Column:
    """``level`` inside the closed window, ``zero`` outside it. A missing date gives NULL."""
    inside = in_window(date, start, end)
    return F.when(inside, F.lit(level)).when(~inside, F.lit(zero))


def with_levels(col: str, levels: Sequence) -> Column:
    """Value if it belongs to the level set, else NULL."""
    return F.when(F.col(col).isin(list(levels)), F.col(col))


def level_rank(col: str, levels: Sequence) -> Column:
    """Position of a level in its list from zero; NULL outside the list."""
    return label(col, {level: i for i, level in enumerate(levels)}).cast("int")


def relevel(levels: Sequence, reference) -> list:
    """Level list with the reference first; the others keep their order."""
    if reference not in levels:
        raise ValueError(f"{reference!r} is not a level")
    return [reference, *[v for v in levels if v != reference]]


def order_levels_by(df: DataFrame, level: str, stat: str, desc: bool = False, rank: str = "level_rank") -> DataFrame:
    """Levels ranked from 1 by the median of ``stat``; ties follow the level name.

    Returns one row per level: level, median, rank.
    """
    medians = group_quantiles(df.filter(F.col(level).isNotNull()), [level], stat, [0.5]).select(
        level, F.col("q")[0].alias("median")
    )
    sign = -F.col("median") if desc else F.col("median")
    ranked = row_rank(medians.withColumn("_key", sign), [], ["_key", level], rank, method="auto")
    return ranked.drop("_key", "n")
