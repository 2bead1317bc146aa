"""Feature tables from raw samples and weather."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import MONTH_NAMES, as_number, build_date, build_date_named, log10_positive, month_of, paste, scale_units, week_index
from ..operators.categorical import IMPACT_OVERRIDES, SITE_ALIASES, SITE_LATITUDES, canonicalise, impact_since, impact_window, lookup
from ..operators.clean import constant, keep_present
from ..operators.joins import join_daily
from ..operators.ordered import needs_ranges, split_ranges
from ..operators.reshape import paired_unpivot
from ..operators.summary import daily_mean, scale_by_max
from ..operators.windows import fill_down_up, fill_ranges, rolling_mean, rolling_ranges
from ..sources import drop_embedded_headers, rename_positional

# The rainfall sheet holds a day column and a value and a year column per month.
RAIN_COLUMNS = ["Day"] + [c for m in MONTH_NAMES for c in (m, f"{m}-Year")]
# Fixed value: rainfall units to the units of the model.
RAIN_FACTOR = 2.5
RAIN_MEANS = {"rainfall48": ("rainfall", 2), "rainfall72": ("rainfall", 3)}


def solar_daily(raw: DataFrame, year: str, month: str, day: str, irradiance: str) -> DataFrame:
    """Daily mean exposure from hourly weather files that carry metadata rows."""
    rows = drop_embedded_headers(raw, year, month, day)
    rows = rows.withColumn("date", build_date(year, month, day)).withColumn("_v", as_number(irradiance))
    return daily_mean(keep_present(rows, "date"), "date", "_v", "solar_exposure")


def rain_daily(raw: DataFrame) -> DataFrame:
    """Daily rainfall from the wide sheet: each month column goes with its own year column.

    Impossible days (30 February) and the heading row drop out, so a date occurs once.
    """
    sheet = drop_embedded_headers(rename_positional(raw, RAIN_COLUMNS), "Day")
    long = paired_unpivot(sheet, ["Day"], [(m, m, f"{m}-Year") for m in MONTH_NAMES], "month", "rain", "year")
    rows = long.select(
        build_date_named("year", "month", "Day").alias("date"), scale_units(as_number("rain"), RAIN_FACTOR).alias("rainfall")
    )
    return keep_present(rows, "date")


def bay_features(
    samples: DataFrame, solar: DataFrame, rain: DataFrame, windows: Mapping[str, tuple[str, str]], order: Sequence[str],
    location: str = "San Francisco", check_unique: bool = True, method: str = "auto", rolling: Mapping[str, tuple[str, int]] = RAIN_MEANS,
    filled: Sequence[str] = ("rainfall",), numbers: Sequence[str] = (), scaled: Sequence[str] = (),
) -> DataFrame:
    """Samples with daily weather, filled gaps, impact windows, month and rolling means.

    ``rolling`` maps a new column to (column, rows); ``filled`` names the columns whose gaps are filled first;
    ``numbers`` are text columns read as numbers before that; ``scaled`` are divided by their maximum, kept beside them.

    ``windows`` maps an impact column to its closed window of days. ``order`` ends in a unique
    tie-break, because a date alone leaves many samples in no order.
    """
    df = keep_present(samples, "total_phytoplankton").withColumns({c: as_number(c) for c in numbers})
    df = join_daily(df, solar, ["date"], check_unique=check_unique)
    df = join_daily(df, rain, ["date"], check_unique=check_unique)
    means = dict(rolling)
    # The joins keep the row count, so the samples alone tell whether one task can hold them.
    if needs_ranges(samples, method):
        cut = rolling_ranges(fill_ranges(split_ranges(df, [], order), list(filled)), means)
        df = cut.result([*df.columns, *means])
    else:
        df = fill_down_up(df, list(filled), order, method="window")
        df = rolling_mean(df, means, order, method="window")
    # What a row says alone comes last, so that it is not carried through the sorts.
    df = df.withColumn("log10_phytoplankton", log10_positive("total_phytoplankton"))
    for name, (start, end) in windows.items():
        df = df.withColumn(name, impact_window("date", start, end))
    df = constant(df, location=location).withColumn("month_of_year", month_of("date"))
    return scale_by_max(df, scaled) if scaled else df


def station_features(
    samples: DataFrame, start: str, end: str, level: str = "low", scaled: Sequence[str] = ("pseudo", "alexandrium", "dinophysis"),
) -> DataFrame:
    """Single-station samples with log count, month, impact window and scaled genus counts."""
    df = keep_present(samples, "total_phytoplankton")
    df = df.withColumns({
        "log10_phytoplankton": log10_positive("total_phytoplankton"),
        "month_of_year": month_of("date"),
        "impact": impact_window("date", start, end, level),
    })
    return scale_by_max(df, scaled)


def harvest_features(
    samples: DataFrame, impacts: DataFrame, covariates: DataFrame, cutoff: str = "2020-03-01",
    overrides: Mapping[str, str] = IMPACT_OVERRIDES, scaled: Sequence[str] = ("pseudo", "alexandrium", "dinophysis"),
    check_unique: bool = True,
) -> DataFrame:
    """Many-site samples: canonical site, impact since the cut-off, latitude, covariates, scaled counts.

    ``impacts`` has (location, impact); ``covariates`` has one row per (date, location).
    """
    spark = samples.sparkSession
    aliases = spark.createDataFrame(list(SITE_ALIASES.items()), "alias string, canonical string")
    latitudes = spark.createDataFrame(list(SITE_LATITUDES.items()), "site string, latitude double")
    df = samples.withColumn("location", paste("area", "area2", sep=" "))
    df = canonicalise(df, "location", aliases)
    df = lookup(df, "location", impacts.withColumnRenamed("impact", "table_impact"), "location", ["table_impact"])
    df = df.withColumn("impact", impact_since("date", cutoff, "table_impact", "location", overrides)).drop("table_impact")
    df = lookup(df, "location", latitudes, "site", ["latitude"])
    first = samples.agg(F.min("date")).scalar()
    df = df.withColumns({"week": week_index("date", first), "month_of_year": month_of("date")})
    df = join_daily(df, covariates, ["date", "location"], check_unique=check_unique)
    return scale_by_max(df, scaled)
