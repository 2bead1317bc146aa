"""The counterfactual contrast: predict the event window as it was and without the event."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..model.design import complete_rows, design
from ..model.fit import Draws, Fit
from ..model.predict import predict_draws, predict_packed
from ..model.sites import SiteFit
from ..operators.categorical import label
from ..operators.clean import in_window
from ..operators.curves import density_curve
from ..operators.joins import paired_contrast
from ..operators.reshape import explode_draws, scenarios, stack_observed_predicted
from ..operators.summary import back_transform, exceedance_curve, median_qi, median_qi_packed
from ..operators.windows import ccdf
from ..sources import read_stage, write_stage


def _model_uses(spec: Mapping, impact: str, zero: str = "zero") -> None:
    if impact not in spec.get("factors", {}):
        raise ValueError(f"the model has no factor {impact!r}, so both scenarios would be equal")
    if zero not in spec["factors"][impact]:
        raise ValueError(f"{zero!r} is not a level of {impact!r}, so the scenario without the event has no rows")


def spread_rows(df: DataFrame, key: str) -> DataFrame:
    """Observations over all cores by key, before each becomes thousands of values.

    Moving the few observations also saves moving the many values: later groups by observation
    and draw, or by observation and scenario, find their rows in one place already.
    """
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), key)


def predict_scenarios(
    obs: DataFrame, spec: Mapping, draws: Draws, family: str, key: str, impact: str, date: str,
    start: str | None = None, end: str | None = None, seed: int = 0, site: str | None = None,
    known_sites: Sequence = (), packed: bool = True, sums: DataFrame | None = None, shift: Sequence[float] | None = None,
) -> DataFrame:
    """Predictions of every complete row in the window, observed and with impact ``zero``.

    All columns of ``obs`` stay, so nothing has to be aligned by position later.
    """
    _model_uses(spec, impact)
    # Incomplete rows go before the copy, so that both scenarios hold the same observations.
    window = spread_rows(complete_rows(obs.filter(in_window(date, start, end)), spec), key)
    both = scenarios(window, impact)
    predict = predict_packed if packed else predict_draws
    return predict(design(both, spec), draws, family, [key, "scenario"], seed=seed, site=site, known_sites=known_sites, sums=sums, shift=shift)


def predict_fitted(obs: DataFrame, fit: Fit | SiteFit, draws: Draws, key: str, impact: str, date: str, pairs: bool = False, **rest) -> DataFrame:
    """:func:`predict_scenarios`, or :func:`predict_pairs`, with family, specification and known sites of the fit.

    A site the fit has not seen gets an effect drawn from the spread of the sites.
    """
    run = predict_pairs if pairs else predict_scenarios
    if isinstance(fit, SiteFit):
        return run(obs, fit.spec, draws, fit.family, key, impact, date, site=fit.site, sums=fit.sums, shift=fit.shift, **rest)
    site = fit.spec["site"]["column"] if fit.spec.get("site") else None
    return run(obs, fit.spec, draws, fit.family, key, impact, date, site=site, known_sites=fit.sites, **rest)


def predict_pairs(
    obs: DataFrame, spec: Mapping, draws: Draws, family: str, key: str, impact: str, date: str,
    start: str | None = None, end: str | None = None, seed: int = 0, site: str | None = None, known_sites: Sequence = (),
    sums: DataFrame | None = None, shift: Sequence[float] | None = None,
) -> DataFrame:
    """Both scenarios of an observation in one row, as arrays ``actual`` and ``counterfactual``.

    The numbers are those of :func:`predict_scenarios`. A contrast needs no shuffle from here.
    """
    _model_uses(spec, impact)
    rows = spread_rows(obs.filter(in_window(date, start, end)), key)
    keep = rows.columns
    rows = design(rows, spec, "_actual").withColumn("_impact", F.col(impact))
    rows = design(rows.withColumn(impact, F.lit("zero")), spec, "_counterfactual")
    rows = rows.withColumn(impact, F.col("_impact"))
    for name in ("actual", "counterfactual"):
        rows = predict_packed(
            rows.withColumn("scenario", F.lit(name)), draws, family, [key, "scenario"], x=f"_{name}", seed=seed, site=site,
            known_sites=known_sites, out=name, sums=sums, shift=shift)
    return rows.select(*keep, "actual", "counterfactual")


def keep_predictions(predicted: DataFrame, path: str) -> DataFrame:
    """Write predictions once and read them back, so that several summaries share one pass."""
    write_stage(predicted, path)
    return read_stage(predicted.sparkSession, path)


def interval_table(
    observed: DataFrame, predicted: DataFrame, response: str, impact: str, scale: Column | None = None, method: str = "auto",
    largest: int | None = None, observed_copies: int | None = None,
) -> DataFrame:
    """Median and interval by type (observed, predicted) and impact; ``predicted`` is long.

    ``largest`` saves a pass over the predictions: rows of the largest impact level times draws.
    ``observed_copies`` restores a habit of wide draw matrices, where each observation appears
    once per draw and once more under the level ``zero``; without it an observation counts once.
    """
    value = F.col("value") if scale is None else scale
    if observed_copies is None:
        stacked = stack_observed_predicted(observed, predicted, response, [impact])
        return median_qi(stacked, ["type", impact], value, method=method, largest=largest)
    stacked = stack_observed_predicted(scenarios(observed, impact), predicted, response, [impact])
    stacked = stacked.withColumn("_times", F.when(F.col("type") == "Observed", observed_copies).otherwise(1))
    return median_qi(stacked, ["type", impact], value, method=method, frequency="_times", largest=largest)


def level_table(predicted: DataFrame, impact: str, method: str = "auto", largest: int | None = None) -> DataFrame:
    """Median and interval by impact level, the data of a bar with error bars."""
    return median_qi(predicted, [impact], "value", method=method, largest=largest)


def ccdf_table(
    packed: DataFrame, key: Sequence[str], impact: str, log10: bool = True, maximum: str | None = None, method: str = "auto",
    largest: int | None = None,
) -> DataFrame:
    """Distribution of the per-row medians on the count scale, one curve per impact level.

    ``largest``, the rows of the largest level, saves a pass over the predictions.
    """
    rows = median_qi_packed(packed, "draws", scale=lambda v: back_transform(v, maximum, log10)).select(*key, impact, "value", "lower", "upper")
    return ccdf(rows, [impact], "value", key, method=method, largest=largest)


def difference_curve(
    long: DataFrame, key: Sequence[str], by: Sequence[str] = (), method: str = "auto", largest: int | None = None, hit: str | None = None,
    zero: str = "zero",
) -> DataFrame:
    """Density of actual minus counterfactual, per site when ``by`` names it.

    With ``hit``, the impact column, only observations that were really hit count: the others have no difference.
    """
    if hit:  # an actual row without impact goes, and its pair with it
        long = long.filter((F.col("scenario") != "actual") | (F.col(hit) != zero))
    pairs = paired_contrast(long, [*key, "draw_id", *by])
    return density_curve(pairs, by, "difference", method=method, largest=largest)


def prediction_curve(
    long: DataFrame, by: Sequence[str], clip: tuple[float | None, float | None] = (None, None), method: str = "auto",
    largest: int | None = None,
) -> DataFrame:
    return density_curve(long, by, "value", clip=clip, method=method, largest=largest)


def exceedance_table(
    packed: DataFrame, by: Sequence[str], maximum: str | None, threshold: float | Mapping[str, float], genus: str | None = None,
) -> DataFrame:
    """Probability of reaching the action level, on the count scale.

    The share of all draws at or above it, per group; missing draws and groups without a level do not count.
    """
    level = label(genus, threshold) if genus else F.lit(float(threshold))
    value = lambda v: back_transform(v, maximum)
    # Two numbers per row before the shuffle; the draws are not unfolded.
    rows = packed.select(
        *by, F.size(F.filter("draws", lambda v: value(v) >= level)).alias("_hits"),
        F.when(value(F.lit(1.0)).isNotNull() & level.isNotNull(), F.size(F.array_compact("draws"))).otherwise(0).alias("_draws"),
    )
    return rows.groupBy(*by).agg(F.try_divide(F.sum("_hits").cast("double"), F.sum("_draws")).alias("exceedance"))


def exceedance_levels(packed: DataFrame, by: Sequence[str], maximum: str | None, levels: Sequence[float]) -> DataFrame:
    """Probability of reaching each of many levels, on the count scale: rows (keys, level, exceedance), from one pass over the draws."""
    value = back_transform("_draw", maximum)
    rows = packed.select(*by, *([maximum] if maximum and maximum not in by else []), F.explode_outer("draws").alias("_draw"))
    return exceedance_curve(rows, by, value, levels)
