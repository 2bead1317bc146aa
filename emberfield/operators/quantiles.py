"""Exact quantiles of groups of any size (linear interpolation between order statistics).

Spark's ``percentile`` keeps every distinct value of a group in one task. That suits groups with
a known bound, such as the draws of one observation. For larger groups two passes give the same
numbers: the first brackets each quantile with ``percentile_approx``, whose rank error is
bounded; the second counts the rows between the brackets and keeps only the values inside them.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from decimal import Decimal

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import broadcast_if_small, durable
from .ordered import ALL, largest_group

# Up to this many values of one group fit into the hash map of one task.
MAX_EXACT_ROWS = 1_000_000

# percentile_approx misses a rank by at most n / accuracy.
ACCURACY = 10_000
MAX_ACCURACY = 1_000_000

# A bracket of weighted rows is cut into so many cells at once; a power of two.
CELLS = 256
# A cut misses its rank by at most a CUT_ACCURACY-th of a cell. Any cuts give exact answers; finer ones make summaries that merge slowly.
CUT_ACCURACY = 10


def _columns(extra: Mapping[str, Column]) -> list[Column]:
    return [v.alias(k) for k, v in extra.items()]


def _weight(frequency: str) -> Column:
    """How often a row counts; a missing or negative number is zero."""
    return F.greatest(F.coalesce(F.col(frequency), F.lit(0)), F.lit(0)).cast("bigint")


def _between(a: Column, b: Column, share: Column) -> Column:
    """The number ``share`` of the way from a to b; only the ends that count are touched, as they may be infinite."""
    return F.when((share == 0) | (a == b), a).otherwise((1 - share) * a + share * b)


def _exact(df, by: Sequence[str], value: str, probs: Sequence[float], frequency: str | None, extra) -> DataFrame:
    weight = _weight(frequency) if frequency else F.lit(1)
    n = F.coalesce(F.sum(F.when(F.col(value).isNotNull(), weight)), F.lit(0)).cast("bigint")
    return df.groupBy(*by).agg(n.alias("n"), F.percentile(value, list(probs), weight).alias("q"), *_columns(extra))


def _approximate(df, by: Sequence[str], value: str, probs: Sequence[float], accuracy: int, extra) -> DataFrame:
    return df.groupBy(*by).agg(
        F.count(value).alias("n"), F.percentile_approx(value, list(probs), accuracy).alias("q"), *_columns(extra)
    )


def _bracketed(df: DataFrame, by: list[str], value: str, probs: Sequence[float], accuracy: int, extra) -> DataFrame:
    rows = df.withColumn("_v", F.col(value).cast("double"))
    # A bracket reaches three rank errors to each side, so the wanted ranks lie inside it.
    slack = 3.0 / accuracy
    ends = [max(0.0, p - slack) for p in probs] + [min(1.0, p + slack) for p in probs]
    sizes = rows.groupBy(*by).agg(
        F.count("_v").alias("_n"), F.percentile_approx("_v", ends, accuracy).alias("_ends"), *_columns(extra)
    )
    # Small groups need no bracket: all their values are kept, and there are few of them.
    small = F.col("_n") < 4 * accuracy
    m = len(probs)
    # One row per group, kept so that the first pass runs once.
    sizes = durable(sizes)
    brackets = sizes.select(
        *[F.col(c).alias(f"_k_{c}") for c in by], "_n",
        *[F.when(small, F.lit(float("-inf"))).otherwise(F.col("_ends")[i]).alias(f"_lo{i}") for i in range(m)],
        *[F.when(small, F.lit(float("inf"))).otherwise(F.col("_ends")[m + i]).alias(f"_hi{i}") for i in range(m)],
    )
    same = F.lit(True)
    for c in by:
        same = same & F.col(c).eqNullSafe(F.col(f"_k_{c}"))
    # Missing values count zero below; a filter here would evaluate the value expression twice.
    joined = rows.select(*by, "_v").join(broadcast_if_small(brackets), same)
    inside = F.lit(False)
    gap = F.lit(0)
    for i in range(m):
        inside = inside | F.col("_v").between(F.col(f"_lo{i}"), F.col(f"_hi{i}"))
        gap = gap + (F.col("_v") > F.col(f"_hi{i}")).cast("int")
    # One cell per value inside a bracket and one per stretch between brackets.
    cells = joined.groupBy(
        *by, "_n", F.when(inside, F.lit(-1)).otherwise(gap).alias("_gap"), F.when(inside, F.col("_v")).alias("_cell")
    ).agg(F.count("_v").alias("_c"), F.min("_v").alias("_low"), F.max("_v").alias("_high"))
    w = Window.partitionBy(*by).orderBy("_low").rowsBetween(Window.unboundedPreceding, 0)
    cells = cells.withColumn("_upto", F.sum("_c").over(w))

    def at(rank):
        hit = (F.col("_upto") - F.col("_c") < rank) & (rank <= F.col("_upto"))
        sure = F.when(F.col("_low") == F.col("_high"), F.col("_low")).otherwise(
            F.raise_error(F.lit("a quantile fell outside its bracket")).cast("double")
        )
        return F.max(F.when(hit, sure))

    picks = []
    for i, p in enumerate(probs):
        place = (F.col("_n") - 1) * F.lit(float(p))
        low = F.floor(place)
        picks += [at(low + 1).alias(f"_a{i}"), at(F.least(low + 2, F.col("_n"))).alias(f"_b{i}")]
    found = cells.groupBy(*by, "_n").agg(*picks)
    values = []
    for i, p in enumerate(probs):
        place = (F.col("_n") - 1) * F.lit(float(p))
        share = place - F.floor(place)
        values.append(_between(F.col(f"_a{i}"), F.col(f"_b{i}"), share))
    out = found.select(*by, F.col("_n").alias("n"), F.when(F.col("_n") > 0, F.array(*values)).alias("q"))
    if not extra:
        return out
    side = sizes.select(*[F.col(c).alias(f"_k_{c}") for c in by], *extra)
    return out.join(side, same).select(*out.columns, *extra)


def _weighted(df: DataFrame, by: list[str], value: str, probs: Sequence[float], frequency: str, extra, max_rows: int) -> DataFrame:
    """Exact quantiles of weighted rows: brackets around each wanted rank are cut into cells, the cells that hold a rank become the
    next brackets, until a bracket has at most ``max_rows`` values; these are summed up and selected by cumulative weight.

    Cells are cut at quantiles of the rows, so each level leaves a CELLS-th of them or a single value, whatever the weights and values.
    The rows left by a level are written once: ``df`` is read for the totals, for the cells and for the first rows left, and not again.
    """
    wide = lambda c: c.cast("decimal(38,0)")
    weight = F.when(F.col(value).isNull(), 0).otherwise(_weight(frequency))
    weighed = df.withColumns({"_v": F.col(value).cast("double"), "_w": weight})
    cuts = [i / CELLS for i in range(1, CELLS)]
    facts = lambda v: [F.count(v).alias("_rows"), F.min(v).alias("_least"), F.max(v).alias("_most"), F.percentile_approx(v, cuts, CUT_ACCURACY * CELLS).alias("_cuts")]
    total = F.coalesce(F.sum(wide(F.col("_w"))), wide(F.lit(0)))
    found = durable(weighed.groupBy(*by).agg(total.alias("_n"), *facts(F.when(F.col("_w") > 0, F.col("_v"))), *_columns(extra)))
    sizes = found.select(*by, "_n", *extra)
    keys = [F.col(c).alias(f"_k_{c}") for c in by]
    same = F.lit(True)
    for c in by:
        same = same & F.col(c).eqNullSafe(F.col(f"_k_{c}"))
    # Places among n - 1 steps in decimals: doubles cannot hold ranks beyond 2^53, and n times a share of 17 digits may not fit 38 digits.
    # So n - 1 is cut in two at 10^17, and each part is multiplied alone: exact for every n below 10^36.
    unit = F.lit(Decimal(10**17)).cast("decimal(18,0)")
    part = lambda p: F.lit(Decimal(str(p)).quantize(Decimal(1).scaleb(-17)).scaleb(17).to_integral_value()).cast("decimal(18,0)")
    times = lambda c: wide((c - c % unit) / unit)
    steps = F.col("_n") - 1
    rest = lambda p: (steps % unit).cast("decimal(18,0)") * part(p)
    low = lambda p: wide(times(steps).cast("decimal(19,0)") * part(p) + times(rest(p)))
    share = lambda p: ((rest(p) % unit).cast("decimal(17,0)") * F.lit(Decimal(1).scaleb(-17)).cast("decimal(17,17)")).cast("double")
    ranks = F.array_distinct(F.array(*[x for p in probs for x in (low(p) + 1, F.least(low(p) + 2, F.col("_n")))]))
    ranks = durable(sizes.filter("_n > 0").select(*keys, F.explode(ranks).alias("_rank")))
    at = ["_base", "_lo", "_hi"]
    whole = {"_base": wide(F.lit(0)), "_lo": F.lit(None).cast("double"), "_hi": F.lit(None).cast("double")}
    inside = weighed.filter("_w > 0").select(*by, *_columns(whole), "_v", "_w")
    found = found.filter("_n > 0").withColumns(whole)
    while not found.filter((F.col("_rows") > max_rows) & (F.col("_least") < F.col("_most"))).isEmpty():
        place_of = found.select(*keys, *[F.col(c).alias(f"_b{c}") for c in at], "_cuts")
        here = same
        for c in at:
            here = here & F.col(c).eqNullSafe(F.col(f"_b{c}"))
        # A value that is a cut is a cell of its own, so a frequent value cannot keep a bracket as it is.
        placed = inside.join(broadcast_if_small(place_of), here).withColumn("_below", F.lit(0))
        # Bisection, a column per step: these are compiled, a fold over an array is not.
        for h in [CELLS >> k for k in range(1, CELLS.bit_length())]:
            placed = placed.withColumn("_below", F.col("_below") + F.when(F.get("_cuts", F.col("_below") + (h - 1)) < F.col("_v"), h).otherwise(0))
        cells = placed.groupBy(*by, *at, (F.col("_below") * 2 + F.when(F.get("_cuts", F.col("_below")) == F.col("_v"), 1).otherwise(0)).alias("_cell"))
        cells = cells.agg(F.sum(wide(F.col("_w"))).alias("_c"), F.max("_v").alias("_top"))
        order = Window.partitionBy(*by, *at).orderBy("_cell")
        cells = cells.select(
            *keys, (F.col("_base") + F.sum("_c").over(order.rowsBetween(Window.unboundedPreceding, 0)) - F.col("_c")).cast("decimal(38,0)").alias("_from"), "_c",
            F.coalesce(F.lag("_top").over(order), F.col("_lo")).alias("_lo"), F.col("_top").alias("_hi"))
        wanted = ranks.select(*[F.col(f"_k_{c}").alias(c) for c in by], "_rank")
        hit = cells.join(wanted, same & (F.col("_from") < F.col("_rank")) & (F.col("_rank") <= F.col("_from") + F.col("_c")), "left_semi")
        brackets = durable(hit.select(*[f"_k_{c}" for c in by], F.col("_from").alias("_base"), "_lo", "_hi"))
        within = (F.col("_lo").isNull() | (F.col("_v") > F.col("_lo"))) & (F.col("_hi").isNull() | (F.col("_v") <= F.col("_hi")))
        inside = durable(inside.select(*by, "_v", "_w").join(broadcast_if_small(brackets), same & within).select(*by, *at, "_v", "_w"))
        found = durable(inside.groupBy(*by, *at).agg(*facts(F.col("_v"))))
    order = Window.partitionBy(*by, "_base").orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)
    summed = inside.groupBy(*by, "_base", "_v").agg(F.sum(wide(F.col("_w"))).alias("_c"))
    summed = summed.withColumn("_upto", F.col("_base") + F.sum("_c").over(order))
    wanted = ranks.join(summed, same & (F.col("_upto") - F.col("_c") < F.col("_rank")) & (F.col("_rank") <= F.col("_upto")))
    picked = wanted.groupBy(*[f"_k_{c}" for c in by]).agg(F.map_from_entries(F.collect_list(F.struct(F.col("_rank").cast("string"), F.col("_v")))).alias("_values"))
    out = sizes.join(picked, same, "left")
    values = []
    for p in probs:
        pick = lambda rank: F.get(F.map_values(F.map_filter("_values", lambda k, _: k == rank.cast("string"))), F.lit(0))  # noqa: B023, E731
        values.append(_between(pick(low(p) + 1), pick(F.least(low(p) + 2, F.col("_n"))), share(p)))
    return out.select(*by, F.col("_n").cast("bigint").alias("n"), F.when(F.col("_n") > 0, F.array(*values)).alias("q"), *extra)


def group_quantiles(
    df: DataFrame, by: Sequence[str], value: str, probs: Sequence[float], method: str = "auto",
    frequency: str | None = None, accuracy: int | None = None, largest: int | None = None,
    max_exact_rows: int = MAX_EXACT_ROWS, extra: Mapping[str, Column] | None = None,
) -> DataFrame:
    """One row per group: its keys, ``n`` values and the array ``q`` of quantiles.

    ``exact`` aggregates each group in one task: for groups of known, bounded size. ``bracketed``
    gives the same numbers for groups of any size in two passes. ``auto`` counts the largest
    group (unless ``largest`` tells its size) and picks one of these. ``approximate`` returns stored
    values whose rank is off by at most n / accuracy. ``frequency`` names a column that tells how
    often a row counts; ``n`` is then the sum over rows with a value, and reading an ``n`` beyond a bigint is an error. A group without a value has n = 0 and no quantiles.
    ``extra`` names further aggregates to take along in the same pass.
    """
    by, extra = list(by), dict(extra or {})
    if method not in ("auto", "exact", "bracketed", "approximate"):
        raise ValueError(f"unknown method {method!r}")
    # Weighted rows are cut at ranks that are counted, so the largest group only decides between the two methods.
    if method == "auto" or (method == "bracketed" and accuracy is None and not frequency):
        if largest is None:
            largest = largest_group(df, by)
        if method == "auto":
            method = "bracketed" if largest > max_exact_rows else "exact"
        if accuracy is None:
            # Keeps what lies inside a bracket small for any group size.
            accuracy = int(min(MAX_ACCURACY, max(ACCURACY, largest // 10_000)))
    accuracy = accuracy or ACCURACY
    if method == "exact":
        return _exact(df, by, value, probs, frequency, extra)
    if frequency:
        if by:
            return _weighted(df, by, value, probs, frequency, extra, max_exact_rows)
        return _weighted(df.withColumn(ALL, F.lit(0)), [ALL], value, probs, frequency, extra, max_exact_rows).drop(ALL)
    if method == "approximate":
        return _approximate(df, by, value, probs, accuracy, extra)
    if by:
        return _bracketed(df, by, value, probs, accuracy, extra)
    return _bracketed(df.withColumn(ALL, F.lit(0)), [ALL], value, probs, accuracy, extra).drop(ALL)
