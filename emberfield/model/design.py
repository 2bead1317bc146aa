"""Design vectors as SQL expressions.

A specification is a plain dict:

- ``linear``: numeric columns;
- ``factors``: column to level list, reference first (dummy coding);
- ``smooths``: column to {center, scale, knots}: a linear term plus a truncated cubic per knot;
- ``psplines``: column to {center, scale, lower, upper, segments}: a linear term plus bends of a B-spline under a difference penalty;
- ``site``: {column, levels}: one dummy per known site, shrunk as a random intercept.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.quantiles import group_quantiles
from .splines import bend_columns

# A factor has a dozen or so levels as a rule; far beyond that the
# normal equations on the driver stop being small.
MAX_LEVELS = 1_000


@dataclass(frozen=True)
class Term:
    name: str
    expr: Column
    block: str  # "intercept", "fixed", "smooth:<column>" or "site"


def learn_smooths(df: DataFrame, columns: Sequence[str], knots: int = 5) -> dict[str, dict]:
    """Centre, scale and quantile knots (on the scaled axis) of each smooth column."""
    probs = [(i + 1) / (knots + 1) for i in range(knots)]
    # All columns as groups of one long table: the passes do not grow with the columns.
    long = df.select(*[F.col(c).cast("double").alias(c) for c in columns]).unpivot([], list(columns), "name", "v")
    extra = {"center": F.avg("v"), "scale": F.stddev("v")}
    out = {}
    for row in group_quantiles(long, ["name"], "v", probs, largest=df.count(), extra=extra).collect():
        center, scale = row["center"], row["scale"] or 1.0
        out[row["name"]] = {"center": center, "scale": scale, "knots": sorted({(v - center) / scale for v in row["q"]})}
    return {c: out[c] for c in columns}


def learn_levels(df: DataFrame, column: str, reference=None, max_levels: int = MAX_LEVELS) -> list:
    """Sorted levels of a column, the reference first. A column that is no factor is refused."""
    found = df.select(column).filter(F.col(column).isNotNull()).distinct().limit(max_levels + 1).collect()
    if len(found) > max_levels:
        raise ValueError(f"{column!r} has more than {max_levels} levels")
    levels = sorted(r[0] for r in found)
    if reference is None:
        return levels
    return [reference, *[v for v in levels if v != reference]]


def terms(spec: Mapping) -> list[Term]:
    """Terms of the design in a fixed order, the intercept first."""
    out = [Term("intercept", F.lit(1.0), "intercept")]
    for c in spec.get("linear", ()):
        out.append(Term(c, F.col(c).cast("double"), "fixed"))
    for c, levels in spec.get("factors", {}).items():
        for level in list(levels)[1:]:
            out.append(Term(f"{c}={level}", F.when(F.col(c) == F.lit(level), 1.0).otherwise(0.0), "fixed"))
    for c, s in spec.get("smooths", {}).items():
        t = (F.col(c).cast("double") - F.lit(float(s["center"]))) / F.lit(float(s["scale"]))
        out.append(Term(c, t, "fixed"))
        for i, k in enumerate(s["knots"]):
            bend = F.greatest(t - F.lit(float(k)), F.lit(0.0))
            out.append(Term(f"s({c}).{i + 1}", bend * bend * bend, f"smooth:{c}"))
    for c, s in spec.get("psplines", {}).items():
        out.append(Term(c, (F.col(c).cast("double") - F.lit(float(s["center"]))) / F.lit(float(s["scale"])), "fixed"))
        for i, bend in enumerate(bend_columns(F.col(c), s)):
            out.append(Term(f"p({c}).{i + 1}", bend, f"smooth:{c}"))
    site = spec.get("site")
    if site:
        for level in site["levels"]:
            hit = F.coalesce(F.col(site["column"]) == F.lit(level), F.lit(False))
            out.append(Term(f"site={level}", F.when(hit, 1.0).otherwise(0.0), "site"))
    return out


def is_complete(spec: Mapping) -> Column:
    """Is every predictor present and every factor inside its level list? Never NULL."""
    test = F.lit(True)
    for c in [*spec.get("linear", ()), *spec.get("smooths", {}), *spec.get("psplines", {})]:
        test = test & F.col(c).isNotNull()
    for c, levels in spec.get("factors", {}).items():
        test = test & F.coalesce(F.col(c).isin(list(levels)), F.lit(False))
    return test


def complete_rows(df: DataFrame, spec: Mapping) -> DataFrame:
    """Rows with every predictor present and every factor inside its level list."""
    return df.filter(is_complete(spec))


def design(df: DataFrame, spec: Mapping, x: str = "x") -> DataFrame:
    """Complete rows with their design vector in an array column."""
    return complete_rows(df, spec).withColumn(x, F.array(*[t.expr for t in terms(spec)]))
