"""Cubic B-splines on equal segments, and smooths under a difference penalty, as SQL expressions.

On one segment every basis function is a cubic in the place within the segment, so that a column of the design
is four lookups by segment and a Horner step, whatever the number of segments. A smooth takes a linear term and bends: with D the matrix of second
differences, the bends are the basis times D'(DD')^-1, whose coefficients are the second differences themselves. Independent
normal coefficients on the bends are therefore the difference penalty, constants and lines stay with the intercept and the linear term, and the
spread of the coefficients (the smoothing) is found like that of any block, from the sums of products alone.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DEGREE, ORDER = 3, 2
# The four cubics of a uniform cubic B-spline that are not zero on a segment, by powers of the place within it, times 6.
LOCAL = np.array([[1, -3, 3, -1], [4, 0, -6, 3], [1, 3, 3, -3], [0, 0, 0, 1]], dtype=np.float64)


def learn_psplines(df: DataFrame, columns: Sequence[str], segments: int = 10) -> dict[str, dict]:
    """Range, centre and scale of each column in one pass; a column without values, or with one value, gets a range of one."""
    if segments < 1:
        raise ValueError("at least one segment")
    aggs = [f(F.col(c).cast("double")) for c in columns for f in (F.min, F.max, F.avg, F.stddev)]
    row = df.agg(*[a.alias(f"v{i}") for i, a in enumerate(aggs)]).first()
    out = {}
    for i, c in enumerate(columns):
        low, high, mid, sd = row[4 * i: 4 * i + 4]
        low = 0.0 if low is None else low
        high = low + 1.0 if high is None or high == low else high
        out[c] = {"lower": low, "upper": high, "segments": segments, "center": low if mid is None else mid, "scale": sd or 1.0}
    return out


def pieces(segments: int, weights: np.ndarray | None = None) -> np.ndarray:
    """(columns, segments, 4): the cubic of each column on each segment, columns being the basis functions or ``weights`` (functions x columns) of them."""
    basis = np.zeros((segments + DEGREE, segments, 4))
    for m in range(segments):
        basis[m: m + 4, m] = LOCAL / 6.0
    return basis if weights is None else np.einsum("bmk,bj->jmk", basis, weights)


def bends(segments: int) -> np.ndarray:
    """Basis weights (functions x bends) whose second differences are one for their own bend and zero for the others."""
    D = np.diff(np.eye(segments + DEGREE), ORDER, axis=0)
    return D.T @ np.linalg.inv(D @ D.T)


def _evaluate(x: Column, spec: Mapping, table: np.ndarray) -> list[Column]:
    segments = int(spec["segments"])
    t = (x.cast("double") - F.lit(float(spec["lower"]))) * F.lit(segments / (float(spec["upper"]) - float(spec["lower"])))
    # ``least`` and ``greatest`` skip NULL, which would place a missing value at a border.
    t = F.when(x.isNotNull(), F.greatest(F.least(t, F.lit(float(segments))), F.lit(0.0)))
    at = F.least(F.floor(t).cast("int"), F.lit(segments - 1))
    u = t - at
    out = []
    for cubics in table:
        c0, c1, c2, c3 = (F.get(F.array(*[F.lit(float(v)) for v in cubics[:, k]]), at) for k in range(4))
        out.append(((c3 * u + c2) * u + c1) * u + c0)
    return out


def bspline_columns(x: Column, spec: Mapping) -> list[Column]:
    """The ``segments + 3`` basis functions at ``x``. Beyond the range they keep the value of its border; NULL stays NULL."""
    return _evaluate(x, spec, pieces(int(spec["segments"])))


def bend_columns(x: Column, spec: Mapping) -> list[Column]:
    """The ``segments + 1`` bends at ``x``; beyond the range they are level, so that only the linear term goes on."""
    n = int(spec["segments"])
    return _evaluate(x, spec, pieces(n, bends(n)))
