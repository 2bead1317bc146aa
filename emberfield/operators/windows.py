"""Rolling means and gap filling over ordered rows (rows, not calendar days)."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ordered import RANGE, Ranges, _ascending, _descending, in_order, row_rank, split_ranges


def _frame(k: int, align: str) -> tuple[int, int]:
    """Rows before and after the current one in a window of ``k`` rows."""
    if align == "center":
        before = (k - 1) // 2
    elif align == "right":
        before = k - 1
    elif align == "left":
        before = 0
    else:
        raise ValueError(f"unknown alignment {align!r}")
    return before, k - 1 - before


def _guarded_mean(col: str, k: int, w) -> Column:
    """Mean over the frame, NULL unless all ``k`` rows exist and hold a value."""
    return F.when(F.count(col).over(w) == k, F.avg(col).over(w))


def rolling_mean(
    df: DataFrame, columns: dict[str, tuple[str, int]], order: Sequence[str], by: Sequence[str] = (),
    align: str = "center", method: str = "auto", ranges: int | None = None,
) -> DataFrame:
    """Rolling means of ``k`` rows; ``columns`` maps a new name to (source column, k).

    A window of two centred rows covers the current and the next row. ``order`` must end in a
    unique tie-break.
    """
    def whole(rows: DataFrame) -> DataFrame:
        w = Window.partitionBy(*(list(by) or [F.lit(0)])).orderBy(*_ascending(order))
        return rows.withColumns(_means(_spans(columns, align), w))

    def cut(rows: DataFrame) -> DataFrame:
        return rolling_ranges(split_ranges(rows, by, order, ranges), columns, align).result([*df.columns, *columns])

    return in_order(df, by, method, whole, cut)


def _spans(columns: dict[str, tuple[str, int]], align: str) -> dict:
    return {name: (col, k, *_frame(k, align)) for name, (col, k) in columns.items()}


def _means(spans: dict, w) -> dict[str, Column]:
    return {name: _guarded_mean(col, k, w.rowsBetween(-a, b)) for name, (col, k, a, b) in spans.items()}


def rolling_ranges(cut: Ranges, columns: dict[str, tuple[str, int]], align: str = "center") -> Ranges:
    """Rolling means on rows already cut into ranges."""
    spans = _spans(columns, align)
    before, after = max(s[2] for s in spans.values()), max(s[3] for s in spans.values())
    reach = before + after
    # Rows near the end of a piece that continues in another range take their means from the
    # edge table, which holds the last few rows of every such piece and nothing else.
    whole = Window.partitionBy(RANGE, *cut.by)
    placed = (
        cut.with_border_flag("_border")
        .withColumn("_first", F.row_number().over(cut.window()))
        .withColumn("_last", F.count(F.lit(1)).over(whole) - F.col("_first") + 1)
    )
    touched = F.col("_border") & ((F.col("_first") <= before) | (F.col("_last") <= after))
    near = F.col("_border") & ((F.col("_first") <= reach) | (F.col("_last") <= reach))
    across = Window.partitionBy(*cut.by).orderBy(*_ascending(cut.order))
    inner = placed.withColumns(_means(spans, cut.window())).filter(~touched)
    edges = placed.filter(near).withColumns(_means(spans, across)).filter(touched)
    names = [*cut.rows.columns, *spans]
    return replace(cut, rows=inner.select(*names).unionByName(edges.select(*names)))


def _so_far(group, order: list[Column]):
    """Rows up to the current one. Looking ahead is written as looking back in reverse order:
    a growing frame is updated row by row, a shrinking one is computed anew for each row."""
    return group.orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)


def fill_down_up(
    df: DataFrame, columns: Sequence[str], order: Sequence[str], by: Sequence[str] = (),
    method: str = "auto", ranges: int | None = None,
) -> DataFrame:
    """Fill gaps with the last known value, and leading gaps with the first known one."""
    def whole(rows: DataFrame) -> DataFrame:
        group = Window.partitionBy(*(list(by) or [F.lit(0)]))
        down, up = _so_far(group, _ascending(order)), _so_far(group, _descending(order))
        return rows.withColumns({c: F.coalesce(F.last(c, True).over(down), F.last(c, True).over(up)) for c in columns})

    def cut(rows: DataFrame) -> DataFrame:
        return fill_ranges(split_ranges(rows, by, order, ranges), columns).result(df.columns)

    return in_order(df, by, method, whole, cut)


def fill_ranges(cut: Ranges, columns: Sequence[str]) -> Ranges:
    """Gap filling on rows already cut into ranges."""
    # Only rows with a value compete, so the pick is the first or last known value of the piece.
    place = F.struct(*cut.order)
    known = cut.border_rows().groupBy(RANGE, *cut.by).agg(*[
        pick(c, F.when(F.col(c).isNotNull(), place)).alias(f"{tag}{c}")
        for c in columns for tag, pick in (("_head_", F.min_by), ("_tail_", F.max_by))
    ])
    pieces = Window.partitionBy(*cut.by)
    earlier = pieces.orderBy(F.col(RANGE).asc()).rowsBetween(Window.unboundedPreceding, -1)
    later = pieces.orderBy(F.col(RANGE).desc()).rowsBetween(Window.unboundedPreceding, -1)
    summary = known.select(
        RANGE, *cut.by,
        *[F.last(f"_tail_{c}", True).over(earlier).alias(f"_down_{c}") for c in columns],
        *[F.last(f"_head_{c}", True).over(later).alias(f"_up_{c}") for c in columns],
    )
    piece = Window.partitionBy(RANGE, *cut.by)
    down, up = _so_far(piece, _ascending(cut.order)), _so_far(piece, _descending(cut.order))
    rows = cut.attach(summary).withColumns({
        c: F.coalesce(F.last(c, True).over(down), f"_down_{c}", F.last(c, True).over(up), f"_up_{c}") for c in columns
    })
    return replace(cut, rows=rows.select(*cut.rows.columns))


def row_id(df: DataFrame, order: Sequence[str], name: str = "id", method: str = "auto") -> DataFrame:
    """Row number over the whole table in a declared order."""
    return row_rank(df, [], order, name, method=method, total="_n").drop("_n")


def ccdf(
    df: DataFrame, by: Sequence[str], value: str, tie: Sequence[str], name: str = "ccdf",
    method: str = "auto", ranges: int | None = None, largest: int | None = None,
) -> DataFrame:
    """Share of a group's values that are at least this one: 1 for the smallest, 1/n for the largest.

    Ties are ordered by ``tie``, which makes the curve the same on every run. A missing value comes last, has no share and
    does not count in n.
    """
    placed = df.withColumn("_missing", F.col(value).isNull())
    ranked = row_rank(
        placed, by, ["_missing", value, *tie], "_rank", method=method, total="_n", ranges=ranges, largest=largest, counted=value)
    share = (F.col("_n") - F.col("_rank") + 1).cast("double") / F.col("_n")
    return ranked.withColumn(name, F.when(~F.col("_missing"), share)).drop("_rank", "_n", "_missing")
