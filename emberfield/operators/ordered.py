"""Row order at scale: ranks and neighbours when one group may hold most of the rows.

A window partitioned by group puts a whole group into one task. Groups too big for that are
range-partitioned by (group, order) instead, so a hot group is cut into many ranges. Each range is worked on alone, and what crosses a range border (row counts,
the last known value, a few neighbour rows) travels in a table with a few rows per range.

Range borders come from a sample, so two evaluations may cut differently. The cut rows are
therefore written once to the shared checkpoint folder before they are used.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import broadcast_if_small, durable

# Groups up to this size are left whole: one task sorts them comfortably.
MAX_GROUP_ROWS = 500_000
RANGE = "_range"
ALL = "_all"


def largest_group(df: DataFrame, by: Sequence[str]) -> int:
    """Rows in the largest group, by one map-side combined count."""
    if not by:
        return df.count()
    return df.groupBy(*by).count().agg(F.max("count")).first()[0] or 0


def needs_ranges(df: DataFrame, method: str, largest: int | None = None) -> bool:
    """Decide for a table without groups: ``window``, ``ranges``, or ``auto`` by its row count."""
    if method not in ("auto", "window", "ranges"):
        raise ValueError(f"unknown method {method!r}")
    if method == "auto":
        return (df.count() if largest is None else largest) > MAX_GROUP_ROWS
    return method == "ranges"


def hot_groups(df: DataFrame, by: Sequence[str]) -> DataFrame | None:
    """Keys of the groups too large for one task, or None. At most rows / MAX_GROUP_ROWS keys."""
    hot = durable(df.groupBy(*by).count().filter(F.col("count") > MAX_GROUP_ROWS).select(*by))
    return None if hot.isEmpty() else hot


def in_order(
    df: DataFrame, by: Sequence[str], method: str, whole: Callable[[DataFrame], DataFrame],
    cut: Callable[[DataFrame], DataFrame], largest: int | None = None,
) -> DataFrame:
    """Run an ordered operator by windows (``whole``), by ranges (``cut``), or each where it fits.

    With ``auto`` only the hot groups are cut; the other groups take the plain window. A known
    size of the ``largest`` group decides for the whole table and saves the count.
    """
    if method != "auto" or largest is not None or not by:
        return cut(df) if needs_ranges(df, method, largest) else whole(df)
    hot = hot_groups(df, by)
    if hot is None:
        return whole(df)
    keys = broadcast_if_small(hot).alias("h")
    match = _same("d", "h", by)
    rest = df.alias("d").join(keys, match, "left_anti")
    return whole(rest).unionByName(cut(df.alias("d").join(keys, match, "left_semi")))


def _ascending(names: Sequence[str]) -> list[Column]:
    return [F.col(c).asc_nulls_first() for c in names]


def _descending(names: Sequence[str]) -> list[Column]:
    return [F.col(c).desc_nulls_last() for c in names]


def _same(left: str, right: str, names: Sequence[str]) -> Column:
    return reduce(lambda a, b: a & b, [F.col(f"{left}.{c}").eqNullSafe(F.col(f"{right}.{c}")) for c in names])


@dataclass
class Ranges:
    """Rows cut into ordered ranges; ``rows`` carries the range number."""

    rows: DataFrame
    by: list[str]
    order: list[str]

    def window(self):
        """Rows of one group inside one range, in order."""
        return Window.partitionBy(RANGE, *self.by).orderBy(*_ascending(self.order))

    @property
    def ungrouped(self) -> bool:
        return self.by == [ALL]

    def border_groups(self) -> DataFrame:
        """Groups at a range border, at most two per range: only they can span ranges."""
        group = F.struct(*self.by)
        sizes = self.rows.groupBy(RANGE, *self.by).count()
        ends = sizes.groupBy(RANGE).agg(F.min(group).alias("lo"), F.max(group).alias("hi"))
        return ends.select(F.explode(F.array("lo", "hi")).alias("g")).select("g.*").distinct()

    def border_rows(self) -> DataFrame:
        """Rows of the border groups; the broadcast side has at most two rows per range."""
        if self.ungrouped:
            return self.rows
        groups = F.broadcast(self.border_groups()).alias("g")
        return self.rows.alias("r").join(groups, _same("r", "g", self.by), "left_semi")

    def with_border_flag(self, flag: str) -> DataFrame:
        """All rows, marked where their group touches a range border."""
        if self.ungrouped:
            return self.rows.withColumn(flag, F.lit(True))
        groups = F.broadcast(self.border_groups()).withColumn(flag, F.lit(True)).alias("g")
        joined = self.rows.alias("r").join(groups, _same("r", "g", self.by), "left")
        return joined.select("r.*", F.coalesce(F.col(f"g.{flag}"), F.lit(False)).alias(flag))

    def result(self, columns: Sequence[str]) -> DataFrame:
        """The rows without the range columns."""
        return self.rows.select(*columns)

    def attach(self, summary: DataFrame) -> DataFrame:
        """Join a per-(range, group) summary of border groups, bounded by the range count."""
        names = [RANGE, *self.by]
        extra = [c for c in summary.columns if c not in names]
        joined = self.rows.alias("r").join(F.broadcast(summary).alias("s"), _same("r", "s", names), "left")
        return joined.select("r.*", *[F.col(f"s.{c}") for c in extra])


def split_ranges(df: DataFrame, by: Sequence[str], order: Sequence[str], ranges: int | None = None) -> Ranges:
    """Cut ``df`` into ranges of (by, order). ``order`` must end in a unique tie-break."""
    by = list(by)
    if not by:
        df, by = df.withColumn(ALL, F.lit(0)), [ALL]
    count = ranges or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cut = df.repartitionByRange(count, *_ascending([*by, *order]))
    return Ranges(durable(cut.withColumn(RANGE, F.spark_partition_id())), by, list(order))


def row_rank(
    df: DataFrame, by: Sequence[str], order: Sequence[str], name: str = "rank", method: str = "auto",
    total: str = "n", ranges: int | None = None, largest: int | None = None, counted: str | None = None,
) -> DataFrame:
    """Row number from 1 inside each group, and the group's row count: of the rows where ``counted``, if given, is not NULL."""
    held = F.lit(1) if counted is None else F.col(counted)
    return in_order(
        df, by, method, lambda rows: _rank_whole(rows, by, order, name, total, held),
        lambda rows: _rank_ranges(rows, by, order, name, total, ranges, held), largest)


def _rank_whole(df: DataFrame, by, order, name: str, total: str, held: Column) -> DataFrame:
    w = Window.partitionBy(*(list(by) or [F.lit(0)]))
    numbered = df.withColumn(name, F.row_number().over(w.orderBy(*_ascending(order))).cast("bigint"))
    return numbered.withColumn(total, F.count(held).over(w))


def _rank_ranges(df: DataFrame, by, order, name: str, total: str, ranges: int | None, held: Column) -> DataFrame:
    cut = split_ranges(df, by, order, ranges)
    sizes = cut.border_rows().groupBy(RANGE, *cut.by).agg(F.count(F.lit(1)).alias("_size"), F.count(held).alias("_held"))
    before = Window.partitionBy(*cut.by).orderBy(RANGE).rowsBetween(Window.unboundedPreceding, -1)
    summary = sizes.select(
        RANGE, *cut.by,
        F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_before"),
        F.sum("_held").over(Window.partitionBy(*cut.by)).alias("_total"),
    )
    whole = Window.partitionBy(RANGE, *cut.by)
    rows = cut.attach(summary)
    rows = rows.withColumn(name, F.coalesce("_before", F.lit(0)) + F.row_number().over(cut.window()))
    rows = rows.withColumn(total, F.coalesce("_total", F.count(held).over(whole)))
    return rows.select(*df.columns, name, total)


def display_order(
    df: DataFrame, order: Sequence[str | tuple[str, Sequence]], position: str = "position", method: str = "auto",
) -> DataFrame:
    """A result table sorted for reading, with the row number in an explicit column.

    ``order`` names columns, or pairs of a column and its level list: levels sort by their place in the list. Missing
    values, and values outside a list, come last. ``order`` must end in a unique tie-break. The sort is by ranges, so the
    table may have any size; a reader who needs the order later has ``position``.
    """
    keys, names = {}, []
    for i, item in enumerate(order):
        col, levels = (item, None) if isinstance(item, str) else item
        value = F.col(col) if levels is None else F.array_position(F.array(*map(F.lit, levels)), F.col(col)).cast("int")
        value = value if levels is None else F.when(value > 0, value)
        keys |= {f"_gap{i}": value.isNull(), f"_key{i}": value}
        names += [f"_gap{i}", f"_key{i}"]
    ranked = row_rank(df.withColumns(keys), [], names, position, method=method, total="_n")
    return ranked.select(*df.columns, position).orderBy(position)
