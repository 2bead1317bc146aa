"""Column expressions with the missing-value rules of field data.

Everything here is a built-in Spark expression, so it stays inside code generation.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The month headings of the rainfall sheet, January to December.
MONTH_NAMES = ["Jan", "Feb", "March", "April", "May", "June", "July", "Aug", "Sept", "Oct", "Nov", "Dec"]


def _c(col: Column | str) -> Column:
    return F.col(col) if isinstance(col, str) else col


def as_number(col: Column | str) -> Column:
    """Number in a text cell; NULL where the cell holds none (never an error)."""
    return _c(col).try_cast("double")


def scale_units(col: Column | str, factor: float) -> Column:
    return _c(col) * F.lit(float(factor))


def log10_positive(col: Column | str) -> Column:
    """log10, NULL at and below zero."""
    return F.when(_c(col) > 0, F.log10(_c(col)))


def ln_positive(col: Column | str) -> Column:
    """Natural log, NULL at and below zero."""
    return F.when(_c(col) > 0, F.log(_c(col)))


def pow10(col: Column | str) -> Column:
    return F.pow(F.lit(10.0), _c(col))


def is_finite_log(col: Column | str) -> Column:
    """True where the log of the value is a finite number."""
    return F.coalesce(_c(col) > 0, F.lit(False))


def paste(*cols: Column | str, sep: str = "") -> Column:
    """Join texts the way a spreadsheet user expects: a missing part reads ``NA``."""
    parts = [F.coalesce(_c(c).cast("string"), F.lit("NA")) for c in cols]
    if not sep:
        return F.concat(*parts)
    return F.concat_ws(sep, *parts)


def month_of(date: Column | str) -> Column:
    return F.month(_c(date))


def week_index(date: Column | str, first: Column) -> Column:
    """Whole weeks from ``first`` to ``date``."""
    return F.floor(F.datediff(_c(date), first) / F.lit(7)).cast("bigint")


def build_date(year: Column | str, month: Column | str, day: Column | str) -> Column:
    """Date from three numbers; NULL where they name no day of the calendar."""
    parts = [_c(c).try_cast("int").cast("string") for c in (year, month, day)]
    text = F.concat(parts[0], F.lit("-"), parts[1], F.lit("-"), parts[2])
    return F.try_to_date(text, "y-M-d")


def month_number(name: Column | str) -> Column:
    """1 to 12 for a month heading, NULL for any other text."""
    return F.nullif(F.array_position(F.array(*[F.lit(m) for m in MONTH_NAMES]), _c(name)), F.lit(0)).cast("int")


def build_date_named(year: Column | str, month_name: Column | str, day: Column | str) -> Column:
    return build_date(year, month_number(month_name), day)
