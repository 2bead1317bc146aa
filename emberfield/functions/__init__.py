from .rng import noise_words, standard_normal, student_t, uniform
from .scalars import (
    MONTH_NAMES,
    as_number,
    build_date,
    build_date_named,
    is_finite_log,
    ln_positive,
    log10_positive,
    month_number,
    month_of,
    paste,
    pow10,
    scale_units,
    week_index,
)

__all__ = [
    "MONTH_NAMES", "as_number", "build_date", "build_date_named", "is_finite_log", "ln_positive",
    "log10_positive", "month_number", "month_of", "noise_words", "paste", "pow10", "scale_units",
    "standard_normal", "student_t", "uniform", "week_index",
]
