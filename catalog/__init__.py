"""Registered queries over the given tables, each with its SQL counterpart where one exists."""

from . import columns, models, ordering, summaries, tables  # noqa: F401
from .common import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
