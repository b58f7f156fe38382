"""Named queries over the benchmark tables, each with the SQL that states its result."""

from . import dependence, evaluation, fit, pricing, replay, season, series, tables, tickets  # noqa: F401
from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
