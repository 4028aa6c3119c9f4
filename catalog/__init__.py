"""Every registered query, by operator family."""

from catalog import rollups, series, forecasts, sources, signals, planning, evaluation, readiness, models  # noqa: F401
from catalog.base import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES"]
