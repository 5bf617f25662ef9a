"""All queries by key."""

from __future__ import annotations

from . import cohorts, extras, joins, kernel, models, rules, sections, series, text  # noqa: F401  (importing registers)
from .base import QUERIES, Query

__all__ = ["QUERIES", "Query"]
