"""Registered queries of the library's own operators and their SQL."""

from __future__ import annotations

from .plans import additions, extras, frames, panels, streams, summaries  # noqa: F401  (they register their queries)
from .plans.registry import ORACLE_SQL, QUERIES

FLAGSHIP = "jon_phase_delta"

__all__ = ["FLAGSHIP", "ORACLE_SQL", "QUERIES"]
