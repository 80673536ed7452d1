"""All registered queries and their SQL twins."""

from __future__ import annotations

from tidegrid.plans import bars, bursts, features, quotes, rates, returns, sessions, sources, spine  # noqa: F401  (they register on import)
from tidegrid.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
