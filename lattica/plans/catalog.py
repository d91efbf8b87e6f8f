"""All queries of the library, by name, and their SQL."""

from lattica.plans import analytics, evaluations, fields, files, more, numeric, physics, records, relational, streams  # noqa: F401  (they register themselves)
from lattica.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
