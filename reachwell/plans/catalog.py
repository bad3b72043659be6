"""Named queries over the driver tables, each with the SQL that must agree with it."""

from reachwell.plans import analysis, model, places, shapes  # noqa: F401
from reachwell.plans.registry import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES"]
