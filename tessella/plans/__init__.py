"""Registered queries over the stand-in tables, each with its SQL oracle where SQL can express it."""

from tessella.plans import comparison, evaluation, governance, labelling, more, selection, storage  # noqa: F401  they register their queries
from tessella.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
