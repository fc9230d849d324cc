"""The registered queries over the given tables, each with an independent SQL version where SQL can say it."""

from tallybox.plans import analysis, detection, files, records  # noqa: F401
from tallybox.plans.tables import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
