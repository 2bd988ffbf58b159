"""The registered queries and the SQL each one is checked against."""

from prepforge.queries import evaluation, governance, lifecycle, modelling, preparation, sql
from prepforge.queries.base import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES", "evaluation", "governance", "lifecycle", "modelling", "preparation", "sql"]
