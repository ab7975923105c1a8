"""Imports every catalogue module so that their queries are registered."""

from simlens.catalog import cleaning, dependence, inference, modes, reduction, relational, reports, simulation, stored  # noqa: F401
from simlens.catalog.base import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
