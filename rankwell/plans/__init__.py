"""Registered queries and their SQL."""

from rankwell.plans import bandits, cleaning, exact, histograms, index, reports, vectors
from rankwell.plans.base import QUERIES, SQL

__all__ = ["QUERIES", "SQL", "bandits", "cleaning", "exact", "histograms", "index", "reports", "vectors"]
