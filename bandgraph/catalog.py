"""Registered queries of the panel analytics engine, and their SQL."""

from bandgraph.plans.oracle import ORACLE
from bandgraph.plans.queries import QUERIES

FLAGSHIP = "zscore_returns"
__all__ = ["FLAGSHIP", "ORACLE", "QUERIES"]
