"""Registered queries; importing this package fills the registry."""

from lodestrata.plans import views  # noqa: F401  (views first: twins expand them)
from lodestrata.plans import corpus, flows, layered, relational, text  # noqa: F401
from lodestrata.plans.base import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
