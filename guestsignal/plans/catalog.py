"""All named queries."""

from guestsignal.plans import catalog_documents, catalog_orders, catalog_profiles
from guestsignal.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES", "catalog_documents", "catalog_orders", "catalog_profiles"]
