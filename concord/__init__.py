"""Compare two datasets that ought to agree, on Spark."""

from concord.domain import Domain, Enrichment, Field, Side
from concord.operators.hashview import hash_view
from concord.plans.reconcile import Result, reconcile

__all__ = ["Domain", "Enrichment", "Field", "Result", "Side", "hash_view", "reconcile"]
