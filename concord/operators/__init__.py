"""Relational steps: hash view, alignment, enrichment, scope and discrepancy filters."""
