"""Whole jobs: preflight contracts, reconciliation, summaries and reports."""
