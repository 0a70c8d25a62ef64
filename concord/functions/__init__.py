"""Column expressions: text forms and hashes, field variance, verdicts."""
