"""Registered queries, the pairs they compare and the SQL they are checked against."""
