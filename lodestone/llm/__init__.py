"""Operators for large text corpora: one module per operator, `catalog` registers the queries."""
