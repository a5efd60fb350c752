"""Fixture views over the given tables, and the catalogue of registered queries."""
