"""Composed plans, and the registry of queries with their SQL."""
