"""Whole dataflows and the registry of queries."""
