"""Fixture views, reports and the catalogue of queries."""
