"""Readers, writers and HTML extraction."""
