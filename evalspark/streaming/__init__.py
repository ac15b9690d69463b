"""Incremental result log."""
